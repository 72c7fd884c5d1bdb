"""Rule expressions: severity, protocol decoding, fusion conditions.

All rules are built from the fixed tables in ``constants`` into native
``CASE WHEN`` expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def severity_infer(attack_type: Column, confidence: Column) -> Column:
    """Severity from attack type and confidence; unknown type -> MEDIUM."""
    out = None
    for name, thr, above, below in K.SEVERITY_RULES:
        val = F.lit(above) if thr is None else F.when(confidence > F.lit(thr), above).otherwise(below)
        out = F.when(attack_type == name, val) if out is None else out.when(attack_type == name, val)
    return out.otherwise(K.SEVERITY_DEFAULT)


def severity_normalize(given: Column, attack_type: Column, confidence: Column) -> Column:
    """Given severity wins (upper-cased; the text "None" means LOW); an
    empty/missing one falls back to inference."""
    has = given.isNotNull() & (given != "")
    return (F.when(has & (given == "None"), F.lit("LOW"))
            .when(has, F.upper(given))
            .otherwise(severity_infer(attack_type, confidence)))


def decode_protocol(cols: list[str]) -> Column:
    """One-hot ``proto_<n>`` columns -> protocol name, first match wins."""
    out = None
    for num, name in K.PROTOCOL_NAMES:
        cname = f"proto_{num}"
        if cname not in cols:
            continue
        cond = F.coalesce(F.col(cname) == 1, F.lit(False))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(K.UNKNOWN_PROTOCOL) if out is None else out.otherwise(K.UNKNOWN_PROTOCOL)


def decode_protocol_number(protocol: Column) -> Column:
    """Protocol number -> name, for tables that keep the raw number."""
    out = None
    for num, name in K.PROTOCOL_NAMES:
        cond = protocol.cast("string") == num
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(K.UNKNOWN_PROTOCOL)
