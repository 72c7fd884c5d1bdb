"""One missing-value convention: NaN and +-Infinity become NULL on ingest.

pandas has a single "missing" (NaN) whose behaviour differs from SQL NULL in
a few places; these helpers give the pandas behaviour with NULLs, all as
native expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(name: str) -> Column:
    """Column by name; names holding ``/`` or spaces are back-quoted."""
    return F.col(f"`{name}`") if not name.startswith("`") else F.col(name)


def finite(x: Column) -> Column:
    """NaN / +-Infinity -> NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def to_double(x: Column) -> Column:
    """Lenient numeric coercion: unparsable -> NULL, then non-finite -> NULL."""
    return finite(x.try_cast("double"))


def floor_at(x: Column, lo: float) -> Column:
    """clip(lower=lo) that keeps NULL (``greatest`` would turn NULL into lo)."""
    return F.when(x < F.lit(lo), F.lit(lo)).otherwise(x)


def zero_to(x: Column, v: float) -> Column:
    """replace(0, v): only exact zeros change."""
    return F.when(x == F.lit(0.0), F.lit(v)).otherwise(x)


def div(a: Column, b: Column) -> Column:
    """Division that never raises: x/0 -> NULL (pandas would give inf, which
    the convention maps to NULL)."""
    return finite(F.try_divide(a, b))


def nz(x: Column) -> Column:
    """Missing -> 0 (row sums that skip missing values)."""
    return F.coalesce(x, F.lit(0.0))


def row_sum(cols: list[Column]) -> Column:
    """pandas ``sum(axis=1)``: missing terms are skipped."""
    out = None
    for x in cols:
        out = nz(x) if out is None else out + nz(x)
    return out


def flag(cond: Column) -> Column:
    """Boolean condition -> 0/1 with missing -> 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")
