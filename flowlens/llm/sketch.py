"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A sketch keeps every shingle hash below a fixed fraction of the hash range.
What is kept depends on the shingle alone, so the sketch of a union is the
union of the sketches, and the share of common hashes estimates Jaccard and
containment between texts of any lengths.  A text of which too few hashes
would be kept has a larger fraction, doubled until enough are, or all; two
sketches are compared, and merged, at the smaller fraction of the two, to
which the other is cut.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, columns
from .textvec import Substrings

#: Bytes of a shingle; a shorter text that is not empty is one shingle.
SHINGLE = 8
#: One shingle in so many is kept.
SCALE = 16
#: Hashes that a sketch has at least, unless it has all.
ENOUGH = 256
#: Rows that share a stretch of ids, the unit of work of the pairing.
STRETCH = 500

_KEEP = 48                                             # bits kept of a hash


@dataclass
class Sketch:
    """The whole text's hash, one in how many shingles is kept, and the sorted
    distinct hashes, cut to 48 bits, that lie below that fraction."""
    name: str
    scale: int
    hashes: np.ndarray

    def at(self, scale: int) -> np.ndarray:
        """The hashes of the sketch at a coarser scale."""
        return self.hashes[:np.searchsorted(self.hashes, np.uint64(_limit(scale)))]


def _limit(scale: int) -> int:
    return (1 << _KEEP) // scale


def sketch(text: bytes, shingle: int = SHINGLE, scale: int = SCALE, enough: int = ENOUGH) -> Sketch:
    """``scale`` is a power of two; it is halved while fewer than ``enough``
    hashes are kept."""
    name = hashlib.blake2b(text, digest_size=8).hexdigest()
    if not text:
        return Sketch(name, 1, np.zeros(0, np.uint64))
    s = Substrings(np.frombuffer(text, np.uint8))
    h = s.windows(shingle) if len(text) >= shingle else s.hash(np.array([0]), np.array([len(text)]))
    h = h >> np.uint64(64 - _KEEP)
    while True:
        kept = np.unique(h[h < np.uint64(_limit(scale))])
        if scale == 1 or len(kept) >= enough:
            return Sketch(name, scale, kept)
        scale //= 2


def merge(a: Sketch, b: Sketch) -> np.ndarray:
    """The hashes of two texts' shingles together, at the coarser scale."""
    scale = max(a.scale, b.scale)
    return np.union1d(a.at(scale), b.at(scale))


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has; zero if ``a`` kept
    none at the coarser scale."""
    scale = max(a.scale, b.scale)
    x = a.at(scale)
    return len(np.intersect1d(x, b.at(scale), assume_unique=True)) / len(x) if len(x) else 0.0


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard: one for equal texts, zero if neither sketch has a
    hash."""
    if a.name == b.name:
        return 1.0
    scale = max(a.scale, b.scale)
    x, y = a.at(scale), b.at(scale)
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    return both / union if union else 0.0


def encode(f: Sketch) -> str:
    """The whole-text hash, the scale, and the sketch's 6-byte values in
    base64, set apart by colons."""
    raw = f.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _KEEP // 8:]
    return f"{f.name}:{f.scale}:{base64.b64encode(raw.tobytes()).decode()}"


def decode(s: str) -> Sketch:
    name, scale, body = s.split(":")
    raw = np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, _KEEP // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - _KEEP // 8:] = raw
    return Sketch(name, int(scale), wide.view(">u8").ravel().astype(np.uint64))


def edited(text: str, other: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as
    many of ``other``, or all of them."""
    n = len(text) // 4
    return text[:len(text) - n] + other[:n]


_OUT = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                  ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                  ("contained_edited", pa.float64()), ("contained_next", pa.float64())])


def _pairs(shingle, scale):
    def run(batches):
        last = None                                     # (stretch, own, id, text, fingerprint)
        for stretch, own, ids, texts in columns(batches):
            rows = []
            for p, o, i, t in zip(stretch, own, ids, texts):
                t = t or ""
                here = (p, o, i, t, sketch(t.encode(), shingle, scale))
                if last and last[0] == p and last[1]:
                    _, _, i0, t0, f0 = last
                    e = edited(t0, t).encode()
                    fe = sketch(e, shingle, scale)
                    rows.append((i0, len(t0), hashlib.sha256(e).hexdigest(), encode(f0), encode(fe), likeness(f0, fe),
                                 likeness(f0, here[4]), containment(f0, fe), containment(f0, here[4])))
                last = here
            if rows:
                yield batch(_OUT, *zip(*rows))
    return run


def _stretches(bounds, lowest):
    """``(stretch, own, wraps)`` for each id: its own stretch of ids, and, for
    the row that another stretch or the end of the table needs as its next
    one, that one too."""
    edges = np.array(bounds, np.int64)
    end = len(edges)

    @F.pandas_udf("array<struct<stretch:int,own:boolean,wraps:boolean>>")
    def place(ids: pd.Series) -> pd.Series:
        missing = ids.isna().to_numpy()
        x = ids.fillna(0).to_numpy(np.int64)
        p = np.where(missing, end, np.searchsorted(edges, x, side="right"))
        first = ~missing & np.isin(x, edges)
        out = []
        for i, k, f, m in zip(x.tolist(), p.tolist(), first.tolist(), missing.tolist()):
            row = [{"stretch": k, "own": True, "wraps": False}]
            if f:
                row.append({"stretch": k - 1, "own": False, "wraps": False})
            if not m and i == lowest:
                row.append({"stretch": end, "own": False, "wraps": True})
            out.append(row)
        return pd.Series(out)
    return place


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                      scale: int = SCALE, stretch: int = STRETCH) -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, contained_edited, contained_next)`` per row.

    The next document follows in ascending order of the id, then of the text's
    hash; the first one follows the last.  Rows with a null id come last.  A
    null text is an empty one; its sketch is empty.  Of short texts all
    shingles are kept, so that their likeness is exact.  Repeated rows follow each other; extra columns
    are ignored; an empty table gives an empty one.  Ids are dealt into
    stretches between quantiles of the ids; the first rows of a stretch also
    go to the stretch before it, so each text moves once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n, lowest = rows.agg(F.count("*"), F.min("id")).first()
    cuts = min(20_000, n // stretch)
    bounds = []
    if cuts > 1:
        bounds = rows.agg(F.percentile_approx("id", [k / cuts for k in range(1, cuts)], 50_000)).first()[0] or []
        bounds = sorted({b for b in bounds if b is not None and b > lowest})
    if lowest is None and n:                            # no ids at all: any first row closes the circle
        rows = rows.withColumn("id", F.lit(None).cast("long"))
    placed = rows.withColumn("p", F.explode(_stretches(bounds, lowest)("id"))).select(
        "p.stretch", "p.own", "id", "text", F.col("p.wraps").alias("wraps"), F.xxhash64("text").alias("tie"))
    if lowest is None and n:
        head = placed.orderBy("tie").limit(1).select("stretch", F.lit(False).alias("own"), "id", "text",
                                                     F.lit(True).alias("wraps"), "tie")
        placed = placed.unionByName(head)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (placed.repartition(parts, "stretch")
            .sortWithinPartitions("stretch", "wraps", F.col("id").asc_nulls_last(), "tie", F.col("own").desc())
            .select("stretch", "own", "id", "text").mapInArrow(
                _pairs(shingle, scale),
                "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                "near_edited double, near_next double, contained_edited double, contained_next double"))
