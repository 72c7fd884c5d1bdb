"""Exact, interpolated quantiles that never hold a column in one buffer.

Spark's exact ``percentile`` / ``median`` keep every distinct value of a
column in one aggregation buffer.  Here the order statistics are found
exactly, for all columns and all levels at once, in two steps:

1. brackets: passes in which each task counts, per column, its values by
   stretch of the number line (first by the leading 16 bits of the value, then
   each stretch that holds a wanted rank by ten bits more), with the smallest
   and the largest, until such a stretch holds one value or few rows;
2. one pass in which each task counts, per column, the distinct values inside
   the brackets (about 4 n / A of them) and, for every stretch between two
   brackets, its values together (with the smallest and the largest), so that
   heavily repeated values cost one row each.  Running counts over the merged
   rows give the ranks.

What a task hands on in 1. is bounded by the stretches, whatever its rows: no
sketch of a column is merged in one task.  Interpolation is linear between the two neighbouring order statistics, as
``percentile`` / numpy do.  The driver receives two rows per column and
level.  A bracket that misses its rank raises.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 100_000


def _col(c: str):
    v = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(v), v)


def exact_quantiles_multi(df: DataFrame, cols: list[str], qs: list[float],
                          accuracy: int = ACCURACY) -> list[list[float | None]]:
    """Exact quantiles ``qs`` of each column (NULL / NaN ignored; a column
    without values gives NULLs)."""
    if not cols or not qs:
        return [[] for _ in cols]
    x = df.select(*[_col(c).alias(f"x{i}") for i, c in enumerate(cols)])
    size, spans = _brackets(x, qs, accuracy)
    ends = [np.array([v for span in spans[i] for v in span]) for i in range(len(cols))]
    wanted = [[q * (n - 1) for q in qs] if n else [] for n in size]
    out: list[list[float | None]] = [[None] * len(qs) for _ in cols]
    if not any(len(w) for w in wanted):
        return out
    counted = x.mapInArrow(_count(ends), "s int, zone int, v double, n long, lo double, hi double")
    g = counted.groupBy("s", "zone", "v").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    w = Window.partitionBy("s").orderBy("zone", "v").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("cum", F.sum("n").over(w))
    # Ranks [cum - n, cum) carry the row's value; of a stretch between brackets
    # only its first and its last rank are known.
    inside = F.col("zone") % 2 == 1
    r = g.select("s", "lo", "hi", (F.col("cum") - F.col("n")).alias("a"), (F.col("cum") - 1).alias("b"), inside.alias("inside"))
    ranks = [(i, k) for i, w_ in enumerate(wanted) for pos in w_ for k in (math.floor(pos), min(math.floor(pos) + 1, size[i] - 1))]
    want = df.sparkSession.createDataFrame(sorted(set(ranks)), "s int, rank long")
    hit = r.join(F.broadcast(want), "s").where((F.col("rank") >= F.col("a")) & (F.col("rank") <= F.col("b")) & (
        F.col("inside") | (F.col("rank") == F.col("a")) | (F.col("rank") == F.col("b"))))
    value = F.when(~F.col("inside") & (F.col("rank") == F.col("b")), F.col("hi")).otherwise(F.col("lo"))
    found = {(h.s, h["rank"]): h.v for h in hit.select("s", "rank", value.alias("v")).collect()}
    for i, w_ in enumerate(wanted):
        for k, pos in enumerate(w_):
            k0 = math.floor(pos)
            k1 = min(k0 + 1, size[i] - 1)
            if (i, k0) not in found or (i, k1) not in found:
                raise RuntimeError(f"quantile {qs[k]} of {cols[i]}: rank outside its bracket")
            v0, v1 = found[i, k0], found[i, k1]
            out[i][k] = v0 if v1 == v0 or pos == k0 else v0 + (pos - k0) * (v1 - v0)
    return out


#: Leading bits that tell the first stretches apart, and those of each refinement.
LEAD, STEP = 16, 10


def _ordered(v: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers ``v``."""
    b = (v + 0.0).view(np.uint64)
    return np.where(b >> np.uint64(63) == 1, ~b, b | np.uint64(1 << 63))


_STRETCH = pa.schema([("s", pa.int32()), ("b", pa.int32()), ("z", pa.int32()), ("n", pa.int64()), ("lo", pa.float64()),
                      ("hi", pa.float64())])
_STRETCH_DDL = "s int, b int, z int, n long, lo double, hi double"


def _stretches(parts: list[tuple[int, np.ndarray]], width: int, bits: int):
    """Rows ``(column, part, stretch of the part, n, smallest, largest)`` of a
    task.  ``parts`` has, per column to look at, the starts of the parts, each
    ``2 ** width`` long, that are cut into ``2 ** bits`` stretches."""
    def run(batches):
        held = [(np.zeros(len(p) << bits, np.int64), np.full(len(p) << bits, np.inf), np.full(len(p) << bits, -np.inf))
                for _, p in parts]
        for batch in batches:
            for k, (_, starts) in enumerate(parts):
                v = batch.column(k).to_numpy(zero_copy_only=False)
                v = v[~np.isnan(v)] + 0.0
                key = _ordered(v)
                at = np.searchsorted(starts, key, side="right") - 1
                off = key - starts[np.maximum(at, 0)]
                ok = at >= 0
                if width < 64:
                    ok &= off >> np.uint64(width) == 0
                slot = (at[ok] << bits) + (off[ok] >> np.uint64(width - bits)).astype(np.int64)
                n, lo, hi = held[k]
                n += np.bincount(slot, minlength=len(n))
                np.minimum.at(lo, slot, v[ok])
                np.maximum.at(hi, slot, v[ok])
        for (i, _), (n, lo, hi) in zip(parts, held):
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), i, np.int32)), pa.array((at >> bits).astype(np.int32)),
                     pa.array((at & ((1 << bits) - 1)).astype(np.int32)), pa.array(n[at]), pa.array(lo[at]), pa.array(hi[at])],
                    schema=_STRETCH)
    return run


def _brackets(x: DataFrame, qs: list[float], accuracy: int) -> tuple[list[int], list[list[tuple[float, float]]]]:
    """Per column of ``x`` the number of its values, and ascending stretches
    (smallest, largest) that hold every order statistic that ``qs`` need."""
    spark, count = x.sparkSession, len(x.columns)
    size, spans = [0] * count, [set() for _ in range(count)]

    def merged(parts, width, bits):
        g = x.select(*[f"x{i}" for i, _ in parts]).mapInArrow(_stretches(parts, width, bits), _STRETCH_DDL).groupBy(
            "s", "b", "z").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        w = Window.partitionBy("s", "b").orderBy("z").rowsBetween(Window.unboundedPreceding, -1)
        return g.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))

    # The first pass also says how many values there are, hence which ranks.
    g = merged([(i, np.zeros(1, np.uint64)) for i in range(count)], 64, LEAD)
    g = g.withColumn("all", F.sum("n").over(Window.partitionBy("s")))
    low = [F.floor(F.lit(float(q)) * (F.col("all") - 1)) for q in qs]
    ranks = F.array_distinct(F.array(*low, *[F.least(k + 1, F.col("all") - 1) for k in low]))
    g = g.withColumn("ranks", F.filter(ranks, lambda k: (k >= F.col("below")) & (k < F.col("below") + F.col("n"))))
    found = [(r["s"], r["z"] << (64 - LEAD), r["n"], r["lo"], r["hi"], [k - r["below"] for k in r["ranks"]], r["all"])
             for r in g.where(F.size("ranks") > 0).collect()]
    width = 64 - LEAD
    while True:
        rest = []
        for f in found:
            size[f[0]] = f[6]
            if f[3] == f[4] or f[2] <= max(1000, 4 * f[6] // accuracy) or not width:
                spans[f[0]].add((f[3], f[4]))
            else:
                rest.append(f)
        if not rest:
            return size, [sorted(v) for v in spans]
        rest.sort(key=lambda f: f[:2])
        cols = sorted({f[0] for f in rest})
        of = {i: [f for f in rest if f[0] == i] for i in cols}
        bits = min(STEP, width)
        want = spark.createDataFrame([(i, b, int(k)) for i in cols for b, f in enumerate(of[i]) for k in f[5]],
                                     "s int, b int, rank long")
        g = merged([(i, np.array([f[1] for f in of[i]], np.uint64)) for i in cols], width, bits).join(F.broadcast(want), ["s", "b"])
        g = g.where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n")))
        got: dict = {}
        for r in g.collect():
            start = of[r["s"]][r["b"]][1] + (r["z"] << (width - bits))
            got.setdefault((r["s"], start), (r["n"], r["lo"], r["hi"], [], of[r["s"]][r["b"]][6]))[3].append(r["rank"] - r["below"])
        width -= bits
        found = [(*k, *v) for k, v in got.items()]


_ROW = pa.schema([("s", pa.int32()), ("zone", pa.int32()), ("v", pa.float64()), ("n", pa.int64()), ("lo", pa.float64()),
                  ("hi", pa.float64())])


def _count(ends: list[np.ndarray]):
    """Rows ``(column, zone, value, n, smallest, largest)`` of a batch: odd
    zones are brackets, whose values stay apart; the others are the stretches
    before, between and behind them."""
    def run(batches):
        for b in batches:
            for i, e in enumerate(ends):
                v = b.column(i).to_numpy(zero_copy_only=False)
                v, n = np.unique(v[~np.isnan(v)] + 0.0, return_counts=True)
                if not len(v):
                    continue
                # A bracket holds both its ends.
                zone = np.searchsorted(e[0::2], v, side="right") + np.searchsorted(e[1::2], v, side="left")
                odd = zone % 2 == 1
                first = np.flatnonzero(np.append(True, zone[1:] != zone[:-1]) | odd)
                last = np.append(first[1:], len(v)) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(first), i, np.int32)), pa.array(zone[first].astype(np.int32)),
                    pa.array(v[first], mask=~odd[first]), pa.array(np.add.reduceat(n, first)), pa.array(v[first]), pa.array(v[last])],
                    schema=_ROW)
    return run


def exact_quantiles(df: DataFrame, col: str, qs: list[float], accuracy: int = ACCURACY) -> list[float | None]:
    """Exact quantiles ``qs`` of one column."""
    return exact_quantiles_multi(df, [col], qs, accuracy)[0]


def quantile_row(df: DataFrame, cols: list[str], q: float) -> DataFrame:
    """One row, one column per input column: its exact q-quantile."""
    vals = tuple(v[0] for v in exact_quantiles_multi(df, cols, [q]))
    return df.sparkSession.createDataFrame([vals], ", ".join(f"`{c}` double" for c in cols))


def quantile_array(df: DataFrame, col: str, qs: list[float]) -> DataFrame:
    """One row with column ``q``: the exact quantiles ``qs`` of ``col``."""
    return df.sparkSession.createDataFrame([(exact_quantiles(df, col, qs),)], "q array<double>")
