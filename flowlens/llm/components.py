"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, columns, stage, unstage

_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _forest(batches):
    """The edges of one Arrow batch as stars on their smallest node: at most
    one edge a node.  A batch is bounded, so the memory is."""
    for us, vs in columns(batches):
        parent: dict[int, int] = {}

        def root(x):
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for u, v in zip(us, vs):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in parent if root(x) != x]
        yield batch(_EDGE, [a for a, _ in pairs], [b for _, b in pairs])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``, both longs; the root
    is the smallest node of the component.

    Each round links all larger neighbours of a node to its smallest one, then
    all smaller ones; the edge table never grows, and after about log(n)
    rounds every component is a star.  Neighbours are never collected: the
    smallest is an aggregate that is joined back.  Edges with a null end and
    loops are ignored; raises when ``max_rounds`` do not suffice.
    """
    e = stage(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
              .mapInArrow(_forest, "u long, v long").distinct(), "edges")
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stage(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .where("u <> v").distinct(), "star")            # u > v from here on
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
                 .select("p.u", "p.v").where("u <> v").distinct())
        new = stage(small, "edges")
        same = _fingerprint(new) == _fingerprint(e)
        unstage(large)
        unstage(e)
        e = new
        if same:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _fingerprint(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
              F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("s")).first()
    return r.n, r.x, r.s
