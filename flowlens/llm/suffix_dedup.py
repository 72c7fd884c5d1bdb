"""Exact repeated-substring removal over sharded, sampled suffixes.

A byte is removed if a ``span``-byte string that covers it also starts
anywhere else.  Sorting every suffix of the corpus moves many times its size,
so suffixes are sampled by content: the smallest hash among the ``key``-byte
strings of a ``span``-byte window names the window's anchor.  Equal windows
have equal anchors at equal places, so windows with different anchors never
need to be compared, and about one suffix in seventy takes part.

Each shard (partition of texts) lists its sampled suffixes; the shards'
lists are interleaved by refinement: suffixes that agree so far form a block,
a block is split by more context, and a suffix alone in its block is settled
and takes no further part.  The common prefix of a block is known from the
round that made it.  The rounds are

1. the first ``key`` bytes of the anchored suffix,
2. the whole range of windows that share the anchor: members of a block of
   two or more are repeated intervals,
3. groups of up to ``GROUP`` neighbouring windows of what is still unsettled:
   first the bytes common to the group, then all its bytes,
4. single windows, which is exact.

From round 3 on only a block's unsettled members and one representative of
each settled content take part, and they bring their own bytes along, so the
texts are read again only to cut them.  Blocks are identified by 64-bit hashes
of their bytes, and every round is a pre-aggregated count that is joined back,
so a block of any size is never gathered in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, columns, slices, stage, unstage
from .textvec import Substrings, mix

#: Bytes of a string that counts as repeated.
SPAN = 200
#: Bytes of an anchor's key.
KEY = 64
#: Windows that are first compared as one.
GROUP = 16

U64 = np.uint64
_PLACE = U64((1 << 28) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, from block-wise prefix and
    suffix minima."""
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, U64)
    padded[:n] = x
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors(text: bytes, span: int = SPAN, key: int = KEY):
    """``(anchor, first window, last window, key hash, range hash)`` arrays: the
    windows between first and last have the anchor as their smallest key hash,
    the leftmost one if it repeats.  The anchor's place in its range is part
    of the range hash."""
    if len(text) < span:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(U64), none.view(U64)
    s = Substrings(np.frombuffer(text, np.uint8))
    h = s.windows(key)
    order = (h & ~_PLACE) | (np.arange(len(h)).astype(U64) & _PLACE)
    low = (_sliding_min(order, span - key + 1) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    last = np.append(first[1:], len(low)) - 1
    at = low[first] + (first >> 28 << 28)
    at += (at < first).astype(np.int64) << 28                  # places are kept modulo 2**28
    return at, first, last, h[at], mix(s.hash(first, last + span) + (at - first).astype(U64))


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _bytes(t) -> bytes:
    return (t or "").encode()


_KEYS = pa.schema([("k", pa.int64())])
_RANGES = pa.schema([("rid", pa.int64()), ("k", pa.int64()), ("r", pa.int64()), ("at", pa.int32()),
                     ("lead", pa.int32()), ("width", pa.int32())])
_SNIPPETS = pa.schema([("rid", pa.int64()), ("at", pa.int32()), ("near", pa.int32()), ("far", pa.int32()),
                       ("want", pa.bool_()), ("bytes", pa.binary())])
_GROUPS = pa.schema([("rid", pa.int64()), ("at", pa.int32()), ("near", pa.int32()), ("far", pa.int32()),
                     ("want", pa.bool_()), ("core", pa.int64()), ("hull", pa.int64())])
_WINDOWS = pa.schema([("rid", pa.int64()), ("start", pa.int32()), ("want", pa.bool_()), ("w", pa.int64())])


def _list_keys(span, key):
    def run(batches):
        for (texts,) in columns(batches):
            found = [anchors(_bytes(t), span, key)[3] for t in texts]
            yield batch(_KEYS, _signed(np.concatenate(found)))
    return run


def _list_ranges(span, key):
    def run(batches):
        for rids, texts in columns(batches):
            rows = [anchors(_bytes(t), span, key) for t in texts]
            rid = np.repeat(np.array(rids, np.int64), [len(r[0]) for r in rows])
            a, first, last, k, r = (np.concatenate(x) for x in zip(*rows))
            yield batch(_RANGES, pa.array(rid), _signed(k), _signed(r), pa.array(a.astype(np.int32)),
                        pa.array((a - first).astype(np.int32)), pa.array((last - first).astype(np.int32)))
    return run


def _cut_snippets(span):
    """The bytes that the windows ``near`` to ``far`` bytes before an anchor
    cover, with the place of the anchor."""
    def run(batches):
        for rids, texts, lists in columns(batches):
            rows = []
            for rid, t, marks in zip(rids, texts, lists):
                b = _bytes(t)
                for m in marks:
                    at, near, far = m["at"], m["near"], m["far"]
                    rows.append((rid, at, near, far, m["want"], b[at - far:at - near + span]))
                if len(rows) >= 4000:
                    yield batch(_SNIPPETS, *zip(*rows))
                    rows = []
            if rows:
                yield batch(_SNIPPETS, *zip(*rows))
    return run


def _joined(snippets: list[bytes]) -> tuple[Substrings, np.ndarray]:
    size = np.fromiter(map(len, snippets), np.int64, len(snippets))
    return Substrings(np.frombuffer(b"".join(snippets), np.uint8)), np.cumsum(size) - size


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number within the row) for ``n`` entries of each row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _list_groups(span, group):
    def run(batches):
        for b in slices(batches, 1000):
            rid, at, near, far, want = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            s, base = _joined(b.column(5).to_pylist())
            near, far = near.astype(np.int64), far.astype(np.int64)
            row, i = _spread(far // group - near // group + 1)
            g = near[row] // group + i
            x, y = np.maximum(g * group, near[row]), np.minimum(g * group + group - 1, far[row])
            zero = base[row] + far[row]                              # the anchor's place in the joined bytes
            # The bytes that all windows of the whole group share do not
            # depend on which of its windows this anchor has.
            core = mix(s.hash(zero - g * group, zero + span - g * group - group + 1) + g.astype(U64))
            hull = mix(s.hash(zero - y, zero - x + span) + ((x << 20) + y).astype(U64))
            yield batch(_GROUPS, pa.array(rid[row]), pa.array(at[row]), pa.array(x.astype(np.int32)),
                        pa.array(y.astype(np.int32)), pa.array(want[row]), _signed(core), _signed(hull))
    return run


def _list_windows(span):
    def run(batches):
        for b in slices(batches, 1000):
            rid, at, far, near, end, want = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            s, base = _joined(b.column(6).to_pylist())
            row, i = _spread(end.astype(np.int64) - near + 1)
            back = near[row].astype(np.int64) + i
            start = base[row] + far[row] - back
            w = mix(s.hash(start, start + span) + back.astype(U64))
            yield batch(_WINDOWS, pa.array(rid[row]), pa.array((at[row] - back).astype(np.int32)),
                        pa.array(want[row]), _signed(w))
    return run


def _blocks(df: DataFrame, key: str, *more) -> DataFrame:
    """Blocks with at least two members."""
    return df.groupBy(key).agg(F.count("*").alias("_n"), *more).where("_n > 1").drop("_n")


def repeated(docs: DataFrame, span: int = SPAN, key: int = KEY, group: int = GROUP) -> DataFrame:
    """``(rid, begin, end)``: byte ranges of ``docs(rid, text)`` that repeated
    ``span``-byte strings cover, overlapping and in any order."""
    text = docs.select("text")
    live = stage(_blocks(text.mapInArrow(_list_keys(span, key), "k long"), "k"), "keys")
    ranges = docs.select("rid", "text").mapInArrow(
        _list_ranges(span, key), "rid long, k long, r long, at int, lead int, width int")
    alive = stage(ranges.join(live, "k"), "ranges")
    unstage(live)
    first = F.min(F.struct("rid", "at")).alias("first")
    whole = stage(_blocks(alive, "r", first), "whole")
    settled = stage(alive.join(whole, "r", "left").select(
        "rid", "k", "at", (F.col("lead") - F.col("width")).alias("near"), F.col("lead").alias("far"),
        F.col("first").isNotNull().alias("full"),
        F.coalesce(F.col("first.rid").eqNullSafe(F.col("rid")) & (F.col("first.at") == F.col("at")),
                   F.lit(False)).alias("speaks")), "settled")
    unstage(alive)
    open_keys = settled.where("not full").select("k").distinct()
    partners = settled.where("speaks").join(open_keys, "k", "left_semi")
    marks = settled.where("not full").unionByName(partners).groupBy("rid").agg(
        F.collect_list(F.struct("at", "near", "far", (~F.col("full")).alias("want"))).alias("marks"))
    snippets = stage(docs.join(marks, "rid").select("rid", "text", "marks").mapInArrow(
        _cut_snippets(span), "rid long, at int, near int, far int, want boolean, bytes binary"), "snippets")
    groups = stage(snippets.mapInArrow(
        _list_groups(span, group), "rid long, at int, near int, far int, want boolean, core long, hull long"), "groups")
    open_cores = _blocks(groups, "core", F.max("want").alias("want")).where("want").select("core")
    held = stage(groups.join(open_cores, "core"), "held")
    unstage(groups)
    hulls = stage(_blocks(held, "hull", F.min(F.struct("rid", "at")).alias("first")), "hulls")
    split = stage(held.join(hulls, "hull", "left").select(
        "rid", "at", "near", "far", "want", "core", F.col("first").isNotNull().alias("full"),
        F.coalesce((F.col("first.rid") == F.col("rid")) & (F.col("first.at") == F.col("at")), F.lit(False)).alias("speaks")),
        "split")
    unstage(held)
    unstage(hulls)
    unsure = split.where("want and not full").select("core").distinct()
    last = split.where("not full or speaks").join(unsure, "core", "left_semi").select(
        "rid", "at", F.col("near").alias("x"), F.col("far").alias("y"), (F.col("want") & ~F.col("full")).alias("ask"))
    single = snippets.dropDuplicates(["rid", "at"]).select("rid", "at", "far", "bytes")
    windows = stage(last.join(single, ["rid", "at"]).select("rid", "at", "far", "x", "y", "ask", "bytes").mapInArrow(
        _list_windows(span), "rid long, start int, want boolean, w long"), "windows")
    again = _blocks(windows, "w")
    return (settled.where("full").selectExpr("rid", "at - far as begin", f"at - near + {span} as end")
            .unionByName(split.where("want and full").selectExpr("rid", "at - far as begin", f"at - near + {span} as end"))
            .unionByName(windows.where("want").join(again, "w").selectExpr("rid", "start as begin", f"start + {span} as end")))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the ranges, which may overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                     ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                     ("kept_text", pa.string())])


def _cut(keep_text):
    def run(batches):
        for b in slices(batches):
            rows = []
            for i, t, ranges in zip(*(b.column(n).to_pylist() for n in ("id", "text", "ranges"))):
                text = _bytes(t)
                spans = merge_spans([(r["begin"], r["end"]) for r in ranges or ()])
                kept, last = [], 0
                for x, y in spans:
                    kept.append(text[last:x])
                    last = y
                kept = b"".join([*kept, text[last:]])
                rows.append((i, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                             [{"begin": x, "end": y} for x, y in spans],
                             kept.decode("utf-8", "ignore") if keep_text and t is not None else None))
            out = batch(_RESULT, *zip(*rows))
            more = [n for n in b.schema.names if n == "carried"]
            yield pa.RecordBatch.from_arrays([*out.columns, *(b.column(n) for n in more)], [*_RESULT.names, *more])
    return run


def remove_repeats(docs: DataFrame, span: int = SPAN, key: int = KEY, group: int = GROUP, id_col: str = "doc_id",
                   text_col: str = "text", keep_text: bool = True, carry: list[str] | None = None) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept_text)`` per
    row of ``docs``: the UTF-8 bytes that no ``span``-byte string found
    elsewhere (also in the same text) covers.

    Strings are judged on the input and never cross texts; overlapping
    occurrences count.  ``kept_text`` drops code points that a cut splits; it
    is null for a null text or without ``keep_text``.  Null and empty texts
    have nothing to remove; null ids are kept; repeated rows repeat each
    other, so their long strings go from all of them; an empty table gives an
    empty one.  Other columns are ignored, but for those named in ``carry``,
    which come back unchanged in one struct ``carried``.  ``key`` and
    ``group`` only decide how much is compared in which round, not the result
    (``group <= key < span - group``).
    """
    if not 0 < group <= key < span - group:
        raise ValueError("0 < group <= key < span - group is required")
    # Rows of equal id and text are alike in every respect, so they share a key.
    more = [F.struct(*carry).alias("carried")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more).withColumn(
        "rid", F.xxhash64("id", "text"))
    ranges = repeated(rows.select("rid", "text"), span, key, group)
    lists = ranges.groupBy("rid").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    schema = T.StructType.fromDDL(
        "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<begin:long,end:long>>, kept_text string")
    if carry:
        schema = schema.add(rows.schema["carried"])
    return rows.join(lists, "rid", "left").drop("rid").mapInArrow(_cut(keep_text), schema)
