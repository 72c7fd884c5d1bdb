"""Ranked lexical search by presence masks.

For each query item a task lays the documents of a block out as one bitmap per
term of the item.  Read across the terms, the bitmaps give every document the
mask of the terms it holds, and documents of one mask form a group.  A mask's
maximum score is what its terms can give at most in this block, so the groups
are evaluated by descending maximum until the next one cannot reach the items'
best ``k`` so far; the rest is finished without being looked at.  Every task
keeps its best ``k`` documents per item over all its blocks, and only these
are shuffled.

A term's weight, a document's length measure and the score are whole numbers
(see ``rank``), so results do not depend on the order of evaluation.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, columns, slices, stage
from .shortkeys import ByteTable, padded
from .textvec import CHUNK

#: Documents that are returned for each item.
TOP = 20
#: Documents that a task lays out as bitmaps at once.
BLOCK_ROWS = 4096
#: Distinct terms, and bytes of text, of the items that one pass over the
#: documents serves; more items are served by more passes.
BLOCK_TERMS, BLOCK_BYTES = 4096, 4 << 20
#: Parts in which the tasks' best rows of one item are merged first.
PARTS = 64

# A term is a maximal run of ASCII letters, digits and code points from U+0080
# on; in UTF-8 the latter are the bytes from 0x80 on.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_IN_TERM = np.array([bool(_TERM.match(bytes([i]))) for i in range(256)])

_HITS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
_BEST = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def terms(text: str | None) -> list[bytes]:
    return _TERM.findall((text or "").encode().lower())          # bytes: only A-Z change


@dataclass
class Items:
    """Query items and the terms that any of them holds."""
    ids: list[int | None]
    terms: list[dict[int, int]]          # per item: occurrences by term number
    vocabulary: list[bytes]


def blocks(items: DataFrame, id_col: str, text_col: str, max_terms: int = BLOCK_TERMS,
           max_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in groups of bounded size (one longer item stands alone), one
    group on the driver at a time."""
    ids, counts, number, size = [], [], {}, 0
    for i, text in items.select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator():
        found = Counter(terms(text))
        if ids and (len(number) + len(found) > max_terms or size + len(text or "") > max_bytes):
            yield Items(ids, counts, list(number))
            ids, counts, number, size = [], [], {}, 0
        ids.append(i)
        counts.append({number.setdefault(t, len(number)): n for t, n in found.items()})
        size += len(text or "")
    if ids:
        yield Items(ids, counts, list(number))


def _buffers(texts: list[str | None]):
    """``(buffer, text number of each of its pieces, where they begin)``; long
    texts are cut between terms."""
    group, size = [], 0
    for i, t in enumerate(texts):
        b, at = (t or "").encode().lower(), 0
        while at < len(b):
            gap = _GAP.search(b, at + CHUNK) if len(b) - at > 2 * CHUNK else None
            to = gap.start() if gap else len(b)
            group.append((i, b[at:to] + b" "))
            size += to - at
            at = to
            if size >= CHUNK:
                yield _joined(group)
                group, size = [], 0
    if group:
        yield _joined(group)


def _joined(group):
    length = np.fromiter((len(b) for _, b in group), np.int64, len(group))
    return padded(b"".join(b for _, b in group)), np.array([i for i, _ in group]), np.cumsum(length) - length


def term_hits(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """``(id, n, term, tf)`` per document with any term: its terms with
    repeats, the numbers of those in ``vocabulary``, and how often each
    occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(ByteTable(vocabulary, range(len(vocabulary))))
    many = max(len(vocabulary), 1)

    def run(batches):
        table = shared.value
        for ids, texts in columns(batches):
            n, keys, times = np.zeros(len(texts), np.int64), [], []
            for buf, text, base in _buffers(texts):
                inside = _IN_TERM[buf]
                edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
                edge = np.concatenate(([0], edge)) if inside[0] else edge
                start, end = edge[0::2], edge[1::2]                # the padding ends the last run
                doc = text[np.searchsorted(base, start, side="right") - 1]
                n += np.bincount(doc, minlength=len(texts))
                number = table.find(buf, start, end)
                hit = number >= 0
                k, c = np.unique(doc[hit] * many + number[hit], return_counts=True)
                keys.append(k)
                times.append(c)
            key, at = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.int64),) * 2
            tf = np.bincount(at, np.concatenate(times), len(key)).astype(np.int32) if len(key) else np.zeros(0, np.int32)
            keep = np.flatnonzero(n)
            ends = np.searchsorted(key, (keep + 1) * many)
            offsets = pa.array(np.append(0, ends).astype(np.int32))    # a text without terms has no keys
            yield batch(_HITS, [ids[i] for i in keep], pa.array(n[keep]),
                        pa.ListArray.from_arrays(offsets, pa.array((key % many).astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(tf)))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n long, term array<int>, tf array<int>")


def document_counts(hits: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term stands; every task hands on its sums."""
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def run(batches):
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(b.column("term").flatten().to_numpy(), minlength=size)
        seen = np.flatnonzero(df)
        yield batch(schema, pa.array(seen.astype(np.int32)), pa.array(df[seen]))
    out = np.zeros(size, np.int64)
    for r in hits.select("term").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]                                   # at most `size` rows
    return out


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Best:
    """The best documents of one item so far: highest score, then smallest id,
    null ids last."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def floor(self) -> int:
        """A score below this one is not among the best."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, id_: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.floor()
        score, id_, null = (np.concatenate((a, b[keep])) for a, b in ((self.score, score), (self.id, id_), (self.null, null)))
        first = np.lexsort((id_, null, -score))[:self.top]
        self.score, self.id, self.null = score[first], id_[first], null[first]


def masks(bitmaps: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(distinct masks as rows of bits, number of the mask of each of
    ``rows``)`` from one bitmap per term."""
    bits = np.unpackbits(bitmaps, axis=1)[:, rows]
    packed = np.packbits(bits, axis=0)
    words = np.zeros((len(rows), -(-len(packed) // 8) * 8), np.uint8)
    words[:, :len(packed)] = packed.T
    words = words.view(np.uint64)
    if words.shape[1] == 1:
        _, first, group = np.unique(words[:, 0], return_index=True, return_inverse=True)
    else:
        _, first, group = np.unique(words, axis=0, return_index=True, return_inverse=True)
    return bits[:, first].T.astype(np.int64), group.ravel()


def search(best: Best, bitmaps: np.ndarray, gain: np.ndarray, most: np.ndarray, term: np.ndarray, value: np.ndarray,
           id_: np.ndarray, null: np.ndarray) -> int:
    """Take up into ``best`` the documents of one block, for an item with the
    terms ``term`` of the given ``value``.  ``gain`` holds what each term
    (rows) gives each document at value 1, ``most`` a term's largest gain and
    ``bitmaps`` where there is any.  Returns the number of documents scored."""
    own = bitmaps[term]
    rows = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(own, axis=0)))
    if not len(rows):
        return 0
    distinct, group = masks(own, rows)
    limit = distinct @ (most[term] * value)
    order = np.argsort(-limit, kind="stable")
    by = np.argsort(group, kind="stable")                          # documents, mask by mask
    last = np.cumsum(np.bincount(group, minlength=len(limit)))
    done = scored = 0
    step = best.top
    while done < len(order) and limit[order[done]] >= best.floor():
        take, size = [], 0
        while done < len(order) and size < step and limit[order[done]] >= best.floor():
            g = order[done]
            take.append(by[last[g - 1] if g else 0:last[g]])
            size += len(take[-1])
            done += 1
        at = rows[np.concatenate(take)]
        best.add(value @ gain[term[:, None], at].astype(np.int64), id_[at], null[at])
        scored += size
        step *= 4
    return scored


def _best(hits: DataFrame, items: Items, documents: int, length: int, df: np.ndarray, top: int) -> DataFrame:
    """Each task's best documents per item."""
    w = np.array([weight(documents, int(d)) if d else 0 for d in df], np.int64)
    wanted = []
    for number, (i, found) in enumerate(zip(items.ids, items.terms)):
        t = np.array([k for k in found if w[k] > 0], np.int64)
        if len(t):
            wanted.append((number, i, t, w[t] * np.array([found[k] for k in t.tolist()], np.int64)))
    shared = hits.sparkSession.sparkContext.broadcast(wanted)
    size = len(df)

    def run(batches):
        wanted = shared.value
        best = [Best(top) for _ in wanted]
        for b in slices(batches, BLOCK_ROWS):
            n, rows = b.column("n").to_pylist(), b.num_rows
            m = np.array([100 - 25 + 25 * x * documents // length for x in n], np.int64)
            ids = b.column("id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            id_ = ids.fill_null(0).to_numpy()
            term = b.column("term").flatten().to_numpy()
            tf = b.column("tf").flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(rows), np.diff(b.column("term").offsets.to_numpy()))
            gain = np.zeros((size, rows), np.int32)                # at most 1,000,000 each
            gain[term, doc] = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
            bitmaps = np.packbits(gain > 0, axis=1)
            most = gain.max(axis=1).astype(np.int64)
            for found, (_, _, t, value) in zip(best, wanted):
                search(found, bitmaps, gain, most, t, value, id_, null)
        for found, (number, i, _, _) in zip(best, wanted):
            k = len(found.score)
            yield batch(_BEST, [number] * k, [i] * k, pa.array(found.id, mask=found.null), pa.array(found.score))
    return hits.mapInArrow(run, "item int, item_id long, id long, score long")


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", top: int = TOP, max_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, id, score)``: each item's ``top`` documents of highest
    score above zero (all, if fewer), equal scores by ascending id, null ids
    last.

    With N documents that hold a term, L terms in them and df documents that
    hold a given term, its weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``;
    a document of n terms measures ``m = 75 + 25 n N div L``; each term of the
    item, repeats included, gives its weight times ``10^9 tf div (1000 tf +
    12 m)``.

    A null or empty text, of a document or an item, has no terms: no rows.
    Repeated documents rank one by one, repeated items each have their rows;
    null ids are kept; other columns are ignored; an empty table gives an
    empty one.  Texts are read whole.
    """
    parts = []
    for number, some in enumerate(blocks(items, item_col, item_text, max_terms)):
        hits = stage(term_hits(docs, some.vocabulary, id_col, text_col), "hits")
        total = hits.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        if not total["n"]:
            break
        df = document_counts(hits, len(some.vocabulary))
        found = _best(hits, some, total["n"], total["l"], df, top)
        parts.append(stage(found.withColumn("block", F.lit(number)), "best"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, id long, score long")
    best = parts[0]
    for p in parts[1:]:
        best = best.union(p)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("id", "score"), F.lit(PARTS))
    first = Window.partitionBy("block", "item", "part").orderBy(*order)
    merged = best.withColumn("part", part).withColumn("r", F.row_number().over(first)).where(F.col("r") <= top)
    whole = Window.partitionBy("block", "item").orderBy(*order)
    return (merged.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
            .select("item_id", "rank", "id", "score"))


def sql(top: int = TOP) -> str:
    """``rank`` over ``documents`` and ``benchmark`` in DuckDB's SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = (f"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), "
             r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
    return f"""
WITH doc AS (SELECT row_number() OVER () AS k, doc_id, {found} AS ts FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS length FROM doc WHERE len(ts) > 0),
item AS (SELECT row_number() OVER () AS q, item_id, {found} AS ts FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT q, item_id, term, count(*) AS times
          FROM (SELECT q, item_id, unnest(ts) AS term FROM item) GROUP BY ALL),
post AS (SELECT k, doc_id, n, term, count(*) AS tf
         FROM (SELECT k, doc_id, len(ts) AS n, unnest(ts) AS term FROM doc)
         WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weighed AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM post GROUP BY term), total),
given AS (SELECT k, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // length))) AS s
          FROM post JOIN weighed USING (term), total),
scored AS (SELECT q, item_id, k, doc_id, CAST(sum(times * s) AS BIGINT) AS score
           FROM asked JOIN given USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
                  doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {top}"""
