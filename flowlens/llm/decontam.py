"""Benchmark decontamination by greedy string tiling.

Words of a document and of a benchmark item that share a run of ``seed`` words
are tiled: again and again the longest match of unmarked words is marked on
both sides, down to ``seed`` words.  Runs are compared by running Karp-Rabin
hashes.  An item is leaked if the tiles cover enough of it, in whatever order
its passages stand in the document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import batch, columns, stage

#: Words of the shortest tile.
SEED = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.8
#: Benchmark text that is sent to the executors at once; a larger benchmark is
#: handled in several such blocks.
BLOCK_BYTES = 16 * 1024 * 1024

_HIT = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("coverage", pa.float64()), ("tiled_words", pa.int32()),
                  ("item_words", pa.int32()),
                  ("tiles", pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()),
                                                ("words", pa.int32())])))])


def tile(doc: np.ndarray, item: np.ndarray, shortest: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles ``(place in doc, place in item, words)`` of two word-hash rows:
    the longest match of unmarked words first, ties by the place in the item,
    then in the document."""
    d, _ = tv.ngrams(doc, np.zeros(len(doc), np.int64), shortest)
    p, _ = tv.ngrams(item, np.zeros(len(item), np.int64), shortest)
    if not len(d) or not len(p):
        return []
    order = np.argsort(p, kind="stable")
    low, high = np.searchsorted(p[order], d, "left"), np.searchsorted(p[order], d, "right")
    many = high - low
    j = np.repeat(np.arange(len(d)), many)
    if not len(j):
        return []
    i = order[np.repeat(low, many) + np.arange(len(j)) - np.repeat(np.cumsum(many) - many, many)]
    # Matching runs follow each other on a diagonal; a gap ends a match.
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(j - i) != 0) | (np.diff(i) != 1))))
    size = np.diff(np.append(new, len(i))) + shortest - 1
    heap = [(-int(n), int(i[a]), int(j[a])) for a, n in zip(new, size)]
    heapq.heapify(heap)
    used_doc, used_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    tiles = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        taken = used_item[a:a + n] | used_doc[b:b + n]
        if not taken.any():
            used_item[a:a + n] = True
            used_doc[b:b + n] = True
            tiles.append((b, a, n))
            if used_item.all():
                break
            continue
        # What earlier tiles left of this match goes back into the queue.
        edge = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s >= shortest:
                heapq.heappush(heap, (s - e, a + s, b + s))
    return tiles


def words_of(texts: list) -> list[np.ndarray]:
    """Hashes of the lower-cased words of each text."""
    out = []
    for _, group in tv.chunks([(t or "").lower() for t in texts]):
        t = tv.tokens(group, words=True)
        out.extend(t.hash[a:b] for a, b in zip(t.first[:-1], t.first[1:]))
    return out


class Block:
    """Some benchmark items: their words, and which items hold a seed."""

    def __init__(self, ids: list[int], texts: list, seed: int):
        rows = words_of(texts)
        self.seed, self.ids, self.rows = seed, ids, rows
        grams = [tv.ngrams(r, np.zeros(len(r), np.int64), seed)[0] for r in rows]
        keys = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        order = np.argsort(keys, kind="stable")
        self.keys, at = np.unique(keys[order], return_index=True)
        self.owner, self.at = owner[order], np.append(at, len(keys))

    def candidates(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which seed of the benchmark, or -1) for each seed of a text."""
        k = np.searchsorted(self.keys, seeds)
        k[k == len(self.keys)] = 0
        return np.where(self.keys[k] == seeds, k, -1) if len(self.keys) else np.full(len(seeds), -1)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, seed: int, block_bytes: int) -> Iterator[Block]:
    """The benchmark in blocks of at most ``block_bytes`` of text (or one
    longer item), in the order of the ids; repeated rows count once."""
    rows = (benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null")
            .distinct().orderBy("i", "t").toLocalIterator())
    ids, texts, size = [], [], 0
    for r in rows:
        n = len(r.t.encode()) if r.t else 0
        if ids and size + n > block_bytes:
            yield Block(ids, texts, seed)
            ids, texts, size = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        size += n
    if ids:
        yield Block(ids, texts, seed)


def _scan(shared, coverage):
    def run(batches):
        block: Block = shared.value
        k = block.seed
        for ids, texts in columns(batches):
            rows = []
            for at, group in tv.chunks([(t or "").lower() for t in texts]):
                t = tv.tokens(group, words=True)
                seeds, first = tv.ngrams(t.hash, t.doc, k)
                hit = block.candidates(seeds)
                some = np.flatnonzero(hit >= 0)
                for d in np.unique(t.doc[first[some]]):
                    own = hit[some[t.doc[first[some]] == d]]
                    here = t.hash[t.first[d]:t.first[d + 1]]
                    # A lower bound first: an item needs enough distinct seeds.
                    own = np.unique(own)
                    items = np.concatenate([block.owner[block.at[s]:block.at[s + 1]] for s in own])
                    item, n = np.unique(items, return_counts=True)
                    for x, seen in zip(item, n):
                        row = block.rows[x]
                        if seen * k < coverage * len(row):       # tiles are made of seeds of k words each
                            continue
                        tiles = tile(here, row, k)
                        covered = sum(w for _, _, w in tiles)
                        if covered and covered >= coverage * len(row):
                            rows.append((ids[at + int(d)], block.ids[x], covered / len(row), covered, len(row),
                                         [{"doc_word": a, "item_word": b, "words": w} for a, b, w in sorted(tiles)]))
            if rows:
                yield batch(_HIT, *zip(*rows))
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id, item, coverage, tiled_words, item_words, tiles)`` for every
    document and benchmark item whose tiles cover at least ``coverage`` of the
    item's words; a document without such an item has no row.

    The benchmark is the query set: it goes to the executors in blocks of
    bounded size, and each block is held against all documents.  Case and
    punctuation do not count.  Null and empty texts match nothing; so does an
    item of fewer than ``seed`` words.  A null item id is left out, a null
    document id is kept; repeated document rows give repeated results;
    repeated benchmark rows count once.  Extra columns are ignored; with an
    empty table on either side the result is empty.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kind = ("id long, item long, coverage double, tiled_words int, item_words int, "
            "tiles array<struct<doc_word:int,item_word:int,words:int>>")
    parts = []
    for block in blocks(benchmark, item_col, item_text, seed, block_bytes):
        # Written at once, so that a block is let go before the next is made.
        shared = spark.sparkContext.broadcast(block)
        parts.append(stage(plain.mapInArrow(_scan(shared, coverage), kind), "hits"))
        shared.destroy()
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], kind)
