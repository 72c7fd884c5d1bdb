"""Packing token sequences by exact-complement hashing, then best fit.

Documents are tokenised, cut where longer than a sequence, and reduced to a
histogram of lengths, which has at most ``capacity`` entries however many
documents there are.  The plan is made on that histogram: runs of sequences
with the same composition, not single ones.  Every piece then finds its
sequence from its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, columns, stage

CAPACITY = 4096
#: Id that ends every document.
END_ID = 1
#: Words whose ids a worker remembers at most; then it starts anew.
CACHED_WORDS = 600_000

# The word pattern of the word-level BPE vocabulary, written out
# for code points below U+0180, whose classes do not depend on a library's
# Unicode version and whose lower case stays in that range.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_PLAIN = re.compile("[\x00-įı-ſ]*")


#: Unknown words that are tokenised in one call.
_TOGETHER = 512


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer, which ids end a word, and a pattern of the strings that
    it takes as special tokens wherever they stand."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    ends = np.zeros(t.get_vocab_size(), bool)
    for token, i in t.get_vocab().items():
        ends[i] = token.endswith("</w>")
    special = [re.escape(a.content) for a in t.get_added_tokens_decoder().values()]
    return t, ends, re.compile("|".join(special) or r"(?!)")


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    The vocabulary splits a text into words first and merges inside a word
    only, so the ids of a text are those of its words one after the other, and
    words repeat.  Texts with code points from U+0180 on, or with the string of
    a special token, go to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        self.path = path
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        coder, ends, _ = _tokenizer(self.path)
        for at in range(0, len(words), _TOGETHER):
            some = words[at:at + _TOGETHER]
            ids = np.array(coder.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            last = ((np.flatnonzero(ends[ids]) + 1) * 4).tolist()
            if len(last) != len(some):
                raise ValueError("the vocabulary does not end every word with an end-of-word id")
            line = ids.tobytes()
            self.known.update(zip(some, (line[i:j] for i, j in zip([0, *last], last))))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list = []
        whole, _, special = _tokenizer(self.path)
        split = [_WORD.findall(t.lower()) if t and _PLAIN.fullmatch(t) and not special.search(t) else None for t in texts]
        known = self.known
        fresh = set()
        for words in split:
            if words:
                fresh.update(words)
        fresh = [w for w in fresh if w not in known]
        if len(known) + len(fresh) > CACHED_WORDS:
            known.clear()
            fresh = list({w for words in split if words for w in words})
        if fresh:
            self._learn(fresh)
        for t, words in zip(texts, split):
            if words is not None:
                out.append(b"".join(map(known.__getitem__, words)))
            elif t:
                out.append(np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(b"")
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker, which its tasks share."""
    return Encoder(path)


_PIECE = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: each document's ids and then
    ``end_id``, cut into pieces of at most ``capacity``.  ``vocabulary`` is the
    tokenizer file's path, the same on every executor."""
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches):
        coder = encoder(vocabulary)
        for ids, texts in columns(batches):
            rows = []
            for i, b in zip(ids, coder.encode(texts)):
                b += end
                for n, s in enumerate(range(0, len(b), step)):
                    part = b[s:s + step]
                    rows.append((i, n, s // 4, len(part) // 4, zlib.crc32(part)))
            yield batch(_PIECE, *zip(*rows))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(sequences, [(length, times), ...])`` that use up ``histogram``.

    From the longest length down, the gap that a piece leaves is looked up
    among the single lengths, then the pair sums, then the triple sums of what
    is still there; a find is consumed as often as all its lengths allow.
    What finds no exact complement is placed by best fit, longest first: into
    the fullest open sequence that still takes it, many equal ones at once.
    """
    c = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        c[length] += n
    out: list[tuple[int, list[tuple[int, int]]]] = []

    def consume(parts: list[int]) -> bool:
        need = {}
        for p in parts:
            need[p] = need.get(p, 0) + 1
        times = min(c[p] // n for p, n in need.items())
        if times <= 0:
            return False
        for p, n in need.items():
            c[p] -= times * n
        out.append((int(times), sorted(((int(p), n) for p, n in need.items()), reverse=True)))
        return True

    def pair(total: int, limit: int):
        """A pair of lengths, none above ``limit``, that sum to ``total``."""
        a = np.arange((total + 1) // 2, min(total - 1, limit) + 1)
        ok = np.flatnonzero((c[a] > 0) & (c[total - a] > 0) & ((a * 2 != total) | (c[a] > 1)))
        return (int(a[ok[-1]]), total - int(a[ok[-1]])) if len(ok) else None

    if c[capacity]:
        out.append((int(c[capacity]), [(capacity, 1)]))
        c[capacity] = 0
    for longest in range(capacity - 1, 0, -1):
        gap = capacity - longest
        while c[longest] > 0:
            if gap <= longest and consume([longest, gap]):
                continue
            found = None
            c[longest] -= 1                              # the anchor itself is taken
            if two := pair(gap, longest):
                found = [longest, *two]
            else:
                present = np.flatnonzero(c[:min(gap - 2, longest) + 1])[::-1]
                for a in present[present * 3 >= gap]:
                    c[a] -= 1
                    two = pair(gap - int(a), int(a))
                    c[a] += 1
                    if two:
                        found = [longest, int(a), *two]
                        break
            c[longest] += 1
            if not found or not consume(found):
                break
    # Residuals: open sequences by free space, as [(count, parts)] stacks.
    open_by: dict[int, list[tuple[int, tuple]]] = {}
    free = np.zeros(capacity + 1, bool)

    def put(space: int, n: int, parts: tuple) -> None:
        if n:
            open_by.setdefault(space, []).append((n, parts))
            free[space] = True

    for length in range(capacity, 0, -1):
        left = int(c[length])
        while left:
            at = length + int(free[length:].argmax())
            if not free[at]:
                per = capacity // length
                whole, rest = divmod(left, per)
                put(capacity - per * length, whole, ((length, per),))
                if rest:
                    put(capacity - rest * length, 1, ((length, rest),))
                break
            n, parts = open_by[at].pop()
            per = at // length
            full = min(n, left // per)
            if full:
                put(at - per * length, full, (*parts, (length, per)))
                left -= full * per
                n -= full
            if n and left and left < per:
                put(at - left * length, 1, (*parts, (length, left)))
                left, n = 0, n - 1
            if n:
                open_by[at].append((n, parts))
            if not open_by[at]:
                free[at] = False
    for stack in open_by.values():
        out.extend((n, list(parts)) for n, parts in stack)
    return out


_PLACED = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])
_RANKS = 1 << 44


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text", end_id: int = END_ID, rows_per_bucket: int = 20_000) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)`` per piece.

    A null or empty text is the end id alone.  Equal rows are packed each on
    its own; a null id is kept; other columns are ignored; an empty table
    gives an empty one.  Ranks within a length are counted over (length,
    bucket), the bucket being a hash of the piece, so a length that many
    pieces share is spread over ever more buckets as the table grows.
    """
    cut = stage(pieces(docs, vocabulary, capacity, id_col, text_col, end_id), "pieces")
    sizes = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    buckets = max(64, sum(sizes.values()) // rows_per_bucket)
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    order = Window.partitionBy("length").orderBy("bucket")
    offsets = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", (F.sum("n").over(order) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = keyed.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)

    key, times, first_rank, first_seq, place = [], [], [], [], []
    used: dict[int, int] = {}
    seq = 0
    for n, parts in plan(sizes, capacity):
        at = 0
        for length, per in parts:
            rank = used.get(length, 0)
            key.append(length * _RANKS + rank)
            times.append(per)
            first_rank.append(rank)
            first_seq.append(seq)
            place.append(at)
            used[length] = rank + n * per
            at += length * per
        seq += n
    runs = np.array([key, times, first_rank, first_seq, place], np.int64).reshape(5, -1)
    # The plan has a few entries for each of the `capacity` lengths at most.
    shared = docs.sparkSession.sparkContext.broadcast(runs[:, np.argsort(runs[0])])

    def run(batches):
        k, per, first, seqs, where = shared.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(k, length * _RANKS + rank, side="right") - 1
            x = rank - first[i]
            yield batch(_PLACED, *[b.column(f.name) for f in _PIECE], pa.array(seqs[i] + x // per[i]),
                        pa.array(where[i] + x % per[i] * length))
    return ranked.select(*_PIECE.names, "rank").mapInArrow(
        run, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
