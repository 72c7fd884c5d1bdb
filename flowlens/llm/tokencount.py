"""Token counts by a map-side look-up in two tiers.

The vocabulary merges characters into pieces, so no token spans two bytes that
never stand side by side inside a piece; cut there, a text falls into
pre-tokens whose token counts add up to its own.  The counts of frequent
pre-tokens come from one compact broadcast table, those of the others from a
cache that each Python worker keeps, and what the cache lacks is encoded by
the library.  Pre-tokens are never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, columns
from .shortkeys import SHORT, ByteTable, padded
from .textvec import CHUNK

#: Tokens that a text may have before it is marked.
LIMIT = 4096
#: Documents expected in the sample that fills the broadcast table.
SAMPLE = 2_000
#: Entries of the broadcast table at most (18 bytes and a value each, twice).
FREQUENT = 1 << 16
#: Pre-tokens that a worker's cache holds at most; then it starts anew.
CACHED = 500_000
_MARK = "▁"                                      # the library's sign for a space


@lru_cache(maxsize=2)
def _library(path: str):
    """The processor, the table of bytes that stand side by side in a piece,
    and the number of tokens of the mark that keeps a pre-token from the
    space that the library puts before a text."""
    import sentencepiece
    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    inside = np.zeros(1 << 16, bool)
    for i in range(coder.get_piece_size()):
        if not (coder.is_byte(i) or coder.is_control(i) or coder.is_unknown(i)):
            b = np.frombuffer(coder.id_to_piece(i).replace(_MARK, " ").encode(), np.uint8).astype(np.int64)
            inside[b[:-1] << 8 | b[1:]] = True
    square = inside.reshape(256, 256)
    if square[10].any() or square[:, 10].any() or any(coder.is_unused(i) for i in range(coder.get_piece_size())):
        raise ValueError("the vocabulary has line feeds inside pieces, or unused pieces")
    if len(coder.encode(" a")) != len(coder.encode("  a")) and coder.encode(" a") == coder.encode("a"):
        raise ValueError("the vocabulary drops white space")
    inside[(np.arange(1 << 16) & 0xC0) == 0x80] = True    # never inside a character
    return coder, inside, len(coder.encode("\n"))


class TokenCounter:
    """Counts of whole texts; ``table`` holds the frequent pre-tokens."""

    def __init__(self, path: str, table: ByteTable | None = None):
        self.coder, self.inside, self.mark = _library(path)
        self.table = table
        self.known: dict[bytes, int] = {}

    def parts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(buffer, text number of each piece of it, where the pieces begin)``
        of about ``CHUNK`` bytes; a longer text goes on in the next buffers,
        from a place where pre-tokens end."""
        group, size = [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            b = (" " + t.replace(_MARK, " ")).encode()
            at = 0
            while at < len(b):
                to = self._cut(b, at)
                group.append((i, b[at:to]))
                size += to - at
                at = to
                if size >= CHUNK:
                    yield self._buffer(group)
                    group, size = [], 0
        if group:
            yield self._buffer(group)

    def _cut(self, b: bytes, at: int) -> int:
        """Where the buffer that begins at ``at`` may end."""
        look = at + CHUNK
        while len(b) - look > CHUNK:
            two = np.frombuffer(b, np.uint8, CHUNK + 1, look).astype(np.int32)
            found = np.flatnonzero(~self.inside[two[:-1] << 8 | two[1:]])
            if len(found):
                return look + int(found[0]) + 1
            look += CHUNK
        return len(b)

    @staticmethod
    def _buffer(group):
        length = np.fromiter((len(b) for _, b in group), np.int64, len(group))
        return padded(b"".join(b for _, b in group)), np.array([i for i, _ in group]), np.append(0, np.cumsum(length))

    def split(self, buf: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each pre-token."""
        n = int(base[-1])
        two = buf[:n - 1].astype(np.uint16) << np.uint16(8) | buf[1:n]
        first = np.ones(n, bool)
        np.logical_not(self.inside[two], out=first[1:])
        first[base[:-1]] = True
        start = np.flatnonzero(first)
        return start, np.append(start[1:], n)

    def learn(self, words: list[bytes]) -> None:
        if len(self.known) + len(words) > CACHED:
            self.known.clear()
        for at in range(0, len(words), 1024):
            some = words[at:at + 1024]
            ids = self.coder.encode(["\n" + w.decode() for w in some], num_threads=1)
            self.known.update(zip(some, (len(x) - self.mark for x in ids)))

    def sizes(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of tokens of each pre-token."""
        out = self.table.find(buf, start, end) if self.table else np.full(len(start), -1, np.int32)
        miss = np.flatnonzero(out < 0)
        data = buf.tobytes()
        words = [data[i:j] for i, j in zip(start[miss].tolist(), end[miss].tolist())]
        known = self.known
        fresh = list({w for w in words if w not in known})
        if fresh:
            self.learn(fresh)
            if len(fresh) < len(words):
                self.learn([w for w in set(words) if w not in known])      # after a clearing
        out[miss] = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        return out

    def count(self, texts: list[str | None]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        for buf, text, base in self.parts(texts):
            start, end = self.split(buf, base)
            run = np.append(0, np.cumsum(self.sizes(buf, start, end), dtype=np.int64))
            at = np.searchsorted(start, base)
            np.add.at(total, text, run[at[1:]] - run[at[:-1]])
        return total


def frequent(docs: DataFrame, vocabulary: str, text_col: str = "text", sample: int = SAMPLE,
             most: int = FREQUENT) -> ByteTable:
    """The table of the most frequent short pre-tokens of about ``sample``
    rows.  It only saves work: counts do not depend on what it holds.  Each
    task counts its own rows and hands on what it has seen twice, so what the
    driver gets is bounded by the sample."""
    n = docs.count()
    part = docs.select(F.col(text_col).alias("text"))
    if n > sample:
        part = part.sample(fraction=sample / n, seed=42)
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("size", pa.int64())])

    def run(batches):
        coder, seen = TokenCounter(vocabulary), Counter()
        for (texts,) in columns(batches):
            for buf, _, base in coder.parts(texts):
                start, end = coder.split(buf, base)
                short = end - start <= SHORT
                data = buf.tobytes()
                seen.update(data[i:j] for i, j in zip(start[short].tolist(), end[short].tolist()))
                if len(seen) > 4 * most:
                    seen = Counter(dict(seen.most_common(2 * most)))
        words = [w for w, k in seen.most_common(most) if k > 1]
        ids = coder.coder.encode(["\n" + w.decode() for w in words], num_threads=1)
        yield batch(schema, words, [seen[w] for w in words], [len(x) - coder.mark for x in ids])

    total, size = Counter(), {}
    for r in part.mapInArrow(run, "word binary, n long, size long").toLocalIterator():
        total[bytes(r["word"])] += r["n"]
        size[bytes(r["word"])] = r["size"]
    words = [w for w, _ in sorted(total.items(), key=lambda t: (-t[1], t[0]))[:most]]
    return ByteTable(words, [size[w] for w in words])


_OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for each row: UTF-8 bytes, and
    tokens as the library counts them without begin, end or added tokens.

    A null or empty text has none of either.  Strings of special tokens are
    ordinary text, as the library takes them.  Null ids and repeated rows stay
    as they are; other columns are ignored; an empty table gives an empty one.
    Texts are read whole; a long one passes through in buffers of bounded size.
    ``vocabulary`` is the model file's path, the same on every executor.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, vocabulary, text_col))

    def run(batches):
        coder = _worker(vocabulary, shared.value)
        for ids, texts in columns(batches):
            n = coder.count(texts)
            size = [len(t.encode()) if t else 0 for t in texts]
            yield batch(_OUT, ids, size, pa.array(n), pa.array(n > limit))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n_bytes long, n_tokens long, over_limit boolean")


@lru_cache(maxsize=2)
def _cached(path: str) -> TokenCounter:
    return TokenCounter(path)


def _worker(path: str, table: ByteTable) -> TokenCounter:
    """One counter a worker, whose cache its tasks share."""
    coder = _cached(path)
    coder.table = table
    return coder
