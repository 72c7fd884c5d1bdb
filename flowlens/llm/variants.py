"""Grouping spelling variants by pivotal grams.

Two words are near if one inserted, deleted or replaced code point parts them.
Bigrams are ordered by how rare they are.  A word's gram prefix is its three
rarest bigrams (with all that are as rare as the third); two of these that do
not overlap, chosen by dynamic programming for the fewest words that hold
them, are its pivots.  One edit spoils at most one pivot, so of two near
words the one whose prefix ends earlier in the order has a pivot in the prefix
of the other.  The position limit is strict: an edit behind the pivot leaves
all before it in place, an edit before it leaves all behind it.  So a pivot is
indexed by the text on its quiet side, and by what follows the edit on the
other side, window by window; candidates agree on all but one short window and
are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, columns, stage

#: Code points that a word has at least, and its occurrences.
MIN_LENGTH, MIN_COUNT = 7, 2
#: One in so many runs of a document loses a code point.
ONE_IN = 31
#: A form occurs so many times as often as the word at least.
RATIO = 10
#: Width of the window that holds the edit; long words have wider ones.
WINDOW = 3
#: Windows that a word has at most on one side of a pivot, or few more.
WINDOWS = 16
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Words for whose keys one task is planned.
TASK_WORDS = 20_000
#: Bytes of one text that are searched at once.
SLICE = 1 << 20

# Runs of a-z and U+00C0 to U+00FF in UTF-8, A-Z being lower-cased before.
_UNIT = rb"(?:[a-z]|\xc3[\x80-\xbf])"
_OTHER = re.compile(rb"[^a-z\x80-\xff]|[\xc4-\xff]")      # begins a sign that is in no run
_COUNT = pa.schema([("word", pa.string()), ("n", pa.int64())])
_KEY = pa.schema([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("last", pa.int32())])


def altered(prefix: bytes, run: bytes, one_in: int = ONE_IN) -> bytes:
    """The run as it is counted: where ``one_in`` divides the checksum of
    document and run, the code point that the checksum points at is left out."""
    h = zlib.crc32(prefix + run)
    if one_in and h % one_in == 0:
        u = run.decode()
        p = h % len(u)
        return (u[:p] + u[p + 1:]).encode()
    return run


def _slices(b: bytes):
    """Pieces of a long text, cut where no run goes on."""
    at = 0
    while len(b) - at > 2 * SLICE:
        cut = _OTHER.search(b, at + SLICE)
        if not cut:
            break
        yield b[at:cut.start()]
        at = cut.start()
    yield b[at:]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
          min_count: int = MIN_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """``(word, n)``: the words of all texts that are long and frequent
    enough.  A null id counts as an empty one in the checksum."""
    # A run must have min_length units to give a word, one more if it is cut.
    find = re.compile(_UNIT + b"{%d,}" % min_length).findall

    def run(batches):
        total: Counter = Counter()
        for ids, texts in columns(batches):
            for i, t in zip(ids, texts):
                if not t:
                    continue
                prefix = b"%d:" % i if i is not None else b":"
                for part in _slices(t.encode().lower()):             # bytes: only A-Z change
                    for r, n in Counter(find(part)).items():
                        total[altered(prefix, r, one_in)] += n
            if len(total) > HELD:
                yield batch(_COUNT, [w.decode() for w in total], list(total.values()))
                total = Counter()
        yield batch(_COUNT, [w.decode() for w in total], list(total.values()))

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where((F.col("n") >= min_count) & (F.length("word") >= min_length)))


def gram_counts(vocabulary: DataFrame) -> dict[bytes, int]:
    """In how many words each bigram stands; there are at most 90 times 90."""
    schema = pa.schema([("gram", pa.binary()), ("n", pa.int64())])

    def run(batches):
        held: Counter = Counter()
        for (ws,) in columns(batches, 4096):
            for w in ws:
                b = w.encode("latin-1")
                held.update({b[i:i + 2] for i in range(len(b) - 1)})
        yield batch(schema, list(held), list(held.values()))
    rows = vocabulary.select("word").mapInArrow(run, "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {bytes(r["gram"]): r["n"] for r in rows.collect()}


def choose(places: list[int], weight: list[int], pick: int = 2, size: int = 2) -> list[int]:
    """``pick`` of the ascending ``places`` that are ``size`` apart at least,
    with the smallest sum of weights: ``best[k]`` holds the lightest choice of
    ``k`` among the places so far, and a place extends the best choice among
    those that end early enough."""
    tables: list[list] = []
    for i, p in enumerate(places):
        early = sum(1 for x in places[:i] if x <= p - size)
        before = tables[early - 1] if early else [(0, [])] + [None] * pick
        best = list(tables[-1]) if tables else [(0, [])] + [None] * pick
        for k in range(1, pick + 1):
            if before[k - 1]:
                took = (before[k - 1][0] + weight[i], before[k - 1][1] + [p])
                if best[k] is None or took < best[k]:
                    best[k] = took
        tables.append(best)
    return tables[-1][pick][1]


class Grams:
    """Prefixes, pivots and keys of words, given the bigram counts."""

    def __init__(self, counts: dict[bytes, int], window: int = WINDOW):
        self.counts = counts
        self.window = window
        self.rank = {g: i for i, (_, g) in enumerate(sorted((n, g) for g, n in counts.items()))}

    def prefix(self, b: bytes) -> tuple[list[int], int]:
        """Places of the prefix's grams, ascending, and the order number at
        which it ends."""
        ranks = [self.rank[b[i:i + 2]] for i in range(len(b) - 1)]
        last = sorted(ranks)[2]
        return [i for i, r in enumerate(ranks) if r <= last], last

    def widths(self, n: int) -> int:
        return self.window if n <= self.window * WINDOWS else -(-n // WINDOWS)

    def _keys(self, side: bytes, y: bytes, q: int, width: int, shifts: tuple, lengths: tuple, upto: int):
        """Keys of the gram at ``q`` for each window behind it that begins
        before ``upto``; ``y`` is the word, or the reversed word."""
        c, n, digest = q + 2, len(y), xxhash.xxh3_64_intdigest
        while c <= n and c < upto:
            head = b"%s%d.%d." % (side, q, c) + y[:c] + b" "
            for tail in {y[c + width + s:] for s in shifts}:
                if tail:
                    yield digest(head + tail) - (1 << 63)
                else:
                    for m in lengths:
                        yield digest(b"%s%d" % (head, m)) - (1 << 63)
            c += width

    def pivot_keys(self, b: bytes) -> tuple[set[int], int]:
        """The word's entries in the index.  With the pivots at ``i`` and
        ``j``, an edit behind the second leaves it in place, an edit up to the
        end of the first leaves the second in place from the end, and one in
        between leaves the first."""
        places, last = self.prefix(b)
        i, j = choose(places, [self.counts[b[p:p + 2]] for p in places])
        n, width, back = len(b), self.widths(len(b)), b[::-1]
        args = (width, (0,), (n - 1, n, n + 1))
        return {*self._keys(b"L", b, j, *args, n + 1), *self._keys(b"L", b, i, *args, j + 2),
                *self._keys(b"R", back, n - 2 - j, *args, n + 1)}, last

    def prefix_keys(self, b: bytes) -> tuple[set[int], int]:
        """What the word looks up: its prefix's grams, for an index word as
        long, or one code point longer or shorter."""
        places, last = self.prefix(b)
        n, back = len(b), b[::-1]
        return {k for width in {self.widths(m) for m in (n - 1, n, n + 1)} for p in places
                for side, y, q in ((b"L", b, p), (b"R", back, n - 2 - p))
                for k in self._keys(side, y, q, width, (-1, 0, 1), (n,), n + 1)}, last


def _keyed(vocabulary: DataFrame, shared, pivots: bool) -> DataFrame:
    def run(batches):
        grams = shared.value
        make = grams.pivot_keys if pivots else grams.prefix_keys
        for ws, ns in columns(batches, 1024):
            out, size = [], 0
            for w, n in zip(ws, ns):
                keys, last = make(w.encode("latin-1"))
                out.extend((k, w, n, last) for k in keys)
                size += len(keys) * len(w)
                if size > 1 << 22:
                    yield batch(_KEY, *zip(*out))
                    out, size = [], 0
            if out:
                yield batch(_KEY, *zip(*out))
    return vocabulary.select("word", "n").mapInArrow(run, "key long, word string, n long, last int")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``(a, b, n_a, n_b)``, ``a < b``: each pair of near words once."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(Grams(gram_counts(vocabulary)))
    r = _keyed(vocabulary, shared, True).select("key", *(F.col(c).alias(f"r_{c}") for c in ("word", "n", "last")))
    s = _keyed(vocabulary, shared, False).select("key", *(F.col(c).alias(f"s_{c}") for c in ("word", "n", "last")))
    near = (F.col("r_last") <= F.col("s_last")) & (F.col("r_word") != F.col("s_word")) & (
        F.levenshtein("r_word", "s_word", 1) == 1)
    swap = F.col("r_word") > F.col("s_word")
    pick = lambda yes, no: F.when(swap, F.col(yes)).otherwise(F.col(no))
    return r.join(s, "key").where(near).select(
        pick("s_word", "r_word").alias("a"), pick("r_word", "s_word").alias("b"),
        pick("s_n", "r_n").alias("n_a"), pick("r_n", "s_n").alias("n_b")).distinct()


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``, in which a form is never
    reached from itself: every round doubles the steps that a word has gone."""
    at = stage(forms.select("word", F.col("form").alias("root")), "steps")
    for _ in range(max_rounds):
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        on = stage(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                        F.col("next").isNotNull().alias("moved")), "steps")
        at = on.select("word", "root")
        if on.where("moved").isEmpty():
            return at
    raise RuntimeError(f"forms not followed to their ends after {max_rounds} rounds")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                   min_count: int = MIN_COUNT, one_in: int = ONE_IN, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each word of all texts.

    ``form`` is the most frequent near word (ties: the first in code-point
    order) if it occurs ``ratio`` times as often, else null; ``root`` is where
    forms lead in the end, the word itself if it has none.  Null and empty
    texts have no words; a null id counts as an empty string in the checksum;
    repeated rows count as often as they stand there; other columns are
    ignored; an empty table gives an empty one.  Texts are read whole, in
    slices cut between runs.
    """
    if min_length < 4:
        raise ValueError("words of fewer than four code points have no two disjoint pivots in a prefix")
    vocabulary = stage(words(docs, id_col, text_col, min_length, min_count, one_in), "words")
    tasks = -(-vocabulary.count() // TASK_WORDS)                 # a word has some forty keys
    pairs = stage(near_pairs(vocabulary.repartition(max(tasks, 1), "word")), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(
        pairs.select("b", "n_b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("own"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("own")
    known = stage(best.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"),
                              F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    led = roots(known.where("form is not null"))
    return (vocabulary.join(known, "word", "left").join(led, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
