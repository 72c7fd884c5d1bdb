"""Near-duplicate paragraphs by banded MinHash, exact Jaccard and components.

Line and sentence ends say little about where a repeated passage begins, so a
paragraph is a run of ``WORDS`` words that begins at a content-chosen word: one
whose bigram hash is the smallest within ``REACH`` words on either side.  The
same passage has the same paragraphs wherever it stands, so a copy of twice
that length holds one, whatever surrounds it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import batch, columns, stage, unstage
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Words of a paragraph, and of the shortest text that is one as a whole.
WORDS, MIN_WORDS = 25, 20
#: Words on either side among which a paragraph's first one is chosen.
REACH = 5
#: Share of the pairs at exactly ``SIMILARITY`` that some band brings together.
RECALL = 0.99
ROWS_PER_BAND = 2
#: Buckets of up to so many distinct paragraphs are compared pair by pair.
PAIRWISE = 32
#: Members of a larger bucket that all others are held against first.
HUBS = 4
#: Paragraphs of one side of a block comparison.
SIDE = 128
#: Contents that a task remembers having handed on.
SEEN = 500_000


def tune_bands(similarity: float, recall: float, rows: int) -> int:
    """The fewest bands of ``rows`` rows that reach ``recall``."""
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - similarity ** rows))))


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lowered(text: str | None) -> bytes:
    """Lower case, in as many bytes as the text has."""
    b = (text or "").encode()
    low = b.lower() if b.isascii() else (text or "").lower().encode()
    return low if len(low) == len(b) else b.lower()


def starts(t: tv.Tokens, words: int = WORDS, min_words: int = MIN_WORDS, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """First token and number of tokens of each paragraph.  A text's first
    word begins one too; a text of fewer words is one if it has enough."""
    count = np.diff(t.first)
    n = len(t.hash)
    chosen = np.zeros(n, bool)
    if n > 1:
        two = tv.mix(t.hash[:-1] * np.uint64(0x9FB21C651E98DF25) ^ t.hash[1:])
        place = np.arange(n) - t.first[t.doc]
        chosen[:-1] = (place[:-1] >= reach) & (place[:-1] + reach + 1 < count[t.doc[:-1]])
        for k in range(1, reach + 1):
            chosen[k:-1] &= two[k:] < two[:-k]
            chosen[:n - 1 - k] &= two[:n - 1 - k] <= two[k:]
            chosen[:k] = False
            chosen[n - 1 - k:] = False
        chosen &= place + words <= count[t.doc]
    chosen[t.first[:-1][count >= max(1, min_words)]] = True
    at = np.flatnonzero(chosen)
    return at, np.minimum(words, t.first[t.doc[at] + 1] - at)


class Paragraphs:
    """The paragraphs of a group of texts, with their shingles' hashes."""

    def __init__(self, group: list[bytes], shingle: int, words: int, min_words: int):
        t = tv.tokens(group, words=True)
        at, size = starts(t, words, max(min_words, shingle))
        self.hash, where = tv.ngrams(t.hash, t.doc, shingle)
        self.first, self.last = np.searchsorted(where, at), np.searchsorted(where, at + size - shingle + 1)
        power, back = tv._powers(len(t.hash) + 1)
        total = np.append(np.uint64(0), np.cumsum(t.hash * power[:len(t.hash)], dtype=np.uint64))
        self.content = tv.mix((total[at + size] - total[at]) * back[at] + size.astype(np.uint64))
        self.text, self.words = t.doc[at], size
        self.number = at - t.first[self.text]
        self.begin = t.start[at] - t.base[self.text]
        self.end = t.end[at + size - 1] - t.base[self.text]

    def bitmaps(self) -> np.ndarray:
        """One bit for each shingle.  Two sets' bitmaps differ in no more bits
        than the sets do in shingles."""
        if not len(self.first):
            return np.zeros(0, np.uint64)
        bit = np.append(np.uint64(1) << (self.hash >> np.uint64(58)), np.uint64(0))
        return np.bitwise_or.reduceat(bit, np.stack((self.first, self.last), 1).ravel())[::2]

    def bands(self, rows: int, bands: int) -> np.ndarray:
        """One bucket key for each band and paragraph."""
        out = np.zeros((bands, len(self.content)), np.uint64)
        if not len(self.content):
            return out
        spans = np.stack((self.first, self.last), 1).ravel()
        h = np.append(self.hash, np.uint64(0))
        for k, seed in enumerate(_seeds(rows * bands)):
            low = np.minimum.reduceat(tv.mix(h * seed), spans)[::2]
            b = k // rows
            out[b] = tv.mix((out[b] + np.uint64(b + 1)) * seed ^ low)
        return out


def _groups(texts):
    yield from tv.chunks([lowered(t) for t in texts])


_ROWS = pa.schema([("id", pa.int64()), ("text", pa.int64()), ("paragraph", pa.int32()), ("begin", pa.int64()),
                   ("end", pa.int64()), ("n_words", pa.int32()), ("e", pa.int64())])
_BANDS = pa.schema([("key", pa.int64()), ("e", pa.int64()), ("bits", pa.int64())])
_SETS = pa.schema([("e", pa.int64()), ("s", pa.list_(pa.int64()))])


def _list_rows(shape):
    def run(batches):
        for ids, keys, texts in columns(batches):
            for at, group in _groups(texts):
                p = Paragraphs(group, *shape)
                d = (at + p.text).tolist()
                yield batch(_ROWS, pa.array([ids[i] for i in d], pa.int64()), pa.array([keys[i] for i in d], pa.int64()),
                            pa.array(p.number.astype(np.int32)), pa.array(p.begin), pa.array(p.end),
                            pa.array(p.words.astype(np.int32)), pa.array(tv.signed(p.content)))
    return run


def _list_bands(shape, rows, bands):
    """Bucket keys of each content; a task hands on a content once, as far as
    it remembers, so a passage that stands in very many texts is no hot key."""
    def run(batches):
        seen: set[int] = set()
        for (texts,) in columns(batches):
            for _, group in _groups(texts):
                p = Paragraphs(group, *shape)
                e = tv.signed(p.content).tolist()
                new = []
                for i, x in enumerate(e):
                    if x not in seen:
                        seen.add(x)
                        new.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                p.content, p.first, p.last = p.content[new], p.first[new], p.last[new]
                yield batch(_BANDS, pa.array(tv.signed(p.bands(rows, bands).ravel())), pa.array(np.tile(tv.signed(p.content), bands)),
                            pa.array(np.tile(tv.signed(p.bitmaps()), bands)))
    return run


def _list_sets(shape):
    def run(batches):
        for texts, wanted in columns(batches, 64):
            for at, group in _groups(texts):
                p = Paragraphs(group, *shape)
                e, sets = tv.signed(p.content).tolist(), {}
                ask = [set(w) for w in wanted[at:at + len(group)]]
                for i, (x, d) in enumerate(zip(e, p.text.tolist())):
                    if x in ask[d] and x not in sets:
                        sets[x] = tv.signed(np.unique(p.hash[p.first[i]:p.last[i]]))
                flat = np.concatenate(list(sets.values())) if sets else np.zeros(0, np.int64)
                offsets = np.cumsum([0, *map(len, sets.values())]).astype(np.int32)
                yield batch(_SETS, list(sets), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
    return run


def jaccard(a: str, b: str):
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    left, right = (sets.select(F.col("e").alias(x), F.col("s").alias(f"s{x}")) for x in "uv")
    return pairs.join(left, "u").join(right, "v").where(jaccard("su", "sv") >= similarity).select("u", "v")


def _compare_blocks(similarity):
    """Edges that join, within one block, the members that pairs of different
    sides at ``similarity`` connect: at most one fewer than members."""
    edge = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        e, left, s = table["e"].to_pylist(), table["left"].to_pylist(), table["s"].to_pylist()
        sizes = np.array([len(x) for x in s])
        _, col = np.unique(np.concatenate([np.array(x, np.int64) for x in s]), return_inverse=True)
        m = np.zeros((len(s), col.max() + 1), np.float32)
        m[np.repeat(np.arange(len(s)), sizes), col] = 1
        a, b = np.flatnonzero(left), np.flatnonzero(~np.array(left, bool))
        both = m[a] @ m[b].T
        hit = both >= similarity * (sizes[a][:, None] + sizes[b][None, :] - both) - 1e-6
        parent = {x: x for x in e}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(hit)):
            x, y = root(e[a[i]]), root(e[b[j]])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((e[a[i]], e[b[j]]))
        return pa.table({"u": [x for x, _ in out], "v": [y for _, y in out]}, schema=edge)
    return run


def _parts(similarity: float):
    """Keys under which two sets at ``similarity`` meet: with the shingles put
    in order of how rare they are, the two share two at least among each one's
    first ``n - ceil(similarity n) + 2``; a set too small for two pairs is
    keyed by one."""
    schema = pa.schema([("key", pa.int64()), ("e", pa.int64())])

    def run(batches):
        for es, sets in columns(batches):
            keys, of = [], []
            for e, s in zip(es, sets):
                least = int(np.ceil(similarity * len(s) - 1e-9))
                first = [x["h"] for x in s[:len(s) - least + 2]]
                for pair in combinations(first, 2) if least > 1 else ((x, 0) for x in first):
                    a, b = max(pair), min(pair)
                    keys.append(((a * 0x9E3779B97F4A7C15 ^ b) * 0xD6E8FEB86659FD93 + (1 << 63)) % (1 << 64) - (1 << 63))
                    of.append(e)
            yield batch(schema, keys, of)
    return run


def _split(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The members of large buckets, dealt into smaller ones by pairs of their
    rarest shingles; no pair at the similarity is parted."""
    own = sets.join(members.select("e").distinct(), "e")
    one = own.select("e", F.explode("s").alias("h"))
    ranked = one.join(one.groupBy("h").agg(F.count("*").alias("n")), "h").groupBy("e").agg(
        F.sort_array(F.collect_list(F.struct("n", "h"))).alias("s"))
    return ranked.mapInArrow(_parts(similarity), "key long, e long").distinct()


def _counted(keyed: DataFrame) -> DataFrame:
    """``(key, e, bits, n)`` of the buckets with ``n`` > 1 distinct contents;
    ``keyed`` is distinct and dealt out by key."""
    return keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").select("key", "e", "bits", "n")


def _spokes(many: DataFrame, apart: int) -> DataFrame:
    """Pairs ``(u, v)`` of the members of large buckets with their buckets'
    hubs.  Buckets of one group of near copies mostly have the same hubs: a
    member lists each hub once, however many buckets the two share."""
    hubs = many.groupBy("key").agg(F.array(*(F.min_by(F.struct("e", "bits"), F.xxhash64("e", F.lit(k))) for k in range(HUBS))).alias("hubs"))
    met = many.join(hubs, "key").groupBy("e", "bits").agg(F.array_distinct(F.flatten(F.collect_set("hubs"))).alias("hubs"))
    close = F.filter("hubs", lambda h: (h["e"] != F.col("e")) & (F.bit_count(F.col("bits").bitwiseXOR(h["bits"])) <= apart))
    return met.select("e", F.explode(F.transform(close, lambda h: h["e"])).alias("h")).select(
        F.least("e", "h").alias("u"), F.greatest("e", "h").alias("v"))


def _candidates(members: DataFrame, apart: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(u, v)`` of the buckets ``members(key, e, bits, n)`` whose
    bitmaps are at most ``apart`` bits apart, and the members of the large
    buckets.  In a large bucket only pairs with a few hubs are listed."""
    few = members.where(F.col("n") <= PAIRWISE)
    many = members.where(F.col("n") > PAIRWISE).select("key", "e", "bits")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= apart
    pairs = (few.select("key", F.col("e").alias("u"), F.col("bits").alias("x"))
             .join(few.select("key", F.col("e").alias("v"), F.col("bits").alias("y")), "key")
             .where((F.col("u") < F.col("v")) & near("x", "y")).select("u", "v"))
    return stage(pairs.union(_spokes(many, apart)).distinct(), "pairs"), many


def _rest(many: DataFrame, edges: DataFrame) -> DataFrame | None:
    """What is left of the large buckets: those in which the edges leave more
    than one component."""
    if many.isEmpty():
        return None
    roots = stage(components(edges), "roots")
    placed = stage(many.join(roots.withColumnRenamed("node", "e"), "e", "left").select(
        "key", "e", "bits", F.coalesce("root", "e").alias("comp")), "placed")
    parts = placed.groupBy("key", "comp").count()
    main = parts.groupBy("key").agg(F.max(F.struct("count", "comp"))["comp"].alias("main"), F.count("*").alias("comps"))
    rest = stage(placed.join(main.where("comps > 1"), "key"), "rest")
    return None if rest.isEmpty() else rest


def _blocks(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """What is still large after the split: members outside a bucket's main
    component against all of the bucket, in blocks of ``SIDE`` by ``SIDE``."""
    sized = rest.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("comp") != F.col("main")).alias("out")
                                    ).where("out > 0")
    parts = lambda n: F.ceil(F.col(n) / SIDE).cast("int")
    rest = rest.join(sized, "key").withColumn("slot", F.xxhash64("e", F.lit(3)))
    mine = F.pmod("slot", parts("out")).cast("int")
    left = rest.where("comp <> main").select("key", "e", F.lit(True).alias("left"), mine.alias("i"),
                                             F.explode(F.sequence(F.lit(0), parts("n") - 1)).alias("j"))
    right = rest.select("key", "e", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), parts("out") - 1)).alias("i"),
                        F.pmod("slot", parts("n")).cast("int").alias("j"))
    return left.unionByName(right).join(sets, "e").select("key", "i", "j", "e", "left", "s").groupBy(
        "key", "i", "j").applyInArrow(_compare_blocks(similarity), "u long, v long")


def _parts(similarity: float):
    """Keys under which two sets at ``similarity`` meet: with the shingles put
    in order of how rare they are, the two share two at least among each one's
    first ``n - ceil(similarity n) + 2``; a set too small for two pairs is
    keyed by one."""
    schema = pa.schema([("key", pa.int64()), ("e", pa.int64())])

    def run(batches):
        for es, sets in columns(batches):
            keys, of = [], []
            for e, s in zip(es, sets):
                least = int(np.ceil(similarity * len(s) - 1e-9))
                first = [x["h"] for x in s[:len(s) - least + 2]]
                for pair in combinations(first, 2) if least > 1 else ((x, 0) for x in first):
                    a, b = max(pair), min(pair)
                    keys.append(((a * 0x9E3779B97F4A7C15 ^ b) * 0xD6E8FEB86659FD93 + (1 << 63)) % (1 << 64) - (1 << 63))
                    of.append(e)
            yield batch(schema, keys, of)
    return run


def _split(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The members of large buckets, dealt into smaller ones by pairs of their
    rarest shingles; no pair at the similarity is parted."""
    own = sets.join(members.select("e").distinct(), "e")
    one = own.select("e", F.explode("s").alias("h"))
    ranked = one.join(one.groupBy("h").agg(F.count("*").alias("n")), "h").groupBy("e").agg(
        F.sort_array(F.collect_list(F.struct("n", "h"))).alias("s"))
    return ranked.mapInArrow(_parts(similarity), "key long, e long").distinct()


def _edges(members: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """Edges from buckets ``members(key, e)``, and what is left of the large
    ones: a large bucket's members are held against a few hubs, and those
    outside its main component are still to be compared."""
    size = members.groupBy("key").agg(
        F.count("*").alias("n"), *(F.min(F.struct(F.xxhash64("e", F.lit(k)), "e"))["e"].alias(f"hub{k}") for k in range(HUBS)))
    sized = stage(members.join(size.where("n > 1"), "key"), "sized")
    few = sized.where(F.col("n") <= PAIRWISE)
    pairs = few.select("key", F.col("e").alias("u")).join(few.select("key", F.col("e").alias("v")), "key").where(
        "u < v").select("u", "v")
    many = sized.where(F.col("n") > PAIRWISE)
    spokes = many.select(F.explode(F.array(*(F.struct(F.least("e", f"hub{k}").alias("u"), F.greatest("e", f"hub{k}").alias("v"))
                                             for k in range(HUBS)))).alias("p")).select("p.u", "p.v").where("u < v")
    edges = stage(_verified(pairs.union(spokes).distinct(), sets, similarity), "edges")
    if many.isEmpty():
        return edges, None
    roots = stage(components(edges), "roots")
    placed = stage(many.select("key", "e").join(roots.withColumnRenamed("node", "e"), "e", "left").select(
        "key", "e", F.coalesce("root", "e").alias("comp")), "placed")
    parts = placed.groupBy("key", "comp").count()
    main = parts.groupBy("key").agg(F.max(F.struct("count", "comp"))["comp"].alias("main"), F.count("*").alias("comps"))
    rest = stage(placed.join(main.where("comps > 1"), "key"), "rest")
    return edges, None if rest.isEmpty() else rest


def _buckets(text: DataFrame, shape: tuple, rows: int, bands: int) -> DataFrame:
    """``(key, e, bits, n)`` of the buckets with two distinct contents or more."""
    return _counted(text.mapInArrow(_list_bands(shape, rows, bands), "key long, e long, bits long").repartition("key").distinct())


def _sets(plain: DataFrame, found: DataFrame, wanted: DataFrame, shape: tuple) -> DataFrame:
    """``(e, s)``: the shingles of the wanted contents, each taken from one
    text that holds it."""
    asked = (found.join(wanted, "e").groupBy("e").agg(F.min("text").alias("text"))
             .groupBy("text").agg(F.collect_list("e").alias("wanted")))
    return (plain.join(asked, "text").select("body", "wanted").mapInArrow(_list_sets(shape), "e long, s array<long>")
            .groupBy("e").agg(F.first("s").alias("s")))


def classes(plain: DataFrame, found: DataFrame, members: DataFrame, shape: tuple, similarity: float) -> DataFrame:
    """``(e, root)`` for the distinct contents in ``found`` that chains of
    similar paragraphs connect with others; ``members`` are the buckets'."""
    shingle, words, _ = shape
    # Sets of at most `most` shingles at the similarity differ in so few.
    most = words - shingle + 1
    apart = int(2 * most * (1 - similarity) / (1 + similarity) + 1e-9)
    pairs, many = _candidates(members, apart)
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("e")).union(many.select("e")).distinct()
    sets = stage(_sets(plain, found, wanted, shape), "sets")
    edges = stage(_verified(pairs, sets, similarity), "edges")
    rest = _rest(many, edges)
    unstage(members)
    if rest is not None:
        bits = rest.select("e", "bits").distinct()
        split = _split(rest, sets, similarity).join(bits, "e").select("key", "e", "bits")
        pairs, many = _candidates(stage(_counted(split), "split"), apart)
        edges = stage(edges.union(_verified(pairs, sets, similarity)), "edges")
        rest = _rest(many, edges)
    if rest is not None:
        edges = edges.union(_blocks(rest, sets, similarity))
    return components(edges)


def _named(found: DataFrame, roots: DataFrame, order) -> DataFrame:
    """``(e, class_id, n_class, first)`` of the contents in classes of two or
    more paragraphs."""
    contents = found.groupBy("e").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    by_class = contents.join(roots.withColumnRenamed("node", "e"), "e", "left").withColumn("class_id", F.coalesce("root", "e"))
    sizes = by_class.groupBy("class_id").agg(F.sum("n").alias("n_class"), F.min("first").alias("first")).where("n_class > 1")
    return by_class.select("e", "class_id").join(sizes, "class_id")


def duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, words: int = WORDS,
               min_words: int = MIN_WORDS, recall: float = RECALL, rows: int = ROWS_PER_BAND, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``(id, paragraph, begin, end, n_words, class_id, n_class, removed)`` for
    every paragraph whose set of ``shingle``-word shingles has Jaccard
    ``similarity`` with another one's.  ``paragraph`` is the number of its
    first word, ``begin`` and ``end`` its bytes in the text.

    Paragraphs have ``words`` words and may overlap by design; a text of fewer
    words, but ``min_words`` at least, is one; shorter texts have none.
    Classes are the components of such pairs; in each the first paragraph by
    id, then place, stays and the others are ``removed``.  Bands are tuned so
    that pairs at the similarity meet with probability ``recall``; exact
    copies always meet, and so do all pairs of a bucket, however large.  Case
    and punctuation do not count.  Null and empty texts have no paragraphs; a
    null id comes after all others; repeated rows are copies of each other;
    extra columns are ignored; an empty table gives an empty one.
    """
    shape = (shingle, words, min_words)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("text"),
                        F.col(text_col).alias("body"))
    members = stage(_buckets(plain.select("body"), shape, rows, tune_bands(similarity, recall, rows)), "members")
    found = stage(plain.mapInArrow(_list_rows(shape), "id long, text long, paragraph int, begin long, end long, n_words int, "
                                   "e long"), "rows")
    roots = classes(plain, found, members, shape, similarity)
    order = F.struct(F.col("id").isNull().alias("x"), F.col("id"), F.col("paragraph"))
    named = stage(_named(found, roots, order), "named")
    return found.join(named, "e").select("id", "paragraph", "begin", "end", "n_words", "class_id", "n_class",
                                         (F.col("first") != order).alias("removed"))
