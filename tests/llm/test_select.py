"""Quality sampling, decontamination, packing, toxicity."""
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import decontam, packing, quality, toxicity
from flowlens.llm.queries import training_labels, vocabulary

SF = "/root/testdata/sf0.01"


def test_top_k_is_exact(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0.0, 1.5, rnd.gauss(0, 1), rnd.gauss(0, 1)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, sample_key double")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in (0, 1, 700, 1900, 2999, 3000, 4000):
        for small in (50, 20_000):
            got = {r.id for r in quality.top_k(df, k, small=small).where("selected").collect()}
            assert got == {i for i, _ in order[:k]}, (k, small)


@pytest.mark.parametrize("small", [2, 20_000])
def test_top_k_takes_exactly_k(spark, small):
    """Null ids and equal rows: k rows are selected and none is undecided."""
    rows = ([(None, 5.0)] * 3 + [(7, 5.0)] * 4 + [(8, 5.0), (9, 5.0)] + [(1, 9.0), (2, 1.0), (None, 1.0), (3, 4.0)]
            + [(None, 4.0)] * 30 + [(4, 4.0)] * 30)
    df = spark.createDataFrame(rows, "id long, sample_key double").repartition(3)
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    for k in ((6, 20) if small == 2 else (2, 9, 50)):
        got = quality.top_k(df, k, small=small).collect()
        assert len(got) == len(rows) and all(r.selected is not None for r in got)
        assert sorted(((r.id, r.sample_key) for r in got if r.selected), key=str) == sorted(order[:k], key=str), k


def test_log_weights_against_plain_counts(spark):
    """Counts of hashed unigrams and bigrams of good and of all texts."""
    texts = ["good words here and there", "bad words", "good day, good words", "", None, "other things"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sample = spark.createDataFrame([(0, 1), (2, 1), (1, 0)], "id long, y int")
    n = 64
    ratio = quality.fit(docs, sample, n_buckets=n, prior=0.5)
    grams = [quality.buckets([(t or "").encode()], n)[0].tolist() for t in texts]
    raw = np.bincount([g for t in grams for g in t], minlength=n)
    good = np.bincount(grams[0] + grams[2], minlength=n)
    want = np.where(raw > 0, np.log((good + 0.5) / (raw * good.sum() / raw.sum() + 0.5)), 0)
    assert np.allclose(ratio, want)
    got = {r.id: r for r in quality.log_weights(docs, ratio).collect()}
    for i, g in enumerate(grams):
        assert got[i].n_grams == len(g) and abs(got[i].log_weight - sum(want[g])) < 1e-9


def test_labelled_sample_is_the_lowest_hashes(spark):
    labels = spark.range(9000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    got = {r.id for r in quality.labelled_sample(labels, "quality", 500).collect()}
    want = {r.doc_id for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(500).collect()}
    assert got == want


def test_benchmark_in_many_blocks(spark, docs):
    """However small the blocks, the hits are the same."""
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(9))) for i in range(30)], "item_id long, text string")
    rows = [(i, f"a b c {' '.join(f'w{i}x{k}' for k in range(9))} d e f") for i in range(0, 30, 3)]
    table = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, item_id string")
    want = [(i, i) for i, _ in rows]
    for size in (1, 200, 1 << 24):
        got = decontam.contaminated(table, bench.withColumn("doc_id", F.lit("q")), block_bytes=size).select("id", "item").collect()
        assert sorted(map(tuple, got)) == want


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.resample(docs, training_labels(labels))
    held = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).withColumnRenamed("doc_id", "id")
    rows = got.join(held, "id").collect()
    assert np.mean([r.selected == (r.quality == 1) for r in rows]) > 0.95
    assert got.count() == docs.count()


def test_quality_edges(docs, empty, spark, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int, id long")
    assert quality.resample(empty, none).count() == 0
    assert quality.resample(docs, none).where("selected").count() == len(corpus)
    some = spark.createDataFrame([(1, 1, 9), (2, 0, 9), (None, 1, 9), (3, None, 9), (1, 1, 9)], "doc_id long, quality int, id long")
    got = quality.resample(docs, some, k=20).collect()
    assert len(got) == len(corpus) and sum(r.selected for r in got) >= 20
    assert all(r.log_weight == 0 for r in got if r.id in (230, 231))


def brute_tiles(doc, item, k):
    used_d, used_i, tiles = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] \
                        and i + n not in used_i and j + n not in used_d:
                    n += 1
                if n >= k and (best is None or n > best[0]):
                    best = (n, i, j)
        if not best:
            return tiles
        n, i, j = best
        used_i.update(range(i, i + n))
        used_d.update(range(j, j + n))
        tiles.append((j, i, n))


def test_tiles():
    rnd = random.Random(4)
    for _ in range(150):
        item = np.array([rnd.randint(1, 6) for _ in range(rnd.randint(0, 25))], np.uint64)
        doc = np.concatenate([np.array([rnd.randint(1, 6) for _ in range(rnd.randint(0, 10))], np.uint64),
                              *(item[a:a + 9] for a in rnd.sample(range(25), 3))])
        assert decontam.tile(doc, item, 3) == brute_tiles(doc.tolist(), item.tolist(), 3)


def test_contaminated(spark, docs, empty, corpus):
    item = "one two, three four five SIX seven eight nine ten eleven twelve"
    w = item.replace(",", "").lower().split()
    moved = " ".join(w[6:] + ["pause"] + w[:6])
    rows = [(1, f"before {item.upper()} after"), (2, moved), (3, " ".join(w[:8])), (4, None), (5, ""), (None, item), (1, item)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (10, item), (11, "too short"), (12, None), (None, item)], "item_id long, text string")
    for size in (1 << 20, 1):                           # one block, and one for each item
        got = sorted((str(r.id), r.item, r.coverage, len(r.tiles)) for r in decontam.contaminated(table, bench, block_bytes=size).collect())
        assert got == [("1", 10, 1.0, 1), ("1", 10, 1.0, 1), ("2", 10, 1.0, 2), ("None", 10, 1.0, 1)]
    assert decontam.contaminated(empty, bench).count() == 0
    assert decontam.contaminated(table, bench.limit(0)).count() == 0


def test_plan_uses_every_piece_once():
    rnd = random.Random(6)
    for cap in (10, 64, 500):
        for _ in range(30):
            sizes = {}
            for _ in range(rnd.randint(0, 400)):
                n = min(cap, max(1, int(rnd.expovariate(3 / cap))))
                sizes[n] = sizes.get(n, 0) + 1
            used, total = {}, 0
            for n, parts in packing.plan(sizes, cap):
                assert n > 0 and sum(a * b for a, b in parts) <= cap
                total += n
                for a, b in parts:
                    used[a] = used.get(a, 0) + n * b
            assert used == sizes
            least = -(-sum(a * b for a, b in sizes.items()) // cap)
            assert least <= total <= max(least + 1, 1.1 * least + 1)


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary())
    rnd = random.Random(8)
    signs = [chr(i) for i in range(0x17F)] + list("'sre've'll d!?., 019")
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    texts += ["İx", "日本 é", "Σας ΟΔΟΣ", "<|endoftext|> a", "", None]
    for text, got in zip(texts, packing.Encoder(vocabulary()).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("capacity", [4096, 50])
def test_pack(docs, empty, corpus, capacity):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary())
    rows = packing.pack(docs, vocabulary(), capacity, rows_per_bucket=5).collect()
    want = []
    for i, text in corpus:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for n, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a:a + capacity]
            want.append((str(i), n, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert packing.pack(empty, vocabulary()).count() == 0


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(q[-1] + 1, p[j] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_automaton():
    rnd = random.Random(2)
    terms = {"idiot": 5.0, "worthless": 6.0, "scum": 3.0, "stupid": 4.0, "stupids": 4.5, "disgusting": 7.0}
    lexicon = toxicity.Lexicon(terms, {"studio"})
    for _ in range(4000):
        w = list(rnd.choice(list(terms)))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(w) + 1)
            w[at:at + rnd.randint(0, 1)] = rnd.choice(["", "a", "s", "t"])
        w = "".join(w)
        near = [(levenshtein(w, t), -terms[t]) for t in terms if levenshtein(w, t) <= toxicity.edits_allowed(t)]
        got = lexicon.match(w)
        assert (got and (got[1], -got[0])) == (min(near) if near and w != "studio" else None), w


def test_context_tells_quotation_from_abuse():
    lexicon = toxicity.Lexicon({"idiot": 5.0})
    cues = tuple(map(toxicity._hashes, (toxicity.QUOTES[:1], toxicity.REPORTING, toxicity.ADDRESS)))
    texts = ["you are an idiot and a fool", "the word “idiot” is old", "you idoit here", "you idiott here", "", "nothing at all"]
    f = toxicity.features([toxicity._plain(t).encode() for t in texts], lexicon, cues)
    exact, quoted, near, _, addressed = f[:, 0], f[:, 1], f[:, 2], f[:, 3], f[:, 4]
    assert exact[0] > 0 and quoted[0] == 0 and addressed[0] > 0
    assert exact[1] == 0 and quoted[1] > 0
    assert near[3] > 0 and near[2] == 0                 # a swap is two edits
    assert not f[4:].any()


def test_toxicity_held_out_and_edges(spark, docs, empty, corpus):
    table, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(table, training_labels(labels))
    held = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).withColumnRenamed("doc_id", "id")
    rows = toxicity.score(table, model).join(held, "id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(corpus) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    unlabelled = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.predicted == 0 for r in toxicity.score(docs, unlabelled).collect())
