"""Ranked search, spelling variants, token counts."""
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from flowlens.llm import queries, ranked, tokencount, variants
from flowlens.llm.shortkeys import PAD, ByteTable, padded

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_byte_table():
    rnd = random.Random(1)
    keys = list({bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(0, 20))) for _ in range(3000)})
    table = ByteTable(keys[:2000], range(2000))
    data = b"".join(keys)
    size = np.array([len(k) for k in keys])
    end = np.cumsum(size)
    got = table.find(padded(data), end - size, end)
    assert got.tolist() == [*range(2000), *[-1] * (len(keys) - 2000)]
    assert ByteTable([], []).find(np.zeros(PAD + 1, np.uint8), np.array([0]), np.array([1])).tolist() == [-1]


# Ranked search

def brute_rank(docs, items, top):
    docs = [(i, TERM.findall(lower(t or ""))) for i, t in docs]
    docs = [(i, len(t), Counter(t)) for i, t in docs if t]
    total = sum(n for _, n, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, n, c in docs:
            m = 100 - 25 + 25 * n * len(docs) // total
            s = 0
            for t in TERM.findall(lower(text or "")):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1)))
                    s += w * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("max_terms", [4096, 30])
def test_ranked(spark, docs, corpus, max_terms, monkeypatch):
    rnd = random.Random(2)
    words = [w for _, t in corpus[:40] for w in (t or "").split()]
    items = [(k, " ".join(rnd.choices(words, k=rnd.randint(1, 90)))) for k in range(12)]
    items += [(3, items[0][1].upper()), (None, items[1][1]), (20, None), (21, ""), (22, "unheardof " * 3), (23, "x" * 5000)]
    table = spark.createDataFrame([(i, t, 5, "z") for i, t in items], "item_id long, text string, doc_id long, score string")
    got = ranked.rank(docs.repartition(5), table, top=7, max_terms=max_terms)
    assert got.columns == ["item_id", "rank", "id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_rank(corpus, items, 7)


def test_ranked_stops_early_and_keeps_ties():
    """Masks that cannot reach the best are not scored; equal scores are."""
    rnd = np.random.default_rng(3)
    gain = np.zeros((6, 4096), np.int32)
    gain[0, rnd.choice(4096, 60, replace=False)] = 500_000        # a rare, heavy term
    for t in range(1, 6):
        gain[t, rnd.random(4096) < 0.5] = 400_000
    value = np.array([9000, 10, 10, 10, 10, 10])
    ids = rnd.permutation(4096)
    best = ranked.Best(20)
    scored = ranked.search(best, np.packbits(gain > 0, axis=1), gain, gain.max(axis=1).astype(np.int64), np.arange(6), value,
                           ids, np.zeros(4096, bool))
    score = value @ gain.astype(np.int64)
    want = sorted(zip((-score).tolist(), ids.tolist()))[:20]
    assert list(zip((-best.score).tolist(), best.id.tolist())) == want
    assert scored <= 120


def test_masks_of_many_terms():
    rnd = np.random.default_rng(4)
    for terms in (1, 8, 63, 64, 65, 200):
        bits = rnd.random((terms, 50)) < 0.5
        bits[:, 20:] = bits[:, :30]
        distinct, group = ranked.masks(np.packbits(bits, axis=1), np.arange(50))
        assert (distinct[group] == bits.T).all() and len(distinct) == len(set(map(tuple, bits.T)))


def test_ranked_long_text_and_empty(spark, empty):
    long = ("alpha beta-gamma été. " * 40_000) + "omega"                  # several buffers
    docs = spark.createDataFrame([(1, long), (1, long), (2, "omega omega"), (3, "ALPHA")], "doc_id long, text string")
    items = [(1, "omega alpha"), (2, "été gamma")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_rank([(1, long), (1, long), (2, "omega omega"), (3, "ALPHA")], items, 20)
    assert sorted(map(tuple, ranked.rank(docs, bench).collect()), key=str) == want
    assert ranked.rank(empty, bench).count() == 0
    none = ranked.rank(docs, bench.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "id", "score"]


def test_ranked_sql(docs, corpus, spark):
    """The registered SQL agrees with the brute-force version."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in corpus])
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    items = [(k, corpus[k][1]) for k in range(5)] + [(9, None)]
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [list(r) for r in items])
    assert sorted(con.execute(queries.ORACLE["op11_ranked_search"]).fetchall(), key=str) == brute_rank(corpus, items, 20)


# Spelling variants

def brute_variants(rows, min_length=7, min_count=2, one_in=31, ratio=10):
    c = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = lower(r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % one_in == 0:
                p = h % len(r)
                r = r[:p] + r[p + 1:]
            c[r] += 1
    w = {k: v for k, v in c.items() if len(k) >= min_length and v >= min_count}
    near, cut = defaultdict(set), defaultdict(set)
    for x in w:
        for i in range(len(x)):
            y = x[:i] + x[i + 1:]
            cut[i, y].add(x)
            if y in w:
                near[x].add(y)
                near[y].add(x)
    for g in cut.values():
        for x in g:
            near[x] |= g - {x}
    form = {}
    for x in w:
        if near[x]:
            m = min(near[x], key=lambda y: (-w[y], y))
            if w[m] >= ratio * w[x]:
                form[x] = m
    out = set()
    for x in w:
        root = x
        while root in form:
            root = form[root]
        out.add((x, form.get(x), root, w[x], len(near[x]), w.get(form.get(x))))
    return out


def test_choose_pivots():
    rnd = random.Random(5)
    for _ in range(500):
        places = sorted(rnd.sample(range(14), rnd.randint(5, 8)))
        weight = [rnd.randint(1, 9) for _ in places]
        got = variants.choose(places, weight, pick=3)
        w = dict(zip(places, weight))
        best = min(w[a] + w[b] + w[c] for a in places for b in places for c in places if b >= a + 2 and c >= b + 2)
        assert sum(w[p] for p in got) == best and all(b - a >= 2 for a, b in zip(got, got[1:]))


def test_pivots_meet_every_near_word():
    """Whatever the edit, one of the two words looks up an entry of the other."""
    rnd = random.Random(6)
    for n in (4, 7, 9, 40, 47, 48, 49, 50, 200):
        words = set()
        for _ in range(60):
            w = "".join(rnd.choice("abé") for _ in range(n))
            p = rnd.randrange(n + 1)
            words |= {w, w[:p] + "z" + w[p:], w[:p] + "z" + w[p + 1:]} | ({w[:p] + w[p + 1:]} if n > 4 and p < n else set())
        words = [w.encode("latin-1") for w in words]
        counts = Counter(g for w in words for g in {w[i:i + 2] for i in range(len(w) - 1)})
        grams = variants.Grams(counts)
        entry = {w: grams.pivot_keys(w) for w in words}
        look = {w: grams.prefix_keys(w) for w in words}
        near = 0
        for r in words:
            for s in words:
                if r != s and abs(len(r) - len(s)) <= 1 and one_edit(r, s):
                    near += 1
                    assert any(entry[x][1] <= look[y][1] and entry[x][0] & look[y][0] for x, y in ((r, s), (s, r))), (r, s)
        assert near > 60


def one_edit(r, s):
    if len(r) > len(s):
        r, s = s, r
    i = 0
    while i < len(r) and r[i] == s[i]:
        i += 1
    return r[i + 1:] == s[i + 1:] if len(r) == len(s) else r[i:] == s[i + 1:]


def variant_rows():
    rnd = random.Random(7)
    base = ["".join(rnd.choice("abcdeoéÿ") for _ in range(rnd.randint(7, 12))) for _ in range(40)]
    rows, chain = [], ["abcdefgh"] + ["abcdefg" + "xyz"[:k] for k in range(1, 3)]
    for i in range(400):
        out = []
        for _ in range(rnd.randint(0, 30)):
            w = rnd.choice(base[:3] if rnd.random() < 0.7 else base)
            if rnd.random() < 0.1:
                p = rnd.randrange(len(w))
                w = rnd.choice([w[:p] + w[p + 1:], w[:p] + "q" + w[p:], w[:p] + "q" + w[p + 1:]])
            out.append(w.upper() if rnd.random() < 0.1 else w.capitalize())
        rows.append((i, rnd.choice([" ", "1", "Ā", "中", "\n"]).join(out)))
    # a chain of forms: counts 2, 30, 400
    for k, n in enumerate((400, 30, 2)):
        rows.append((1000 + k, f"{chain[k]} " * n))
    return [*rows, (None, base[0] + " " + base[1]), (7, rows[7][1]), (2000, None), (2001, ""), (2002, "z" * 3000 + " " + "z" * 3000),
            (2003, ("filler " * 400_000) + "fillers fillers")]


def test_variants(spark):
    rows = variant_rows()
    table = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(6)
    got = variants.group_variants(table)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(rows)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert any(f and f != r for _, f, r, *_ in want)
    assert variants.group_variants(table, min_length=4, min_count=1, one_in=0, ratio=3).count() == len(
        brute_variants(rows, 4, 1, 1 << 60, 3))


def test_variants_edges(spark, docs, corpus, empty):
    assert variants.group_variants(empty).count() == 0
    assert {tuple(r) for r in variants.group_variants(docs).collect()} == brute_variants(corpus)
    with pytest.raises(ValueError):
        variants.group_variants(docs, min_length=3)


# Token counts

def test_token_counts(spark, docs, corpus, empty):
    rnd = random.Random(8)
    signs = "abc the 123 \n\t\r\0 éü▁ﬁ中文\U0001f44d\U0001f3fd<s></s><unk><0x0A>.,'-_     При"
    rows = [(i, "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60)))) for i in range(800)]
    rows += [(900, "a" * 300_000), (901, "word " * 120_000), (902, "中" * 200_000), (903, " " * 5), (904, "▁"),
             (904, "▁"), (None, "some text")]
    coder = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def want(i, t):
        n = len(coder.encode(t)) if t else 0
        return i, len((t or "").encode()), n, n > 4096
    table = spark.createDataFrame([(i, t, 3, "q") for i, t in rows], "doc_id long, text string, n_tokens int, id string")
    got = tokencount.count_tokens(table.repartition(4), MODEL)
    assert got.columns == ["id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((want(*r) for r in rows), key=str)
    assert sorted(map(tuple, tokencount.count_tokens(docs, MODEL).collect()), key=str) == sorted(
        (want(*r) for r in corpus), key=str)
    assert tokencount.count_tokens(empty, MODEL).count() == 0


def test_token_tiers(monkeypatch):
    """Either tier gives the library's counts, also when the cache starts anew."""
    texts = [f"word{k} some other words, {k * 7919} x\n" * 20 for k in range(50)]
    coder = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [len(x) for x in coder.encode(texts)]
    monkeypatch.setattr(tokencount, "CACHED", 40)
    plain = tokencount.TokenCounter(MODEL)
    assert plain.count(texts).tolist() == want
    keys = [b" some", b" other", b" words", b",", b" x"]
    table = ByteTable(keys, [len(coder.encode("\n" + k.decode())) - plain.mark for k in keys])
    both = tokencount.TokenCounter(MODEL, table)
    assert both.count(texts).tolist() == want and not set(keys) & set(both.known)


def test_word_queries(spark):
    """The columns of the contracts, over the whole small tables."""
    sf = "/root/testdata/sf0.001"
    q = queries.QUERIES
    assert q["op11_ranked_search"](spark, sf).columns == ["item_id", "rank", "doc_id", "score"]
    assert q["op12_spelling_variants"](spark, sf).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = q["op13_token_counts"](spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
