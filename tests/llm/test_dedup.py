"""Near and exact duplicates against brute force."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from flowlens.llm import paragraphs, simhash, suffix_dedup, textvec
from flowlens.llm.components import components


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark, sets):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(5, 5)]
    s = sets(500)
    for a, b in edges:
        s.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: s.root(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("pairwise", [32, 2])
def test_simhash(docs, corpus, sets, pairwise, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    fps = [brute_fingerprint(t) for _, t in corpus]
    s = sets(len(corpus))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                s.join(i, j)
    low = {}
    for k, (i, _) in enumerate(corpus):
        if i is not None:
            low[s.root(k)] = min(i, low.get(s.root(k), i))
    want = Counter((i, fps[k], low.get(s.root(k))) for k, (i, _) in enumerate(corpus))
    assert Counter((r.id, r.fp & (1 << 64) - 1, r.component) for r in got) == want


@pytest.mark.parametrize("pairwise", [32, 2])
def test_links_of_a_crowded_ball(spark, sets, pairwise, monkeypatch):
    """Many fingerprints around one: cells of all sizes, no pair lost."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rnd = random.Random(9)
    centre = rnd.getrandbits(63)
    fps = {centre ^ sum(1 << b for b in rnd.sample(range(60), rnd.randint(0, 5))) for _ in range(150)}
    fps = sorted(fps | {rnd.getrandbits(63) for _ in range(100)})
    s = sets(len(fps))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                s.join(i, j)
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    assert edges.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > 3).count() == 0
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {x: fps[s.root(i)] for i, x in enumerate(fps) if sum(s.root(j) == s.root(i) for j in range(len(fps))) > 1}


def brute_cut(texts, span):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i:i + span]] > 1:
                gone[i:i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("span,key,group", [(200, 64, 16), (60, 20, 4)])
def test_suffix_dedup(docs, corpus, span, key, group):
    got = suffix_dedup.remove_repeats(docs, span, key, group, carry=["lang", "fp"]).collect()
    want = brute_cut([t for _, t in corpus], span)
    assert sum(w[1] for w in want) > 1000
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == \
        Counter((i, *w) for (i, _), w in zip(corpus, want))
    assert all(r.carried.fp == "x" and r.carried.lang is None for r in got)
    assert all((r.kept_text is None) == (r.id == 230) for r in got)


def test_suffix_dedup_rejects_wrong_parameters(docs):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, 100, 90, 20)


def cut(text, words=25, min_words=20, reach=5):
    """``(number of the first word, words)`` of each paragraph."""
    t = textvec.tokens([paragraphs.lowered(text)], words=True)
    w = [t.buf[a:b].tobytes() for a, b in zip(t.start, t.end)]
    two = [int(textvec.mix(t.hash[i:i + 1] * np.uint64(0x9FB21C651E98DF25) ^ t.hash[i + 1:i + 2])[0]) for i in range(len(w) - 1)]
    at = [i for i in range(reach, len(w) - words + 1) if i + reach + 1 < len(w)
          and two[i] < min(two[i - reach:i]) and two[i] <= min(two[i + 1:i + reach + 1])]
    return [(i, w[i:i + words]) for i in sorted({0, *at}) if len(w) >= min_words]


def brute_paragraphs(corpus, sets, similarity=0.8):
    items = []
    for i, t in corpus:
        for n, w in cut(t):
            items.append((i, n, {tuple(w[k:k + 5]) for k in range(len(w) - 4)}))
    s = sets(len(items))
    where = {}
    for k, (_, _, x) in enumerate(items):
        for h in x:
            where.setdefault(h, []).append(k)
    for a, (_, _, x) in enumerate(items):
        for b in {k for h in x for k in where[h] if k < a}:
            if len(x & items[b][2]) >= similarity * len(x | items[b][2]):
                s.join(a, b)
    groups = {}
    for k in range(len(items)):
        groups.setdefault(s.root(k), []).append(items[k][:2])
    return Counter(tuple(sorted(g, key=str)) for g in groups.values() if len(g) > 1)


def near_texts():
    """Passages with a few words changed near their ends, so that paragraphs
    of similarity 0.8 and more, and of less, abound."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(4)) for _ in range(300)]
    base = [rnd.choice(words) for _ in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((1000 + i, " ".join(w[:rnd.choice([21, 22, 24, 25, 60])])))
    return rows


@pytest.mark.parametrize("pairwise", [32, 2])
def test_paragraphs(spark, corpus, sets, pairwise, monkeypatch):
    monkeypatch.setattr(paragraphs, "PAIRWISE", pairwise)
    monkeypatch.setattr(paragraphs, "SIDE", 3)
    monkeypatch.setattr(paragraphs, "HUBS", 4 if pairwise > 2 else 1)
    rows = [*corpus, *near_texts()]
    table = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, id long, e string").repartition(5)
    got = paragraphs.duplicates(table, recall=0.999999).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.class_id, []).append((r.id, r.paragraph))
    assert Counter(tuple(sorted(g, key=str)) for g in groups.values()) == brute_paragraphs(rows, sets)
    text = {}
    for i, t in rows:
        text.setdefault(i, []).append((t or "").encode())
    for c in groups:
        members = [r for r in got if r.class_id == c]
        first = min((r.id is None, r.id or 0, r.paragraph) for r in members)
        assert all(r.n_class == len(members) and r.removed == ((r.id is None, r.id or 0, r.paragraph) != first) for r in members)
    for r in got:
        assert any(len(re.findall(rb"[a-z0-9\x80-\xff]+", b[r.begin:r.end].lower())) == r.n_words for b in text[r.id])


def test_split_parts_keep_pairs():
    """Two sets at the similarity share a key of the smaller buckets."""
    rnd = random.Random(10)
    run = paragraphs._parts(0.8)
    for _ in range(300):
        n = rnd.choice([1, 2, 3, 5, 16, 21])
        a = set(rnd.sample(range(60), n))
        b = set(a)
        for _ in range(rnd.randint(0, 3)):
            b.symmetric_difference_update({rnd.randrange(60)})
        if not b or len(a & b) < 0.8 * len(a | b):
            continue
        rank = {h: (h * 7919 % 13, h) for h in a | b}
        rows = [[{"n": rank[h][0], "h": h} for h in sorted(x, key=rank.get)] for x in (a, b)]
        kind = pa.list_(pa.struct([("n", pa.int64()), ("h", pa.int64())]))
        out = next(run([pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int64()), pa.array(rows, kind)], ["e", "s"])]))
        keys = {0: set(), 1: set()}
        for k, e in zip(*(c.to_pylist() for c in out.columns)):
            keys[e].add(k)
        assert keys[0] & keys[1]


def test_planted_passages(spark):
    """Passages of 51 words and more are found wherever they are put in, and
    texts that share only short lines are left alone."""
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]

    def prose(n):
        return " ".join(rnd.choice(words) + rnd.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))
    notice = ["All rights reserved by the makers of this text", "Click here to read more and share it with friends today"]
    rows, planted = [], set()
    for k in range(150):
        passage = prose(rnd.randint(51, 80)).replace("\n", " ")
        for _ in range(2):
            t = prose(rnd.randint(40, 300)).split(" ")
            t.insert(rnd.randrange(len(t)), rnd.choice(["", "\n", "&&& "]) + passage)
            planted.add(len(rows))
            rows.append(" ".join(t))
    for k in range(300):
        t = prose(rnd.randint(30, 300)).split("\n")
        t.insert(rnd.randrange(len(t)), rnd.choice(notice))
        t.insert(rnd.randrange(len(t)), rnd.choice(notice))
        rows.append("\n".join(t))
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.id for r in paragraphs.duplicates(table).select("id").distinct().collect()}
    assert len(got & planted) >= 0.95 * len(planted)
    assert len(got - planted) <= 0.01 * 300


def test_paragraph_starts_depend_on_content_only():
    rnd = random.Random(13)
    words = [str(rnd.randrange(900)) for _ in range(5000)]
    for _ in range(100):
        p = [rnd.choice(words) for _ in range(80)]
        found = []
        for _ in range(2):
            before, after = ([rnd.choice(words) for _ in range(rnd.randint(0, 40))] for _ in range(2))
            found.append({i - len(before) for i, _ in cut(" ".join(before + p + after)) if i >= len(before) + 5
                          and i + 25 <= len(before) + 80 and i + 6 < len(before) + 80})
        assert found[0] == found[1]


def test_paragraph_long_and_changed_case(spark):
    """A text over several buffers, and letters whose lower case is longer."""
    long = " ".join(f"w{k % 9973}x{k % 7}" for k in range(90_000))
    table = spark.createDataFrame([(1, long), (2, "İ Ⱥ " + long[5000:6000]), (3, long)], "doc_id long, text string")
    got = paragraphs.duplicates(table).collect()
    assert {r.id for r in got} == {1, 2, 3}
    assert {r.paragraph for r in got if r.id == 1} == {r.paragraph for r in got if r.id == 3}
    assert all(r.removed for r in got if r.id > 1) and not all(r.removed for r in got if r.id == 1)


def test_band_tuning():
    for rows in (2, 3, 4):
        n = paragraphs.tune_bands(0.8, 0.9995, rows)
        assert 1 - (1 - 0.8 ** rows) ** n >= 0.9995 > 1 - (1 - 0.8 ** rows) ** (n - 1)


def test_empty_tables(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert paragraphs.duplicates(empty).count() == 0


def test_members_list_each_hub_once(spark):
    """Near copies that share many buckets are held against their hubs once."""
    rows = [(k, e, e % 3) for k in range(9) for e in range(50)]
    got = paragraphs._spokes(spark.createDataFrame(rows, "key long, e long, bits long"), 2).collect()
    assert all(r.u < r.v for r in got)
    pairs = {(r.u, r.v) for r in got}
    hubs = {x for x in range(50) if sum(x in p for p in pairs) == 49}
    assert 1 <= len(hubs) <= paragraphs.HUBS and len(got) <= len(hubs) * 49
    assert pairs == {(min(h, e), max(h, e)) for h in hubs for e in range(50) if e != h}
