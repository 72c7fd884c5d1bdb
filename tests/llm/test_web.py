"""Fingerprints, URL rules and page text."""
import hashlib
import html

from flowlens.llm import html_extract, sketch, urls
from flowlens.llm.queries import URL_RULES


def test_sketch_of_a_union_and_containment():
    a, b = (" ".join(f"w{i}" for i in range(x, y)).encode() for x, y in ((0, 4000), (2000, 4000)))
    whole, part = sketch.sketch(a), sketch.sketch(b)
    scale = max(whole.scale, part.scale)
    assert set(sketch.merge(whole, part)) == set(whole.at(scale)) | set(part.at(scale))
    assert sketch.containment(part, whole) > 0.98 and 0.4 < sketch.containment(whole, part) < 0.6
    again = sketch.decode(sketch.encode(whole))
    assert (again.name, again.scale) == (whole.name, whole.scale) and (again.hashes == whole.hashes).all()


def test_a_coarser_scale_is_the_coarser_sketch():
    text = " ".join(f"word{i * 7919}" for i in range(900)).encode()
    dense = sketch.sketch(text, scale=1)
    for scale in (2, 4, 8, 16):
        assert (dense.at(scale) == sketch.sketch(text, scale=scale, enough=0).hashes).all()
    assert sketch.sketch(b"a few words only").scale == 1


def exact_likeness(a, b):
    grams = [{t[i:i + 8] for i in range(max(1, len(t) - 7))} if t else set() for t in (a, b)]
    return len(grams[0] & grams[1]) / len(grams[0] | grams[1]) if grams[0] | grams[1] else 1.0


def test_likeness_against_exact_jaccard(spark):
    """All documents of the small tables and their edited texts: the estimate
    is near the exact Jaccard, for short texts it is the exact one."""
    rows = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    errors, short = [], []
    for t, n in zip(rows, rows[1:]):
        a, b = t.encode(), sketch.edited(t, n).encode()
        x, y = sketch.sketch(a), sketch.sketch(b)
        error = abs(sketch.likeness(x, y) - exact_likeness(a, b))
        (short if max(x.scale, y.scale) == 1 else errors).append(error)
    assert max(short) < 1e-9 and len(short) > 50
    assert max(errors) < 0.1 and sum(errors) / len(errors) < 0.02


def test_compare_with_next(spark, docs, corpus, empty):
    for stretch in (500, 7):
        got = sketch.compare_with_next(docs, stretch=stretch).collect()
        assert len(got) == len(corpus)
        unique = sorted((i, t or "") for i, t in corpus if i not in (None, 3))
        by = {r.id: r for r in got}
        for (i, t), (j, n) in zip(unique, unique[1:]):
            if j != i + 1 or i == 234:
                continue
            q = len(t) // 4
            e = t[:len(t) - q] + n[:q]
            f, g = sketch.decode(by[i].fingerprint), sketch.decode(by[i].edited_fingerprint)
            assert by[i].n_chars == len(t) and by[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            assert g.name == sketch.sketch(e.encode()).name and by[i].near_edited == sketch.likeness(f, g)
            assert by[i].near_next == sketch.likeness(f, sketch.decode(by[j].fingerprint))
    assert sketch.compare_with_next(empty).count() == 0
    one = sketch.compare_with_next(spark.createDataFrame([(4, "abcd" * 9)], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    lost = sketch.compare_with_next(spark.createDataFrame([(None, "a"), (None, "b")], "doc_id long, text string"))
    assert lost.count() == 2


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name)) if fits else None


def test_urls(spark):
    given = ["HTTP://A.Com", "http://x.com/a?b=1&c=2#d", None, "mailto:x", "https://www.example.com/en/1?x", "://",
             "https://b.example.com/en/1", "https://q.net/es/", "https://Ünet.NET?x=/es/", "http://com/x", "http://acom/",
             "http://a.org/x\ny", "", "http://example.com/de/", "x://y://z.com/a", "http://f.net/fr/#a", "http://f.net/fr"]
    table = spark.createDataFrame([(i, u, "a", 1.0) for i, u in enumerate(given)] * 2 + [(None, given[0], "a", 1.0)],
                                  "page_id long, url string, host string, score double")
    rows = urls.judge(table, URL_RULES).collect()
    assert len(rows) == 2 * len(given) + 1
    for r in rows:
        if r.id is None:
            continue
        host, path, rule = brute_rule(given[r.id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
    assert urls.judge(table.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in urls.judge(table, [urls.Rule("block", "com", "/")]).collect()} == {"block"}
    assert {r.verdict for r in urls.judge(table, []).collect()} == {"allow"}


def test_extract():
    page = ('<html><head><title>T</title></head><body><header>Site</header><div id="sidebar">side</div><main><article><header>'
            '<h2>Head</h2></header><p>One&nbsp;two <b>th</b>ree<p>four &lt;b&gt; <ul><li>a<li>b</ul><aside>no</aside>'
            '<div class="comments"><p>reader</p></div><script>if(a<b){"<p>"}</script></article></main><form>f</form>'
            '<div class="ad-box">buy</div><footer>x</footer>')
    assert html_extract.extract(page) == "Head One two three four <b> a b"
    assert html_extract.extract("") == "" and html_extract.extract("a<br>b<!-- c --> d & e &amp; f <x") == "a b d & e & f <x"
    deep = "<div>" * 5000 + "in" + "</div>" * 5000 + " out"
    assert html_extract.extract(deep) == "in out"


def test_template_is_cut_where_markup_says_nothing(spark):
    """No article, no telling names: constant places go, varying ones stay."""
    rows = []
    for i in range(30):
        story = "".join(f"<p>Story {i} part {k} &amp; more</p>" for k in range(1 + i % 3))
        rows.append((i, "http://h.org/%d" % i, f"<body><div><p>Welcome to us</p></div><div><div>{story}</div></div>"
                                              f"<section>All rights {html.escape('<r>')}</section></body>", "x", 1))
    rows += [(30, "http://one.org/", "<body><div>Alone</div></body>", "x", 1), (31, None, None, "x", 1), (32, "u", "", "x", 1),
             (None, "http://h.org/n", "<body><div><p>Welcome to us</p></div><div><div><p>N</p></div></div></body>", "x", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text int")
    got = {r.id: r.text for r in html_extract.main_text(table).collect()}
    for i in range(30):
        assert got[i] == " ".join(f"Story {i} part {k} & more" for k in range(1 + i % 3))
    assert (got[30], got[31], got[32], got[None]) == ("Alone", "", "", "N")
    assert html_extract.main_text(table.limit(0)).count() == 0
