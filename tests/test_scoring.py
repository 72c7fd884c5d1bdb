"""Train, choose, save, load, score: batch and upload stream give the same rows."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlens.plans import train as tn
from flowlens.plans.score import from_raw_csv, score
from flowlens.session import scratch_path
from flowlens.sources import adapters
from flowlens.streaming import streams as st


@pytest.fixture(scope="module")
def artifacts(spark):
    path = scratch_path(spark, "t-artifacts")
    a = tn.train(spark, adapters.flows(spark, SF_SMALL), trees=20, depth=6, rounds=5, iterations=50, isolation_trees=20,
                 ranking={"trees": 10, "rounds": 6, "boruta_trees": 10, "depth": 5})
    tn.save(a, path)
    return a, tn.load(spark, path)


def test_all_rankings_are_in_the_artifacts(artifacts):
    a, b = artifacts
    assert {r.method for r in b.rankings.select("method").distinct().collect()} == {"anova", "mi", "forest", "boruta"}
    got = b.rankings.where("selected").collect()
    assert set(a.features) >= {r.feature for r in got} - set(tn.K.NON_REALTIME_FEATURES)


def test_versions_are_published_whole(spark, artifacts, tmp_path):
    """While a second version is being written, every load gives the first or
    the second, with all its parts from one."""
    import threading
    from dataclasses import replace
    a, _ = artifacts
    base = scratch_path(spark, "t-versions")
    with pytest.raises(FileNotFoundError):
        tn.load(spark, base)
    mark = lambda k: replace(a, protocols=[str(k)], norm=a.norm.withColumn("p0", F.lit(float(k))))
    assert tn.save(mark(1), base) == 1
    seen, writer = [], threading.Thread(target=lambda: [tn.save(mark(k), base) for k in (2, 3)])
    writer.start()
    while writer.is_alive():
        b = tn.load(spark, base)
        seen.append((b.protocols[0], b.norm.first()["p0"]))
    writer.join()
    assert seen and all(float(p) == n for p, n in seen)
    assert tn.load(spark, base).protocols == ["3"] and tn.load(spark, base, version=1).protocols == ["1"]
    # A version that was never published is not seen.
    from flowlens.sources import io
    io.save_params(a.norm, f"{base}/v-half/norm")
    assert tn.load(spark, base).protocols == ["3"]


def test_best_candidate_is_kept(artifacts):
    a, b = artifacts
    rows = {r.model: r for r in a.comparison.collect()}
    assert set(rows) == {"logistic", "forest", "boosted"}
    best = max(rows.values(), key=lambda r: r.macro_f1)
    assert rows[best.model].best and 0 < best.macro_f1 <= 1
    assert b.features == a.features and b.protocols == a.protocols
    for name in tn.TABLES:
        assert sorted(map(str, getattr(a, name).collect())) == sorted(map(str, getattr(b, name).collect()))
    assert b.isolation.select("tree").distinct().count() == 20


def _numbers(df):
    return {r.flow_key: (r.predicted_label, r.explanation, round(r.attack_score_supervised, 9),
                         round(r.attack_score_unsupervised, 6)) for r in df.collect()}


def test_stream_equals_batch_whatever_arrives_together(spark, artifacts):
    _, a = artifacts
    raw = adapters.raw_flows(spark, SF_SMALL).limit(900).checkpoint()
    got = []
    for files in (1, 5):
        up = scratch_path(spark, f"t-up{files}")
        raw.repartition(files).write.option("header", "true").csv(up)
        runs = st.score_uploads(spark, up, raw.columns, a, scratch_path(spark, f"t-runs{files}"), files_per_batch=3)
        res = runs.read("results")
        assert res.count() == 900 and res.select("run_id").distinct().count() == files
        log = runs.read("attack_log").select("id", "attack_type", "severity", F.round("confidence", 9))
        got.append((_numbers(res), sorted(map(str, log.collect()))))
        status = st.latest_status(runs.status()).collect()
        assert len(status) == 2 * files and {(r.status, r.attempt) for r in status} == {("completed", 1)}
        assert sum(r.n_rows for r in status if r.step == "scoring") == 900
        assert {r.run_id for r in status} == {r.run_id for r in res.select("run_id").distinct().collect()}
    assert got[0] == got[1]
    whole = score(from_raw_csv(spark.read.schema(", ".join(f"`{c}` string" for c in raw.columns))
                               .option("header", "true").csv(up)), a, frozen=True)
    assert _numbers(whole) == got[0][0]
    assert all((v[1] is None) == (v[0] == "Benign") for v in got[0][0].values())


def test_failed_run_leaves_nothing_half_and_is_made_up(spark, artifacts, monkeypatch):
    """A crash between results and log: neither is seen, the status says so,
    and a second attempt gives each once."""
    _, a = artifacts
    raw = adapters.raw_flows(spark, SF_SMALL).limit(60)
    up, base = scratch_path(spark, "t-up-fail"), scratch_path(spark, "t-runs-fail")
    raw.coalesce(1).write.option("header", "true").csv(up)
    from flowlens.operators import alerts as al
    good = al.alert_log_rows

    def broken(*args, **kw):
        raise ValueError("no alert today")
    monkeypatch.setattr(al, "alert_log_rows", broken)
    with pytest.raises(Exception, match="no alert today"):
        st.score_uploads(spark, up, raw.columns, a, base)
    runs = st.Uploads(spark, base)
    status = {r.step: r.status for r in st.latest_status(runs.status()).collect()}
    assert status == {"scoring": "completed", "fusion": "failed"}
    with pytest.raises(FileNotFoundError):
        runs.read("results")
    monkeypatch.setattr(al, "alert_log_rows", good)
    st.score_uploads(spark, up, raw.columns, a, base)
    status = {r.step: (r.status, r.attempt) for r in st.latest_status(runs.status()).collect()}
    assert status == {"scoring": ("completed", 2), "fusion": ("completed", 2)}
    assert runs.read("results").count() == 60
    attacks = runs.read("attack_log")
    assert attacks.count() == runs.read("alert_log").count() > 0
    assert attacks.count() == attacks.select("id").distinct().count()


def test_uploads_are_archived(spark, artifacts):
    """Files of finished batches leave the upload folder."""
    from flowlens.sources import io
    _, a = artifacts
    raw = adapters.raw_flows(spark, SF_SMALL).limit(40)
    up, done, base = (scratch_path(spark, f"t-{x}") for x in ("up-arch", "archive", "runs-arch"))
    raw.coalesce(1).write.option("header", "true").csv(up)
    st.score_uploads(spark, up, raw.columns, a, base, archive_dir=done)
    raw.coalesce(1).write.mode("append").option("header", "true").csv(up)
    runs = st.score_uploads(spark, up, raw.columns, a, base, archive_dir=done)
    assert runs.read("results").count() == 80 and runs.read("results").select("run_id").distinct().count() == 2
    assert len(io.glob_paths(spark, f"{up}/*.csv")) <= 1
