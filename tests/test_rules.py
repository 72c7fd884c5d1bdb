"""Nothing is cut off or swallowed: limits raise, keys stay, domains are whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import clean, iforest, models as md, select as sl
from flowlens.plans.score import from_raw_csv
from flowlens.sources import io
from flowlens.streaming.streams import finish


class Endless:
    name, stopped = "endless", False

    def awaitTermination(self, timeout=None):
        return False

    def stop(self):
        self.stopped = True


def test_stream_that_does_not_end_raises():
    q = Endless()
    with pytest.raises(TimeoutError):
        finish(q, 1)
    assert q.stopped


def test_protocols_whole_domain_and_no_more(spark):
    full = spark.range(256).select(F.col("id").cast("int").alias("protocol")).union(
        spark.range(1).select(F.lit(None).cast("int")))
    assert len(clean.fit_protocols(full)) == 256
    with pytest.raises(ValueError):
        clean.fit_protocols(spark.range(257).select(F.col("id").alias("protocol")))


def test_resample_reaches_every_part_of_a_class(spark):
    n = 1_200_000
    rows = spark.range(n).select(F.col("id").alias("flow_key"), F.lit("a").alias("label"))
    ranks = sl.equal_class_resample(rows, "label", "flow_key", 2000).select("rank").toPandas()["rank"]
    assert ranks.max() > 0.99 * n and ranks.min() < 0.01 * n
    assert np.histogram(ranks, bins=20, range=(0, n))[0].min() > 50


def test_unreadable_results_raise(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception):
        io.read_results_safe(spark, str(tmp_path / "bad"), spark.range(1).schema).collect()


def test_text_flow_ids_become_distinct_keys(spark):
    ids = ["10.0.0.1-10.0.0.2-80-4432-6", "10.0.0.1-10.0.0.2-81-4432-6", "77"]
    got = from_raw_csv(spark.createDataFrame([(i,) for i in ids], "`Flow ID` string")).collect()
    keys = {r.flow_id: r.flow_key for r in got}
    assert len(set(keys.values())) == 3 and None not in keys.values() and keys["77"] == 77


def test_reconstruction_is_centred(spark):
    """Rows on a line that misses the origin are rebuilt by one component."""
    rng = np.random.default_rng(1)
    x = np.array([50.0, -20.0, 7.0]) + np.outer(rng.normal(size=80), [1.0, 2.0, -1.0])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "features_arr array<double>").withColumn(
        "features", md.array_to_vector("features_arr"))
    out = md.reconstruct(md.train_reconstruction(df, 1), df).agg(F.max("recon_error")).first()[0]
    assert out < 1e-9


def test_isolation_score_of_a_small_sample(spark):
    """Normalised by the rows a tree was given: ordinary rows score near 0.5."""
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 3)))]
    df = spark.createDataFrame(rows, "row_id long, features_arr array<double>")
    got = iforest.score(df, iforest.fit(df, trees=50)).toPandas()["iso_score"]
    assert 0.4 < got.mean() < 0.56


def test_split_and_sample_are_exact_with_repeated_and_missing_keys(spark):
    """Neither a key that many rows share nor a missing one doubles or drops a row."""
    rows = [(7, "a", i) for i in range(300)] + [(None, "a", i) for i in range(50)] + \
           [(i, "b", i) for i in range(41)] + [(3, None, i) for i in range(10)]
    df = spark.createDataFrame(rows, "flow_key long, label string, n int")
    got = clean.stratified_split(df).groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in got} == {
        ("a", "test"): 70, ("a", "train"): 280, ("b", "test"): 8, ("b", "train"): 33, (None, "test"): 2, (None, "train"): 8}
    for n, want in ((0, 0), (120, 120), (349, 349), (350, 350), (1000, 350)):
        assert clean.downsample_benign(df, n, benign="a").count() == want


def test_split_shuffles_counts_only(spark):
    """The rows themselves are not joined back on their key."""
    df = spark.range(1000).select(F.col("id").alias("flow_key"), F.lit("a").alias("label"), F.lit("x" * 50).alias("wide"))
    plan = clean.stratified_split(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2                      # the boundary row per class, once for each side of the union
