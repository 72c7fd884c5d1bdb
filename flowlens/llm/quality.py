"""Quality selection by importance resampling.

Two bags of hashed word unigrams and bigrams are fitted: one on good
(target) text, one on the whole corpus (raw).  A document's log weight is the
sum of the log ratios of its n-grams; documents are drawn without replacement
in proportion to their weights by adding Gumbel noise and keeping the ``k``
largest keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import batch, columns, stage

#: Buckets of the hashed n-grams, and so the size of the model.
BUCKETS = 1 << 18
#: Labelled documents that are read for the target model and the cut at most;
#: corpus counts cover every document.
MAX_LABELLED = 20_000
#: Weight of the corpus model in the target model, in n-grams: a bucket whose
#: expected target count is far below it has a log ratio near zero.
PRIOR = 40.0
#: Scale of the Gumbel noise against the log weights.
TEMPERATURE = 0.25


def buckets(group: list[bytes], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every unigram and bigram, repeats included.
    A word that follows itself, or itself but one, adds one n-gram that is the
    same for all words, so that stuttering text is seen whatever it repeats."""
    t = tv.tokens([b.lower() for b in group], punctuation=True)
    pairs, at = tv.ngrams(t.hash, t.doc, 2)
    grams, docs = [t.hash, pairs], [t.doc, t.doc[at]]
    for gap in (1, 2):
        again = np.flatnonzero((t.hash[gap:] == t.hash[:-gap]) & (t.doc[gap:] == t.doc[:-gap]))
        grams.append(np.full(len(again), gap, np.uint64))
        docs.append(t.doc[again])
    return (np.concatenate(grams) % np.uint64(n_buckets)).astype(np.int64), np.concatenate(docs)


_COUNTS = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("good", pa.int64())])


def _count(n_buckets):
    def run(batches):
        raw, good = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
        for texts, target in columns(batches):
            for at, group in tv.chunks(texts):
                b, doc = buckets(group, n_buckets)
                raw += np.bincount(b, minlength=n_buckets)
                flag = np.array(target[at:at + len(group)], bool)
                if flag.any():
                    good += np.bincount(b[flag[doc]], minlength=n_buckets)
        seen = np.flatnonzero(raw)
        yield batch(_COUNTS, pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(good[seen]))
    return run


def labelled_sample(labels: DataFrame, column: str, limit: int = MAX_LABELLED, id_col: str = "doc_id") -> DataFrame:
    """At most ``limit`` labelled ids ``(id, y)`` in a fixed pseudo-random
    order; null ids and labels are left out."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("int").alias("y")).dropna()
    return lowest_hashes(known, ["id"], limit).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(limit)


def lowest_hashes(df: DataFrame, cols: list[str], limit: int) -> DataFrame:
    """The rows whose hash of ``cols`` is low enough that about 1.5 times
    ``limit`` remain, so that sorting out the lowest ``limit`` merges few rows
    however many partitions there are."""
    n = df.count()
    if n <= 2 * limit:
        return df
    return df.where(F.xxhash64(*cols) < int(1.5 * limit / n * (1 << 64)) - (1 << 63))


def fit(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        n_buckets: int = BUCKETS, prior: float = PRIOR) -> np.ndarray:
    """The log ratio of each bucket.  ``sample(id, y)`` is bounded; documents
    with ``y = 1`` in it are the target text."""
    good = F.broadcast(sample.where("y = 1").select(F.col("id").alias("_good")))
    flagged = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(
        good, F.col("_id") == F.col("_good"), "left").select("_text", F.col("_good").isNotNull().alias("_target"))
    table = flagged.mapInArrow(_count(n_buckets), "bucket int, raw long, good long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()       # at most n_buckets rows
    ratio = np.zeros(n_buckets)
    raw, hit = table["raw"].to_numpy(float), table["good"].to_numpy(float)
    if raw.sum() and hit.sum():
        expected = raw * (hit.sum() / raw.sum())
        ratio[table["bucket"].to_numpy()] = np.log((hit + prior) / (expected + prior))
    return ratio


_WEIGHT = pa.schema([("id", pa.int64()), ("log_weight", pa.float64()), ("n_grams", pa.int64())])


def log_weights(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, log_weight, n_grams)``; zero for null and empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)             # n_buckets doubles

    def run(batches):
        r = shared.value
        for ids, texts in columns(batches):
            total, grams = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            for at, group in tv.chunks(texts):
                b, doc = buckets(group, len(r))
                total[at:at + len(group)] = np.bincount(doc, r[b], len(group))
                grams[at:at + len(group)] = np.bincount(doc, minlength=len(group))
            yield batch(_WEIGHT, ids, pa.array(total), pa.array(grams))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, log_weight double, n_grams long")


def gumbel(id_col: str, seed: int):
    """Gumbel noise that depends on the id and the seed only."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def top_k(scored: DataFrame, k: int, key: str = "sample_key", tie: str = "id", small: int = 20_000) -> DataFrame:
    """Adds ``selected``: whether a row is among the ``k`` with the largest
    key, ties by the smaller id (null ids last), then arbitrary among equal
    rows; exactly ``k`` rows are (all, if there are fewer).  Keys are numbers,
    never null.

    The cut is found by repeatedly counting 1,024 slices of the interval that
    holds it, so no rows are sorted together but those of the last interval,
    at most ``small`` unless they share one key.
    """
    n, low, high = scored.agg(F.count("*"), F.min(key), F.max(key)).first()
    if k >= n or n == 0:
        return scored.withColumn("selected", F.lit(True))
    if k <= 0:
        return scored.withColumn("selected", F.lit(False))
    above = 0                                          # rows over the interval [low, high]
    while True:
        inside = scored.where(F.col(key).between(low, high))
        width = (high - low) / 1024
        if inside.count() <= small or width <= 0 or low + width == low:
            break
        cut = F.least(F.floor((F.col(key) - low) / width), F.lit(1023))
        slices = inside.groupBy(cut.alias("s")).agg(F.count("*").alias("c"), F.min(key).alias("a"),
                                                    F.max(key).alias("b")).orderBy(F.desc("s")).collect()
        for r in slices:
            if above + r.c >= k:
                low, high = r.a, r.b
                break
            above += r.c
    need = k - above
    if need > small and low == high:
        # Ties in one key can be many: they are cut by the id in the same way.
        rest = scored.where(F.col(key) != low).withColumn("selected", F.col(key) > low)
        equal = scored.where(F.col(key) == low)
        if key == "_tie":                              # one id: equal rows
            return rest.unionByName(_first(equal, need))
        named, nameless = equal.where(F.col(tie).isNotNull()), equal.where(F.col(tie).isNull())
        m = named.count()
        return rest.unionByName(top_k(named.withColumn("_tie", -F.col(tie).cast("double")), need, "_tie", tie, small).drop("_tie")
                                ).unionByName(_first(nameless, need - m))
    last, left = None, need
    for r in inside.groupBy(key, tie).count().orderBy(F.desc(key), F.asc_nulls_last(tie)).limit(need).collect():
        last, left = r, left - r["count"]
        if left <= 0:
            break
    here = (F.col(key) == last[key]) & F.col(tie).eqNullSafe(F.lit(last[tie]).cast(scored.schema[tie].dataType))
    before = F.col(tie).isNotNull() if last[tie] is None else F.coalesce(F.col(tie) < last[tie], F.lit(False))
    outside = scored.where(~here).withColumn("selected", (F.col(key) > last[key]) | ((F.col(key) == last[key]) & before))
    return outside.unionByName(_first(scored.where(here), left + last["count"]))


def _first(rows: DataFrame, k: int) -> DataFrame:
    """Marks ``k`` of some equal rows: each partition learns how many of its
    rows count, so they are neither sorted nor moved."""
    if k <= 0:
        return rows.withColumn("selected", F.lit(False))
    sizes = {r["p"]: r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    if k >= sum(sizes.values()):
        return rows.withColumn("selected", F.lit(True))
    quota = {}
    for p in sorted(sizes):
        quota[p] = min(sizes[p], k)
        k -= quota[p]
    out = rows.withColumn("_p", F.spark_partition_id())
    names = rows.columns

    def run(batches):
        left = None
        for b in batches:
            if not b.num_rows:
                continue
            if left is None:
                left = quota.get(b.column("_p")[0].as_py(), 0)
            mark = np.arange(b.num_rows) < left
            left -= int(mark.sum())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(mark)], [*names, "selected"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", selected boolean"
    return out.mapInArrow(run, schema)


def best_cut(weight: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best balanced accuracy; -inf if a class is missing."""
    if not len(y) or y.min() == y.max():
        return -np.inf
    order = np.argsort(weight, kind="stable")
    w, good = weight[order], y[order] == 1
    rejected_bad, kept_good = np.cumsum(~good) / (~good).sum(), 1 - np.cumsum(good) / good.sum()
    value = np.where(np.append(w[1:] > w[:-1], True), rejected_bad + kept_good, -1)
    i = int(value.argmax())
    if value[i] <= 1 or i + 1 == len(w):
        return -np.inf
    return float((w[i] + w[i + 1]) / 2)


def resample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", k: int | None = None,
             id_col: str = "doc_id", text_col: str = "text", n_buckets: int = BUCKETS,
             max_labelled: int = MAX_LABELLED, prior: float = PRIOR, temperature: float = TEMPERATURE,
             seed: int = 7) -> DataFrame:
    """``(id, log_weight, n_grams, sample_key, selected)`` per row of ``docs``.

    ``k`` is the size of the sample; by default the number of documents whose
    log weight exceeds the cut that best parts the labelled sample, so that
    the sample has the size of the good part.  A null or empty text has log
    weight zero.  Rows of one id have one noise value; a null id gets one as
    well and counts as a row.  Without good labels all ratios are zero and
    every document is kept.  Extra columns are ignored; an empty table gives
    an empty one.
    """
    sample = stage(labelled_sample(labels, label_col, max_labelled), "labelled")
    ratio = fit(docs, sample, id_col, text_col, n_buckets, prior)
    weights = log_weights(docs, ratio, id_col, text_col).withColumn(
        "sample_key", F.col("log_weight") + temperature * gumbel("id", seed))
    weights = stage(weights, "weights")
    if k is None:
        known = weights.join(F.broadcast(sample), "id").select("log_weight", "y").toPandas()    # max_labelled ids
        cut = best_cut(known["log_weight"].to_numpy(), known["y"].to_numpy())
        k = weights.where(F.col("log_weight") > cut).count() if np.isfinite(cut) else weights.count()
    return top_k(weights, k)
