"""Feature selection.

Constants, gaps, correlations and class moments come from one pass over the
training rows (``moments``); the ranking runs over one row per feature.
Forest-based rankings use MLlib.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.nulls import c
from .clean import seeded_hash


def _finite(x):
    # NaN compares greater than every number in Spark: map it to NULL first
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


# ------------------------------------------------------------- moments ----

@dataclass
class Moments:
    """Sums of a table's features less ``centre``: by pair of features over the
    rows that have both (``pairs``: n, a, b, ab, aa, bb, each d x d, upper
    half), and by class (``rows``, and n, sum, squares: classes x d); smallest
    and largest value of each feature."""
    features: list[str]
    centre: np.ndarray
    pairs: dict[str, np.ndarray]
    labels: list
    rows: np.ndarray
    n: np.ndarray
    total: np.ndarray
    squares: np.ndarray
    low: np.ndarray
    high: np.ndarray


_SUMS = pa.schema([("kind", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("label", pa.string()), ("n", pa.float64()),
                   *((x, pa.float64()) for x in ("sa", "sb", "sab", "saa", "sbb", "lo", "hi"))])


def _sums(centre: np.ndarray):
    """Per task: rows of kind 0 for pairs i < j, of kind 1 for (class, feature)
    and of kind 2 for classes."""
    d = len(centre)
    iu, ju = np.triu_indices(d, k=1)

    def run(batches):
        n, s, sab, sq = (np.zeros((d, d)) for _ in range(4))
        by: dict = {}
        lo, hi = np.full(d, np.inf), np.full(d, -np.inf)
        for b in batches:
            if not b.num_rows:
                continue
            X = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(1, d + 1)]) - centre
            M = ~np.isnan(X)
            X0 = np.where(M, X, 0.0)
            m = M.astype("float64")
            n += m.T @ m
            s += X0.T @ m                                  # s[i, j]: sum of x_i where both are present
            sab += X0.T @ X0
            sq += (X0 * X0).T @ m
            lo = np.minimum(lo, np.where(M, X, np.inf).min(axis=0))
            hi = np.maximum(hi, np.where(M, X, -np.inf).max(axis=0))
            code = b.column(0).dictionary_encode()
            at = code.indices.to_numpy(zero_copy_only=False)
            for k, label in enumerate(code.dictionary.to_pylist()):
                rows = at == k
                part = by.setdefault(label, [0.0, np.zeros(d), np.zeros(d), np.zeros(d)])
                part[0] += rows.sum()
                part[1] += m[rows].sum(axis=0)
                part[2] += X0[rows].sum(axis=0)
                part[3] += (X0[rows] ** 2).sum(axis=0)
        ends = [np.where(np.isfinite(x), x, np.nan) for x in (lo, hi)]
        z = lambda k: np.zeros(k)
        cols = [[np.zeros(len(iu)), iu, ju, [None] * len(iu), n[iu, ju], s[iu, ju], s[ju, iu], sab[iu, ju], sq[iu, ju], sq[ju, iu],
                 np.full(len(iu), np.nan), np.full(len(iu), np.nan)]]
        for label, (rows, k, total, squares) in by.items():
            cols.append([np.full(d, 1), np.arange(d), z(d), [label] * d, k, total, z(d), z(d), squares, z(d), *ends])
            cols.append([[2], [0], [0], [label], [rows], *([0.0] for _ in range(5)), [np.nan], [np.nan]])
        for part in cols:
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, f.type.to_pandas_dtype()) if f.name != "label" else x, f.type,
                                                       from_pandas=True) for x, f in zip(part, _SUMS)], schema=_SUMS)
    return run


def moments(df: DataFrame, features: list[str], label: str | None = None) -> Moments:
    """One pass over ``df`` (write it first if it is dear to compute).  Sums
    are taken of the values less the mean of the first rows, so that large
    values do not cancel; a task hands on d^2 / 2 pairs and classes x d sums,
    and the driver receives as many."""
    d = len(features)
    lab = F.col(label).cast("string") if label else F.lit("")
    x = df.select(lab.alias("label"), *[_finite(c(f).cast("double")).alias(f"x{k}") for k, f in enumerate(features)])
    first = x.limit(1000).agg(*[F.coalesce(F.avg(f"x{k}"), F.lit(0.0)).alias(f"x{k}") for k in range(d)], F.lit(0).alias("_")).first()
    centre = np.array([float(v) for v in first[:d]])
    sums = ("n", "sa", "sb", "sab", "saa", "sbb")
    got = x.mapInArrow(_sums(centre), "kind int, i int, j int, label string, n double, sa double, sb double, sab double, "
                       "saa double, sbb double, lo double, hi double").groupBy("kind", "i", "j", "label").agg(
        *[F.sum(v).alias(v) for v in sums], F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    pairs = {v: np.zeros((d, d)) for v in sums}
    labels = sorted((r["label"] for r in got if r["kind"] == 2 and r["label"] is not None), key=str)
    labels += [None] * any(r["kind"] == 2 and r["label"] is None for r in got)
    place = {v: k for k, v in enumerate(labels)}
    m = Moments(features, centre, pairs, labels, np.zeros(len(labels)), *(np.zeros((len(labels), d)) for _ in range(3)),
                np.full(d, np.nan), np.full(d, np.nan))
    for r in got:
        if r["kind"] == 0:
            for v in sums:
                pairs[v][r["i"], r["j"]] = r[v]
        elif r["kind"] == 2:
            m.rows[place[r["label"]]] = r["n"]
        else:
            k, i = place[r["label"]], r["i"]
            m.n[k, i], m.total[k, i], m.squares[k, i] = r["n"], r["sa"], r["saa"]
            m.low[i], m.high[i] = (float(fn([v, w])) if w is not None else v for v, w, fn in
                                   ((m.low[i], r["lo"], np.nanmin), (m.high[i], r["hi"], np.nanmax)))
    return m


def constants(m: Moments) -> list[str]:
    """Features with at most one distinct value (or none)."""
    return [f for f, a, b in zip(m.features, m.low, m.high) if not a < b]


def gaps(m: Moments) -> list[str]:
    """Features that some row lacks."""
    return [f for f, n in zip(m.features, m.n.sum(axis=0)) if n < m.rows.sum()]


# --------------------------------------------------------- correlation ----

def correlations(m: Moments) -> np.ndarray:
    """|Pearson r| for every pair i < j over the rows where both are present;
    NaN where either does not vary (never "correlated")."""
    p = m.pairs
    cov = p["n"] * p["sab"] - p["sa"] * p["sb"]
    va, vb = p["n"] * p["saa"] - p["sa"] ** 2, p["n"] * p["sbb"] - p["sb"] ** 2
    # rounding leaves about 1e-16 of the raw moment: less than that is no variance
    ok = (va > 1e-13 * p["n"] * p["saa"]) & (vb > 1e-13 * p["n"] * p["sbb"])
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(ok, np.abs(cov / np.sqrt(va * vb)), np.nan)


def corr_pairs(df: DataFrame, features: list[str], m: Moments | None = None) -> DataFrame:
    """``(i, j, r)`` of ``correlations``; no variance gives NULL."""
    r = correlations(m or moments(df, features))
    rows = [(i, j, None if np.isnan(r[i, j]) else float(r[i, j])) for i in range(len(features)) for j in range(i + 1, len(features))]
    return df.sparkSession.createDataFrame(rows, "i int, j int, r double")


def corr_prune(df: DataFrame, features: list[str], limit: float = K.CORR_LIMIT, m: Moments | None = None) -> DataFrame:
    """Drop feature j when any earlier feature i < j has |r| > limit (i counts
    even if dropped itself).  Rows: (feature, position, dropped)."""
    r = correlations(m or moments(df, features))
    rows = [(f, j, bool(np.any(np.nan_to_num(r[:j, j]) > limit))) for j, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, position int, dropped boolean")


def constant_prune(df: DataFrame, features: list[str]) -> DataFrame:
    """Columns with at most one distinct value (min = max, or all missing)."""
    wide = df.agg(*[x for f in features for x in (F.min(c(f)).alias(f"mn_{features.index(f)}"),
                                                   F.max(c(f)).alias(f"mx_{features.index(f)}"))])
    rows = [F.struct(F.lit(f).alias("feature"), F.lit(i).alias("position"),
                     F.coalesce(F.col(f"mn_{i}") == F.col(f"mx_{i}"), F.lit(True)).alias("constant"))
            for i, f in enumerate(features)]
    return wide.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


# -------------------------------------------------------------- ANOVA ----

def anova_scores(df: DataFrame, features: list[str], label: str = "label", m: Moments | None = None,
                 medians: dict[str, float] | None = None) -> DataFrame:
    """One-way ANOVA F per feature from class counts, sums and squares.  With
    ``medians`` the rows that lack a feature count as having its median: their
    number per class is known, so no imputed table is written."""
    m = m or moments(df, features, label)
    rows = []
    for f in features:
        i = m.features.index(f)
        n, total, squares = m.n[:, i].copy(), m.total[:, i].copy(), m.squares[:, i].copy()
        if medians and medians.get(f) is not None:
            lack, v = m.rows - n, medians[f] - m.centre[i]
            n, total, squares = n + lack, total + lack * v, squares + lack * v * v
        n, total, squares = n[n > 0], total[n > 0], squares[n > 0]
        score = None
        k, count = len(n), n.sum()
        if k > 1 and count > k:
            within = float(np.maximum(squares - total ** 2 / n, 0).sum())
            between = float((n * (total / n - total.sum() / count) ** 2).sum())
            score = float((between / (k - 1)) / (within / (count - k))) if within > 0 else None
        rows.append((f, score))
    return df.sparkSession.createDataFrame(rows, "feature string, score double")


def top_k(scores: DataFrame, k: int = K.TOP_K, score: str = "score", digits: int | None = None) -> DataFrame:
    """Rank features by score (descending, ties by name); keep the top k.
    With ``digits`` the score is rounded first, so equal-looking scores tie
    and fall back to the name.  The window runs over one row per feature."""
    if digits is not None:
        scores = scores.withColumn(score, F.round(F.col(score), digits))
    w = Window.orderBy(F.col(score).desc_nulls_last(), F.col("feature"))
    r = scores.withColumn("rank", F.row_number().over(w))
    return r.withColumn("selected", F.col("rank") <= k)


# ----------------------------------------------------- mutual information ----

_JOINT = pa.schema([("feature", pa.int32()), ("bin", pa.int32()), ("label", pa.string()), ("n", pa.int64())])


def mi_scores(df: DataFrame, features: list[str], label: str = "label", bins: int = 10) -> DataFrame:
    """Mutual information (nats) between quantile bins of each feature and the
    label: sum p(x,y) ln(p(x,y) / (p(x) p(y))).  A value's bin is the number of
    quantiles (k / bins) below it, so bins hold equal shares however skewed
    the values are.  Each task counts (feature, bin, class) of its rows."""
    from .quantiles import exact_quantiles_multi
    if not features:
        return df.sparkSession.createDataFrame([], "feature string, score double")
    edges = [np.array([v for v in q if v is not None]) for q in
             exact_quantiles_multi(df, features, [k / bins for k in range(1, bins)])]

    def run(batches):
        counts: dict = {}
        for b in batches:
            code = b.column(0).dictionary_encode()
            at, labels = code.indices.to_numpy(zero_copy_only=False), code.dictionary.to_pylist()
            for k, e in enumerate(edges):
                v = b.column(k + 1).to_numpy(zero_copy_only=False)
                ok = ~np.isnan(v)
                joint = np.bincount(at[ok] * bins + np.searchsorted(e, v[ok], side="left"), minlength=len(labels) * bins)
                for x in np.flatnonzero(joint).tolist():
                    key = (k, x % bins, labels[x // bins])
                    counts[key] = counts.get(key, 0) + int(joint[x])
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(
                (*zip(*counts), counts.values()), _JOINT)], schema=_JOINT)
    x = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), *[_finite(c(f).cast("double")).alias(f"x{k}") for k, f in enumerate(features)])
    joint = x.mapInArrow(run, "feature int, bin int, label string, n long").groupBy("feature", "bin", "label").agg(F.sum("n").alias("nxy"))
    wx = Window.partitionBy("feature", "bin")
    wy = Window.partitionBy("feature", "label")
    wn = Window.partitionBy("feature")
    j = joint.select("feature", "nxy", F.sum("nxy").over(wx).alias("nx"), F.sum("nxy").over(wy).alias("ny"),
                     F.sum("nxy").over(wn).alias("n"))
    term = (F.col("nxy") / F.col("n")) * F.log((F.col("nxy") * F.col("n")) / (F.col("nx") * F.col("ny")))
    names = df.sparkSession.createDataFrame(list(enumerate(features)), "feature int, name string")
    return j.groupBy("feature").agg(F.sum(term).alias("score")).join(F.broadcast(names), "feature").select(
        F.col("name").alias("feature"), "score")


# ------------------------------------------------------------- forests ----

#: Depth of the ranking forests: MLlib's largest, for trees that are not cut.
DEPTH = 30
#: Rows up to which MLlib grows them; ``forest`` grows those of larger tables.
SMALL = 16_384


def rf_importance(df: DataFrame, features: list[str], label: str = "label", trees: int = 200,
                  seed: int = K.SEED, depth: int = DEPTH) -> DataFrame:
    """Random-forest feature importance per feature: MLlib's forest, or for
    more than ``SMALL`` rows that of ``forest``."""
    from pyspark.ml.classification import RandomForestClassifier
    from . import forest
    from .models import assemble
    x = assemble(df, features)
    if df.count() > SMALL:
        imp = forest.importances(x, "features", label, trees, depth, seed).tolist()
    else:
        m = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(x)
        imp = m.featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, imp)],
                                           "feature string, score double")


# --------------------------------------------------------- resampling ----

def rank_within(df: DataFrame, part: str, key: str, seed: int = K.SEED) -> DataFrame:
    """Exact 0-based rank of each row inside ``part`` ordered by (seeded hash,
    key), plus the part size ``n``.

    No window ever holds a whole part: ranks come from the (part, hash)
    histogram, bounded by the hash domain, plus a rank among the few rows
    that share one hash value."""
    x = df.withColumn("__h", seeded_hash(F.col(key), seed))
    hist = x.groupBy(part, "__h").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(part).orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(part, "__h", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"),
                       F.sum("__n").over(Window.partitionBy(part)).alias("n"))
    inner = Window.partitionBy(part, "__h").orderBy(key)
    y = x.withColumn("__r", F.row_number().over(inner) - 1)
    return y.join(hist, [part, "__h"]).withColumn("rank", F.col("__off") + F.col("__r")).drop(
        "__h", "__off", "__r")


def equal_class_resample(df: DataFrame, label: str = "label", key: str = "flow_key", total: int = 100000,
                         seed: int = K.SEED) -> DataFrame:
    """With-replacement sample of ``total // classes`` rows per class.

    Slot s of class c draws the row at the share (s * 2654435761 + seed) mod
    2**32 of 2**32 of its n_c rows (n_c below 2**31), so any row can be drawn, of
    the class's hash order.  The (class, hash) histogram says which hash value
    holds each slot's row; rows of other hash values stay where they are, so
    what is ranked and shuffled is bounded by the slots (``total``) times the
    rows of one hash value."""
    x = df.filter(F.col(label).isNotNull()).withColumn("__h", seeded_hash(F.col(key), seed))
    hist = x.groupBy(F.col(label).alias("__c"), "__h").agg(F.count(F.lit(1)).alias("__n")).checkpoint()
    w = Window.partitionBy("__c").orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    first = hist.select("__c", "__h", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("pos"))
    sizes = hist.groupBy("__c").agg(F.sum("__n").alias("n"))
    k = sizes.agg(F.count(F.lit(1)).alias("k"))
    slots = sizes.crossJoin(F.broadcast(k)).select("__c", "n", F.explode(F.sequence(F.lit(0), (F.lit(total) / F.col("k"))
                                                                                   .cast("int") - 1)).alias("slot"))
    slots = slots.select("__c", "slot", F.shiftright(((F.col("slot") * 2654435761 + seed) % 4294967296) * F.col("n"), 32).alias("pos"))
    # A slot's hash value is the last one that begins at or before its place.
    at = Window.partitionBy("__c").orderBy("pos", F.col("slot").isNotNull(), "slot").rowsBetween(Window.unboundedPreceding, 0)
    both = first.select("__c", "pos", F.lit(None).cast("int").alias("slot"), "__h").unionByName(
        slots.select("__c", "pos", "slot", F.lit(None).cast("long").alias("__h")))
    picks = both.select("__c", "slot", F.col("pos").alias("rank"), F.last("__h", True).over(at).alias("__ph"),
                        (F.col("pos") - F.last(F.when(F.col("__h").isNotNull(), F.col("pos")), True).over(at)).alias("__r")
                        ).where("slot is not null").checkpoint()
    wanted = picks.select("__c", "__ph").distinct()                                  # at most `total` rows
    near = x.join(F.broadcast(wanted), (x[label] == wanted["__c"]) & (x["__h"] == wanted["__ph"])).drop("__c", "__ph")
    ranked = near.withColumn("__i", F.row_number().over(Window.partitionBy(label, "__h").orderBy(key)) - 1)
    p = F.broadcast(picks)                                                           # at most `total` rows
    return ranked.join(p, (ranked[label] == p["__c"]) & (ranked["__h"] == p["__ph"]) & (ranked["__i"] == p["__r"])).drop(
        "__c", "__ph", "__r", "__i", "__h")


# -------------------------------------------------------------- Boruta ----

def _binom_sf(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k) for X ~ Binomial(n, p) (tiny n, on the driver)."""
    return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k, n + 1))


def boruta_select(df: DataFrame, features: list[str], label: str = "label", key: str = "flow_key",
                  rounds: int = 20, trees: int = 100, alpha: float = 0.05, seed: int = K.SEED,
                  parallel_rounds: int = 4, depth: int = DEPTH) -> DataFrame:
    """All-relevant selection with shadow features.

    Rows get one exact seeded rank (histogram ranks, no single-task window).
    Round r pairs row k with row (a_r * k + b_r) mod n — a permutation, as
    gcd(a_r, n) = 1 — and takes that row's values as shadow features (one
    equi-join per round); a forest on real + shadow features records a hit
    for every real feature beating the best shadow.  More than
    ``SMALL`` rows are binned and broadcast, as long as they fit
    (``forest.shadow_hits``).  A two-sided binomial
    test over the rounds (Bonferroni over features) confirms or rejects; it
    runs on the driver over one count per feature."""
    from pyspark.ml.classification import RandomForestClassifier
    from . import forest
    from .models import assemble
    base = df.select(key, label, *[c(f).alias(f"f{i}") for i, f in enumerate(features)])
    ranked = rank_within(base.withColumn("__all", F.lit(1)), "__all", key, seed).drop("__all", "n")
    ranked = ranked.checkpoint()                      # reused by every round
    n = ranked.count()
    names = [f"f{i}" for i in range(len(features))]
    shadows = [f"sh{i}" for i in range(len(features))]
    pairs = []
    for r in range(rounds):
        a = 7919 + 104729 * r
        while math.gcd(a, n) != 1:
            a += 1
        pairs.append((a, (seed * 31 + r * 2654435761) % max(n, 1), seed + r))

    def one_round(r: int) -> list[int]:
        a, b, _ = pairs[r]
        src = ranked.select(((F.col("rank") * a + b) % n).alias("rank"),
                            *[F.col(x).alias(y) for x, y in zip(names, shadows)])
        x = ranked.join(src, "rank").select(label, *names, *shadows)
        m = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth,
                                   seed=seed + r).fit(assemble(x, names + shadows))
        imp = m.featureImportances.toArray()
        best_shadow = max(imp[len(features):]) if len(imp) > len(features) else 0.0
        return [int(imp[i] > best_shadow) for i in range(len(features))]

    # rounds are independent: submit their jobs from a few driver threads so
    # the cluster is not idle between the small stages of one forest
    from concurrent.futures import ThreadPoolExecutor
    per_round = forest.shadow_hits(ranked, names, label, pairs, trees, depth) if n > SMALL else None
    if per_round is None:
        with ThreadPoolExecutor(max_workers=parallel_rounds) as pool:
            per_round = list(pool.map(one_round, range(rounds)))
    hits = [sum(col) for col in zip(*per_round)]
    a = alpha / max(len(features), 1)
    rows = []
    for f, h in zip(features, hits):
        p_acc = _binom_sf(h, rounds)
        p_rej = _binom_sf(rounds - h, rounds)
        status = "confirmed" if p_acc < a else ("rejected" if p_rej < a else "tentative")
        rows.append((f, h, status, status == "confirmed"))
    return df.sparkSession.createDataFrame(rows, "feature string, hits int, status string, selected boolean")


# ------------------------------------------------------------ union ----

def select_features(rankings: DataFrame, exclude: list[str] = K.NON_REALTIME_FEATURES,
                    force: list[str] = K.MANDATORY_FEATURES) -> DataFrame:
    """Ordered de-duplicated union of ranked lists, minus excluded features,
    plus forced ones.  ``rankings``: (method, method_order, feature, rank,
    selected).  Output: (feature, position)."""
    sel = rankings.filter(F.col("selected")).select(
        "feature", (F.col("method_order") * 100000 + F.col("rank")).alias("o"))
    first = sel.groupBy("feature").agg(F.min("o").alias("o"))
    spark = rankings.sparkSession
    ex = spark.createDataFrame([(f,) for f in exclude], "feature string")
    kept = first.join(F.broadcast(ex), "feature", "left_anti")
    fo = spark.createDataFrame([(f, 10 ** 9 + i) for i, f in enumerate(force)], "feature string, o long")
    allf = kept.unionByName(fo.join(kept.select("feature"), "feature", "left_anti"))
    w = Window.orderBy("o", "feature")
    return allf.select("feature", (F.row_number().over(w) - 1).alias("position"))


@dataclass
class Selection:
    """A selection job's outcome: what was pruned, the rankings ``(method,
    method_order, feature, rank, selected)``, and the features in order."""
    constant: list[str]
    correlated: list[str]
    rankings: DataFrame
    features: list[str]


def run_selection(train: DataFrame, candidates: list[str], top: int = K.TOP_K, key: str = "flow_key", label: str = "label",
                  trees: int = 200, rounds: int = 20, boruta_trees: int = 100, depth: int = DEPTH,
                  methods: tuple[str, ...] = ("anova", "mi", "forest", "boruta")) -> Selection:
    """The whole job on the rows of a training split (write them first: they
    are read by every step): constants go, then features that correlate with
    an earlier one; the rest are ranked four ways on median-imputed values,
    and the rankings' top lists are united in order.  Every ranking covers all
    rows."""
    from .clean import encode_labels, fit_label_codes, fit_medians, impute_median
    spark = train.sparkSession
    m = moments(train, candidates, label)
    constant = constants(m)
    r = correlations(m)
    alive = [i for i, f in enumerate(candidates) if f not in constant]
    correlated = [candidates[j] for j in alive if any(np.nan_to_num(r[i, j]) > K.CORR_LIMIT for i in alive if i < j)]
    feats = [candidates[i] for i in alive if candidates[i] not in correlated]
    lack = [f for f in gaps(m) if f in feats]
    medians = fit_medians(train, lack) if lack else None
    x = train.select(key, label, *[c(f).cast("double").alias(f) for f in feats])
    x = impute_median(x, medians, lack) if lack else x
    values = medians.first().asDict() if lack else {}
    ranks = []
    if "anova" in methods:
        ranks.append(("anova", top_k(anova_scores(train, feats, label, m, values), top, digits=4)))
    if "mi" in methods:
        ranks.append(("mi", top_k(mi_scores(x, feats, label), top, digits=9)))
    if "forest" in methods or "boruta" in methods:
        y = encode_labels(x, fit_label_codes(x, label), label, "y").checkpoint()
    if "forest" in methods:
        ranks.append(("forest", top_k(rf_importance(y, feats, "y", trees, depth=depth), top)))
    if "boruta" in methods:
        b = boruta_select(y, feats, "y", key, rounds, boruta_trees, depth=depth)
        w = Window.orderBy(F.col("hits").desc(), F.col("feature"))
        ranks.append(("boruta", b.select("feature", F.col("hits").cast("double").alias("score"), F.row_number().over(w).alias("rank"), "selected")))
    order = {"anova": 0, "mi": 1, "forest": 2, "boruta": 3}
    rows = [(n, order[n], q["feature"], q["rank"], bool(q["selected"])) for n, t in ranks
            for q in t.select("feature", "rank", "selected").collect()]               # methods x features rows
    rankings = spark.createDataFrame(rows, "method string, method_order int, feature string, rank int, selected boolean")
    chosen = [q["feature"] for q in select_features(rankings).orderBy("position").collect()]
    return Selection(constant, correlated, rankings, chosen)
