"""Cleaning, projection and label handling.

Fitted steps follow one rule: ``fit_*(df) -> params DataFrame`` and
``apply(df, params)``; params are one row (or one row per label/feature)
and are broadcast back, so batch and stream share them.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.nulls import c, finite
from ..functions.rules import decode_protocol as _decode_protocol_expr


# ------------------------------------------------------------- names ----

def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case names, spaces -> underscores."""
    return df.toDF(*[n.replace(" ", "_").lower() for n in df.columns])


def rename_aliases(df: DataFrame, aliases: dict | None = None) -> DataFrame:
    """Apply the alias map to the columns that are present."""
    aliases = K.COLUMN_ALIASES if aliases is None else aliases
    present = {old: new for old, new in aliases.items() if old in df.columns and old != new}
    return df.withColumnsRenamed(present) if present else df


# ------------------------------------------------------------ labels ----

def clean_label_text(df: DataFrame, col: str = "label") -> DataFrame:
    """Text, trimmed, broken dash characters repaired."""
    x = F.trim(F.col(col).cast("string"))
    for ch in K.LABEL_DASH_CHARS:
        x = F.replace(x, F.lit(ch), F.lit("-"))
    return df.withColumn(col, x)


def _label_map() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(K.LABEL_GROUPS.items())])


def group_labels(df: DataFrame, col: str = "label", out: str | None = None) -> DataFrame:
    """Raw label -> label group; unknown labels -> NULL.

    The 15-entry mapping is a literal map expression: no join at all."""
    return df.withColumn(out or col, F.element_at(_label_map(), F.col(col)))


def unmapped_labels(df: DataFrame, col: str = "label") -> DataFrame:
    """Distinct labels that have no group."""
    return (df.select(F.col(col).alias("label"))
            .filter(F.element_at(_label_map(), F.col("label")).isNull())
            .distinct())


# ------------------------------------------------------------ numeric ----

def enforce_numeric(df: DataFrame, patterns: list[str] | None = None, skip: tuple = ("label",)) -> DataFrame:
    """Coerce columns whose name contains a pattern: bad text -> NULL,
    NaN / +-inf -> NULL."""
    patterns = K.NUMERIC_PATTERNS_SCORE if patterns is None else patterns
    return df.select([
        finite(c(n).try_cast("double")).alias(n)
        if n not in skip and any(p in n for p in patterns) else c(n)
        for n in df.columns])


def coerce_all_numeric(df: DataFrame, exclude: tuple = ("label", "label_encoded")) -> DataFrame:
    """Coerce every column except the excluded ones."""
    return df.select([c(n) if n in exclude else finite(c(n).try_cast("double")).alias(n) for n in df.columns])


def inf_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """+-Infinity and NaN -> NULL on the given (default: all double) columns."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.select([finite(c(n)).alias(n) if n in cols else c(n) for n in df.columns])


# ----------------------------------------------------------- protocol ----

def fit_protocols(df: DataFrame, col: str = "protocol") -> list[str]:
    """Distinct protocol values, nulls aside.  Protocol numbers go from 0 to
    255; a column with more values is no protocol column, and raises."""
    p = F.col(col).cast("string")
    vals = [r[0] for r in df.where(p.isNotNull()).select(p).distinct().limit(257).collect()]
    if len(vals) > 256:
        raise ValueError(f"column {col} has more than 256 distinct values")
    return sorted(vals)


def one_hot_protocol(df: DataFrame, values: list[str] | None = None, col: str = "protocol") -> DataFrame:
    """protocol -> ``proto_<value>`` 0/1 columns (values fitted once and stored)."""
    if col not in df.columns:
        return df
    values = fit_protocols(df, col) if values is None else values
    p = F.col(col).cast("string")
    onehot = [F.when(p == v, 1).otherwise(0).alias(f"proto_{v}") for v in values]
    return df.select([c(n) for n in df.columns if n != col] + onehot)


def decode_protocol(df: DataFrame, out: str = "protocol_name") -> DataFrame:
    """One-hot columns -> TCP / UDP / HOPOPT / UNKNOWN."""
    return df.withColumn(out, _decode_protocol_expr(df.columns))


# ------------------------------------------------------ audits, dedup ----

def null_audit(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null count per column plus a ``__total__`` row, one pass."""
    cols = cols or df.columns
    wide = df.agg(*[F.sum(F.isnull(c(n)).cast("long")).alias(n) for n in cols])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), c(n).alias("null_count"))
                                           for n in cols])).alias("s")).select("s.*")
    total = long.agg(F.lit("__total__").alias("column_name"), F.sum("null_count").alias("null_count"))
    return long.unionByName(total)


def drop_null_rows(df: DataFrame, enabled: bool = True, cols: list[str] | None = None) -> DataFrame:
    """Drop rows holding any missing value (a switch: off in the scorer)."""
    return df.na.drop("any", subset=cols) if enabled else df


def duplicate_count(df: DataFrame) -> DataFrame:
    """Number of exact repeat rows (NULLs compare equal).

    The group-by pre-aggregates map-side, so a hot group of copies collapses
    before the shuffle."""
    return (df.groupBy(*[c(n) for n in df.columns]).count()
            .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


# ------------------------------------------------------------ encoding ----

def fit_label_codes(df: DataFrame, col: str = "label") -> DataFrame:
    """Alphabetical integer code per distinct label (label, code).

    The window runs over the distinct labels only (a handful of rows)."""
    d = df.select(F.col(col).alias("label")).filter(F.col("label").isNotNull()).distinct()
    return d.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("code"))


def encode_labels(df: DataFrame, codes: DataFrame, col: str = "label", out: str = "label_encoded") -> DataFrame:
    """Join the code table (broadcast: one row per class)."""
    m = F.broadcast(codes.select(F.col("label").alias("__l"), F.col("code").alias(out)))
    return df.join(m, F.col(col) == F.col("__l"), "left").drop("__l")


def filter_rare_reencode(df: DataFrame, codes: DataFrame, col: str = "label",
                         drop: str = K.RARE_GROUP) -> tuple[DataFrame, DataFrame]:
    """Drop the Rare group and compact the codes: returns (rows, model code table
    with columns model_code, code, label)."""
    kept = codes.filter(F.col("label") != drop)
    model_codes = kept.select("label", "code",
                              (F.row_number().over(Window.orderBy("code")) - 1).cast("int").alias("model_code"))
    rows = df.filter(F.col(col) != drop).join(
        F.broadcast(model_codes.select(F.col("label").alias("__l"), "model_code")), F.col(col) == F.col("__l"),
        "inner").drop("__l")
    return rows, model_codes


def decode_predictions(df: DataFrame, model_codes: DataFrame, col: str = "predicted_code",
                       out: str = "predicted_label") -> DataFrame:
    """Model code -> original code -> label text."""
    m = F.broadcast(model_codes.select(F.col("model_code").alias("__m"), F.col("code").alias("original_code"),
                                       F.col("label").alias(out)))
    return df.join(m, F.col(col) == F.col("__m"), "left").drop("__m")


# ------------------------------------------------------------ sampling ----

def seeded_hash(key: Column, seed: int = K.SEED) -> Column:
    """Arithmetic hash of a unique key that SQL engines can repeat."""
    return ((key % 1000003) * 7919 + seed) % 1000003


def mark_lowest(df: DataFrame, part: str, key: str, quota: Callable[[Column], Column], out: str,
                seed: int = K.SEED) -> DataFrame:
    """Adds the boolean ``out``: the row is one of the ``quota(n)`` rows of its
    ``part`` (of ``n`` rows) with the smallest (seeded hash, key).

    The (part, hash) histogram, bounded by the hash domain, gives each part's
    boundary hash.  Rows beside it are settled by comparison where they are;
    only rows that share the boundary hash are shuffled and ranked.  Null keys
    come first; repeated keys are told apart by their rank, so counts are exact."""
    x = df.withColumn("__h", F.coalesce(seeded_hash(F.col(key), seed), F.lit(-1)))
    hist = x.groupBy(F.col(part).alias("__c"), "__h").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__c").orderBy("__h").rowsBetween(Window.unboundedPreceding, 0)
    hist = (hist.withColumn("__cum", F.sum("__n").over(w))
            .withColumn("__k", quota(F.sum("__n").over(Window.partitionBy("__c")))))
    bound = (hist.filter(F.col("__cum") >= F.col("__k"))
             .groupBy("__c").agg(F.min_by(F.struct("__h", "__cum", "__n", "__k"), "__h").alias("b"))
             .select("__c", F.col("b.__h").alias("__bh"),
                     (F.col("b.__k") - (F.col("b.__cum") - F.col("b.__n"))).alias("__need")))
    j = x.join(F.broadcast(bound), x[part].eqNullSafe(bound["__c"]), "left")
    sure = j.filter(F.col("__h") != F.col("__bh")).withColumn(out, F.col("__h") < F.col("__bh"))
    edge = j.filter(F.col("__h") == F.col("__bh")).withColumn(
        out, F.row_number().over(Window.partitionBy("__c", "__h").orderBy(key)) <= F.col("__need"))
    return sure.unionByName(edge).drop("__h", "__c", "__bh", "__need")


def downsample_benign(df: DataFrame, n: int = K.BENIGN_SAMPLE, key: str = "flow_key",
                      col: str = "label", benign: str = K.BENIGN, seed: int = K.SEED) -> DataFrame:
    """Exactly ``n`` benign rows (all, if there are fewer): the smallest
    (seeded hash, key).  No top-k merge, which would pull partitions x n rows
    into one task."""
    low = mark_lowest(df.filter(F.col(col) == benign), col, key, lambda tot: F.least(tot, F.lit(n)), "__low", seed)
    return low.filter("__low").drop("__low")


def balanced_union(df: DataFrame, n: int = K.BENIGN_SAMPLE, key: str = "flow_key",
                   col: str = "label", benign: str = K.BENIGN) -> DataFrame:
    """Sampled benign rows + every other row (row order carries no meaning)."""
    return downsample_benign(df, n, key, col, benign).unionByName(
        df.filter((F.col(col) != benign) | F.col(col).isNull()))


def class_distribution(df: DataFrame, col: str = "label") -> DataFrame:
    """Count and percent per class; the share uses a window over the grouped
    rows (one per class), never over the data."""
    g = df.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("label", "n", (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).alias("pct"))


def preview(df: DataFrame, n: int = 5, attacks_only: bool = False, col: str = "label") -> DataFrame:
    if attacks_only:
        df = df.filter(F.col(col) != K.BENIGN)
    return df.limit(n)


def stratified_split(df: DataFrame, key: str = "flow_key", col: str = "label",
                     test_share: float = K.TEST_SHARE, seed: int = K.SEED) -> DataFrame:
    """Exact seeded stratified split: per class the round(share * n) rows with
    the smallest (hash, key) go to test.  Hot classes are never gathered."""
    x = mark_lowest(df, col, key, lambda n: F.round(n * test_share).cast("long"), "__test", seed)
    return x.withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).drop("__test")


# ------------------------------------------------------- align, impute ----

def align_features(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """Required columns in stored order; missing ones become 0.0."""
    keep = keep or []
    have = set(df.columns)
    return df.select([c(k) for k in keep] +
                     [c(f).cast("double").alias(f) if f in have else F.lit(0.0).alias(f) for f in features])


def align_report(spark, df_columns: list[str], features: list[str]) -> DataFrame:
    """Which required features are present / missing (tiny, driver-built)."""
    rows = [(i, f, f in df_columns) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "position int, feature string, present boolean")


def fit_medians(df: DataFrame, features: list[str], exact: bool = True, accuracy: int = 100000) -> DataFrame:
    """One row of medians.

    ``exact`` gives the interpolated median of the reference; on large
    tables it brackets and band-selects instead of holding a column in one
    buffer (``operators.quantiles``).  ``exact=False`` uses the one-pass,
    bounded-memory ``percentile_approx``."""
    if exact:
        from .quantiles import quantile_row
        return quantile_row(df, features, 0.5)
    return df.agg(*[F.percentile_approx(c(f), 0.5, accuracy).cast("double").alias(f) for f in features])


def impute_median(df: DataFrame, medians: DataFrame, features: list[str]) -> DataFrame:
    m = F.broadcast(medians.select([c(f).alias(f"__m_{f}") for f in features]))
    j = df.crossJoin(m)
    return j.select([F.coalesce(c(n), F.col(f"`__m_{n}`")).alias(n) if n in features else c(n)
                     for n in df.columns])


def fit_scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean and population std per feature, one aggregation pass."""
    aggs = []
    for f in features:
        aggs += [F.avg(c(f)).alias(f"mean__{f}"), F.stddev_pop(c(f)).alias(f"std__{f}")]
    return df.agg(*aggs)


def standard_scale(df: DataFrame, scaler: DataFrame, features: list[str]) -> DataFrame:
    """(x - mean) / std with std 0 -> 1 (constant column -> 0)."""
    j = df.crossJoin(F.broadcast(scaler))
    out = []
    for n in df.columns:
        if n in features:
            sd = F.col(f"`std__{n}`")
            sd = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
            out.append(((c(n) - F.col(f"`mean__{n}`")) / sd).alias(n))
        else:
            out.append(c(n))
    return j.select(out)


def counts_to_int(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing -> 0, round half-even, integer."""
    return df.select([F.bround(F.coalesce(c(n), F.lit(0.0)), 0).cast("long").alias(n) if n in cols else c(n)
                      for n in df.columns])


# --------------------------------------------------------------- time ----

FLOW_TIME_FORMATS = ["dd/MM/yyyy hh:mm:ss a", "dd/MM/yyyy HH:mm:ss"]


def parse_flow_time(x: Column) -> Column:
    """Flow-meter text (12 h AM/PM or 24 h, day first) -> timestamp; bad -> NULL."""
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in FLOW_TIME_FORMATS])


def parse_detect_time(x: Column) -> Column:
    """Epoch seconds, else ISO text, else now."""
    secs = x.cast("string").try_cast("double")
    epoch = F.when(secs.isNotNull(), F.timestamp_micros((secs * 1e6).cast("long")))
    return F.coalesce(epoch, F.try_to_timestamp(x.cast("string")), F.current_timestamp())
