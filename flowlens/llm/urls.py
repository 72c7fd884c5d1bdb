"""URL filtering: host and path rules, then boosted trees on lexical features.

Rules decide what they fit.  The other URLs are judged by gradient-boosted
trees that learn from the URLs the rules have labelled, on features of the
URL's text alone: lengths, depth, digit ratio, entropy, parameters, and what
the table shows of the host's suffixes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, with_small
from .quality import lowest_hashes

#: Labelled URLs that the trees learn from at most, in a fixed pseudo-random
#: order; suffix statistics cover all rows.
MAX_LABELLED = 20_000
TREES = 20
DEPTH = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str                                        # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> dict[str, Column]:
    """Host, path and query of a URL; all empty for a null URL or one without
    ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    tail = rest.substr(F.length(raw) + 1, F.length(rest))
    path = F.regexp_extract(tail, r"\A[^?#]*", 0)
    return {"host": F.translate(raw, _UPPER, _LOWER), "path": path,
            "query": F.regexp_extract(tail, r"\A[^?#]*\?([^#]*)", 1)}


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The number of the longest rule (host and path together, then the host)
    whose host is the URL's or a parent of it and whose path begins the URL's;
    null if none fits."""
    out = None
    for k, r in sorted(enumerate(rules), key=lambda kr: (-len(kr[1].name), -len(kr[1].host), kr[1].name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, k) if out is None else out.when(fits, k)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _entropy(text: Column) -> Column:
    """Bits per character of the characters' distribution."""
    signs = F.split(text, "")
    shares = F.transform(F.array_distinct(signs), lambda c: F.size(F.filter(signs, lambda x: x == c)) / F.size(signs))
    return F.when(F.length(text) > 0, -F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0)


FEATURES = ["n_url", "n_host", "n_path", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy",
            "host_entropy", "parameters", "n_query", "longest_word", "other_ratio", "suffix_size", "suffix_block",
            "domain_size", "domain_block", "folder_block"]


def lexical(df: DataFrame) -> DataFrame:
    """Adds the lexical features; needs ``url``, ``host``, ``path`` and
    ``query``."""
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    label = F.split("host", r"\.")
    words = F.transform(F.split(url, "[^A-Za-z]+"), F.length)
    return df.withColumns({
        "n_url": F.length(url), "n_host": F.length("host"), "n_path": F.length("path"),
        "depth": _count(F.col("path"), "/"), "labels": F.size(label),
        "digit_ratio": _count(url, "[0-9]") / size, "host_digits": _count(F.col("host"), "[0-9]"),
        "hyphens": _count(F.col("host"), "-"), "entropy": _entropy(url), "host_entropy": _entropy(F.col("host")),
        "parameters": F.when(F.length("query") > 0, _count(F.col("query"), "&") + 1).otherwise(0),
        "n_query": F.length("query"), "longest_word": F.array_max(words),
        "other_ratio": _count(url, "[^A-Za-z0-9]") / size,
        "suffix": F.element_at(label, -1),
        "domain": F.array_join(F.slice(label, F.greatest(F.size(label) - 1, F.lit(1)), 2), "."),
        "folder": F.substring_index(F.substring_index("path", "/", 2), "/", -1),
    })


def _suffix_statistics(df: DataFrame, key: str, size: str | None, share: str) -> DataFrame:
    """Joins the number of URLs with ``key`` and the smoothed share of blocked
    ones among those that rules have labelled."""
    stats = df.groupBy(key).agg(F.count("*").alias("_n"), F.count("label").alias("_k"), F.sum("label").alias("_b")).select(
        key, *([F.log1p("_n").alias(size)] if size else []),
        ((F.coalesce("_b", F.lit(0)) + 1) / (F.col("_k") + 2)).alias(share))
    return with_small(df, stage(stats, "suffix"), key, "left", row_bytes=160)


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", trees: int = TREES,
          depth: int = DEPTH, max_labelled: int = MAX_LABELLED, seed: int = 5) -> DataFrame:
    """``(id, host, path, rule, verdict, score)`` per row: the rule's verdict,
    or else ``block`` if the trees' probability of it is at least one half.

    ``rule`` is the fitting rule's host and path, null if none; ``score`` is
    that probability for every row.  A URL that is null or has no ``://`` has
    an empty host and path and is left to the trees.  If the rules have
    labelled URLs of one kind only, the trees cannot be trained and the other
    URLs get that verdict, or ``allow`` if there are none.  Repeated rows get
    equal results; null ids are kept; extra columns are ignored; an empty
    table gives an empty one.
    """
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    base = base.withColumns(parts(F.col("url")))
    blocked = F.array(*(F.lit(1.0 if r.verdict == "block" else 0.0) for r in rules)) if rules else F.array(F.lit(0.0))
    ruled = base.withColumn("fit", best_rule(F.col("host"), F.col("path"), rules))
    ruled = ruled.withColumn("label", F.when(F.col("fit").isNotNull(), F.get(blocked, F.col("fit"))))
    table = lexical(ruled)
    for key, size, share in (("suffix", "suffix_size", "suffix_block"), ("domain", "domain_size", "domain_block"),
                             ("folder", None, "folder_block")):
        table = _suffix_statistics(table, key, size, share)
    table = stage(table.withColumns({c: F.col(c).cast("double") for c in FEATURES}).select(
        "id", "host", "path", "fit", "label", "url", *FEATURES), "features")
    known = stage(lowest_hashes(table.where("label is not null"), ["url", "id"], max_labelled).orderBy(
        F.xxhash64("url", "id"), "id").limit(max_labelled), "labelled")
    kinds = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(kinds) == 2:
        # Both kinds weigh the same, whatever the rules' share of each.
        total = sum(kinds.values())
        weight = F.when(F.col("label") == 1, total / 2 / kinds[1.0]).otherwise(total / 2 / kinds[0.0])
        vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
        model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.2,
                              subsamplingRate=1.0, seed=seed, maxBins=32).fit(
            vector.transform(known.withColumn("weight", weight)))
        scored = model.transform(vector.transform(table)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = table.withColumn("score", F.lit(float(1.0 in kinds)))
    names = F.array(*(F.lit(r.name) for r in rules)) if rules else F.array(F.lit(""))
    verdict = F.when(F.coalesce("label", F.col("score")) >= 0.5, "block").otherwise("allow")
    return scored.select("id", "host", "path", F.get(names, F.col("fit")).alias("rule"), verdict.alias("verdict"), "score")
