"""The registered queries of the text operators, with production parameters.

``QUERIES`` maps a name to a ``(spark, sf_dir) -> DataFrame`` function over
the whole tables; ``ORACLE`` has the SQL of those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontam, html_extract, packing, paragraphs, quality, ranked, simhash, sketch, suffix_dedup, tokencount,
               toxicity, urls, variants)
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that models may learn from; the fifth that is left out measures
    them."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def vocabulary() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, training_labels(read(spark, sf_dir, "labels")))
    out = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", *toxicity.FEATURES)


@query
def op2_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), keep_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op3_quality_resampling(spark, sf_dir):
    out = quality.resample(read(spark, sf_dir, "documents"), training_labels(read(spark, sf_dir, "labels")))
    return out.withColumnRenamed("id", "doc_id")


@query
def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary()).withColumnRenamed("id", "doc_id")


@query
def op5_simhash_near_dedup(spark, sf_dir):
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, max_bits=3)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.col("component").alias("component_id"))


@query
def op6_benchmark_decontamination(spark, sf_dir):
    out = decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "coverage", "tiled_words",
                      "item_words", F.size("tiles").alias("n_tiles"))


#: Verdict, host and path of the URL rules.
URL_RULES = [urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"),
             urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/"),
             urls.Rule("block", "net", "/fr/")]


@query
def op7_url_filter(spark, sf_dir):
    return urls.judge(read(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


@query
def op8_paragraph_dedup(spark, sf_dir):
    return paragraphs.duplicates(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op9_document_fingerprints(spark, sf_dir):
    return sketch.compare_with_next(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op10_html_extraction(spark, sf_dir):
    out = html_extract.main_text(read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_ranked_search(spark, sf_dir):
    return ranked.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


ORACLE["op11_ranked_search"] = ranked.sql()


@query
def op12_spelling_variants(spark, sf_dir):
    return variants.group_variants(read(spark, sf_dir, "documents"))


@query
def op13_token_counts(spark, sf_dir):
    import public_tokenizers
    out = tokencount.count_tokens(read(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))
    return out.withColumnRenamed("id", "doc_id")


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
