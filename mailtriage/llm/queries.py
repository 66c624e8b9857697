"""The registered queries of the operators: ``(spark, sf_dir) -> DataFrame``, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailtriage.llm import (
    centroids,
    class_lm,
    decontaminate,
    exact_dedup,
    ngram_join,
    packing,
    pii,
    prefix_trie,
    secrets,
    sharding,
    token_counts,
    toxicity,
    url_filter,
)
from mailtriage.llm.tables import fold_column, texts


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.jaccard_groups(_documents(spark, sf)).select("doc_id", "n_shingles", "component_id")


def op2_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each stretch of a document that a benchmark item covers; clean documents have none."""
    return decontaminate.contaminated(_documents(spark, sf), _table(spark, sf, "benchmark")).select(
        "doc_id", "item_id", F.col("start").alias("word_start"), F.col("end").alias("word_end"), "item_start", "matched"
    )


def op3_class_lm(spark: SparkSession, sf: str) -> DataFrame:
    return class_lm.score_documents(_documents(spark, sf)).drop("perplexity")


def op4_best_two_fit(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf))


def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.place(_documents(spark, sf), "doc_id").select("doc_id", "slot", "shard")


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf, "pages")).drop("listed")


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    model = toxicity.learn(texts(docs), _table(spark, sf, "labels"))
    held_out = (fold_column(F.col("doc_id"), 3) == 1).alias("held_out")
    return toxicity.score_documents(docs, model).select("doc_id", held_out, "score", "predicted")


def op8_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = F.col("found")
    base = F.filter(found, lambda s: s["base"])
    return secrets.scan_secrets(_documents(spark, sf)).select(
        "doc_id",
        *(_of_kind(base, r.kind).alias(f"n_{r.kind}") for r in secrets.BASE_RULES),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(found).alias("spans"),
    )


def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = F.col("found")
    base = F.filter(found, lambda s: s["base"])
    return pii.find_personal_data(_documents(spark, sf)).select(
        "doc_id",
        *(_of_kind(base, kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(found).alias("spans"),
    )


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf, "conversations"))


def op12_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf, "embeddings"))[0]


def op13_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_decontaminate": op2_decontaminate,
    "op3_class_lm": op3_class_lm,
    "op4_best_two_fit": op4_best_two_fit,
    "op5_sharding": op5_sharding,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity": op7_toxicity,
    "op8_secrets": op8_secrets,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_pii": op10_pii,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_centroids": op12_centroids,
    "op13_token_counts": op13_token_counts,
}
