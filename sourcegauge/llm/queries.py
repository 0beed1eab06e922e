"""The registered queries: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, codes, decontaminate, html, langid, licenses, mixing, neardup, pii, quality, substrings, topsearch, toxicity
from .common import held_out, table


def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.summarise(licenses.scan_licenses(table(spark, folder, "documents")))


def op2_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def _listed(spans: Column) -> Column:
    parts = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(parts, ",")


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(table(spark, folder, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(*pii.BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op4_substrings(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "n_tokens", "n_covered", "n_changed", "coverage")


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    named = langid.identify(docs, langid.train(docs))
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.measure(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines", "kept_chars")


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op11_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topsearch.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster(table(spark, folder, "embeddings"))


def op13_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.compress(table(spark, folder, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_licenses, op2_html, op3_pii, op4_substrings, op5_decontamination, op6_language, op7_near_duplicates, op8_toxicity, op9_quality, op10_mixing,
    op11_topk, op12_clusters, op13_codes)}
