"""The registered queries of this subpackage: one opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, common, cover_tree, decontam, html_extract, jaccard_join, periodic_runs, pii, prefix_trie, quality_model, quality_rules, token_counts, toxicity, url_filter
from .common import table
from .oracles import ORACLES


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), limit=512)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_model.score(docs, quality_model.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality_model.AT_THRESHOLD).cast("int").alias("predicted"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *pii.counts(F.col("base")), F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontam.contaminated(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    ids = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return scanned.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt_paths(table(spark, sf_dir, "conversations")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), change=periodic_runs.made_periodic)


def op13_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_byte_bpe, op3_quality_model, op4_html_extraction, op5_pii, op6_toxicity, op7_quality_rules, op8_url_filter, op9_jaccard_join, op10_decontamination, op11_prefix_trie, op12_periodic_runs, op13_cover_tree)}


def oracle_sql() -> dict[str, str]:
    """The others are learned, or return digests and offsets that SQL can't give; tests hold them against brute force."""
    return dict(ORACLES)
