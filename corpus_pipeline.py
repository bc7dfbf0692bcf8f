"""The corpus pipeline: documents in, token ids of the clean, distinct, uncontaminated and redacted ones out.

A stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
`documents`. Toxicity and contamination drop rows; of each group of near copies (five-word shingles, similarity 0.8 or
more) the row of the least id stays; personal data are replaced in the text, and n_chars follows; the last stage encodes
the text. Null or empty texts pass all filters. Rows that share an id are told apart by their text: equal ones are one row
after the near-copy stage, near copies one group, and others stay. Rows without an id stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import byte_bpe, common, decontam, jaccard_join, pii, toxicity

TOXIC_FROM = 0.5
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity.learn(docs, common.table(spark, sf_dir, "labels"))
    scored = toxicity.score(common.whole_rows(docs), lexicon, "row")
    return scored.where(F.col("score") < TOXIC_FROM).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    repeated = not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    kept = first_of_groups_by_text(docs) if repeated else first_of_groups(docs)
    return kept.union(docs.where("doc_id is null"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """Of each group of near copies the row of the least id; no two rows share an id."""
    groups = jaccard_join.jaccard_components(docs, size=SHINGLE, percent=PERCENT)
    return docs.join(groups.where("doc_id = component_id"), "doc_id", "left_semi").select(docs.columns)


def first_of_groups_by_text(docs: DataFrame) -> DataFrame:
    """The same where rows share ids: id and text tell rows apart, so that another text of the same id is a row of its own."""
    rows = common.whole_rows(docs.where("doc_id is not null")).select("row", "text", F.col("row.doc_id").alias("id"))
    rows = rows.withColumn("key", F.concat_ws(":", F.col("id").cast("string"), F.coalesce(F.sha2("text", 256), F.lit("null"))))
    groups = jaccard_join.jaccard_components(rows, "key", size=SHINGLE, percent=PERCENT)
    named = groups.select("key", "component_id").distinct().join(rows.select("key", "id").distinct(), "key")
    first = named.groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("least")).select("least.key")
    return rows.join(first, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scanned = decontam.contamination(common.whole_rows(docs), common.table(spark, sf_dir, "benchmark"), "row")
    return decontam.contaminated(scanned).where("not contaminated").select("row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(docs)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("decontamination", drop_contaminated), ("personal data", redact), ("byte-level BPE", encode)]

#: The first stage is learned, so SQL can't give the rows. Tests hold the near copies against brute force, and run every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            out = common.stored(out)
            if i:
                common.dropped(docs)
        docs = out
    return docs
