"""The corpus pipeline: quality rules, line dedup, near-dedup, redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the
shared folder and reads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.llm import line_dedup, packing, pii, quality, queries, simhash_jaccard
from tilth.llm._shared import fresh_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the forest reject go, all others stay as they are.

    Null and empty texts have no words and go; repeated rows and rows without a doc_id are judged each;
    without labels only the plain rules reject; an empty table gives an empty one.
    """
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), keep=("text", "lang", "source", "n_chars"))
    return judged.filter("kept").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents or more hold stay in the one of the largest doc_id; n_chars follows.

    Every row stays, with an empty text where all its lines go; a null text becomes empty; rows that
    share a doc_id count as one document; rows without one count as none and lose such lines.
    """
    cleaned = line_dedup.line_dedup(docs, carry=("lang", "source"))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id: similarity 0.8 or more over five-word shingles.

    Texts without words are copies of each other; rows that share a doc_id stay or go together; rows
    without a doc_id stay.
    """
    return simhash_jaccard.deduplicated(docs).select(COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become their kind in angle brackets; n_chars follows.

    Every row stays; a null text stays null, and so does its n_chars; texts without spans are unchanged.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece, no token twice or missing.

    Null and empty texts are the end id alone; repeated rows and rows without a doc_id are packed each.
    """
    return packing.pack_documents(docs, queries.vocabulary(queries.BYTES))


STAGES = [("quality_rules", keep_good), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_copies), ("pii", hide_personal_data), ("packing", pack)]

#: The forest's verdicts, similarity groups and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
