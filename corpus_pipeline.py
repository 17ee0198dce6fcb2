"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, mixing.

Each stage takes what the one before kept and returns the columns of documents;
the last adds size, source_size, target, copies and taken. A stage's decisions
take effect: rejected, duplicate and contaminated documents go, personal data is
replaced in the text (n_chars follows), documents of which the mix takes no copy
go. Weak supervision and consistent sampling can't be stated in SQL, so there is
no ORACLE_SQL; the tests hold each stage against a brute-force version of its own.

Nulls: a null, empty or blank text fails the quality rules, so none reaches the later
stages. Rows with a null doc_id are never near-duplicates; they are scored, decontaminated,
redacted and mixed by their texts. A null source is a source, null lang and n_chars are
carried. Of a class of near-duplicates the smallest doc_id stays, with all rows that repeat
it; ties in the mix go by the rank alone. Very long texts are taken whole. Empty tables give
an empty result. Columns other than the five of documents end with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontamination, mixture, near_dedup, pii, quality_rules
from tidewell.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality_rules.keep_good(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each class of near-duplicates."""
    return near_dedup.keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that share too much with the benchmark."""
    return decontamination.remove_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by [EMAIL], [IP], [CARD] and [PHONE]."""
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.lit(0))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes copies of documents so that each source comes near its target."""
    mixed = mixture.mix(docs, carry=("text", "lang", "n_chars")).filter("copies > 0")
    return mixed.select(*COLUMNS, "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality_rules", rules),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("source_mixture", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
