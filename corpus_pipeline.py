"""A corpus pipeline: language, near copies, benchmark passages, personal data, tokens.

Each stage is (spark, docs, sf_dir) -> DataFrame, works on every row that its predecessor kept and, but for the last, returns the columns
of documents. Rows with null texts have no language and go at the first stage. Of rows that repeat a doc_id and text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.llm import bpe, decontamination, language, near_dups, pii
from terrapulse.llm.common import remove, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that no language model accepts go."""
    return language.accepted(docs, language.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class stays."""
    return near_dups.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the names of their kinds; n_chars follows."""
    return pii.redacted(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the redacted text, their number, and whether they decode to the text again."""
    out = bpe.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))
    return out.select("doc_id", "n_tokens", "ids", F.sha2(bpe.decode(F.col("ids")), 256).alias("text_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("personal_data", redact_personal_data),
    ("tokens", tokenize),
]
#: SQL has neither language models nor edit distances over stretches; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and reread."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
