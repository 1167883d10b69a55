"""A corpus from raw documents to packed sequences; each stage applies one operator of furlong.llm.

Every stage but the last returns the columns of ``documents``. SQL cannot express learned rules or packing, so there is no
ORACLE_SQL; tests/llm compare each stage and the whole run with a brute-force version on a small table. Rows are told
apart by numbers of their own, so null and repeated ids lose nothing; empty tables give no rows; a null text is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from furlong.llm import decontam, minhash, packing, quality, secret_scan
from furlong.llm.queries import tokenizer_path
from furlong.llm.work import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list rejects."""
    rules = quality.fit_quality_rules(docs, table(spark, sf_dir, "labels"))
    return quality.apply_quality_rules(docs, rules).filter("kept").select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number for each row, fixed by being written: ids may be null or repeat."""
    return materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_number")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the first of the smallest id (a null before all others), of each group of near duplicates."""
    docs = numbered(docs)
    kept = minhash.near_duplicates(docs, row_col="row_number").filter("kept").select("row_number")
    return docs.join(kept, "row_number", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no test item."""
    docs = numbered(docs)
    leaks = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"), id_col="row_number").select(F.col("doc_id").alias("row_number")).distinct()
    return docs.join(leaks, "row_number", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark; n_chars is that of the new text."""
    found = secret_scan.find_secrets(docs.select(*COLUMNS))
    out = found.withColumn("text", secret_scan.redact(found)).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_sequences(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules), ("near dedup", near_dedup), ("decontamination", decontaminate), ("secret scan", redact_secrets), ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
