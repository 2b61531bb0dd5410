"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of documents, whatever these are beside doc_id, text and lang.

Defined results of every stage: a null text has no words, so the first stage rejects
it, as it does empty texts; later stages let it pass. Rows that share an id are judged
row by row by the first stage and the fourth; the second keeps one of them (the smallest
text hash), the third takes them as one document. Rows with a null id are kept by the
second stage and rank last in the third. Texts are read whole, however long. An empty
table passes every stage as an empty table. Columns whose names clash with results of an
operator are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import common, packing, quality_rules, queries, secrets, simhash, substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; ties can't occur, since each row is judged by itself."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    return simhash.deduplicate(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has; n_chars follows. No row goes, whatever is left of its text."""
    return substring_dedup.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced; overlapping ones count as one, n_chars follows."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document, or piece of one, in training sequences, in tokens. An empty text has its begin and end ids."""
    return packing.pack_documents(docs, queries.model_path())


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", passages),
    ("secret scans", secret_scan),
    ("best-fit packing", pack),
]

#: Fingerprints and greedy packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bound_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with common.scope() as kept:  # what a stage has written goes when its result is written
            docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(docs)
        common.free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
