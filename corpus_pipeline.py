"""The corpus pipeline: toxicity, quality, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Filtering stages return
the rows that stay, with all columns of docs; the last returns the pieces of packed sequences.

Defined cases, of every stage: an empty table gives an empty table; extra columns stay as they are, whatever their names; very long texts are
read whole. Null and empty texts score as texts without terms, so the classifiers keep or drop all of them alike; they are near
duplicates of nothing, hold nothing of the benchmark, and pack as the end id alone. Repeated rows have equal scores, stay one row in near_dedup, and elsewhere
each for itself; of near duplicates the least doc_id stays, a null doc_id is linked with nothing. Without labels, or with labels of one class only,
a classifier keeps every document; without a benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import decontaminate, near_dedup, packing, quality, toxicity
from loomwork.llm.common import stage, table
from loomwork.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.with_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), with_ids=False).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The classifiers and the tokenizer have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
