"""A training-data pipeline over ``documents``: quality rules, near duplicates,
secrets, the source mix and packing.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs,
sf_dir)`` and works on everything that the stage before it kept.  ``run`` writes
each result below ``spark.checkpoint.dir`` and rereads it as the next one's
``docs``.  Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldreports.llm import ngram_join, packing, quality_rules, secret_scans, source_mix
from fieldreports.llm.common import read, ship, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship(spark)
    model = quality_rules.fit(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_rules.keep_documents(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    ship(spark)
    return ngram_join.keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the scan finds is replaced by a mark; all documents stay."""
    return secret_scans.redact(docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: as often as it takes them, or in part."""
    return source_mix.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a packed sequence."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("secret scans", secrets),
    ("source mix", source_weights),
    ("packing", sequences),
]

#: The stages fit a model, draw MinHash samples and call a tokenizer: SQL cannot express their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
