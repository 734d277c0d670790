"""A corpus pipeline: quality rules, near-duplicates, secrets, mixing and packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewise.llm import mixing, packing, quality, secrets, simhash
from tracewise.llm.common import hashable, positional, staged, words


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    rows, (text,) = positional(docs, "text")
    return quality.ledger(rows, text).filter(~quality.rejects("v1")).select(rows.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; of equal rows, one. Null ids come last.

    A row is known by 128 bits of all its columns.
    """
    rows, (id, text) = positional(docs, "doc_id", "text")
    plain = hashable(rows)
    key = F.struct(F.xxhash64(*plain).alias("a"), F.xxhash64(F.lit(7), *plain).alias("b"))
    place = F.struct(F.col(id).isNull().alias("no_id"), id, key.alias("key"))
    found = simhash.near_duplicates(rows.select(place.alias("place"), text), "place", text, shingle=3, distance=2)
    first = found.filter(F.col("place") == F.col("component_id")).select(F.col("place.key").alias("_key")).distinct()
    kept = rows.withColumn("_key", key).join(first, "_key", "left_semi")
    same = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    return kept.withColumn("_same", same).filter("_same = 1").select(rows.columns).toDF(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    rows, (text, source) = positional(docs, "text", "source")
    mixed = mixing.copies(rows, F.size(words(F.col(text))), source).filter("copies > 0")
    repeated = mixed.select(*rows.columns, F.explode(F.sequence(F.lit(1), "copies")).alias("_copy"))
    return repeated.drop("_copy").toDF(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    return packing.pack(packing.pieces(docs, "word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: The forest, the rounding and the tokens have no equivalent in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
