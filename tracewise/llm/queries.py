"""The queries of the text operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.llm import (
    chosen_path, collocations, mixing, packing, page_diff, postings, prefix_counts, quality, secrets, simhash, sql,
    toxicity, warc, whitening,
)
from tracewise.llm.common import words

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = packing.pieces(_table(spark, sf_dir, "documents"), "word_bpe_49k.json")
    return packing.pack(items)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "place", "length", F.sha2("candidate", 256).alias("digest"), "label", "probability", "is_secret"
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = quality.rejects("base")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"),
        (~base & ~quality.rejects("v1")).alias("kept"),
        "failed",
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    kept = F.col("record_type") == "response"
    return read.select(
        warc.page_id("record_id").alias("page_id"),
        F.when(kept, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("bigint").alias("payload_bytes"),
        F.when(kept, F.sha1("payload")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        "record_type",
        warc.page_id("refers_to").alias("refers_to"),
    )


def op5_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), "text"
    )
    counted = prefix_counts.with_prefix_tokens(documents, "byte_bpe_50k.json")
    n = prefix_counts.tokens_in(F.col("prefix_tokens"))
    return counted.select("doc_id", "n_bytes", n.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > 512)


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    known = _table(spark, sf_dir, "labels").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    # the sample is bounded, and so is what the join broadcasts
    known = known.orderBy(F.xxhash64("doc_id")).limit(toxicity.TRAIN_ROWS)
    model = toxicity.fit(documents.join(F.broadcast(known), "doc_id"))
    return toxicity.score(documents, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.size(words(F.col("text")))
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", size.alias("n"))
    return mixing.copies(documents, F.col("n")).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "source", "copies",
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(documents, shingle=3, distance=2)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), min_count=10, top=2000, absorbed=50)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"), most=4)
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))


def op13_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def llm_queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_secret_scan": op2_secret_scan,
        "op3_quality_rules": op3_quality_rules,
        "op4_warc": op4_warc,
        "op5_prefix_token_counts": op5_prefix_token_counts,
        "op6_page_text": op6_page_text,
        "op7_posting_lists": op7_posting_lists,
        "op8_mixing": op8_mixing,
        "op9_toxicity": op9_toxicity,
        "op10_simhash": op10_simhash,
        "op11_collocations": op11_collocations,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_chosen_path": op13_chosen_path,
    }


def llm_oracles() -> dict[str, str]:
    return sql.ORACLES
