"""The training-data operators bound to the driver's tables, whole tables each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.llm import decontamination, embedding_dedup, html_text, mixing, near_dup, secrets, sharding, substring_dedup, toxicity, url_filter
from spanloom.llm.common import table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs.select("doc_id", "text"), toxicity.training_labels(labels))
    return toxicity.score(docs.select("doc_id", "text"), lexicon).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


# A log of list entries for the synthetic hosts (key, list, action, time).
LIST_LOG = [
    ("cheap-pills.example.com", "spam", "add", "2023-03-01"),
    ("www.cheap-pills.example.com", "spam", "remove", "2024-06-01"),
    ("cheap-pills.example.com", "spam", "remove", "2024-09-01"),
    ("cheap-pills.example.com", "spam", "add", "2024-11-15"),
    ("example.net", "bulk", "add", "2023-07-01"),
    ("example.net", "bulk", "remove", "2023-10-01"),
    ("tionsh.example.net", "hosts", "add", "2024-01-01"),
    ("tionsh.example.net/en", "paths", "allow", "2024-02-01"),
    ("tionsh.example.net/en", "paths", "remove", "2024-05-01"),
    ("example.org", "bulk", "add", "2024-10-01"),
    ("blog.ththth.example.org", "hosts", "allow", "2024-10-15"),
    ("ththre.example.com/fr", "paths", "add", "2023-05-01"),
    ("ththre.example.com/fr", "paths", "remove", "2024-05-01"),
    ("therat.example.net/en/231", "paths", "add", "2023-01-01"),
]
#: Pages carry no fetch time: page_id spreads them over two years from here.
FIRST_FETCH, FETCH_DAYS = "2023-01-01", 730


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(LIST_LOG, "key string, list string, action string, at string")
    day = F.pmod(F.col("page_id") * 37, F.lit(FETCH_DAYS)).cast("int")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit(FIRST_FETCH).cast("date"), day).cast("timestamp").alias("fetched_at"))
    out = url_filter.evaluate(pages, entries)
    return out.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd"))


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assign(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}
