"""The driver's tables seen as timelines, frames, sentences and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spanloom.functions import text

#: These events last minutes to hours: thresholds and buckets in seconds.
GAP, ANCHOR, BUCKET = 3600, 7200, 14_400
RATE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, id, spk, a, b) in whole seconds."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("rec"), F.col("event_id").alias("id"), F.col("event_type").alias("spk"), epoch("ts").alias("a"), F.floor(F.col("value") * 60).alias("len"))
    return e.select("rec", "id", "spk", "a", (F.col("a") + F.col("len")).alias("b")).where("b > a")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, frame_idx, start_sample, end_sample, probability) of each user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), (F.row_number().over(w) - 1).cast("long").alias("frame_idx"), F.least(F.col("value") / 500, F.lit(1.0)).alias("probability"))
    return f.select("rec", "frame_idx", (F.col("frame_idx") * 512).alias("start_sample"), (F.col("frame_idx") * 512 + 512).alias("end_sample"), "probability")


def totals(frame_rows: DataFrame) -> DataFrame:
    return frame_rows.groupBy("rec").agg(F.max("end_sample").alias("samples"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, id, spk, at) of each user in order."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), F.col("event_id").alias("id"), F.col("event_type").alias("spk"), epoch("ts").alias("at"), F.floor(F.col("value") * 60).alias("len"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, pos, sentence, a, b) of the documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec"), "text")
    return text.sentence_spans(docs, ["rec"]).select("rec", F.col("pos").cast("long").alias("pos"), "sentence", "a", "b")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, part, repaired, qty, len) of each order's lines."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("rec"), (F.row_number().over(w) - 1).cast("long").alias("part"), (F.col("l_returnflag") == "R").alias("repaired"), F.col("l_quantity").cast("long").alias("len"), F.col("l_linenumber").cast("long").alias("line"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, id, content, speaker, boundary, note, text, speakers, start, end)."""
    lab = table(spark, sf_dir, "labels")
    content = F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail").otherwise("review_required")
    speaker = F.when(F.col("toxic") == 0, "pass").when(F.col("toxic") == 1, "not_applicable").otherwise("review_required")
    return lab.select(
        (F.col("doc_id") % 20).alias("rec"), F.col("doc_id").alias("id"), content.alias("content"), speaker.alias("speaker"), F.lit("pass").alias("boundary"), F.lit("heard").alias("note"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<string>").alias("speakers"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"),
    )


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, id, start, end, text, speakers, state, a, b): documents as the
    rows of 20 transcripts."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("rec"), F.col("doc_id").alias("id"), "text", F.array("source").alias("speakers"), F.lit("single").alias("state"))
    out = text.running_offsets(d, ["rec"], "id", F.length("text").cast("long"))
    return out.withColumns({"start": F.col("a").cast("double"), "end": F.col("b").cast("double")})
