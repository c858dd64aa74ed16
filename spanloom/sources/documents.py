"""JSON sources of model outputs, strict parsing, and text and JSON sinks."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FRAMES = "file string, sha256 string, sample_count long, sample_rate int, frames array<struct<start_sample:long,end_sample:long,probability:double>>"
EVENTS = "segments array<struct<start:double,end:double,speaker:string>>"
SEGMENTS = "segments array<struct<text:string,units:array<struct<text:string,start:double,end:double>>>>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents; NaN and Infinity literals and malformed documents
    are errors, not nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("allowNonNumericNumbers", False).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, one row each; malformed lines and literals that are not
    finite are errors."""
    return spark.read.schema(schema).option("allowNonNumericNumbers", False).option("mode", "FAILFAST").json(path)


ALIGNMENT = (
    "source_offset_seconds double, duration_seconds double, alignment_status string, mapping struct<original_text:string>, "
    "items array<struct<index:int,text:string,raw_clip_seconds:array<double>,repaired_clip_seconds:array<double>,library_repaired:boolean,"
    "original_character_spans:array<array<int>>,flags:array<string>,eligible_for_boundary_candidate:boolean>>"
)
REVIEW = (
    "reviewer string, reviewed_at string, listened_ranges array<struct<start:double,end:double>>, rows map<string,struct<"
    "content:string,speaker:string,boundary:string,note:string,text:string,speakers:array<string>,start:double,end:double,"
    "corrections:struct<text:string,speakers:array<string>,start:double,end:double>>>"
)


def alignments(documents: DataFrame, rec: Column) -> tuple[DataFrame, DataFrame]:
    """Texts (rec, text, offset, duration, empty) and tokens (rec, idx, token,
    xa, xb, spans, ra, rb, a, b, repaired, flags, eligible) of alignment
    documents.  A blank text is a valid, empty result without tokens."""
    text = F.col("mapping.original_text")
    blank = F.coalesce(F.length(F.trim(text)) == 0, F.lit(True))
    texts = documents.select(rec.alias("rec"), text.alias("text"), F.col("source_offset_seconds").alias("offset"), F.col("duration_seconds").alias("duration"), blank.alias("empty"))
    t = documents.where(~blank).select(rec.alias("rec"), F.explode("items").alias("i"))
    pair = lambda c, k: F.get(F.col(f"i.{c}"), F.lit(k))
    spans = F.transform("i.original_character_spans", lambda s: F.struct(s[0].alias("a"), s[1].alias("b")))
    t = t.select("rec", F.col("i.index").alias("idx"), F.col("i.text").alias("token"), spans.alias("spans"), pair("raw_clip_seconds", 0).alias("ra"), pair("raw_clip_seconds", 1).alias("rb"),
                 pair("repaired_clip_seconds", 0).alias("a"), pair("repaired_clip_seconds", 1).alias("b"), F.col("i.library_repaired").alias("repaired"), F.col("i.flags").alias("flags"), F.col("i.eligible_for_boundary_candidate").alias("eligible"))
    return texts, t.withColumns({"xa": F.get("spans", F.lit(0))["a"], "xb": F.try_element_at("spans", F.lit(-1))["b"]})


def review_sheets(documents: DataFrame, rec: Column) -> tuple[DataFrame, DataFrame]:
    """Reviews (rec, id, content, speaker, boundary, note, text, speakers, start,
    end, original) and listened ranges (rec, a, b) of review sheets."""
    r = documents.select(rec.alias("rec"), F.explode("rows").alias("id", "r"))
    fields = ("text", "speakers", "start", "end")
    reviews = r.select("rec", "id", "r.content", "r.speaker", "r.boundary", "r.note", *[F.col(f"r.corrections.{c}").alias(c) for c in fields], F.struct(*[F.col(f"r.{c}").alias(c) for c in fields]).alias("original"))
    heard = documents.select(rec.alias("rec"), F.explode("listened_ranges").alias("l")).select("rec", F.col("l.start").alias("a"), F.col("l.end").alias("b"))
    return reviews, heard


def verified_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(path, content) of files whose (path, bytes, sha256) is as expected; any
    other content is an error when it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    met = files.join(F.broadcast(expected.select("path", "bytes", "sha256")), "path", "left")
    same = F.col("bytes").eqNullSafe(F.octet_length("content").cast("long")) & F.col("sha256").eqNullSafe(F.sha2("content", 256))
    return met.select("path", F.when(same, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("the input changed: "), F.col("path")))).alias("content"))


def frames(documents: DataFrame, rec: Column) -> DataFrame:
    return documents.select(rec.alias("rec"), F.posexplode("frames").alias("frame_idx", "f")).select("rec", "frame_idx", "f.*")


def events(documents: DataFrame, rec: Column) -> DataFrame:
    return documents.select(rec.alias("rec"), F.posexplode("segments").alias("id", "s")).select("rec", "id", F.col("s.start").alias("a"), F.col("s.end").alias("b"), F.col("s.speaker").alias("spk"))


def units(documents: DataFrame, rec: Column) -> DataFrame:
    out = documents.select(rec.alias("rec"), F.posexplode("segments").alias("segment_index", "s"))
    return out.select("rec", "segment_index", F.posexplode("s.units").alias("unit_index", "u")).select("rec", "segment_index", "unit_index", "u.*")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines of a text file."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0)


def parse_strict(text: Column, schema: str) -> Column:
    """A JSON string as a struct; null if it is malformed or not finite."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"})


def encode_number(x: Column) -> Column:
    """A number for JSON text: nonfinite values as quoted names."""
    return F.when(F.isnan(x), '"nan"').when(x == float("inf"), '"inf"').when(x == float("-inf"), '"-inf"').otherwise(F.to_json(F.struct(x.alias("v"))).substr(6, 64))


def float_bytes(values: Column) -> Column:
    """Little-endian 32-bit floats of an array of numbers."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda a: np.asarray(a, "<f4").tobytes())

    return run(values)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines to a new place; null fields are left out."""
    df.write.mode("errorifexists").option("ignoreNullFields", True).json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("errorifexists").text(path)


def write_pretty(df: DataFrame, path: str) -> None:
    """Each row as indented JSON to a new place."""
    write_text(df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")), "value", path)


def replace_path(spark: SparkSession, path: str, write) -> None:
    """``write(temporary path)``, then put it in the place of ``path``.

    Readers see the old files or the new ones where the file system renames in
    one step (not on object stores); a failed write leaves the old ones.
    """
    jvm = spark.sparkContext._jvm
    temporary = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    here, there = jvm.org.apache.hadoop.fs.Path(temporary), jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(temporary)
        fs.delete(there, True)
        if not fs.rename(here, there):
            raise OSError(f"could not move {temporary} to {path}")
    finally:
        fs.delete(here, True)


def provider(inputs: DataFrame, load, schema: str) -> DataFrame:
    """Rows of an external model: ``load()`` runs once per partition and gives
    a function from a pandas batch to a pandas batch of ``schema``."""

    def run(it):
        model = load()
        for p in it:
            yield model(p)

    return inputs.mapInPandas(run, schema)
