"""Constraints as tables of violations, indicators, identity and caching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanloom.functions.text import canonical, digest
from spanloom.operators.joins import full_diff
from spanloom.operators.scratch import materialize

LONGER_SLACK = 1e-7


def first_failure(checks: list[tuple[str, DataFrame | Callable[[], DataFrame]]]) -> tuple[list[tuple[str, str]], str | None]:
    """Run named violation queries (or functions that give one) in order up to
    the first that has rows: the (name, status) of those that ran, and the name of the failure."""
    done: list[tuple[str, str]] = []
    for name, bad in checks:
        if (bad() if callable(bad) else bad).limit(1).count():
            return [*done, (name, "failed")], name
        done.append((name, "passed"))
    return done, None


def duplicates(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")


def missing_references(df: DataFrame, refs: DataFrame, on: list[str]) -> DataFrame:
    return df.join(refs.select(*on).distinct(), on, "left_anti")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only with ``side``; empty if the sets are equal."""
    l, r = left.distinct(), right.distinct()
    return l.exceptAll(r).withColumn("side", F.lit("left")).union(r.exceptAll(l).withColumn("side", F.lit("right")))


def lossless(pieces: DataFrame, whole: DataFrame, key: list[str], order: str, piece: str, text: str) -> DataFrame:
    """(key, ok): whether the pieces in order are the text exactly."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, piece))), lambda x: x[piece]), "")
    got = pieces.groupBy(*key).agg(joined.alias("_joined"))
    return whole.join(got, key, "left").select(*key, (F.coalesce("_joined", F.lit("")) == F.col(text)).alias("ok"))


def indicators(rows: DataFrame, key: list[str], column: str, domain: list[str]) -> DataFrame:
    """(key, value, n) with a row for each value of the fixed domain."""
    n = rows.groupBy(*key).agg(*[F.count_if(F.col(column) == d).alias(d) for d in domain])
    return n.select(*key, F.explode(F.array(*[F.struct(F.lit(d).alias("value"), F.col(d).alias("n")) for d in domain])).alias("e")).select(*key, "e.value", "e.n")


def max_ties(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """All rows that share their key's greatest value."""
    top = df.groupBy(*key).agg(F.max(value).alias("_top"))
    return df.join(top, key).where(F.col(value) == F.col("_top")).drop("_top")


def identities(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, artifact_id): digest of the canonical JSON of the columns."""
    return df.select(key, digest(canonical(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))).alias("artifact_id"))


def cache_key(source_sha: Column, path: Column, settings: Column) -> Column:
    """Key of a result: content, place and canonical settings."""
    return digest(F.concat_ws("\n", source_sha, path, canonical(settings)))


def valid_cache(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Differences (path, state) between recorded and actual (path, bytes,
    sha256); a result may be used again if there are none."""
    return full_diff(recorded, actual, ["path"], ["bytes", "sha256"])


def inventory(spark: SparkSession, directory: str) -> DataFrame:
    """(path, bytes, sha256) of all files under a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_digest(files: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, n, bytes, missing, sha256) of each inventory, in path order;
    ``missing`` counts entries without a size.

    One inventory's lines are one array: those of a model or an installation are
    thousands of lines.  Give a key (a directory, a recording) to digest more.
    """
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "bytes", "sha256"))), lambda x: F.concat_ws("\t", x["path"], x["bytes"].cast("string"), x["sha256"])), "\n")
    return files.groupBy(*(key or [])).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes").isNull()).alias("missing"), F.sha2(lines, 256).alias("sha256"))


def manifest_violations(files: DataFrame) -> DataFrame:
    """(path, problem) of manifest entries (path, bytes, sha256)."""
    bad_path = (F.length("path") == 0) | F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.?(/|$)|\\|//")
    n = files.groupBy("path").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"), F.max("sha256").alias("sha256"))
    problem = F.when(F.col("path").isNull() | bad_path, "unsafe_path").when(F.col("n") > 1, "duplicate_path").when(~F.coalesce(F.col("bytes") >= 0, F.lit(False)), "invalid_size").when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "invalid_digest")
    return n.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def descendants(spark: SparkSession, parents: DataFrame, root: int) -> DataFrame:
    """(id, depth) of all that descend from ``root`` in (id, parent), itself at
    depth 0: level by level, each id once, so cycles end.  A job to a level."""
    edges = parents.select("id", "parent")
    level = seen = spark.createDataFrame([(root, 0)], "id long, depth int")
    depth = 0
    while True:
        depth += 1
        below = edges.join(level.select(F.col("id").alias("parent")), "parent").select(F.col("id").cast("long").alias("id")).distinct()
        level = materialize(below.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            return seen
        seen = seen.union(level)


def version_mismatches(pinned: DataFrame, installed: DataFrame) -> DataFrame:
    """(name, expected, actual): pinned packages (name, version) that are
    missing (null) or of another version; others that are there do not count."""
    own = installed.select("name", F.col("version").alias("actual"))
    met = pinned.select("name", F.col("version").alias("expected")).join(own, "name", "left")
    return met.where(~F.col("expected").eqNullSafe(F.col("actual")))
