"""Operator 3: URL filters as a temporal list join.

A list is a log of dated entries: a host (with its subdomains) or a URL prefix
is put on a list (``add``) or taken off (``remove``) at a time.  The entries of
a key become validity intervals [from, until): the last entry at a time wins,
and each lasts to the next.  A capture is evaluated as of its fetch time: its
URL yields the keys that could list it (every parent domain, every path
prefix), an equi-join finds their intervals, and the one that holds the fetch
time decides.  The most specific active key is reported; an ``allow`` entry
overrides a block of the same or a less specific key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.llm.common import small_side

_SPLIT = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without a trailing dot; '' where there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, _SPLIT, 1)), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 2)


def keys_of(url: Column) -> Column:
    """array<struct<key, rank>>: domains by their number of labels, then path
    prefixes ending at a slash, each more specific than any domain."""
    host, path = host_of(url), path_of(url)
    labels, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda p: p != "")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.struct(F.array_join(F.slice(labels, -k, k), ".").alias("key"), k.alias("rank")),
    )
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda k: F.struct(F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")).alias("key"), (k + 1000).alias("rank")),
    )
    return F.when(F.length(host) == 0, F.array().cast("array<struct<key:string,rank:int>>")).otherwise(
        F.when(F.size(parts) > 0, F.concat(domains, prefixes)).otherwise(domains)
    )


def intervals(entries: DataFrame) -> DataFrame:
    """(key, list, verdict, valid_from, valid_until) from entries (key, list,
    action, at): action ``add``, ``allow`` or ``remove``.  Entries without a
    key, an action or a time are ignored; at equal times ``remove`` yields to
    ``add`` and both to ``allow``; an open interval has a null end."""
    host = F.substring_index("key", "/", 1)
    # paths keep their case, as those of captures do
    key = F.concat(F.rtrim(F.lower(host), F.lit(".")), F.rtrim(F.expr("substring(key, length(substring_index(key, '/', 1)) + 1)"), F.lit("/")))
    e = entries.select(key.alias("key"), F.coalesce("list", F.lit("")).alias("list"), F.lower("action").alias("action"), F.col("at").cast("timestamp").alias("at"))
    strength = F.expr("array_position(array('remove', 'add', 'allow'), action)")
    e = e.where(F.col("key").isNotNull() & (F.col("key") != "") & F.col("action").isin("add", "allow", "remove") & F.col("at").isNotNull())
    e = e.groupBy("key", "list", "at").agg(F.max_by("action", strength).alias("action"))
    after = Window.partitionBy("key", "list").orderBy("at")
    return e.withColumn("valid_until", F.lead("at").over(after)).where("action <> 'remove'").select(
        "key", "list", F.col("action").alias("verdict"), F.col("at").alias("valid_from"), "valid_until"
    )


def evaluate(captures: DataFrame, entries: DataFrame, capture_id: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """(capture_id, url, fetched_at, n_active, list, key, allowed), one row per
    row: the number of list entries active at fetch time, and the most
    specific (then first list by name) that decides, null if none does.

    Null or unparsable URLs and null times match nothing and are allowed.
    Rows that repeat an id are evaluated by url and time, so they agree.  Extra
    columns are ignored; empty tables give an empty result or allow all.
    """
    spans = intervals(entries).withColumnRenamed("key", "k")
    own = captures.select(F.col(capture_id).alias("id"), F.col(url).cast("string").alias("u"), F.col(fetched).cast("timestamp").alias("t"))
    asked = own.select("u", "t").where("u IS NOT NULL AND t IS NOT NULL").distinct()
    n = spans.count()
    probes = asked.select("u", "t", F.explode(keys_of(F.col("u"))).alias("e")).select("u", "t", F.col("e.key").alias("k"), F.col("e.rank").alias("rank"))
    active = probes.join(small_side(spans, n), "k").where((F.col("valid_from") <= F.col("t")) & (F.col("valid_until").isNull() | (F.col("t") < F.col("valid_until"))))
    # the least struct: most specific first, an allow before a block, then by name
    order = F.struct((-F.col("rank")).alias("rank"), (F.col("verdict") != "allow").alias("block"), F.col("list").alias("list"), F.col("k").alias("key"))
    decided = active.groupBy("u", "t").agg(F.count("*").alias("n_active"), F.min(order).alias("d"))
    return own.join(decided, ["u", "t"], "left").select(
        F.col("id").alias(capture_id),
        F.col("u").alias("url"),
        F.col("t").alias("fetched_at"),
        F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
        F.col("d.list").alias("list"),
        F.col("d.key").alias("key"),
        F.coalesce(~F.col("d.block"), F.lit(True)).alias("allowed"),
    )
