"""Operator 8: benchmark decontamination by size-partitioned MinHash
containment search, in DataFrame functions only.

Words are lower-cased runs of letters and digits.  An item is the set of its
five-word shingles; an item of fewer words is one shingle of its own width.
Items fall into partitions by size (powers of two).  A partition's sketch
keeps, per item, the m shingles of least hash, where m follows from the
partition's greatest size q and the containment c that is asked for:
m = floor((1 - c) q) + 1.  A document that contains a share c of an item lacks
at most (1 - c) q of its shingles, so it holds one of the minima for certain.

Size and hash prune before the join.  A document of n shingles can contain
items of up to n / c shingles only, and of the partitions that leaves it needs
to probe just with shingles whose hash is at most the partitions' greatest
minimum (about 1 - c of them).  Candidates are verified by exact shingle
containment over the whole text.

Rows are told apart by doc_id and text, items by item_id and text, so null and
repeated ids are searched and dropped like all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.llm.common import SHINGLE_WORDS, SIMILARITY, materialize, packed, small_side

_NULL_ID = -(1 << 63)
_ROW = ["id", "h1", "h2"]
_ITEM = ["item", "ih"]
#: Shingles of items that may be broadcast: 16 MB of hashes.
_MOST_BROADCAST = 2_000_000


def word_array(text: Column) -> Column:
    """Lower-cased words; null and wordless texts have none."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[^\p{L}\p{N}]+", "")
    return F.filter(F.split(bare, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value bound to a lambda variable, or else the
    optimizer could put its whole expression in place of each use of it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingles(w: Column, width: int) -> Column:
    one = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
    return F.when(F.size(w) >= width, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - width), one))).otherwise(F.array().cast("array<bigint>"))


def shingle_array(text: Column, width: int) -> Column:
    """Distinct hashes of the text's shingles of ``width`` words."""
    return _let(word_array(text), lambda w: _shingles(w, width))


def _rank(shingle: Column) -> Column:
    return F.xxhash64(shingle, F.lit(3))


def _id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(_NULL_ID))


def _row_key() -> list[Column]:
    text = F.col("text").cast("string")
    return [_id("doc_id").alias("id"), F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2")]


def item_shingles(items: DataFrame) -> DataFrame:
    """(item, ih, width, q, s): one row for each distinct item that has words."""
    text = F.col("text").cast("string")
    w = items.select(_id("item_id").alias("item"), F.xxhash64(text).alias("ih"), text.alias("text")).distinct()
    w = w.withColumn("width", F.least(F.size(word_array(F.col("text"))), F.lit(SHINGLE_WORDS))).where("width > 0")
    s = F.when(F.col("width") == SHINGLE_WORDS, shingle_array(F.col("text"), SHINGLE_WORDS))
    for k in range(1, SHINGLE_WORDS):
        s = s.when(F.col("width") == k, shingle_array(F.col("text"), k))
    return w.withColumn("s", s).select(*_ITEM, "width", F.size("s").alias("q"), "s")


def sketches(items: DataFrame, containment: float) -> DataFrame:
    """(width, part, item, ih, q, k, h): the minima of each item by its size
    partition, k their rank."""
    part = items.withColumn("part", F.floor(F.log2("q")).cast("int"))
    bounds = part.groupBy("width", "part").agg(F.max("q").alias("top"))
    m = F.floor((1 - containment) * F.col("top") + 1e-9) + 1
    own = part.join(F.broadcast(bounds), ["width", "part"]).withColumn("m", m.cast("int"))
    by_hash = F.array_sort(F.transform("s", lambda x: F.struct(_rank(x).alias("k"), x.alias("h"))))
    return own.select("width", "part", *_ITEM, "q", F.explode(F.slice(by_hash, F.lit(1), F.col("m"))).alias("e")).select("width", "part", *_ITEM, "q", "e.k", "e.h")


def probes(text: Column, parts: list[tuple[int, int, int]], containment: float) -> Column:
    """Array of (width, n, h): the shingles with which a text must probe the
    ``parts`` (width, least size, greatest rank); the text is split once."""

    def chosen(width: int):
        def of(s: Column) -> Column:
            n = F.size(s)
            limits = [F.when(n >= containment * low - 1e-9, F.lit(top).cast("long")) for at, low, top in parts if at == width]
            limit = F.greatest(*limits) if len(limits) > 1 else limits[0]
            near = _let(limit, lambda t: F.when(t.isNull(), F.array().cast("array<bigint>")).otherwise(F.filter(s, lambda x: _rank(x) <= t)))
            return F.transform(near, lambda x: F.struct(F.lit(width).alias("width"), n.alias("n"), x.alias("h")))

        return of

    widths = sorted({p[0] for p in parts})
    return _let(word_array(text), lambda w: F.concat(*[_let(_shingles(w, k), chosen(k)) for k in widths]))


_FOUND = "id long, h1 long, h2 long, item long, q int, n_shared int, containment double"


def found_rows(docs: DataFrame, items: DataFrame, containment: float = SIMILARITY) -> DataFrame:
    """(id, h1, h2, item, q, n_shared, containment) of rows and items, null
    doc_ids and item_ids as ``_NULL_ID``."""
    bench = materialize(item_shingles(items), "items")
    minima = materialize(sketches(bench, containment), "minima")
    # at most five widths of 31 powers of two
    parts = [tuple(r) for r in minima.groupBy("width", "part").agg(F.min("q").alias("low"), F.max("k").alias("top")).select("width", "low", "top").orderBy("width", "low").collect()]
    if not parts:
        return docs.sparkSession.createDataFrame([], _FOUND)
    texts = docs.where("text IS NOT NULL").select(*_row_key(), F.col("text").cast("string").alias("text"))
    probe = texts.select(*_ROW, F.explode(probes(F.col("text"), parts, containment)).alias("e")).select(*_ROW, "e.width", "e.n", "e.h")
    met = probe.join(small_side(minima.select("width", "h", "q", *_ITEM), minima.count()), ["width", "h"]).where(F.col("n") >= F.lit(containment) * F.col("q") - 1e-9)
    found = materialize(met.select(*_ROW, *_ITEM, "width").distinct(), "candidates")
    size = bench.agg(F.coalesce(F.sum("q"), F.lit(0)), F.collect_set("width")).first()
    pairs = found.drop("width").join(small_side(bench, size[0], _MOST_BROADCAST), _ITEM)
    keys = materialize(found.select(*_ROW).distinct(), "rows")
    hit = texts.join(small_side(keys, keys.count()), _ROW, "left_semi")
    own = hit.select(*_ROW, *[shingle_array(F.col("text"), w).alias(f"s{w}") for w in sorted(size[1])])
    mine = F.coalesce(*[F.when(F.col("width") == w, F.col(f"s{w}")) for w in sorted(size[1])])
    checked = own.join(pairs, _ROW).withColumn("n_shared", F.size(F.array_intersect(mine, F.col("s"))))
    checked = checked.where(F.col("n_shared") >= F.lit(containment) * F.col("q") - 1e-9)
    return checked.select(*_ROW, "item", "q", "n_shared", (F.col("n_shared") / F.col("q")).alias("containment"))


def contaminated(docs: DataFrame, items: DataFrame, containment: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, item_id, n_item, n_shared, containment), one for each
    document and item of which at least that share of shingles is in the text.

    Null and empty texts, and items without words, match nothing; long texts
    are searched whole.  Rows that share a doc_id, or have none, give its
    greatest containment, and so do items that share an item_id or have none;
    of equal containments the one of more shared shingles.  Extra columns are
    ignored; empty tables give an empty result.
    """
    best = found_rows(docs, items, containment).groupBy("id", "item").agg(F.max(F.struct("containment", "n_shared", "q")).alias("b"))
    real = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return best.select(real("id").alias("doc_id"), real("item").alias("item_id"), F.col("b.q").alias("n_item"), F.col("b.n_shared").alias("n_shared"), F.col("b.containment").alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, containment: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows whose text contains an item, whatever their
    doc_id; clean rows of the same or of no doc_id stay, and so do null texts.
    All columns stay as they are."""
    bad = materialize(found_rows(docs, items, containment).select(*[F.col(c).alias(f"_{c}") for c in _ROW]).distinct(), "contaminated")
    keys = [f"_{c}" for c in _ROW]
    own = packed(docs, *[F.coalesce(k, F.lit(0)).alias(c) for k, c in zip(_row_key(), keys)])
    return own.join(small_side(bad, bad.count()), keys, "left_anti").select("_row.*")
