"""Operator 5: mixing sources to target weights.

One aggregation gives the size of each source.  Targets are the weights'
shares of a total, and no source gives more than ``most`` times its size: the
excess goes to the others by weight, which is the water level L at which the
sum of least(most * size, L * weight) reaches the total.  The repetition rate
of a source is target / size; each of its documents is emitted floor(rate)
times plus once more with a probability of the fraction, decided by a hash of
its id and a seed.  Of ``SEEDS`` seeds each source takes the one under which
its words come nearest to the target, so single long documents do not spoil it.

Only per-source rows are aggregated; texts are never shuffled while the table
of rates is small enough to broadcast, which its counted size decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.llm.common import WORD_SQL, materialize, packed, small_side

SEEDS = 32
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: Column) -> Column:
    """A number in [0, 1) from 48 bits of a hash of id and seed."""
    text = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), seed.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size), one row
    per source: an aggregate, so one window over it is small."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("weight", F.element_at(listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    # the level if this source and all of a larger cap for their weight stay under their caps
    w = w.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    w = w.withColumn("place", F.row_number().over(full))
    open_ = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("place", "level"))
    w = w.withColumn("water", F.min(open_).over(everything)["level"])
    w = w.withColumn("target", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return w.select("source", "source_size", "target", rate.alias("rate"))


def _with_rates(rows: DataFrame, rates: DataFrame, n: int, on: Column) -> DataFrame:
    return rows.join(small_side(rates, n), on, "left")


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, int]:
    """Rates with the chosen seed, (source, source_size, target, rate, seed),
    and how many rows they are."""
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"))
    sized = materialize(sized, "sizes")
    rates = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    n = rates.count()
    r = rates.select(F.col("source").alias("_mix_source"), "source_size", "rate", "target")
    tried = _with_rates(sized, r, n, F.col("source").eqNullSafe(F.col("_mix_source")))
    extra = F.col("rate") - F.floor("rate")
    sums = [F.sum(F.when(uniform(F.col("doc_id"), F.lit(k)) < extra, F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(SEEDS)]
    # the words that whole copies take are the same under every seed
    base = F.floor("rate") * F.col("source_size")
    off = F.array_sort(F.array(*[F.struct(F.abs(F.col(f"s{k}") + base - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)]))
    best = tried.groupBy("source", "source_size", "target", "rate").agg(*sums).select("source", "source_size", "target", "rate", off[0]["seed"].alias("seed"))
    return materialize(best, "rates"), n


def _copies(docs: DataFrame, rates: DataFrame, n: int) -> DataFrame:
    r = rates.select(F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_size"), F.col("target").alias("_mix_target"), F.col("rate").alias("_mix_rate"), F.col("seed").alias("_mix_seed"))
    met = _with_rates(docs, r, n, F.col("source").cast("string").eqNullSafe(F.col("_mix_source")))
    lucky = uniform(F.col("doc_id"), F.col("_mix_seed")) < F.col("_mix_rate") - F.floor("_mix_rate")
    return met.withColumn("_mix_copies", (F.floor("_mix_rate") + lucky.cast("int")).cast("int"))


def assign(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), one row per row.

    Size counts the words of the text, 0 for null.  Sources weigh by their
    rank in code point order, null last.  A source without words has target
    0; an empty table gives an empty result; repeated rows decide alike;
    extra columns are ignored.
    """
    docs = docs.select("doc_id", "source", F.col("text").cast("string").alias("text"))
    rates, n = plan(docs, **how)
    size = n_words(F.col("text"))
    return _copies(docs, rates, n).select(
        "doc_id", size.alias("size"), F.col("_mix_size").alias("source_size"), F.col("_mix_target").alias("target"), (size * F.col("_mix_copies")).alias("taken"), F.col("_mix_copies").alias("copies")
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it.

    Null texts have no words and a null source is a source; a source without
    words has target 0, so its rows go.  Equal rows decide alike.  All columns
    stay as they are.  An empty table gives an empty result.
    """
    rates, n = plan(docs, **how)
    out = _copies(packed(docs, "doc_id", "source"), rates, n).where("_mix_copies > 0")
    return out.withColumn("_mix_k", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select("_row.*")
