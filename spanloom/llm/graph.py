"""Connected components over an edge table, in the alternating-star scheme."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import materialize, release


def _least(edges: DataFrame) -> DataFrame:
    """(a, m): the least neighbour of each node.  Written, or else it shares
    the exchange of the join with it, which AQE then leaves whole."""
    return materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both)
    star = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
    out = materialize(star, "edges")
    release(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    rest = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = materialize(rest.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    release(least)
    return out


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Rows (node, component) for all nodes of ``edges(a long, b long)``.

    The component is its least node.  Every round is two aggregations with
    map-side minima, written out, and two equi-joins with them, so that AQE can
    split a hub's rows.  Self loops and repeated edges are harmless, null ends
    are dropped, an empty table gives an empty result.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = lambda df: df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
    before = mark(now)
    if not before[0]:
        return spark.createDataFrame([], "node long, component long")
    for _ in range(most_rounds):
        for star in (_large_star, _small_star):
            old, now = now, star(now)
            release(old)
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
