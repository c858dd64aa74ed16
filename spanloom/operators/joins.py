"""Range, nearest and as-of joins over keyed timelines.

Every join carries the timeline's key as an equality, so that it plans as a
hash or sort-merge join.  ``interval_join`` adds time buckets: a timeline of
any length then splits over tasks, and AQE splits what is still hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def interval_join(left: DataFrame, right: DataFrame, key: list[str], bucket: int, left_cols: tuple[str, str] = ("a", "b"), right_cols: tuple[str, str] = ("ra", "rb"), how: str = "inner") -> DataFrame:
    """Pairs of strictly overlapping intervals of one key.

    Both sides are laid out over buckets of ``bucket`` units; a pair that
    meets in several is kept in the first one that both reach.  ``how`` may
    be ``inner`` or ``left`` (left rows need not be distinct).
    """
    (la, lb), (ra, rb) = left_cols, right_cols
    width = F.lit(bucket)

    def lay(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
        first, last = F.floor(F.col(a) / width), F.greatest(F.floor(F.col(a) / width), F.ceil(F.col(b) / width) - 1)
        return df.withColumn(name, F.explode(F.sequence(first, last)))

    tagged = left.withColumn("_row", F.monotonically_increasing_id()) if how == "left" else left
    l, r = lay(tagged, la, lb, "_bucket"), lay(right, ra, rb, "_bucket")
    met = l.join(r, [*key, "_bucket"]).where((F.col(la) < F.col(rb)) & (F.col(ra) < F.col(lb)) & (F.col("_bucket") == F.floor(F.greatest(F.col(la), F.col(ra)) / width)))
    if how != "left":
        return met.drop("_bucket")
    extra = [c for c in right.columns if c not in key]
    return tagged.join(met.select("_row", *extra), "_row", "left").drop("_row")


def nearest_join(left: DataFrame, right: DataFrame, key: list[str], left_at: str, right_at: str, tolerance: float | None, tie: list[str]) -> DataFrame:
    """Each left row with its nearest right row of the key, |difference| at
    most ``tolerance`` (inclusive); ties go to the least of ``tie``; left rows
    without one stay, with nulls.

    The nearest row is the last before or the first after: two as-of joins
    with the best row of each place, linear in both sides.
    """
    cols = [c for c in right.columns if c not in key]
    order = F.struct(*[F.col(t) for t in tie])
    places = right.where(F.col(right_at).isNotNull()).groupBy(*key, F.col(right_at).alias("_place")).agg(F.min_by(F.struct(*cols), order).alias("_r"))
    met = left
    for name, direction in (("_b", "backward"), ("_f", "forward")):
        met = asof_join(met, places.withColumnsRenamed({"_place": f"_p{name}", "_r": name}), key, left_at, f"_p{name}", direction)

    def candidate(name: str) -> Column:
        away = F.abs(F.col(left_at) - F.col(f"_p{name}"))
        near = away.isNotNull() if tolerance is None else away <= tolerance
        return F.when(near, F.struct(away.alias("away"), *[F.col(f"{name}.{t}").alias(f"t{k}") for k, t in enumerate(tie)], F.col(name).alias("r")))

    best = F.least(candidate("_b"), candidate("_f"))
    return met.withColumn("_best", best["r"]).select(*left.columns, *[F.col(f"_best.{c}").alias(c) for c in cols])


def asof_join(left: DataFrame, right: DataFrame, key: list[str], left_at: str, right_at: str, direction: str = "backward") -> DataFrame:
    """Each left row with the last right row at or before it (``backward``) or
    the first at or after it (``forward``).

    One union and one running window, no pairs: linear in both sides.
    """
    cols = [c for c in right.columns if c not in key]
    kind = lambda df, names: df.select(F.struct(*names).alias("x")).schema["x"].dataType
    l = left.select(*key, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(kind(right, cols)).alias("_r"))
    r = right.select(*key, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(kind(left, left.columns)).alias("_l"), F.struct(*cols).alias("_r"))
    # both directions run over rows already seen: a frame that reaches ahead would be read again for each row
    at = F.col("_at") if direction == "backward" else F.col("_at").desc()
    w = Window.partitionBy(*key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_found", F.last("_r", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
    return both.select("_l.*", *[F.col(f"_found.{c}").alias(c) for c in cols])


def point_in_interval(points: DataFrame, regions: DataFrame, key: list[str], at: str, a: str = "ra", b: str = "rb") -> DataFrame:
    """Points with the region [a, b) that holds them, by as-of on the start:
    regions of one key must not overlap."""
    met = asof_join(points, regions, key, at, a)
    cols = [c for c in regions.columns if c not in key]
    inside = F.col(at) < F.col(b)
    return met.select(*points.columns, *[F.when(inside, F.col(c)).alias(c) for c in cols])


def full_diff(left: DataFrame, right: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """Rows of a manifest comparison, (key, state): missing, extra, or the name
    of the first column that differs; equal rows are left out."""
    l = left.select(*key, *[F.col(c).alias(f"_l_{c}") for c in compare], F.lit(True).alias("_inl"))
    r = right.select(*key, *[F.col(c).alias(f"_r_{c}") for c in compare], F.lit(True).alias("_inr"))
    state: Column = F.when(F.col("_inr").isNull(), F.lit("missing")).when(F.col("_inl").isNull(), F.lit("extra"))
    for c in compare:
        state = state.when(~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")), F.lit(c))
    return l.join(r, key, "full").select(*key, state.alias("state")).where(F.col("state").isNotNull())
