"""Operator 1: exact metric range join of embeddings.

Vectors are compared within a group (label and dimension).  On the unit sphere
cosine >= t is a chord of at most r = sqrt(2 - 2t), a metric.  Each group has
its own pivots, about sqrt(n) / 4 of its vectors (two from ``TWO`` vectors on),
one of least hash to each of as many salts.  They partition the group: a vector
is at home with its nearest pivot p.  If y is at home with q and |x - y| <= r,
then |x - q| <= |x - p| + 2r by the triangle inequality; in the Euclidean form
the sharper bound x.p - x.q <= r * |p - q| holds, and x is replicated to just
those cells.  Every partner of a home vector is thus in its cell, and cells
join independently.

Equal vectors of a group are one class with a weight, so copies cost one
aggregation.  Rows meet their group's pivots in chunks of about ``CHUNK``, and
a cell of more than ``BLOCK`` vectors is cut into blocks of home rows and blocks
of members: every task is bounded.  Pairs are counted inside a task and never
leave it: it returns link counts and the edges of a spanning forest.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from spanloom.llm.common import materialize, release, small_side
from spanloom.llm.graph import connected_components

THRESHOLD = 0.98
TWO = 32
CHUNK = 4096
BLOCK = 4096
#: More pivots would cost more to ship than they save; no vector is lost by it.
MAX_PIVOTS = 1024
_EPS = 1e-9


def _units(col: pd.Series) -> np.ndarray:
    x = np.stack(col.to_numpy()).astype(np.float64)
    # scaled first, so that no square over- or underflows
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def keyed(vectors: DataFrame, group: str) -> DataFrame:
    """(id, grp, dim, c1, c2, e) of all rows; the keys of those that cannot
    link are null.  c1 and c2 are 128 bits of hash of the components."""
    e = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & F.col(group).isNotNull() & e.isNotNull() & (F.size(e) > 0)
    usable = usable & ~F.exists(e, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))) & F.exists(e, lambda x: x != 0.0)
    only = lambda c: F.when(usable, c)
    return vectors.select(
        F.col("vec_id").cast("long").alias("id"), only(F.col(group).cast("string")).alias("grp"), only(F.size(e)).alias("dim"),
        only(F.xxhash64(F.lit(1), e)).alias("c1"), only(F.xxhash64(F.lit(2), e)).alias("c2"), e.alias("e"),
    )


def pivots_of(rows: DataFrame) -> DataFrame:
    """(grp, dim, e): the pivots of each group of ``rows`` (id, grp, dim, e, k),
    k salts to a group; distinct."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(7)), F.col("k")))
    least = salted.groupBy("grp", "dim", "salt").agg(F.min_by("e", F.struct(F.xxhash64("id", F.lit(8)), "id")).alias("e"))
    return least.select("grp", "dim", "e").distinct()


def cells_of(x: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and a mask (vector, cell) of the cells
    that may hold the home of a partner within ``r``, its own included."""
    dots = x @ pivots.T
    home = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T))
    return home, dots[np.arange(len(x)), home][:, None] - dots <= r * apart[home] + _EPS


def _assign(r: float):
    def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in ("id", "grp", "dim", "w", "home", "cells", "e")})
        # every chunk of a group sees the pivots in one order
        p = _units(pivots.sort_values("p", ignore_index=True)["e"])
        home, near = cells_of(_units(rows["e"]), p, r)
        return pd.DataFrame({"id": rows["id"], "grp": rows["grp"], "dim": rows["dim"], "w": rows["w"], "home": home, "cells": [np.flatnonzero(m).astype(np.int32) for m in near], "e": rows["e"]})

    return run


def _forest(n: int, chunks) -> np.ndarray:
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for rows, hit in chunks:
        for k in np.flatnonzero(hit.any(axis=1)):
            tops = {find(int(j)) for j in np.unique(root[np.flatnonzero(hit[k])])} | {find(int(rows[k]))}
            low = min(tops)
            for t in tops:
                root[t] = low
    return np.array([find(i) for i in range(n)], np.int64) if n else root


def _compare(threshold: float):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        h, m = p[p["side"] == 0], p[p["side"] == 1]
        if not len(h) or not len(m):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        x, y, hid, mid, w = _units(h["e"]), _units(m["e"]), h["id"].to_numpy(), m["id"].to_numpy(), m["w"].to_numpy(np.int64)
        count, ids = np.zeros(len(x), np.int64), np.concatenate([hid, mid])
        step = max(1, (1 << 23) // len(y))

        def chunks():
            for at in range(0, len(x), step):
                own = hid[at : at + step, None] == mid[None, :]
                hit = (x[at : at + step] @ y.T >= threshold) | own
                count[at : at + step] = hit @ w
                yield np.arange(at, at + len(hit)), np.pad(hit & ~own, ((0, 0), (len(x), 0)))

        root = _forest(len(ids), chunks())
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        to = least[root]
        star = ids != to
        some = count > 0
        return pd.concat([pd.DataFrame({"a": hid[some], "b": hid[some], "n": count[some]}), pd.DataFrame({"a": ids[star], "b": to[star], "n": np.zeros(int(star.sum()), np.int64)})])

    return run


def assigned(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``classes`` (id, grp, dim, w, e) with ``home`` and ``cells``, by pivots."""
    key = ["grp", "dim"]
    n = F.col("n")
    k = F.when(n < TWO, 1).otherwise(F.least(F.greatest(F.ceil(F.sqrt(n) / 4), F.lit(2)), F.lit(MAX_PIVOTS)))
    sizes = materialize(classes.groupBy(*key).agg(F.count("*").alias("n")).select(*key, k.cast("int").alias("k"), F.ceil(n / CHUNK).cast("int").alias("chunks")), "groups")
    sized = classes.join(small_side(sizes, sizes.count()), key)
    found = pivots_of(sized.where("k > 1"))
    # at most MAX_PIVOTS rows to a group
    found = materialize(found.withColumn("p", F.row_number().over(Window.partitionBy(*key).orderBy("e"))), "pivots")
    spread = found.join(small_side(sizes, sizes.count()), key).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*key, "chunk", "p", "e")
    r = sqrt(max(0.0, 2 - 2 * threshold))
    kind = dict(classes.dtypes)["e"]
    chunked = sized.where("k > 1").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(9)), F.col("chunks")).cast("int"))
    many = chunked.groupBy(*key, "chunk").cogroup(spread.groupBy(*key, "chunk")).applyInPandas(_assign(r), f"id long, grp string, dim int, w long, home int, cells array<int>, e {kind}")
    one = sized.where("k = 1").select("id", *key, "w", F.lit(0).alias("home"), F.array(F.lit(0)).alias("cells"), "e")
    return many.unionByName(one)


def range_join(classes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links, edges): links(id, n), the weight of all classes linked with each
    class and its own, and edges(a, b) of a spanning forest."""
    rows = materialize(assigned(classes, threshold), "cells")
    key = ["grp", "dim", "cell"]
    each = rows.select("id", "grp", "dim", "home", F.explode("cells").alias("cell"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    sizes = each.groupBy(*key).agg(blocks(F.count("*")).alias("nm"), blocks(F.count_if(F.col("home") == F.col("cell"))).alias("nh")).where("nh > 0")
    sizes = materialize(sizes, "sizes")
    sizes = small_side(sizes, sizes.count())
    part = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = rows.withColumn("cell", F.col("home")).join(sizes, key).select(*key, part(11, "nh").alias("hb"), all_of("nm").alias("mb"), F.lit(0).alias("side"), "id", "w", "e")
    members = rows.withColumn("cell", F.explode("cells")).join(sizes, key).select(*key, all_of("nh").alias("hb"), part(11, "nm").alias("mb"), F.lit(1).alias("side"), "id", "w", "e")
    found = materialize(homes.unionByName(members).groupBy(*key, "hb", "mb").applyInPandas(_compare(threshold), "a long, b long, n long"), "links")
    release(rows)
    links = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    return links, found.where("a <> b").select("a", "b")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, group: str = "label") -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) for each vector.

    Null, zero and empty vectors, those with null or non-finite components and
    those without a label link with nothing; a null vec_id has a null
    component and is kept.  Vectors of different dimension never link.  Equal
    rows that repeat a vec_id each count as a vector; different vectors of one
    vec_id count their links together if it is the least of their copies.
    Extra columns are ignored; an empty table gives an empty result.
    """
    key = ["grp", "dim", "c1", "c2"]
    rows = keyed(vectors, group)
    classes = rows.where("c1 IS NOT NULL").groupBy(*key).agg(F.min("id").alias("id"), F.count("*").alias("w"), F.first("e").alias("e"))
    classes = materialize(classes, "classes")
    links, edges = range_join(classes.select("id", "grp", "dim", "w", "e"), threshold)
    comp = connected_components(edges).withColumnRenamed("node", "id")
    found = classes.select(*key, F.col("id").alias("first")).join(links.withColumnRenamed("id", "first"), "first", "left").join(comp.withColumnRenamed("id", "first"), "first", "left")
    # written, so that the rows of a hot class are split by AQE
    found = materialize(found.select(*key, "n", F.coalesce("component", "first").alias("component")), "found")
    return (
        rows.drop("e").join(found, key, "left")
        .select(F.col("id").alias("vec_id"), F.coalesce(F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
