"""Operator 4: near duplicates by order MinHash, verified by banded alignment.

Each of ``SKETCHES`` repetitions samples the ``PICKS`` least labelled
five-word shingles under its own hash and keeps them in text order; the key is
a hash of that sequence.  Texts that share a key in some repetition are
candidates.  At a similarity of 0.8 a pair shares a given key with probability
0.8**6 = 0.26 or so and misses all 40 with probability under 1e-5.  Six of few
shingles are almost the whole text, so texts of up to ``SHORT`` shingles also
get ``SHORT_SKETCHES`` keys of ``SHORT_PICKS`` shingles; any pair of which one
text has up to 12 shares these (at least 0.4 each, all missed: 5e-6).

Verification aligns the two shingle sequences inside a band: the similarity is
m / (a + b - m) for the m shingles that stand in the same order in both texts.
A pair of similarity s cannot leave the band of
max(a, b) - s / (1 + s) * (a + b) positions.  Labels serve the keys and the
count of shared shingles only: an edit in an early copy of a repeated line
shifts the labels of all later ones, so the best alignment is the longest
common subsequence of the shingles without labels.  Where no shingle between
the texts' equal ends repeats, that is a longest increasing subsequence of
positions.

Equal texts form classes first, and only class representatives are sketched
against each other, so a group of copies costs one aggregation.  Within a
bucket every member is compared with its ``CENTERS`` members of highest degree.
Buckets whose other members these leave in different components are compared
whole, in pairs of blocks: one bounded task counts shared shingles, aligns
where the count allows the similarity, and returns the edges of a forest.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.llm.common import SIMILARITY, labelled, labelled_shingles, materialize, mix, occurrence, packed, plain_shingles, release, signed, small_side, words
from spanloom.llm.graph import connected_components

SKETCHES = 40
PICKS = 6
SHORT = 15
SHORT_SKETCHES = 24
SHORT_PICKS = 3
CENTERS = 8
BLOCK = 512
SALTS = 32
#: Ids from here on stand for rows without one.
NO_ID = 1 << 62

_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_AT_ONCE = 1 << 18
_COLUMNS = 8192


def _picks(row: np.ndarray, k: int) -> np.ndarray:
    return np.sort(np.argpartition(row, k - 1)[:k]) if len(row) > k else np.arange(len(row))


def order_minhash(shingles: np.ndarray) -> np.ndarray:
    """One key for each repetition, and the keys of short texts after these; an
    empty text has none."""
    n = len(shingles)
    if not n:
        return np.empty(0, np.int64)
    k = min(PICKS, n)
    out = np.zeros(SKETCHES, np.uint64)
    step = max(1, _AT_ONCE // n)
    for at in range(0, SKETCHES, step):
        seeds = _SEEDS[at : at + step, None]
        x = shingles[None, :] * seeds
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        if n > 64:
            # the k least are all among those under a cut that holds at least k of each row
            cut = np.uint64(min(2**64 - 1, int(2**64 * (4 * k + 12) / n)))
            r, c = np.nonzero(x < cut)
            held = np.bincount(r, minlength=len(x))
            ends = np.cumsum(held)
            for i in range(len(x)):
                if held[i] < k:
                    out[at + i] = _key(shingles, _picks(x[i], k))
                else:
                    own = c[ends[i] - held[i] : ends[i]]
                    out[at + i] = _key(shingles, own[_picks(x[i, own], k)])
        else:
            for i in range(len(x)):
                out[at + i] = _key(shingles, _picks(x[i], k))
    if n <= SHORT:
        # all repetitions of a short text were hashed at once
        few = [_key(shingles, _picks(row, min(SHORT_PICKS, n))) for row in x[:SHORT_SKETCHES]]
        out = np.concatenate([out, np.array(few, np.uint64)])
    return signed(out)


def _key(shingles: np.ndarray, at: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles[at].tobytes())


def _increasing(to: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    if np.all(to[1:] > to[:-1]):
        return len(to)
    tails: list[int] = []
    for v in to.tolist():
        p = bisect_left(tails, v)
        if p == len(tails):
            tails.append(v)
        else:
            tails[p] = v
    return len(tails)


def _common(x: list[int], y: list[int], band: int) -> int:
    """Length of the longest common subsequence inside the band, bit-parallel.

    Bit p of ``v`` is zero where the row's length grows at position p of y.
    ``v`` holds positions ``lo`` to ``hi`` only: those before the band do not
    change any more, and those beyond it are ones still.
    """
    at: dict[int, list[int]] = {}
    for p, s in enumerate(y):
        at.setdefault(s, []).append(p)
    held: dict[int, tuple[int, int, int]] = {}
    v, lo, hi, done = 0, 0, 0, 0
    for i, s in enumerate(x):
        where = at.get(s)
        if where is None:
            continue
        top, low = min(len(y), i + band + 1), min(len(y), max(0, i - band))
        if top > hi:
            v |= ((1 << (top - hi)) - 1) << (hi - lo)
            hi = top
        if low > lo:
            done += low - lo - (v & ((1 << (low - lo)) - 1)).bit_count()
            v >>= low - lo
            lo = low
        if len(where) <= 8:
            met = sum(1 << (p - lo) for p in where if lo <= p < hi)
        else:
            # the positions of a frequent shingle move along with the band
            met, old, k = held.get(s, (0, lo, bisect_left(where, lo)))
            met >>= lo - old
            while k < len(where) and where[k] < hi:
                if where[k] >= lo:
                    met |= 1 << (where[k] - lo)
                k += 1
            held[s] = (met, lo, k)
        u = v & met
        v = (v + u) | (v - u)
        if v.bit_length() > hi - lo:
            v ^= 1 << (hi - lo)
    return done + hi - lo - v.bit_count()


def aligned_similarity(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two shingle sequences; 0.0 where under ``least``.

    Two empty sequences are equal (1.0).
    """
    a, b = len(x), len(y)
    if not a and not b:
        return 1.0
    need = ceil(least * (a + b) / (1 + least) - 1e-9)
    if min(a, b) < need:
        return 0.0
    band = max(a, b) - need
    # some best alignment keeps the equal ends
    n = min(a, b)
    unlike = np.flatnonzero(x[:n] != y[:n])
    head = int(unlike[0]) if len(unlike) else n
    unlike = np.flatnonzero(x[a - n + head :][::-1] != y[b - n + head :][::-1])
    tail = int(unlike[0]) if len(unlike) else n - head
    x, y = x[head : a - tail], y[head : b - tail]
    m = head + tail
    if len(x) and len(y):
        lx, ly = labelled(x), labelled(y)
        order = np.argsort(ly)
        ranked = ly[order]
        at = np.minimum(np.searchsorted(ranked, lx), len(ly) - 1)
        same = np.flatnonzero(ranked[at] == lx)
        if m + len(same) < need:
            return 0.0
        to = order[at[same]]
        near = _increasing(to[np.abs(to - same) <= band])
        if near < len(same) and (occurrence(x).any() or occurrence(y).any()):
            near = _common(x.tolist(), y.tolist(), band)
        m += near
    s = m / (a + b - m)
    return s if s >= least - 1e-12 else 0.0


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, keys = [], []
        for text in batch.column(3):
            s = labelled_shingles(words(text.as_py()))
            size.append(len(s))
            keys.append(order_minhash(s).tolist())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "hi", "lo", "size", "keys"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def shingles(t: str | None) -> np.ndarray:
        t = t or ""
        if t not in held:
            if len(held) > 64:
                held.clear()
            held[t] = plain_shingles(words(t))
        return held[t]

    for batch in batches:
        a, b, s = [], [], []
        for i in range(batch.num_rows):
            sim = aligned_similarity(shingles(batch.column(2)[i].as_py()), shingles(batch.column(3)[i].as_py()))
            if sim:
                a.append(batch.column(0)[i].as_py())
                b.append(batch.column(1)[i].as_py())
                s.append(sim)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])


def _buckets(classes: DataFrame) -> DataFrame:
    """(r, key, id, size, n, degree): the members of all keys that several
    classes share, n to a bucket; degree sums n over a member's buckets."""
    rows = classes.where("size > 0").select("id", "size", F.posexplode("keys").alias("r", "key"))
    # written, as a count and a join in one stage share an exchange, and AQE then
    # does not split a hot key; hashing the few shared keys needs no sort of all
    shared = materialize(rows.groupBy("r", "key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = materialize(rows.join(shared.hint("shuffle_hash"), ["r", "key"]), "buckets")
    release(shared)
    return met.join(met.groupBy("id").agg(F.sum("n").alias("degree")), "id")


def _centers(members: DataFrame, most: int) -> DataFrame:
    """The first ``most`` members (r, key, c, c_size, c_component) of each
    bucket: those outside its largest component, then by degree.  Salts keep a
    hot bucket from being sorted in one task."""
    first = ["inner", F.col("degree").desc(), F.col("id")]
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    some = members.withColumn("salt", salt).withColumn("k", F.row_number().over(Window.partitionBy("r", "key", "salt").orderBy(*first))).where(F.col("k") <= most)
    best = some.withColumn("k", F.row_number().over(Window.partitionBy("r", "key").orderBy(*first))).where(F.col("k") <= most)
    return best.select("r", "key", F.col("id").alias("c"), F.col("size").alias("c_size"), F.col("component").alias("c_component"))


def _pairs(members: DataFrame, centers: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a member and a centre of its bucket that no
    component joins yet and whose sizes allow the similarity."""
    near = members.join(centers, ["r", "key"]).where(
        (F.col("component") != F.col("c_component")) & (F.least("size", "c_size") >= SIMILARITY * F.greatest("size", "c_size") - 1e-9)
    )
    return near.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()


def _open(members: DataFrame, centers: DataFrame, comp: DataFrame) -> DataFrame:
    """What is left to compare: the members that were no centres, of buckets in
    which these belong to several components."""
    left = members.drop("component", "inner").join(centers.select("r", "key", F.col("c").alias("id")), ["r", "key", "id"], "left_anti")
    left = left.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = left.groupBy("r", "key", "component").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("r", "key").agg(F.max(F.struct("m", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    mixed = materialize(mixed.select("r", "key", "main"), "mixed")
    return left.join(small_side(mixed, mixed.count()), ["r", "key"]).withColumn("inner", F.col("component") == F.col("main")).drop("main")


def _shared_counts(own: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many shingles each text of rows ``x`` shares with each of rows ``y``."""
    out = np.zeros((len(x), len(y)), np.float32)
    row = np.repeat(np.arange(len(own)), [len(o) for o in own])
    _, col, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    rank = np.cumsum(n > 1) - 1
    some = n[col] > 1
    row, col = row[some], rank[col[some]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, _COLUMNS):
        lo, hi = np.searchsorted(col, [at, at + _COLUMNS])
        held = np.zeros((len(own), _COLUMNS), np.float32)
        held[row[lo:hi], col[lo:hi] - at] = 1
        out += held[x] @ held[y].T
    return out


def _compare_block(p: pd.DataFrame) -> pd.DataFrame:
    """Edges of a forest over the components that similar texts of one pair of
    blocks join."""
    plain = [plain_shingles(words(t)) for t in p["text"]]
    own = [labelled(s) for s in plain]
    comp, size = p["component"].tolist(), np.array([len(o) for o in own])
    x, y = np.flatnonzero(p["home"]), np.flatnonzero(p["member"])
    edges: list[tuple[int, int]] = []
    if len(x) and len(y):
        both = size[x][:, None] + size[y][None, :]
        # an alignment keeps at most the shared shingles
        rows, cols = np.nonzero(_shared_counts(own, x, y) >= SIMILARITY / (1 + SIMILARITY) * both - 1e-6)
        root = {c: c for c in comp}
        for i, j in zip(x[rows].tolist(), y[cols].tolist()):
            a, b = comp[i], comp[j]
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b and aligned_similarity(plain[i], plain[j]):
                root[max(a, b)] = min(a, b)
                edges.append((comp[i], comp[j]))
    return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")


def _block_links(members: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) between components of open members of a bucket: those outside its largest component against all, in pairs of blocks of
    ``BLOCK`` texts, each one bounded task that returns a forest, never pairs."""
    sizes = members.groupBy("r", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nm"), F.ceil(F.count(F.when(~F.col("inner"), 1)) / BLOCK).cast("int").alias("nh"))
    sizes = materialize(sizes, "sizes")
    own = members.join(small_side(sizes, sizes.count()), ["r", "key"]).withColumn("h", F.pmod(F.xxhash64("id", F.lit(17)), F.col("nh"))).withColumn("m", F.pmod(F.xxhash64("id", F.lit(19)), F.col("nm")))
    as_member = own.withColumn("hb", F.explode(F.sequence(F.lit(0), F.col("nh") - 1))).select(
        "r", "key", "hb", F.col("m").alias("mb"), "id", "component", (~F.col("inner") & (F.col("h") == F.col("hb"))).alias("home"), F.lit(True).alias("member")
    )
    as_home = own.where(~F.col("inner") & (F.col("nm") > 1)).withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("nm") - 1))).where(F.col("mb") != F.col("m"))
    as_home = as_home.select("r", "key", F.col("h").alias("hb"), "mb", "id", "component", F.lit(True).alias("home"), F.lit(False).alias("member"))
    rows = as_member.unionByName(as_home).withColumn("hb", F.col("hb").cast("int")).withColumn("mb", F.col("mb").cast("int"))
    rows = materialize(rows, "blocks")
    return known.join(small_side(rows, rows.count()), "id").groupBy("r", "key", "hb", "mb").applyInPandas(_compare_block, "a long, b long")


def link_classes(classes: DataFrame, known: DataFrame) -> DataFrame:
    """Components (node, component) of the classes that share a bucket and are
    similar: first by the centres of each bucket, then, for buckets whose other
    members these leave in several components, by blocks."""
    members = _buckets(classes).withColumn("component", F.col("id")).withColumn("inner", F.lit(False))
    centers = materialize(_centers(members, CENTERS), "centers")
    pairs = materialize(_pairs(members, centers), "pairs")
    links = materialize(_verified(pairs, known).select("a", "b"), "links")
    comp = materialize(connected_components(links), "components")
    # a bucket of one more member than centres is done
    rest = materialize(_open(members.where(F.col("n") > CENTERS + 1), centers, comp), "open")
    if rest.isEmpty():
        return comp
    more = materialize(_block_links(rest, known).distinct(), "more")
    if more.isEmpty():
        return comp
    # only the components that are joined further take part again
    top = materialize(connected_components(more), "tops")
    alone = top.join(comp.select("node"), "node", "left_anti")
    joined = comp.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    return joined.select("node", F.coalesce("top", "component").alias("component")).union(alone.select("node", "component"))


def _verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    both = (
        pairs.join(known.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
        .join(known.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    return both.mapInArrow(_verify, "a long, b long, similarity double")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _row_key() -> tuple[Column, Column, Column]:
    hi, lo = F.xxhash64(F.lit(1), _text()), F.xxhash64(F.lit(2), _text())
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(lo, F.lit(NO_ID - 1))), hi, lo


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(id, hi, lo, text) of all rows: the doc_id, and 128 bits of hash of the
    text (null counts as empty).  A row without a doc_id gets one from its text,
    ``NO_ID`` or more."""
    ident, hi, lo = _row_key()
    return docs.select(ident.alias("id"), hi.alias("hi"), lo.alias("lo"), _text().alias("text"))


def _grouped(docs: DataFrame) -> DataFrame:
    """(id, hi, lo, class_id, component) of the distinct rows of ``docs``."""
    known = keyed_rows(docs)
    each = materialize(known.mapInArrow(_sketch, "id long, hi long, lo long, size long, keys array<long>"), "sketches")
    firsts = each.groupBy("hi", "lo").agg(F.min(F.struct("id", "size", "keys")).alias("f")).select("hi", "lo", "f.*")
    classes = materialize(firsts, "classes")
    comp = link_classes(classes, known.select("id", "text"))
    member = each.select("id", "hi", "lo").distinct().join(classes.select("hi", "lo", F.col("id").alias("class_id")), ["hi", "lo"])
    return member.join(comp.withColumnRenamed("node", "class_id"), "class_id", "left").select("id", "hi", "lo", "class_id", F.coalesce("component", "class_id").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row (doc_id, class_id, component_id, kept) per document.

    ``class_id`` is the least doc_id with an equal text (null counts as
    empty), ``component_id`` the least doc_id that links reach.  Texts without words
    are equal to each other only if their characters are.  Rows without a
    doc_id are compared as all others; equal ones count as one, and come back
    with a null doc_id (and null ids of a group in which no row has one).
    Repeated rows of one doc_id with different texts are linked through that
    id.  Extra columns are ignored.  An empty table gives an empty result.
    """
    rows = _grouped(docs).groupBy("id").agg(F.min("class_id").alias("class_id"), F.min("component").alias("component"))
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return rows.select(real("id").alias("doc_id"), real("class_id").alias("class_id"), real("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, the row of the least doc_id.

    Rows without a doc_id come after all others of their group.  Of rows that
    repeat a kept doc_id the one stays whose text has the least hash; equal
    ones collapse, so reruns agree.
    """
    rows = _grouped(docs).groupBy("id").agg(F.min("component").alias("component"), F.min(F.struct("hi", "lo")).alias("f"))
    keep = materialize(rows.where("id = component").select(F.col("id").alias("_k"), F.col("f.hi").alias("_hi"), F.col("f.lo").alias("_lo")), "kept")
    marked = packed(docs, *[c.alias(n) for c, n in zip(_row_key(), ("_k", "_hi", "_lo"))])
    chosen = marked.join(keep, ["_k", "_hi", "_lo"], "left_semi")
    again = marked.groupBy("_k", "_hi", "_lo").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    again = materialize(again, "again")
    n = again.count()
    once = chosen.join(small_side(again, n), ["_k", "_hi", "_lo"], "left_anti")
    twice = chosen.join(small_side(again, n), ["_k", "_hi", "_lo"], "left_semi").dropDuplicates(["_k", "_hi", "_lo"])
    return once.unionByName(twice).select("_row.*")
