"""Sentences of recordings with the tokens that they hold, one recording at a time.

A recording's text is one value, so its tokens travel with it as one array:
sentences and tokens meet in one Arrow pass, linear in both, and no row per
token is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanloom.operators.align import MAX_GAP, REPAIR_GATE

LETTER = r"[\p{L}\p{N}]"
#: Tokens and characters that are worked on at once, but for one larger recording.
STRETCH = 1_000_000
#: Flags of a boundary, by bit.
BOUNDARY_FLAGS = [
    "source_chunk_boundary_not_sentence_boundary", "missing_adjacent_mapped_token", "adjacent_tokens_not_consecutive",
    "unmapped_lexical_characters_at_boundary", "adjacent_token_timing_ineligible", "adjacent_token_gap_or_overlap_unsafe",
]
_letters: list[int] = []


def packed(idx: Column, xa: Column, xb: Column, ra: Column, rb: Column, repaired: Column, flags: Column, part: Column, eligible: Column) -> Column:
    """A token as an element of the ``tokens`` of its recording."""
    named = F.coalesce(flags, F.array().cast("array<string>"))
    return F.struct(
        idx.cast("long").alias("idx"), xa.cast("long").alias("xa"), xb.cast("long").alias("xb"), ra.cast("double").alias("ra"), rb.cast("double").alias("rb"), repaired.alias("repaired"),
        (F.size(named) > 0).alias("marked"), F.array_contains(named, "raw_nonmonotonic_sequence").alias("disorder"), F.array_contains(named, "alignment_chunk_repair_gate").alias("child_gate"),
        part.cast("long").alias("part"), F.coalesce(eligible, F.lit(True)).alias("eligible"),
    )


def pack_tokens(tokens: DataFrame) -> DataFrame:
    """(rec, tokens): the rows of a recording in one array."""
    cols = ("idx", "xa", "xb", "ra", "rb", "repaired", "flags", "part", "eligible")
    return tokens.groupBy("rec").agg(F.collect_list(packed(*map(F.col, cols))).alias("tokens"))


def letter_edges(spark: SparkSession) -> list[int]:
    """Code points at which letters and numbers begin and end, as Spark's own
    expressions have them: Python knows another version of Unicode."""
    if not _letters:
        char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
        is_letter = lambda c: F.when((c < 0) | c.between(0xD800, 0xDFFF), F.lit(False)).otherwise(char(c).rlike(LETTER))
        edges = spark.range(0x110000).where(is_letter(F.col("id")) != is_letter(F.col("id") - 1)).collect()
        _letters.extend(sorted(r["id"] for r in edges))
    return list(_letters)


def _parts(column: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Elements of each row of a column of arrays of structs; their fields."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    held = column.flatten()
    return n, {f.name: c for f, c in zip(held.type, held.flatten())}


def _plain(column: pa.Array, fill: object) -> np.ndarray:
    return pc.fill_null(column, fill).to_numpy(zero_copy_only=False)


def _known(column: pa.Array) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False)


def _limit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of comparison: NaN exceeds all numbers, as in Spark."""
    x = _plain(column, np.nan).astype(float)
    return x, np.where(np.isnan(x) & _known(column), np.inf, x)


def _before(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _stretch(batch: pa.RecordBatch, letters: np.ndarray, composite: bool) -> pa.RecordBatch:
    col = dict(zip(batch.schema.names, batch.columns))
    rows = batch.num_rows
    # sentences: [a, b) in their text, [at, to) among all characters of the stretch
    n_said, said = _parts(col["said"])
    row = np.repeat(np.arange(rows), n_said)
    m = len(row)
    edge = _before(pc.utf8_length(said["sentence"]).to_numpy(zero_copy_only=False).astype(np.int64))
    first = _before(n_said)
    base, size = edge[first[:-1]], edge[first[1:]] - edge[first[:-1]]
    at, to = edge[:-1], edge[1:]
    a, b = at - base[row], to - base[row]
    split_a, split_b = _plain(said["split_a"], False), _plain(said["split_b"], False)
    chars = np.frombuffer("".join(said["sentence"].to_pylist()).encode("utf-32-le"), np.uint32)
    letter = letters[chars]
    # places of a recording have keys of their own, one past the end of the text included
    key = base + 2 * np.arange(rows)
    ka, kb = key[row] + a, key[row] + b

    duration, ends = _limit(col["duration"])
    r_start, r_end, r_upto = np.zeros(m), duration[row], ends[row]
    no_start, no_end, inside = np.zeros(m, bool), ~_known(col["duration"])[row], np.ones(m, bool)
    if composite:
        n_area, area = _parts(col["regions"])
        a_row, xa, xb = np.repeat(np.arange(rows), n_area), _plain(area["xa"], -1), _plain(area["xb"], -1)
        start, (end, upto) = _plain(area["start"], np.nan).astype(float), _limit(area["end"])
        order = np.lexsort((xa, a_row))
        j = np.searchsorted((key[a_row] + np.clip(xa, 0, size[a_row] + 1))[order], ka, "right") - 1
        hit = np.concatenate([order, [0]])[j]
        inside = (j >= 0) & (len(order) > 0)
        if len(order):
            inside &= (a_row[hit] == row) & (a < xb[hit])
            r_start, r_end, r_upto = start[hit], end[hit], upto[hit]
            no_start, no_end = ~_known(area["start"])[hit], ~_known(area["end"])[hit]

    # tokens in their order
    n_held, held = _parts(col["tokens"])
    t_row = np.repeat(np.arange(rows), n_held)
    repaired = _plain(held["repaired"], False)
    counted = np.bincount(t_row, _known(held["repaired"]), rows) > 0
    gated = ~counted
    if not composite:
        gated |= np.bincount(t_row, repaired, rows) / np.maximum(n_held, 1) > REPAIR_GATE
    idx = _plain(held["idx"], -1)
    keep = np.flatnonzero(_known(held["xa"]) & _known(held["xb"]))
    if np.any((np.diff(t_row[keep]) == 0) & (np.diff(idx[keep]) < 0)):
        keep = keep[np.lexsort((idx[keep], t_row[keep]))]
    t_row, idx, repaired = t_row[keep], idx[keep], repaired[keep]
    get = lambda name, fill: _plain(held[name], fill)[keep]
    xa, xb = (np.clip(get(c, 0), 0, size[t_row] + 1) for c in ("xa", "xb"))
    ra, rb = get("ra", np.nan), get("rb", np.nan)
    with np.errstate(invalid="ignore"):
        valid = np.isfinite(ra) & np.isfinite(rb) & (ra >= 0) & (ra < rb) & (rb <= ends[t_row])
    ta, tb = key[t_row] + xa, key[t_row] + xb

    # each token with the sentences that it overlaps, by sentence
    lo, hi = np.searchsorted(kb, ta, "right"), np.searchsorted(ka, tb, "left")
    met = np.maximum(hi - lo, 0)
    ti = np.repeat(np.arange(len(keep)), met)
    si = np.repeat(lo, met) + np.arange(len(ti)) - np.repeat(_before(met)[:-1], met)
    if np.any(np.diff(si) < 0):
        order = np.argsort(si, kind="stable")
        ti, si = ti[order], si[order]
    n = np.bincount(si, minlength=m)
    some, heads = n > 0, _before(n)[:-1]
    with np.errstate(invalid="ignore"):
        usable = valid[ti] & (ra[ti] >= r_start[si]) & (rb[ti] <= r_upto[si])
    falls, t_start, t_end = np.zeros(m, bool), np.full(m, np.nan), np.full(m, np.nan)
    ui, us = ti[usable], si[usable]
    down = (us[1:] == us[:-1]) & ((ra[ui[1:]] < ra[ui[:-1]]) | (rb[ui[1:]] < rb[ui[:-1]]))
    falls[us[1:][down]] = True
    t_start[some], t_end[some] = ra[ti[heads[some]]], rb[ti[heads[some] + n[some] - 1]]

    def any_token(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(m, bool)
        out[si[mask[ti]]] = True
        return out

    crosses = np.zeros(m, bool)
    part, in_part = get("part", 0), _known(held["part"])[keep]
    if in_part.any():
        pi, ps = ti[in_part[ti]], si[in_part[ti]]
        crosses[ps[1:][(ps[1:] == ps[:-1]) & (part[pi[1:]] != part[pi[:-1]])]] = True

    # letters outside of all tokens
    ca, cb = (base[t_row] + np.minimum(x, size[t_row]) for x in (xa, xb))
    real = ca < cb
    cover = np.cumsum(np.bincount(ca[real], minlength=len(chars) + 1) - np.bincount(cb[real], minlength=len(chars) + 1))[:-1]
    bare = _before(letter & (cover == 0))
    unmapped = bare[to] > bare[at]
    safe = some & (np.bincount(us, minlength=m) == n) & ~falls & ~any_token(get("disorder", False)) & ~unmapped

    # the inner ends of sentences: the last token that ends by them, the first that starts at them or later
    inner = np.concatenate([row[1:] == row[:-1], np.zeros(min(m, 1), bool)])
    by_end, by_start = np.argsort(tb, kind="stable"), np.argsort(ta, kind="stable")
    l, r = np.searchsorted(tb[by_end], kb, "right") - 1, np.searchsorted(ta[by_start], kb, "left")
    has_l, has_r = l >= 0, r < len(keep)
    if len(keep):
        l, r = by_end[np.maximum(l, 0)], by_start[np.minimum(r, len(keep) - 1)]
        has_l, has_r = has_l & (t_row[l] == row), has_r & (t_row[r] == row)
    both = has_l & has_r
    l, r = np.where(both, l, 0), np.where(both, r, 0)
    mask = np.where(split_b, 1, 0) | np.where(both, 0, 2)
    cut_at, left, right = np.full(m, np.nan), np.full(m, -1), np.full(m, -1)
    if len(keep):
        # the first word that ends behind the left token must not begin before the right one
        fresh = np.zeros(len(chars) + 1, bool)
        fresh[base] = True
        starts = np.flatnonzero(letter & (fresh[:-1] | ~np.concatenate([[False], letter[:-1]])))
        stops = np.flatnonzero(letter & (fresh[1:] | ~np.concatenate([letter[1:], [False]]))) + 1
        w = np.searchsorted(stops, cb[l], "right")
        word = np.concatenate([starts, [len(chars)]])[w] < ca[r]
        eligible = get("eligible", True) & valid
        gap = ra[r] - rb[l]
        with np.errstate(invalid="ignore"):
            wide = valid[l] & valid[r] & ((gap < 0) | (gap > MAX_GAP))
        for bit, bad in enumerate((idx[r] != idx[l] + 1, word, ~(eligible[l] & eligible[r]), wide), 2):
            mask |= np.where(both & bad, 1 << bit, 0)
        cut_at, left, right = rb[l], np.where(both, idx[l], -1), np.where(both, idx[r], -1)

    take = lambda c: pc.take(col[c], pa.array(row))
    floats = lambda x, null: pa.array(x, pa.float64(), mask=null)
    out = {
        "rec": take("rec"), "pos": pa.array(np.arange(m) - first[row], pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "split": pa.array(split_a | split_b), "sentence": said["sentence"],
        "offset": take("offset"), "duration": take("duration"), "gated": pa.array(gated[row]), "inside": pa.array(inside), "timed": pa.array(safe),
        "start": floats(np.where(safe, t_start, r_start), ~safe & no_start), "end": floats(np.where(safe, t_end, r_end), ~safe & no_end),
        "unmapped": pa.array(unmapped), "flagged": pa.array(any_token(get("marked", False) | repaired)), "child_gate": pa.array(any_token(get("child_gate", False))), "crosses": pa.array(crosses),
        "inner": pa.array(inner), "left": pa.array(left, pa.int64(), mask=left < 0), "right": pa.array(right, pa.int64(), mask=right < 0), "bits": pa.array(mask, pa.int32()), "at": floats(cut_at, ~inner | (mask != 0)),
    }
    return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out.values()], names=list(out))


def _pass(edges: list[int], composite: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.zeros(0x110000, bool)
        for lo, hi in zip(edges[::2], [*edges[1::2], 0x110000]):
            letters[lo:hi] = True
        for batch in batches:
            weight = sum(_plain(pc.list_value_length(batch.column(c)), 0).astype(np.int64) for c in ("said", "tokens")) + _plain(batch.column("n_chars"), 0)
            lots = np.cumsum(weight) // STRETCH
            cuts = [0, *(np.flatnonzero(np.diff(lots)) + 1), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    yield _stretch(batch.slice(i, j - i), letters, composite)

    return run


def placed(texts: DataFrame, said: DataFrame | None, regions: DataFrame | None) -> DataFrame:
    """One row per sentence of ``texts``, which carry their packed ``tokens``.

    (rec, pos, a, b, split, sentence, offset, duration, gated, inside, timed,
    start, end, unmapped, flagged, child_gate, crosses, inner, left, right,
    bits, at): ``inside`` a region, ``timed`` by its tokens or else by its
    region; ``left`` to ``at`` are the boundary at an ``inner`` end.
    ``said`` (rec, said) has other sentences than the column ``said``.
    """
    t = texts if said is None else texts.drop("said").join(said, "rec")
    cols = ["rec", F.col("offset").cast("double").alias("offset"), F.col("duration").cast("double").alias("duration"), "said", "tokens", F.length("text").cast("long").alias("n_chars")]
    if regions is not None:
        one = F.struct(*[F.col(c).cast(k).alias(c) for c, k in (("xa", "long"), ("xb", "long"), ("start", "double"), ("end", "double"))])
        t = t.join(regions.where("xa IS NOT NULL").groupBy("rec").agg(F.collect_list(one).alias("regions")), "rec", "left")
        cols.append("regions")
    kind = texts.select("rec").schema["rec"].dataType.simpleString()
    schema = (
        f"rec {kind}, pos int, a long, b long, split boolean, sentence string, offset double, duration double, gated boolean, inside boolean, timed boolean, start double, end double, "
        "unmapped boolean, flagged boolean, child_gate boolean, crosses boolean, inner boolean, left long, right long, bits int, at double"
    )
    return t.select(*cols).mapInArrow(_pass(letter_edges(texts.sparkSession), regions is not None), schema)
