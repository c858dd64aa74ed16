"""Text functions on columns: sentences, offsets, stamps, terms, digests."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed value: one sentence, without loss.  A full stop between digits is no end.
SENTENCE = r"""(?sU)(?:(?<=\p{Nd})\.(?=\p{Nd})|[^。？！?!.])*+(?:[。？！?!.][。？！?!.」』）)\]}”’"\s]*|$)"""
# Negations, and the pattern of numbers.
NEGATIONS = ["ない", "なく", "なかった", "ません", "ぬ", "ず", "違う", "違い", "不要", "不可能", "以外"]
NUMBER = re.compile(r"[-+]?\d+(?:[.,:/-]\d+)*(?:%)?")
NUMERIC_MARKS = ".,:-/+%"


def sentences(text: Column) -> Column:
    """The text's sentences in order; joined they are the text."""
    return F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.length(s) > 0)


def sentence_spans(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, pos, sentence, a, b): half-open code point spans of sentences."""
    out = df.select(*key, F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))
    return running_offsets(out, key, "pos", F.length("sentence"))


def running_offsets(df: DataFrame, key: list[str], order: str, length: Column, separator: int = 0) -> DataFrame:
    """``df`` with the span [a, b) of each row in the ordered concatenation."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(length + separator).over(w), F.lit(0)).cast("long")
    return df.withColumn("a", before).withColumn("b", (F.col("a") + length).cast("long"))


def word_spans(text: Column) -> Column:
    """(idx, xa, xb) of the words between single spaces; empty words count but
    have no span.  Spark has no running sum inside arrays."""

    @F.arrow_udf("array<struct<idx:int,xa:int,xb:int>>")
    def run(column: pa.Array) -> pa.Array:
        texts = [t or "" for t in column.to_pylist()]
        chars = np.frombuffer("".join(t + " " for t in texts).encode("utf-32-le"), np.uint32)
        ends = np.flatnonzero(chars == 32)
        starts = np.concatenate([[0], ends + 1])[:-1]
        base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        row = np.searchsorted(base, starts, "right") - 1
        words = np.bincount(row, minlength=len(texts))
        idx = np.arange(len(row)) - np.repeat(np.cumsum(words) - words, words)
        real = ends > starts
        fields = [pa.array(x[real], pa.int32()) for x in (idx, starts - base[row], ends - base[row])]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[real], minlength=len(texts)))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names=["idx", "xa", "xb"]))

    return run(text)


def cut_spans(df: DataFrame, key: list[str], cuts: list[DataFrame], total: Column) -> DataFrame:
    """(key, a, b) between neighbouring cuts: 0, the total, and all (key, cut)."""
    every = df.select(*key, F.explode(F.array(F.lit(0).cast("long"), total.cast("long"))).alias("cut"))
    for c in cuts:
        every = every.union(c.select(*key, F.col("cut").cast("long")))
    w = Window.partitionBy(*key).orderBy("cut")
    return every.distinct().withColumn("b", F.lead("cut").over(w)).where("b > cut").select(*key, F.col("cut").alias("a"), "b")


def stamp(seconds: Column) -> Column:
    """``mm:ss.mmm`` with unbounded minutes, milliseconds rounded half to even."""
    ms = F.bround(seconds.cast("double") * 1000).cast("long")
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60000).cast("long"), F.floor(ms / 1000).cast("long") % 60, ms % 1000)


def short_stamp(seconds: Column) -> Column:
    """``[mm:ss]``, truncated."""
    s = F.floor(seconds.cast("double")).cast("long")
    return F.format_string("[%02d:%02d]", F.floor(s / 60).cast("long"), s % 60)


def label(rank: Column) -> Column:
    """0 -> A, 1 -> B; past Z the code points go on."""
    return F.decode(F.encode(F.when(rank >= 0, F.concat(F.lit(""), F.char((rank + 65).cast("long")))), "utf-8"), "utf-8")


def sentence_id(pos: Column) -> Column:
    return F.format_string("sentence-%04d", pos.cast("long"))


def is_lexical(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}']")


def json_pointer(*parts: Column) -> Column:
    """The JSON pointer to a place: ``~`` and ``/`` in names are escaped; null
    where a part is null."""
    return F.concat(F.lit(""), *[F.concat(F.lit("/"), F.replace(F.replace(p.cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))) for p in parts])


def ordered_flags(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in the order given."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]), lambda x: x.isNotNull())


def occurrences(text: Column, needle: str) -> Column:
    """0-based starts of all, also overlapping, occurrences of a literal."""
    at = F.sequence(F.lit(1), F.length(text))
    here = F.filter(at, lambda i: F.substr(text, i, F.lit(len(needle))) == needle)
    return F.when(F.length(text) > 0, F.transform(here, lambda i: i - 1)).otherwise(F.array().cast("array<int>"))


def span_intersects(s: Column, e: Column, ts: Column, te: Column) -> Column:
    """A span meets a term; an empty one must lie strictly inside."""
    return F.when(s == e, (ts < s) & (s < te)).otherwise((s < te) & (e > ts))


def difference_overlaps(s: Column, e: Column, a: Column, b: Column, total: Column) -> Column:
    """A difference [s, e) belongs to row [a, b): by overlap, or, if it is
    empty, to the row that it precedes; at the very end to the last row."""
    empty = F.when(s == total, b == total).otherwise((a <= s) & (s < b))
    return F.when(s == e, empty).otherwise((s < b) & (e > a))


# --- what Spark has no function for -------------------------------------------


def normalize(text: str) -> tuple[str, list[tuple[int, int]]]:
    """NFKC by cluster without white space and punctuation, each character
    with the raw span of its cluster; marks that may change a number beside
    one stay."""
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    clusters = [m.span() for m in re.finditer(r"(?s).", text)]
    merged: list[list[int]] = []
    for i, j in clusters:
        if merged and (unicodedata.combining(text[i]) or text[i] in "ﾞﾟ"):
            merged[-1][1] = j
        else:
            merged.append([i, j])
    for i, j in merged:
        beside = text[i - 1 : i].isnumeric() or text[j : j + 1].isnumeric()
        for c in unicodedata.normalize("NFKC", text[i:j]):
            if c.isspace():
                continue
            if not unicodedata.category(c).startswith("P") or c in NUMERIC_MARKS and beside or c in NUMERIC_MARKS and not unicodedata.category(c).startswith("P"):
                out.append(c)
                spans.append((i, j))
    return "".join(out), spans


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, UTF-8, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical(col: Column) -> Column:
    """Canonical form of a JSON string column; null where it does not parse."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return canonical_json(json.loads(x))
            except (TypeError, ValueError):
                return None

        return s.map(one)

    return run(col)


def digest(col: Column) -> Column:
    return F.sha2(col, 256)
