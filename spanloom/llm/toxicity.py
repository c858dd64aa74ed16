"""Operator 2: toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, digits and signs that stand for letters)
and matched once by an Aho-Corasick automaton.  A term is a whole word or the
beginning of one; of the terms that match at one word the longest counts,
unless the word and its neighbours form an exception phrase.  The score is a
logistic function of the summed weights, raw and normalised by length.

The lexicon, its weights, the exception phrases and the logistic layer are
learned from labelled rows: terms are counted by documents on the executors
over a sample of at most ``max_rows`` rows, those of least hash.  Only the
terms that separate, which that sample bounds, and a few numbers per sampled
row reach the driver.  Scoring covers every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import least_hashed, materialize, packed, small_side

MAX_ROWS = 20_000
_LENGTHS = range(3, 13)

# Letters that look like Latin ones, and signs that replace them.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i",
}
_FOLD = str.maketrans(_LOOKALIKES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {c: "" for c in "­​‌‍﻿"})
# signs within a word fold; a sign at its end is punctuation
_TAIL = re.compile(r"[!$@]+(?=\s|$)")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    """Words of the folded text, one space around each."""
    if not text:
        return " "
    return f" {' '.join(_WORD.findall(_TAIL.sub(' ', text.lower()).translate(_FOLD)))} "


def terms_of(folded: str) -> set[str]:
    """All terms of a folded text: ' word ' and ' beginning'."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in _LENGTHS if k <= len(w))
    return out


@dataclass
class Lexicon:
    """Weights by term, exception phrases (word, neighbour in order) and the
    logistic layer (weights of the features, bias last)."""

    weights: dict[str, float]
    exceptions: set[tuple[str, str]] = field(default_factory=set)
    layer: list[float] = field(default_factory=lambda: [1.0, 0.0, 0.0, -3.0])

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        a = ahocorasick.Automaton()
        for t, w in self.weights.items():
            a.add_word(t, (len(t), w))
        a.make_automaton()
        return a


def hits(folded: str, automaton, exceptions: set[tuple[str, str]]) -> list[float]:
    """The weight of each matched word: of its longest term."""
    if automaton is None:
        return []
    best: dict[int, tuple[int, float]] = {}
    for end, (n, w) in automaton.iter(folded):
        at = end - n + 1
        if at not in best or n > best[at][0]:
            best[at] = (n, w)
    if exceptions and best:
        for at in list(best):
            stop = folded.index(" ", at + 1)
            word = folded[at + 1 : stop]
            before = folded[folded.rfind(" ", 0, at) + 1 : at] if at else ""
            after = folded[stop + 1 : folded.find(" ", stop + 1)] if stop + 1 < len(folded) else ""
            if (word, after) in exceptions or (before, word) in exceptions:
                del best[at]
    return [w for _, w in best.values()]


def features(found: list[float], n_words: int) -> tuple[float, float, float]:
    """Sum (in log scale), sum by length, greatest weight."""
    if not found:
        return 0.0, 0.0, 0.0
    s = sum(found)
    return log(1 + s), 10 * s / (n_words + 10), max(found)


def score_text(text: str | None, lexicon: Lexicon, automaton) -> float:
    f = fold(text)
    x = features(hits(f, automaton, lexicon.exceptions), f.count(" ") - 1)
    z = lexicon.layer[-1] + sum(a * b for a, b in zip(lexicon.layer, x))
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, z)))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Newton's method; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        penalty = ridge * np.r_[np.ones(len(w) - 1), 1e-6]
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def select_terms(counts: list[tuple[str, int, int]], n1: int, n0: int) -> dict[str, float]:
    """Smoothed log odds of the terms that separate.

    Of a word's beginnings that stand in nearly the same documents the longest
    stays, and a longer one stays beside a shorter one only if it adds weight.
    """
    odds = lambda c1, c0: log((c1 + 0.1) / (n1 + 0.2)) - log((c0 + 0.1) / (n0 + 0.2))
    by = {t: (c1, c0) for t, c1, c0 in counts}
    for t in sorted(by, key=lambda x: (-len(x), x)):
        for k in range(len(t) - 1, 3, -1):
            shorter = t[:k]
            if shorter in by and t in by and by[t][0] >= 0.9 * by[shorter][0]:
                # ' word' covers ' word '
                del by[t if t == f"{shorter} " else shorter]
    found: dict[str, float] = {}
    for t in sorted(by, key=lambda x: (len(x), x)):
        w = odds(*by[t])
        stem = next((t[:k] for k in range(len(t) - 1, 3, -1) if t[:k] in found), None)
        if w >= 1.5 and not (stem and found[stem] >= w - 0.7):
            found[t] = w
    return found


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_rows: int = MAX_ROWS) -> Lexicon:
    """Learn a lexicon from the rows of ``labels`` (doc_id, target 0/1).

    Null labels and rows without a document or a doc_id are left out; a row
    that has both labels counts as 1; of texts that repeat a doc_id the least
    counts.  Null texts count as empty, long ones are read whole.  Without both
    kinds of labels, as in empty tables, the lexicon is empty and the score near
    0 or 1, or 0.5 without any label.  Extra columns are ignored.
    """
    rows = labels.where(F.col(target).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = materialize(least_hashed(rows, max_rows, "doc_id"), "labelled")
    n = rows.count()
    if not n:
        return Lexicon({}, set(), [0.0, 0.0, 0.0, 0.0])
    # bounded by max_rows; read five times
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = materialize(texts.join(small_side(rows, n), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "sample")

    def count(it):
        seen: dict[str, list[int]] = {}
        for p in it:
            for text, y in zip(p["text"], p["y"]):
                for t in terms_of(fold(text)):
                    c = seen.get(t)
                    if c is None:
                        c = seen[t] = [0, 0]
                    c[y] += 1
                if len(seen) > 150_000:
                    yield pd.DataFrame([(t, c[1], c[0]) for t, c in seen.items()], columns=["t", "c1", "c0"])
                    seen = {}
        yield pd.DataFrame([(t, c[1], c[0]) for t, c in seen.items()], columns=["t", "c1", "c0"])

    of = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = of.get(1, 0), of.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, set(), [0.0, 0.0, 0.0, 35.0 if n1 else -35.0])
    # the part of the likelihood ratio that a term with more positives than expected has
    c1, c0, rate = F.col("c1"), F.col("c0"), n1 / (n1 + n0)
    gain = c1 * F.log((c1 + 0.01) / ((c1 + c0) * rate)) + c0 * F.log((c0 + 0.01) / ((c1 + c0) * (1 - rate)))
    best = (
        sample.select("text", "y").mapInPandas(count, "t string, c1 long, c0 long")
        .groupBy("t").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
        .where((c1 >= max(2, n1 // 1000)) & (c1 / n1 > 4 * c0 / n0)).withColumn("g", gain).where("g > 6")
        .select("t", "c1", "c0").collect()
    )
    lexicon = Lexicon(select_terms([(r["t"], r["c1"], r["c0"]) for r in best], n1, n0))

    def measure(it):
        auto = lexicon.automaton()
        for p in it:
            out = []
            for text, y in zip(p["text"], p["y"]):
                f = fold(text)
                out.append((*features(hits(f, auto, set()), f.count(" ") - 1), y))
            yield pd.DataFrame(out, columns=["a", "b", "c", "y"])

    def phrases(it):
        auto = lexicon.automaton()
        seen: Counter = Counter()
        for p in it:
            for text, y in zip(p["text"], p["y"]):
                f = fold(text)
                ws = f.split()
                bad = [i for i, w in enumerate(ws) if hits(f" {w} ", auto, set())] if hits(f, auto, set()) else []
                for pair in {(ws[i], ws[i + 1]) for i in bad if i + 1 < len(ws)} | {(ws[i - 1], ws[i]) for i in bad if i}:
                    seen[(*pair, y)] += 1
        yield pd.DataFrame([(a, b, y, n) for (a, b, y), n in seen.items()], columns=["a", "b", "y", "n"])

    if lexicon.weights:
        clean = F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c0")
        toxic = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("c1")
        found = sample.select("text", "y").mapInPandas(phrases, "a string, b string, y int, n long").groupBy("a", "b").agg(clean, toxic)
        rows = found.where((F.col("c0") >= 5) & (F.col("c1") == 0)).collect()
        lexicon.exceptions = {(r["a"], r["b"]) for r in rows}
    x = sample.select("text", "y").mapInPandas(measure, "a double, b double, c double, y int").toPandas()
    # a sum of many terms is taken in a fixed order, so that reruns agree
    x = x.sort_values(["a", "b", "c", "y"], ignore_index=True)
    lexicon.layer = _logistic(x[["a", "b", "c"]].to_numpy(), x["y"].to_numpy(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with a column ``score`` in 0 to 1, row by row: null texts count
    as empty, long ones are read whole, equal ones score alike, an empty table
    gives an empty result.  A column of that name is replaced; the others are
    kept."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = lexicon.automaton()
        for texts in batches:
            yield pd.Series([score_text(t, lexicon, auto) for t in texts], dtype="float64")

    return docs.withColumn("score", of(F.col("text").cast("string")))


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of the doc_id mod 5 is not 0."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def reject_toxic(docs: DataFrame, lexicon: Lexicon, least: float = 0.5) -> DataFrame:
    """``docs`` without those of a score of ``least`` or more.  Null texts count
    as empty; rows without a doc_id and repeated rows are judged by their texts;
    all columns stay as they are, one named score too."""
    return score(packed(docs, "text"), lexicon).where(F.col("score") < least).select("_row.*")
