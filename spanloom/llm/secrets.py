"""Operator 10: secret scans by patterns and character Markov models.

The base patterns find assignments, access keys and long hexadecimal runs.
Beside them, two Markov models of order 2 over character classes of tokens, one
of random strings and one of ordinary identifiers, score every other token of
``MIN_LENGTH`` characters or more: the log-likelihood ratio per character alone
decides.  The models are trained from labelled samples: as random, the
secrets that the base patterns find in a sample of documents, and strings drawn
from the usual alphabets; as ordinary, the words of the sample's other text
and identifiers and numbers composed of them.  The sample holds at most
``SAMPLE`` documents, those of least hash; only transition counts (a bounded
table) reach the driver.
Scanning covers every whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import least_hashed

# The base patterns with the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "markov")
_HINTS = ("passw", "secret", "token", "api")

MIN_LENGTH = 16
SAMPLE = 4_000
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_START = "\x02"
#: Characters that a chain tells apart, and the weight of the order below.
_CLASSES, _PRIOR = 58, 2.0
_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end), ordered by start, then kind as listed."""
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def transitions(token: str) -> Iterator[tuple[str, str]]:
    """(context of two characters, next character); digits are one class."""
    t = re.sub("[0-9]", "0", token)
    c = _START * 2
    for x in t:
        yield c, x
        c = c[1] + x


class Chain:
    """A Markov model of order 2 from counts of (context, next character):
    each order is smoothed towards the one below it, the lowest towards a
    uniform character."""

    def __init__(self, counts: Counter):
        self.two, self.one, self.none = Counter(counts), Counter(), Counter()
        for (c, x), n in counts.items():
            self.one[(c[1], x)] += n
            self.none[x] += n
        self.of_two, self.of_one, self.all = Counter(), Counter(), sum(self.none.values())
        for (c, _), n in self.two.items():
            self.of_two[c] += n
        for (c, _), n in self.one.items():
            self.of_one[c] += n

    def p(self, c: str, x: str) -> float:
        p = (self.none[x] + _PRIOR / _CLASSES) / (self.all + _PRIOR)
        p = (self.one[(c[1], x)] + _PRIOR * p) / (self.of_one[c[1]] + _PRIOR)
        return (self.two[(c, x)] + _PRIOR * p) / (self.of_two[c] + _PRIOR)


@dataclass
class Models:
    """The two chains, and the least log-likelihood ratio per character
    (random over ordinary) of a random string: strings of letters alone, which
    names and foreign words may be, need more."""

    random: Chain
    ordinary: Chain
    least: float = 2.5
    least_letters: float = 3.0
    _ratio: dict[tuple[str, str], float] = field(default_factory=dict)

    def llr(self, token: str) -> float:
        out, held = 0.0, self._ratio
        for pair in transitions(token):
            r = held.get(pair)
            if r is None:
                r = held[pair] = log(self.random.p(*pair) / self.ordinary.p(*pair))
            out += r
        return out

    def is_random(self, token: str) -> bool:
        return self.llr(token) >= (self.least_letters if token.isalpha() else self.least) * len(token)


def generated_random(n: int = 12_000, seed: int = 20) -> list[str]:
    """Strings drawn from the alphabets of keys and tokens, by a fixed seed."""
    rng = np.random.default_rng(seed)
    alphabets = ["0123456789abcdef", _CHARS[26:62], _CHARS[:62], _CHARS[:64], _CHARS[:62] + "_-", _CHARS[:52], _CHARS[:26], _CHARS[:26] + _CHARS[52:62]]
    return ["".join(np.array(list(alphabets[i % len(alphabets)]))[rng.integers(0, len(alphabets[i % len(alphabets)]), int(rng.integers(16, 65)))]) for i in range(n)]


def composed(ws: list[str]) -> list[str]:
    """Ordinary identifiers from neighbouring words, in the usual styles."""
    out = []
    for i in range(0, len(ws) - 2, 3):
        a, b, c = (w.lower() for w in ws[i : i + 3])
        out.append((f"{a}_{b}_{c}", f"{a}-{b}-{c}", f"{a}{b.capitalize()}{c.capitalize()}", f"{a.upper()}_{b.upper()}_{i % 100}", f"/{a}/{b}/{c}", f"{a}{b}{1900 + i % 200}")[i // 3 % 6])
        if i % 30 == 0:
            out.append(str(1 + i) * 40 if i % 60 else f"{1900 + i % 200}-{10 + i % 20}-{10 + i % 18}")
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    for p in batches:
        for text in p["text"]:
            text = text or ""
            spans = base_spans(text)
            for start, _, end in spans:
                for t in TOKEN.findall(text[start:end]):
                    seen.update((1, c, x) for c, x in transitions(t))
            rest = list(text)
            for start, _, end in spans:
                rest[start:end] = " " * (end - start)
            ws = re.findall(r"[A-Za-z]{3,}", "".join(rest))
            for t in ws + composed(ws):
                seen.update((0, c, x) for c, x in transitions(t))
    yield pd.DataFrame([(y, c, x, n) for (y, c, x), n in seen.items()], columns=["y", "c", "x", "n"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Models:
    """Train both models on at most ``sample`` documents, those of least hash.

    Rows that repeat id and text count once; null texts are empty.  Without any
    ordinary text the models find nothing, and the base patterns stand alone.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = least_hashed(own, sample, "doc_id", "text").select("text").mapInPandas(_count, "y int, c string, x string, n long").groupBy("y", "c", "x").agg(F.sum("n").alias("n")).collect()
    by: list[Counter] = [Counter(), Counter()]
    for r in rows:
        by[r["y"]][(r["c"], r["x"])] += r["n"]
    for t in generated_random():
        by[1].update(transitions(t))
    return Models(Chain(by[1]), Chain(by[0]))


def scan_text(text: str | None, models: Models) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans); Markov spans never overlap base ones."""
    text = text or ""
    base = base_spans(text)
    extra: list[Span] = []
    at = 0
    ends = sorted((s, e) for s, _, e in base)
    for m in TOKEN.finditer(text):
        while at < len(ends) and ends[at][1] <= m.start():
            at += 1
        if any(s < m.end() and m.start() < e for s, e in ends[at : at + 4]):
            continue
        if models.is_random(m[0]):
            extra.append((m.start(), 3, m.end()))
    return base, sorted(base + extra)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans).

    One row per row, in one narrow pass.  Offsets count code points, ends are
    exclusive.  Null and empty texts have no spans and the digest of the empty
    string.  Extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, out = [[], [], [], []], [], []
            for text in batch.column(1):
                base, spans = scan_text(text.as_py(), models)
                for k in range(4):
                    n[k].append(sum(x[1] == k for x in spans))
                sha.append(hashlib.sha256(listed(base).encode()).hexdigest())
                out.append(listed(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(out, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")
