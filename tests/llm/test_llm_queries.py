"""The queries against SQL, brute force and laws on the small tables."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from spanloom.llm import oracles, queries
from tests.oracle import connect, rows

NAMES = [f"op{i}_" for i in range(1, 11)]


def run(spark, data, prefix):
    f = next(f for n, f in queries.queries().items() if n.startswith(prefix))
    return f(spark, data).toPandas()


def documents(data):
    return connect(data).sql("SELECT doc_id, text, source, lang FROM documents").fetchall()


def test_names():
    assert all(sum(q.startswith(n) for q in queries.queries()) == 1 for n in NAMES)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    want = connect(data).sql(oracles.oracle_sql()[name])
    assert rows(run(spark, data, name)) == rows(want.df())


def test_toxicity_on_held_out_rows(spark, data):
    got = run(spark, data, "op2_").set_index("doc_id")
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    for i in list(got.index)[:50]:
        assert got.loc[i, "held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_near_duplicates_against_all_pairs(spark, data):
    docs = {i: t for i, t, _, _ in documents(data)}
    got = run(spark, data, "op4_").set_index("doc_id")
    assert set(got.index) == set(docs)
    shingles = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, out = Counter(), []
        for k in range(max(1, len(w) - 4)):
            s = tuple(w[k : k + 5])
            out.append((s, seen[s]))
            seen[s] += 1
        shingles[i] = out
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = shingles[i], shingles[j]
            if min(len(a), len(b)) < 0.8 * max(len(a), len(b)) or len(set(a) & set(b)) * 1.8 < 0.8 * (len(a) + len(b)):
                continue
            m = lcs(a, b)
            if docs[i] == docs[j] or m >= 0.8 * (len(a) + len(b) - m):
                one, two = sorted((find(i), find(j)))
                parent[two] = one
    assert {i: find(i) for i in ids} == {i: int(got.loc[i, "component_id"]) for i in ids}
    assert (got["kept"] == (got.index == got["component_id"])).all()


def lcs(a, b):
    at = {s: k for k, s in enumerate(b)}
    row = [0] * (len(b) + 1)
    for s in a:
        k = at.get(s)
        if k is not None:
            best = max(row[: k + 1]) + 1
            row[k + 1] = max(row[k + 1], best)
    return max(row)


def test_mixing_laws(spark, data):
    got = run(spark, data, "op5_")
    assert (got["taken"] <= 2 * got["size"]).all()
    total = got["size"].sum()
    by = got.merge(connect(data).sql("SELECT doc_id, source FROM documents").df(), on="doc_id").groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by["target"].sum() - 1.5 * total) < 1e-6 * total
    assert (by["target"] <= 2 * by["size"] + 1e-9).all()
    assert ((by["taken"] - by["target"]).abs() <= 0.25 * by["target"]).all()
    assert abs(by["taken"].sum() - 1.5 * total) < 0.05 * total


def test_sharding_laws(spark, data):
    got = run(spark, data, "op7_")
    docs = {i: t for i, t, _, _ in documents(data)}
    count = got.groupby("shard").size()
    assert len(count) == 24 and count.max() - count.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    for r in got.itertuples():
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "rows")
    order = got.sort_values(["shard", "slot"])["curve"]
    assert order.is_monotonic_increasing
    # groups of equal texts: only one that a full shard cuts lies in two
    got["text"] = got["doc_id"].map(docs)
    cut = [g for _, g in got.groupby("text") if g["shard"].nunique() > 1]
    assert len(cut) <= 23 and all(g["curve"].nunique() == 1 for _, g in got.groupby("text"))
    for g in cut:
        assert sorted(g["shard"].unique()) == list(range(g["shard"].min(), g["shard"].max() + 1))


def test_extraction_on_the_pages(spark, data):
    pages = dict(connect(data).sql("SELECT page_id, html FROM pages").fetchall())
    got = run(spark, data, "op9_")
    for r in got.itertuples():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"<(?!/?b\b)[^>]*>|<br>", " ", inner))
        import html

        assert r.text == " ".join(html.unescape(inner).split()) and r.n_chars == len(r.text)


def test_secret_base_spans(spark, data):
    docs = {i: t for i, t, _, _ in documents(data)}
    got = run(spark, data, "op10_").set_index("doc_id")
    for i, t in docs.items():
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        listed = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        assert got.loc[i, "base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(got.loc[i, "spans"].split(",")) | {""}
        assert (got.loc[i, "n_assign"], got.loc[i, "n_access"], got.loc[i, "n_hex"]) == tuple(sum(s[1] == k for s in spans) for k in range(3))
