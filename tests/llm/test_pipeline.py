"""The corpus pipeline against brute force, and its stages on odd tables."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from spanloom.llm import near_dup, toxicity
from spanloom.llm.common import plain_shingles, table, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, _mix_rate int, keys string, id long, size long, curve int"


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, data).cache()
        assert docs.columns == columns, name
        n = docs.count()
        assert n > 0 and (k == 3 or n <= before), name
        before = n
    assert docs.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    out = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert out.count() == before
    spark.catalog.clearCache()


def _groups(texts):
    """The least id of each text's group, by alignment of all pairs."""
    own = {i: plain_shingles(words(t)) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and find(i) != find(j) and (texts[i] == texts[j] or len(own[i]) and len(own[j]) and near_dup.aligned_similarity(own[i], own[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


def test_run_against_brute_force(spark, data):
    docs = {r["doc_id"]: r for r in table(spark, data, "documents").collect()}
    lexicon = toxicity.fit(table(spark, data, "documents").select("doc_id", "text"), toxicity.training_labels(table(spark, data, "labels")))
    automaton = lexicon.automaton()
    texts = {i: r["text"] for i, r in docs.items() if toxicity.score_text(r["text"], lexicon, automaton) < 0.5}
    assert len(texts) < len(docs)
    groups = _groups(texts)
    kept = {i: t for i, t in texts.items() if groups[i] == i}
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    shingles = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    items = [(min(5, len(w)), shingles(w, min(5, len(w)))) for w in (split(r["text"]) for r in table(spark, data, "benchmark").collect()) if w]
    clean = {i for i, t in kept.items() if not any(len(s & shingles(split(t), n)) >= 0.8 * len(s) - 1e-9 for n, s in items)}
    assert len(clean) < len(kept)
    sizes = Counter()
    for i in clean:
        sizes[docs[i]["source"]] += len(words(docs[i]["text"]))
    names = sorted(sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    rows = corpus_pipeline.run(spark, data).collect()
    taken = Counter(r["doc_id"] for r in rows)
    assert set(taken) <= clean
    for s in names:
        rate = target[s] / sizes[s]
        own = [i for i in clean if docs[i]["source"] == s]
        assert all(taken[i] in (int(rate), int(rate + 1 - 1e-9)) for i in own), s
        words_taken = sum(taken[i] * len(words(docs[i]["text"])) for i in own)
        assert abs(words_taken - target[s]) <= 0.25 * target[s], s
    by = Counter(r["shard"] for r in rows)
    assert len(by) == 24 and max(by.values()) - min(by.values()) <= 1
    assert {(r["shard"], r["slot"]) for r in rows} == {(s, k) for s, n in by.items() for k in range(n)}
    assert corpus_pipeline.ORACLE_SQL is None


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of small tables with nulls, ties, repeats and clashing names."""
    where = str(tmp_path_factory.mktemp("odd"))
    bad = "grumph zorkel blix "
    rows = [(i, prose(i, 30) + (" " + bad * 3 if i % 4 == 0 else ""), "en", "s") for i in range(100, 180)]
    rows += [(1, None, None, None), (2, "", "en", "s"), (None, "no id at all", "en", None), (None, prose(300, 40), "en", "s"), (None, prose(300, 40), "en", "s"), (3, prose(301, 40), "en", "s"), (3, prose(301, 40), "en", "s")]
    rows += [(4, prose(302, 20_000), "en", "t"), (5, prose(302, 20_000) + " tail", "en", "t"), (None, prose(303, 20) + " " + prose(304, 12), "en", "s"), (6, prose(304, 12), "en", "s"), (7, bad * 9, "en", "s"), (8, " \t ", "en", "u")]
    docs = spark.createDataFrame([(*r, 5, 9.5, 1, "k", -1, -2, -3) for r in rows], COLUMNS)
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100, 180)] + [(100, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, prose(304, 12)), (None, prose(303, 20)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_stages_on_odd_tables(spark, odd):
    docs = table(spark, odd, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd).cache()
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")], name
        rows = docs.collect()
        assert all(r["score"] == 9.5 and r["keys"] == "k" and r["id"] == -1 for r in rows), name
        kept.append(Counter((r["doc_id"], r["text"]) for r in rows))
    first, second, third, last = kept
    assert not any(i is not None and 100 <= i and i % 4 == 0 for i, _ in first) and (7, "grumph zorkel blix " * 9) not in first
    assert first[1, None] == first[2, ""] == 1 and first[None, prose(300, 40)] == first[3, prose(301, 40)] == 2
    # empty texts are equal, copies collapse, the long near copy goes
    assert second[1, None] == 1 and not second[2, ""] and second[8, " \t "] == 1
    assert second[None, prose(300, 40)] == second[3, prose(301, 40)] == 1 and second[4, prose(302, 20_000)] == 1
    assert not any(i == 5 for i, _ in second) and second[None, "no id at all"] == 1
    # the rows that hold an item go, whatever their id
    gone = set(second) - set(third)
    assert gone == {(6, prose(304, 12)), (None, prose(303, 20) + " " + prose(304, 12))} and not set(third) - set(second)
    assert set(last) <= set(third) and max(last.values()) <= 2
    out = corpus_pipeline.STAGES[-1][1](spark, docs, odd).collect()
    assert len(out) == sum(last.values()) and len({(r["shard"], r["slot"]) for r in out}) == len(out)
    spark.catalog.clearCache()


def test_stages_on_empty_tables(spark, odd):
    none = table(spark, odd, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, odd).count() == 0, name
