"""Scenarios and independent loops for the operators."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import align, audit, intervals, joins, partition, review, sessionize, turns, validate
from spanloom.sources import documents, wav
from spanloom.streaming import sessions


def frames(lows, samples, width=10):
    return [("r", i, a, min(a + width, samples), 0.1 if any(x <= a and a + width <= y for x, y in lows) else 0.9) for i, a in enumerate(range(0, samples, width))]


def pauses(spark, lows, samples, rate=100):
    f = spark.createDataFrame(frames(lows, samples), "rec string, frame_idx long, start_sample long, end_sample long, probability double")
    t = spark.createDataFrame([("r", samples)], "rec string, samples long")
    return sessionize.pause_runs(f, t, rate), t


@pytest.mark.parametrize(
    "lows,samples,cuts",
    [
        ([(2290, 2310)], 4000, [2300, 4000]),
        ([(1990, 2010), (2390, 2410)], 4000, [2400, 4000]),
        ([(590, 610)], 4000, [600, 3600, 4000]),
    ],
)
def test_pause_partition(spark, lows, samples, cuts):
    runs, totals = pauses(spark, lows, samples)
    plan = partition.partition_at_pauses(runs.where("NOT edge"), totals, 100, 30).orderBy("part").collect()
    assert [p["b"] for p in plan] == cuts
    assert [p["a"] for p in plan] == [0, *cuts[:-1]]


def test_edges_are_no_candidates(spark):
    got = pauses(spark, [(0, 300), (300, 310), (390, 410), (2290, 2300), (3800, 4000)], 4000)[0].collect()
    assert sorted(r["edge"] for r in got) == [False, True, True]
    assert [r["id"] for r in got if not r["edge"]] == [0]


def test_score_at_the_threshold_is_not_low(spark):
    rows = [(*r[:4], 0.35) for r in frames([], 4000)]
    f = spark.createDataFrame(rows, "rec string, frame_idx long, start_sample long, end_sample long, probability double")
    assert sessionize.pause_runs(f, spark.createDataFrame([("r", 4000)], "rec string, samples long"), 100).count() == 0


def test_energy_plan():
    x = np.ones(1400, np.float32)
    x[840:850], x[845] = 0.1, -0.001
    assert [p[1] for p in partition.energy_plan(x, 100, 12)][0] == 845
    y = np.full(701, 0.25, np.float32)
    assert partition.energy_plan(y, 10, 30.09)[0][:2] == (0, 200)
    for n in (1, 2, 1800):
        assert partition.energy_plan(np.ones(n, np.float32), 10) == [(0, n, "input_end")]
    for bad in (np.nan, np.inf):
        with pytest.raises(ValueError):
            partition.energy_plan(np.array([0, bad], np.float32), 10)


def events(spark, rows):
    return spark.createDataFrame([("r", i, s, float(a), float(b)) for i, (a, b, s) in enumerate(rows)], "rec string, id long, spk string, a double, b double")


def classes(spark, rows, **how):
    got = sessionize.activity_candidates(events(spark, rows), **how).orderBy("a", "b", "spk").collect()
    return [(r["spk"], r["a"], r["b"], r["activity"], round(r["single"], 6)) for r in got]


def test_activity_scenarios(spark):
    assert classes(spark, [(0, 12, "s17"), (4, 4.8, "s9")]) == [("s17", 0, 12, "sustained", 11.2), ("s9", 4, 4.8, "unresolved", 0)]
    assert [c[0] for c in classes(spark, [(0, 4, "x"), (4, 4.1, "y"), (4.1, 8, "x")])] == ["x", "y", "x"]
    assert classes(spark, [(0, 3, "x"), (3.2, 6, "x"), (7, 10, "x")])[0][4] == 5.8
    assert classes(spark, [(0, 10, "x"), (2, 7, "y"), (4, 8, "z")])[0][4] == 4


def test_clipped_source_extent_counts_for_speech(spark):
    e = intervals.clip(events(spark, [(50, 110, "B"), (99.5, 100.5, "A")]), F.lit(100.0), F.lit(102.0))
    got = {r["spk"]: r for r in sessionize.activity_candidates(e).collect()}
    assert (got["B"]["a"], got["B"]["b"], got["B"]["activity"]) == (100, 102, "sustained")


def test_uncertain_boundaries(spark):
    e = events(spark, [(0, 10, "x"), (9, 20, "y")])
    got = sessionize.uncertain_boundaries(sessionize.activity_candidates(e), e).collect()
    assert sorted((r["spk"], r["side"], r["at"]) for r in got) == [("x", "end", 10.0), ("y", "start", 9.0)]


def test_activity_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(a := rng.randrange(0, 400), a + rng.randrange(1, 40), rng.choice("xyz")) for _ in range(120)]
    got = {(s, a, b): (k, n) for s, a, b, k, n in classes(spark, rows, gap=5, anchor=30)}
    want = {}
    order = sorted((a, b, i, s) for i, (a, b, s) in enumerate(rows))
    for who in "xyz":
        group = []
        for a, b, _, s in order:
            if s != who:
                continue
            if group:
                end = max(y for _, y in group)
                hit = any(t != who and x < a and y > end for x, y, _, t in order)
                if a > end and (a - end > 5 or hit):
                    want |= summary(who, group, order)
                    group = []
            group.append((a, b))
        want |= summary(who, group, order)
    assert got == want


def summary(who, group, order):
    own = {t for a, b in group for t in range(a, b)}
    other = {t for a, b, _, s in order if s != who for t in range(a, b)}
    speech, single = len(own), len(own - other)
    kind = "sustained" if speech >= 30 else "brief" if single else "unresolved"
    return {(who, min(a for a, _ in group), max(b for _, b in group)): (kind, single)}


def test_interval_measures_against_loops(spark):
    rng = random.Random(5)
    iv = [(rng.choice("pq"), a := rng.randrange(0, 200), a + rng.randrange(0, 15)) for _ in range(80)]
    df = spark.createDataFrame(iv, "k string, a long, b long")
    got = {(r["k"], t) for r in intervals.union(df, ["k"]).collect() for t in range(r["a"], r["b"])}
    assert got == {(k, t) for k, a, b in iv for t in range(a, b)}
    asked = [(i, rng.choice("pq"), a := rng.randrange(0, 200), a + 12) for i in range(30)]
    q = spark.createDataFrame(asked, "id long, k string, a long, b long")
    left = {r["id"]: r["uncovered"] for r in intervals.uncovered(q, ["k"], "id", df).collect()}
    assert left == {i: sum((k, t) not in got for t in range(a, b)) for i, k, a, b in asked}


def test_interval_join_meets_each_pair_once(spark):
    rng = random.Random(7)
    l = [(i, a := rng.randrange(0, 300), a + rng.randrange(1, 90)) for i in range(40)]
    r = [(i, a := rng.randrange(0, 300), a + rng.randrange(1, 90)) for i in range(40)]
    left = spark.createDataFrame([("k", *x) for x in l], "k string, i long, a long, b long")
    right = spark.createDataFrame([("k", *x) for x in r], "k string, j long, ra long, rb long")
    got = sorted((x["i"], x["j"]) for x in joins.interval_join(left, right, ["k"], 25).collect())
    assert got == sorted((i, j) for i, a, b in l for j, c, d in r if a < d and c < b)
    assert joins.interval_join(left.limit(3), right.where("false"), ["k"], 25, how="left").count() == 3


def test_asof_and_nearest(spark):
    left = spark.createDataFrame([("k", i, float(t)) for i, t in enumerate([0, 5, 7, 12])], "k string, i long, t double")
    right = spark.createDataFrame([("k", "a", 5.0), ("k", "b", 9.0)], "k string, n string, u double")
    back = {r["i"]: r["n"] for r in joins.asof_join(left, right, ["k"], "t", "u").collect()}
    ahead = {r["i"]: r["n"] for r in joins.asof_join(left, right, ["k"], "t", "u", "forward").collect()}
    near = {r["i"]: r["n"] for r in joins.nearest_join(left, right, ["k"], "t", "u", 3.0, ["u"]).collect()}
    assert back == {0: None, 1: "a", 2: "a", 3: "b"}
    assert ahead == {0: "a", 1: "a", 2: "b", 3: None}
    assert near == {0: None, 1: "a", 2: "a", 3: "b"}


def test_sentences(spark):
    cases = ["費用3.5円。\r\n次です？！ 終わり", "", "a.b! c", "「はい。」と言う。", "v1.2.3 is out. ok"]
    df = spark.createDataFrame(list(enumerate(cases)), "rec long, text string")
    got = {}
    for r in tx.sentence_spans(df, ["rec"]).orderBy("rec", "pos").collect():
        assert cases[r["rec"]][r["a"] : r["b"]] == r["sentence"]
        got.setdefault(r["rec"], []).append(r["sentence"])
    assert got == {0: ["費用3.5円。\r\n", "次です？！ ", "終わり"], 2: ["a.", "b! ", "c"], 3: ["「はい。」", "と言う。"], 4: ["v1.2.3 is out. ", "ok"]}


def test_stamps(spark):
    df = spark.createDataFrame([(0.0005,), (0.0015,), (3723.9996,)], "s double")
    assert [r[0] for r in df.select(tx.stamp(F.col("s"))).collect()] == ["00:00.000", "00:00.002", "62:04.000"]
    assert df.select(tx.short_stamp(F.col("s"))).collect()[2][0] == "[62:03]"


def test_time_flags(spark):
    ms = [(0, 0), (800, 1200), (400, 600), (float("nan"), 800)]
    t = spark.createDataFrame([("r", i, a / 1000, b / 1000) for i, (a, b) in enumerate(ms)], "rec string, idx long, a double, b double")
    got = [r["flags"] for r in align.time_flags(t, ["rec"], "idx", F.lit(1.0), {"raw": ("a", "b")}).orderBy("idx").collect()]
    assert got == [["raw_zero_length"], ["raw_outside_audio_extent"], ["raw_nonmonotonic_sequence", "raw_overlap_previous_token"], ["raw_nonfinite_timestamp"]]


def test_repair_gate_is_strict(spark):
    df = spark.createDataFrame([(k, i, i < n) for k, n in (("ten", 10), ("eleven", 11)) for i in range(100)], "rec string, i long, r boolean")
    assert {r["rec"]: r["gated"] for r in align.repair_gate(df, ["rec"], F.col("r")).collect()} == {"ten": False, "eleven": True}


def test_compose_seams(spark):
    parts = spark.createDataFrame([("r", 0, "abc", 100.0, 3.0), ("r", 1, "def", 103.0, 3.0)], "rec string, part int, text string, start double, duration double")
    items = spark.createDataFrame([("r", p, i, float(i), i + 1.0, i, i + 1, False) for p in (0, 1) for i in range(3)], "rec string, part int, idx int, a double, b double, xa int, xb int, repaired boolean")
    got = align.compose(parts, items).orderBy("index").collect()
    assert [r["index"] for r in got if "alignment_chunk_edge" in r["flags"]] == [2, 3]
    assert [r["index"] for r in got if not r["eligible"]] == [2, 3]
    assert (got[3]["a"], got[3]["xa"]) == (103.0, 4)


def test_compose_appends_to_the_flags_of_items(spark):
    parts = spark.createDataFrame([("r", p, "abc", 3.0 * p, 3.0) for p in (0, 1)], "rec string, part int, text string, start double, duration double")
    rows = [("r", p, i, float(i), i + 1.0, i, i + 1, p == 1 and i == 0, ["own"] if i == 2 else ["alignment_chunk_edge"] if i == 0 else None, i != 1) for p in (0, 1) for i in range(3)]
    items = spark.createDataFrame(rows, "rec string, part int, idx int, a double, b double, xa int, xb int, repaired boolean, flags array<string>, eligible boolean")
    got = align.compose(parts, items).orderBy("index").collect()
    gate = "alignment_chunk_repair_gate"
    assert [r["flags"] for r in got] == [["alignment_chunk_edge"], [], ["own", "alignment_chunk_edge"], ["alignment_chunk_edge", gate], [gate], ["own", gate]]
    assert [r["eligible"] for r in got] == [True, False, False, False, False, False]


def test_composition_violations(spark):
    text = "rec string, part int, text string, start double, end double, duration double, offset double"
    good = [("ok", 0, "abc", 0.0, 2.0, 2.0, 10.0), ("ok", 1, "de", 2.0, 5.0, 3.0, 12.0)]
    bad = [("gap", 0, "abc", 0.0, 2.0, 2.0, 10.0), ("gap", 1, "de", 2.1, 5.0, 2.9, 12.1), ("short", 0, "x", 0.0, 4.0, 3.0, 10.0), ("off", 0, None, 0.0, 5.0, 5.0, float("nan"))]
    items = [("ok", 0, 0, [(0, 1), (2, 3)], False), ("ok", 0, 1, [], True), ("ok", 1, 0, [(0, 2)], False), ("gap", 0, 0, [(1, 2)], None), ("gap", 0, 1, [(0, 1)], False), ("gap", 1, 1, [(0, 3)], False)]
    totals = spark.createDataFrame([(r, 10.0, 5.0) for r in ("ok", "gap", "short", "off")], "rec string, offset double, duration double")
    got = align.composition_violations(spark.createDataFrame(good + bad, text), spark.createDataFrame(items, "rec string, part int, idx int, spans array<struct<a:int,b:int>>, repaired boolean"), totals)
    assert sorted(map(tuple, got.collect())) == [
        ("gap", 0, "missing_repair_flag"), ("gap", 0, "spans_not_ordered"), ("gap", 1, "extent_not_contiguous"), ("gap", 1, "indices_not_ordered"), ("gap", 1, "spans_not_ordered"),
        ("off", 0, "missing_text"), ("off", 0, "offset_differs_from_start"), ("short", 0, "duration_differs_from_extent"), ("short", 0, "last_part_ends_early"),
    ]


def test_zip_tokens(spark):
    schema = "rec string, words array<string>, raw array<double>, repaired array<struct<text:string,start:double,end:double>>"
    one = ("r", ["no", "yes"], [100.0, 200.0, 300.0, 250.0], [("no", 100.0, 200.0), ("yes", 250.0, 300.0)])
    got = align.zip_tokens(spark.createDataFrame([one], schema)).orderBy("idx").collect()
    assert [tuple(r)[1:] for r in got] == [(0, "no", 0.1, 0.2, 0.1, 0.2), (1, "yes", 0.3, 0.25, 0.25, 0.3)]
    for row in (one[:2] + (one[2][:3], one[3]), one[:3] + (one[3][:1],), one[:3] + ([("no", 1.0, 2.0), ("maybe", 1.0, 2.0)],)):
        with pytest.raises(Exception, match="expected|changed"):
            align.zip_tokens(spark.createDataFrame([row], schema)).collect()


def test_difference_links(spark):
    cases = {(0, 4): "TF", (4, 8): "FT", (4, 4): "FT", (8, 8): "FT", (0, 0): "TF", (3, 5): "TT"}
    rows = spark.createDataFrame([("r", "0", 0, 4), ("r", "1", 4, 8)], "rec string, id string, a long, b long")
    diffs = spark.createDataFrame([("r", i, s, e) for i, (s, e) in enumerate(cases)], "rec string, diff long, s long, e long")
    got = review.difference_links(rows, diffs, F.lit(8))
    found = {(r["diff"], r["id"]) for r in got.collect()}
    assert found == {(i, str(k)) for i, v in enumerate(cases.values()) for k in (0, 1) if v[k] == "T"}
    assert {r["diff"]: r["ids"] for r in review.inverse_links(diffs, got).collect()}[5] == ["0", "1"]


REVIEW = "rec string, id string, content string, speaker string, boundary string, note string, text string, speakers array<string>, start double, end double"


def reviewed(spark, row, listened, speakers=("A",)):
    rows = spark.createDataFrame([("r", "0", 100.0, 110.0, "x", ["A"], "single"), ("r", "1", 120.0, 130.0, "y", ["B"], "single")], "rec string, id string, start double, end double, text string, speakers array<string>, state string")
    rev = spark.createDataFrame([("r", *row)], REVIEW)
    heard = spark.createDataFrame([("r", float(a), float(b)) for a, b in listened], "rec string, a double, b double")
    known = spark.createDataFrame([("r", "A"), ("r", "B")], "rec string, spk string")
    return [r["problem"] for r in review.review_violations(rows, rev, heard, known).collect()], review.apply_review(rows, rev)


def test_review(spark):
    ok = ("0", "pass", "pass", "pass", None, None, None, None, None)
    assert reviewed(spark, ok, [(100, 110)])[0] == []
    assert reviewed(spark, ok, [(100, 105), (105, 110)])[0] == []
    assert reviewed(spark, ok, [(105, 110)])[0] == ["not_listened_to"]
    assert reviewed(spark, ok, [(100, 105), (105.1, 110)])[0] == ["not_listened_to"]
    assert reviewed(spark, ("0", "pass", "pass", "pass", None, None, ["A", "A"], None, None), [(100, 110)])[0] == ["invalid_speakers"]
    assert reviewed(spark, ("0", "pass", "pass", "pass", None, None, ["C"], None, None), [(100, 110)])[0] == ["invalid_speakers"]
    assert reviewed(spark, ("9", "pass", "pass", "pass", None, None, None, None, None), [(100, 110)])[0] == ["unknown_row"]
    assert reviewed(spark, ("0", "pass", "not_applicable", "pass", None, None, None, None, None), [(100, 110)])[0] == ["note_required"]
    done = {r["id"]: r for r in reviewed(spark, ok, [(100, 110)])[1].collect()}
    assert done["0"]["ready_attributed"] and not done["1"]["ready_anonymous"]
    na = {r["id"]: r for r in reviewed(spark, ("0", "pass", "not_applicable", "pass", "n", None, None, None, None), [(100, 110)])[1].collect()}["0"]
    assert na["ready_anonymous"] and not na["ready_attributed"] and na["candidate_speakers"] == ["A"] and na["speakers"] == []
    both = {r["id"]: r for r in reviewed(spark, ("0", "pass", "pass", "pass", None, "z", ["A", "B"], 101.0, 111.0), [(100, 112)])[1].collect()}["0"]
    assert both["state"] == "mixed" and not both["ready_attributed"] and both["model"]["text"] == "x" and both["corrected_time"]
    ready = review.document_ready(reviewed(spark, ok, [(100, 110)])[1]).first()
    assert (ready["ready"], ready["all_anonymous"]) == (1, False)


def test_review_times(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05",), ("2024-13-02T03:04:05Z",), (None,)], "t string")
    assert [r[0] for r in df.select(review.valid_review_time(F.col("t"))).collect()] == [True, False, False, False]


def test_wave_round_trip(spark, tmp_path):
    pcm = np.array([0.0, 0.5, -1.0], "<f4").tobytes()
    data = wav.build(pcm, 16000)
    assert wav.parse(data, strict=True) == (16000, pcm)
    odd = data[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + data[12:]
    assert wav.parse(odd) == (16000, pcm)
    for bad in (data[:-1], data + b"data" + struct.pack("<I", 0), b"RIFX" + data[4:]):
        with pytest.raises(ValueError):
            wav.parse(bad)
    i16 = b"RIFF" + struct.pack("<I", 40) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<Ihh", 4, 16384, -32768)
    assert np.frombuffer(wav.parse(i16)[1], "<f4").tolist() == [0.5, -1.0]
    wav.write(spark.createDataFrame([("one", 16000, bytearray(pcm))], "name string, rate int, pcm binary"), str(tmp_path / "out"))
    back = wav.read(spark, str(tmp_path / "out"))
    assert back.first()["samples"] == 3
    assert wav.samples(back, 2).count() == 2


def test_strict_json(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"segments":[{"start":0,"end":1.5,"speaker":"a"}]}')
    docs = documents.read_json(spark, str(tmp_path / "good.json"), documents.EVENTS)
    assert documents.events(docs, F.lit("r")).first()["b"] == 1.5
    (tmp_path / "bad.json").write_text('{"segments":[{"start":NaN,"end":1.5,"speaker":"a"}]}')
    with pytest.raises(Exception):
        documents.read_json(spark, str(tmp_path / "bad.json"), documents.EVENTS).collect()


def test_validation(spark):
    a = spark.createDataFrame([("x", 1, "h"), ("y", 2, "h"), ("z", 3, "h")], "path string, bytes long, sha256 string")
    b = spark.createDataFrame([("x", 1, "h"), ("y", 9, "h"), ("w", 3, "h")], "path string, bytes long, sha256 string")
    assert {r["path"]: r["state"] for r in validate.valid_cache(a, b).collect()} == {"y": "bytes", "z": "missing", "w": "extra"}
    bad = spark.createDataFrame([("../x", 1, "0" * 64), ("/y", 1, "0" * 64), ("ok", 1, "0" * 64), ("ok", 1, "0" * 64), ("h", 1, "q")], "path string, bytes long, sha256 string")
    assert {r["path"]: r["problem"] for r in validate.manifest_violations(bad).collect()} == {"../x": "unsafe_path", "/y": "unsafe_path", "ok": "duplicate_path", "h": "invalid_digest"}
    steps, failed = validate.first_failure([("one", a.where("false")), ("two", a), ("three", a)])
    assert failed == "two" and [s[0] for s in steps] == ["one", "two"]
    js = spark.createDataFrame([('{"b":1,"a":"é"}',), ("{",)], "j string")
    assert [r[0] for r in js.select(tx.canonical(F.col("j"))).collect()] == ['{"a":"é","b":1}', None]


def attributed(spark, text, times, evs, duration=30.0, repaired=()):
    words = [w for w in text.replace("。", "。 ").split(" ") if w]
    tokens, at = [], 0
    for i, w in enumerate(words):
        body = w.rstrip("。")
        tokens.append(("r", i, at, at + len(body), float(times[i][0]), float(times[i][1]), i in repaired, [], None, True))
        at += len(w)
    t = spark.createDataFrame(tokens, "rec string, idx int, xa int, xb int, ra double, rb double, repaired boolean, flags array<string>, part int, eligible boolean")
    x = spark.createDataFrame([("r", text, 0.0, duration)], "rec string, text string, offset double, duration double")
    return turns.attribute(x, t, events(spark, evs)).orderBy("a").collect()


def test_attribution_snaps_to_a_sentence_end(spark):
    got = attributed(spark, "質問をどうぞ。回答します。", [(0, 10.2), (10.2, 19)], [(0, 9.8, "host"), (9.2, 20, "guest")], 20.0)
    assert [r["speakers"] for r in got] == [["host"], ["guest"]]
    assert "".join(r["text"] for r in got) == "質問をどうぞ。回答します。"


def test_brief_reply_stays_unattributed(spark):
    got = attributed(spark, "一つ目。二つ。三つ目。", [(0, 10), (10, 10.8), (11, 20)], [(0, 11.5, "alpha"), (10.1, 21, "beta")], 21.0)
    assert got[1]["main"] == "beta" and got[1]["speakers"] == []
    assert got[1]["overlaps"][0]["start"] == 10.1


def test_time_regression_falls_back(spark):
    got = attributed(spark, "一二三", [(0, 5)], [(0, 30, "x")])
    assert got[0]["speakers"] == ["x"]
    t = [("r", 0, 0, 1, 0.0, 5.0, False, [], None, True), ("r", 1, 1, 2, 20.0, 25.0, False, [], None, True), ("r", 2, 2, 3, 10.0, 15.0, False, [], None, True)]
    tokens = spark.createDataFrame(t, "rec string, idx int, xa int, xb int, ra double, rb double, repaired boolean, flags array<string>, part int, eligible boolean")
    x = spark.createDataFrame([("r", "一二三", 0.0, 30.0)], "rec string, text string, offset double, duration double")
    row = turns.attribute(x, tokens, events(spark, [(0, 30, "x")])).first()
    assert (row["start"], row["end"], row["speakers"], row["time_kind"]) == (0.0, 30.0, [], "source_clip_envelope_fallback")


def test_brief_correction_is_not_attributed(spark):
    got = attributed(spark, "長い文です。", [(0, 12)], [(0, 5, "a"), (5, 6, "b"), (6, 12, "a")], 12.0)
    assert got[0]["speakers"] == [] and "unseparated_brief_other_speaker_activity" in got[0]["flags"]


def test_streaming_sessions(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:00:05"), ("u", "2024-01-01 00:01:00"), ("v", "2024-01-01 00:02:00")]
    batch = spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias("t"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = sessions.sessions(stream, "k", "t", "10 seconds", "1 minute").writeStream.format("memory").queryName("s").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["k"], r["n"]) for r in spark.table("s").collect()) == [("u", 1), ("u", 2), ("v", 1)]
