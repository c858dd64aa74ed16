import pytest
from pyspark.sql import functions as F

from spanloom.operators import validate as va
from spanloom.plans import document

TEXT = "質問をどうぞ。回答します。"


@pytest.fixture(scope="module")
def doc(spark):
    texts = spark.createDataFrame([("r", TEXT, 100.0, 20.0)], "rec string, text string, offset double, duration double")
    tokens = spark.createDataFrame(
        [("r", 0, 0, 6, 0.0, 10.2, False, [], None, True), ("r", 1, 7, 12, 10.2, 19.0, False, [], None, True)],
        "rec string, idx int, xa int, xb int, ra double, rb double, repaired boolean, flags array<string>, part int, eligible boolean",
    )
    events = spark.createDataFrame([("r", 0, "host", 0.0, 9.8), ("r", 1, "guest", 9.2, 20.0)], "rec string, id long, spk string, a double, b double")
    units = spark.createDataFrame([("r", [("質問をどう", 0.0, 5.0), ("ぞ。返答します。", 5.0, 19.0)])], "rec string, units array<struct<text:string,start:double,end:double>>")
    return document.make_document(texts, tokens, events, units)


def test_rows(doc):
    rows = doc.rows.orderBy("a").collect()
    assert [(r["speakers"], r["state"], r["start"]) for r in rows] == [(["A"], "mixed", 100.0), (["B"], "single", 110.2)]
    assert (rows[0]["playback_start"], rows[1]["playback_end"]) == (100.0, 120.0)
    segments, differences = document.source_material(doc)
    assert [r["ids"] for r in differences.collect()] == [["sentence-0001"]]
    assert [len(r["difference_ids"]) for r in segments.orderBy("a").collect()] == [0, 1]


def test_validation_and_tampering(doc):
    assert document.validate(doc)[1] is None
    for change, name in (
        (doc.rows.withColumn("text", F.upper(F.concat("text", F.lit("x")))), "segment_text_preservation"),
        (doc.rows.withColumn("b", F.col("b") + 1), "segment_coverage"),
        (doc.rows.withColumn("end", F.lit(float("nan"))), "timestamps_ids_and_references"),
        (doc.rows.withColumn("speakers", F.array(F.lit("Q"))), "timestamps_ids_and_references"),
        (doc.rows.withColumn("id", F.lit("same")), "timestamps_ids_and_references"),
        (doc.rows.withColumn("state", F.lit("odd")), "states"),
    ):
        bad = document.Document(doc.texts, change, doc.speakers, doc.differences, doc.links)
        assert document.validate(bad)[1] == name


def test_bundle(spark, doc, tmp_path):
    out = str(tmp_path / "out")
    document.save(doc, out)
    assert spark.read.json(f"{out}/segments.jsonl").count() == 2
    text = "\n".join(r[0] for r in spark.read.text(f"{out}/transcript.txt").collect())
    assert text == "[01:40.000] A: 質問をどうぞ。\n[01:50.200] B: 回答します。"
    with pytest.raises(Exception):
        document.save(doc, out)
    bad = document.Document(doc.texts, doc.rows.withColumn("id", F.lit("same")), doc.speakers, doc.differences, doc.links)
    with pytest.raises(ValueError):
        document.save(bad, str(tmp_path / "never"))
    assert not (tmp_path / "never").exists()
    made = []
    files = va.inventory(spark, out).cache()
    assert files.count() and document.cached(spark, out, files, lambda: made.append(1)) and not made
    assert not document.cached(spark, out, files.withColumn("bytes", F.col("bytes") + 1), lambda: made.append(1)) and made
    assert {(r["value"], r["n"]) for r in document.indicators(doc).where("kind = 'state'").collect()} == {("mixed", 1), ("single", 1), ("unknown", 0)}
    assert document.artifact_ids(doc).first()["artifact_id"] == document.artifact_ids(doc).first()["artifact_id"]


def test_source_metadata(spark, doc):
    models = spark.createDataFrame([("r", "asr/a~b", {"repo": "x", "secret": "y", "license": "z"}, "m.json"), ("r", "plain", {}, None)], "rec string, name string, recorded map<string,string>, manifest string")
    row = document.source_metadata(doc, models).first()
    assert row["counts"].asDict() == {"segments": 2, "differences": doc.differences.count()} and row["speakers"] == ["A", "B"]
    assert row["artifact_id"] == document.artifact_ids(doc).first()["artifact_id"] and row["pointers"]["raw_sources"] == "/raw_sources"
    assert row["models"]["asr/a~b"].asDict(True) == {"recorded": {"repo": "x", "license": "z"}, "manifest": "m.json", "full_metadata_pointer": "/provenance/models/asr~1a~0b"}
    assert row["models"]["plain"]["recorded"] == {}
    none = document.Document(doc.texts, doc.rows, doc.speakers.limit(0), doc.differences.limit(0), doc.links)
    row = document.source_metadata(none).first()
    assert row["speakers"] == [] and row["counts"]["differences"] == 0


def test_candidate_export(spark, tmp_path):
    rows = spark.createDataFrame(
        [("r", "s2", 6, 9, 1.5, 2.25, "二つ目", [], None, "unknown_requires_review", ["x", "y"]), ("r", "s1", 0, 6, 0.0, 1.5, "one", ["h"], "h", "candidate_main_not_verified", [])],
        "rec string, id string, a int, b int, start double, end double, text string, speakers array<string>, main string, state string, flags array<string>",
    )
    texts = spark.createDataFrame([("r", "one\n二つ目")], "rec string, text string")
    document.save_candidates(rows, texts, str(tmp_path / "c"))
    body = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "c" / "candidates.md")).collect())
    first, second = "[0.000-1.500] h (main candidate: h)\none\n", "[1.500-2.250] unknown speaker (main candidate: none)\n二つ目\n"
    assert first in body and second in body and body.index(first) < body.index(second) and "state: unknown_requires_review / x, y" in body
    assert spark.read.json(str(tmp_path / "c" / "text.jsonl")).first()["text"] == "one\n二つ目"
    with pytest.raises(Exception):
        document.save_candidates(rows, texts, str(tmp_path / "c"))


def test_review_of_single_clips(spark, doc):
    kind = "rec string, status string, limited boolean, text string, aligned_text string, sha256 string, recorded_sha256 string, pcm binary, aligned_pcm binary, offset double, duration double"
    good = ("r", "completed", False, TEXT, TEXT, "s", "s", bytearray(b"ab"), bytearray(b"ab"), 100.0, 20.0)
    tokens = spark.createDataFrame(
        [("r", 0, 0, 6, 0.0, 10.2, False, [], None, True), ("r", 1, 7, 12, 10.2, 19.0, False, [], None, True)],
        "rec string, idx int, xa int, xb int, ra double, rb double, repaired boolean, flags array<string>, part int, eligible boolean",
    )
    events = spark.createDataFrame([("r", 0, "host", 0.0, 9.8), ("r", 1, "guest", 9.2, 20.0)], "rec string, id long, spk string, a double, b double")
    made = document.review_document(spark.createDataFrame([good], kind), tokens, events)
    plain = lambda d: sorted(tuple(r) for r in d.rows.select("rec", "id", "start", "end", "text", "state").collect())
    assert plain(made) == plain(doc)
    for at, value, problem in ((1, "failed", "alignment_not_completed"), (2, True, "token_limit_reached"), (4, "other", "text_differs"), (5, "t", "audio_changed"), (7, bytearray(b"ac"), "sound_differs"), (1, None, "alignment_not_completed")):
        bad = spark.createDataFrame([(*good[:at], value, *good[at + 1 :])], kind)
        assert [tuple(r) for r in document.clip_problems(bad).collect()] == [("r", problem)]
        with pytest.raises(ValueError, match=problem):
            document.review_document(bad, tokens, events)


def test_version_mismatches(spark):
    pinned = spark.createDataFrame([("a", "1.0"), ("b", "2.0"), ("c", "3.0")], "name string, version string")
    there = spark.createDataFrame([("a", "1.0"), ("b", "2.1"), ("d", "9")], "name string, version string")
    assert sorted(map(tuple, va.version_mismatches(pinned, there).collect())) == [("b", "2.0", "2.1"), ("c", "3.0", None)]
