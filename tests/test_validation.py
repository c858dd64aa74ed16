"""Ten checks over a made run, each broken in turn; sources and sinks."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import align, validate as va
from spanloom.plans import document, validation
from spanloom.sources import documents, wav

TEXTS = ["first one speaks. ", "second one answers."]
RATE = 16_000


@pytest.fixture(scope="module")
def run(spark):
    whole = "\n".join(TEXTS)
    texts = spark.createDataFrame([("r", whole, 2.0, 20.0)], "rec string, text string, offset double, duration double")
    parts = spark.createDataFrame([("r", 0, TEXTS[0], 0.0, 10.0, 10.0, 2.0), ("r", 1, TEXTS[1], 10.0, 20.0, 10.0, 12.0)], "rec string, part int, text string, start double, end double, duration double, offset double")
    items, at = [], 0
    for p, t in enumerate(TEXTS):
        at = 0
        for k, w in enumerate(t.replace(".", "").split()):
            at = t.index(w, at)
            items.append(("r", p, k, [(at, at + len(w))], 1.0 + 3 * k, 3.5 + 3 * k, at, at + len(w), False, [], True))
    items = spark.createDataFrame(items, "rec string, part int, idx int, spans array<struct<a:int,b:int>>, a double, b double, xa int, xb int, repaired boolean, flags array<string>, eligible boolean")
    composed = align.compose(parts.select("rec", "part", "text", "start", "duration"), items.drop("spans"))
    tokens = composed.select("rec", F.col("index").alias("idx"), "xa", "xb", F.col("a").alias("ra"), F.col("b").alias("rb"), "repaired", F.array().cast("array<string>").alias("flags"), F.lit(None).cast("int").alias("part"), F.lit(True).alias("eligible"))
    events = spark.createDataFrame([("r", 0, "x", 0.5, 9.9), ("r", 1, "y", 10.5, 19.8)], "rec string, id long, spk string, a double, b double")
    readings = spark.createDataFrame([("r", [("first one speaks", 0.0, 9.0), ("second one replies", 11.0, 19.0)])], "rec string, units array<struct<text:string,start:double,end:double>>")
    doc = document.make_document(texts, tokens, events, readings)
    n, first = 20 * RATE, 2 * RATE
    rng = np.random.default_rng(1)
    normalized = rng.normal(size=first + n + 50).astype("<f4")
    frames = spark.createDataFrame([("r", k, k * 512, min(n, k * 512 + 512), 0.1 if 300 <= k < 320 else 0.9) for k in range(-(-n // 512))], "rec string, frame_idx int, start_sample long, end_sample long, probability double")
    audio = spark.createDataFrame([("r", RATE, first, first + n, 2.0, 20.0, bytearray(normalized[first : first + n].tobytes()), bytearray(normalized.tobytes()))], "rec string, rate int, start_sample long, end_sample long, offset double, duration double, clip binary, normalized binary")
    plan = document.chunk_plan(frames, RATE, 12.0, audio.select("rec", F.col("clip").alias("pcm")))
    ends = [(r["a"], r["b"], r["boundary"]) for r in plan.orderBy("part").collect()]
    assert [e[2] for e in ends] == ["vad_pause_preferred", "input_end"]
    cut = ends[0][1] / RATE
    parts = spark.createDataFrame([("r", 0, TEXTS[0], 0.0, cut, cut, 2.0), ("r", 1, TEXTS[1], cut, 20.0, 20.0 - cut, 2.0 + cut)], parts.schema)
    composed = align.compose(parts.select("rec", "part", "text", "start", "duration"), items.drop("spans"))
    chunks = spark.createDataFrame([("r", p, *ends[p], TEXTS[p], TEXTS[p], False) for p in (0, 1)], "rec string, part int, a long, b long, boundary string, text string, raw_text string, limited boolean")
    artifact = document.artifact_ids(doc).first()["artifact_id"]
    processing = spark.createDataFrame([("r", "complete", artifact, [("one", "complete")])], "rec string, status string, artifact_id string, stages array<struct<name:string,status:string>>")
    names = ["input", *validation.RAW_SOURCES]
    recorded = spark.createDataFrame([("r", k, f"/{k}", i, str(i)) for i, k in enumerate(names)], "rec string, name string, path string, bytes long, sha256 string")
    segments, differences = document.source_material(doc)
    from spanloom.operators import review

    return validation.Evidence(doc, processing, recorded, recorded.drop("rec", "name"), audio, frames, plan, chunks, parts, items, composed, tokens, events, readings, segments, differences, review.render(doc.rows), 12.0)


def test_a_whole_run_passes(spark, run, tmp_path):
    report = validation.validate(run)
    assert (report["status"], report["failed"], report["checks"]) == ("passed", None, validation.CHECKS), report
    validation.write_report(spark, report, str(tmp_path / "report"))
    assert spark.read.option("multiLine", True).json(str(tmp_path / "report")).first()["status"] == "passed"
    with pytest.raises(Exception):
        validation.write_report(spark, report, str(tmp_path / "report"))


def change(df, **cols):
    return df.withColumns(cols)


def test_each_check_finds_what_is_broken(run):
    half = F.when(F.col("part") == 1, True).otherwise(False)
    broken = [
        ("completed_run", {"processing": change(run.processing, status=F.lit("running"))}),
        ("completed_run", {"processing": change(run.processing, stages=F.array(F.struct(F.lit("one").alias("name"), F.lit("failed").alias("status"))))}),
        ("completed_run", {"processing": change(run.processing, artifact_id=F.lit("other"))}),
        ("source_input_identity", {"files": change(run.files, bytes=F.when(F.col("path") == "/input", 99).otherwise(F.col("bytes")))}),
        ("raw_source_fingerprints", {"files": run.files.where("path <> '/qwen'")}),
        ("raw_source_fingerprints", {"recorded": run.recorded.where("name <> 'qwen'")}),
        ("selected_audio_preservation", {"audio": change(run.audio, clip=F.expr("substring(clip, 5)"))}),
        ("selected_audio_preservation", {"audio": change(run.audio, offset=F.lit(2.5))}),
        ("vad_evidence_and_chunk_plan", {"frames": run.frames.where("frame_idx <> 7")}),
        ("vad_evidence_and_chunk_plan", {"plan": change(run.plan, boundary=F.lit("input_end"))}),
        ("vad_evidence_and_chunk_plan", {"chunks": change(run.chunks, a=F.col("a") + half.cast("int"))}),
        ("qwen_chunk_coverage_and_raw_text", {"chunks": change(run.chunks, raw_text=F.lit("else"))}),
        ("qwen_chunk_coverage_and_raw_text", {"chunks": change(run.chunks, limited=half)}),
        ("qwen_chunk_coverage_and_raw_text", {"chunks": change(run.chunks, text=F.upper("text"), raw_text=F.upper("text"))}),
        ("alignment_and_segment_text_preservation", {"parts": change(run.parts, offset=F.col("offset") + 1)}),
        ("alignment_and_segment_text_preservation", {"items": change(run.items, a=F.col("a") + 0.5)}),
        ("alignment_and_segment_text_preservation", {"composed": change(run.composed, flags=F.array(F.lit("odd")))}),
        ("timestamps_ids_and_references", {"events": run.events.where("id = 0")}),
        ("derived_transcript_from_raw_evidence", {"readings": change(run.readings, units=F.slice("units", 1, 1))}),
        ("compact_exports_and_readable_text", {"segments": change(run.segments, text=F.lit("changed"))}),
        ("compact_exports_and_readable_text", {"transcript": change(run.transcript, body=F.lit(""))}),
    ]
    for name, fields in broken:
        bad = dataclasses.replace(run, **fields)
        assert dict(validation.checks(bad))[name]().limit(1).count() == 1, (name, fields.keys())
    assert {name for name, _ in broken} == set(validation.CHECKS)
    report = validation.validate(dataclasses.replace(run, **broken[3][1]))
    assert (report["failed"], report["checks"]) == ("source_input_identity", ["completed_run"])


def test_warnings(run):
    gone = dataclasses.replace(run, files=run.files.where("path <> '/input'"), chunks=change(run.chunks, boundary=F.lit("forced_low_energy_no_vad_pause")))
    got = {r["warning"]: r["n"] for r in validation.warnings(gone).collect()}
    assert got["input_unavailable"] == 1 and got["boundary_without_pause"] == 2


def test_cache_pointer(spark, tmp_path):
    base = str(tmp_path)
    spark.range(3).write.parquet(f"{base}/one")
    assert document.completed_attempt(spark, base, "k") is None
    document.complete(spark, base, "k", "one")
    document.complete(spark, base, "k", "one")
    assert document.completed_attempt(spark, base, "k") == f"{base}/one" and document.completed_attempt(spark, base, "other") is None
    part = next((tmp_path / "one").glob("part-*"))
    part.with_name(f".{part.name}.crc").unlink()
    part.write_bytes(b"changed")
    assert document.completed_attempt(spark, base, "k") is None


def test_replace_keeps_the_old_files_of_a_failed_write(spark, tmp_path):
    path = str(tmp_path / "out")
    documents.replace_path(spark, path, lambda at: spark.range(2).write.json(at))

    def fails(at):
        spark.range(5).write.json(at)
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        documents.replace_path(spark, path, fails)
    assert spark.read.json(path).count() == 2 and len(list(tmp_path.iterdir())) == 1


def test_stage_log(spark):
    log = document.StageLog([])
    with log.stage("good"):
        pass
    with pytest.raises(ValueError), log.stage("bad"):
        raise ValueError("why")
    assert [(r["name"], r["status"], r["error"]) for r in log.table(spark).collect()] == [("good", "complete", None), ("bad", "failed", "ValueError: why")]


def test_alignment_and_review_sources(spark, tmp_path):
    item = '{"index":0,"text":"yes","raw_clip_seconds":[0.5,1.0],"repaired_clip_seconds":[0.5,1.0],"library_repaired":false,"original_character_spans":[[0,2],[3,4]],"flags":[],"eligible_for_boundary_candidate":true}'
    (tmp_path / "a.json").write_text(f'{{"source_offset_seconds":2.0,"duration_seconds":3.0,"mapping":{{"original_text":"ye s"}},"items":[{item}]}}')
    (tmp_path / "b.json").write_text('{"source_offset_seconds":0.0,"duration_seconds":1.0,"alignment_status":"no_text_to_align","mapping":{"original_text":" "},"items":[]}')
    docs = documents.read_json(spark, f"{tmp_path}/[ab].json", documents.ALIGNMENT)
    texts, tokens = documents.alignments(docs, F.col("source_offset_seconds"))
    assert {r["rec"]: r["empty"] for r in texts.collect()} == {2.0: False, 0.0: True}
    assert [(r["token"], r["xa"], r["xb"], r["ra"]) for r in tokens.collect()] == [("yes", 0, 4, 0.5)]
    (tmp_path / "r.json").write_text('{"reviewer":"n","reviewed_at":"2024-01-01T00:00:00Z","listened_ranges":[{"start":0,"end":9}],"rows":{"s1":{"content":"pass","speaker":"pass","boundary":"pass","text":"x","speakers":["A"],"start":1,"end":2,"corrections":{"text":"y"}}}}')
    reviews, heard = documents.review_sheets(documents.read_json(spark, str(tmp_path / "r.json"), documents.REVIEW), F.lit("r"))
    one = reviews.first()
    assert (one["id"], one["text"], one["start"], one["original"]["text"], heard.first()["b"]) == ("s1", "y", None, "x", 9.0)


def test_verified_files(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    seen = va.inventory(spark, str(tmp_path))
    assert bytes(documents.verified_files(spark, str(tmp_path), seen).first()["content"]) == b"abc"
    with pytest.raises(Exception, match="input changed"):
        documents.verified_files(spark, str(tmp_path), seen.withColumn("bytes", F.lit(4).cast("long"))).collect()


def test_plan_and_review_outputs(spark, run, tmp_path):
    signals = run.audio.select("rec", F.col("clip").alias("pcm"))
    document.save_plan(spark, run.plan, signals, RATE, str(tmp_path / "plan"))
    back = {r["path"].rsplit("/", 1)[1]: r["samples"] for r in wav.read(spark, str(tmp_path / "plan/chunks")).collect()}
    assert back == {f"r-{r['part']:03d}.wav": r["b"] - r["a"] for r in run.plan.collect()}
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "plan/files.txt")).collect()) == sorted(back)
    out = str(tmp_path / "bundle")
    document.save(run.document, out)
    segments, differences = document.read_segments(spark, out, run.document)
    assert validation.validate(dataclasses.replace(run, segments=segments, differences=differences))["status"] == "passed"
    from spanloom.operators import review

    reviews = spark.createDataFrame([("r", "sentence-0000", "pass", "pass", "pass", None, None, ["A"], None, None)], "rec string, id string, content string, speaker string, boundary string, note string, text string, speakers array<string>, start double, end double")
    document.save_review(review.apply_review(run.document.rows, reviews), reviews, run.document, str(tmp_path / "review"))
    assert spark.read.json(str(tmp_path / "review/ready.jsonl")).count() == 1 and spark.read.json(str(tmp_path / "review/application.json")).first()["ready"] == 1


def test_settings_identity(spark):
    settings = spark.createDataFrame([("k", "b", "2"), ("k", "a", "1")], "key string, name string, value string")
    assets = spark.createDataFrame([("k", "m", 3, "h")], "key string, path string, bytes long, sha256 string")
    one = document.settings_identity(settings, assets).first()["artifact_id"]
    assert one == document.settings_identity(settings.orderBy("name"), assets).first()["artifact_id"]
    assert one != document.settings_identity(settings, assets.withColumn("sha256", F.lit("x"))).first()["artifact_id"]
