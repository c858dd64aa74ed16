"""Ordered validation of whole runs: ten named checks, each a table of
violations (rec, problem), stopped at the first that has rows.

A run's evidence is a set of tables keyed by ``rec``; one validation covers any
number of recordings.  Signals are compared where they lie, inside the rows that
hold them; everything else is joins, and re-derived tables are held against the
recorded ones as sets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spanloom.operators import align, review as rv, sessionize, validate as va
from spanloom.operators.intervals import is_finite
from spanloom.operators.joins import interval_join
from spanloom.plans import document as dc
from spanloom.sources import documents

# The checks in their order, and the raw sources that a document names.
CHECKS = [
    "completed_run",
    "source_input_identity",
    "raw_source_fingerprints",
    "selected_audio_preservation",
    "vad_evidence_and_chunk_plan",
    "qwen_chunk_coverage_and_raw_text",
    "alignment_and_segment_text_preservation",
    "timestamps_ids_and_references",
    "derived_transcript_from_raw_evidence",
    "compact_exports_and_readable_text",
]
RAW_SOURCES = ["apple", "diarization", "qwen", "audio_manifest", "alignment"]
COMPLETE = "complete"


@dataclass
class Evidence:
    """What a run leaves behind, as tables:

    document; processing (rec, status, artifact_id, stages array<struct<name,
    status>>); recorded (rec, name, path, bytes, sha256), the fingerprints of the
    input and the raw sources as the document states them; files (path, bytes,
    sha256) as they lie; audio (rec, rate, start_sample, end_sample, offset,
    duration, clip binary, normalized binary); frames (rec, frame_idx,
    start_sample, end_sample, probability); plan (rec, part, a, b, boundary);
    chunks (rec, part, a, b, boundary, text, raw_text, limited); parts (rec,
    part, text, start, end, duration, offset) and items (rec, part, idx, spans,
    token times a, b, offsets xa, xb, repaired, flags, eligible) of the parts'
    alignments; composed, their recorded composition; tokens, events and
    readings, from which the document was made; segments, differences and
    transcript (rec, body), the exports read back.
    """

    document: dc.Document
    processing: DataFrame
    recorded: DataFrame
    files: DataFrame
    audio: DataFrame
    frames: DataFrame
    plan: DataFrame
    chunks: DataFrame
    parts: DataFrame
    items: DataFrame
    composed: DataFrame
    tokens: DataFrame
    events: DataFrame
    readings: DataFrame | None
    segments: DataFrame
    differences: DataFrame
    transcript: DataFrame
    max_seconds: float = 180.0
    terms: list[str] | None = None


def _problems(df: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """(rec, problem) of the rows that break a rule; null counts as broken."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules])
    return df.select("rec", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("problem"))


def _differ(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """A violation for each recording of which two tables differ as sets."""
    return va.set_difference(left, right.select(*left.columns)).select("rec", F.lit(name).alias("problem")).distinct()


def _fingerprints(e: Evidence, recorded: DataFrame) -> DataFrame:
    there = e.files.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    return recorded.join(there, "path", "left").where(~(F.col("bytes").eqNullSafe(F.col("_bytes")) & F.col("sha256").eqNullSafe(F.col("_sha"))))


def completed(e: Evidence) -> DataFrame:
    stages = F.size("stages") > 0
    every = F.forall("stages", lambda s: F.coalesce(s["status"] == COMPLETE, F.lit(False)))
    ids = e.processing.join(dc.artifact_ids(e.document).select("rec", F.col("artifact_id").alias("_own")), "rec", "left")
    return _problems(ids, (F.col("status") == COMPLETE, "run_not_complete"), (stages & every, "stage_not_complete"), (F.col("artifact_id") == F.col("_own"), "artifact_id_differs"))


def input_identity(e: Evidence) -> DataFrame:
    """Only of inputs that are still there; others are a warning."""
    own = e.recorded.where("name = 'input'")
    return _fingerprints(e, own.join(e.files.select("path"), "path", "left_semi")).select("rec", F.lit("input_differs").alias("problem"))


def raw_sources(e: Evidence) -> DataFrame:
    own = e.recorded.where("name <> 'input'")
    names = own.groupBy("rec").agg(F.array_sort(F.collect_set("name")).alias("names"))
    keys = _problems(e.processing.select("rec").join(names, "rec", "left"), (F.col("names") == F.array(*[F.lit(n) for n in sorted(RAW_SOURCES)]), "raw_source_names_differ"))
    return keys.union(_fingerprints(e, own).select("rec", F.concat(F.col("name"), F.lit("_differs"))))


def selected_audio(e: Evidence) -> DataFrame:
    a, b, n = F.col("start_sample"), F.col("end_sample"), F.octet_length("normalized") / 4
    part = F.expr("substring(normalized, int(start_sample * 4 + 1), int((end_sample - start_sample) * 4))")
    met = e.audio.join(e.document.texts.select("rec", F.col("offset").alias("_off"), F.col("duration").alias("_dur")), "rec")
    return _problems(
        met, ((a >= 0) & (a < b) & (b <= n), "invalid_sample_range"), (F.col("clip") == part, "audio_differs"), (F.col("offset") == a / F.col("rate"), "offset_differs"),
        (F.col("duration") == (b - a) / F.col("rate"), "duration_differs"), ((F.col("_off") == F.col("offset")) & (F.col("_dur") == F.col("duration")), "window_differs"),
    )


def chunk_plan(e: Evidence) -> DataFrame:
    total = e.audio.select("rec", "rate", (F.col("end_sample") - F.col("start_sample")).alias("_n"))
    gaps = sessionize.contiguity_violations(e.frames.join(total, "rec"), ["rec"], ["frame_idx"], "start_sample", "end_sample", 0, "_n").select("rec", F.lit("frames_not_contiguous").alias("problem"))
    score = _problems(e.frames, (is_finite(F.col("probability")) & F.col("probability").between(0, 1), "invalid_probability"))
    bad = gaps.union(score).distinct()
    # a plan per rate: the rates of a run are few
    for rate in [r["rate"] for r in total.select("rate").distinct().collect()]:
        own = e.audio.where(F.col("rate") == rate)
        some = own.select("rec")
        made = dc.chunk_plan(e.frames.join(some, "rec", "left_semi"), rate, e.max_seconds, own.select("rec", F.col("clip").alias("pcm")))
        recorded = e.plan.join(some, "rec", "left_semi").select("rec", F.col("part").cast("int").alias("part"), "a", "b", "boundary")
        bad = bad.union(_differ(recorded, made, "plan_differs"))
    used = e.chunks.select("rec", F.col("part").cast("int").alias("part"), "a", "b", "boundary")
    return bad.union(_differ(used, e.plan.select("rec", F.col("part").cast("int").alias("part"), "a", "b", "boundary"), "cuts_differ_from_plan"))


def chunk_texts(e: Evidence) -> DataFrame:
    total = e.audio.select("rec", (F.col("end_sample") - F.col("start_sample")).alias("_n"))
    gaps = sessionize.contiguity_violations(e.chunks.join(total, "rec"), ["rec"], ["part"], "a", "b", 0, "_n").select("rec", F.lit("chunks_not_contiguous").alias("problem"))
    w = Window.partitionBy("rec").orderBy("part")
    each = _problems(
        e.chunks.withColumn("_k", F.row_number().over(w) - 1), (F.col("part") == F.col("_k"), "chunks_not_numbered"), (F.col("a") < F.col("b"), "empty_chunk"),
        (F.col("text") == F.col("raw_text"), "raw_text_differs"), (~F.col("limited"), "token_limit_reached"),
    )
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n")
    joined = e.document.texts.select("rec", "text").join(e.chunks.groupBy("rec").agg(lines.alias("_joined")), "rec", "left")
    return gaps.union(each).union(_problems(joined, (F.col("text") == F.col("_joined"), "combined_text_differs")))


def alignment(e: Evidence) -> DataFrame:
    """The contract of the parts, the composition derived again, and the rows'
    text and spans."""
    totals = e.document.texts.select("rec", "offset", "duration")
    bad = align.composition_violations(e.parts, e.items, totals).select("rec", "problem")
    met = e.parts.join(e.chunks.select("rec", "part", "a", "b", F.col("text").alias("_text")), ["rec", "part"], "full").join(e.audio.select("rec", "rate"), "rec", "left")
    bad = bad.union(_problems(met, ((F.col("start") == F.col("a") / F.col("rate")) & (F.col("end") == F.col("b") / F.col("rate")), "part_extent_differs"), (F.col("text") == F.col("_text"), "part_text_differs")))
    cols = ["rec", "part", "idx", "index", "a", "b", "xa", "xb", "flags", "eligible"]
    again = align.compose(e.parts.select("rec", "part", "text", "start", "duration"), e.items.drop("spans")).select(*cols)
    bad = bad.union(_differ(e.composed.select(*cols), again, "composition_differs"))
    rows, texts = e.document.rows, e.document.texts.select("rec", F.col("text").alias("_whole"))
    bad = bad.union(va.lossless(rows, texts, ["rec"], "a", "text", "_whole").where("NOT ok").select("rec", F.lit("rows_change_the_text")))
    spans = rows.join(texts.select("rec", F.length("_whole").cast("long").alias("_n")), "rec")
    return bad.union(sessionize.contiguity_violations(spans, ["rec"], ["a"], "a", "b", 0, "_n").select("rec", F.lit("row_spans_not_contiguous")))


def references(e: Evidence) -> DataFrame:
    bad = dc.row_violations(e.document).select("rec", "problem")
    lo, hi = F.col("offset"), F.col("offset") + F.col("duration")
    met = e.document.rows.join(e.document.texts.select("rec", "offset", "duration"), "rec")
    inside = lambda a, b: is_finite(F.col(a)) & is_finite(F.col(b)) & (F.col(a) >= lo) & (F.col(a) <= F.col(b)) & (F.col(b) <= hi)
    bad = bad.union(_problems(met, (inside("start", "end"), "time_outside_window"), (inside("playback_start", "playback_end"), "playback_outside_window")))
    said = e.document.rows.select("rec", F.explode(F.coalesce(F.array_union("events", "other_events"), F.array().cast("array<bigint>"))).alias("id"))
    return bad.union(va.missing_references(said, e.events.select("rec", F.col("id").cast("long").alias("id")), ["rec", "id"]).select("rec", F.lit("unknown_event")))


def derived(e: Evidence) -> DataFrame:
    """The document made again from the evidence."""
    d = e.document
    again = dc.make_document(d.texts, e.tokens, e.events, e.readings, terms=e.terms)
    out = _differ(d.rows, again.rows, "rows_differ_from_evidence")
    for name in ("speakers", "differences", "links"):
        out = out.union(_differ(getattr(d, name), getattr(again, name), f"{name}_differ_from_evidence"))
    return out


def exports(e: Evidence) -> DataFrame:
    segments, differences = dc.source_material(e.document)
    out = _differ(segments, e.segments, "segments_export_differs").union(_differ(differences, e.differences, "differences_export_differs"))
    return out.union(_differ(rv.render(e.document.rows), e.transcript, "readable_text_differs"))


def checks(e: Evidence) -> list[tuple[str, Callable[[], DataFrame]]]:
    """The named checks in their order; each is planned when its turn comes."""
    steps = [completed, input_identity, raw_sources, selected_audio, chunk_plan, chunk_texts, alignment, references, derived, exports]
    return [(name, partial(f, e)) for name, f in zip(CHECKS, steps)]


def warnings(e: Evidence) -> DataFrame:
    """(rec, warning, n): what is no corruption but may be unhelpful."""
    rows = e.document.rows
    longest = e.chunks.join(e.audio.select("rec", "rate"), "rec").groupBy("rec").agg(F.max((F.col("b") - F.col("a")) / F.col("rate")).alias("_longest"))
    parts = e.parts.join(e.document.texts.select("rec", F.col("offset").alias("_off")), "rec").select("rec", F.length("text").alias("_len"), "part")
    w = Window.partitionBy("rec").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    seams = parts.withColumn("_cut", F.coalesce(F.sum(F.col("_len") + 1).over(w), F.lit(0)).cast("long")).where("_cut > 0").select("rec", "_cut")
    over = interval_join(rows.select("rec", "id", "a", "b"), seams.select("rec", F.col("_cut").alias("_p"), F.col("_cut").alias("_q")), ["rec"], 1_000, ("a", "b"), ("_p", "_q")).select("rec", "id").distinct()
    found = [
        (rows.where(F.array_contains("flags", "broad_playback_timing_fallback")), "fallback_timing"),
        (rows.join(longest, "rec").where("end - start > _longest + 1e-7"), "row_longer_than_longest_chunk"),
        (over, "row_covers_several_chunks"),
        (e.chunks.where("boundary = 'forced_low_energy_no_vad_pause'"), "boundary_without_pause"),
        (e.recorded.where("name = 'input'").join(e.files.select("path"), "path", "left_anti"), "input_unavailable"),
    ]
    out = None
    for df, name in found:
        one = df.groupBy("rec").agg(F.count("*").alias("n")).select("rec", F.lit(name).alias("warning"), "n")
        out = one if out is None else out.union(one)
    return out


def validate(e: Evidence) -> dict:
    """{status, checks, failed, warnings}: checks in order up to the first that
    fails; warnings (totals over all recordings) only of what passed."""
    done, failed = va.first_failure(checks(e))
    said = {} if failed else {r["warning"]: r["n"] for r in warnings(e).groupBy("warning").agg(F.sum("n").alias("n")).collect()}
    return {"status": "failed" if failed else "passed", "checks": [name for name, status in done if status == "passed"], "failed": failed, "warnings": said}


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """The report as pretty JSON to a new place only."""
    one = spark.createDataFrame([(report["status"], report["checks"], report["failed"], report["warnings"])], "status string, checks array<string>, failed string, warnings map<string,bigint>")
    documents.write_pretty(one, path)
