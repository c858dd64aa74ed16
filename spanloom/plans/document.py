"""Whole documents: assembly, compact views, bundles, validation, caching."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.functions.text import json_pointer
from spanloom.operators import audit as au, partition, review as rv, sessionize, turns, validate as va
from spanloom.operators.intervals import is_finite
from spanloom.operators.scratch import materialize
from spanloom.sources import documents, wav

STATES = ["single", "mixed", "unknown"]
# What an export tells of a model, and the parts of a document that it points to.
MODEL_FIELDS = ["repo", "revision", "license", "model", "purpose"]
POINTED = ["raw_sources", "provenance", "qwen_settings", "diarization_metadata", "review"]
TIME_KINDS = ["forced_alignment_token_envelope", "source_chunk_envelope_fallback", "source_clip_envelope_fallback"]


@dataclass
class Document:
    """Tables of one or many recordings: ``rows`` of sentences, ``speakers``
    with their labels, ``differences`` to the other reading, ``links`` between
    the two, and the ``texts`` that the rows partition."""

    texts: DataFrame
    rows: DataFrame
    speakers: DataFrame
    differences: DataFrame
    links: DataFrame


def make_document(texts: DataFrame, tokens: DataFrame, events: DataFrame, readings: DataFrame | None = None, regions: DataFrame | None = None, terms: list[str] | None = None) -> Document:
    """Attribute sentences, audit them against the other reading (rec, units),
    and link the two.

    Speakers get letters by first appearance.  A row's state is unknown
    without a speaker, mixed with overlaps or foreign activity, else single;
    playback is padded by two seconds inside the recording.
    """
    names = rv.speaker_labels(events)
    rows = turns.attribute(texts, tokens, events, regions)
    letter = names.select("rec", F.col("spk").alias("_s"), F.col("label").alias("_label"))
    rows = rows.withColumn("_s", F.get("speakers", F.lit(0))).join(letter, ["rec", "_s"], "left")
    rows = rows.withColumn("speakers", F.when(F.col("_label").isNotNull(), F.array("_label")).otherwise(F.array().cast("array<string>"))).drop("_s", "_label")
    foreign = F.array_contains("flags", "other_speaker_activity_ownership_unresolved")
    rows = rows.withColumn("state", rv.document_state(F.col("speakers"), F.coalesce(F.size("overlaps") > 0, F.lit(False)), foreign))
    window = texts.select("rec", F.col("offset").alias("_lo"), (F.col("offset") + F.col("duration")).alias("_hi"), F.length("text").cast("long").alias("_n"))
    rows = materialize(rv.playback(rows.join(window, "rec"), F.col("_lo"), F.col("_hi")).drop("_lo", "_hi"))
    if readings is None:
        differences = texts.sparkSession.createDataFrame([], f"rec {dict(texts.dtypes)['rec']}, diff long, s long, e long, signals array<string>")
    else:
        found = au.audit(readings.select("rec", "units").join(texts.select("rec", "text"), "rec"), terms).where("kind = 'difference'")
        differences = materialize(found.select("rec", F.col("pos").cast("long").alias("diff"), F.col("own_span.a").cast("long").alias("s"), F.col("own_span.b").cast("long").alias("e"), "signals"))
    links = rv.difference_links(rows.select("rec", "id", "a", "b", "_n"), differences.select("rec", "diff", "s", "e"), F.col("_n"))
    return Document(texts, rows.drop("_n"), names, differences, links)


def row_violations(doc: Document) -> DataFrame:
    """(rec, id, problem): duplicate ids, invalid times, unknown speakers,
    links to rows or differences that are not there."""
    r = doc.rows
    twice = va.duplicates(r, ["rec", "id"]).select("rec", "id", F.lit("duplicate_id").alias("problem"))
    times = r.where(~(is_finite(F.col("start")) & is_finite(F.col("end"))) | (F.col("start") < 0) | (F.col("start") >= F.col("end"))).select("rec", "id", F.lit("invalid_time"))
    said = r.select("rec", "id", F.explode("speakers").alias("label"))
    strange = va.missing_references(said, doc.speakers, ["rec", "label"]).select("rec", "id", F.lit("unknown_speaker"))
    lost = va.missing_references(doc.links, r, ["rec", "id"]).select("rec", "id", F.lit("unknown_row"))
    gone = va.missing_references(doc.links, doc.differences, ["rec", "diff"]).select("rec", "id", F.lit("unknown_difference"))
    return twice.union(times).union(strange).union(lost).union(gone)


def source_material(doc: Document) -> tuple[DataFrame, DataFrame]:
    """Compact segments and differences, each with the ids of the other."""
    ids = doc.links.groupBy("rec", "id").agg(F.array_sort(F.collect_list("diff")).alias("difference_ids"))
    segments = doc.rows.join(ids, ["rec", "id"], "left").withColumn("difference_ids", F.coalesce("difference_ids", F.array().cast("array<bigint>")))
    segments = segments.select("rec", "id", "start", "end", "text", "speakers", "state", "difference_ids", "flags", "playback_start", "playback_end", "time_kind", "a", "b")
    by = rv.inverse_links(doc.differences, doc.links)
    return segments, doc.differences.join(by, ["rec", "diff"])


def artifact_ids(doc: Document) -> DataFrame:
    """(rec, artifact_id) over the rows in order."""
    rows = doc.rows.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("a", "id", "start", "end", "text", "speakers", "state", "flags"))).alias("rows"))
    return va.identities(rows, "rec", ["rows"])


def checks(doc: Document) -> list[tuple[str, DataFrame]]:
    """Named violation queries in the order in which they are to run."""
    texts = doc.texts.select("rec", F.col("text").alias("_whole"))
    whole = va.lossless(doc.rows, texts, ["rec"], "a", "text", "_whole")
    spans = doc.rows.join(doc.texts.select("rec", F.length("text").cast("long").alias("_n")), "rec")
    return [
        ("segment_text_preservation", whole.where("NOT ok")),
        ("segment_coverage", sessionize.contiguity_violations(spans, ["rec"], ["a"], "a", "b", 0, "_n")),
        ("timestamps_ids_and_references", row_violations(doc)),
        ("states", doc.rows.where(~F.col("state").isin(*STATES))),
    ]


def validate(doc: Document) -> tuple[list[tuple[str, str]], str | None]:
    """The status of each check up to the first failure, and its name."""
    return va.first_failure(checks(doc))


def indicators(doc: Document) -> DataFrame:
    """(rec, kind, value, n): counts of states and kinds of time, zeros too."""
    states = va.indicators(doc.rows, ["rec"], "state", STATES).select("rec", F.lit("state").alias("kind"), "value", "n")
    return states.union(va.indicators(doc.rows, ["rec"], "time_kind", TIME_KINDS).select("rec", F.lit("time_kind"), "value", "n"))


def save(doc: Document, path: str) -> None:
    """Write segments, differences and readable text to a new place; nothing
    is written if a check fails.  Files hold ranges of recordings in order."""
    _, failed = validate(doc)
    if failed:
        raise ValueError(f"not saved: {failed} failed")
    segments, differences = source_material(doc)
    for df, order, name in ((segments, "a", "segments"), (differences, "diff", "differences")):
        documents.write_json(df.repartitionByRange("rec").sortWithinPartitions("rec", order), f"{path}/{name}.jsonl")
    text = rv.render(doc.rows)
    documents.write_text(text, "body", f"{path}/transcript.txt")
    documents.write_text(markdown(text), "body", f"{path}/transcript.md")


def markdown(rendered: DataFrame, title: str = "Unverified transcript") -> DataFrame:
    """(rec, body) of rendered texts under a heading and a caution."""
    head = F.lit(f"# {title}\n\nSpeakers, boundaries and words are candidates and need review.\n\n")
    return rendered.select("rec", F.concat(head, F.regexp_replace("body", "\n", "\n\n"), F.lit("\n")).alias("body"))


def model_metadata(models: DataFrame) -> DataFrame:
    """(rec, models): by name, what a reader needs of each model (rec, name,
    recorded map<string,string>, manifest), and a pointer to all of it.  Names are
    unique in a recording; a repeated one fails."""
    short = F.map_filter("recorded", lambda k, _: k.isin(*MODEL_FIELDS))
    place = json_pointer(F.lit("provenance"), F.lit("models"), F.col("name"))
    one = F.struct("name", F.struct(short.alias("recorded"), "manifest", place.alias("full_metadata_pointer")).alias("model"))
    return models.groupBy("rec").agg(F.map_from_entries(F.collect_list(one)).alias("models"))


def source_metadata(doc: Document, models: DataFrame | None = None) -> DataFrame:
    """(rec, artifact_id, speakers, counts, pointers, models): one row for each
    recording, which tells what its exports hold and where the rest lies."""
    count = lambda df, name: df.groupBy("rec").agg(F.count("*").alias(name))
    names = doc.speakers.groupBy("rec").agg(F.array_sort(F.collect_list("label")).alias("speakers"))
    own = artifact_ids(doc).join(names, "rec", "left").join(count(doc.rows, "_rows"), "rec", "left").join(count(doc.differences, "_diffs"), "rec", "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    counts = F.struct(n(F.col("_rows")).alias("segments"), n(F.col("_diffs")).alias("differences"))
    pointers = F.struct(*[json_pointer(F.lit(p)).alias(p) for p in POINTED])
    own = own.select("rec", "artifact_id", F.coalesce("speakers", F.array().cast("array<string>")).alias("speakers"), counts.alias("counts"), pointers.alias("pointers"))
    return own if models is None else own.join(model_metadata(models), "rec", "left")


def save_candidates(rows: DataFrame, texts: DataFrame, path: str) -> None:
    """Attributed sentences (``turns.attribute``) to a new place, unverified:
    their table, a readable list for each recording, and the texts as they came."""
    documents.write_json(rows.repartitionByRange("rec").sortWithinPartitions("rec", "a"), f"{path}/candidates.jsonl")
    documents.write_text(candidate_list(rows), "body", f"{path}/candidates.md")
    documents.write_json(texts.select("rec", "text"), f"{path}/text.jsonl")


def candidate_list(rows: DataFrame) -> DataFrame:
    """(rec, body): each sentence with its seconds, speakers, main candidate,
    state and flags, in order."""
    or_else = lambda c, other: F.when(F.length(c) > 0, c).otherwise(F.lit(other))
    who, main = or_else(F.array_join("speakers", ", "), "unknown speaker"), or_else(F.col("main").cast("string"), "none")
    said = F.format_string("[%.3f-%.3f] %s (main candidate: %s)\n%s\n\nstate: %s / %s\n", "start", "end", who, main, "text", "state", F.array_join("flags", ", "))
    body = F.transform(F.array_sort(F.collect_list(F.struct("a", said.alias("said")))), lambda x: x["said"])
    return rows.groupBy("rec").agg(F.concat(F.lit("# Speaker candidates\n\nTexts, speakers and times are unverified.\n\n"), F.array_join(body, "\n")).alias("body"))


def clip_problems(clips: DataFrame) -> DataFrame:
    """(rec, problem): why an aligned clip cannot become a document.

    ``clips`` is (rec, status, limited, text, aligned_text, sha256,
    recorded_sha256, pcm, aligned_pcm): the alignment must be complete, the
    transcription not cut off, and both made from the same text and sound.
    Nulls count as broken.
    """
    rules = [
        (F.col("status") == "completed", "alignment_not_completed"),
        (F.col("sha256") == F.col("recorded_sha256"), "audio_changed"),
        (~F.col("limited"), "token_limit_reached"),
        (F.col("text") == F.col("aligned_text"), "text_differs"),
        (F.col("pcm") == F.col("aligned_pcm"), "sound_differs"),
    ]
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules])
    return clips.select("rec", F.explode(F.array_compact(broken)).alias("problem"))


def review_document(clips: DataFrame, tokens: DataFrame, events: DataFrame, readings: DataFrame | None = None, regions: DataFrame | None = None) -> Document:
    """The document of single aligned clips: ``clips`` has what ``clip_problems``
    asks for and their ``offset`` and ``duration``.  All must be sound."""
    bad = clip_problems(clips).groupBy("problem").agg(F.count("*").alias("n"), F.min(F.col("rec").cast("string")).alias("first")).orderBy("problem").collect()
    if bad:
        raise ValueError("; ".join(f"{r['problem']}: {r['n']} clips, the first {r['first']}" for r in bad))
    return make_document(clips.select("rec", "text", "offset", "duration"), tokens, events, readings, regions)


def read_segments(spark: SparkSession, path: str, doc: Document) -> tuple[DataFrame, DataFrame]:
    """The segments and differences of a saved bundle, with the types of ``doc``."""
    segments, differences = source_material(doc)
    read = lambda df, name: documents.read_lines(spark, f"{path}/{name}.jsonl", df.schema)
    return read(segments, "segments"), read(differences, "differences")


def save_review(applied: DataFrame, reviews: DataFrame, doc: Document, path: str) -> None:
    """Four outputs of a review in a new place: all rows, those ready for
    anonymous use, the review as it came, and what was applied to what."""
    documents.write_json(applied.repartitionByRange("rec").sortWithinPartitions("rec", "a"), f"{path}/reviewed.jsonl")
    documents.write_json(applied.where("ready_anonymous").repartitionByRange("rec").sortWithinPartitions("rec", "a"), f"{path}/ready.jsonl")
    documents.write_json(reviews, f"{path}/review.jsonl")
    counts = rv.document_ready(applied).join(applied.groupBy("rec").agg(F.count_if("ready_attributed").alias("ready_attributed")), "rec")
    documents.write_json(artifact_ids(doc).withColumnRenamed("artifact_id", "source_artifact_id").join(counts, "rec"), f"{path}/application.json")


def save_plan(spark: SparkSession, plan: DataFrame, signals: DataFrame, rate: int, path: str) -> None:
    """A chunk plan (rec, part, a, b, boundary) with one wave file to a chunk of
    (rec, pcm), and the list of these files, all in a new place."""
    name = F.format_string("%s-%03d", F.col("rec").cast("string"), F.col("part"))
    cut = F.expr("substring(pcm, int(a * 4 + 1), int((b - a) * 4))")
    named = plan.withColumn("name", name)
    documents.write_json(named.withColumn("file", F.concat("name", F.lit(".wav"))).drop("name"), f"{path}/plan.jsonl")
    wav.write(named.join(signals, "rec").select("name", F.lit(rate).alias("rate"), cut.alias("pcm")), f"{path}/chunks")
    documents.write_text(named.repartitionByRange("rec").sortWithinPartitions("rec", "part").select(F.concat("name", F.lit(".wav")).alias("value")), "value", f"{path}/files.txt")


def chunk_plan(frames: DataFrame, rate: int, max_seconds: float = partition.MAX_SECONDS, signals: DataFrame | None = None) -> DataFrame:
    """Parts of each recording from its score frames and, for places without a
    pause, its signal (rec, pcm)."""
    totals = frames.groupBy("rec").agg(F.max("end_sample").alias("samples"))
    pauses = sessionize.pause_runs(frames, totals, rate).where("NOT edge")
    return partition.partition_at_pauses(pauses, totals, rate, max_seconds, signals)


def run_pipeline(spark: SparkSession, texts: DataFrame, tokens: DataFrame, events: DataFrame, readings: DataFrame | None = None, regions: DataFrame | None = None, path: str | None = None, log: StageLog | None = None) -> Document:
    """Assemble, validate and, with a path, save; stages go to ``log``."""
    log = log or StageLog([])
    with log.stage("assemble"):
        doc = make_document(texts, tokens, events, readings, regions)
    with log.stage("validate"):
        _, failed = validate(doc)
        if failed:
            raise ValueError(f"{failed} failed")
    if path:
        with log.stage("save"):
            save(doc, path)
    return doc


def settings_identity(settings: DataFrame, assets: DataFrame) -> DataFrame:
    """(key, artifact_id): digest of named settings (key, name, value) and the
    assets (key, path, bytes, sha256) that a result depends on, in order."""
    a = settings.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("settings"))
    b = assets.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("path", "bytes", "sha256"))).alias("assets"))
    return va.identities(a.join(b, "key", "full"), "key", ["settings", "assets"])


POINTER = "key string, attempt string, files array<struct<path:string,bytes:bigint,sha256:string>>"


def complete(spark: SparkSession, directory: str, key: str, attempt: str) -> None:
    """Point ``directory`` to a finished attempt, a folder inside it: its cache
    key and the fingerprints of all its files.  The pointer is put in place last
    and at once."""
    files = relative_inventory(spark, f"{directory}/{attempt}").agg(F.array_sort(F.collect_list(F.struct("path", "bytes", "sha256"))).alias("files"))
    one = files.select(F.lit(key).alias("key"), F.lit(attempt).alias("attempt"), "files")
    documents.replace_path(spark, f"{directory}/completed", lambda at: one.write.json(at))


def relative_inventory(spark: SparkSession, directory: str) -> DataFrame:
    """(path, bytes, sha256) with paths from the directory on; a path that is
    not below it stays whole, and so matches nothing recorded."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString()
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    base, path = plain(F.lit(root.rstrip("/") + "/")), plain(F.col("path"))
    inside = F.substr(path, F.length(base) + 1)
    return va.inventory(spark, directory).withColumn("path", F.when(path.startswith(base), inside).otherwise(path))


def completed_attempt(spark: SparkSession, directory: str, key: str) -> str | None:
    """The folder of the attempt that ``complete`` pointed to, if its key is the
    same, it lies in the directory and no file of it changed; else none."""
    try:
        pointer = spark.read.schema(POINTER).json(f"{directory}/completed").first()
    except AnalysisException:
        return None
    if pointer is None or pointer["key"] != key or not pointer["attempt"] or "/" in pointer["attempt"] or pointer["attempt"] in (".", "..") or not pointer["files"]:
        return None
    where = f"{directory}/{pointer['attempt']}"
    recorded = spark.createDataFrame(pointer["files"], "path string, bytes long, sha256 string")
    try:
        same = va.valid_cache(recorded, relative_inventory(spark, where)).limit(1).count() == 0
    except AnalysisException:
        return None
    return where if same else None


@dataclass
class StageLog:
    """Stages of a run with their status and seconds, on the driver."""

    stages: list[dict]

    @contextmanager
    def stage(self, name: str) -> Iterator[dict]:
        row = {"name": name, "status": "running"}
        self.stages.append(row)
        began = time.perf_counter()
        try:
            yield row
            row["status"] = "complete"
        except BaseException as error:
            row.update(status="failed", error=f"{type(error).__name__}: {error}"[:500])
            raise
        finally:
            row["seconds"] = time.perf_counter() - began

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(s["name"], s["status"], s.get("seconds"), s.get("error")) for s in self.stages]
        return spark.createDataFrame(rows, "name string, status string, seconds double, error string")


def cached(spark: SparkSession, directory: str, recorded: DataFrame | None, produce: Callable[[], None]) -> bool:
    """True if the files of ``directory`` are those recorded (path, bytes,
    sha256); otherwise ``produce`` runs and False is returned."""
    if recorded is not None and va.valid_cache(recorded, va.inventory(spark, directory)).limit(1).count() == 0:
        return True
    produce()
    return False
