"""Documents of rows, their links and views, and the overlay of human review.

Transcript rows are (rec, id, start, end, text, speakers, state, flags, a, b);
reviews are (rec, id, content, speaker, boundary, note, text, speakers, start,
end) with the reviewer's corrections in the last four columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.functions.text import difference_overlaps, label, ordered_flags, stamp
from spanloom.operators import intervals, joins

PAD_SECONDS = 2.0
#: Characters of a bucket in which rows and differences meet.
CHARACTERS = 1_000
STATUSES = ("pass", "fail", "review_required", "not_applicable")


def speaker_labels(events: DataFrame, key: str = "rec", speaker: str = "spk", a: str = "a", b: str = "b", ident: str = "id") -> DataFrame:
    """(key, speaker, rank, label): letters by first appearance (start, end,
    original position).  Labels past the 26th go on in code points."""
    first = events.groupBy(key, speaker).agg(F.min(F.struct(a, b, ident)).alias("_f"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_f")) - 1
    return first.withColumn("rank", rank).select(key, speaker, F.col("rank").cast("long").alias("rank"), label(F.col("rank")).alias("label"))


def document_state(speakers: Column, overlapped: Column, foreign: Column) -> Column:
    return F.when(F.size(speakers) == 0, "unknown").when(overlapped | foreign, "mixed").otherwise("single")


def playback(df: DataFrame, lo: Column, hi: Column, pad: float = PAD_SECONDS) -> DataFrame:
    return df.withColumns({"playback_start": F.greatest(lo, F.col("start") - pad), "playback_end": F.least(hi, F.col("end") + pad)})


def difference_links(rows: DataFrame, differences: DataFrame, total: Column) -> DataFrame:
    """(rec, id, diff): differences (rec, diff, s, e) with the rows (rec, id, a,
    b) that they belong to; ``total`` is the text's length, a column of rows."""
    # an empty difference takes the character that it precedes, or the last one, and then both overlap
    n = rows.withColumn("_total", total).groupBy("rec").agg(F.max("_total").alias("_total"))
    d = differences.join(n, "rec").withColumns({"_s": F.when((F.col("s") == F.col("e")) & (F.col("s") == F.col("_total")), F.col("s") - 1).otherwise(F.col("s")), "_e": F.greatest(F.col("e"), F.col("s") + 1)})
    met = joins.interval_join(rows.select("rec", "id", "a", "b"), d.select("rec", "diff", "s", "e", "_total", "_s", "_e"), ["rec"], CHARACTERS, ("a", "b"), ("_s", "_e"))
    return met.where(difference_overlaps(F.col("s"), F.col("e"), F.col("a"), F.col("b"), F.col("_total"))).select("rec", "id", "diff")


def inverse_links(differences: DataFrame, links: DataFrame) -> DataFrame:
    """(rec, diff, ids): every difference, with no ids if it belongs nowhere."""
    by = links.groupBy("rec", "diff").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return differences.select("rec", "diff").join(by, ["rec", "diff"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def render(rows: DataFrame, separator: str = "\n") -> DataFrame:
    """(rec, body): rows as ``[mm:ss.mmm] speaker: text`` in order."""
    who = F.when(F.size("speakers") > 0, F.array_join("speakers", "+")).otherwise("?")
    line = F.concat(F.lit("["), stamp(F.col("start")), F.lit("] "), who, F.lit(": "), F.col("text"))
    return rows.groupBy("rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", line.alias("line")))), lambda x: x["line"]), separator).alias("body"))


def valid_review_time(value: Column) -> Column:
    """ISO-8601 with a zone."""
    shaped = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.coalesce(shaped & F.try_to_timestamp(value).isNotNull(), F.lit(False))


def unknown_reviews(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    return reviews.join(rows.select("rec", "id"), ["rec", "id"], "left_anti")


def _nonblank(x: Column) -> Column:
    return F.coalesce(F.length(F.trim(x)) > 0, F.lit(False))


def review_violations(rows: DataFrame, reviews: DataFrame, listened: DataFrame, known: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """(rec, id, problem): why reviews cannot be applied.

    ``listened`` is (rec, a, b), ``known`` (rec, spk), ``windows`` (rec, lo, hi)
    what the recording covers.  A row with a decision or a correction must have
    been listened to in its original and in its corrected extent; fail and
    not_applicable need a note; a pass of speaker needs a known speaker, one of
    content needs text.  Where reviews carry ``original`` (struct of text,
    speakers, start and end), it must be that of the row.
    """
    names = known.groupBy("rec").agg(F.collect_set("spk").alias("names"))
    extra = ["original"] if "original" in reviews.columns else []
    r = reviews.select("rec", "id", "content", "speaker", "boundary", "note", *extra, *[F.col(c).alias(f"c_{c}") for c in ("text", "speakers", "start", "end")])
    met = r.join(rows.select("rec", "id", "text", "speakers", "start", "end"), ["rec", "id"]).join(names, "rec", "left")
    if windows is not None:
        met = met.join(windows.select("rec", F.col("lo").alias("_wlo"), F.col("hi").alias("_whi")), "rec", "left")
    else:
        met = met.withColumns({"_wlo": F.lit(float("-inf")), "_whi": F.lit(float("inf"))})
    met = met.withColumns({"_lo": F.coalesce("c_start", "start"), "_hi": F.coalesce("c_end", "end"), "_said": F.coalesce("c_speakers", "speakers"), "_text": F.coalesce("c_text", "text")})
    extents = [met.select("rec", "id", F.lit(k).alias("k"), F.col(a).alias("a"), F.col(b).alias("b")) for k, a, b in ((0, "start", "end"), (1, "_lo", "_hi"))]
    both = extents[0].union(extents[1]).select("rec", F.struct("id", "k").alias("ident"), "a", "b")
    heard = intervals.covered(both, ["rec"], "ident", listened).select("rec", "ident.id", "covered").groupBy("rec", "id").agg(F.bool_and("covered").alias("covered"))
    met = met.join(heard, ["rec", "id"], "left")
    ok = lambda c: F.coalesce(c, F.lit(False))
    status = lambda c: ~ok(F.col(c).isin(*STATUSES))
    anyone = lambda test: test("content") | test("speaker") | test("boundary")
    inside = lambda a, b: ok(intervals.is_finite(F.col(a)) & intervals.is_finite(F.col(b)) & (F.col(a) >= F.col("_wlo")) & (F.col(a) < F.col(b)) & (F.col(b) <= F.col("_whi")))
    wrong = (F.size(F.array_distinct("_said")) != F.size("_said")) | (F.size(F.array_except("_said", F.coalesce("names", F.array().cast("array<string>")))) > 0)
    decided = anyone(lambda c: ok(F.col(c) != "review_required"))
    corrected = F.col("c_text").isNotNull() | F.col("c_speakers").isNotNull() | F.col("c_start").isNotNull() | F.col("c_end").isNotNull()
    told = ~F.col("original").eqNullSafe(F.struct("text", "speakers", "start", "end")) if extra else F.lit(False)
    problems = ordered_flags(
        (told, "original_differs"),
        (anyone(status), "invalid_status"),
        (ok(anyone(lambda c: ok(F.col(c).isin("fail", "not_applicable"))) & ~_nonblank(F.col("note"))), "note_required"),
        (~(inside("start", "end") & inside("_lo", "_hi")), "invalid_interval"),
        (ok(wrong), "invalid_speakers"),
        ((decided | corrected) & ~ok(F.col("covered")), "not_listened_to"),
        (ok(F.col("speaker") == "pass") & ~ok(F.size("_said") > 0), "speaker_required"),
        (ok(F.col("content") == "pass") & ~_nonblank(F.col("_text")), "text_required"),
    )
    return met.select("rec", "id", F.explode(problems).alias("problem")).union(unknown_reviews(rows, reviews).select("rec", "id", F.lit("unknown_row")))


def apply_review(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """``rows`` with the review's corrections and readiness.

    Anonymous use needs content and boundary passed and the speaker passed or
    not applicable; attributed use also a passed, single speaker.  A passed
    speaker leaves a row mixed if it was, if activities overlap (column
    ``overlaps``, where there is one) or if several speakers are named, else
    single.  Rows without a review are not ready.  The model's values stay in
    ``model``.
    """
    r = reviews.select("rec", "id", "content", "speaker", "boundary", F.col("text").alias("_text"), F.col("speakers").alias("_speakers"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.lit(True).alias("reviewed"))
    m = rows.withColumn("model", F.struct("text", "speakers", "start", "end")).join(r, ["rec", "id"], "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))
    for c in ("content", "speaker", "boundary"):
        m = m.withColumn(c, F.coalesce(c, F.lit("review_required")))
    none = F.array().cast("array<string>")
    said = F.coalesce("_speakers", "speakers")
    na, ok = F.col("speaker") == "not_applicable", F.col("speaker") == "pass"
    overlapped = F.coalesce(F.size("overlaps") > 0, F.lit(False)) if "overlaps" in rows.columns else F.lit(False)
    mixed = overlapped | F.coalesce(F.col("state") == "mixed", F.lit(False)) | (F.size(said) > 1)
    state = F.when(ok, F.when(mixed, "mixed").otherwise("single")).when(na, "unknown").otherwise(F.col("state"))
    status = F.when(ok, F.when(F.size(said) == 1, "human_reviewed").otherwise("human_reviewed_multiple_speakers_not_individual_word_ownership")).when(na, "not_applicable_to_anonymous_summary")
    anonymous = (F.col("content") == "pass") & (F.col("boundary") == "pass") & (ok | na)
    moved = F.col("_start").isNotNull() | F.col("_end").isNotNull()
    m = m.withColumns({
        "text": F.coalesce("_text", "text"), "candidate_speakers": F.when(na, said).otherwise(none), "corrected_time": moved, "attribution_status": status,
        "start": F.coalesce("_start", "start"), "end": F.coalesce("_end", "end"), "ready_anonymous": anonymous, "ready_attributed": anonymous & ok & (F.size(said) == 1), "state": state,
    })
    if "time_kind" in rows.columns:
        m = m.withColumn("time_kind", F.when(moved, "human_corrected_source_range").otherwise(F.col("time_kind")))
    return m.withColumn("speakers", F.when(na, none).otherwise(F.coalesce("_speakers", "speakers"))).drop("_text", "_speakers", "_start", "_end")


def document_ready(applied: DataFrame) -> DataFrame:
    """(rec, rows, ready, all_anonymous, all_attributed): all, and not none."""
    n = F.count("*")
    return applied.groupBy("rec").agg(
        n.alias("rows"), F.count_if("ready_anonymous").alias("ready"), ((n > 0) & F.bool_and("ready_anonymous")).alias("all_anonymous"), ((n > 0) & F.bool_and("ready_attributed")).alias("all_attributed")
    )
