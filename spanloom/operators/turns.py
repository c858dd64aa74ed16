"""Sentences, their boundaries in time, and cautious speaker attribution.

Tables (all keyed by ``rec``):
  texts(rec, text, offset, duration)      tokens(rec, idx, xa, xb, ra, rb, repaired, flags, part, eligible)
  events(rec, id, spk, a, b)              regions(rec, xa, xb, start, end, part) of the source chunks
Token times are clip seconds, spans code points, null where unmapped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from spanloom.functions.text import cut_spans, ordered_flags, sentence_id, sentence_spans, sentences
from spanloom.operators import intervals, joins, placing, sessionize
from spanloom.operators.align import SNAP
from spanloom.operators.scratch import materialize

BRIEF_SECONDS = 2.5
#: Characters of a bucket in which sentences and changes meet.
CHARACTERS = 400


def chunk_spans(texts: DataFrame, regions: DataFrame) -> DataFrame:
    """(rec, a, b, split_a, split_b, sentence): sentences, cut at the starts of
    later regions too; a split marks an end that is such a cut only."""
    natural = sentence_spans(texts, ["rec"])
    w = Window.partitionBy("rec").orderBy("xa")
    seams = regions.withColumn("_k", F.row_number().over(w)).where("_k > 1").select("rec", F.col("xa").cast("long").alias("cut"))
    only = seams.join(natural.select("rec", F.col("b").alias("cut")), ["rec", "cut"], "left_anti").withColumn("_seam", F.lit(True))
    text = texts.select("rec", "text")
    spans = cut_spans(text, ["rec"], [natural.select("rec", F.col("b").alias("cut")), seams], F.length("text"))
    spans = spans.join(only.withColumnRenamed("cut", "a").withColumnRenamed("_seam", "split_a"), ["rec", "a"], "left")
    spans = spans.join(only.withColumnRenamed("cut", "b").withColumnRenamed("_seam", "split_b"), ["rec", "b"], "left")
    part = F.substring(F.col("text"), F.col("a").cast("int") + 1, (F.col("b") - F.col("a")).cast("int"))
    return spans.join(text, "rec").select("rec", "a", "b", F.coalesce("split_a", F.lit(False)).alias("split_a"), F.coalesce("split_b", F.lit(False)).alias("split_b"), part.alias("sentence"))


def placed_sentences(texts: DataFrame, tokens: DataFrame | None, regions: DataFrame | None) -> DataFrame:
    """The sentences of ``texts`` beside their tokens (``placing.placed``);
    without ``tokens`` the texts carry them, packed."""
    if tokens is not None:
        texts = texts.join(placing.pack_tokens(tokens), "rec", "left")
    one = ("sentence", "split_a", "split_b")
    if regions is None:
        uncut = F.transform(sentences(F.col("text")), lambda x: F.struct(x.alias("sentence"), F.lit(False).alias("split_a"), F.lit(False).alias("split_b")))
        return placing.placed(texts.withColumn("said", uncut), None, None)
    cut = chunk_spans(texts, regions).groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("a", *one))).alias("said"))
    return placing.placed(texts, cut.withColumn("said", F.transform("said", lambda x: F.struct(*[x[c].alias(c) for c in one]))), regions)


def boundaries(placed: DataFrame) -> DataFrame:
    """Inner ends of placed sentences with the tokens around them.

    (rec, cut, left, right, flags, eligible, at): ``left`` is the last mapped
    token that ends by the cut, ``right`` the first that starts at it or later.
    A boundary without flags has the raw end of its left token as time.
    """
    flags = ordered_flags(*[(F.col("bits").bitwiseAND(1 << k) != 0, f) for k, f in enumerate(placing.BOUNDARY_FLAGS)])
    return placed.where("inner").select("rec", F.col("b").alias("cut"), "left", "right", flags.alias("flags"), (F.col("bits") == 0).alias("eligible"), "at")


def snap_transitions(changes: DataFrame, bounds: DataFrame, gates: DataFrame, snap: float = SNAP) -> DataFrame:
    """Each change of speaker with the nearest eligible boundary in ``snap``
    seconds (ties: the smaller offset), unless the recording is gated.

    changes(rec, id, from_speaker, to_speaker, at); gates(rec, gated).  State is
    resolved, or unresolved: none near, or neighbours among those that snapped
    whose offsets do not rise.  Conflicting ones keep their snapped values.
    """
    open_ = bounds.where("eligible").join(changes.select("rec").distinct(), "rec", "left_semi").select("rec", "cut", F.col("at").alias("snapped"))
    met = changes.join(gates, "rec", "left").withColumn("gated", F.coalesce("gated", F.lit(False)))
    near = joins.nearest_join(met, open_, ["rec"], "at", "snapped", snap, ["cut"])
    near = near.withColumns({"cut": F.when(~F.col("gated"), F.col("cut")), "snapped": F.when(~F.col("gated"), F.col("snapped"))})
    clash = sessionize.conflicts(near.where("cut IS NOT NULL"), "rec", "id", "cut").where("conflict").select("rec", "id", "conflict")
    out = near.join(clash, ["rec", "id"], "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    none = F.col("cut").isNull()
    return out.withColumns({
        "resolved": ~none & ~F.col("conflict"),
        "flags": ordered_flags((none & F.col("gated"), "input_repair_gate"), (none & ~F.col("gated"), "no_eligible_sentence_boundary_near_start"), (F.col("conflict"), "competing_or_nonmonotonic_sentence_boundary")),
    })


def attribute(texts: DataFrame, tokens: DataFrame | None, events: DataFrame, regions: DataFrame | None = None, snap: float = SNAP, anchor: float = sessionize.ANCHOR_SECONDS) -> DataFrame:
    """One row per sentence: text, span, time, speaker if it is safe, flags.

    (rec, id, start, end, text, a, b, speakers, main, state, flags, time_kind,
    events, other_events, overlaps).  Doubt leaves ``speakers`` empty; times
    are never interpolated but fall back to the extent of the source chunk.
    Without ``tokens``, ``texts`` carry them in a column ``tokens`` of arrays of
    ``placing.packed``: then no text and no token is shuffled here.
    """
    composite = regions is not None
    spans = materialize(placed_sentences(texts, tokens, regions).drop("left", "right"))
    known = spans.groupBy("rec").agg(F.any_value("duration").alias("duration"), F.any_value("gated").alias("gated"))
    # only sentences of recordings with events go into the joins below
    live = materialize(intervals.clip(events.join(known.select("rec", "duration"), "rec"), F.lit(0.0), F.col("duration")).drop("duration"))
    lasting = materialize(sessionize.activity_candidates(live, anchor=anchor).where("activity = 'sustained'").select("rec", "spk", "grp", "a", "b"))
    turns = sessionize.major_turns(lasting, "rec", ["a", "b", "spk"], "spk").groupBy("rec", "turn", "spk").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    grouped = sessionize.coalesce_activity(live.select("rec", "id", "spk", "a", "b")).join(lasting.select("rec", "spk", "grp", F.lit(True).alias("lasting")), ["rec", "spk", "grp"], "left").withColumn("lasting", F.coalesce("lasting", F.lit(False)))
    changes = sessionize.transitions(turns, "rec", "spk")
    bounds = spans.where("inner AND bits = 0").select("rec", F.col("b").alias("cut"), F.lit(True).alias("eligible"), "at")
    moves = materialize(snap_transitions(changes, bounds, known.select("rec", "gated"), snap))
    first = turns.where("turn = 0").select("rec", F.col("spk").alias("first_speaker"))
    whole = spans.where("inside")
    s = whole.join(live.select("rec").distinct(), "rec", "left_semi").select("rec", "pos", "a", "b", "start", "end").join(first, "rec", "left")

    # the last applicable change decides; one inside makes the row unsafe
    # resolved ones apply in text, the others in time
    def latest(df: DataFrame, at: str, place: str, name: str) -> DataFrame:
        """(rec, place, name): the latest move among those up to each place."""
        each = df.groupBy("rec", F.col(at).alias(place)).agg(F.max(F.struct(F.col("id").alias("move"), "to_speaker")).alias("_m"))
        upto = Window.partitionBy("rec").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
        return each.select("rec", place, F.max("_m").over(upto).alias(name))

    cuts, times = latest(moves.where("resolved"), "cut", "m_cut", "by_cut"), latest(moves.where("NOT resolved"), "at", "m_at", "by_time")
    s = joins.asof_join(joins.asof_join(s, cuts, ["rec"], "a", "m_cut"), times, ["rec"], "start", "m_at").drop("m_cut", "m_at")
    s = s.withColumn("main", F.coalesce(F.greatest("by_cut", "by_time")["to_speaker"], "first_speaker")).drop("by_cut", "by_time")
    point = lambda df, c: df.select("rec", F.col(c).alias("_p"), F.col(c).alias("_q"))
    met = joins.interval_join(s.select("rec", "pos", "a", "b"), point(cuts, "m_cut"), ["rec"], CHARACTERS, ("a", "b"), ("_p", "_q")).select("rec", "pos")
    met = met.union(joins.interval_join(s.select("rec", "pos", "start", "end"), point(times, "m_at"), ["rec"], sessionize.BUCKET, ("start", "end"), ("_p", "_q")).select("rec", "pos"))
    s = materialize(s.join(met.distinct().withColumn("cut_inside", F.lit(True)), ["rec", "pos"], "left").drop("a", "b", "first_speaker"))

    # activity in the sentence's time
    e = grouped.select("rec", F.col("id").alias("eid"), F.col("spk").alias("espk"), F.col("a").alias("ea"), F.col("b").alias("eb"), "lasting")
    act = joins.interval_join(s.select("rec", "pos", "start", "end", "main"), e, ["rec"], sessionize.BUCKET, ("start", "end"), ("ea", "eb"))
    act = materialize(act)
    foreign = ~F.col("espk").eqNullSafe(F.col("main"))
    seen = act.groupBy("rec", "pos").agg(
        F.array_sort(F.collect_list("eid")).alias("events"), F.array_sort(F.collect_list(F.when(foreign, F.col("eid")))).alias("other_events"), F.bool_or(~foreign).alias("supported")
    )
    key = ["rec", "pos"]
    brief = act.where(foreign & ~F.col("lasting")).select(*key, "eid", F.greatest("start", "ea").alias("a"), F.least("end", "eb").alias("b"))
    exposed = intervals.uncovered(brief, key, "eid", act.where(~foreign).select(*key, F.col("ea").alias("a"), F.col("eb").alias("b")))
    exposed = exposed.groupBy(*key).agg(F.bool_or(F.col("uncovered") > sessionize.EXPOSED).alias("exposed"))
    l, r = act.alias("l"), act.select(*key, "eid", "espk", "ea", "eb").alias("r")
    lo, hi = F.greatest("l.start", "l.ea", "r.ea"), F.least("l.end", "l.eb", "r.eb")
    pairs = l.join(r, (F.col("l.rec") == F.col("r.rec")) & (F.col("l.pos") == F.col("r.pos")) & (F.struct("l.ea", "l.eb", "l.eid") < F.struct("r.ea", "r.eb", "r.eid")) & (F.col("l.espk") != F.col("r.espk"))).where(lo < hi)
    both = pairs.groupBy("l.rec", "l.pos").agg(F.array_sort(F.collect_list(F.struct(lo.alias("start"), hi.alias("end"), F.col("l.eid").alias("left"), F.col("r.eid").alias("right")))).alias("overlaps"))
    found = s.drop("start", "end").join(seen, key, "left").join(exposed, key, "left").join(both, key, "left")
    s = whole.join(found, key, "left")

    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    doubt = F.col("unmapped") | F.col("child_gate") | F.col("crosses") | F.col("split") | yes("cut_inside") | yes("exposed")
    unsafe = doubt | ~yes("supported") | ~F.col("timed")
    short = F.col("end") - F.col("start") < BRIEF_SECONDS
    flags = ordered_flags(
        (F.lit(True), "not_human_verified"),
        (F.lit(True), "asr_text_accuracy_not_established"),
        (~F.col("timed"), "broad_playback_timing_fallback"),
        (F.col("flagged"), "contains_flagged_alignment_tokens"),
        (F.col("child_gate"), "alignment_chunk_repair_gate"),
        (F.col("crosses"), "alignment_chunk_seam_inside_sentence"),
        (F.col("split"), "sentence_split_at_alignment_chunk_boundary"),
        (F.col("unmapped"), "unmapped_lexical_text_timing_unresolved"),
        (F.coalesce(F.size("other_events") > 0, F.lit(False)), "other_speaker_activity_ownership_unresolved"),
        (yes("exposed"), "unseparated_brief_other_speaker_activity"),
        (F.col("overlaps").isNotNull(), "raw_diarization_overlap_ownership_unverified"),
        (doubt, "unresolved_major_transition_inside_sentence"),
        (~yes("supported"), "no_raw_activity_support_for_candidate_main"),
        (short, "brief_sentence_ownership_unresolved"),
        (F.col("gated"), "input_repair_gate"),
    )
    sure = F.col("main").isNotNull() & ~(F.col("gated") | unsafe | short)
    fallback = "source_chunk_envelope_fallback" if composite else "source_clip_envelope_fallback"
    return s.select(
        "rec", sentence_id(F.col("pos")).alias("id"), (F.col("offset") + F.col("start")).alias("start"), (F.col("offset") + F.col("end")).alias("end"),
        F.col("sentence").alias("text"), "a", "b", F.when(sure, F.array("main")).otherwise(F.array().cast("array<string>")).alias("speakers"), "main",
        F.when(sure, "candidate_main_not_verified").otherwise("unknown_requires_review").alias("state"), flags.alias("flags"),
        F.when(F.col("timed"), "forced_alignment_token_envelope").otherwise(fallback).alias("time_kind"), "events", "other_events", "overlaps",
    )
