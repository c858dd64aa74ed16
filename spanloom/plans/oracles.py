"""DuckDB SQL for the queries, written from the semantics, not from the plans.

No SQL: the token maps and audits (sequence matching), sentence_attribution and
scanned_inventory; tests hold these against plain loops.
"""

from __future__ import annotations

_ACT = """act AS (SELECT * FROM (SELECT user_id % 20 AS rec, event_id AS id, event_type AS spk,
  date_diff('second', TIMESTAMP '1970-01-01', ts) AS a,
  date_diff('second', TIMESTAMP '1970-01-01', ts) + CAST(floor(value * 60) AS BIGINT) AS b FROM events) WHERE b > a)"""
_FRAMES = """frames AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
  least(value / 500, 1.0) AS probability FROM events),
totals AS (SELECT rec, CAST(count(*) * 512 AS BIGINT) AS samples FROM frames GROUP BY rec)"""
_TURNS = """ev AS (SELECT user_id AS rec, event_id AS id, event_type AS spk,
  date_diff('second', TIMESTAMP '1970-01-01', ts) AS "at", CAST(floor(value * 60) AS BIGINT) AS len FROM events),
chg AS (SELECT *, CASE WHEN lag(spk) OVER (PARTITION BY rec ORDER BY "at", id) = spk THEN 0 ELSE 1 END AS n FROM ev),
tid AS (SELECT *, sum(n) OVER (PARTITION BY rec ORDER BY "at", id) - 1 AS turn FROM chg),
turns AS (SELECT rec, CAST(turn AS BIGINT) AS turn, spk, min("at") AS a, max("at" + len) AS b, count(*) AS n FROM tid GROUP BY rec, turn, spk),
trans AS (SELECT * FROM (SELECT rec, turn - 1 AS id, lag(spk) OVER w AS from_speaker, spk AS to_speaker, a AS "at", lag(b) OVER w AS prev_end
  FROM turns WINDOW w AS (PARTITION BY rec ORDER BY turn)) WHERE from_speaker IS NOT NULL)"""
_SNAP = """marks AS (SELECT rec, id AS mark, "at" AS mark_at FROM ev WHERE spk = 'purchase'),
snap AS (SELECT t.rec, t.id, t.to_speaker, t.at, m.mark, m.mark_at,
  row_number() OVER (PARTITION BY t.rec, t.id ORDER BY abs(m.mark_at - t.at), m.mark_at, m.mark) AS k
  FROM trans t LEFT JOIN marks m ON m.rec = t.rec AND abs(m.mark_at - t.at) <= 86400)"""
_GROUPS = f"""{_ACT},
pm AS (SELECT *, max(b) OVER (PARTITION BY rec, spk ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM act),
blk AS (SELECT DISTINCT m.id FROM pm m JOIN act o ON o.rec = m.rec AND o.spk <> m.spk AND o.a < m.a AND o.b > m.pm WHERE m.a > m.pm AND m.a - m.pm <= 3600),
fl AS (SELECT pm.*, CASE WHEN pm IS NULL OR (a > pm AND (a - pm > 3600 OR blk.id IS NOT NULL)) THEN 1 ELSE 0 END AS brk,
  CASE WHEN pm IS NULL OR a > pm THEN 1 ELSE 0 END AS ubrk FROM pm LEFT JOIN blk ON blk.id = pm.id),
mem AS (SELECT *, CAST(sum(brk) OVER w AS BIGINT) AS grp, sum(ubrk) OVER w AS isl FROM fl
  WINDOW w AS (PARTITION BY rec, spk ORDER BY a, b, id ROWS UNBOUNDED PRECEDING)),
isl AS (SELECT rec, spk, grp, isl, min(a) AS a, max(b) AS b FROM mem GROUP BY ALL),
cut AS (SELECT i.rec, i.spk, i.grp, i.isl, greatest(i.a, o.a) AS x, least(i.b, o.b) AS y
  FROM isl i JOIN act o ON o.rec = i.rec AND o.spk <> i.spk AND o.a < i.b AND o.b > i.a),
run AS (SELECT *, max(y) OVER (PARTITION BY rec, spk, isl ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM cut),
cov AS (SELECT rec, spk, isl, sum(greatest(0, y - greatest(x, coalesce(p, x)))) AS c FROM run GROUP BY ALL),
size AS (SELECT i.rec, i.spk, i.grp, min(i.a) AS a, max(i.b) AS b, CAST(sum(i.b - i.a) AS BIGINT) AS speech, CAST(sum(i.b - i.a - coalesce(c, 0)) AS BIGINT) AS single
  FROM isl i LEFT JOIN cov USING (rec, spk, isl) GROUP BY i.rec, i.spk, i.grp),
grps AS (SELECT size.rec, size.spk, size.grp, size.a, size.b, n, speech, single,
  CASE WHEN speech >= 7200 THEN 'sustained' WHEN single > 0 THEN 'brief' ELSE 'unresolved' END AS activity
  FROM size JOIN (SELECT rec, spk, grp, count(*) AS n FROM mem GROUP BY ALL) USING (rec, spk, grp))"""
_COVER = f"""{_ACT},
mine AS (SELECT * FROM act WHERE spk = 'purchase'),
oth AS (SELECT rec, a, b, max(b) OVER (PARTITION BY rec ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM act WHERE spk <> 'purchase'),
oi AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM oth),
solid AS (SELECT rec, min(a) AS a, max(b) AS b FROM oi GROUP BY rec, i)"""
_SENT = """sent AS (SELECT rec, CAST(pos - 1 AS BIGINT) AS pos, sentence,
  CAST(coalesce(sum(length(sentence)) OVER (PARTITION BY rec ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a,
  CAST(sum(length(sentence)) OVER (PARTITION BY rec ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b
  FROM (SELECT rec, unnest(p) AS sentence, generate_subscripts(p, 1) AS pos FROM (
    SELECT doc_id AS rec, list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '(\\d)\\.(\\d)', '\\1' || chr(57345) || '\\2', 'g'), '(\\d)\\.(\\d)', '\\1' || chr(57345) || '\\2', 'g'),
      '(?s)[^。？！?!.]*(?:[。？！?!.][。？！?!.」』）)\\]}”’"\\s\\p{Z}]*|$)'), lambda s: replace(s, chr(57345), '.')), lambda s: length(s) > 0) AS p FROM documents)))"""
_PARTS = """parts AS (SELECT l_orderkey AS rec, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag) - 1 AS part,
  l_returnflag = 'R' AS repaired, CAST(l_quantity AS BIGINT) AS len, CAST(l_linenumber AS BIGINT) AS line FROM lineitem)"""
_TIMED = f"""{_PARTS}, timed AS (SELECT *, part * 20 + len % 7 * 5 - 3 AS a, part * 20 + len % 7 * 5 - 3 + len - 2 AS b FROM parts)"""
_PAUSES = f"""{_FRAMES},
low AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY rec ORDER BY frame_idx) AS run FROM frames WHERE probability < 0.35),
pr AS (SELECT rec, CAST(min(frame_idx) * 512 AS BIGINT) AS a, CAST((max(frame_idx) + 1) * 512 AS BIGINT) AS b, count(*) AS n, min(frame_idx) AS first_frame FROM low GROUP BY rec, run HAVING count(*) * 512 >= 1024),
pe AS (SELECT pr.*, (a + b) // 2 AS midpoint, a = 0 OR b = samples AS edge FROM pr JOIN totals USING (rec))"""
def _greedy(top: int, half: int, early: int, forced: str, name: str) -> str:
    """A recursive walk over mids(rec, m) and totals(rec, samples)."""
    late = f"(SELECT max(m) FROM mids WHERE mids.rec = p.rec AND m BETWEEN p.b + {half} AND p.b + {top})"
    soon = f"(SELECT max(m) FROM mids WHERE mids.rec = p.rec AND m BETWEEN p.b + {early} AND p.b + {half} - 1)"
    return f"""walk AS (SELECT rec, -1 AS part, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, '' AS boundary, samples FROM totals
  UNION ALL
  SELECT p.rec, p.part + 1, p.b, CASE WHEN p.samples - p.b > {top} THEN coalesce({late}, {soon}, {forced}) ELSE p.samples END,
  CASE WHEN p.samples - p.b <= {top} THEN 'input_end' WHEN {late} IS NOT NULL THEN 'vad_pause_preferred' WHEN {soon} IS NOT NULL THEN 'vad_pause_early' ELSE '{name}' END, p.samples FROM walk p WHERE p.b < p.samples),
plan AS (SELECT * FROM walk WHERE part >= 0)"""


_GREEDY = f"""{_PAUSES}, mids AS (SELECT rec, midpoint AS m FROM pe WHERE NOT edge), {_greedy(10752, 5376, 2560, "p.b + 10752", "forced_maximum_without_signal")}"""
# four samples to a frame; the quietest window of four samples, then its least sample
_SIGNAL = """sig AS (SELECT rec, frame_idx * 4 + k AS i, CAST(floor(probability * 1000) AS BIGINT) * 4 + k * 3 % 4 AS x FROM frames, range(4) t(k)),
win AS (SELECT rec, i, CAST(sum(x) OVER w AS BIGINT) AS e, min(x * 10000000 + i) OVER w % 10000000 AS cut FROM sig WINDOW w AS (PARTITION BY rec ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))"""
_QUIET = "(SELECT arg_min(cut, e * 10000000 + i) FROM win WHERE win.rec = p.rec AND i BETWEEN p.b + 4 AND p.b + 40)"
_FRAMES4 = _FRAMES.replace("* 512", "* 4")
_ROWS = """r0 AS (SELECT doc_id % 20 AS rec, doc_id AS id, text, source FROM documents),
trows AS (SELECT *, CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS a, CAST(sum(length(text)) OVER w AS BIGINT) AS b FROM r0 WINDOW w AS (PARTITION BY rec ORDER BY id ROWS UNBOUNDED PRECEDING))"""
_LINKS = f"""{_ROWS}, tot AS (SELECT rec, max(b) AS n FROM trows GROUP BY rec),
dk AS (SELECT rec, n, unnest(range(0, n // 700 + 1)) AS diff FROM tot),
diffs AS (SELECT rec, n, diff, least(diff * 700, n) AS s, CASE WHEN diff % 3 = 0 THEN least(diff * 700, n) ELSE least(least(diff * 700, n) + 900, n) END AS e FROM dk),
links AS (SELECT t.rec, CAST(t.id AS VARCHAR) AS id, d.diff FROM trows t JOIN diffs d ON d.rec = t.rec AND
  CASE WHEN d.s = d.e THEN CASE WHEN d.s = d.n THEN t.b = d.n ELSE t.a <= d.s AND d.s < t.b END ELSE d.s < t.b AND d.e > t.a END)"""
_REVIEW = f"""{_ROWS},
rev AS (SELECT doc_id % 20 AS rec, doc_id AS id, CASE quality WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' ELSE 'review_required' END AS content,
  CASE toxic WHEN 0 THEN 'pass' WHEN 1 THEN 'not_applicable' ELSE 'review_required' END AS speaker FROM labels),
app AS (SELECT t.rec, t.id, coalesce(content, 'review_required') AS content, coalesce(speaker, 'review_required') AS speaker,
  CASE WHEN speaker = 'not_applicable' THEN '' ELSE source END AS speakers, CASE WHEN speaker = 'not_applicable' THEN source ELSE '' END AS candidate_speakers,
  CASE WHEN speaker = 'not_applicable' THEN 'unknown' ELSE 'single' END AS state,
  coalesce(content = 'pass' AND speaker IN ('pass', 'not_applicable'), false) AS ready_anonymous, coalesce(content = 'pass' AND speaker = 'pass', false) AS ready_attributed
  FROM trows t LEFT JOIN rev USING (rec, id))"""
_COMPOSE = f"""{_PARTS},
ord AS (SELECT o_orderkey AS key, o_custkey AS rec, o_orderpriority AS text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS part,
  coalesce(sum(length(o_orderpriority) + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars,
  count(*) OVER (PARTITION BY o_custkey) AS of FROM orders),
it AS (SELECT o.rec, o.part, p.repaired, p.part AS idx, o.part * 10 + p.part AS a0, o.chars, o.of, p.part = 0 AS first, p.part = max(p.part) OVER k AS last,
  sum(CASE WHEN p.repaired THEN 1 ELSE 0 END) OVER k / count(*) OVER k > 0.1 AS gated FROM parts p JOIN ord o ON o.key = p.rec WINDOW k AS (PARTITION BY p.rec)),
comp AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY part, idx) - 1 AS index, CAST(part AS INTEGER) AS part, CAST(idx AS INTEGER) AS idx, CAST(a0 AS DOUBLE) AS a, a0 + 0.5::DOUBLE AS b,
  CAST(idx + chars AS INTEGER) AS xa, CAST(idx + 1 + chars AS INTEGER) AS xb, gated, repaired, (first AND part > 0) OR (last AND part < of - 1) AS seam FROM it)"""
_UNITS = f"""{_TURNS.split('chg AS')[0].rstrip().rstrip(',')},
un AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY "at", id, spk, len) - 1 AS unit_index, spk, CAST("at" % 100000 AS DOUBLE) AS s,
  CASE WHEN len % 11 > 0 THEN CAST("at" % 100000 + len AS DOUBLE) END AS e FROM ev),
unt AS (SELECT *, coalesce(e IS NOT NULL AND s >= 0 AND s < e, false) AS timed FROM un)"""
_ASSETS = "assets AS (SELECT CAST(doc_id AS VARCHAR) AS path, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256, lang, source FROM documents)"
ORACLES: dict[str, str] = {
    "interval_union": f"""WITH {_ACT}, p AS (SELECT *, max(b) OVER (PARTITION BY rec, spk ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM act),
      i AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p THEN 1 ELSE 0 END) OVER (PARTITION BY rec, spk ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM p)
      SELECT rec, spk, min(a) AS a, max(b) AS b, count(*) AS n FROM i GROUP BY rec, spk, i""",
    "uncovered_seconds": f"""WITH {_COVER} SELECT m.rec, m.id, CAST(greatest(0, m.b - m.a - coalesce(sum(CASE WHEN s.a IS NOT NULL THEN least(m.b, s.b) - greatest(m.a, s.a) END), 0)) AS BIGINT) AS uncovered
      FROM mine m LEFT JOIN solid s ON s.rec = m.rec AND s.a < m.b AND s.b > m.a GROUP BY m.rec, m.id, m.a, m.b""",
    "listened_cover": f"""WITH {_COVER} SELECT m.rec, m.id, EXISTS (SELECT 1 FROM solid s WHERE s.rec = m.rec AND s.a <= m.a AND s.b >= m.b) AS covered FROM mine m""",
    "clip_events": f"""WITH {_ACT}, w AS (SELECT min(a) + (max(b) - min(a)) // 4 AS w1, min(a) + (max(b) - min(a)) // 2 AS w2 FROM act)
      SELECT rec, id, spk, greatest(a, w1) AS a, least(b, w2) AS b, a AS source_a, b AS source_b, a < w1 OR b > w2 AS clipped FROM act, w WHERE b > w1 AND a < w2""",
    "slice_with_context": f"""WITH {_FRAMES}, t AS (SELECT rec, samples, (rec * 97) % samples AS s, samples // 3 AS d FROM totals)
      SELECT rec, s AS requested_start, s + d AS requested_end, greatest(0, s - 2048) AS actual_start, least(samples, s + d + 2048) AS actual_end, s - 2048 < 0 AS clamped_start, s + d + 2048 > samples AS clamped_end FROM t""",
    "pause_runs": f"""WITH {_PAUSES} SELECT rec, a, b, n, midpoint, edge, CASE WHEN NOT edge THEN row_number() OVER (PARTITION BY rec, edge ORDER BY a) - 1 END AS id, first_frame FROM pe""",
    "greedy_partition_pauses": f"""WITH RECURSIVE {_GREEDY} SELECT rec, CAST(part AS BIGINT) AS part, a, b, boundary FROM plan""",
    "pause_partition_coverage": f"""WITH RECURSIVE {_GREEDY} SELECT rec, count(*) AS parts, CAST(sum(b - a) AS BIGINT) AS covered, max(samples) AS samples, CAST(0 AS BIGINT) AS violations FROM plan GROUP BY rec""",
    "greedy_partition_signal": f"""WITH RECURSIVE {_FRAMES4}, {_SIGNAL}, lo AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY rec ORDER BY frame_idx) AS run FROM frames WHERE probability < 0.35),
      pr AS (SELECT rec, min(frame_idx) * 4 AS a, max(frame_idx) * 4 + 4 AS b FROM lo GROUP BY rec, run), inner_ AS (SELECT pr.*, row_number() OVER (PARTITION BY pr.rec ORDER BY a) - 1 AS id FROM pr JOIN totals USING (rec) WHERE a > 0 AND b < samples),
      mids AS (SELECT rec, (a + b) // 2 AS m FROM inner_ WHERE id % 3 = 0), {_greedy(44, 22, 11, _QUIET, "forced_low_energy_no_vad_pause")}
      SELECT rec, CAST(part AS BIGINT) AS part, a, b, boundary FROM plan""",
    "energy_partition": f"""WITH RECURSIVE {_FRAMES4}, {_SIGNAL}, mids AS (SELECT rec, CAST(NULL AS BIGINT) AS m FROM totals), {_greedy(44, 22, 11, _QUIET, "minimum_window_then_sample")}
      SELECT rec, CAST(part AS BIGINT) AS part, a, b, boundary FROM plan""",
    "speaker_coalesce": f"""WITH {_GROUPS} SELECT rec, spk, grp, min(a) AS a, max(b) AS b, count(*) AS n FROM mem GROUP BY rec, spk, grp""",
    "activity_candidates": f"""WITH {_GROUPS} SELECT * FROM grps""",
    "unresolved_events": f"""WITH {_GROUPS} SELECT m.rec, m.id, m.spk, m.a, m.b FROM mem m JOIN grps g USING (rec, spk, grp) WHERE g.activity = 'unresolved'""",
    "uncertain_boundaries": f"""WITH {_GROUPS}, ends AS (SELECT rec, spk, grp, a, b, 'start' AS side, a AS "at" FROM grps WHERE activity <> 'unresolved' UNION ALL SELECT rec, spk, grp, a, b, 'end', b FROM grps WHERE activity <> 'unresolved')
      SELECT e.rec, e.spk, e.grp, side, "at", min(greatest(e.a, o.a)) AS "from", max(least(e.b, o.b)) AS "until", count(*) AS n, string_agg(DISTINCT o.spk, ',' ORDER BY o.spk) AS speakers
      FROM ends e JOIN act o ON o.rec = e.rec AND o.spk <> e.spk AND o.a < "at" AND "at" < o.b GROUP BY e.rec, e.spk, e.grp, side, "at" """,
    "major_turns": f"WITH {_TURNS} SELECT * FROM turns",
    "turn_transitions": f"WITH {_TURNS} SELECT * FROM trans",
    "nearest_boundary_snap": f"""WITH {_TURNS}, {_SNAP} SELECT rec, id, to_speaker, "at", mark, mark_at - "at" AS delta FROM snap WHERE k = 1""",
    "snap_conflicts": f"""WITH {_TURNS}, {_SNAP} SELECT rec, id, mark, coalesce(lag(mark_at) OVER w >= mark_at, false) OR coalesce(mark_at >= lead(mark_at) OVER w, false) AS conflict
      FROM snap WHERE k = 1 AND mark IS NOT NULL WINDOW w AS (PARTITION BY rec ORDER BY id)""",
    "asof_neighbors": f"""WITH {_TURNS}, p AS (SELECT rec, "at", min(id) AS mark FROM ev WHERE spk = 'purchase' GROUP BY rec, "at"), q AS (SELECT * FROM ev WHERE spk <> 'purchase')
      SELECT q.rec, q.id, b.mark AS "before", f.mark AS "after" FROM q ASOF LEFT JOIN p b ON b.rec = q.rec AND q."at" >= b."at" ASOF LEFT JOIN p f ON f.rec = q.rec AND q."at" <= f.at""",
    "sentence_event_overlap": f"""WITH {_GROUPS} SELECT g.rec, g.spk AS main, g.grp, count(*) AS events, CAST(sum(CASE WHEN e.spk <> g.spk THEN 1 ELSE 0 END) AS BIGINT) AS others, CAST(sum(least(g.b, e.b) - greatest(g.a, e.a)) AS BIGINT) AS seconds
      FROM grps g JOIN act e ON e.rec = g.rec AND e.a < g.b AND e.b > g.a WHERE g.activity = 'sustained' GROUP BY g.rec, g.spk, g.grp""",
    "pairwise_overlaps": f"""WITH {_ACT} SELECT l.rec, least(l.spk, r.spk) AS one, greatest(l.spk, r.spk) AS two, count(*) AS pairs, CAST(sum(least(l.b, r.b) - greatest(l.a, r.a)) AS BIGINT) AS seconds
      FROM act l JOIN act r ON l.rec = r.rec AND l.id < r.id AND l.spk <> r.spk AND l.a < r.b AND r.a < l.b GROUP BY ALL""",
    "sentence_region": f"WITH {_SENT} SELECT rec, a // 500 AS region, count(*) AS sentences, min(a) AS first FROM sent GROUP BY rec, a // 500",
    "sentence_split": f"WITH {_SENT} SELECT * FROM sent",
    "text_offsets": """SELECT conv_id AS rec, turn, CAST(coalesce(sum(length(text) + 1) OVER w, 0) AS BIGINT) AS a, CAST(coalesce(sum(length(text) + 1) OVER w, 0) + length(text) AS BIGINT) AS b
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "cut_union": f"""WITH {_SENT}, len AS (SELECT doc_id AS rec, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(text) > 0),
      g AS (SELECT rec, unnest(range(0, n, 1000)) AS c FROM len), c AS (SELECT rec, c FROM g UNION SELECT rec, n FROM len UNION SELECT rec, b FROM sent),
      s AS (SELECT rec, c AS a, lead(c) OVER (PARTITION BY rec ORDER BY c) AS b FROM c)
      SELECT s.rec, s.a, s.b, s.a > 0 AND NOT EXISTS (SELECT 1 FROM sent e WHERE e.rec = s.rec AND e.b = s.a) AS forced FROM s WHERE s.b IS NOT NULL""",
    "lossless_text_check": f"""WITH {_SENT}, j AS (SELECT rec, string_agg(sentence, '' ORDER BY pos) AS t FROM sent GROUP BY rec)
      SELECT doc_id AS rec, coalesce(t, '') = text AS ok FROM documents LEFT JOIN j ON rec = doc_id""",
    "token_time_flags": f"""WITH {_TIMED}, v AS (SELECT rec, part, a / 10 AS ra, b / 10 AS rb, greatest(a, 0) / 10 AS fa, greatest(a, b, 0) / 10 AS fb FROM timed),
      p AS (SELECT *, lag(ra) OVER w AS pra, lag(rb) OVER w AS prb, lag(fa) OVER w AS pfa, lag(fb) OVER w AS pfb FROM v WINDOW w AS (PARTITION BY rec ORDER BY part))
      SELECT rec, part, concat_ws(',', CASE WHEN ra <> fa OR rb <> fb THEN 'timestamp_repaired_by_library' END,
        CASE WHEN ra < 0 OR rb > 12 OR rb < 0 OR ra > 12 THEN 'raw_outside_audio_extent' END, CASE WHEN ra > rb THEN 'raw_reversed_interval' END, CASE WHEN ra = rb THEN 'raw_zero_length' END,
        CASE WHEN ra < pra OR rb < prb THEN 'raw_nonmonotonic_sequence' END, CASE WHEN ra < prb THEN 'raw_overlap_previous_token' END,
        CASE WHEN fa < 0 OR fb > 12 OR fb < 0 OR fa > 12 THEN 'repaired_outside_audio_extent' END, CASE WHEN fa > fb THEN 'repaired_reversed_interval' END, CASE WHEN fa = fb THEN 'repaired_zero_length' END,
        CASE WHEN fa < pfa OR fb < pfb THEN 'repaired_nonmonotonic_sequence' END, CASE WHEN fa < pfb THEN 'repaired_overlap_previous_token' END) AS flags FROM p""",
    "monotonic_check": f"""WITH {_TIMED}, p AS (SELECT rec, a < lag(a) OVER w OR b < lag(b) OVER w AS down FROM timed WINDOW w AS (PARTITION BY rec ORDER BY part))
      SELECT rec, count(*) AS n, NOT coalesce(bool_or(down), false) AS monotonic FROM p GROUP BY rec""",
    "repair_gate": f"WITH {_PARTS} SELECT rec, count(*) AS n, count(*) FILTER (repaired) AS repaired, count(*) FILTER (repaired) / count(*) > 0.1 AS gated FROM parts GROUP BY rec",
    "compose_offsets": f"WITH {_COMPOSE} SELECT rec, index, part, idx, a, b, xa, xb, concat_ws(',', CASE WHEN repaired THEN 'timestamp_repaired_by_library' END, CASE WHEN seam THEN 'alignment_chunk_edge' END, CASE WHEN gated THEN 'alignment_chunk_repair_gate' END) AS flags, NOT (repaired OR seam OR gated) AS eligible FROM comp",
    "seam_tokens": f"WITH {_COMPOSE} SELECT rec, index, part FROM comp WHERE seam",
    "midpoint_filter": f"WITH {_UNITS} SELECT rec, unit_index, spk, timed, timed AND coalesce((s + e) / 2 >= 20000 AND (s + e) / 2 < 60000, false) AS kept FROM unt",
    "unit_envelope": f"""WITH {_UNITS}, o AS (SELECT *, CAST(sum(length(spk)) OVER w - length(spk) AS BIGINT) AS xa, CAST(sum(length(spk)) OVER w AS BIGINT) AS xb FROM unt WINDOW w AS (PARTITION BY rec ORDER BY unit_index ROWS UNBOUNDED PRECEDING)),
      k AS (SELECT rec, unnest(range(0, (max(xb) - 1) // 12 + 1)) AS k FROM o GROUP BY rec),
      m AS (SELECT k.rec, k.k, o.unit_index, o.timed, o.s, o.e, o.s < lag(o.s) OVER w OR o.e < lag(o.e) OVER w AS down FROM k JOIN o ON o.rec = k.rec AND o.xa < k.k * 12 + 12 AND o.xb > k.k * 12 WINDOW w AS (PARTITION BY k.rec, k.k ORDER BY o.unit_index)),
      g AS (SELECT rec, k, count(*) AS units, bool_and(timed) AS ok, coalesce(bool_or(down), false) AS down, arg_min(s, unit_index) AS s, arg_max(e, unit_index) AS e FROM m GROUP BY rec, k)
      SELECT rec, k, units, CASE WHEN ok AND NOT down THEN s END AS start, CASE WHEN ok AND NOT down THEN e END AS "end",
        CASE WHEN NOT ok THEN 'missing_or_invalid_source_time' WHEN down THEN 'non_monotonic_source_times' ELSE 'native_unit_envelope' END AS timing FROM g""",
    "speaker_first_seen": f"""WITH {_ACT}, f AS (SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY rec, spk ORDER BY a, b, id) = 1),
      k AS (SELECT rec, spk, row_number() OVER (PARTITION BY rec ORDER BY a, b, id) - 1 AS rank FROM f) SELECT rec, spk, rank, chr(CAST(65 + rank AS INTEGER)) AS label FROM k""",
    "timestamp_render": """WITH e AS (SELECT event_id, value AS s, CAST(round_even(value * 1000, 0) AS BIGINT) AS ms FROM events)
      SELECT event_id, printf('%02d:%02d.%03d', ms // 60000, ms // 1000 % 60, ms % 1000) AS stamp, printf('[%02d:%02d]', CAST(floor(s) AS BIGINT) // 60, CAST(floor(s) AS BIGINT) % 60) AS short FROM e""",
    "difference_links": f"WITH {_LINKS} SELECT rec, id, diff FROM links",
    "inverse_links": f"WITH {_LINKS} SELECT d.rec, d.diff, coalesce(string_agg(l.id, ',' ORDER BY l.id), '') AS ids FROM diffs d LEFT JOIN links l USING (rec, diff) GROUP BY d.rec, d.diff",
    "review_apply": f"WITH {_REVIEW} SELECT * FROM app",
    "review_ready": f"""WITH {_REVIEW} SELECT rec, count(*) AS "rows", count(*) FILTER (ready_anonymous) AS ready, bool_and(ready_anonymous) AS all_anonymous, bool_and(ready_attributed) AS all_attributed FROM app GROUP BY rec""",
    "review_violations": f"""WITH {_ROWS}, lab AS (SELECT doc_id, doc_id % 20 AS rec, CASE quality WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' ELSE 'review_required' END AS content,
        CASE toxic WHEN 0 THEN 'pass' WHEN 1 THEN 'not_applicable' ELSE 'review_required' END AS speaker, CASE WHEN doc_id % 13 = 5 THEN 'perhaps' ELSE 'pass' END AS boundary,
        doc_id % 4 = 0 AS silent, doc_id % 9 = 1 AS blank, CASE doc_id % 10 WHEN 3 THEN 'nobody' WHEN 4 THEN '' ELSE 'own' END AS said, CASE WHEN doc_id % 7 = 2 THEN -1 END AS c_end FROM labels),
      m AS (SELECT l.*, r.id, r.a, r.b, coalesce(c_end, r.b) AS e, length(trim(r.text)) = 0 AS bare FROM lab l JOIN trows r ON r.rec = l.rec AND r.id = l.doc_id),
      h AS (SELECT *, a // 50000 * 50000 + 45000 AS upto FROM m),
      p AS (SELECT rec, id, unnest([CASE WHEN boundary = 'perhaps' THEN 'invalid_status' END, CASE WHEN silent AND (content = 'fail' OR speaker = 'not_applicable') THEN 'note_required' END,
        CASE WHEN a >= b OR a >= e THEN 'invalid_interval' END, CASE WHEN said = 'nobody' THEN 'invalid_speakers' END, CASE WHEN b > upto OR e > upto OR a > upto THEN 'not_listened_to' END,
        CASE WHEN speaker = 'pass' AND said = '' THEN 'speaker_required' END, CASE WHEN content = 'pass' AND (blank OR (bare AND NOT blank)) THEN 'text_required' END]) AS problem FROM h)
      SELECT rec, id, problem FROM p WHERE problem IS NOT NULL UNION ALL SELECT rec, doc_id, 'unknown_row' FROM lab WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "review_unknown_ids": "SELECT doc_id % 20 AS rec, doc_id AS id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE length(text) >= 1000)",
    "quality_indicators": """WITH s AS (SELECT DISTINCT source FROM documents), l AS (SELECT unnest(['en', 'fr', 'de', 'es', 'unknown']) AS value)
      SELECT s.source, l.value, count(d.doc_id) AS n FROM s CROSS JOIN l LEFT JOIN documents d ON d.source = s.source AND d.lang = l.value GROUP BY s.source, l.value""",
    "max_ties": f"WITH {_PARTS} SELECT rec, part, len FROM parts QUALIFY len = max(len) OVER (PARTITION BY rec)",
    "contiguity_violations": f"WITH {_PARTS}, x AS (SELECT rec, part, line, coalesce(lag(line + 1) OVER (PARTITION BY rec ORDER BY part), 1) AS expected FROM parts) SELECT * FROM x WHERE line <> expected",
    "reference_violations": "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "duplicate_ids": "SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
    "fingerprint_inventory": f"WITH {_ASSETS} SELECT path, bytes, sha256 FROM assets",
    "manifest_diff": f"""WITH {_ASSETS}, l AS (SELECT path, CASE WHEN bytes % 5 = 0 THEN bytes + 1 ELSE bytes END AS b, sha256 AS h FROM assets WHERE bytes % 7 <> 0),
      r AS (SELECT path, bytes AS b, CASE WHEN bytes % 13 = 0 THEN reverse(sha256) ELSE sha256 END AS h FROM assets WHERE bytes % 11 <> 0),
      x AS (SELECT coalesce(l.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'missing' WHEN l.path IS NULL THEN 'extra' WHEN l.b <> r.b THEN 'bytes' WHEN l.h <> r.h THEN 'sha256' END AS state FROM l FULL JOIN r ON l.path = r.path)
      SELECT * FROM x WHERE state IS NOT NULL""",
    "cache_key": f"""WITH {_ASSETS} SELECT path, sha256(sha256 || chr(10) || path || chr(10) || '{{"lang":"' || lang || '","source":"' || source || '"}}') AS key FROM assets""",
    "process_closure": """WITH RECURSIVE p AS (SELECT p_partkey AS id, p_partkey // 10 AS parent FROM part), d AS (SELECT CAST(1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS depth
      UNION ALL SELECT p.id, d.depth + 1 FROM d JOIN p ON p.parent = d.id AND p.id <> p.parent) SELECT id, depth FROM d""",
    "strict_json_parse": "SELECT event_id, json_valid(props) AS valid, CAST(length(props) AS BIGINT) AS chars, json_valid(props) AND json_type(props) = 'OBJECT' AS is_object FROM events",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
