"""Queries on timelines of sections derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeline as t
from .adapters import CONCERTS, ROUND3, SECTIONS, concerts, sections
from .registry import query


def _decisions(s: DataFrame) -> DataFrame:
    """Every third section decides on the twelve seconds before it."""
    kind = F.when(F.col("section_id") % 2 == 0, "music_only").otherwise("unknown")
    return s.where("section_id % 3 = 0").select("concert_id", (F.col("start") - 40.0).alias("start"), F.col("start").alias("end"), kind.alias("disposition"))


_DECISIONS = """decisions AS (SELECT concert_id, start - 40.0 AS start, start AS "end", CASE WHEN section_id % 2 = 0 THEN 'music_only' ELSE 'unknown' END AS disposition FROM sections WHERE section_id % 3 = 0)"""


def _candidates(s: DataFrame) -> DataFrame:
    status = F.when(F.col("mark") == "F", "approved").when(F.col("mark") == "O", "needs_transcription_review")
    return s.where("section_id % 5 <> 0").select("concert_id", "section_id", F.when(F.col("section_id") % 2 == 0, F.col("section_id")).alias("id"), status.alias("status"))


_CANDIDATES = """candidates AS (SELECT concert_id, section_id, CASE WHEN section_id % 2 = 0 THEN section_id END AS id, CASE mark WHEN 'F' THEN 'approved' WHEN 'O' THEN 'needs_transcription_review' END AS status FROM sections WHERE section_id % 5 <> 0)"""

_GAPS = f"""inside AS (SELECT concert_id, section_id, greatest(0.0, start) AS start, least(duration, "end") AS "end" FROM sections JOIN concerts USING (concert_id)),
reached AS (SELECT *, greatest(0.0, coalesce(max("end") OVER (PARTITION BY concert_id ORDER BY start, "end", section_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS reach FROM inside),
holes AS (SELECT concert_id, reach AS a, start AS b FROM reached WHERE start > reach + 0.5
  UNION ALL SELECT concert_id, greatest(0.0, m) AS a, duration AS b FROM concerts JOIN (SELECT concert_id, max("end") AS m FROM inside GROUP BY concert_id) USING (concert_id) WHERE duration > greatest(0.0, m) + 0.5),
gaps AS (SELECT concert_id, {ROUND3.format('a')} AS start, {ROUND3.format('b')} AS "end", {ROUND3.format('b - a')} AS duration FROM holes)"""
_UNRESOLVED = """unresolved AS (SELECT * FROM gaps g WHERE NOT EXISTS (SELECT 1 FROM decisions d WHERE d.concert_id = g.concert_id AND d.start <= g.start + 0.5 AND d."end" >= g."end" - 0.5
  AND d.disposition IN ('approved_speech', 'crowd_nonlexical', 'credits', 'music_only', 'no_speech')))"""


@query(f"WITH {SECTIONS}, {CONCERTS}, {_GAPS} SELECT * FROM gaps")
def w1_timeline_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections(spark, sf_dir)
    return t.timeline_gaps(s, concerts(s))


@query(f"WITH {SECTIONS}, {CONCERTS}, {_GAPS}, {_DECISIONS}, {_UNRESOLVED} SELECT * FROM unresolved")
def j7_unresolved_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections(spark, sf_dir)
    return t.unresolved_gaps(t.timeline_gaps(s, concerts(s)), _decisions(s))


@query(f"WITH {SECTIONS}, {_CANDIDATES} SELECT concert_id, section_id FROM sections s WHERE type = 'song' AND NOT EXISTS (SELECT 1 FROM candidates c WHERE c.concert_id = s.concert_id AND c.section_id = s.section_id)")
def j8_missing_song_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections(spark, sf_dir)
    return t.missing_scans(s, _candidates(s)).select("concert_id", "section_id")


@query(f"WITH {SECTIONS}, {_CANDIDATES} SELECT concert_id, section_id, id, coalesce(status, 'missing') AS status FROM candidates WHERE coalesce(status, 'missing') NOT IN ('approved', 'known_lyric', 'crowd_nonlexical', 'rejected_hallucination')")
def j8_unresolved_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.unresolved_candidates(_candidates(sections(spark, sf_dir)))


@query(f"""WITH {SECTIONS}, {CONCERTS}, {_GAPS}, {_DECISIONS}, {_CANDIDATES}, {_UNRESOLVED},
missing AS (SELECT concert_id, section_id FROM sections s WHERE type = 'song' AND NOT EXISTS (SELECT 1 FROM candidates c WHERE c.concert_id = s.concert_id AND c.section_id = s.section_id)),
parts AS (SELECT c.concert_id,
  (SELECT count(*) FROM sections s WHERE s.concert_id = c.concert_id AND type = 'song') AS songs,
  (SELECT count(*) FROM missing m WHERE m.concert_id = c.concert_id) AS missing_song_scans,
  (SELECT count(*) FROM candidates k WHERE k.concert_id = c.concert_id AND id IS NOT NULL) AS candidate_count,
  (SELECT count(*) FROM candidates k WHERE k.concert_id = c.concert_id AND id IS NOT NULL AND coalesce(status, 'missing') <> 'approved') AS unresolved_candidate_count,
  (SELECT count(*) FROM gaps g WHERE g.concert_id = c.concert_id) AS timeline_gap_count,
  coalesce((SELECT {ROUND3.format('sum(duration)')} FROM gaps g WHERE g.concert_id = c.concert_id), 0.0) AS timeline_gap_seconds,
  (SELECT count(*) FROM unresolved g WHERE g.concert_id = c.concert_id) AS unresolved_gap_count FROM concerts c)
SELECT concert_id, songs - missing_song_scans AS song_scan_count, missing_song_scans, candidate_count, unresolved_candidate_count, timeline_gap_count, timeline_gap_seconds, unresolved_gap_count,
  missing_song_scans = 0 AND unresolved_candidate_count = 0 AND unresolved_gap_count = 0 AS ready FROM parts""")
def a7_coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections(spark, sf_dir)
    return t.coverage_audit(s, concerts(s), _candidates(s), _decisions(s))


_ORDER = "(PARTITION BY concert_id ORDER BY start, \"end\", section_id)"


@query(f"""WITH {SECTIONS}, {CONCERTS},
placed AS (SELECT s.*, duration, coalesce(lag("end") OVER {_ORDER}, 0.0) AS p FROM sections s JOIN concerts USING (concert_id)),
every AS (SELECT concert_id, section_id, type AS kind, start, "end", CASE WHEN start < 0 OR "end" > duration THEN 'out_of_range' WHEN start < p - 0.001 THEN 'overlap' END AS error FROM placed
  UNION ALL SELECT concert_id, NULL, 'transition', p, start, NULL FROM placed WHERE start > p
  UNION ALL SELECT concert_id, NULL, 'transition', p, duration, NULL FROM concerts JOIN (SELECT concert_id, arg_max("end", row(start, "end", section_id)) AS p FROM sections GROUP BY concert_id) USING (concert_id) WHERE duration > p)
SELECT *, format('{{}} {{}}', kind, row_number() OVER (PARTITION BY concert_id, kind ORDER BY start, "end", section_id)) AS label FROM every""")
def w2_fill_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections(spark, sf_dir)
    return t.fill_timeline(s, concerts(s))


@query(f"""WITH {SECTIONS}, {CONCERTS} SELECT concert_id, section_id, format('{{}}{{:02d}}', type, row_number() OVER (PARTITION BY concert_id, type ORDER BY start, section_id)) AS id,
  greatest(0.0, start - 20.0) AS context_start, least(duration, "end" + 20.0) AS context_end FROM sections JOIN concerts USING (concert_id)""")
def w4_section_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections(spark, sf_dir)
    return t.section_ids(s, concerts(s))


@query(f"""WITH {SECTIONS}, n AS (SELECT concert_id, section_id, start, "end", lag("end") OVER w AS previous_end, lead(start) OVER w AS next_start FROM sections WINDOW w AS (PARTITION BY concert_id ORDER BY start, section_id))
SELECT *, md5(concat_ws('|', {", ".join(f"coalesce(CAST(CAST(floor({c} * 1000 + 0.5) AS BIGINT) AS VARCHAR), 'none')" for c in ('start', '"end"', 'previous_end', 'next_start'))})) AS contract FROM n""")
def w5_neighbor_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.neighbor_contract(sections(spark, sf_dir))


@query(f"""WITH {SECTIONS} SELECT concert_id, section_id FROM (SELECT concert_id, section_id, max(CASE WHEN section_id % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY concert_id ORDER BY start, section_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM sections) WHERE m = 1""")
def w5_with_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.with_neighbors(sections(spark, sf_dir), F.col("section_id") % 7 == 0).select("concert_id", "section_id")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_shipdate", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice")
    s = sections(spark, sf_dir).where("section_id % 9 <> 0").select("concert_id", "section_id")
    seq = F.struct("l_linenumber", "l_extendedprice")
    return s.join(li, F.col("section_id") == F.col("l_orderkey")).select("concert_id", "section_id", F.col("l_shipdate").alias("at"), seq.alias("seq"), F.concat("l_returnflag", "l_linestatus").alias("status"))


_LATEST = """latest AS (SELECT concert_id, section_id, arg_max(l_returnflag || l_linestatus, row(l_shipdate, l_linenumber, l_extendedprice)) AS status
  FROM sections JOIN lineitem ON section_id = l_orderkey WHERE section_id % 9 <> 0 GROUP BY ALL)"""


@query(f"WITH {SECTIONS}, {_LATEST} SELECT * FROM latest")
def w6_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.latest_status(_history(spark, sf_dir))


@query(f"WITH {SECTIONS}, {_LATEST} SELECT concert_id, coalesce(status, 'missing') AS status, count(*) AS n FROM sections LEFT JOIN latest USING (concert_id, section_id) GROUP BY ALL")
def a8_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.status_summary(sections(spark, sf_dir), _history(spark, sf_dir))


@query(f"""WITH {SECTIONS},
parts AS (SELECT concert_id, start AS a, least("end", start + 4.0) AS b FROM sections UNION ALL
  SELECT concert_id, greatest(start, (start + "end") / 2 - 0.75), least("end", (start + "end") / 2 + 0.75) FROM sections UNION ALL
  SELECT concert_id, greatest(start, "end" - 2.0), "end" FROM sections),
flags AS (SELECT concert_id, a, b, CASE WHEN a <= max(b) OVER (PARTITION BY concert_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.01 THEN 0 ELSE 1 END AS f FROM parts WHERE b - a >= 0.2),
islands AS (SELECT *, sum(f) OVER (PARTITION BY concert_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM flags)
SELECT concert_id, min(a) AS start, max(b) AS "end" FROM islands GROUP BY concert_id, i""")
def w7_merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.merge_intervals(t.review_windows(sections(spark, sf_dir)))


_CELLS = """weighed AS (SELECT s.concert_id, section_id, start, "end", CASE WHEN type = 'mc' THEN least(("end" - start) * 3.0, coalesce(median * 1.2, ("end" - start) * 3.0)) ELSE "end" - start END AS weight
  FROM {0} s LEFT JOIN (SELECT concert_id, quantile_cont("end" - start, 0.5) AS median FROM {0} WHERE type = 'song' GROUP BY concert_id) m ON m.concert_id = s.concert_id),
runs AS (SELECT concert_id, section_id, weight, count(*) OVER (PARTITION BY concert_id) AS n, sum(weight) OVER (PARTITION BY concert_id) AS total, row_number() OVER w - 1 AS i, sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM weighed WINDOW w AS (PARTITION BY concert_id ORDER BY start, section_id)),
roomy AS (SELECT *, CASE WHEN n <= 30 THEN 4 ELSE 2 END AS gap FROM runs),
cells AS (SELECT concert_id, section_id, CAST(round_even((1200 - gap * (n - 1)) * ((run - weight) / total), 0) AS BIGINT) + gap * i AS x0, CAST(round_even((1200 - gap * (n - 1)) * (run / total), 0) AS BIGINT) + gap * i AS x1 FROM roomy)"""


@query(f"WITH {SECTIONS}, {_CELLS.format('sections')} SELECT * FROM cells")
def w14_duration_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.duration_bounds(sections(spark, sf_dir))


@query(f"""WITH {SECTIONS}, {_CELLS.format('sections')},
told AS (SELECT r.*, s.start, s."end", CAST(ceil(length(title) * CAST(0.55 AS DOUBLE) * 24 * CAST(0.8 AS DOUBLE)) AS BIGINT) + 16 AS asked FROM roomy r JOIN sections s USING (concert_id, section_id) WHERE n <= 80),
pairs AS (SELECT a.concert_id, a.section_id AS active_id, a.start AS active_from, a."end" AS active_to, a.i AS k, a.weight AS w, a.asked, b.section_id, b.i, b.n, b.gap, b.weight, b.run, b.total, 1200 - b.gap * (b.n - 1) AS room,
  CAST(round_even((1200 - b.gap * (b.n - 1)) * (a.run / b.total), 0) AS BIGINT) - CAST(round_even((1200 - b.gap * (b.n - 1)) * ((a.run - a.weight) / b.total), 0) AS BIGINT) AS own FROM told a JOIN told b ON a.concert_id = b.concert_id),
wide AS (SELECT *, least(greatest(asked, own), room - (n - 1)) AS cur, run - weight - CASE WHEN i > k THEN w ELSE 0.0 END AS others FROM pairs),
placed AS (SELECT *, coalesce(CAST(round_even((room - cur - (n - 1)) * (others / nullif(total - w, 0.0)), 0) AS BIGINT), 0) + i - CASE WHEN i > k THEN 1 - cur ELSE 0 END AS a0,
  CAST(round_even((room - cur - (n - 1)) * ((others + weight) / nullif(total - w, 0.0)), 0) AS BIGINT) - CAST(round_even((room - cur - (n - 1)) * (others / nullif(total - w, 0.0)), 0) AS BIGINT) + 1 AS grow FROM wide),
drawn AS (SELECT concert_id, active_id, active_from, active_to, section_id, asked, CASE WHEN i = k THEN 'active' WHEN i < k THEN 'played' ELSE 'unplayed' END AS state,
  CASE WHEN cur > own THEN a0 ELSE CAST(round_even(room * ((run - weight) / total), 0) AS BIGINT) END + gap * i AS x0,
  CASE WHEN cur > own THEN a0 + CASE WHEN i = k THEN cur ELSE grow END ELSE CAST(round_even(room * (run / total), 0) AS BIGINT) END + gap * i AS x1 FROM placed)
SELECT concert_id, active_id, active_from, active_to, 10 AS layer, section_id, x0, x1, state, CAST(NULL AS DOUBLE) AS scale FROM drawn
UNION ALL SELECT concert_id, active_id, active_from, active_to, 11, section_id, x0, x1, 'fill', NULL FROM drawn WHERE state = 'active'
UNION ALL SELECT concert_id, active_id, active_from, active_to, 12, section_id, x0 + 8, x1, 'label', least(100.0, greatest(1, x1 - x0 - 16) / greatest(1, asked - 16) * 100) FROM drawn WHERE state = 'active'
UNION ALL SELECT DISTINCT concert_id, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 10, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'too_many_sections', NULL FROM roomy WHERE n > 80""", layer="INTEGER", x0="BIGINT", x1="BIGINT", scale="DOUBLE")
def u2_progress_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.progress_rows(sections(spark, sf_dir).withColumn("label", F.col("title")))


@query(f"""WITH {SECTIONS}, {CONCERTS}, p AS (SELECT s.*, duration, lag("end") OVER (PARTITION BY concert_id ORDER BY start, section_id) AS q, count(*) OVER (PARTITION BY concert_id, section_id) AS k FROM sections s JOIN concerts USING (concert_id))
SELECT concert_id, section_id, 'bad_interval' AS code FROM p WHERE start >= "end" UNION ALL SELECT concert_id, section_id, 'outside_concert' FROM p WHERE start < 0 OR "end" > duration + 0.001
UNION ALL SELECT concert_id, section_id, 'duplicate_id' FROM p WHERE k > 1 UNION ALL SELECT concert_id, section_id, 'overlap' FROM p WHERE start < q - 0.001""")
def g32_section_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections(spark, sf_dir)
    return t.section_errors(s, concerts(s))
