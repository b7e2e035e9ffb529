"""Queries on joins by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit, joins as j, timeline as tl
from .adapters import CUES, SECTIONS, SEGMENTS, TALK, cues, read, sections, segments, talk
from .registry import query

_MICRO = "floor(({}) * 1000000 + 0.5) / CAST(1000000 AS DOUBLE)".format

_ABS = """absolute AS (SELECT c.section_id, c.pos, c.start + s.start AS start, c."end" + s.start AS "end", s.concert_id, s.type AS section_kind, s.start AS ss, s."end" AS se FROM cues c JOIN sections s ON s.section_id = c.section_id),
kept AS (SELECT * FROM absolute WHERE NOT (start < ss - 0.001 OR "end" > se + 0.001 OR start >= "end"))"""


@query(f"WITH {SECTIONS}, {CUES}, {_ABS} SELECT concert_id, section_id, pos, section_kind, start, \"end\" FROM kept")
def j1_to_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.to_absolute(cues(spark, sf_dir), sections(spark, sf_dir))[0].select("concert_id", "section_id", "pos", "section_kind", "start", "end")


@query(f"WITH {SECTIONS}, {CUES}, {_ABS}, o AS (SELECT *, lag(\"end\") OVER (PARTITION BY concert_id ORDER BY start, section_id, pos) - start AS overlap FROM kept) SELECT concert_id, section_id, pos, overlap FROM o WHERE overlap > 0.001")
def w3_global_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.global_overlap(j.to_absolute(cues(spark, sf_dir), sections(spark, sf_dir))[0]).select("concert_id", "section_id", "pos", "overlap")


def _approvals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    s = sections(spark, sf_dir)
    k = F.col("section_id")
    base = s.select("section_id").where("section_id % 13 <> 0")
    own = s.select("concert_id", "section_id", "type", (k * 31 % 97).alias("section_hash"))
    package = base.select("section_id", F.when(k % 7 == 0, F.lit(-1)).otherwise(k * 31 % 97).cast("long").alias("package_hash"))
    status = s.select("section_id", F.when(F.col("mark") == "O", "needs_review").otherwise("approved").alias("status"))
    gate = base.select("section_id", (k % 89).alias("gate_hash"), F.when(k % 17 == 0, k % 89 + 1).otherwise(k % 89).alias("result_hash"), (k % 5).alias("n_events"))
    decision = base.select("section_id", F.when(k % 11 == 0, "reject").otherwise("accept").alias("decision"), (k % 89).alias("decided_hash"), (k % 83).alias("decided_assessment"))
    assessment = base.select("section_id", F.when(k % 8 == 4, k % 83 + 1).otherwise(k % 83).alias("assessed_hash"))
    return own, package, status, gate, decision, assessment


@query(f"""WITH {SECTIONS} SELECT concert_id, section_id, CASE WHEN section_id % 13 = 0 OR section_id % 7 = 0 THEN 'manifest_changed' WHEN mark = 'O' THEN 'not_approved' WHEN section_id % 11 = 0 THEN 'bad_decision'
  WHEN type = 'mc' AND section_id % 8 = 4 THEN 'assessment_changed' WHEN section_id % 5 = 0 THEN 'missing_events' WHEN section_id % 17 = 0 THEN 'result_changed' END AS fault FROM sections""")
def j2_approval_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.approval_chain(*_approvals(spark, sf_dir))


@query(f"""WITH {SECTIONS}, m AS (SELECT section_id, concat_ws(',', CASE WHEN section_id % 3 = 0 THEN 'title' END, CASE WHEN section_id % 5 = 0 THEN 'end' END) AS fields FROM sections) SELECT * FROM m WHERE fields <> ''""")
def j3_package_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections(spark, sf_dir)
    k = F.col("section_id")
    p = s.withColumns({"title": F.when(k % 3 == 0, None).otherwise(F.col("title")), "end": F.when(k % 5 == 0, F.col("end") + 1).otherwise(F.col("end"))})
    return j.package_mismatches(s, p, ["title", "start", "end"]).select("section_id", F.array_join("fields", ",").alias("fields"))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).where("kind = 'purchase'").select("section_id", (F.col("start") - 300.0).alias("start"), (F.col("start") + 2000.0).alias("end"))


_GAP = """gap AS (SELECT section_id, start - 300.0 AS gs, start + 2000.0 AS ge FROM segments WHERE kind = 'purchase')"""


@query(f"""WITH {SEGMENTS}, {_GAP}, f AS (SELECT s.section_id, id, min(row(gs, ge)) AS g FROM segments s JOIN gap g ON g.section_id = s.section_id AND start >= gs + 0.15 AND "end" <= ge - 0.15 WHERE kind <> 'purchase' GROUP BY ALL)
SELECT section_id, id, g[1] AS gap_start, g[2] AS gap_end FROM f""")
def j6_contained_in_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.contained_in_gap(segments(spark, sf_dir).where("kind <> 'purchase'"), _gaps(spark, sf_dir))


@query()
def j4_speech_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as lyrics, the other turns, two seconds later, as what was heard."""
    t = talk(spark, sf_dir)
    heard = t.where("role <> 'user'").select("section_id", F.col("pos").alias("id"), (F.col("start") + 2.0).alias("start"), (F.col("end") + 2.0).alias("end"), "text", F.lit(0.8).alias("probability"))
    gaps = t.where("pos % 3 = 0").select("section_id", F.col("end").alias("start"), (F.col("end") + 10.0).alias("end"))
    return j.speech_candidates(heard, t.where("role = 'user'").select("section_id", F.col("pos").alias("id"), "start", "end", "text"), gaps)


def _ms(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    s = segments(spark, sf_dir).where(F.col("kind") == kind)
    return s.select(F.col("section_id").alias("track_id"), F.floor(F.col("start") / 1000.0).cast("long").alias("ms"), F.col("id").alias("n"))


@query(f"""WITH {SEGMENTS}, a AS (SELECT section_id AS track_id, CAST(floor(start / 1000.0) AS BIGINT) AS ms, id AS n FROM segments WHERE kind = 'purchase'), b AS (SELECT section_id AS track_id, CAST(floor(start / 1000.0) AS BIGINT) AS ms, id AS n FROM segments WHERE kind = 'view'),
m AS (SELECT a.track_id, a.ms, a.n, b.ms AS r_ms, b.n AS r_n, row_number() OVER (PARTITION BY a.n ORDER BY abs(a.ms - b.ms), b.n) AS k FROM a JOIN b ON a.track_id = b.track_id AND abs(a.ms - b.ms) <= 350) SELECT * EXCLUDE (k) FROM m WHERE k = 1""")
def j9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.nearest(_ms(spark, sf_dir, "purchase"), _ms(spark, sf_dir, "view"), "track_id", "ms", "n", 350)


@query(f"""WITH {SEGMENTS}, c AS (SELECT section_id, id AS cue, start - 100.0 AS start, start + 3000.0 AS "end" FROM segments WHERE kind = 'purchase')
SELECT c.section_id, cue, s.id FROM c JOIN segments s ON s.section_id = c.section_id AND s.start >= c.start - 0.05 AND s."end" <= c."end" + 0.05""")
def j10_matching_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    c = s.where("kind = 'purchase'").select("section_id", F.col("id").alias("cue"), (F.col("start") - 100.0).alias("start"), (F.col("start") + 3000.0).alias("end"))
    return j.matching_segments(c, s).select("section_id", "cue", F.col("r_id").alias("id"))


def _phones(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Four phones a cue in lines; every seventh track hears its first phone otherwise."""
    c = cues(spark, sf_dir).select(F.col("section_id").alias("track_id"), "pos", "start")
    said = c.select("track_id", F.col("pos").alias("line"), F.array(*[F.lit(x) for x in "aiue"]).alias("phones"))
    k = F.explode(F.sequence(F.lit(0), F.lit(4)))
    heard = c.withColumn("k", k).select("track_id", (F.col("pos") * 5 + F.col("k")).alias("n"), (F.col("start") + F.col("k") / 10.0).alias("start"), (F.col("start") + (F.col("k") + 1) / 10.0).alias("end"),
        F.when(F.col("k") == 4, "SP").when((F.col("track_id") % 7 == 0) & (F.col("pos") == 0) & (F.col("k") == 0), "o").otherwise(F.substring(F.lit("aiue"), F.col("k") + 1, F.lit(1))).alias("phone"))
    return heard, said


_PHONES = f"""{CUES}, k AS (SELECT section_id AS track_id, pos, start, unnest(range(5)) AS k FROM cues), heard AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY pos * 5 + k) AS i, start + k / 10.0 AS start, start + (k + 1) / 10.0 AS "end", phone FROM (
  SELECT *, CASE WHEN k = 4 THEN 'SP' WHEN track_id % 7 = 0 AND pos = 0 AND k = 0 THEN 'o' ELSE 'aiue'[k + 1] END AS phone FROM k) WHERE phone NOT IN ('AP', 'SP')),
said AS (SELECT track_id, pos AS line, 'aiue'[k + 1] AS want, row_number() OVER (PARTITION BY track_id ORDER BY pos, k) AS i FROM k WHERE k < 4), met AS (SELECT * FROM said FULL JOIN heard USING (track_id, i))"""


@query(f"""WITH {_PHONES} SELECT track_id, line, arg_min(start, i) AS start, arg_max("end", i) AS "end", count(*) FILTER (phone IS NULL) AS lost FROM met WHERE line IS NOT NULL GROUP BY track_id, line""")
def j11_phone_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.phone_lines(*_phones(spark, sf_dir))[0]


@query(f"""WITH {_PHONES} SELECT track_id, CAST(min(i) AS INTEGER) AS first_mismatch FROM met WHERE want IS DISTINCT FROM phone GROUP BY track_id""")
def j11_phone_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.phone_lines(*_phones(spark, sf_dir))[1]


@query(f"""WITH {CUES}, w AS (SELECT o_orderkey AS section_id, o_orderkey % 3 AS window_id, CAST(o_orderkey % 5 AS DOUBLE) AS ws, CAST(o_orderkey % 5 AS DOUBLE) + 4.0 AS we FROM orders)
SELECT section_id, pos, window_id, greatest(start, ws) - ws AS start, least("end", we) - ws AS "end" FROM cues JOIN w USING (section_id) WHERE we > start AND ws < "end" AND "end" >= start""")
def j12_clip_to_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section_id"), (F.col("o_orderkey") % 3).alias("window_id"), (F.col("o_orderkey") % 5).cast("double").alias("start"), ((F.col("o_orderkey") % 5).cast("double") + 4.0).alias("end"))
    out = j.clip_to_window(cues(spark, sf_dir).where("end >= start").select("section_id", "pos", "start", "end"), w, "section_id")
    return out.select("section_id", "pos", F.col("r_window_id").alias("window_id"), "start", "end")


@query("""WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS h, doc_id % 20 AS k FROM documents), a AS (SELECT 'doc/' || doc_id AS path, size, h FROM d), b AS (SELECT CASE WHEN k = 2 THEN 'new/' ELSE 'doc/' END || doc_id AS path, size, CASE WHEN k = 3 THEN 'x' ELSE h END AS h FROM d WHERE k <> 1),
j AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' WHEN a.size IS DISTINCT FROM b.size OR a.h IS DISTINCT FROM b.h THEN 'changed' END AS code FROM a FULL JOIN b ON a.path = b.path) SELECT path, code FROM j WHERE code IS NOT NULL""")
def j13_inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), (F.col("doc_id") % 20).alias("k"))
    a = d.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "size", "sha256")
    b = d.where("k <> 1").select(F.concat(F.when(F.col("k") == 2, "new/").otherwise("doc/"), F.col("doc_id").cast("string")).alias("path"), "size", F.when(F.col("k") == 3, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"))
    return audit.inventory_diff(a, b)


def _edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = talk(spark, sf_dir).select(F.col("section_id").alias("track_id"), F.col("pos").alias("line"), F.col("role").alias("text"), F.lit("old").alias("value"))
    k = F.pmod(F.col("track_id") * 3 + F.col("line"), F.lit(8))
    e = t.where(k < 5).select("track_id", F.when(k == 1, F.col("line") + 1000).otherwise(F.col("line")).alias("line"), F.when(k == 2, "x").otherwise(F.col("text")).alias("text"), F.when(k == 3, " ").otherwise("new").alias("value"), k.alias("k"))
    return t, e.unionByName(e.where("k = 4")).drop("k")


@query(f"WITH {TALK} SELECT section_id AS track_id, pos AS line, role AS text, CASE WHEN (section_id * 3 + pos) % 8 = 0 THEN 'new' ELSE 'old' END AS value FROM talk")
def j14_overlay_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.overlay_edits(*_edits(spark, sf_dir))[0]


@query(f"""WITH {TALK}, k AS (SELECT section_id AS track_id, pos AS line, (section_id * 3 + pos) % 8 AS k FROM talk)
SELECT track_id, line + 1000 AS line, 'unknown_line' AS code FROM k WHERE k = 1 UNION ALL SELECT track_id, line, 'text_changed' FROM k WHERE k = 2 UNION ALL SELECT track_id, line, 'blank' FROM k WHERE k = 3 UNION ALL SELECT track_id, line, 'duplicate' FROM k, range(2) WHERE k = 4""")
def j14_rejected_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.overlay_edits(*_edits(spark, sf_dir))[1]


@query(f"""WITH {TALK}, r AS (SELECT section_id, pos, start, "end" FROM talk WHERE pos >= 1) SELECT section_id AS track_id, pos - 1 AS pos, pos AS ref_pos, start AS ref_start, "end" AS ref_end, start - start AS start_delta FROM r""")
def j15_timing_reference_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns but the first, looked up in the whole conversation; their texts are told apart by section and place."""
    t = talk(spark, sf_dir).select(F.col("section_id").alias("track_id"), "pos", F.concat(F.lit("turn "), F.col("pos").cast("string")).alias("text"), "start", "end")
    want = t.where("pos >= 1").withColumn("pos", F.col("pos") - 1).drop("end")
    return j.timing_reference_match(want, t)


@query(f"""WITH {SECTIONS}, {CUES}, t AS (SELECT section_id AS track_id, pos, c.start, c."end", c.start + s.start + CAST(0.25 AS DOUBLE) - s.start AS a, c."end" + s.start + CAST(0.25 AS DOUBLE) - s.start AS b, s."end" - s.start AS duration FROM cues c JOIN sections s USING (section_id)),
x AS (SELECT *, CASE WHEN a < 0 OR b <= a OR b > duration THEN 'imported_time_outside_section' END AS code FROM t)
SELECT track_id, pos, start, "end", {_MICRO("a")} AS imported_start, {_MICRO("b")} AS imported_end, {_MICRO("a - start")} AS start_adjustment, {_MICRO('b - "end"')} AS end_adjustment, code, count(code) OVER (PARTITION BY track_id) = 0 AS accepted FROM x""")
def j16_import_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues matched in the recording, where they stand a quarter second late, on the clock of their section."""
    c = cues(spark, sf_dir).select(F.col("section_id").alias("track_id"), "pos", F.concat(F.lit("cue "), F.col("pos").cast("string")).alias("text"), "start", "end")
    s = sections(spark, sf_dir).select(F.col("section_id").alias("track_id"), (-F.col("start")).alias("shift"), (F.col("end") - F.col("start")).alias("duration"))
    heard = c.join(s, "track_id").select("track_id", "pos", "text", (F.col("start") - F.col("shift") + 0.25).alias("start"), (F.col("end") - F.col("shift") + 0.25).alias("end"))
    return j.import_timings(j.timing_reference_match(c.drop("end"), heard), c, s)


def _repeats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cues of orders in blocks of four: the first block is the sample, the rest are occurrences. The times of a sample's
    last cue were not imported where the order's number divides by five; by seven, the rhythm does not fit."""
    c = cues(spark, sf_dir)
    b = c.select(F.col("section_id").alias("group_id"), F.floor(F.col("pos") / 4).cast("int").alias("occurrence"), (F.col("pos") % 4).alias("offset"), F.col("role").alias("text"), "start", "end")
    d = F.count("*").over(Window.partitionBy("group_id", "occurrence")) * 1.0
    none = F.array().cast("array<string>")
    b = b.withColumn("duration", d).withColumn("risks", F.when(F.col("text") == "speech", F.array(F.lit("speech"))).when(F.col("text") == "lyric_adlib", F.array(F.lit("lyric_adlib"))).otherwise(none))
    imported = (F.col("group_id") % 5 != 0) | (F.col("offset") != 3)
    s = b.where("occurrence = 0").select("group_id", "offset", "text", "risks", F.when(imported, (F.col("start") % 1.0) * 0.5).alias("start_delta"), F.when(imported, F.col("end") % 1.0).alias("end_delta"), "duration")
    mapping = F.when(F.col("group_id") % 7 == 0, F.array(F.lit("duration_drift_exceeds_limit"))).otherwise(none)
    return s, b.where("occurrence > 0").withColumn("mapping", mapping)


@query(f"""WITH {CUES}, b AS (SELECT section_id AS group_id, CAST(floor(pos / 4) AS INTEGER) AS occurrence, pos % 4 AS "offset", role AS text, start, "end" FROM cues),
d AS (SELECT *, count(*) OVER (PARTITION BY group_id, occurrence) * CAST(1.0 AS DOUBLE) AS duration, CASE text WHEN 'speech' THEN ['speech'] WHEN 'lyric_adlib' THEN ['lyric_adlib'] ELSE [] END AS risks FROM b),
m AS (SELECT o.group_id, o.occurrence, o."offset", o.text, o.start, o."end", o.risks, s.text AS t, coalesce(s.risks, []) AS sample_risks, o.duration / s.duration AS scale,
  CASE WHEN o.group_id % 5 <> 0 OR o."offset" <> 3 THEN (s.start % 1.0) * CAST(0.5 AS DOUBLE) END AS sd, CASE WHEN o.group_id % 5 <> 0 OR o."offset" <> 3 THEN s."end" % 1.0 END AS ed
  FROM d o LEFT JOIN d s ON s.group_id = o.group_id AND s."offset" = o."offset" AND s.occurrence = 0 WHERE o.occurrence > 0),
v AS (SELECT *, start + coalesce(sd * scale, 0.0) AS new_start, "end" + coalesce(ed * scale, 0.0) AS new_end,
  list_concat(list_concat(list_concat(CASE WHEN group_id % 7 = 0 THEN ['duration_drift_exceeds_limit'] ELSE [] END, CASE WHEN text IS DISTINCT FROM t THEN ['text_mismatch'] ELSE [] END), list_concat(sample_risks, list_filter(risks, lambda x: NOT list_contains(sample_risks, x)))), CASE WHEN sd IS NULL THEN ['representative_boundary_not_imported'] ELSE [] END) AS shared FROM m),
r AS (SELECT *, array_to_string(list_concat(shared, CASE WHEN abs(new_start - start) > 0.75 THEN ['start_adjustment_exceeds_0_75_seconds'] ELSE [] END), ',') AS start_reasons, array_to_string(list_concat(shared, CASE WHEN abs(new_end - "end") > 0.75 THEN ['end_adjustment_exceeds_0_75_seconds'] ELSE [] END), ',') AS end_reasons FROM v)
SELECT group_id, occurrence, "offset", new_start, new_end, start_reasons, end_reasons, start_reasons = '' AND end_reasons = '' AS eligible FROM r""")
def j17_propagate_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = j.propagate_timing(*_repeats(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("start_reasons", "end_reasons")})


@query(f"""WITH {SECTIONS}, a AS (SELECT concert_id, start AS x, max("end") AS y FROM sections GROUP BY ALL), l AS (SELECT concert_id, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, max(x) OVER (PARTITION BY concert_id) AS m FROM a WINDOW w AS (PARTITION BY concert_id ORDER BY x)),
t AS (SELECT concert_id, section_id, start + 10.0 AS q FROM sections)
SELECT t.concert_id, section_id, q AS "at", y0 + (q - x0) / (x1 - x0) * (y1 - y0) AS value FROM t LEFT JOIN l ON l.concert_id = t.concert_id AND x1 IS NOT NULL AND q >= x0 AND (q < x1 OR (q = x1 AND x1 = m))""")
def j18_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections(spark, sf_dir)
    # the latest end of each start: a sort of the rows takes less memory than hash tables of nearly as many keys
    latest = F.row_number().over(Window.partitionBy("concert_id", "start").orderBy(F.desc("end")))
    anchors = s.select("concert_id", F.col("start").alias("x"), F.col("end").alias("y"), latest.alias("_n")).where("_n = 1").drop("_n")
    return j.interpolate(s.select("concert_id", "section_id", (F.col("start") + 10.0).alias("at")), anchors, "concert_id")


def _structure(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of four cues are cycles, the two halves of a block parts A and B."""
    c = cues(spark, sf_dir)
    lines = c.select(F.col("section_id").alias("track_id"), F.floor(F.col("pos") / 4).cast("string").alias("cycle"), F.when(F.col("pos") % 4 < 2, "A").otherwise("B").alias("part"), (F.col("pos") % 2).alias("offset"), (F.col("pos") * 5.0).alias("start"), (F.col("pos") * 5.0 + 4.0 + F.col("section_id") % 3).alias("end"))
    parts = lines.groupBy("track_id", "cycle", "part").agg(F.lit("verse").alias("role"), F.when(F.col("track_id") % 5 == F.col("cycle").cast("int"), 12).otherwise(8).alias("beats"), F.count("*").alias("n_lines"), F.lit(True).alias("complete"), F.min("start").alias("start"), (F.min("start") + 10.0 + F.col("cycle").cast("int")).alias("end"))
    return lines, parts


@query(f"""WITH {CUES}, l AS (SELECT section_id AS track_id, CAST(CAST(floor(pos / 4) AS BIGINT) AS VARCHAR) AS cycle, CASE WHEN pos % 4 < 2 THEN 'A' ELSE 'B' END AS part, pos % 2 AS "offset", pos * CAST(5.0 AS DOUBLE) AS start, pos * CAST(5.0 AS DOUBLE) + 4.0 + section_id % 3 AS "end" FROM cues),
p AS (SELECT track_id, cycle, part, CASE WHEN track_id % 5 = CAST(cycle AS INTEGER) THEN 12 ELSE 8 END AS beats, count(*) AS n, min(start) AS s, min(start) + 10.0 + CAST(cycle AS INTEGER) AS e FROM l GROUP BY track_id, cycle, part),
q AS (SELECT p.track_id, p.cycle, p.part, CASE WHEN r.part IS NULL THEN 'no_reference_part' WHEN p.beats <> r.beats THEN 'beats' WHEN p.n <> r.n THEN 'line_count' END AS reason, (p.e - p.s) / (r.e - r.s) AS scale, p.s AS t, r.s AS f FROM p LEFT JOIN p r ON r.track_id = p.track_id AND r.part = p.part AND r.cycle = '0' WHERE p.cycle <> '0'),
o AS (SELECT l.track_id, l.cycle, l.part, l."offset", CASE WHEN reason IS NULL THEN t + (v.start - f) * scale END AS start, CASE WHEN reason IS NULL THEN t + (v."end" - f) * scale END AS "end", reason FROM l JOIN q USING (track_id, cycle, part) LEFT JOIN l v ON v.track_id = l.track_id AND v.part = l.part AND v."offset" = l."offset" AND v.cycle = '0'),
g AS (SELECT *, coalesce(start < lag("end") OVER w - 0.001 OR "end" > lead(start) OVER w + 0.001, FALSE) AS touch FROM o WHERE start IS NOT NULL WINDOW w AS (PARTITION BY track_id ORDER BY start, cycle, part, "offset"))
SELECT * EXCLUDE (touch), CASE WHEN touch THEN 'overlap' ELSE 'mapped' END AS status FROM g UNION ALL SELECT *, 'local_review' FROM o WHERE start IS NULL""")
def j19_structure_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.structure_transfer(*_structure(spark, sf_dir), "0")


@query(f"""WITH {TALK}, l AS (SELECT section_id AS track_id, CAST(floor(start * 1000) AS BIGINT) AS ms, pos AS n, CASE WHEN pos % 4 = 3 THEN 'la la' ELSE text END AS text FROM talk WHERE text <> ''), t AS (SELECT track_id, ms + 100 AS ms, n, 'tr' || n AS text FROM l WHERE n % 4 < 2),
d AS (SELECT track_id, max(ms) / 1000.0 + 3.0 AS duration FROM l GROUP BY track_id),
m AS (SELECT l.track_id, l.n, t.text AS tr, row_number() OVER (PARTITION BY l.track_id, l.n ORDER BY abs(l.ms - t.ms), t.n) AS k FROM l JOIN t ON t.track_id = l.track_id AND abs(l.ms - t.ms) <= 350),
c AS (SELECT l.*, l.ms / 1000.0 AS start, lead(l.ms) OVER (PARTITION BY l.track_id ORDER BY l.n) / 1000.0 AS nx, duration FROM l JOIN d USING (track_id)),
w AS (SELECT c.track_id, c.n, start, CASE WHEN nx IS NOT NULL THEN greatest(start + CAST(0.05 AS DOUBLE), nx - CAST(0.05 AS DOUBLE)) ELSE least(duration, start + 6.0) END AS "end", coalesce(tr, CASE WHEN c.text = 'la la' THEN c.text END) AS translation, c.text FROM c LEFT JOIN m ON m.track_id = c.track_id AND m.n = c.n AND m.k = 1)
SELECT *, translation IS NULL AS missing FROM w""")
def j24_merge_lrc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = talk(spark, sf_dir).where("text <> ''")
    lines = base.select(F.col("section_id").alias("track_id"), F.floor(F.col("start") * 1000).cast("long").alias("ms"), F.col("pos").alias("n"), F.when(F.col("pos") % 4 == 3, "la la").otherwise(F.col("text")).alias("text"))
    tr = lines.where("n % 4 < 2").select("track_id", (F.col("ms") + 100).alias("ms"), "n", F.concat(F.lit("tr"), F.col("n").cast("string")).alias("text"))
    d = lines.groupBy("track_id").agg((F.max("ms") / 1000.0 + 3.0).alias("duration"))
    return j.merge_lrc(lines, tr, d)


@query(f"""WITH {TALK}, t AS (SELECT section_id AS track_id, pos, CASE WHEN pos % 2 = 0 THEN 'la' ELSE role END AS text, start, "end" FROM talk), w AS (SELECT track_id, pos - 1 AS pos, text FROM t WHERE pos BETWEEN 1 AND 2), n AS (SELECT track_id, count(*) AS n FROM w GROUP BY track_id),
c AS (SELECT t.track_id, t.pos AS s, any_value(n) AS n, count(*) AS hits FROM t JOIN n USING (track_id) JOIN w ON w.track_id = t.track_id JOIN t r ON r.track_id = t.track_id AND r.pos = t.pos + w.pos AND r.text = w.text GROUP BY t.track_id, t.pos),
b AS (SELECT c.track_id, s, n, row_number() OVER (PARTITION BY c.track_id ORDER BY abs(t.start - 100.0), s) AS k FROM c JOIN t ON t.track_id = c.track_id AND t.pos = s WHERE hits = n)
SELECT b.track_id, t.pos - s AS pos, t.pos AS ref_pos, t.start AS ref_start, t."end" AS ref_end, t.start - (100.0 + (t.pos - s)) AS start_delta FROM b JOIN t ON t.track_id = b.track_id AND t.pos BETWEEN s AND s + n - 1 WHERE k = 1""")
def j15_refrains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns of each conversation, in which every second says the same, looked up where they stand nearest to 100 seconds."""
    t = talk(spark, sf_dir).select(F.col("section_id").alias("track_id"), "pos", F.when(F.col("pos") % 2 == 0, "la").otherwise(F.col("role")).alias("text"), "start", "end")
    want = t.where("pos BETWEEN 1 AND 2").select("track_id", (F.col("pos") - 1).alias("pos"), "text", (F.lit(100.0) + F.col("pos") - 1).alias("start"))
    return j.timing_reference_match(want, t)
