"""Queries on gates: sequences from line items, texts from conversations, reports from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gates as g
from .adapters import CUES, TALK, cues, read, talk
from .registry import query


def _union(parts: list[tuple[str, str, str]], source: str, keys: str = "section_id, pos") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{code}' AS code, '{level}' AS severity FROM {source} WHERE {cond}" for cond, code, level in parts)


_TIME = [
    ("start < ps - 0.001", "event_order_changed", "hard"),
    ('start >= "end"', "invalid_time", "hard"),
    ('start < "end" AND "end" - start < 0.2 - 0.001', "unreadable_event_duration", "hard"),
    ('start < "end" AND "end" - start >= 0.2 - 0.001 AND "end" - start < 0.35 - 0.001', "very_short_event_duration", "review"),
    ('start < -0.001 OR "end" > section_end + 0.001', "outside_section", "hard"),
    ("pe >= 0 AND start < pe - 0.001", "overlap", "hard"),
]
_SEQ = """seq AS (SELECT *, lag(start) OVER w AS ps, lag("end") OVER w AS pe FROM cues WINDOW w AS (PARTITION BY section_id ORDER BY pos))"""


@query(f"WITH {CUES}, {_SEQ} {_union(_TIME, 'seq')}")
def g1_g5_time_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.time_gates(cues(spark, sf_dir))


def _evidenced(c: DataFrame) -> DataFrame:
    kind = F.pmod(F.col("section_id") + F.col("pos"), F.lit(4))
    e = F.when(kind == 0, F.array(F.lit("asr_words"))).when(kind == 1, F.array(F.lit("continuous_av_review"))).when(kind == 2, F.array(F.lit("guess")))
    return c.withColumns({"evidence": e, "role": F.when(F.pmod(F.col("section_id"), F.lit(50)) == 7, "shout").otherwise(F.col("role"))})


_ROLE = [
    ("role NOT IN ('lyric', 'speech', 'lyric_adlib')", "invalid_event_role", "hard"),
    ("role = 'lyric_adlib' AND section_type <> 'song'", "lyric_adlib_outside_song", "hard"),
    ("role = 'lyric_adlib' AND k NOT IN (0, 1)", "lyric_adlib_missing_evidence", "hard"),
    ("role = 'lyric_adlib'", "lyric_adlib_review_required", "review"),
    ("section_type = 'song' AND role = 'speech' AND k <> 0", "embedded_speech_missing_asr_evidence", "hard"),
    ("section_type = 'song' AND role = 'speech'", "embedded_speech_review_required", "review"),
]


@query(f"WITH {CUES}, e AS (SELECT * REPLACE (CASE WHEN section_id % 50 = 7 THEN 'shout' ELSE role END AS role), (section_id + pos) % 4 AS k FROM cues) {_union(_ROLE, 'e')}")
def g8_g10_role_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.role_gates(_evidenced(cues(spark, sf_dir)))


def _mc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as MC cues: every sixth without a translation, else its first 60 characters."""
    t = talk(spark, sf_dir)
    return t.select("section_id", "pos", F.col("text").alias("source_text"), F.when(F.pmod("pos", F.lit(6)) != 0, F.col("text")).alias("translation"), F.lit("speech").alias("role"), F.lit("mc").alias("section_type"), "start", "end")


_WIDE = T.wide()
_WS = T.SPACE


def units_sql(x: str) -> str:
    bare = f"regexp_replace({x}, '[{_WS}]+', '', 'g')"
    return f"(length({bare}) + length(regexp_replace({bare}, '[^{_WIDE}]+', '', 'g')))"


def mc_sql(x: str) -> str:
    """Without look-around: dots between digits are put aside first."""
    dotted = f"regexp_replace({x}, '[.．｡]{{2,}}', '…', 'g')"
    kept = f"regexp_replace(regexp_replace({dotted}, '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1␞\\2', 'g'), '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1␞\\2', 'g')"
    return f"replace(regexp_replace({kept}, '[,，。、｡､.．]', '', 'g'), '␞', '.')"


_MC = f"""mc AS (SELECT section_id, pos, text AS s, CASE WHEN pos % 6 <> 0 THEN text ELSE '' END AS t FROM talk),
m AS (SELECT *, {units_sql('s')} AS us, {units_sql('t')} AS ut, {mc_sql('s')} AS ns, {mc_sql('t')} AS nt FROM mc)"""
_TEXT = [
    (f"regexp_replace(s, '[{_WS}]+', '', 'g') = ''", "empty_source_text", "hard"),
    (f"regexp_replace(t, '[{_WS}]+', '', 'g') = ''", "missing_translation", "hard"),
    ("ns <> s", "mc_disallowed_punctuation:source_text", "hard"),
    ("nt <> t", "mc_disallowed_punctuation:translation", "hard"),
    ("us > 56 OR ut > 44", "overlong_mc_event", "hard"),
]


@query(f"WITH {TALK}, {_MC} {_union(_TEXT, 'm')}")
def g6_g9_text_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.text_gates(_mc_text(spark, sf_dir))


def _lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = talk(spark, sf_dir)
    canonical = F.when(F.pmod("pos", F.lit(3)) == 0, F.upper("text")).when(F.pmod("pos", F.lit(3)) == 1, F.concat(F.lit(" "), "text"))
    evidence = F.when(F.pmod("section_id", F.lit(2)) == 0, F.array(F.lit("continuous_av_review"))).otherwise(F.array(F.lit("asr_words")))
    span = F.array(F.col("pos") + 1, F.col("pos") + 1 + F.pmod(F.col("pos"), F.lit(2)))
    return t.select("section_id", "pos", F.col("text").alias("source_text"), canonical.alias("canonical_source_text"), evidence.alias("evidence"), span.alias("lyric_line_span"), F.lit("song").alias("section_type"), F.lit("lyric").alias("role"), "start", "end")




def _squeeze(x: str) -> str:
    return f"regexp_replace({x}, '[{_WS}]+', '', 'g')"


_VARIANT = [
    ("differs AND section_id % 2 <> 0", "live_lyric_variant_missing_manual_av_evidence", "hard"),
    ("differs", "live_lyric_variant_review_required", "review"),
    ("pos % 2 = 1", "lyric_semantic_merge_review_required", "review"),
]


@query(f"WITH {TALK}, v AS (SELECT section_id, pos, pos % 3 = 0 AND {_squeeze('upper(text)')} <> {_squeeze('text')} AS differs FROM talk) {_union(_VARIANT, 'v')}")
def g11_g12_variant_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.variant_gates(_lyrics(spark, sf_dir))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir).where("pos % 2 = 0")
    n = F.count("*").over(g.Window.partitionBy("section_id"))
    evidence = F.when(F.col("role") == "speech", F.array(F.lit("guess"))).otherwise(F.array(F.lit("continuous_av_review")))
    return c.select("section_id", F.col("pos").alias("first"), (F.col("pos") + F.floor(F.abs("start")).cast("int") % 4).alias("last"), (n * 2).alias("n_lines"), evidence.alias("evidence"))


_SPAN = [("first < 1 OR last > n_lines OR first > last", "invalid_omitted_span", "hard"), ("role = 'speech'", "omitted_span_missing_evidence", "hard"), ("first <= pl", "omitted_spans_overlap", "hard")]


@query(f"""WITH {CUES}, o AS (SELECT section_id, role, pos AS first, pos + CAST(floor(abs(start)) AS INTEGER) % 4 AS last, count(*) OVER (PARTITION BY section_id) * 2 AS n_lines FROM cues WHERE pos % 2 = 0),
p AS (SELECT *, lag(last) OVER (PARTITION BY section_id ORDER BY first, last) AS pl FROM o) {_union(_SPAN, 'p', 'section_id, first, last')}""")
def g13_omitted_span_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.omitted_span_gates(_spans(spark, sf_dir))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0")
    p = F.col("o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("section_id"),
        F.when(F.col("o_orderkey") % 5 != 0, p / 100000.0).alias("first_vocal_start"),
        (p / 50000.0).alias("max_correction_seconds"),
        (p / 70000.0).alias("max_extrapolation_seconds"),
        (p / 200000.0 + 0.5).alias("alignment_slope"),
        (p / 1000000.0).alias("first_reliable_anchor_ratio"),
        (F.col("o_orderstatus") == "P").alias("unsafe_reference_extrapolation"),
        (p / 400000.0).alias("boundary_confidence"),
    )


_REPORTS = """reports AS (SELECT o_orderkey AS section_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 100000.0 END AS v, o_totalprice / 50000.0 AS c, o_totalprice / 70000.0 AS x,
  o_totalprice / 200000.0 + 0.5 AS s, o_totalprice / 1000000.0 AS a, o_orderstatus = 'P' AS u, o_totalprice / 400000.0 AS b FROM orders WHERE o_orderkey % 11 <> 0)"""
_ALIGN = [
    ("c > 5.0", "excessive_correction", "hard"), ("c > 2.0 AND c <= 5.0", "large_correction", "review"), ("x > 5.0", "excessive_extrapolation", "hard"), ("x > 2.0 AND x <= 5.0", "large_extrapolation", "review"),
    ("s < 0.75 OR s > 1.35", "unsafe_alignment_slope", "hard"), ("(s >= 0.75 AND s < 0.85) OR (s > 1.15 AND s <= 1.35)", "unusual_alignment_slope", "review"), ("a > 0.2", "late_first_reliable_anchor", "review"),
    ("u", "unsafe_reference_extrapolation", "hard"), ("b < 0.6", "low_boundary_confidence", "review"),
]


@query(f"WITH {_REPORTS} {_union(_ALIGN, 'reports', 'section_id')}")
def g17_alignment_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.alignment_gates(_reports(spark, sf_dir))


@query(f"""WITH {CUES}, {_REPORTS}, f AS (SELECT section_id, arg_min(start, pos) AS first, min(pos) AS pos FROM cues WHERE section_type = 'song' AND role = 'lyric' GROUP BY section_id),
j AS (SELECT * FROM f LEFT JOIN reports USING (section_id)) {_union([("v IS NULL", "missing_first_vocal_start", "review"), ("v - first > 0.35", "lyrics_before_vocal", "hard")], "j")}""")
def g15_vocal_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.vocal_gates(cues(spark, sf_dir), _reports(spark, sf_dir))


def _instrumental(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, d = read(spark, sf_dir, "orders"), F.pmod("o_orderkey", F.lit(9)).cast("double")
    return o.select(F.col("o_orderkey").alias("section_id"), d.alias("start"), (d + F.col("o_totalprice") / 50000.0 - 1.0).alias("end"), (F.col("o_totalprice") / 200000.0).alias("confidence"))


@query(f"""WITH {CUES}, sure AS (SELECT o_orderkey AS section_id, CAST(o_orderkey % 9 AS DOUBLE) AS gs, CAST(o_orderkey % 9 AS DOUBLE) + o_totalprice / 50000.0 - 1.0 AS ge FROM orders WHERE o_totalprice / 200000.0 >= 0.75)
SELECT section_id, pos, 'lyrics_in_instrumental_gap' AS code, 'hard' AS severity FROM cues JOIN sure USING (section_id) WHERE section_type = 'song' AND role = 'lyric' AND ge > gs AND least("end", ge) - greatest(start, gs) > 0.25
UNION ALL SELECT section_id, NULL, 'invalid_instrumental_gap', 'hard' FROM sure WHERE ge <= gs""")
def g16_instrumental_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.instrumental_gates(cues(spark, sf_dir), _instrumental(spark, sf_dir))


@query(f"""WITH {_REPORTS}, s AS (SELECT o_orderkey AS section_id FROM orders)
SELECT section_id, 'empty_section_events' AS code, 'hard' AS severity FROM s WHERE section_id NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT section_id, 'missing_section_report', 'hard' FROM s WHERE section_id NOT IN (SELECT section_id FROM reports)""")
def g18_presence_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section_id"))
    c = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section_id"))
    return g.presence_gates(o, c, _reports(spark, sf_dir))


@query(f"""WITH {CUES}, {_SEQ}, flags AS ({_union(_TIME, 'seq')}), sums AS (SELECT section_id, count(*) FILTER (severity = 'hard') AS hard, count(*) FILTER (severity = 'review') AS review, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM flags GROUP BY section_id)
SELECT o_orderkey AS section_id, coalesce(hard, 0) AS hard, coalesce(review, 0) AS review, coalesce(codes, '') AS codes, CASE WHEN coalesce(hard, 0) > 0 THEN 'failed' ELSE 'passed' END AS result FROM orders LEFT JOIN sums ON section_id = o_orderkey""")
def g19_gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section_id"))
    return g.gate_summary(g.time_gates(cues(spark, sf_dir)), o)


def _sung(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as one part; who sings, how and with which colour follows from numbers."""
    t = talk(spark, sf_dir)
    k = F.pmod(F.col("section_id") * 7 + F.col("pos"), F.lit(12))
    mode = F.when(k < 6, "solo").when(k < 9, "group").otherwise("unknown")
    ids = F.when(k < 5, F.array(F.concat(F.lit("p"), (k % 3).cast("string")))).when(k < 8, F.array(F.lit("p0"), F.lit("p1"))).otherwise(F.array().cast("array<string>"))
    color = F.when(k < 4, F.when(F.pmod("section_id", F.lit(10)) == 3, "#00ff00").otherwise("#FF0000"))
    basis = F.when(F.pmod("pos", F.lit(2)) == 0, "audio_review").otherwise("camera")
    part = F.struct(F.col("text").alias("text"), mode.alias("mode"), F.when(k % 2 == 0, "confirmed").otherwise("candidate").alias("status"), ids.alias("performer_ids"), color.alias("color"), F.array(F.struct(basis.alias("basis"), F.lit("00:01").alias("reference"))).alias("evidence"))
    return t.select("section_id", "pos", F.floor(F.col("section_id") / 10).alias("concert_id"), F.col("text").alias("source_text"), F.lit("lyric").alias("role"), F.lit("song").alias("section_type"), F.array(part).alias("singing_parts"))


_SUNG = f"""sung AS (SELECT section_id, pos, text, CAST(floor(section_id / 10) AS BIGINT) AS concert_id, (section_id * 7 + pos) % 12 AS k, CASE WHEN section_id % 10 = 3 THEN '#00FF00' ELSE '#FF0000' END AS color FROM {{}})"""


@query(f"""WITH {TALK}, {_SUNG.format('talk')}, f AS (SELECT section_id, pos, CASE WHEN text = '' THEN 'part_without_text' WHEN text <> trim(text) THEN 'text_changed' WHEN k IN (5, 6, 7) AND k = 5 THEN 'performer_count'
  WHEN k >= 9 AND k % 2 = 0 THEN 'unknown_confirmed' WHEN k % 2 = 0 AND pos % 2 <> 0 THEN 'unconfirmed' END AS fault FROM sung) SELECT * FROM f WHERE fault IS NOT NULL""")
def g20_singing_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.singing_gates(_sung(spark, sf_dir))


@query(f"""WITH {TALK}, {_SUNG.format('talk')}, one AS (SELECT concert_id, section_id, pos, 0 AS part, 'p' || (k % 3) AS performer, color FROM sung WHERE k < 4 AND k % 2 = 0),
w AS (SELECT *, first(color) OVER (PARTITION BY concert_id, performer ORDER BY section_id, pos, part) AS first_color FROM one) SELECT * FROM w WHERE color <> first_color""")
def g21_palette_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.palette_gates(_sung(spark, sf_dir))


@query("""SELECT user_id AS section_id, CASE WHEN count(*) > 70 OR count(DISTINCT event_type) >= 6 OR count(*) FILTER (value > 400) > 0 THEN 'high' WHEN count(*) > 60 THEN 'medium' ELSE 'low' END AS level FROM events GROUP BY user_id""")
def g22_mc_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("section_id")).agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("k"), F.count_if(F.col("value") > 400).alias("r"))
    risks = F.when(F.col("r") > 0, F.array(F.lit("overlap"))).otherwise(F.array().cast("array<string>"))
    return e.select("section_id", g.mc_policy((F.col("n") > 70) | (F.col("k") >= 6), F.lit(1), risks, F.col("n") > 60)["level"].alias("level"))


@query("""WITH p AS (SELECT user_id AS section_id, list(DISTINCT event_type) AS reviewed FROM events WHERE event_id % 3 = 0 GROUP BY user_id)
SELECT section_id, array_to_string(list_sort(list_filter(['click', 'listen', 'purchase', 'translation', 'view'], lambda x: NOT list_contains(reviewed, x))), ',') AS missing FROM p""")
def g24_missing_review_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_id % 3 = 0").groupBy(F.col("user_id").alias("section_id")).agg(F.collect_set("event_type").alias("reviewed"))
    required, triggered = F.array(*map(F.lit, ("listen", "translation", "view"))), F.array(*map(F.lit, ("click", "purchase", "view")))
    return e.select("section_id", F.array_join(g.missing_review_points(required, triggered, F.col("reviewed")), ",").alias("missing"))


def _cw_sql(x: str) -> str:
    bare = f"regexp_replace({x}, '[{_WS}]+', '', 'g')"
    n = f"length(regexp_replace({bare}, '[^\\x00-\\x7F]+', '', 'g'))"
    return f"({n} * 0.5 + (length({bare}) - {n}) * 1.0)"


@query(f"""WITH {TALK}, w AS (SELECT section_id, pos, "end" - start AS d, {_cw_sql('text')} AS c, {_cw_sql('text')} AS j FROM talk)
SELECT section_id, pos, concat_ws(',', CASE WHEN d > 8 THEN 'duration_gt_8s' END, CASE WHEN c > 20 THEN 'chinese_gt_20' END, CASE WHEN j > 28 THEN 'japanese_gt_28' END) AS reasons FROM w""")
def g26_segmentation_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = talk(spark, sf_dir)
    return t.select("section_id", "pos", F.array_join(g.segmentation_review(F.col("end") - F.col("start"), F.col("text"), F.col("text")), ",").alias("reasons"))


_BI = [('start < 0 OR "end" <= start', "invalid_time", "hard"), ("start < pe - 0.001", "overlap", "hard"), ("role = 'speech'", "missing_text", "hard")]


@query(f"WITH {CUES}, {_SEQ} {_union(_BI, 'seq')}")
def g29_bilingual_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return g.bilingual_gates(c.select("section_id", "pos", "start", "end", F.when(F.col("role") != "speech", F.col("role")).alias("chinese"), F.lit("x").alias("japanese")))


def _edited(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    base = c.select(F.col("section_id").alias("track_id"), F.col("pos").alias("line"), F.col("role").alias("text"), "start", "end")
    k = F.pmod(F.col("track_id") + F.col("line"), F.lit(20))
    edited = base.where(k != 0).select("track_id", F.when(k == 1, F.col("line") + 1000).otherwise(F.col("line")).alias("line"), F.when(k == 2, "x").otherwise(F.col("text")).alias("text"), "start", F.when(k == 3, F.col("end") + 0.5).otherwise(F.col("end")).alias("end"))
    return base, edited


@query(f"""WITH {CUES}, b AS (SELECT section_id AS track_id, pos AS line, role AS text, start, "end", (section_id + pos) % 20 AS k FROM cues),
e AS (SELECT track_id, CASE WHEN k = 1 THEN line + 1000 ELSE line END AS line, CASE WHEN k = 2 THEN 'x' ELSE text END AS text, start, CASE WHEN k = 3 THEN "end" + 0.5 ELSE "end" END AS "end" FROM b WHERE k <> 0),
j AS (SELECT coalesce(b.track_id, e.track_id) AS track_id, coalesce(b.line, e.line) AS line, CASE WHEN e.track_id IS NULL THEN 'line_lost' WHEN b.track_id IS NULL THEN 'line_added' WHEN b.text <> e.text THEN 'text_changed' WHEN NOT (e.start < e."end") THEN 'illegal_time' WHEN b."end" <> e."end" THEN 'timing_changed' END AS code
  FROM b FULL JOIN e ON b.track_id = e.track_id AND b.line = e.line) SELECT * FROM j WHERE code IS NOT NULL""")
def g30_frozen_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.frozen_fields(*_edited(cues(spark, sf_dir)))


@query(f"""WITH {CUES} SELECT section_id, pos, concat_ws(',', CASE WHEN "end" - start > 12 THEN 'duration_gt_12s' END, CASE WHEN "end" - start < 0.3 THEN 'duration_lt_0.3s' END) AS flags FROM cues""")
def g33_phone_line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues(spark, sf_dir).select("section_id", "pos", g.phone_line_flags(F.col("end") - F.col("start")).alias("flags"))


@query("""WITH o AS (SELECT o_orderkey AS media_id, o_totalprice AS p, o_orderkey % 8 AS k FROM orders), f AS (
SELECT media_id, 'missing_render' AS code FROM o WHERE k = 0 UNION ALL SELECT media_id, 'size' FROM o WHERE k = 1 UNION ALL SELECT media_id, 'duration' FROM o WHERE k <> 0 AND p / 500000.0 > 0.25
UNION ALL SELECT media_id, 'codec' FROM o WHERE k = 3 UNION ALL SELECT media_id, 'no_audio' FROM o WHERE k = 4 UNION ALL SELECT media_id, 'audio_changed' FROM o WHERE k = 5) SELECT * FROM f""")
def g35_media_pair_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("media_id"), F.col("o_totalprice").alias("p"), (F.col("o_orderkey") % 8).alias("k"))
    common = [F.lit(1080).alias("height")]
    first = o.select("media_id", F.lit(1920).alias("width"), *common, F.lit(0.0).alias("duration"), F.lit("h264").alias("codec"), F.lit("a").alias("audio_hash"))
    k = F.col("k")
    second = o.where("k <> 0").select("media_id", F.when(k == 1, 1280).otherwise(1920).alias("width"), *common, (F.col("p") / 500000.0).alias("duration"), F.when(k == 3, "vp9").otherwise("h264").alias("codec"), F.when(k == 4, None).when(k == 5, "b").otherwise("a").alias("audio_hash"))
    return g.media_pair_faults(first, second)


@query("""SELECT o_orderkey AS section_id, unnest(CASE WHEN o_orderkey % 10 = 0 THEN ['section_missing_from_manifest'] ELSE list_filter([CASE WHEN o_orderkey % 10 = 1 THEN 'stale_package' END, CASE WHEN o_orderkey % 15 = 1 THEN 'stale_lyrics' END], lambda x: x IS NOT NULL) END) AS code FROM orders""")
def g36_stale_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section_id"), "o_totalprice")
    taken = o.select("section_id", T.content_hash("o_totalprice").alias("package"), T.content_hash("section_id").alias("lyrics"))
    moved = o.withColumn("o_totalprice", F.when(F.col("section_id") % 10 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("other", F.when(F.col("section_id") % 15 == 1, -F.col("section_id")).otherwise(F.col("section_id")))
    now = moved.where("section_id % 10 <> 0").select("section_id", T.content_hash("o_totalprice").alias("package"), F.sha2(F.to_json(F.struct(F.col("other").alias("section_id")), {"ignoreNullFields": "false"}), 256).alias("lyrics"))
    return g.stale_hashes(taken, now, ["package", "lyrics"])
