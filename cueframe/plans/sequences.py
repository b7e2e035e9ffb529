"""Queries on files, structure, signals, reflow and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import timecode as C
from ..operators import align, reflow, signal, structure as st
from ..sources import datasource as ds
from ..sources import readers as r, writers as w
from ..sources.shared import shared_path
from .adapters import CUES, TALK, cues, read, talk
from .registry import query


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with text on one line, as cues."""
    t = talk(spark, sf_dir).where("trim(text) <> ''")
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return t.select("section_id", "pos", "start", "end", flat.alias("source_text"), F.lit("").alias("translation"), F.lit("lyric").alias("role"))


_FLAT = """flat AS (SELECT section_id, pos, start, "end", trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY section_id ORDER BY pos) - 1 AS n FROM talk WHERE trim(text) <> '')"""
_MS = "round_even({0} * 1000, 0) / 1000.0"
_CS = "round_even({0} * 100, 0) / 100.0"


@query(f"""WITH {TALK}, {_FLAT} SELECT section_id, string_agg((n + 1) || chr(10) || {{0}} || ' --> ' || {{1}} || chr(10) || t || chr(10), chr(10) ORDER BY pos) AS text FROM flat GROUP BY section_id""".format(*["format('{:02d}:{:02d}:{:02d},{:03d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000)".replace("ms", f'CAST(round_even({x} * 1000, 0) AS BIGINT)') for x in ("start", '"end"')]))
def k1_render_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.render_srt(_turns(spark, sf_dir), wrap=False)


@query(f"""WITH {TALK}, {_FLAT} SELECT section_id, CAST(n AS INTEGER) AS pos, {_MS.format('start')} AS start, {_MS.format('"end"')} AS "end", t AS text FROM flat""")
def s1_parse_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.parse_srt(w.render_srt(_turns(spark, sf_dir), wrap=False), keys=("section_id",))


@query(f"""WITH {TALK}, {_FLAT} SELECT section_id, CAST(n AS INTEGER) AS pos, {_CS.format('start')} AS start, {_CS.format('"end"')} AS "end", t AS text FROM flat""")
def s2_parse_ass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.parse_ass(w.render_ass(_turns(spark, sf_dir), "section_id", safe=1e9), keys=("section_id",))


_W2 = f"((length(t) + length(regexp_replace(t, '[^{TX.wide()}]+', '', 'g'))) * 56 / 2)"


def _ass_sql(seconds: str) -> str:
    cs = f"CAST(round_even({seconds} * 100, 0) AS BIGINT)"
    return f"format('{{:d}}:{{:02d}}:{{:02d}}.{{:02d}}', {cs} // 360000, {cs} // 6000 % 60, {cs} // 100 % 60, {cs} % 100)"


@query(f"""WITH {TALK}, {_FLAT}, fitted AS (SELECT section_id, start, "end", translate(t, '{{}}\\', '｛｝＼') AS t, CAST(greatest(50, least(100, floor(CAST(1760 AS DOUBLE) / {_W2} * 100))) AS INTEGER) AS scale, {_W2} > 1760 AS narrow FROM flat)
SELECT section_id, '{w.HEAD}' || string_agg('Dialogue: 0,' || {_ass_sql("start")} || ',' || {_ass_sql('"end"')} || ',Default,,0,0,0,,' || CASE WHEN narrow AND scale < 100 THEN '{{\\fscx' || scale || '}}' ELSE '' END || t, chr(10) ORDER BY start, t) || chr(10) AS text FROM fitted GROUP BY section_id""")
def k2_render_ass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.render_ass(_turns(spark, sf_dir), "section_id")


def _vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    clock = lambda x: F.replace(C.srt(F.col(x)), F.lit(","), F.lit("."))
    block = F.concat(clock("start"), F.lit(" --> "), clock("end"), F.lit(" align:start\n<c>&lt;"), "source_text", F.lit("</c>\n{\\an8}<00:00:01.000>two&amp;\n"))
    return t.withColumn("_b", block).groupBy("section_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_b"))), lambda x: x["_b"]), "\n")).alias("text"))


@query(f"""WITH {TALK}, {_FLAT} SELECT section_id, CAST(n AS INTEGER) AS pos, CAST(round_even(start * 1000, 0) AS BIGINT) AS start_ms, CAST(round_even("end" * 1000, 0) AS BIGINT) AS end_ms, '<' || t || '　two&' AS text FROM flat""")
def s3_parse_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.parse_vtt(_vtt(spark, sf_dir), keys=("section_id",))


def _lrc(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    line = F.concat(F.format_string("[%02d:%02d.%02d]", F.floor(F.col("start") / 60), F.floor("start") % 60, F.floor(F.col("start") * 100) % 100), F.when(F.col("pos") % 3 == 2, "").otherwise(F.col("source_text")))
    return t.withColumn("_l", line).groupBy("section_id").agg(F.concat(F.lit("[ar:Someone]\n[ti:Song]\nLyrics: me\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_l"))), lambda x: x["_l"]), "\n")).alias("text"))


@query(f"""WITH {TALK}, {_FLAT}, k AS (SELECT section_id, pos, t, CAST(floor(start / 60) AS BIGINT) * 60000 + CAST(floor(start) AS BIGINT) % 60 * 1000 + CAST(floor(start * 100) AS BIGINT) % 100 * 10 AS ms FROM flat WHERE pos % 3 <> 2)
SELECT section_id, CAST(row_number() OVER (PARTITION BY section_id ORDER BY pos) - 1 AS INTEGER) AS pos, ms, t AS text FROM k""")
def s4_parse_lrc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.parse_lrc(_lrc(spark, sf_dir), keys=("section_id",))


@query(f"""WITH {TALK}, {_FLAT} SELECT section_id, CAST(row_number() OVER (PARTITION BY section_id ORDER BY pos) AS INTEGER) AS line, t AS text FROM flat WHERE pos % 3 <> 2 AND NOT (t LIKE '[%')""")
def s5_parse_lyric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.parse_lyric_lines(_lrc(spark, sf_dir), keys=("section_id",))


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as JSON, one in three as a bare list, one as utterances."""
    t = _turns(spark, sf_dir)
    word = F.array(F.struct(F.col("start"), (F.col("start") + 0.1).alias("end"), F.lit("w").alias("text"), F.lit(0.5).alias("probability")))
    seg = F.struct("start", F.when(F.col("pos") % 5 == 4, F.col("start")).otherwise(F.col("end")).alias("end"), F.col("source_text").alias("text"), word.alias("words"))
    g = t.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("pos", seg.alias("s")))).alias("l")).select("section_id", F.transform("l", lambda x: x["s"]).alias("l"))
    k = F.pmod("section_id", F.lit(3))
    text = F.when(k == 0, F.to_json(F.struct(F.col("l").alias("segments")))).when(k == 1, F.to_json("l")).otherwise(F.to_json(F.struct(F.col("l").alias("utterances"))))
    return g.select("section_id", text.alias("text"))


@query(f"""WITH {TALK}, {_FLAT} SELECT section_id, CAST(row_number() OVER (PARTITION BY section_id ORDER BY start, "end", t) - 1 AS INTEGER) AS seg, start, "end", t AS text, CAST(1 AS INTEGER) AS n_words FROM flat WHERE pos % 5 <> 4 AND start < "end" """)
def s6_parse_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.parse_transcripts(_transcripts(spark, sf_dir), keys=("section_id",)).select("section_id", "seg", "start", "end", "text", F.size("words").alias("n_words"))


@query(f"""WITH {TALK}, {_FLAT} SELECT section_id, CAST(n AS INTEGER) AS pos, start, "end", t AS source_text, CASE WHEN pos % 2 = 0 THEN 'speech' END AS role FROM flat""")
def s7_parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    event = F.struct("start", "end", F.when(F.col("pos") % 2 == 0, F.col("source_text")).alias("source_text"), F.when(F.col("pos") % 2 == 1, F.col("source_text")).alias("text"), F.when(F.col("pos") % 2 == 0, "speech").alias("role"))
    g = t.groupBy("section_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", event.alias("e")))), lambda x: x["e"]).alias("l"))
    files = g.select("section_id", F.when(F.pmod("section_id", F.lit(2)) == 0, F.to_json("l")).otherwise(F.to_json(F.struct(F.col("l").alias("events")))).alias("text"))
    return r.parse_events(files, ("section_id",)).select("section_id", "pos", "start", "end", "source_text", "role")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS concert_id, CAST(o_orderkey AS VARCHAR) AS section_id, o_orderpriority AS title, o_totalprice AS "end" FROM orders WHERE o_custkey % 4 <> 0""")
def s8_parse_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    s = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("end"))
    g = o.groupBy("o_custkey").agg(F.collect_list(s).alias("sections"))
    version = F.when(F.col("o_custkey") % 4 == 0, "9").otherwise(r.VERSION)
    files = g.select(F.col("o_custkey").cast("string").alias("path"), F.to_json(F.struct(version.alias("schema_version"), F.col("o_custkey").cast("string").alias("concert_id"), "sections")).alias("text"))
    return r.parse_manifests(files)[1].select("concert_id", "section_id", "title", "end")


@query("""SELECT l_orderkey AS track_id, CAST(l_partkey * 1000 AS BIGINT) / 10000000 AS start, CAST(l_partkey * 1000 + 500 AS BIGINT) / 10000000 AS "end", CASE WHEN l_returnflag = 'A' THEN 'AP' ELSE 'a' END AS phone, l_returnflag = 'A' AS silence FROM lineitem""")
def s10_parse_phone_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    line = F.concat_ws(" ", (F.col("l_partkey") * 1000).cast("string"), (F.col("l_partkey") * 1000 + 500).cast("string"), F.when(F.col("l_returnflag") == "A", "AP").otherwise("a"))
    files = li.groupBy(F.col("l_orderkey").alias("track_id")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return r.parse_phone_labels(files, ("track_id",)).select("track_id", "start", "end", "phone", "silence")


@query()
def s11_file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the documents table."""
    files = r.file_inventory(spark, f"{sf_dir}/documents.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", "sha256")


@query("""SELECT * FROM (SELECT l_returnflag AS style, CAST(l_orderkey AS BIGINT) AS n FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT o_orderstatus, o_orderkey FROM orders UNION ALL SELECT 'R', o_orderkey FROM orders)""")
def u1_merge_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_returnflag").alias("style"), F.col("l_orderkey").alias("n"))
    o = read(spark, sf_dir, "orders")
    over = o.select(F.col("o_orderstatus").alias("style"), F.col("o_orderkey").alias("n")).unionByName(o.select(F.lit("R").alias("style"), F.col("o_orderkey").alias("n"))).unionByName(o.select(F.lit("A").alias("style"), F.col("o_orderkey").alias("n")))
    return w.merge_overlay(c, over)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues in pairs are parts of a structure table: verse and chorus by turns, four cues a cycle."""
    c = cues(spark, sf_dir)
    p = c.select(F.col("section_id").alias("track_id"), F.floor(F.col("pos") / 2).cast("int").alias("n"), "pos")
    g = p.groupBy("track_id", "n").agg((F.min("pos") + 1).alias("first"), (F.max("pos") + 1).alias("last"))
    k = F.col("track_id") % 6
    return g.select("track_id", "n", F.floor(F.col("n") / 2).cast("string").alias("cycle"), F.when(F.col("n") % 2 == 0, "A").otherwise("B").alias("part"), F.when(F.col("n") % 2 == 0, "verse").otherwise("chorus").alias("role"), F.when((k == 1) & (F.col("n") == 1), F.col("first") + 1).otherwise(F.col("first")).alias("first"), "last", (F.col("n") * 8.0).alias("start"), (F.col("n") * 8.0 + F.when(k == 2, 9.0).otherwise(8.0)).alias("end"), (~((k == 3) & (F.col("n") == 0))).alias("complete"), F.when(k == 4, "").otherwise("heard").alias("evidence"), (F.lit(8) + k * 4).cast("int").alias("beats"))


_PARTS = f"""{CUES}, p AS (SELECT section_id AS track_id, CAST(floor(pos / 2) AS INTEGER) AS n, min(pos) + 1 AS f, max(pos) + 1 AS last FROM cues GROUP BY ALL),
parts AS (SELECT track_id, n, CAST(CAST(floor(n / 2) AS BIGINT) AS VARCHAR) AS cycle, CASE WHEN n % 2 = 0 THEN 'A' ELSE 'B' END AS part, CASE WHEN n % 2 = 0 THEN 'verse' ELSE 'chorus' END AS role, CASE WHEN track_id % 6 = 1 AND n = 1 THEN f + 1 ELSE f END AS first, last, n * CAST(8.0 AS DOUBLE) AS start, n * CAST(8.0 AS DOUBLE) + CASE WHEN track_id % 6 = 2 THEN 9 ELSE 8 END AS "end", NOT (track_id % 6 = 3 AND n = 0) AS complete, CASE WHEN track_id % 6 = 4 THEN '' ELSE 'heard' END AS evidence FROM p)"""


def _durations(parts: DataFrame) -> DataFrame:
    return parts.groupBy("track_id").agg((F.max("n") * 8.0 + 8.0).alias("duration"))


@query(f"""WITH {_PARTS}, d AS (SELECT track_id, max(n) * CAST(8.0 AS DOUBLE) + 8.0 AS duration FROM parts GROUP BY track_id), j AS (SELECT *, lag(last) OVER w AS pl, lag("end") OVER w AS pe FROM parts JOIN d USING (track_id) WINDOW w AS (PARTITION BY track_id ORDER BY start, first, cycle, part))
SELECT track_id, cycle, part, 'line_range' AS code FROM j WHERE first > last OR first <= pl UNION ALL SELECT track_id, cycle, part, 'time_order' FROM j WHERE "end" > duration + 0.001 OR start < pe - 0.001 UNION ALL SELECT track_id, cycle, part, 'no_evidence' FROM j WHERE evidence = '' """)
def g31_structure_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    return st.structure_errors(p, _durations(p))


@query(f"""WITH {_PARTS}, d AS (SELECT track_id, max(n) * CAST(8.0 AS DOUBLE) + 8.0 AS duration FROM parts GROUP BY track_id), f AS (SELECT *, coalesce(first <> lag(last) OVER (PARTITION BY track_id, cycle ORDER BY n) + 1, FALSE) AS gap FROM parts),
g AS (SELECT track_id, cycle, arg_min(role, n) AS a, arg_max(role, n) AS b, bool_and(complete) AS c, bool_or(gap) AS g, arg_min(start, n) AS s, arg_max("end", n) AS e FROM f GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY cycle) AS k FROM g WHERE a = 'verse' AND b = 'chorus' AND c AND NOT g AND cycle IN ('0', '1'))
SELECT track_id, cycle, greatest(0.0, s - 3.0) AS window_start, least(duration, e + 3.0) AS window_end FROM k JOIN d USING (track_id) WHERE k = 1""")
def w16_choose_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    return st.choose_cycle(p, _durations(p))


def _onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as onsets of recordings of 64 order numbers: hundredths of a second and strengths."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.floor(F.col("l_orderkey") / 64).alias("track_id"), (F.col("l_partkey") % 3200).cast("long").alias("i")).agg(F.max(F.col("l_quantity") * F.col("l_quantity")).alias("value"))


@query(f"""WITH {_PARTS}, o AS (SELECT l_orderkey // 64 AS track_id, CAST(l_partkey % 3200 AS BIGINT) AS i, max(l_quantity * l_quantity) AS v FROM lineitem GROUP BY ALL),
q AS (SELECT track_id // 64 AS track_id, track_id || ':' || cycle || part AS part, start, "end", CAST(8 + track_id % 6 * 4 AS INTEGER) AS beats FROM parts), b AS (SELECT *, unnest(range(4, beats, 4)) AS beat FROM q),
x AS (SELECT *, start + ("end" - start) / beats * beat AS expected, least(0.25, ("end" - start) / beats * CAST(0.35 AS DOUBLE)) AS radius FROM b),
n AS (SELECT x.track_id, part, x.beat, max(v) AS peak, avg(v) AS mean, arg_max(i, row(v, -i)) AS best FROM x JOIN o ON o.track_id = x.track_id AND i BETWEEN greatest(0, ceil((expected - radius) * 100)) AND floor((expected + radius) * 100) GROUP BY ALL)
SELECT x.track_id, x.part, CAST(x.beat AS INTEGER) AS beat, CASE WHEN peak > greatest(0.000001, 2.5 * mean) THEN best / 100.0 ELSE expected END AS time, coalesce(peak > greatest(0.000001, 2.5 * mean), FALSE) AS supported FROM x LEFT JOIN n USING (track_id, part, beat)
UNION ALL SELECT track_id, part, 0, start, FALSE FROM q UNION ALL SELECT track_id, part, beats, "end", FALSE FROM q""")
def w15_beat_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir).withColumn("part", F.concat(F.col("track_id").cast("string"), F.lit(":"), "cycle", "part")).withColumn("track_id", F.floor(F.col("track_id") / 64))
    return st.beat_anchors(p.select("track_id", "part", "start", "end", "beats"), _onsets(spark, sf_dir))


@query("""SELECT o_custkey AS section_id, count(*) FILTER (o_orderstatus = 'F') AS reference, count(*) FILTER (o_orderstatus = 'O') AS mapped, count(*) FILTER (o_orderstatus = 'P') AS local_review FROM orders GROUP BY o_custkey""")
def a17_usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return st.usage_counts(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("section_id"), F.when(s == "F", "reference").when(s == "O", "mapped").otherwise("local_review").alias("status")), ["section_id"])


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return e.select(F.col("vec_id").alias("track_id"), F.col("embedding").cast("array<double>").alias("samples"), "label")


@query("""WITH s AS (SELECT vec_id AS track_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s, len(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
m AS (SELECT track_id, sqrt(list_reduce(list_transform(s, lambda x: x * x), lambda a, b: a + b) / n) AS rms, len(list_filter(s, lambda x: abs(x) < 0.002)) / n AS silent_ratio, len(list_filter(s, lambda x: abs(x) >= 0.999)) / n AS clip_ratio FROM s)
SELECT *, least(1.0, rms / CAST(0.08 AS DOUBLE)) * (1 - silent_ratio) * (1 - clip_ratio) AS score FROM m""")
def a13_audio_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.audio_stability(_samples(spark, sf_dir))


@query("""WITH s AS (SELECT vec_id AS track_id, list_transform(embedding, lambda x: CAST(abs(x) AS DOUBLE)) AS s, len(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL), c AS (SELECT track_id, s, n, unnest(range(10)) AS k FROM s),
p AS (SELECT track_id, CAST(k AS INTEGER) AS k, coalesce(list_max(s[CAST(round_even(k * n / 10, 0) AS INTEGER) + 1 : CAST(round_even((k + 1) * n / 10, 0) AS INTEGER)]), 0.0) AS p FROM c)
SELECT track_id, k, CASE WHEN max(p) OVER (PARTITION BY track_id) > 0 THEN floor(p / max(p) OVER (PARTITION BY track_id) * 10000 + 0.5) / 10000 ELSE 0.0 END AS peak FROM p""")
def a14_waveform_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.waveform_peaks(_samples(spark, sf_dir), 10)


@query("""WITH o AS (SELECT l_orderkey AS group_id, l_linenumber AS occurrence, CAST(0.35 AS DOUBLE) * l_discount + CAST(0.30 AS DOUBLE) * l_tax + CAST(0.20 AS DOUBLE) * (l_quantity / 50) + CAST(0.10 AS DOUBLE) * 1.0 + CAST(0.05 AS DOUBLE) * 0.5 AS score FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, occurrence) AS k FROM o)
SELECT group_id, occurrence, score FROM r WHERE k = 1""")
def a15_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("occurrence"), F.col("l_discount").alias("asr"), F.col("l_tax").alias("peer"), (F.col("l_quantity") / 50).alias("stability"), F.lit(1.0).alias("clean"), F.lit(0.5).alias("boundary"))
    return signal.representative(o).select("group_id", "occurrence", "score")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten vectors of neighbouring numbers, one after another, as one recording."""
    s = _samples(spark, sf_dir)
    g = s.groupBy(F.floor(F.col("track_id") / 10).alias("track_id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("track_id", "samples"))), lambda x: x["samples"])).alias("samples"))
    return g


_ENVELOPE = """WITH v AS (SELECT vec_id // 10 AS track_id, flatten(list(list_transform(embedding, lambda x: CAST(x AS DOUBLE)) ORDER BY vec_id)) AS s FROM embeddings WHERE embedding IS NOT NULL GROUP BY ALL),
f AS (SELECT track_id, s, unnest(range(0, (len(s) - 40) // 8 + 1)) AS k FROM v WHERE len(s) >= 40), r AS (SELECT track_id, k, sqrt(list_sum(list_transform(s[k * 8 + 1 : k * 8 + 40], lambda x: x * x)) / 40) AS rms FROM f),
d AS (SELECT track_id, k, greatest(0, rms - coalesce(lag(rms) OVER (PARTITION BY track_id ORDER BY k), rms)) AS d, count(*) OVER (PARTITION BY track_id) AS n FROM r),
o AS (SELECT track_id, k, CASE WHEN n < 3 THEN d ELSE (d + coalesce(lag(d) OVER w, 0) + coalesce(lead(d) OVER w, 0)) / 3 END AS o FROM d WINDOW w AS (PARTITION BY track_id ORDER BY k))"""
_ROUND6 = "floor(({0}) * 1000000 + 0.5) / 1000000"


@query(f"""{_ENVELOPE} SELECT track_id, CAST(k AS INTEGER) AS k, {_ROUND6.format("CASE WHEN max(o) OVER (PARTITION BY track_id) > 0 THEN o / max(o) OVER (PARTITION BY track_id) ELSE o END")} AS onset FROM o""")
def d1_onset_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each recording as one row."""
    out = _long(spark, sf_dir).select("track_id", F.posexplode(signal.onset_envelope(F.col("samples"), 40, 8)).alias("k", "onset"))
    return out.withColumn("onset", F.floor(F.col("onset") * 1000000 + 0.5) / 1000000)


@query(f"""{_ENVELOPE} SELECT track_id, CAST(k AS INTEGER) AS k, {_ROUND6.format("CASE WHEN max(o) OVER (PARTITION BY track_id) > 0 THEN o / max(o) OVER (PARTITION BY track_id) ELSE o END")} AS onset FROM o""")
def d1_long_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of recordings in rows of 128 samples, two vectors each."""
    s = _samples(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("track").orderBy("track_id")) - 1
    each = s.withColumn("track", F.floor(F.col("track_id") / 10)).withColumn("n", n)
    rows = each.groupBy(F.col("track").alias("track_id"), F.floor(F.col("n") / 2).alias("chunk")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "samples"))), lambda x: x["samples"])).alias("samples"))
    out = signal.long_envelope(rows, 40, 8).select("track_id", "chunk", F.posexplode("onsets").alias("i", "onset"))
    return out.select("track_id", (F.col("chunk") * 16 + F.col("i")).cast("int").alias("k"), (F.floor(F.col("onset") * 1000000 + 0.5) / 1000000).alias("onset"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x, len(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.x AS x, b.x AS y, a.n, unnest(range(-8, 9)) AS lag FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
i AS (SELECT a, b, lag, x, y, unnest(range(greatest(0, -lag), n - greatest(0, lag))) AS i FROM p),
c AS (SELECT a, b, lag, coalesce(corr(x[i + 1], y[i + lag + 1]), 0) AS c FROM i GROUP BY a, b, lag)
SELECT a, b, floor(least(1, greatest(0, max(c))) * 1000000 + 0.5) / 1000000 AS correlation, CAST(arg_max(lag, c) AS INTEGER) AS lag FROM c GROUP BY a, b""")
def d2_lag_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    pair = s.select(F.col("track_id").alias("a"), F.col("samples").alias("x"), (F.col("track_id") + 1).alias("b")).join(s.select(F.col("track_id").alias("b"), F.col("samples").alias("y")), "b")
    out = pair.select("a", "b", signal.lag_correlation(F.col("x"), F.col("y"), 8).alias("m")).select("a", "b", "m.*")
    return out.withColumn("correlation", F.floor(F.col("correlation") * 1000000 + 0.5) / 1000000)


@query()
def d3_rhythm_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir).select("track_id", signal.rhythm_signature(F.col("samples")).alias("signature"))


@query()
def d4_rhythm_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _long(spark, sf_dir).select("track_id", F.transform("samples", lambda x: F.abs(x)).alias("onsets"))
    return signal.rhythm_hypotheses(t.withColumn("seconds", F.size("onsets") / 100.0))


@query()
def d5_rhythm_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir).where("label IS NOT NULL")
    first = F.min("track_id").over(Window.partitionBy("label"))
    o = s.select(F.col("label").alias("group_id"), F.col("track_id").alias("occurrence"), F.transform("samples", lambda x: F.abs(x)).alias("onsets"), (F.lit(10.0) + F.col("track_id") % 7 / 10.0).alias("duration"), F.when(F.col("track_id") % 5 == 0, F.array(F.lit("speech"))).otherwise(F.array().cast("array<string>")).alias("risks"), (F.col("track_id") == first).alias("representative"))
    return signal.rhythm_mapping(o)


def _speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two short prefixes before each turn."""
    t = talk(spark, sf_dir).where("trim(text) <> ''").withColumn("_k", F.explode(F.array(*map(F.lit, range(3))))).withColumn("pos", F.col("pos") * 3 + F.col("_k"))
    short = F.when(F.col("pos") % 3 < 2, "それで").otherwise(F.col("text"))
    speaker = F.when(F.col("pos") % 4 == 3, F.array(F.lit("b"))).otherwise(F.array(F.lit("a")))
    return t.select("section_id", "pos", (F.col("pos") * 1.5).alias("start"), (F.col("pos") * 1.5 + 1.2).alias("end"), short.alias("source_text"), F.lit("短い").alias("translation"), speaker.alias("speakers"), F.array().cast("array<string>").alias("evidence"))


@query(f"""WITH {TALK}, each AS (SELECT section_id, CAST(pos * 3 + k AS INTEGER) AS pos, text FROM talk, range(3) r(k) WHERE trim(text) <> ''), s AS (SELECT section_id, pos, CAST(pos * 1.5 AS DOUBLE) AS start, CAST(pos * 1.5 AS DOUBLE) + CAST(1.2 AS DOUBLE) AS "end", CASE WHEN pos % 3 < 2 THEN 'それで' ELSE text END AS t, CASE WHEN pos % 4 = 3 THEN 'b' ELSE 'a' END AS sp FROM each),
f AS (SELECT *, coalesce(pos % 3 < 2 AND lead(start) OVER w - "end" BETWEEN -0.001 AND 0.8 AND lead(sp) OVER w = sp, FALSE) AS can, lead(t) OVER w AS nt, lead("end") OVER w AS ne, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY section_id ORDER BY pos)),
c AS (SELECT *, i - sum(CAST(can AS INTEGER)) OVER (PARTITION BY section_id ORDER BY pos) AS ch FROM f), o AS (SELECT *, can AND row_number() OVER (PARTITION BY section_id, ch, can ORDER BY pos) % 2 = 1 AS op FROM c), l AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY section_id ORDER BY pos), FALSE) AS tail FROM o)
SELECT section_id, pos, start, CASE WHEN op THEN ne ELSE "end" END AS "end", CASE WHEN op THEN rtrim(t) || ltrim(nt) ELSE t END AS source_text, CASE WHEN op THEN '短い短い' ELSE '短い' END AS translation, op AS merged FROM l WHERE NOT tail""")
def w8_merge_short_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reflow.merge_short_prefixes(_speech(spark, sf_dir))


def _spoken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns as cues, and transcript segments: a turn's words by eights, at even steps of its time. Every second
    turn's translation has commas in place of its full stops."""
    t = talk(spark, sf_dir).where("trim(text) <> ''").withColumn("w", F.split(F.trim("text"), "\\s+"))
    c = t.select("section_id", "pos", "start", "end", F.col("text").alias("source_text"), F.when(F.col("pos") % 2 == 1, F.translate("text", ".", ",")).otherwise(F.col("text")).alias("translation"))
    step = (F.col("end") - F.col("start")) / F.size("w")
    word = F.struct((F.col("start") + step * F.col("k")).alias("start"), (F.col("start") + step * (F.col("k") + 1)).alias("end"), F.col("text").alias("text"))
    each = t.select("section_id", "pos", "start", "end", "w", F.posexplode("w").alias("k", "text")).select("section_id", "pos", F.floor(F.col("k") / 8).alias("g"), "k", word.alias("word"))
    g = each.groupBy("section_id", "pos", "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("words"))
    return c, g.select("section_id", F.get("words", F.lit(0))["start"].alias("start"), F.element_at("words", -1)["end"].alias("end"), F.array_join(F.transform("words", lambda x: x["text"]), " ").alias("text"), "words")


@query()
def w9_split_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reflow.split_events(*_spoken(spark, sf_dir))


def _sentences(text: str) -> str:
    bare = f"regexp_replace({text}, '^[{TX.SPACE}]+|[{TX.SPACE}]+$', '', 'g')"
    closers = TX.CLOSERS.replace("'", "''")
    return f"(length({bare}) - length(regexp_replace({bare}, '[{TX.STRONG}]', '', 'g')) - CAST(regexp_matches({bare}, '[{TX.STRONG}][{closers}]*$') AS INTEGER) + 1)"


@query(f"""WITH {TALK}, c AS (SELECT section_id, pos, "end" - start AS seconds, text, CASE WHEN pos % 2 = 1 THEN translate(text, '.', ',') ELSE text END AS translation, len(regexp_split_to_array(trim(text), '\\s+')) AS w FROM talk WHERE trim(text) <> ''),
n AS (SELECT *, {_sentences("text")} AS a, {_sentences("translation")} AS b FROM c), k AS (SELECT *, CASE WHEN a = b AND a > 1 THEN a WHEN w > 8 AND least(a, b) = 1 AND greatest(a, b) = 2 THEN 2 ELSE 1 END AS told FROM n)
SELECT section_id, pos, CAST(greatest(1, least(told, greatest(1, floor(seconds / CAST(0.45 AS DOUBLE))), 6)) AS INTEGER) AS parts FROM k""")
def w9_part_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reflow.split_events(*_spoken(spark, sf_dir)).groupBy("section_id", "pos").agg(F.count("*").cast("int").alias("parts"))


@query()
def a16_reflow_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, heard = _spoken(spark, sf_dir)
    c = c.withColumns({"speakers": F.array(F.lit("a")), "evidence": F.array().cast("array<string>")})
    return reflow.reflow_metrics(c, reflow.split_events(reflow.merge_short_prefixes(c), heard))


@query(f"""WITH {TALK}, {_FLAT} SELECT section_id, pos, CASE WHEN pos % 2 = 0 THEN 'ann,bob' ELSE 'bob' END AS speakers FROM flat""")
def u4_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    own = t.select("section_id", "pos", F.when(F.col("pos") % 2 == 0, " ann ").otherwise("").alias("speaker"))
    return reflow.speakers(own, t.select("section_id", "pos", F.lit("bob").alias("speaker"))).select("section_id", "pos", F.array_join("speakers", ",").alias("speakers"))


def _bare_sql(text: str) -> str:
    return f"regexp_replace(replace(regexp_replace({text}, '{TX.TAG}', '', 'g'), '\\N', ' '), '[{TX.SPACE}]+', '', 'g')"


@query(f"""WITH {TALK}, {_FLAT}, l AS (SELECT section_id, {_bare_sql("t")} AS t, row_number() OVER (PARTITION BY section_id ORDER BY pos) AS line FROM flat),
c AS (SELECT section_id, {_bare_sql("CASE WHEN section_id % 7 = 0 AND pos = 1 THEN 'x' ELSE t END")} AS c, row_number() OVER (PARTITION BY section_id ORDER BY pos) AS line FROM flat WHERE section_id % 5 <> 0 OR pos <> 2),
n AS (SELECT section_id, count(*) FILTER (c <> t) AS changed, count(*) - count(c) AS lost FROM l LEFT JOIN c USING (section_id, line) GROUP BY section_id)
SELECT section_id, 'lyrics_text_or_order_changed' AS code, changed AS n FROM n WHERE changed > 0 UNION ALL SELECT section_id, 'lyrics_event_count_mismatch', lost FROM n WHERE lost > 0""")
def g14_lyric_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("section_id").orderBy("pos"))
    lines = t.select("section_id", n.cast("long").alias("line"), F.col("source_text").alias("text"))
    c = t.where("section_id % 5 <> 0 OR pos <> 2").select("section_id", "pos", F.when((F.col("section_id") % 7 == 0) & (F.col("pos") == 1), "x").otherwise(F.col("source_text")).alias("source_text"), F.lit(None).cast("string").alias("canonical_source_text"), F.lit(None).cast("array<bigint>").alias("lyric_line_span"))
    return align.lyric_cover(c, lines)


def _official(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns of a conversation as lyrics, whose even lines come again at the end; every seventh is missing in the
    official cues, every fifth joined to the next."""
    t = _turns(spark, sf_dir).select(F.col("section_id").alias("track_id"), F.col("pos").cast("long").alias("line"), F.col("source_text").alias("text"))
    last = Window.partitionBy("track_id")
    t = t.withColumn("_all", F.max("line").over(last) + 1)
    again = t.where("line % 2 = 0").select("track_id", (F.col("line") + F.col("_all")).alias("line"), "text")
    ly = t.drop("_all").unionByName(again).select("track_id", "line", "text", (F.col("line") * 4000).cast("long").alias("ms"), F.concat(F.lit("t"), F.col("line").cast("string")).alias("translation"))
    nxt = F.lead("text").over(Window.partitionBy("track_id").orderBy("line"))
    of = ly.withColumn("_n", nxt).where("line % 7 <> 6").select("track_id", "line", F.when((F.col("line") % 5 == 0) & F.col("_n").isNotNull(), F.concat("text", "_n")).otherwise(F.col("text")).alias("text"), (F.col("ms") + F.when(F.col("line") % 4 == 1, 900).otherwise(100)).alias("start_ms"))
    return of, ly


@query()
def j20_align_lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    of, ly = _official(spark, sf_dir)
    return align.align_lyrics(of, ly)


@query()
def j21_reference_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    of, ly = _official(spark, sf_dir)
    return align.reference_translation(align.align_lyrics(of, ly), of, ly)


@query()
def j22_propose_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against all their words, a third of a second each, half a second late and begun anew at each turn."""
    t = _turns(spark, sf_dir).withColumn("n", F.size(F.split("source_text", " ")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("section_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * 0.33
    t = t.select("section_id", "pos", before.alias("start"), (before + F.col("n") * 0.33).alias("end"), F.col("source_text").alias("text"))
    ws = t.select("section_id", "start", F.posexplode(F.split("text", " ")).alias("k", "text")).select("section_id", (F.col("start") + 0.5 + F.col("k") * 0.33).alias("start"), (F.col("start") + 0.8 + F.col("k") * 0.33).alias("end"), "text", (1 - F.col("k") % 5 / 10).alias("probability"))
    return align.propose_boundaries(t, ws)


def _files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Turns written as files of this kind and read again, through the data source."""
    t = _turns(spark, sf_dir).select(F.col("section_id").alias("name"), "pos", "start", "end", F.col("source_text").alias("text"))
    path = shared_path(spark, f"files-{kind}")
    ds.write_subtitles(t, path, kind)
    return ds.read_subtitles(spark, path, kind).select(F.col("name").cast("long").alias("section_id"), "pos", "start", "end", "text")


@query(f"""WITH {TALK}, {_FLAT} SELECT section_id, CAST(n AS INTEGER) AS pos, {_MS.format('start')} AS start, {_MS.format('"end"')} AS "end", t AS text FROM flat""")
def k1_srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, "srt")


@query(f"""WITH {TALK}, {_FLAT} SELECT section_id, CAST(n AS INTEGER) AS pos, {_CS.format('start')} AS start, {_CS.format('"end"')} AS "end", t AS text FROM flat""")
def k2_ass_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, "ass")


@query(f"""WITH {TALK}, {_FLAT} SELECT section_id, CAST(n AS INTEGER) AS pos, {_MS.format('start')} AS start, {_MS.format('"end"')} AS "end", t AS text FROM flat""")
def s3_vtt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, "vtt")


@query(f"""WITH {TALK}, {_FLAT} SELECT section_id, CAST(n AS INTEGER) AS pos, {_CS.format('start')} AS start, CAST(NULL AS DOUBLE) AS "end", t AS text FROM flat""")
def s4_lrc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, "lrc")


@query("""SELECT o_orderkey AS track_id, o_totalprice AS seconds, o_orderpriority AS title FROM orders""")
def s9_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("track_id"), F.col("o_totalprice").alias("seconds"), F.col("o_orderpriority").alias("title"))
    path = shared_path(spark, "tsv")
    w.write_tsv(o, path)
    return r.read_tsv(spark, path, "track_id bigint, seconds double, title string")


@query(f"""WITH {CUES} SELECT o_custkey % 40 AS concert_id, section_id, pos, start, "end", role FROM cues JOIN orders ON o_orderkey = section_id""")
def k3_by_concert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section_id"), (F.col("o_custkey") % 40).alias("concert_id"))
    c = cues(spark, sf_dir).join(o, "section_id").select("concert_id", "section_id", "pos", "start", "end", "role")
    path = shared_path(spark, "by-concert")
    w.write_by_concert(c, path)
    return spark.read.parquet(path).withColumn("concert_id", F.col("concert_id").cast("long"))


@query(f"""WITH {TALK}, c AS (SELECT section_id, pos, start, "end", pos % 3 = 0 OR pos % 5 = 1 AS heard FROM talk), d AS (SELECT section_id, max("end") + 2.0 AS duration FROM c GROUP BY section_id),
o AS (SELECT section_id, CAST(pos // 3 AS INTEGER) AS occurrence, arg_min(start, pos) AS start, arg_max("end", pos) AS "end", round_even(avg(CAST(heard AS INTEGER)), 6) AS evidence_coverage FROM c GROUP BY ALL)
SELECT section_id, occurrence, start, "end", evidence_coverage, round_even(least(1.0, least(start, greatest(0.0, duration - "end")) / greatest(1.0, duration / 2)), 6) AS boundary_score FROM o JOIN d USING (section_id)""")
def a15_occurrence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in blocks of three as occurrences."""
    p = F.col("pos")
    evidence = F.when(p % 3 == 0, F.array(F.lit("Word_timing"))).when(p % 5 == 1, F.array(F.lit("by ear"), F.lit("VOCAL stem"))).otherwise(F.array(F.lit("by ear")))
    c = talk(spark, sf_dir).select("section_id", "pos", "start", "end", evidence.alias("evidence"))
    blocks = c.groupBy("section_id", F.floor(p / 3).cast("int").alias("occurrence")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return signal.occurrence_quality(c, blocks, c.groupBy("section_id").agg((F.max("end") + 2.0).alias("duration")))
