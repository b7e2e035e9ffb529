"""Queries on scores, lyric choice and repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, lyrics as ly, metrics as m, repetition as rep
from .adapters import CUES, LINES, ROUND3, TALK, cues, lines, read, sections, talk
from .registry import query


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pairs of a part: quantities and discounts as counts and errors."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("track_id"), (F.col("l_quantity").cast("long") % 3 + 1).alias("n_hyp"), (F.col("l_quantity").cast("long") % 2 + 1).alias("n_ref"), (F.col("l_discount") * 10 - 0.5).alias("start_error"), (F.col("l_tax") * 10 - F.col("l_discount") * 5).alias("end_error"))


_PAIRS = """pairs AS (SELECT l_suppkey AS track_id, CAST(l_quantity AS BIGINT) % 3 + 1 AS n_hyp, CAST(l_quantity AS BIGINT) % 2 + 1 AS n_ref, l_discount * 10 - CAST(0.5 AS DOUBLE) AS start_error, l_tax * 10 - l_discount * 5 AS end_error FROM lineitem)"""


@query(f"""WITH {_PAIRS} SELECT track_id, count(*) AS count, {ROUND3.format('quantile_disc(abs(start_error), 0.5)')} AS median, {ROUND3.format('quantile_disc(abs(start_error), 0.9)')} AS p90, {ROUND3.format('max(abs(start_error))')} AS maximum, {ROUND3.format('quantile_disc(start_error, 0.5)')} AS signed_median FROM pairs GROUP BY track_id""")
def a1_error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.error_stats(_pairs(spark, sf_dir), ["track_id"], "start_error")


@query(f"""WITH {_PAIRS}, e AS (SELECT track_id, sum(n_hyp) + 10 AS hypothesis, sum(n_ref) AS reference FROM pairs GROUP BY track_id),
p AS (SELECT *, abs(start_error) < CAST(1.0 AS DOUBLE) / 30 AS small, abs(start_error) AS x FROM pairs)
SELECT track_id, any_value(hypothesis) AS hypothesis, any_value(reference) AS reference, count(*) FILTER (NOT small) AS matched_pairs, count(*) FILTER (NOT small AND n_hyp = 1 AND n_ref > 1) AS split_pairs, count(*) FILTER (NOT small AND n_hyp > 1 AND n_ref = 1) AS merge_pairs,
  count(*) FILTER (NOT small AND x <= 0.20) AS near, count(*) FILTER (NOT small AND x > 0.20 AND x <= 0.75) AS middle, count(*) FILTER (NOT small AND x > 0.75) AS far, CAST(sum(n_hyp) AS BIGINT) / any_value(hypothesis) AS coverage FROM p JOIN e USING (track_id) GROUP BY track_id""", hypothesis="BIGINT", reference="BIGINT")
def a2_timing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    e = p.groupBy("track_id").agg((F.sum("n_hyp") + 10).alias("hypothesis"), F.sum("n_ref").alias("reference"))
    return m.timing_metrics(p, e, ["track_id"], 30.0)


_SHARES = ", ".join(f"avg(CASE WHEN abs({e}_error) <= {t} THEN 1 ELSE 0 END) AS {e}_{int(t * 100)}" for e in ("start", "end") for t in (0.25, 0.5, 0.75))


@query(f"WITH {_PAIRS} SELECT track_id, {_SHARES} FROM pairs GROUP BY track_id")
def a3_coverage_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.coverage_by_threshold(_pairs(spark, sf_dir), ["track_id"])


def _two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns, and the same words cut into sentences, as two subtitle sets of a conversation."""
    t = talk(spark, sf_dir).select("section_id", "pos", "text", "start", "end")
    s = t.select("section_id", F.posexplode(F.split("text", r"\. ")).alias("k", "text"), F.col("pos").alias("p"), F.col("start").alias("s"), F.col("end").alias("e"))
    n = F.count("*").over(Window.partitionBy("section_id", "p"))
    pos = F.row_number().over(Window.partitionBy("section_id").orderBy("p", "k")) - 1
    step = (F.col("e") - F.col("s")) / n
    return t, s.select("section_id", pos.cast("long").alias("pos"), "text", (F.col("s") + step * F.col("k")).alias("start"), (F.col("s") + step * (F.col("k") + 1)).alias("end"))


@query()
def a4_char_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.char_links(*_two_sides(spark, sf_dir), "section_id")


@query()
def a5_alignment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, r = _two_sides(spark, sf_dir)
    return m.alignment_groups(m.char_links(h, r, "section_id"), h, r, "section_id")


def _before_after(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = cues(spark, sf_dir).select(F.col("section_id").alias("track_id"), "pos", "start", "role")
    before = li.select("track_id", "pos", (F.col("start") % 1.0).alias("start_error"), (F.col("role") == "lyric").alias("review"))
    after = li.select("track_id", "pos", F.when(F.col("pos") % 2 == 0, (F.col("start") % 1.0) / 2 - 0.1).otherwise(F.col("start") % 1.0).alias("start_error"), ((F.col("role") == "lyric") & (F.col("pos") % 2 == 1)).alias("review"))
    return before, after


@query(f"""WITH {CUES}, j AS (SELECT section_id AS track_id, start % 1.0 AS b, CASE WHEN pos % 2 = 0 THEN (start % 1.0) / 2 - CAST(0.1 AS DOUBLE) ELSE start % 1.0 END AS a, role = 'lyric' AS rb, role = 'lyric' AND pos % 2 = 1 AS ra FROM cues),
s AS (SELECT track_id, count(*) AS cues, count(*) FILTER (a <> b) AS propagated, count(*) FILTER (a <> b AND abs(a) > abs(b) + 0.001) AS worsened, count(*) FILTER (rb) AS review_before, count(*) FILTER (ra) AS review_after FROM j GROUP BY track_id)
SELECT *, CASE WHEN review_before > 0 THEN 1 - review_after / review_before ELSE 0.0 END AS review_reduction FROM s""")
def a11_benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.benchmark_report(*_before_after(spark, sf_dir), ["track_id"])


def _songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as hits for its query: titles agree wholly, partly or not at all."""
    li = read(spark, sf_dir, "lineitem")
    k = F.col("l_partkey") % 4
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return li.select(
        F.col("l_orderkey").alias("query_id"), F.row_number().over(w).alias("hit_id"), F.lit("Blue Sky").alias("title"), F.lit("Ann").alias("artist"),
        F.when(k == 0, "blue sky").when(k == 1, "Blue Sky (Live)").when(k == 2, "Sky").otherwise("Rain").alias("hit_title"), F.when(F.col("l_suppkey") % 2 == 0, "Ann & Bob").otherwise("Eve").alias("hit_artist"),
        F.col("l_quantity").alias("popularity"), F.when(F.col("l_linenumber") % 3 == 0, "[00:01.00]a").alias("synced"), F.when(F.col("l_linenumber") % 2 == 0, "a\n\nb").otherwise("a").alias("plain"),
        F.when(F.col("l_linenumber") % 6 == 0, "t").alias("translation"), (F.col("l_returnflag") == "R").alias("instrumental"), (F.col("l_quantity").cast("long") % 5).alias("lines"), (F.col("l_discount") * 10).alias("coverage"),
    )


def _songs_sql(both: bool = False) -> str:
    score = "CASE WHEN k = 0 THEN 8 WHEN k = 1" + (" OR k = 2" if both else "") + " THEN 4 ELSE 0 END + CASE WHEN l_suppkey % 2 = 0 THEN 4 ELSE 0 END"
    return f"""songs AS (SELECT query_id, hit_id, k, {score} AS score, l_quantity AS popularity, l_linenumber % 3 = 0 AS synced, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS nplain, l_linenumber % 6 = 0 AS translated, l_returnflag = 'R' AS instrumental, CAST(l_quantity AS BIGINT) % 5 AS lines, l_discount * 10 AS coverage
  FROM (SELECT *, l_orderkey AS query_id, l_partkey % 4 AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS hit_id FROM lineitem))"""


_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, popularity DESC, hit_id) AS place FROM songs)"


@query(f"WITH {_songs_sql()}, {_RANKED} SELECT query_id, hit_id, score, place FROM ranked WHERE place <= 5", hit_id="INTEGER", place="INTEGER")
def o1_rank_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.rank_songs(_songs(spark, sf_dir)).select("query_id", "hit_id", "score", "place")


@query(f"WITH {_songs_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, synced DESC, nplain DESC, instrumental, hit_id) AS k1 FROM songs) SELECT query_id, hit_id, score FROM r WHERE k1 = 1", hit_id="INTEGER")
def o2_choose_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.choose_hit(_songs(spark, sf_dir)).select("query_id", "hit_id", "score")


@query(f"""WITH {_songs_sql(True)}, f AS (SELECT *, k = 0 AS exact FROM songs WHERE k <> 3 AND score >= 8), g AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM (SELECT *, max(CAST(exact AS INTEGER)) OVER (PARTITION BY query_id) AS anyx FROM f) WHERE exact OR anyx = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage = 1.0 DESC, coverage DESC, score DESC, lines DESC, popularity DESC, hit_id) AS k1 FROM g WHERE score >= best - 2 AND lines > 0) SELECT query_id, hit_id, score, coverage FROM r WHERE k1 = 1""", hit_id="INTEGER")
def o3_choose_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.choose_candidate(_songs(spark, sf_dir)).select("query_id", "hit_id", "score", "coverage")


@query(f"""WITH {_songs_sql()}, {_RANKED}, n AS (SELECT *, CASE WHEN synced AND translated THEN 1 WHEN synced THEN 2 END AS g FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM ranked WHERE place <= 5) WHERE score >= greatest(1, best - 2)),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g, place) AS k1 FROM n WHERE g IS NOT NULL), a AS (SELECT DISTINCT query_id, 1000 AS alt FROM songs WHERE query_id % 2 = 0)
SELECT q.query_id, coalesce(hit_id, alt) AS hit_id, CASE WHEN g = 1 THEN 'synced_translated' WHEN g = 2 THEN 'synced' WHEN alt IS NOT NULL THEN 'alternative' ELSE 'none' END AS source FROM (SELECT DISTINCT query_id FROM songs) q LEFT JOIN b ON b.query_id = q.query_id AND k1 = 1 LEFT JOIN a ON a.query_id = q.query_id""", hit_id="INTEGER")
def o4_choose_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _songs(spark, sf_dir)
    return ly.choose_source(s, s.where("query_id % 2 = 0").select("query_id", F.lit(1000).alias("hit_id")))


@query(f"""WITH {TALK}, c AS (SELECT section_id AS track_id, pos, start, "end", length(text) AS n_chars, (pos * 37) % 11 AS luma, max("end") OVER (PARTITION BY section_id) + 5.0 AS duration FROM talk),
w AS (SELECT *, count(*) OVER p AS n, row_number() OVER (PARTITION BY track_id ORDER BY pos) AS f, row_number() OVER (PARTITION BY track_id ORDER BY pos DESC) AS l, row_number() OVER (PARTITION BY track_id ORDER BY n_chars DESC, pos) AS g, row_number() OVER (PARTITION BY track_id ORDER BY luma DESC, pos) AS b, row_number() OVER (PARTITION BY track_id ORDER BY luma, pos) AS d FROM c WINDOW p AS (PARTITION BY track_id)),
x AS (SELECT *, 'early_sync' AS label FROM w WHERE f = 1 UNION ALL SELECT *, 'middle_sync' FROM w WHERE f = floor(n / 2) + 1 UNION ALL SELECT *, 'late_sync' FROM w WHERE l = 1 UNION ALL SELECT *, 'long_line' FROM w WHERE g = 1 UNION ALL SELECT *, 'bright_subtitle' FROM w WHERE b = 1 UNION ALL SELECT *, 'dark_subtitle' FROM w WHERE d = 1 UNION ALL SELECT *, 'subtitle_disappearance' FROM w WHERE l = 1)
SELECT track_id, label, pos, greatest(0.0, CASE WHEN label = 'subtitle_disappearance' THEN "end" - CAST(1.2 AS DOUBLE) ELSE (start + "end") / 2 - 1.5 END) AS window_start, least(duration, CASE WHEN label = 'subtitle_disappearance' THEN "end" + CAST(1.2 AS DOUBLE) ELSE (start + "end") / 2 + 1.5 END) AS window_end FROM x""")
def o5_review_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = talk(spark, sf_dir)
    c = t.select(F.col("section_id").alias("track_id"), "pos", "start", "end", F.length("text").alias("n_chars"), ((F.col("pos") * 37) % 11).alias("luma"))
    return ly.review_samples(c, c.groupBy("track_id").agg((F.max("end") + 5.0).alias("duration")))


def _lrc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one lyric text: lines with stamps, but for every seventh conversation's first one."""
    t = talk(spark, sf_dir).where("text <> ''")
    stamp = F.format_string("[%02d:%02d.%02d]", F.floor(F.col("start") / 60), (F.floor("start") % 60), F.floor(F.col("start") * 100) % 100)
    line = F.concat(F.when((F.col("section_id") % 7 == 0) & (F.col("pos") == 0), "").otherwise(stamp), F.regexp_replace("text", "\n", " "))
    head = F.concat(F.lit("[ar:x]\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda s: s["l"]), "\n"))
    return t.groupBy(F.col("section_id").alias("track_id")).agg(head.alias("text"))


@query(f"WITH {TALK} SELECT section_id AS track_id, CASE WHEN section_id % 7 = 0 AND min(pos) = 0 THEN 'partly_timed' ELSE 'timed' END AS status FROM talk WHERE text <> '' GROUP BY section_id")
def t24_timing_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.timing_status(_lrc(spark, sf_dir), "track_id", "text")


@query(f"""WITH {TALK}, o AS (SELECT section_id AS track_id, pos AS n, CAST(floor(start * 1000) AS BIGINT) AS ms, text FROM talk WHERE text <> ''), t AS (SELECT track_id, n, ms + 200 AS ms FROM o WHERE n % 3 <> 0),
h AS (SELECT track_id, n, EXISTS (SELECT 1 FROM t WHERE t.track_id = o.track_id AND abs(t.ms - o.ms) <= 350) AS hit FROM o)
SELECT track_id, count(*) AS required, count(*) FILTER (hit) AS covered, count(*) FILTER (hit) / count(*) AS coverage FROM h GROUP BY track_id""")
def a6_translation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = talk(spark, sf_dir).where("text <> ''")
    o = t.select(F.col("section_id").alias("track_id"), F.col("pos").alias("n"), F.floor(F.col("start") * 1000).cast("long").alias("ms"), "text")
    return ly.translation_coverage(o, o.where("n % 3 <> 0").withColumn("ms", F.col("ms") + 200))


_N3 = rf"regexp_replace(replace(lower(text), 'ß', 'ss'), '[{T.SPACE}\p{{P}}\p{{S}}]+', '', 'g')"


@query(f"""WITH {LINES}, f AS (SELECT track_id, line, lang, {_N3} AS text FROM lines) SELECT track_id, text, count(*) AS n, CAST(list_sort(list(line)) AS VARCHAR) AS lines, count(DISTINCT line % 2) > 1 AS inconsistent FROM f WHERE text <> '' GROUP BY track_id, text HAVING count(*) > 1""")
def a12_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir).select("track_id", "line", F.col("text").alias("japanese"), (F.col("line") % 2).cast("string").alias("chinese"))
    return ly.repeated_lines(d).withColumn("lines", F.concat(F.lit("["), F.array_join(F.transform("lines", lambda x: x.cast("string")), ", "), F.lit("]")))


@query(f"""WITH {LINES}, g AS (SELECT track_id, count(*) AS n, count(*) FILTER (track_id % 3 <> 0 AND (track_id % 3 = 1 OR line % 2 = 0)) AS same FROM lines WHERE track_id % 3 <> 5 GROUP BY track_id)
SELECT track_id, n, same, CASE WHEN track_id % 10 = 9 THEN 'official' WHEN same = n THEN 'external' WHEN same = 0 THEN 'model' ELSE 'hybrid' END AS tier FROM g""")
def g34_translation_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir).select("track_id", "line", F.lit("译").alias("chinese"), (F.col("track_id") % 10 == 9).alias("official"))
    a = d.where("track_id % 3 <> 0 AND (track_id % 3 = 1 OR line % 2 = 0)").select("track_id", "line", F.lit("译。").alias("chinese"))
    return ly.translation_tier(d, a)


def _song_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as cues of ten characters a second; a question is speech."""
    d = lines(spark, sf_dir).where("text <> ''").select(F.col("track_id").alias("section_id"), F.col("line").cast("long").alias("pos"), "text")
    w = Window.partitionBy("section_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)) / 10.0
    c = d.withColumn("start", start)
    return c.select("section_id", "pos", F.col("text").alias("source_text"), F.lit(None).cast("string").alias("canonical_source_text"), F.when(F.col("pos") % 13 == 12, "speech").otherwise("lyric").alias("role"), F.array().cast("array<string>").alias("evidence"), "start", (F.col("start") + F.length("text") / 10.0).alias("end"))


_SONG = """song AS (SELECT section_id, pos, CASE WHEN pos % 13 = 12 THEN 'speech' ELSE 'lyric' END AS role, s AS start, s + n / 10.0 AS "end" FROM (SELECT track_id AS section_id, line AS pos, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY track_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 10.0 AS s FROM lines WHERE text <> ''))"""
_MATCHED = f"regexp_replace(lower(replace(regexp_replace(text, '{T.TAG}', '', 'g'), '\\N', '')), '[{T.SPACE}\\p{{P}}\\p{{S}}]+', '', 'g')"
#: From tokens (section_id, pos, n, t): each section's block of most lines that stands twice without overlap, and its places
#: from the left. Two places i and i + d hold a block of as many lines as agree along d, d at most.
_BLOCKS = """same AS (SELECT a.section_id, a.n AS i, b.n - a.n AS d FROM tokens a JOIN tokens b ON a.section_id = b.section_id AND a.t = b.t AND a.n < b.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY section_id, d ORDER BY i) AS g FROM same),
agree AS (SELECT section_id, d, max(i) OVER (PARTITION BY section_id, d, g) - i + 1 AS e FROM islands),
longest AS (SELECT section_id, max(least(e, d)) AS size FROM agree GROUP BY section_id HAVING max(least(e, d)) >= 2),
places AS (SELECT l.section_id, l.size, a.n AS s, list(x.t ORDER BY x.n) AS block FROM longest l JOIN tokens a ON a.section_id = l.section_id JOIN tokens x ON x.section_id = a.section_id AND x.n BETWEEN a.n AND a.n + l.size - 1 GROUP BY ALL HAVING count(x.t) = l.size),
twice AS (SELECT * FROM (SELECT *, max(s) OVER (PARTITION BY section_id, block) - min(s) OVER (PARTITION BY section_id, block) AS far FROM places) WHERE far >= size),
chosen AS (SELECT section_id, size, block, min(s) AS s FROM twice GROUP BY ALL UNION ALL SELECT c.section_id, c.size, c.block, min(t.s) FROM chosen c JOIN twice t ON t.section_id = c.section_id AND t.block = c.block AND t.s >= c.s + c.size GROUP BY ALL),
ranked AS (SELECT section_id, block, row_number() OVER (PARTITION BY section_id ORDER BY count(*) DESC, length(array_to_string(block, '')) DESC, min(s)) AS k FROM chosen GROUP BY section_id, block),
occurrences AS (SELECT c.section_id, row_number() OVER (PARTITION BY c.section_id ORDER BY c.s) AS occurrence, a.pos AS first, b.pos AS last FROM ranked r JOIN chosen c ON c.section_id = r.section_id AND c.block = r.block
  JOIN tokens a ON a.section_id = c.section_id AND a.n = c.s JOIN tokens b ON b.section_id = c.section_id AND b.n = c.s + c.size - 1 WHERE r.k = 1)"""
_TOKENS = f"sung AS (SELECT track_id AS section_id, line AS pos, row_number() OVER (PARTITION BY track_id ORDER BY line) AS n, nullif({_MATCHED}, '') AS t FROM lines WHERE text <> ''), tokens AS (SELECT section_id, pos, n, CASE WHEN pos % 13 <> 12 THEN t END AS t FROM sung)"
#: The same, of texts that are lines in a row of the lyric alone: they stand in the joined lines from one line's start to one's end.
_KNOWN = _TOKENS.replace("tokens AS", "said AS") + """, lyric AS (SELECT section_id, t, sum(length(t)) OVER (PARTITION BY section_id ORDER BY pos) AS upto FROM sung WHERE pos % 3 = 0 AND t IS NOT NULL),
joined AS (SELECT section_id, string_agg(t, '' ORDER BY upto) AS whole, list(upto) AS ends FROM lyric GROUP BY section_id),
runs AS (SELECT DISTINCT s.section_id, s.t FROM said s JOIN lyric l ON s.section_id = l.section_id JOIN joined j ON j.section_id = s.section_id
  WHERE substr(j.whole, CAST(l.upto - length(l.t) + 1 AS BIGINT), length(s.t)) = s.t AND list_contains(j.ends, l.upto - length(l.t) + length(s.t))),
tokens AS (SELECT s.section_id, s.pos, s.n, r.t FROM said s LEFT JOIN runs r ON r.section_id = s.section_id AND r.t = s.t)"""


@query(f"WITH RECURSIVE {LINES}, {_TOKENS}, {_BLOCKS} SELECT * FROM occurrences", occurrence="INTEGER", first="BIGINT", last="BIGINT")
def a9_repetition_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rep.repetition_groups(_song_cues(spark, sf_dir))


@query(f"""WITH RECURSIVE {LINES}, {_SONG}, {_TOKENS}, {_BLOCKS}, times AS (SELECT o.section_id, o.occurrence, a.start, b."end", b."end" - a.start AS duration FROM occurrences o JOIN song a ON a.section_id = o.section_id AND a.pos = o.first JOIN song b ON b.section_id = o.section_id AND b.pos = o.last),
middle AS (SELECT section_id, (ds[(len(ds) + 1) // 2] + ds[len(ds) // 2 + 1]) / 2 AS median FROM (SELECT section_id, list_sort(list(duration)) AS ds FROM times GROUP BY section_id)),
drifts AS (SELECT t.*, median, max(abs(duration / median - 1)) OVER (PARTITION BY section_id) AS drift FROM times t JOIN middle USING (section_id))
SELECT section_id, occurrence, start, "end", '' AS risks, duration, median, drift, drift <= CAST(0.12 AS DOUBLE) AS stable FROM drifts""", occurrence="INTEGER")
def a10_occurrence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _song_cues(spark, sf_dir)
    out = rep.occurrence_stats(c, rep.repetition_groups(c))
    return out.withColumn("risks", F.array_join("risks", ","))


_LETTERS_OF = "regexp_replace(lower({0}), '[" + T.SPACE + "\\p{{P}}\\p{{S}}]+', '', 'g')"


@query(f"""WITH {TALK}, c AS (SELECT section_id, pos, CASE WHEN role = 'user' THEN 'speech' ELSE 'shout' END AS role, text, CASE WHEN pos % 3 = 0 THEN text || 'x' END AS canonical, [CASE WHEN pos % 4 = 0 THEN 'Crowd noise' ELSE 'ok' END, CASE WHEN pos % 5 = 0 THEN 'line omitted' ELSE 'ok' END] AS evidence FROM talk WHERE text <> '')
SELECT section_id, pos, array_to_string(list_sort(list_filter([CASE WHEN role IN ('speech', 'lyric_adlib') THEN role WHEN role <> 'lyric' THEN 'non_lyric_role' END, CASE WHEN {_LETTERS_OF.replace('{0}', 'canonical').replace('{{', '{').replace('}}', '}')} <> {_LETTERS_OF.replace('{0}', 'text').replace('{{', '{').replace('}}', '}')} THEN 'live_lyric_variant' END,
  CASE WHEN len(list_filter(evidence, lambda e: regexp_matches(lower(e), 'audience|crowd'))) > 0 THEN 'audience_singing' END, CASE WHEN len(list_filter(evidence, lambda e: regexp_matches(lower(e), 'omitted|missing'))) > 0 THEN 'omitted_lyric' END], lambda x: x IS NOT NULL)), ',') AS codes FROM c""")
def u3_risk_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = talk(spark, sf_dir).where("text <> ''")
    evidence = F.array(F.when(F.col("pos") % 4 == 0, "Crowd noise").otherwise("ok"), F.when(F.col("pos") % 5 == 0, "line omitted").otherwise("ok"))
    c = t.select("section_id", "pos", F.when(F.col("role") == "user", "speech").otherwise("shout").alias("role"), F.col("text").alias("source_text"), F.when(F.col("pos") % 3 == 0, F.concat("text", F.lit("x"))).alias("canonical_source_text"), evidence.alias("evidence"))
    return rep.risk_codes(c).select("section_id", "pos", F.array_join("risk_codes", ",").alias("codes"))




@query(f"""WITH {LINES}, {_SONG}, i AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY pos) AS i FROM song), l AS (SELECT *, i - row_number() OVER (PARTITION BY section_id ORDER BY pos) AS run FROM i WHERE role = 'lyric'),
p AS (SELECT a.section_id, a.pos AS first, b.pos AS last, max(CASE WHEN b."end" - a.start > 174 AND b.pos > a.pos THEN 1 ELSE 0 END) OVER (PARTITION BY a.section_id, a.pos ORDER BY b.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bad FROM l a JOIN l b ON a.section_id = b.section_id AND a.run = b.run AND b.pos >= a.pos),
r AS (SELECT section_id, first, max(last) AS last, count(*) AS n FROM p WHERE bad = 0 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY n DESC, first) AS k FROM r) SELECT section_id, first, last, n FROM k WHERE k = 1""", first="BIGINT", last="BIGINT")
def w11_fallback_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rep.fallback_sample(_song_cues(spark, sf_dir))


@query(f"""WITH {LINES}, {_SONG}, f AS (SELECT section_id, pos, start, coalesce(lag(role) OVER w <> 'lyric' OR start - lag("end") OVER w >= 3.0, TRUE) AS st FROM song WINDOW w AS (PARTITION BY section_id ORDER BY pos)),
a AS (SELECT section_id, pos AS anchor, pos + 1 AS last FROM song WHERE pos % 5 = 3 AND (section_id, pos + 1) IN (SELECT section_id, pos FROM song)),
e AS (SELECT a.*, greatest(coalesce((SELECT max(pos) FROM f WHERE f.section_id = a.section_id AND f.pos <= anchor AND st), 0), coalesce((SELECT max(b.last + 1) FROM a b WHERE b.section_id = a.section_id AND b.last + 1 <= a.anchor), 0)) AS fr, (SELECT "end" FROM song s WHERE s.section_id = a.section_id AND s.pos = a.last) AS u FROM a)
SELECT e.section_id, anchor, last, min(f.pos) AS sample_start FROM e JOIN f ON f.section_id = e.section_id AND f.pos BETWEEN fr AND anchor AND (u - f.start <= 174 OR f.pos = anchor) GROUP BY ALL""", anchor="BIGINT", last="BIGINT", sample_start="BIGINT")
def w10_structure_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _song_cues(spark, sf_dir)
    nxt = c.select("section_id", F.col("pos").alias("last"))
    a = c.where("pos % 5 = 3").select("section_id", F.col("pos").alias("anchor"), (F.col("pos") + 1).alias("last")).join(nxt, ["section_id", "last"])
    return rep.structure_boundary(c, a)


def _proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir).select("section_id", F.col("pos").cast("long").alias("pos"), F.col("role").alias("text"), "start", "end")
    return c.withColumns({"new_start": F.when(F.col("pos") % 2 == 0, F.col("start") + 0.3), "new_end": F.when(F.col("pos") % 3 == 0, F.col("end") - 0.2)})


@query(f"""WITH RECURSIVE {CUES}, p AS (SELECT section_id, CAST(pos AS BIGINT) AS pos, start, "end", CASE WHEN pos % 2 = 0 THEN start + CAST(0.3 AS DOUBLE) END AS a, CASE WHEN pos % 3 = 0 THEN "end" - CAST(0.2 AS DOUBLE) END AS b, lead(start) OVER (PARTITION BY section_id ORDER BY pos) AS nxt FROM cues),
r AS (SELECT section_id, pos, a, b, s, CASE WHEN b - s > 0 AND NOT coalesce(b > nxt + 0.001, FALSE) THEN b ELSE "end" END AS e FROM (SELECT *, CASE WHEN "end" - a > 0 THEN a ELSE start END AS s FROM p WHERE pos = 0)
  UNION ALL SELECT section_id, pos, a, b, s, CASE WHEN b - s > 0 AND NOT coalesce(b > nxt + 0.001, FALSE) THEN b ELSE "end" END FROM (SELECT p.*, CASE WHEN p."end" - p.a > 0 AND NOT p.a < r.e - 0.001 THEN p.a ELSE p.start END AS s FROM p JOIN r ON p.section_id = r.section_id AND p.pos = r.pos + 1))
SELECT section_id, pos, 'start' AS edge, s = a AS eligible FROM r WHERE a IS NOT NULL UNION ALL SELECT section_id, pos, 'end', e = b FROM r WHERE b IS NOT NULL""")
def w12_change_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rep.change_collisions(_proposed(spark, sf_dir))


@query(f"""WITH {CUES}, n AS (SELECT section_id, CAST(pos AS BIGINT) AS pos, role AS text, CASE WHEN pos % 7 <> 6 AND pos % 2 = 0 THEN start + CAST(0.3 AS DOUBLE) ELSE start END AS start, CASE WHEN pos % 7 <> 6 AND pos % 3 = 0 THEN "end" - CAST(0.2 AS DOUBLE) ELSE "end" END AS "end", pos % 7 = 6 AS ch FROM cues)
SELECT section_id, pos, text, start, "end", CASE WHEN ch THEN 'text_changed' WHEN start >= "end" THEN 'no_duration' WHEN start < lag("end") OVER (PARTITION BY section_id ORDER BY pos) - 0.001 THEN 'overlap' END AS code FROM n""")
def w13_apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _proposed(spark, sf_dir)
    changes = p.select("section_id", "pos", F.when(F.col("pos") % 7 == 6, "x").otherwise(F.col("text")).alias("text"), "new_start", "new_end")
    return rep.apply_changes(p.drop("new_start", "new_end"), changes)


@query(f"""WITH {TALK}, t AS (SELECT section_id, pos, string_split(text, ' ') AS w FROM talk), k AS (SELECT section_id, pos, w, unnest(range(1, len(w) + 1)) AS i FROM t), x AS (SELECT section_id, pos, i, w[i] AS x, i - 1 AS j FROM k),
h AS (SELECT a.section_id, a.pos, a.i, b.i AS j FROM x a JOIN x b ON b.section_id = a.section_id AND b.pos = a.pos + 1 AND b.x = a.x), r AS (SELECT section_id, pos, i - row_number() OVER (PARTITION BY section_id, pos, i - j ORDER BY i) AS g, i - j AS d FROM h),
n AS (SELECT section_id, pos, g, d, count(*) AS n FROM r GROUP BY ALL) SELECT a.section_id * 1000 + a.pos AS pair, coalesce(max(n), 0) AS run FROM t a JOIN t b ON b.section_id = a.section_id AND b.pos = a.pos + 1 LEFT JOIN n ON n.section_id = a.section_id AND n.pos = a.pos GROUP BY a.section_id, a.pos""")
def u5_longest_common_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each turn against those of the next one."""
    t = talk(spark, sf_dir).select("section_id", "pos", F.split("text", " ").alias("items"))
    a = t.select((F.col("section_id") * 1000 + F.col("pos")).alias("pair"), "items")
    b = t.where("pos > 0").select((F.col("section_id") * 1000 + F.col("pos") - 1).alias("pair"), "items")
    return audit.longest_common_run(a, b, "pair")


@query("""WITH t AS (SELECT l_orderkey AS media_id, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN 'ja' WHEN 1 THEN 'ja-JP' WHEN 2 THEN 'en' ELSE 'ja-x' END AS lang, l_suppkey % 3 = 0 AS auto FROM lineitem), r AS (SELECT *, CASE WHEN lang = 'ja' THEN 1 WHEN lang LIKE 'ja-%' THEN 2 END AS r FROM t WHERE NOT auto),
b AS (SELECT *, min(r) OVER (PARTITION BY media_id) AS m FROM r WHERE r IS NOT NULL), n AS (SELECT *, count(*) OVER (PARTITION BY media_id) AS n FROM b WHERE r = m) SELECT media_id, lang FROM n WHERE n = 1""")
def u6_language_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    k = F.col("l_partkey") % 4
    t = li.select(F.col("l_orderkey").alias("media_id"), F.when(F.col("l_suppkey") % 3 == 0, "ja.auto").otherwise("ja").alias("name"), F.when(k == 0, "ja").when(k == 1, "ja-JP").when(k == 2, "en").otherwise("ja-x").alias("lang"))
    return audit.language_track(t, "ja").select("media_id", "lang")


@query("""WITH c AS (SELECT o_custkey AS track_id, o_orderstatus AS version, o_orderpriority AS name, bool_or(o_totalprice > 100000) AS ok FROM orders GROUP BY ALL), g AS (SELECT track_id, version, list(name) FILTER (ok) AS good FROM c GROUP BY ALL)
SELECT track_id, version, len(miss) = 0 AS ready, array_to_string(miss, ',') AS missing FROM (SELECT track_id, version, list_filter(['1-URGENT', '2-HIGH'], lambda x: NOT coalesce(list_contains(good, x), FALSE)) AS miss FROM g)""")
def a18_delivery_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("track_id"), F.col("o_orderstatus").alias("version"), F.col("o_orderpriority").alias("name")).agg(F.bool_or(F.col("o_totalprice") > 100000).alias("ok"))
    return audit.delivery_ready(o, ["1-URGENT", "2-HIGH"])


@query("""WITH i AS (SELECT l_orderkey AS list_id, 'check ' || l_returnflag AS label, l_discount > 0.05 AS ticked FROM lineitem), n AS (SELECT list_id, label, count(*) AS n FROM i GROUP BY ALL), w AS (SELECT list_id, label FROM (SELECT DISTINCT list_id FROM i), (VALUES ('check A'), ('check N'), ('check R')) v(label))
SELECT list_id, label, 'unticked' AS code FROM i WHERE NOT ticked UNION ALL SELECT list_id, label, CASE WHEN n IS NULL THEN 'missing' ELSE 'repeated' END FROM w LEFT JOIN n USING (list_id, label) WHERE coalesce(n, 0) <> 1""")
def g28_checklist_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    item = F.concat(F.when(F.col("l_discount") > 0.05, "- [x] check ").otherwise("- [ ] check "), F.col("l_returnflag"))
    lists = li.groupBy(F.col("l_orderkey").alias("list_id")).agg(F.array_join(F.collect_list(item), "\n").alias("text"))
    return audit.checklist_faults(lists, spark.createDataFrame([("check A",), ("check N",), ("check R",)], "label string"))


@query(f"""WITH {TALK}, c AS (SELECT section_id AS track_id, pos, start - CASE WHEN pos % 4 = 3 THEN 0.5 ELSE 0.0 END AS start, "end" FROM talk),
n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY track_id) AS n, row_number() OVER (PARTITION BY track_id ORDER BY "end" - start DESC, pos) AS l, row_number() OVER (PARTITION BY track_id ORDER BY "end" - start, pos) AS s, lag("end") OVER (PARTITION BY track_id ORDER BY pos) AS u FROM c),
x AS (SELECT *, 0 AS k, 'early_sync' AS label FROM n WHERE i = 1 UNION ALL SELECT *, 1, 'middle_sync' FROM n WHERE i = n // 2 + 1 UNION ALL SELECT *, 2, 'late_sync' FROM n WHERE i = n UNION ALL SELECT *, 3, 'longest_cue' FROM n WHERE l = 1 UNION ALL SELECT *, 4, 'shortest_cue' FROM n WHERE s = 1)
SELECT track_id, label, pos, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY track_id, start, "end" ORDER BY k) AS o FROM x) WHERE o = 1 UNION ALL SELECT track_id, 'overlap', pos, start, u FROM n WHERE start < u - CAST(0.001 AS DOUBLE)""")
def o5_preview_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = talk(spark, sf_dir).select(F.col("section_id").alias("track_id"), "pos", (F.col("start") - F.when(F.col("pos") % 4 == 3, 0.5).otherwise(0.0)).alias("start"), "end")
    return ly.preview_points(c)


@query(f"WITH RECURSIVE {LINES}, {_KNOWN}, {_BLOCKS} SELECT * FROM occurrences", occurrence="INTEGER", first="BIGINT", last="BIGINT")
def a9_known_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only texts that are runs of a lyric's lines may repeat: the lyric is every third line of the same document."""
    c = _song_cues(spark, sf_dir)
    known = c.where("pos % 3 = 0").select("section_id", F.col("pos").alias("line"), F.col("source_text").alias("text"))
    return rep.repetition_groups(c, known=known)
