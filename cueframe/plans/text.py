"""Queries on text functions over conversations, document lines, page titles and URLs.

The shared texts are composed Latin text, on which NFKC changes nothing; so the SQL leaves it out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import timecode as C
from .adapters import LINES, TALK, lines, read, talk
from .gates import _cw_sql, mc_sql, units_sql
from .registry import query

_P = rf"[{T.SPACE}\p{{P}}\p{{S}}]+"


def _q(text: str) -> str:
    return text.replace("'", "''")


def _each(name: str, column: Callable[[], Column], sql: str, source: str = "talk", keys: tuple[str, ...] = ("section_id", "pos")) -> None:
    """A query of one value for each row of conversations or lines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return (talk if source == "talk" else lines)(spark, sf_dir).select(*keys, column().alias("value"))

    run.__name__ = name
    query(f"WITH {TALK if source == 'talk' else LINES} SELECT {', '.join(keys)}, {sql} AS value FROM {source}")(run)


def _text() -> Column:
    return F.col("text")


_LINE = ("track_id", "line")


def _marked() -> Column:
    return F.concat(F.lit("{an8}"), _text(), F.lit("\\N"), "text")


_MARKED = "'{an8}' || text || '\\N' || text"
_each("t1_norm_layout", lambda: T.norm_layout(_marked()), f"regexp_replace(replace(regexp_replace({_MARKED}, '{T.TAG}', '', 'g'), '\\N', ' '), '[{T.SPACE}]+', '', 'g')")
_each("t2_norm_match", lambda: T.norm_match(_marked()), f"regexp_replace(lower(replace(regexp_replace({_MARKED}, '{T.TAG}', '', 'g'), '\\N', '')), '{_P}', '', 'g')")
_each("t3_norm_lyric", lambda: T.norm_lyric(_text()), f"regexp_replace(replace(lower(text), 'ß', 'ss'), '{_P}', '', 'g')", "lines", _LINE)
_each("t4_display_units", lambda: T.display_units(_text()), f"CAST({units_sql('text')} AS INTEGER)", "lines", _LINE)
_N = f"length(regexp_replace(text, '[^{T.wide()}]+', '', 'g'))"
_each("t5_weighted_width", lambda: T.weighted_width(_text()), f"CAST({_N} * CAST(1.0 AS DOUBLE) + (length(text) - {_N}) * CAST(0.55 AS DOUBLE) AS DOUBLE)", "lines", _LINE)
_each("t5_line_width", lambda: T.line_width(F.replace(_text(), F.lit(". "), F.lit("\n")), 48), f"list_max(list_transform(string_split(replace(text, '. ', chr(10)), chr(10)), lambda x: length(x) + length(regexp_replace(x, '[^{T.wide()}]+', '', 'g')))) * 48 / 2")
_NF = f"length(regexp_replace(text, '[^{T.wide('WF')}]+', '', 'g'))"
_each("t5_label_width", lambda: T.label_width(_text()), f"CAST(ceil(({_NF} + (length(text) - {_NF}) * CAST(0.55 AS DOUBLE)) * 24 * CAST(0.8 AS DOUBLE)) AS BIGINT) + 16")
_each("t5_comment_width", lambda: T.comment_width(_text()), f"CAST({_cw_sql('text')} AS DOUBLE)")
_W = f"(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x) + length(regexp_replace(x, '[^{T.wide()}]+', '', 'g')))) * 48 / 2)"
_each("t6_fit_scale", lambda: T.fit_scale(T.line_width(_text(), 48), 1760.0), f"CAST(CASE WHEN {_W} <= 1760 THEN 100 ELSE greatest(50, least(100, floor(CAST(1760 AS DOUBLE) / {_W} * 100))) END AS INTEGER)")
_each("t8_mc_punctuation", lambda: T.normalize_mc_punctuation(F.concat(_text(), F.lit(" 3.14, a... b.."))), mc_sql("(text || ' 3.14, a... b..')"))
_each("t9_review_placeholder", lambda: T.has_review_placeholder(F.when(F.pmod("pos", F.lit(3)) == 0, F.concat(_text(), F.lit(" [TODO]"))).otherwise(_text())), f"regexp_matches(CASE WHEN pos % 3 = 0 THEN text || ' [TODO]' ELSE text END, '{_q(T.REVIEW_MARK)}')")
_CREDITED = "trim(CASE WHEN pos % 3 = 0 THEN 'Lyrics: ' || text WHEN pos % 3 = 1 THEN '[Verse 2]' ELSE text END)"
_each("t10_lyric_metadata", lambda: T.is_lyric_metadata(F.when(F.pmod("pos", F.lit(3)) == 0, F.concat(F.lit("Lyrics: "), _text())).when(F.pmod("pos", F.lit(3)) == 1, "[Verse 2]").otherwise(_text())), f"regexp_matches({_CREDITED}, '{_q(T.CREDIT).split('(?!')[0]}(?:[^\\p{{L}}\\p{{N}}_]|$)') OR regexp_matches({_CREDITED}, '{_q(T.SECTION_LABEL)}') OR regexp_matches({_CREDITED}, '{_q(T.LRC_TAG)}')")
_V = "(CASE WHEN pos % 2 = 0 THEN regexp_replace(lower(text), '[a-z]+', 'la', 'g') ELSE lower(text) END)"
_each(
    "t11_ascii_chant",
    lambda: T.is_ascii_chant(F.when(F.pmod("pos", F.lit(2)) == 0, F.regexp_replace(F.lower(_text()), "[a-z]+", "la")).otherwise(_text())),
    f"len(regexp_extract_all({_V}, '[a-z]+')) > 0 AND regexp_replace({_V}, '{_q(T.CHANT_OTHER)}', '', 'g') = '' AND len(list_filter(regexp_extract_all({_V}, '[a-z]+'), lambda x: NOT regexp_matches(x, '{T.CHANT_TOKEN}'))) = 0",
)


def _titled() -> Column:
    return F.concat(F.lit("Artist - "), F.lpad((F.col("pos") + 1).cast("string"), 2, "0"), F.lit(". "), F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")), F.lit(" (Official Video) x"))


_each("t12_clean_title", lambda: T.clean_title(_titled()), "trim(regexp_replace(regexp_replace(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) || ' (Official Video) x', '(?i)\\s+from\\s+.*$', ''), ' \\(Official Video\\).*$', ''))")
_each("t12_clean_artist", lambda: T.clean_artist(F.concat("text", F.lit(" Official YouTube Channel"))), f"coalesce(nullif(trim(regexp_replace(trim(text || ' Official YouTube Channel'), '{T.CHANNEL}', '')), ''), trim(text || ' Official YouTube Channel'))")
_each("t13_slugify", lambda: T.slugify(_text()), r"coalesce(nullif(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\x{3040}-\x{30ff}\x{3400}-\x{9fff}.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'untitled')")
_each("t13_filename_fault", lambda: T.valid_filename_component(_text()), r"""CASE WHEN trim(text) IN ('', '.', '..') THEN 'empty' WHEN length(trim(text)) > 128 THEN 'too_long' WHEN trim(text) LIKE '%.' THEN 'ends_with_dot'
  WHEN regexp_matches(trim(text), '[<>:"/\\|?*\x00-\x1F]') THEN 'illegal_character' WHEN lower(split_part(trim(text), '.', 1)) IN ('con', 'prn', 'aux', 'nul') THEN 'reserved_name' END""")
_each("t14_srt_time", lambda: C.srt(F.col("start")), "format('{:02d}:{:02d}:{:02d},{:03d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000)".replace("ms", "CAST(round_even(start * 1000, 0) AS BIGINT)"))
_each("t14_ass_time", lambda: C.ass(F.col("end")), "format('{}:{:02d}:{:02d}.{:02d}', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100)".replace("cs", "CAST(round_even(\"end\" * 100, 0) AS BIGINT)"))
_each("t14_review_time", lambda: C.review(F.col("start") * 100), "CASE WHEN ms >= 3600000 THEN format('{:02d}:', ms // 3600000) ELSE '' END || format('{:02d}:{:02d}.{:03d}', ms // 60000 % 60, ms // 1000 % 60, ms % 1000)".replace("ms", "CAST(round_even(start * 100 * 1000, 0) AS BIGINT)"))
_each("t14_parse_time", lambda: C.parse_ms(C.srt(F.col("start"))), "CAST(round_even(start * 1000, 0) AS BIGINT)")
_TWO = "CASE WHEN pos % 3 = 0 THEN 'かな' || chr(10) || text WHEN pos % 3 = 1 THEN text || chr(10) || chr(10) || ' カナ ' ELSE text || chr(10) || role END"
_LINES2 = f"list_filter(list_transform(string_split({_TWO}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_each(
    "t21_split_bilingual",
    lambda: T.split_bilingual(F.when(F.pmod("pos", F.lit(3)) == 0, F.concat(F.lit("かな\n"), "text")).when(F.pmod("pos", F.lit(3)) == 1, F.concat("text", F.lit("\n\n カナ "))).otherwise(F.concat("text", F.lit("\n"), "role")))["chinese"],
    f"CASE WHEN len({_LINES2}) = 2 THEN CASE WHEN regexp_matches(({_LINES2})[1], '[぀-ヿ]') AND NOT regexp_matches(({_LINES2})[2], '[぀-ヿ]') THEN ({_LINES2})[2] ELSE ({_LINES2})[1] END END",
)
_MARKS = _q(T.CLOSERS + T.STRONG + T.SOFT)
_each("t22_strong_end", lambda: T.has_strong_end(_text()), "regexp_matches(rtrim(rtrim(trim(text), '”’」』）》】\"'''), ' '), '[。！？?!；;]$')")
_each("t22_unfinished_tail", lambda: T.has_unfinished_tail(F.when(F.pmod("pos", F.lit(2)) == 0, F.concat(_text(), F.lit("けど、"))).otherwise(_text())), f"regexp_matches(trim(rtrim(trim(CASE WHEN pos % 2 = 0 THEN text || 'けど、' ELSE text END), '{_MARKS}')), '(?:{'|'.join(T.UNFINISHED)})$')")
_each("t22_short_reply", lambda: T.is_short_reply(F.when(F.pmod("pos", F.lit(3)) == 0, "そう です。").otherwise(_text())), f"replace(trim(rtrim(trim(CASE WHEN pos % 3 = 0 THEN 'そう です。' ELSE text END), '{_MARKS}')), ' ', '') IN {T.SHORT_REPLIES}")
_each("t22_continuation", lambda: T.has_continuation_evidence(F.array(F.when(F.pmod("pos", F.lit(3)) == 0, "Sentence_Unfinished").otherwise(F.col("role")))), "regexp_matches(lower(CASE WHEN pos % 3 = 0 THEN 'Sentence_Unfinished' ELSE role END), 'continuation|continues_next|unfinished')")
_each("t23_choose_lyric_text", lambda: T.choose_lyric_text(F.when(F.pmod("pos", F.lit(3)) == 0, F.concat(F.lit("[00:01.5]"), _text())).when(F.pmod("pos", F.lit(3)) == 1, _text()), F.when(F.pmod("pos", F.lit(6)) == 2, _text()))["kind"], "CASE WHEN pos % 3 = 0 THEN 'lrc' WHEN pos % 6 = 2 AND trim(text) <> '' THEN 'txt' WHEN pos % 3 = 1 AND trim(text) <> '' THEN 'txt' END")
_OTHER = "(CASE WHEN pos % 3 = 0 THEN text WHEN pos % 3 = 1 THEN text || ' zz' ELSE role END)"


def _other() -> Column:
    return F.when(F.pmod("pos", F.lit(3)) == 0, _text()).when(F.pmod("pos", F.lit(3)) == 1, F.concat(_text(), F.lit(" zz"))).otherwise(F.col("role"))


_each("t16_title_score", lambda: T.title_match_score(_text(), F.col("role"), _other(), F.concat(F.lit("the "), F.col("role"))), "CASE WHEN text <> '' AND text = " + _OTHER + " THEN 8 WHEN text <> '' AND contains(" + _OTHER + ", text) THEN 4 ELSE 0 END + 4")
_A, _B = (f"length(regexp_replace(lower({x}), '{_P}', '', 'g'))" for x in ("text", "text || ' ' || role"))
_each("t15_contained_ratio", lambda: T.contained_ratio(T.norm_match(_text()), T.norm_match(F.concat_ws(" ", "text", "role"))), f"CASE WHEN {_A} = 0 THEN CAST(0.0 AS DOUBLE) ELSE least({_A}, {_B}) / greatest({_A}, {_B}) END")


@query()
def t7_wrap_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk(spark, sf_dir).select("section_id", "pos", T.wrap_display(_text(), 38).alias("wrapped"))


_KANA = "かサなタはマらキしチにヒみリうクすツぬフむユるケせテ"


def _sung(text: str, kana: str) -> Column:
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), "abcdefghijklmnopqrstuvwxyz", kana)


_LOW = "translate(regexp_replace(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', '{0}')"
_HIRA, _KATA = "".join(map(T.kana_folded, _KANA)), "".join(T.KATAKANA[T.HIRAGANA.index(T.kana_folded(c))] for c in _KANA)
_each(
    "t15_by_reading",
    lambda: T.contained_similarity(_sung("text", _KANA), F.concat(_sung("text", _KATA), F.when(F.pmod("pos", F.lit(2)) == 0, "ン").otherwise(F.col("role")))),
    f"(SELECT CASE WHEN len(a) = 0 THEN 0 ELSE greatest(CASE WHEN contains(b, a) THEN length(a) / length(b) END, length(a) / length(b)) END FROM (SELECT {_LOW.format(_HIRA)} AS a, {_LOW.format(_HIRA)} || CASE WHEN pos % 2 = 0 THEN 'ん' ELSE role END AS b))",
)


@query()
def t15_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before it."""
    before = F.lag("text").over(Window.partitionBy("section_id").orderBy("pos"))
    return talk(spark, sf_dir).withColumn("before", before).where("before IS NOT NULL").select("section_id", "pos", T.similarity(_text(), F.col("before")).alias("similarity"))


@query(f"""WITH {TALK} SELECT section_id, pos, sha256(CAST(json_object('pos', pos, 'role', role, 'section_id', section_id, 'text', text) AS VARCHAR)) AS hash FROM talk""")
def t20_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk(spark, sf_dir).select("section_id", "pos", T.content_hash("section_id", "pos", "text", "role").alias("hash"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) > 20 AS too_long, regexp_matches(url, '://(?:[^/]*\.)?example\.(?:net|org)(?:[/?#]|$)') AS off_site FROM pages")
def g27_post_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.audit import title_of, url_is_off_site

    title = title_of(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", title.alias("title"), (F.length(title) > 20).alias("too_long"), url_is_off_site(F.col("url"), ["example.com"], ["example.net", "example.org"]).alias("off_site"))


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's first turns as a post copy of two platforms."""
    t = talk(spark, sf_dir).where("pos < 4")
    line = lambda n: F.max(F.when(F.col("pos") == n, F.regexp_replace(F.substring("text", 1, 200000), "\\s+", " ")))
    g = t.groupBy(F.col("section_id").alias("copy_id")).agg(*[F.coalesce(line(n), F.lit("")).alias(f"t{n}") for n in range(4)])
    k = F.col("copy_id")
    text = F.concat(
        F.lit("head\n## 小红书\n标题："), "t0", F.lit("\n\n"), "t1", F.when(k % 3 == 0, F.lit("\nsee https://a.example/x")).otherwise(F.lit("")), F.lit("\n上一篇笔记ID："), F.when(k % 2 == 0, F.lit("0123456789abcdef01234567")).otherwise(F.lit("?")),
        F.lit("\n## B站\n标题：song "), "t2", F.lit("\n正文：\n"), "t3", F.lit("\n上一首：x BV1234567890 y\nhttps://www.bilibili.com/video\n话题：a b\n"), F.when(k % 5 == 0, F.lit("标题：again\n")).otherwise(F.lit("")), F.when(k % 7 == 0, F.lit("## B站\n标题：b\n")).otherwise(F.lit("")),
    )
    return g.select("copy_id", "t0", "t1", "t2", "t3", text.alias("text"))


_COPIES = f"""{TALK}, every AS (SELECT section_id AS copy_id, {', '.join(f"coalesce(max(CASE WHEN pos = {n} THEN regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g') END), '') AS t{n}" for n in range(4))} FROM talk WHERE pos < 4 GROUP BY section_id), g AS (SELECT * FROM every WHERE copy_id % 5 <> 0 AND copy_id % 7 <> 0)"""


@query(f"""WITH {_COPIES} SELECT copy_id, '小红书' AS platform, trim(t0) AS title, trim(t1 || CASE WHEN copy_id % 3 = 0 THEN chr(10) || 'see https://a.example/x' ELSE '' END, ' ' || chr(10)) AS body, '' AS tags, '' AS source, CASE WHEN copy_id % 2 = 0 THEN '0123456789abcdef01234567' ELSE '?' END AS previous_note_id, '' AS chapter_comment, '' AS publishing_notes FROM g
UNION ALL SELECT copy_id, 'B站', trim('song ' || t2), trim(t3 || chr(10) || '上一首：x BV1234567890 y' || chr(10) || 'https://www.bilibili.com/video', ' ' || chr(10)), 'a b', '', '', '', '' FROM g""")
def g27_parse_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.audit import parse_copies

    return parse_copies(_copies(spark, sf_dir).select("copy_id", "text"))[0]


@query(f"""WITH {_COPIES} SELECT copy_id, 'B站' AS platform, 'field_repeated' AS code FROM every WHERE copy_id % 5 = 0 UNION ALL SELECT copy_id, 'B站', 'platform_repeated' FROM every WHERE copy_id % 7 = 0
UNION ALL SELECT copy_id, '小红书', 'missing_post' FROM g WHERE trim(t0) = '' OR trim(t1) = '' AND copy_id % 3 <> 0 UNION ALL SELECT copy_id, '小红书', 'url_in_body' FROM g WHERE trim(t0) <> '' AND copy_id % 3 = 0
UNION ALL SELECT copy_id, '小红书', 'previous_title_missing' FROM g WHERE trim(t0) <> '' AND (trim(t1) <> '' OR copy_id % 3 = 0) UNION ALL SELECT copy_id, '小红书', 'previous_note_missing' FROM g WHERE trim(t0) <> '' AND (trim(t1) <> '' OR copy_id % 3 = 0) AND copy_id % 2 = 1
UNION ALL SELECT copy_id, '小红书', 'title_without_song' FROM g WHERE NOT contains(trim(t0), 'song') UNION ALL SELECT copy_id, '小红书', 'title_too_long' FROM g WHERE length(trim(t0)) > 20 UNION ALL SELECT copy_id, '视频号', 'missing_post' FROM g""")
def g27_copy_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.audit import copy_faults, parse_copies

    copies = _copies(spark, sf_dir)
    posts, faults = parse_copies(copies.select("copy_id", "text"))
    return faults.unionByName(copy_faults(posts, copies.select("copy_id", F.lit("song").alias("song")), ("小红书", "B站", "视频号"), True))
