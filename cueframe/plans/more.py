"""Queries on readings, assessments and written outputs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reading as rd
from ..functions import text as T
from ..functions import timecode as C
from ..operators import gates as g
from .adapters import TALK, read, talk
from .registry import query

#: Overrides on the shared Latin texts, in place of a dictionary of words and readings.
READINGS = {"ation": "eishon", "at": "atto", "the": "za"}


@query(f"WITH {TALK} SELECT section_id, pos, replace(replace(replace(text, 'ation', 'eishon'), 'the', 'za'), 'at', 'atto') AS value FROM talk")
def t17_common_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk(spark, sf_dir).select("section_id", "pos", rd.common_reading(F.col("text"), READINGS).alias("value"))


@query(f"WITH {TALK} SELECT section_id, pos, concat_ws(',', CASE WHEN contains(text, 'ation') THEN 'ation' END, CASE WHEN contains(text, 'the') THEN 'the' END, CASE WHEN contains(text, 'at') AND NOT contains(text, 'ation') THEN 'at' END) AS value FROM talk")
def t17_reading_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk(spark, sf_dir).select("section_id", "pos", F.array_join(rd.reading_hits(F.col("text"), READINGS), ",").alias("value"))


#: Kana for small and capital letters: all rows, small kana and both scripts among them.
_SMALL, _CAPITAL = "かシうツてぃんふっぎじょあをゔぇリゃハぴデゅズゐぬコ", "ヱァゾベミやヲチユレワのエもヴザぼソゥパゴォムグダキ"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_PARTS = "|".join(k for k in rd.kana_table() if len(k) == 2)
_PLAIN = f"translate(translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{_LETTERS + _LETTERS.upper()}', '{_SMALL + _CAPITAL}'), '{T.KATAKANA}', '{T.HIRAGANA}')"
_MAP = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in rd.kana_table().items()) + "}"


def _kana(column: str) -> Column:
    return F.translate(F.regexp_replace(column, "[^A-Za-z]", ""), _LETTERS + _LETTERS.upper(), _SMALL + _CAPITAL)


@query(f"""WITH {TALK}, p AS (SELECT section_id, pos, regexp_extract_all({_PLAIN}, '{_PARTS}|.') AS p FROM talk)
SELECT section_id, pos, array_to_string(list_transform(p, lambda x: {_MAP}[x]), ' ') AS phones, 'unknown:' || list_filter(p, lambda x: {_MAP}[x] IS NULL)[1] AS error FROM p""")
def t18_kana_to_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of turns, put as kana."""
    p = rd.kana_to_phones(_kana("text"))
    return talk(spark, sf_dir).select("section_id", "pos", p.alias("p")).select("section_id", "pos", F.array_join("p.phones", " ").alias("phones"), "p.error")


@query(f"""WITH {TALK}, t AS (SELECT section_id, pos, CASE WHEN pos % 2 = 0 THEN text || '空 ソラ' ELSE text END AS t FROM talk)
SELECT section_id, pos, concat_ws(',', CASE WHEN regexp_matches(replace(replace(replace(t, 'ation', ''), 'the', ''), 'at', ''), '[A-Za-z0-9]') THEN 'latin_or_digits' END, CASE WHEN regexp_matches(t, '[一-龥々〆ヵヶ]+[ /／]+[ァ-ヶー]+') THEN 'double_writing' END) AS value FROM t""")
def t19_pronunciation_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.when(F.col("pos") % 2 == 0, "空 ソラ").otherwise(""))
    return talk(spark, sf_dir).select("section_id", "pos", F.array_join(rd.pronunciation_suspects(text, READINGS), ",").alias("value"))


def _codes(*checks: tuple[str, str, str]) -> str:
    """SQL for one row of code and severity for each condition that holds."""
    each = ", ".join(f"CASE WHEN {when} THEN {{'code': '{code}', 'severity': '{severity}'}} END" for when, code, severity in checks)
    return f"unnest(list_filter([{each}], lambda x: x IS NOT NULL))"


def _set(values: Iterable[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_G23 = _codes(
    ("cls IS NULL", "mc_complexity_missing", "hard"),
    ("v <> '0.1.0'", "mc_complexity_schema_mismatch", "hard"),
    ("seen <> input_hash", "stale_mc_complexity_assessment", "hard"),
    ("NOT known", "invalid_mc_complexity_classification", "hard"),
    ("n < 1", "invalid_mc_speaker_count", "hard"),
    ("odd", "invalid_mc_complexity_signal", "hard"),
    (f"len(basis) = 0 OR NOT list_has_all({_set(g.BASES)}, basis)", "invalid_mc_complexity_evidence_basis", "hard"),
    (f"NOT list_has_any(basis, {_set(g.HEARD)})", "mc_complexity_missing_audio_review", "hard"),
    (f"judged AND risk <> CASE WHEN high THEN 'high' WHEN cls = '{g.CLASSES[1]}' THEN 'medium' ELSE 'low' END", "mc_complexity_risk_mismatch", "hard"),
    ("judged AND manual <> high", "mc_manual_conform_policy_mismatch", "hard"),
    ("judged AND policy <> CASE WHEN high THEN 'draft_only' ELSE 'review_required' END", "mc_reflow_policy_mismatch", "hard"),
    (f"cls = '{g.CLASSES[2]}'", "crowded_mc_review_required", "review"),
    (f"cls = '{g.CLASSES[1]}'", "managed_mc_review_required", "review"),
)


@query(f"""WITH o AS (SELECT o_orderkey AS section_id, o_orderkey AS input_hash, o_orderkey % 12 AS k FROM orders),
a AS (SELECT section_id, CASE WHEN k = 1 THEN '9' ELSE '0.1.0' END AS v, CASE WHEN k = 2 THEN -1 ELSE input_hash END AS seen, CASE k WHEN 3 THEN 'x' WHEN 7 THEN 'managed_dialogue' WHEN 8 THEN 'crowded_multi_speaker' ELSE 'single_speaker' END AS cls, CASE WHEN k = 4 THEN 0 ELSE 1 END AS n,
  CAST(CASE WHEN k = 5 THEN ['noise'] ELSE [] END AS VARCHAR[]) AS sig, CAST(CASE WHEN k = 6 THEN [] ELSE ['audio_review'] END AS VARCHAR[]) AS basis, 'low' AS risk, FALSE AS manual, 'review_required' AS policy FROM o WHERE k <> 0),
r AS (SELECT *, list_contains({_set(g.CLASSES)}, cls) AS known, NOT list_has_all({_set(g.RISKS)}, sig) AS odd, cls = '{g.CLASSES[2]}' OR n >= 3 OR len(sig) > 0 AS high FROM o LEFT JOIN a USING (section_id)), j AS (SELECT *, known AND n >= 1 AND NOT odd AS judged FROM r),
f AS (SELECT section_id, {_G23} AS f FROM j) SELECT section_id, f.code AS code, f.severity AS severity FROM f""")
def g23_mc_assessment_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section_id"), F.col("o_orderkey").alias("input_hash"))
    k = F.col("section_id") % 12
    a = o.where("section_id % 12 <> 0").select(
        "section_id", F.when(k == 1, "9").otherwise("0.1.0").alias("schema_version"), F.when(k == 2, -1).otherwise(F.col("input_hash")).alias("input_hash"),
        F.when(k == 3, "x").when(k == 7, "managed_dialogue").when(k == 8, "crowded_multi_speaker").otherwise("single_speaker").alias("classification"), F.when(k == 4, 0).otherwise(1).alias("speaker_count"),
        F.when(k == 5, F.array(F.lit("noise"))).otherwise(F.array().cast("array<string>")).alias("signals"), F.when(k == 6, F.array().cast("array<string>")).otherwise(F.array(F.lit("audio_review"))).alias("evidence_basis"),
        F.lit("low").alias("risk_level"), F.lit(False).alias("manual_required"), F.lit("review_required").alias("reflow_policy"),
    )
    return g.mc_assessment_failures(o, a)


_G25 = _codes(
    ("ready IS NULL", "missing_coverage_audit_report", "hard"),
    ("seen <> 'h'", "stale_coverage_audit_report", "hard"),
    ("NOT ready", "concert_coverage_not_ready", "hard"),
    ("result IS NULL", "missing_merge_evidence", "hard"),
    ("event_count <> n", "output_event_count_mismatch", "hard"),
    ("result <> 'passed'", "output_report_not_passed", "hard"),
    ("events_hash <> hash", "output_events_content_mismatch", "hard"),
    ("lines IS NULL", "missing_formal_output", "hard"),
    ("lines <> n", "ass_event_count_mismatch", "hard"),
    ("bare > 0", "ass_empty_text", "hard"),
)


@query(f"""WITH {TALK}, o AS (SELECT section_id AS concert_id, count(*) AS n, section_id % 8 AS k, sha256(string_agg(pos || ':' || start || ':' || "end" || ':' || text, '|' ORDER BY pos)) AS hash FROM talk GROUP BY section_id),
cov AS (SELECT concert_id, CASE WHEN k = 2 THEN 'x' ELSE 'h' END AS seen, k <> 3 AS ready FROM o WHERE k <> 1), rep AS (SELECT concert_id, n + CAST(k = 5 AS INTEGER) AS event_count, CASE WHEN k IN (5, 7) THEN '?' ELSE hash END AS events_hash, CASE WHEN k = 6 THEN 'failed' ELSE 'passed' END AS result FROM o WHERE k <> 4),
d AS (SELECT section_id AS concert_id, count(*) AS lines, count(*) FILTER (trim(CASE WHEN section_id % 8 = 0 THEN '' ELSE 'x' END) = '') AS bare FROM talk WHERE section_id % 8 <> 7 AND NOT (section_id % 16 = 9 AND pos = 0) GROUP BY section_id),
f AS (SELECT concert_id, {_G25} AS f FROM o LEFT JOIN cov USING (concert_id) LEFT JOIN rep USING (concert_id) LEFT JOIN d USING (concert_id)) SELECT concert_id, f.code AS code, f.severity AS severity FROM f""")
def g25_output_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as concerts; all but some fail in their own way."""
    t = talk(spark, sf_dir)
    m = t.select(F.col("section_id").alias("concert_id"), "section_id", "pos", "start", "end", "text")
    n = g.events_digest(m)
    k = F.pmod("concert_id", F.lit(8))
    c = n.select("concert_id", F.lit("h").alias("manifest_hash"))
    cov = n.where(k != 1).select("concert_id", F.when(k == 2, "x").otherwise("h").alias("seen_hash"), (k != 3).alias("ready"))
    rep = n.where(k != 4).select("concert_id", F.when(k == 5, F.col("n") + 1).otherwise(F.col("n")).alias("event_count"), F.when(k.isin(5, 7), "?").otherwise(F.col("hash")).alias("events_hash"), F.when(k == 6, "failed").otherwise("passed").alias("result"))
    line = F.concat(F.lit("Dialogue: 0,"), C.ass(F.col("start")), F.lit(","), C.ass(F.col("end")), F.lit(",D,,0,0,0,,"), F.when(k == 0, "").otherwise("x"))
    docs = m.where((k != 7) & ~((F.pmod("concert_id", F.lit(16)) == 9) & (F.col("pos") == 0))).groupBy("concert_id").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return g.output_checks(c, cov, m, rep, docs)
