"""Timed-text tables derived from the shared tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROUND3 = "floor(({0}) * 1000 + 0.5) / 1000.0"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """concert_id, section_id, type, title, start, end: an order is a section of its customer's concert."""
    first = F.min("o_orderdate").over(Window.partitionBy("o_custkey"))
    out = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority", first.alias("_first"))
    start = F.datediff("o_orderdate", "_first").cast("double")
    return out.select(
        F.col("o_custkey").alias("concert_id"),
        F.col("o_orderkey").alias("section_id"),
        F.when(F.col("o_orderkey") % 4 == 0, "mc").otherwise("song").alias("type"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("mark"),
        start.alias("start"),
        (start + F.col("o_totalprice") / 2000.0).alias("end"),
    )


SECTIONS = """sections AS (
  SELECT concert_id, section_id, type, title, mark, d AS start, d + price / 2000.0 AS "end" FROM (
    SELECT o_custkey AS concert_id, o_orderkey AS section_id, CASE WHEN o_orderkey % 4 = 0 THEN 'mc' ELSE 'song' END AS type,
      o_orderpriority AS title, o_orderstatus AS mark, o_totalprice AS price,
      CAST(date_diff('day', min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey), CAST(o_orderdate AS DATE)) AS DOUBLE) AS d FROM orders))"""


def concerts(sections_: DataFrame) -> DataFrame:
    """concert_id, duration: a second and a half beyond the last end, to whole seconds."""
    return sections_.groupBy("concert_id").agg((F.floor(F.max("end") + 1.5) * 1.0).alias("duration"))


CONCERTS = 'concerts AS (SELECT concert_id, floor(max("end") + 1.5) * 1.0 AS duration FROM sections GROUP BY concert_id)'


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section_id, pos, start, end, role, section_type, section_end, from line items: quantities are tenths
    of seconds, and the discount pulls starts forward so that some overlap."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    before = F.coalesce(F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = read(spark, sf_dir, "lineitem").select("l_orderkey", *order, "l_quantity", "l_discount", "l_returnflag", before.alias("_before"), (F.row_number().over(w) - 1).alias("pos"), F.sum("l_quantity").over(Window.partitionBy("l_orderkey")).alias("_all"))
    start = F.col("_before") / 10.0 - F.col("l_discount") * 10.0
    return out.select(
        F.col("l_orderkey").alias("section_id"),
        "pos",
        start.alias("start"),
        (start + (F.col("l_quantity") - F.when(F.col("l_quantity") > 40, 41.0).otherwise(0.0)) / 10.0).alias("end"),
        F.when(F.col("l_returnflag") == "A", "speech").when(F.col("l_returnflag") == "R", "lyric_adlib").otherwise("lyric").alias("role"),
        F.when(F.col("l_orderkey") % 4 == 0, "mc").otherwise("song").alias("section_type"),
        (F.col("_all") / 10.0).alias("section_end"),
    )


CUES = """cues AS (
  SELECT section_id, pos, s AS start, s + (q - CASE WHEN q > 40 THEN 41.0 ELSE 0.0 END) / 10.0 AS "end", role, section_type, total / 10.0 AS section_end FROM (
    SELECT l_orderkey AS section_id, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, l_quantity AS q,
      coalesce(sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) / 10.0 - l_discount * 10.0 AS s,
      CASE l_returnflag WHEN 'A' THEN 'speech' WHEN 'R' THEN 'lyric_adlib' ELSE 'lyric' END AS role,
      CASE WHEN l_orderkey % 4 = 0 THEN 'mc' ELSE 'song' END AS section_type, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)))"""


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section_id, pos, text, role, start, end, from conversations: a turn lasts a twentieth of a second a character."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    n = F.length(F.coalesce("text", F.lit("")))
    start = F.coalesce(F.sum(n).over(w), F.lit(0)) / 20.0
    out = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), "role", start.alias("start"), n.alias("_n"))
    return out.select(F.col("conv_id").alias("section_id"), F.col("turn").alias("pos"), "text", "role", "start", (F.col("start") + F.col("_n") / 20.0).alias("end"))


TALK = """talk AS (
  SELECT section_id, pos, text, role, s AS start, s + n / 20.0 AS "end" FROM (
    SELECT conv_id AS section_id, turn AS pos, coalesce(text, '') AS text, role, length(coalesce(text, '')) AS n,
      coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20.0 AS s FROM conversations))"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section_id, id, start, end, kind, k, from events: seconds since the user's first event."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first = F.min(micros).over(Window.partitionBy("user_id"))
    out = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", micros.alias("_ts"), first.alias("_first"))
    start = (F.col("_ts") - F.col("_first")) / 1000000.0
    return out.select(F.col("user_id").alias("section_id"), F.col("event_id").alias("id"), start.alias("start"), (start + F.abs(F.coalesce("value", F.lit(0.0)))).alias("end"), F.col("event_type").alias("kind"))


SEGMENTS = """segments AS (
  SELECT section_id, id, s AS start, s + abs(coalesce(value, 0.0)) AS "end", kind FROM (
    SELECT user_id AS section_id, event_id AS id, value, event_type AS kind,
      (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0 AS s FROM events))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, line, text, lang, from documents: their \\n-split lines."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("track_id"), "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))


LINES = """lines AS (
  SELECT track_id, lang, CAST(i - 1 AS INTEGER) AS line, ls[i] AS text FROM (
    SELECT doc_id AS track_id, lang, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
      SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))"""
