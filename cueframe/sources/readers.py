"""Readers of subtitle, lyric, transcript and manifest files.

Each reader is two steps: whole files as rows (path, text), and a parser from such rows to typed ones. The
parsers work on any table that holds file texts, so files packed in a table need no unpacking. Schemas are
explicit, and nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import timecode as C

# Formats, tags and credit words that results depend on.
CLOCK = r"(\d{2}:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[,.]\d{3})"
SHORT_CLOCK = r"((?:\d{1,2}:)?\d{2}:\d{2}[,.]\d{2,3})\s*-->\s*((?:\d{1,2}:)?\d{2}:\d{2}[,.]\d{2,3})"
WORDS = "array<struct<start:double,end:double,text:string,probability:double>>"
SEGMENT = f"struct<start:double,end:double,text:string,speaker:string,words:{WORDS}>"
EVENT = "struct<id:string,start:double,end:double,source_text:string,text:string,translation:string,role:string,canonical_source_text:string,lyric_line_span:array<int>,evidence:array<string>>"
SECTION = "struct<id:string,`order`:int,type:string,title:string,artist:string,start:double,end:double,context_start:double,context_end:double,boundary_confidence:double,review_priority:string,status:string>"
MANIFEST = f"schema_version string, concert_id string, duration_seconds double, coverage_policy string, sections array<{SECTION}>"
VERSION = "0.1.0"
FILE_TAG = r"(?i)^\[(?:ar|al|ti|by|offset|re|ve|length):"
FILE_CREDIT = r"(?i)^\s*(?:(?:作词|作詞|作曲|编曲|編曲|翻译|翻譯|歌词|歌詞)|(?:lyricist|composer|arranger|lyrics|music))\s*[:：]"
FILE_STAMP = r"^(?:\[\d{1,3}:\d{2}(?:[.:]\d{1,3})?\])+"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every file, without a byte-order mark and with plain line ends."""
    out = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return out.withColumn("text", plain(F.col("text")))


def plain(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def _blocks(files: DataFrame, keys: list[str]) -> DataFrame:
    blocks = F.split(F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")), r"\n[ \t\f\x0B]*\n\s*")
    return files.select(*keys, F.posexplode(blocks).alias("_b", "_block"))


def _after(mark: Column) -> Column:
    """What stands in the block after the first place of the mark."""
    return F.substr("_block", F.instr(F.col("_block"), mark) + F.length(mark))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("_b")) - 1).drop("_b")


def parse_srt(files: DataFrame, line: str = "last", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Keys, pos, start, end, text. line: which line of a block is its text: last, first or all."""
    ks = list(keys)
    at = F.regexp_extract("_block", rf"(?m)^\s*{CLOCK}\s*$", 0)
    body = F.regexp_replace(_after(at), r"\\N", "\n")
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pick = {"last": F.element_at(lines, -1), "first": F.get(lines, F.lit(0)), "all": F.array_join(lines, "\n")}[line]
    out = _blocks(files, ks).where(at != "").where(F.size(lines) > 0)
    out = out.select(*ks, "_b", C.parse(F.regexp_extract(at, CLOCK, 1)).alias("start"), C.parse(F.regexp_extract(at, CLOCK, 2)).alias("end"), pick.alias("text"))
    return _numbered(out, ks).select(*ks, "pos", "start", "end", "text")


def parse_ass(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Keys, pos, start, end, text (tags stay, line marks become line breaks)."""
    ks = list(keys)
    rows = files.select(*ks, F.posexplode(F.split("text", "\n")).alias("_b", "_l")).where(F.col("_l").startswith("Dialogue:"))
    f = F.split("_l", ",", 10)
    out = rows.where(F.size(f) == 10).select(*ks, "_b", C.parse(f[1]).alias("start"), C.parse(f[2]).alias("end"), F.trim(F.regexp_replace(f[9], r"\\N|\\n", "\n")).alias("text"))
    return _numbered(out.where("text <> ''"), ks).select(*ks, "pos", "start", "end", "text")


def clean_caption(text: Column) -> Column:
    """One caption line without inline times, tags and entities, its white space single."""
    out = F.regexp_replace(text, r"\\N|\\n", "　")
    out = F.regexp_replace(F.regexp_replace(out, r"<\d{1,2}:\d{2}:\d{2}[.,]\d{3}>", ""), r"\{[^}]*\}|<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lrm;", "‎"), ("&rlm;", "‏"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, f"[{T.SPACE}]+", " "))


def parse_vtt(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """S3: keys, pos, start_ms, end_ms, text (lines joined by an ideographic space)."""
    ks = list(keys)
    at = F.regexp_extract("_block", f"(?m)^.*?{SHORT_CLOCK}.*$", 0)
    lines = F.filter(F.transform(F.split(_after(at), "\n"), clean_caption), lambda x: x != "")
    out = _blocks(files, ks).where(at != "").where(F.size(lines) > 0)
    out = out.select(*ks, "_b", C.parse_ms(F.regexp_extract(at, SHORT_CLOCK, 1)).alias("start_ms"), C.parse_ms(F.regexp_extract(at, SHORT_CLOCK, 2)).alias("end_ms"), F.array_join(lines, "　").alias("text"))
    return _numbered(out, ks).select(*ks, "pos", "start_ms", "end_ms", "text")


def parse_lrc(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Keys, pos, ms, text of the stamped lines that hold text."""
    ks, stamp = list(keys), r"^\s*\[(\d{2,3}:\d{2}(?:\.\d{1,3})?)\](.*)$"
    rows = files.select(*ks, F.posexplode(F.split("text", "\n")).alias("_b", "_l")).where(F.col("_l").rlike(stamp))
    out = rows.select(*ks, "_b", C.parse_ms(F.regexp_extract("_l", stamp, 1)).alias("ms"), F.trim(F.regexp_extract("_l", stamp, 2)).alias("text")).where("text <> ''")
    return _numbered(out, ks).select(*ks, "pos", "ms", "text")


def parse_lyric_lines(files: DataFrame, keys: tuple[str, ...] = ("path",), metadata: str | None = None) -> DataFrame:
    """Keys, line, text: lyric lines without stamps, credits and tags. metadata: a column with an array of titles
    and artists, which are left out before the first other line."""
    from pyspark.sql import Window

    ks = list(keys)
    extra = [F.transform(F.col(metadata), lambda x: F.lower(F.regexp_replace(x, f"[{T.SPACE}]+", ""))).alias("_m")] if metadata else [F.array().cast("array<string>").alias("_m")]
    rows = files.select(*ks, *extra, F.posexplode(F.split("text", "\n")).alias("_b", "_l"))
    raw = F.trim("_l")
    text = F.trim(F.regexp_replace(raw, FILE_STAMP, ""))
    tag = raw.rlike(FILE_TAG)
    credit = text.rlike(FILE_CREDIT)
    kept = rows.where(~tag).select(*ks, "_b", text.alias("text"), "_m", credit.alias("_c")).where("text <> '' AND NOT _c AND NOT startswith(text, '[')")
    named = F.array_contains("_m", F.lower(F.regexp_replace("text", f"[{T.SPACE}]+", "")))
    before = F.max(F.when(F.coalesce(named, F.lit(False)), 0).otherwise(1)).over(Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    out = kept.withColumn("_k", before).where("_k = 1")
    return out.withColumn("line", F.row_number().over(Window.partitionBy(*ks).orderBy("_b"))).select(*ks, "line", "text")


def parse_transcripts(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Keys, seg, start, end, text, speaker, words of JSON transcripts: an object with segments or utterances, a bare
    list, or a single segment. Segments and words need finite times, start before end, and text."""
    from pyspark.sql import Window

    ks = list(keys)
    whole = F.from_json("text", f"struct<segments:array<{SEGMENT}>,utterances:array<{SEGMENT}>>")
    some = F.coalesce(whole["segments"], whole["utterances"], F.when(F.col("text").rlike(r"^\s*\["), F.from_json("text", f"array<{SEGMENT}>")), F.array(F.from_json("text", SEGMENT)))
    good = lambda x: x["start"].isNotNull() & x["end"].isNotNull() & (x["start"] < x["end"]) & (F.trim(F.coalesce(x["text"], F.lit(""))) != "")
    s = files.select(*ks, F.explode(F.filter(some, good)).alias("s"))
    words = F.filter(F.coalesce("s.words", F.array().cast(WORDS)), good)
    out = s.select(*ks, "s.start", "s.end", F.trim("s.text").alias("text"), "s.speaker", words.alias("words"))
    seg = F.row_number().over(Window.partitionBy(*ks).orderBy("start", "end", "text")) - 1
    return out.withColumn("seg", seg)


def parse_events(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Cues of JSON event lists, bare or under `events`; pos is the order."""
    ks = list(keys)
    listed = F.coalesce(F.from_json("text", f"struct<events:array<{EVENT}>>")["events"], F.when(F.col("text").rlike(r"^\s*\["), F.from_json("text", f"array<{EVENT}>")))
    rows = files.select(*ks, F.posexplode(listed).alias("pos", "e"))
    names = ("id", "start", "end", "translation", "role", "canonical_source_text", "lyric_line_span", "evidence")
    return rows.select(*ks, "pos", F.coalesce("e.source_text", "e.text").alias("source_text"), *[F.col(f"e.{n}").alias(n) for n in names])


def parse_manifests(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concerts, their sections, and files of another schema version."""
    m = files.select("path", F.from_json("text", MANIFEST).alias("m")).select("path", "m.*")
    good = m.where(F.col("schema_version").eqNullSafe(F.lit(VERSION)))
    sections = good.select("concert_id", F.inline("sections")).withColumnRenamed("id", "section_id")
    return good.select("concert_id", "duration_seconds", "coverage_policy"), sections, m.where(~F.col("schema_version").eqNullSafe(F.lit(VERSION))).select("path", "schema_version")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S9"""
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def parse_phone_labels(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Keys, n, start, end, phone of lines `start end phone` in units of 100 ns; silence tells AP and SP."""
    ks = list(keys)
    rows = files.select(*ks, F.posexplode(F.split("text", "\n")).alias("n", "_l")).where(F.trim("_l") != "")
    f = F.split(F.trim("_l"), r"\s+")
    seconds = lambda i: f[i].try_cast("bigint") / 10_000_000
    return rows.where(F.size(f) == 3).select(*ks, "n", seconds(0).alias("start"), seconds(1).alias("end"), f[2].alias("phone"), f[2].isin("AP", "SP").alias("silence"))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path, size, sha256 of every file below a folder; contents are hashed and dropped at once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_srt(spark: SparkSession, path: str, line: str = "last") -> DataFrame:
    return parse_srt(whole_files(spark, path), line)


def read_ass(spark: SparkSession, path: str) -> DataFrame:
    return parse_ass(whole_files(spark, path))


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    return parse_vtt(whole_files(spark, path))


def read_lrc(spark: SparkSession, path: str) -> DataFrame:
    return parse_lrc(whole_files(spark, path))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return parse_transcripts(whole_files(spark, path))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(whole_files(spark, path))


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_manifests(whole_files(spark, path))
