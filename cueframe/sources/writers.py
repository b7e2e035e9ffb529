"""Subtitle documents from cues, and the partitioned sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import timecode as C

SOURCE_RENDER, TRANSLATION_RENDER = 56, 38
HEAD = "[Script Info]\nScriptType: v4.00+\nPlayResX: 1920\nPlayResY: 1080\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"


def _in_order(order: str, text: Column, sep: str) -> Column:
    """One document from a group's lines, sorted inside the group."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("_t")))), lambda x: x["_t"]), sep)


def render_srt(cues: DataFrame, key: str = "section_id", wrap: bool = True) -> DataFrame:
    """K1: one document (key, text) for each key of cues (key, pos, start, end, source_text, translation)."""
    from pyspark.sql import Window

    fit = (lambda c, n: T.wrap_display(c, n)) if wrap else (lambda c, n: F.trim(c))
    source, translation = fit(F.coalesce("source_text", F.lit("")), SOURCE_RENDER), fit(F.coalesce("translation", F.lit("")), TRANSLATION_RENDER)
    flat = cues.select(key, "pos", "start", "end", source.alias("_s"), translation.alias("_r"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    body = F.when(F.col("_r") != "", F.concat("_r", F.lit("\n"), "_s")).otherwise(F.col("_s"))
    block = F.concat(number.cast("string"), F.lit("\n"), C.srt(F.col("start")), F.lit(" --> "), C.srt(F.col("end")), F.lit("\n"), body, F.lit("\n"))
    return flat.withColumn("_block", block).groupBy(key).agg(_in_order("pos", F.col("_block"), "\n").alias("text"))


def ass_text(text: Column) -> Column:
    """Text without what ASS would take for marks: braces and backslashes full-width, breaks as \\N."""
    out = F.translate(text, "{}\\", "｛｝＼")
    return F.regexp_replace(out, "\r\n|\r|\n", r"\\\\N")


def colour_runs(parts: Column, text: Column) -> Column:
    """The text with a colour tag for each confirmed solo part."""

    def run(p: Column) -> Column:
        bgr = F.concat(F.substring(p["color"], 6, 2), F.substring(p["color"], 4, 2), F.substring(p["color"], 2, 2))
        tag = F.concat(F.lit("{\\1c&H"), F.upper(bgr), F.lit("&}"))
        own = ass_text(p["text"])
        return F.when((p["mode"] == "solo") & (p["status"] == "confirmed") & p["color"].isNotNull(), F.concat(tag, own, F.lit("{\\r}"))).otherwise(own)

    return F.when(parts.isNotNull() & (F.size(parts) > 0), F.array_join(F.transform(parts, run), "")).otherwise(ass_text(text))


def render_ass(cues: DataFrame, key: str = "concert_id", font_size: int = 56, safe: float = 1760.0, parts: str | None = None) -> DataFrame:
    """K2: one document for each key: a head and a line for each cue, narrowed to fit, with colours from singing parts."""
    source = F.coalesce("source_text", F.lit(""))
    scale = T.fit_scale(T.line_width(source, font_size), safe)
    text = colour_runs(F.col(parts), source) if parts else ass_text(source)
    fitted = F.concat(F.when(scale < 100, F.concat(F.lit("{\\fscx"), scale.cast("string"), F.lit("}"))).otherwise(""), text)
    translation = ass_text(F.coalesce("translation", F.lit("")))
    body = F.when(translation != "", F.concat(translation, F.lit("\\N"), fitted)).otherwise(fitted)
    line = F.concat(F.lit("Dialogue: 0,"), C.ass(F.col("start")), F.lit(","), C.ass(F.col("end")), F.lit(",Default,,0,0,0,,"), body)
    return cues.withColumn("_line", line).groupBy(key).agg(F.concat(F.lit(HEAD), _in_order("start", F.col("_line"), "\n"), F.lit("\n")).alias("text"))


def write_by_concert(df: DataFrame, path: str, form: str = "parquet") -> None:
    """K3: partitioned by concert; the rows of a concert go to one file, those of a very large one to several."""
    df.hint("rebalance", "concert_id").write.mode("overwrite").partitionBy("concert_id").format(form).save(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def merge_overlay(captions: DataFrame, overlay: DataFrame) -> DataFrame:
    """Caption rows and overlay rows (style, ...); of overlay styles only new ones."""
    return captions.unionByName(overlay.join(captions.select("style").distinct(), "style", "left_anti"))
