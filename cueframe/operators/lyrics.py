"""Choosing among lyric candidates, and lyric lines against their translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .joins import nearest

STAMP = r"^\s*\[(\d{2,3}):(\d{2}(?:\.\d{1,3})?)\](.*)$"


def _first(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def scored(songs: DataFrame, both_ways: bool = False) -> DataFrame:
    """Adds the match score of each hit (query_id, title, artist, hit_title, hit_artist)."""
    return songs.withColumn("score", T.title_match_score(*[F.coalesce(c, F.lit("")) for c in ("title", "artist", "hit_title", "hit_artist")], both_ways))


def rank_songs(songs: DataFrame, most: int = 5) -> DataFrame:
    """O1: the best hits of each query by score, then popularity, then the order they came in (hit_id)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.coalesce("popularity", F.lit(0.0))), "hit_id")
    return scored(songs).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def choose_hit(songs: DataFrame) -> DataFrame:
    """O2: by score, then synced text, then lines of plain text, then not instrumental."""
    lines = F.size(F.filter(F.split(F.coalesce("plain", F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    return _first(scored(songs), "query_id", F.desc("score"), F.desc(F.coalesce("synced", F.lit("")) != ""), F.desc(lines), F.desc(~F.coalesce("instrumental", F.lit(False))), F.asc("hit_id"))


def choose_candidate(candidates: DataFrame) -> DataFrame:
    """O3: candidates (query_id, title, artist, hit_title, hit_artist, lines, coverage, popularity, hit_id): identity
    first, then translation coverage."""
    t, h = F.lower(F.trim("title")), F.lower(F.trim("hit_title"))
    hit = (t != "") & (h != "") & (F.contains(h, t) | F.contains(t, h))
    q = Window.partitionBy("query_id")
    fit = scored(candidates, True).withColumn("_exact", t == h).where(hit & (F.col("score") >= 8))
    fit = fit.withColumn("_any", F.max(F.col("_exact").cast("int")).over(q)).where("_exact OR _any = 0")
    fit = fit.withColumn("_best", F.max("score").over(q)).where((F.col("score") >= F.col("_best") - 2) & (F.col("lines") > 0))
    return _first(fit, "query_id", F.desc(F.col("coverage") == 1.0), F.desc("coverage"), F.desc("score"), F.desc("lines"), F.desc(F.coalesce("popularity", F.lit(0.0))), F.asc("hit_id")).drop("_exact", "_any", "_best")


def choose_source(songs: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Of the top five near the best score, the first with synced and translated text, else the first
    with synced text, else the hit of the other source, else none."""
    top = rank_songs(songs).withColumn("_best", F.max("score").over(Window.partitionBy("query_id")))
    near = top.where(F.col("score") >= F.greatest(F.lit(1), F.col("_best") - 2))
    synced, translated = F.coalesce("synced", F.lit("")) != "", F.coalesce("translation", F.lit("")) != ""
    grade = F.when(synced & translated, 1).when(synced, 2)
    best = _first(near.withColumn("_g", grade).where("_g IS NOT NULL"), "query_id", F.asc("_g"), F.asc("place")).select("query_id", "hit_id", F.when(F.col("_g") == 1, "synced_translated").otherwise("synced").alias("source"))
    other = alternatives.groupBy("query_id").agg(F.min("hit_id").alias("_alt"))
    j = songs.select("query_id").distinct().join(best, "query_id", "left").join(other, "query_id", "left")
    return j.select("query_id", F.coalesce("hit_id", "_alt").alias("hit_id"), F.coalesce("source", F.when(F.col("_alt").isNotNull(), "alternative"), F.lit("none")).alias("source"))


def timed_lines(texts: DataFrame, key: str, column: str) -> DataFrame:
    """Lines (key, n, ms, text) of lyric texts: ms is null for a line without a timestamp; blank lines and
    metadata are left out."""
    raw = texts.select(key, F.posexplode(F.split(F.coalesce(column, F.lit("")), "\r\n|\r|\n")).alias("n", "_l"))
    minute, second = F.regexp_extract("_l", STAMP, 1), F.regexp_extract("_l", STAMP, 2)
    stamped = minute != ""
    ms = F.when(stamped, F.rint((minute.try_cast("double") * 60 + second.try_cast("double")) * 1000).cast("long"))
    text = F.trim(F.when(stamped, F.regexp_extract("_l", STAMP, 3)).otherwise(F.col("_l")))
    out = raw.select(key, "n", ms.alias("ms"), text.alias("text"))
    return out.where((F.col("text") != "") & ~T.is_lyric_metadata(F.col("text")))


def timing_status(texts: DataFrame, key: str, column: str) -> DataFrame:
    """None, no_body, timed or partly_timed."""
    n = timed_lines(texts, key, column).groupBy(key).agg(F.count("*").alias("n"), F.count("ms").alias("m"))
    j = texts.select(key, F.trim(F.coalesce(column, F.lit(""))).alias("_t")).join(n, key, "left")
    return j.select(key, F.when(F.col("_t") == "", "none").when(F.col("n").isNull(), "no_body").when(F.col("n") == F.col("m"), "timed").otherwise("partly_timed").alias("status"))


def translation_coverage(originals: DataFrame, translations: DataFrame, key: str = "track_id") -> DataFrame:
    """Lines (key, n, ms, text) that are no chants and have a translation within 350 ms; none counts
    if a side is not fully timed."""
    status = lambda d, name: d.groupBy(key).agg((F.count("*") == F.count("ms")).alias(name))
    need = originals.where(F.col("ms").isNotNull() & ~T.is_ascii_chant(F.col("text")))
    hit = nearest(need.select(key, "n", "ms"), translations.where("ms IS NOT NULL").select(key, "n", "ms"), key, "ms", "n", 350).select(key, "n", F.lit(1).alias("_h"))
    j = need.join(hit, [key, "n"], "left").groupBy(key).agg(F.count("*").alias("required"), F.count("_h").alias("covered"))
    out = originals.select(key).distinct().join(status(originals, "_o"), key).join(status(translations, "_t"), key, "left").join(j, key, "left").na.fill(0, ["required", "covered"])
    good = F.col("_o") & F.coalesce("_t", F.lit(True))
    return out.select(key, "required", "covered", F.when(good & (F.col("required") > 0), F.col("covered") / F.col("required")).otherwise(0.0).alias("coverage"))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """Lyric texts (track_id, line, japanese, chinese) that stand several times in a track, the lines, and
    whether their translations differ."""
    flat = lines.withColumn("text", T.norm_lyric(F.col("japanese"))).where("text <> ''")
    g = flat.groupBy("track_id", "text").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("line")).alias("lines"), (F.countDistinct(F.coalesce("chinese", F.lit(""))) > 1).alias("inconsistent"))
    return g.where("n > 1")


def review_samples(cues: DataFrame, durations: DataFrame) -> DataFrame:
    """The cues (track_id, pos, start, end, n_chars, luma) to look at: first, middle, last, longest, brightest,
    darkest, each in three seconds around its middle, and the end of the last one."""
    w = Window.partitionBy("track_id")
    at = lambda *o: F.row_number().over(w.orderBy(*o))
    out = cues.withColumns({
        "_n": F.count("*").over(w), "_first": at(F.asc("pos")), "_last": at(F.desc("pos")),
        "_long": at(F.desc("n_chars"), F.asc("pos")), "_bright": at(F.desc("luma"), F.asc("pos")), "_dark": at(F.asc("luma"), F.asc("pos")),
    }).join(durations, "track_id")
    labels = F.array_compact(F.array(
        F.when(F.col("_first") == 1, "early_sync"), F.when(F.col("_first") == F.floor(F.col("_n") / 2) + 1, "middle_sync"), F.when(F.col("_last") == 1, "late_sync"),
        F.when(F.col("_long") == 1, "long_line"), F.when(F.col("_bright") == 1, "bright_subtitle"), F.when(F.col("_dark") == 1, "dark_subtitle"), F.when(F.col("_last") == 1, "subtitle_disappearance"),
    ))
    mid = (F.col("start") + F.col("end")) / 2
    gone = F.col("label") == "subtitle_disappearance"
    picked = out.withColumn("label", F.explode(labels))
    a, b = F.when(gone, F.col("end") - 1.2).otherwise(mid - 1.5), F.when(gone, F.col("end") + 1.2).otherwise(mid + 1.5)
    return picked.select("track_id", "label", "pos", F.greatest(F.lit(0.0), a).alias("window_start"), F.least("duration", b).alias("window_end"))


def preview_points(cues: DataFrame) -> DataFrame:
    """The places of a candidate to look at: first, middle and last cue (track_id, pos, start, end), the one that
    lasts longest and the one that lasts shortest, the first of equal ones. Cues with the same times come once, under the
    first label. Each cue that begins over 1 ms before the one before it ends is an overlap."""
    w = Window.partitionBy("track_id")
    seconds = F.col("end") - F.col("start")
    at = lambda *o: F.row_number().over(w.orderBy(*o))
    k = cues.select("track_id", "pos", "start", "end").withColumns({"_n": F.count("*").over(w), "_first": at("pos"), "_long": at(seconds.desc(), "pos"), "_short": at(seconds.asc(), "pos"), "_until": F.lag("end").over(w.orderBy("pos"))})
    is_ = [("early_sync", F.col("_first") == 1), ("middle_sync", F.col("_first") == F.floor(F.col("_n") / 2) + 1), ("late_sync", F.col("_first") == F.col("_n")), ("longest_cue", F.col("_long") == 1), ("shortest_cue", F.col("_short") == 1)]
    labels = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(i).alias("place"), F.lit(name).alias("label"))) for i, (name, hit) in enumerate(is_)]))
    picked = k.select("track_id", "pos", "start", "end", F.explode(labels).alias("l"))
    once = F.row_number().over(Window.partitionBy("track_id", "start", "end").orderBy("l.place"))
    points = picked.withColumn("_k", once).where("_k = 1").select("track_id", F.col("l.label").alias("label"), "pos", "start", "end")
    return points.unionByName(k.where(F.col("start") < F.col("_until") - 0.001).select("track_id", F.lit("overlap").alias("label"), "pos", "start", F.col("_until").alias("end")))


def translation_tier(lines: DataFrame, accepted: DataFrame) -> DataFrame:
    """Official, external, model or hybrid, from the share of lines (track_id, line, chinese, official) whose
    translation equals (N3) an accepted external one (track_id, line, chinese)."""
    e = accepted.select("track_id", "line", T.norm_lyric(F.coalesce("chinese", F.lit(""))).alias("_e"))
    j = lines.join(e, ["track_id", "line"], "left").withColumn("_same", T.norm_lyric(F.coalesce("chinese", F.lit(""))).eqNullSafe(F.col("_e")))
    g = j.groupBy("track_id").agg(F.count("*").alias("n"), F.count_if("_same").alias("same"), F.bool_and("official").alias("_off"))
    tier = F.when(F.col("_off"), "official").when(F.col("same") == F.col("n"), "external").when(F.col("same") == 0, "model").otherwise("hybrid")
    return g.select("track_id", "n", "same", tier.alias("tier"))
