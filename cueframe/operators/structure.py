"""Verses and choruses: the structure table, its checks, beats and the choice of a cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("intro", "verse", "pre_chorus", "chorus", "bridge", "interlude", "outro")


def structure_errors(parts: DataFrame, durations: DataFrame) -> DataFrame:
    """Codes for parts (track_id, cycle, part, role, first, last, start, end, evidence) in the order of the table."""
    w = Window.partitionBy("track_id").orderBy("start", "first", "cycle", "part")
    j = parts.join(durations, "track_id").withColumns({
        "_last": F.lag("last").over(w), "_end": F.lag("end").over(w), "_same": F.count("*").over(Window.partitionBy("track_id", "cycle", "part")),
    })
    codes = F.array_compact(F.array(
        F.when(F.col("_same") > 1, "duplicate_part"),
        F.when(~F.col("role").isin(*ROLES), "role"),
        F.when((F.col("first") < 1) | (F.col("first") > F.col("last")) | (F.col("first") <= F.col("_last")), "line_range"),
        F.when((F.col("start") >= F.col("end")) | (F.col("start") < 0) | (F.col("end") > F.col("duration") + 0.001) | (F.col("start") < F.col("_end") - 0.001), "time_order"),
        F.when(F.trim(F.coalesce("evidence", F.lit(""))) == "", "no_evidence"),
    ))
    return j.select("track_id", "cycle", "part", F.explode(codes).alias("code"))


def choose_cycle(parts: DataFrame, durations: DataFrame) -> DataFrame:
    """Of the first two cycles that hold a verse, the first that runs from verse to chorus, whole and without
    a break in its lines; with its window of three seconds on each side. parts: track_id, n (place in the table),
    cycle, role, first, last, start, end, complete."""
    verse = parts.where("role = 'verse'").groupBy("track_id", "cycle").agg(F.min("n").alias("_n"))
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy("_n"))
    two = verse.withColumn("_r", rank).where("_r <= 2")
    w = Window.partitionBy("track_id", "cycle").orderBy("n")
    flow = parts.withColumn("_gap", F.coalesce(F.col("first") != F.lag("last").over(w) + 1, F.lit(False)))
    g = flow.groupBy("track_id", "cycle").agg(
        F.min_by("role", "n").alias("_a"), F.max_by("role", "n").alias("_b"), F.bool_and("complete").alias("_c"), F.bool_or("_gap").alias("_g"), F.min_by("start", "n").alias("start"), F.max_by("end", "n").alias("end")
    )
    fit = two.join(g, ["track_id", "cycle"]).where("_a = 'verse' AND _b = 'chorus' AND _c AND NOT _g")
    best = fit.groupBy("track_id").agg(F.min_by(F.struct("cycle", "start", "end"), "_r").alias("b"))
    out = best.join(durations, "track_id")
    return out.select("track_id", F.col("b.cycle").alias("cycle"), F.greatest(F.lit(0.0), F.col("b.start") - 3.0).alias("window_start"), F.least("duration", F.col("b.end") + 3.0).alias("window_end"))


def beat_anchors(parts: DataFrame, onsets: DataFrame) -> DataFrame:
    """Every fourth beat of a part (track_id, part, start, end, beats), moved to the strongest onset (track_id, i in
    hundredths of a second, value) near it if that stands out, else left where it is expected; and both ends of the part.

    A beat asks for a second or the two that its range touches, so the onsets of each second stand in one row with those
    of the next, and a beat meets one row."""
    step = (F.col("end") - F.col("start")) / F.col("beats")
    expected, radius = F.col("start") + step * F.col("beat"), F.least(F.lit(0.25), step * 0.35)
    inside = (F.col("beat") > 0) & (F.col("beat") < F.col("beats"))
    last = F.col("beats").cast("int")
    inner = F.when(F.col("beats") > 4, F.sequence(F.lit(4), F.col("beats") - 1, F.lit(4)).cast("array<int>")).otherwise(F.array().cast("array<int>"))
    beats = parts.withColumn("beat", F.explode(F.concat(F.array(F.lit(0)), inner, F.array(last))))
    # ends are not moved: their range is empty
    low = F.when(inside, F.greatest(F.lit(0), F.ceil((expected - radius) * 100))).otherwise(F.floor(F.col("start") * 100))
    beats = beats.select(
        "track_id", "part", "beat",
        F.when(inside, expected).when(F.col("beat") == 0, F.col("start")).otherwise(F.col("end")).alias("expected"),
        low.cast("long").alias("_lo"), F.when(inside, F.floor((expected + radius) * 100).cast("long")).alias("_hi"),
    )
    second = F.floor(F.col("i") / 100)
    o = onsets.where("i IS NOT NULL AND value IS NOT NULL").select("track_id", F.struct(F.col("value").cast("double").alias("v"), (-F.col("i")).alias("k")).alias("o"), F.explode(F.array(second, second - 1)).alias("_w"))
    o = o.groupBy(F.col("track_id").alias("_k"), "_w").agg(F.collect_list("o").alias("_o"))
    met = beats.join(o, (F.col("track_id") == F.col("_k")) & (F.floor(F.col("_lo") / 100) == F.col("_w")), "left")
    met = met.withColumn("_near", F.filter("_o", lambda x: (-x["k"] >= F.col("_lo")) & (-x["k"] <= F.col("_hi"))))
    mean = F.aggregate("_near", F.lit(0.0), lambda total, x: total + x["v"]) / F.size("_near")
    met = met.withColumns({"_top": F.array_max("_near"), "_mean": F.when(F.size("_near") > 0, mean)})
    moved = F.when(F.col("_top.v") > F.greatest(F.lit(1e-6), 2.5 * F.col("_mean")), -F.col("_top.k") / 100.0)
    return met.select("track_id", "part", "beat", F.coalesce(moved, "expected").alias("time"), moved.isNotNull().alias("supported"))


def usage_counts(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by status: reference, mapped, local_review."""
    return mapped.groupBy(*keys).pivot("status", ["reference", "mapped", "local_review"]).count().na.fill(0)
