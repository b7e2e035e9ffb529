"""Timelines of recordings: gaps, fills, neighbours, merged windows, progress bars.

Sections: concert_id, section_id, type, start, end. Every function keeps concerts apart by a window or a
join on concert_id, so one shuffle by concert serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import round3

GAP_TOLERANCE = 0.5
# Dispositions that settle a gap, and statuses that settle a candidate.
RESOLVING = ("approved_speech", "crowd_nonlexical", "credits", "music_only", "no_speech")
RESOLVED = ("approved", "known_lyric", "crowd_nonlexical", "rejected_hallucination")


def _in_time() -> WindowSpec:
    return Window.partitionBy("concert_id").orderBy("start", "end", "section_id")


def timeline_gaps(sections: DataFrame, concerts: DataFrame) -> DataFrame:
    """concert_id, start, end, duration of what no section covers, beyond half a second."""
    inside = sections.join(concerts, "concert_id").select("concert_id", "section_id", F.greatest(F.lit(0.0), "start").alias("start"), F.least("duration", "end").alias("end"))
    reach = F.greatest(F.lit(0.0), F.coalesce(F.max("end").over(_in_time().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    holes = inside.withColumn("reach", reach).where(F.col("start") > F.col("reach") + GAP_TOLERANCE).select("concert_id", F.col("reach").alias("a"), F.col("start").alias("b"))
    last = inside.groupBy("concert_id").agg(F.greatest(F.lit(0.0), F.max("end")).alias("a"))
    tail = concerts.join(last, "concert_id", "left").select("concert_id", F.coalesce("a", F.lit(0.0)).alias("a"), F.col("duration").alias("b")).where(F.col("b") > F.col("a") + GAP_TOLERANCE)
    return holes.unionByName(tail).select("concert_id", round3(F.col("a")).alias("start"), round3(F.col("b")).alias("end"), round3(F.col("b") - F.col("a")).alias("duration"))


def unresolved_gaps(gaps: DataFrame, decisions: DataFrame) -> DataFrame:
    """Gaps that no decision of a resolving kind covers, give or take the tolerance."""
    d = decisions.where(F.col("disposition").isin(*RESOLVING)).select("concert_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    covers = (F.col("_s") <= F.col("start") + GAP_TOLERANCE) & (F.col("_e") >= F.col("end") - GAP_TOLERANCE)
    return gaps.join(d, (gaps["concert_id"] == d["concert_id"]) & covers, "left_anti")


def missing_scans(sections: DataFrame, candidates: DataFrame) -> DataFrame:
    """Songs without a scan."""
    return sections.where("type = 'song'").join(candidates.select("concert_id", "section_id").distinct(), ["concert_id", "section_id"], "left_anti")


def unresolved_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.where(~F.coalesce(F.col("status").isin(*RESOLVED), F.lit(False))).withColumn("status", F.coalesce("status", F.lit("missing")))


def coverage_audit(sections: DataFrame, concerts: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row for each concert: scans, candidates, gaps, what is unresolved, and whether it is ready.
    candidates: a row without an id says that the section was scanned and none was found."""
    gaps = timeline_gaps(sections, concerts)
    songs = sections.where("type = 'song'").groupBy("concert_id").agg(F.count("*").alias("songs"))
    missing = missing_scans(sections, candidates).groupBy("concert_id").agg(F.count("*").alias("missing"))
    found = candidates.where("id IS NOT NULL")
    own = found.groupBy("concert_id").agg(F.count("*").alias("candidate_count"), F.count_if(~F.coalesce(F.col("status").isin(*RESOLVED), F.lit(False))).alias("unresolved_candidate_count"))
    holes = gaps.groupBy("concert_id").agg(F.count("*").alias("timeline_gap_count"), round3(F.sum("duration")).alias("timeline_gap_seconds"))
    unclear = unresolved_gaps(gaps, decisions).groupBy("concert_id").agg(F.count("*").alias("unresolved_gap_count"))
    out = concerts.select("concert_id")
    for part in (songs, missing, own, holes, unclear):
        out = out.join(part, "concert_id", "left")
    out = out.na.fill(0)
    ready = (F.col("missing") == 0) & (F.col("unresolved_candidate_count") == 0) & (F.col("unresolved_gap_count") == 0)
    return out.select("concert_id", (F.col("songs") - F.col("missing")).alias("song_scan_count"), F.col("missing").alias("missing_song_scans"), "candidate_count", "unresolved_candidate_count", "timeline_gap_count", "timeline_gap_seconds", "unresolved_gap_count", ready.alias("ready"))


def fill_timeline(sections: DataFrame, concerts: DataFrame) -> DataFrame:
    """Sections and a transition in every gap, numbered by kind. error: overlap or out_of_range."""
    previous = F.lag("end").over(_in_time())
    placed = sections.join(concerts, "concert_id").withColumn("_p", F.coalesce(previous, F.lit(0.0)))
    error = F.when((F.col("start") < 0) | (F.col("end") > F.col("duration")), "out_of_range").when(F.col("start") < F.col("_p") - 0.001, "overlap")
    own = placed.select("concert_id", "section_id", F.col("type").alias("kind"), "start", "end", error.alias("error"))
    none = F.lit(None).cast(sections.schema["section_id"].dataType)
    hole = placed.where(F.col("start") > F.col("_p")).select("concert_id", none.alias("section_id"), F.lit("transition").alias("kind"), F.col("_p").alias("start"), F.col("start").alias("end"), F.lit(None).cast("string").alias("error"))
    last = concerts.join(sections.groupBy("concert_id").agg(F.max_by("end", F.struct("start", "end", "section_id")).alias("_p")), "concert_id").where("duration > _p")
    tail = last.select("concert_id", none.alias("section_id"), F.lit("transition").alias("kind"), F.col("_p").alias("start"), F.col("duration").alias("end"), F.lit(None).cast("string").alias("error"))
    every = own.unionByName(hole).unionByName(tail)
    number = F.row_number().over(Window.partitionBy("concert_id", "kind").orderBy("start", "end", "section_id"))
    return every.withColumn("label", F.format_string("%s %d", "kind", number))


def global_overlap(absolute: DataFrame) -> DataFrame:
    """Neighbouring cues of a concert that overlap, with how much."""
    w = Window.partitionBy("concert_id").orderBy("start", "section_id", "pos")
    out = absolute.withColumn("overlap", F.lag("end").over(w) - F.col("start"))
    return out.where(F.col("overlap") > 0.001)


def section_ids(sections: DataFrame, concerts: DataFrame, context: float = 20.0) -> DataFrame:
    """Ids such as song03, and the context around each section."""
    number = F.row_number().over(Window.partitionBy("concert_id", "type").orderBy("start", "section_id"))
    named = sections.withColumn("id", F.format_string("%s%02d", "type", number))
    return named.join(concerts, "concert_id").select("concert_id", "section_id", "id", F.greatest(F.lit(0.0), F.col("start") - context).alias("context_start"), F.least("duration", F.col("end") + context).alias("context_end"))


def neighbor_contract(sections: DataFrame) -> DataFrame:
    """Bounds of the previous and the next section, and a hash that changes when one of them moves."""
    w = Window.partitionBy("concert_id").orderBy("start", "section_id")
    out = sections.select("concert_id", "section_id", "start", "end", F.lag("end").over(w).alias("previous_end"), F.lead("start").over(w).alias("next_start"))
    parts = [F.coalesce(F.floor(F.col(c) * 1000 + 0.5).cast("string"), F.lit("none")) for c in ("start", "end", "previous_end", "next_start")]
    return out.withColumn("contract", F.md5(F.concat_ws("|", *parts)))


def with_neighbors(sections: DataFrame, selected: Column) -> DataFrame:
    """The selected sections and those beside them."""
    w = Window.partitionBy("concert_id").orderBy("start", "section_id").rowsBetween(-1, 1)
    return sections.withColumn("_s", F.max(F.when(selected, 1).otherwise(0)).over(w)).where("_s = 1").drop("_s")


def latest_status(history: DataFrame) -> DataFrame:
    """The last status of each section."""
    return history.groupBy("concert_id", "section_id").agg(F.max_by("status", F.struct("at", "seq")).alias("status"))


def status_summary(sections: DataFrame, history: DataFrame) -> DataFrame:
    """Sections by latest status in each concert; those without history are missing."""
    out = sections.select("concert_id", "section_id").join(latest_status(history), ["concert_id", "section_id"], "left")
    return out.groupBy("concert_id", F.coalesce("status", F.lit("missing")).alias("status")).agg(F.count("*").alias("n"))


def merge_intervals(windows: DataFrame, key: str = "concert_id", join: float = 0.01) -> DataFrame:
    """Windows (start, end) of a key that touch become one."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") <= reach + join, 0).otherwise(1)
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return windows.withColumn("_new", new).withColumn("_island", island).groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def review_windows(sections: DataFrame) -> DataFrame:
    """The first 4, middle 1.5 and last 2 seconds of each section, where they last 0.2 at least."""
    mid = (F.col("start") + F.col("end")) / 2
    parts = F.array(
        F.struct(F.col("start").alias("a"), F.least("end", F.col("start") + 4.0).alias("b")),
        F.struct(F.greatest("start", mid - 0.75).alias("a"), F.least("end", mid + 0.75).alias("b")),
        F.struct(F.greatest("start", F.col("end") - 2.0).alias("a"), F.col("end").alias("b")),
    )
    out = sections.select("concert_id", F.explode(parts).alias("p")).select("concert_id", F.col("p.a").alias("start"), F.col("p.b").alias("end"))
    return out.where(F.col("end") - F.col("start") >= 0.2)


def _weighed(sections: DataFrame) -> DataFrame:
    """Sections with the bar's weight of each, the running and the total weight, number and place."""
    w = Window.partitionBy("concert_id").orderBy("start", "section_id")
    whole = Window.partitionBy("concert_id")
    seconds = F.col("end") - F.col("start")
    songs = sections.where("type = 'song'").groupBy("concert_id").agg(F.percentile(seconds, F.lit(0.5)).alias("median"))
    weight = F.when(F.col("type") == "mc", F.least(seconds * 3.0, F.coalesce(F.col("median") * 1.2, seconds * 3.0))).otherwise(seconds)
    return sections.join(songs, "concert_id", "left").withColumn("weight", weight).withColumns({"n": F.count("*").over(whole), "total": F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "i": F.row_number().over(w) - 1, "run": F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0))}).withColumn("gap", F.when(F.col("n") <= 30, 4).otherwise(2))


def _cell(room: Column, share: Column) -> Column:
    """The pixel at which a share of the room ends, rounded to even."""
    return F.rint(room * share).cast("long")


def duration_bounds(sections: DataFrame, width: int = 1200) -> DataFrame:
    """Pixel edges of each section in a bar: weights are durations (MC three times, at most 1.2 of the
    songs' median), gaps 4 pixels up to 30 sections and 2 beyond."""
    room = F.lit(width) - F.col("gap") * (F.col("n") - 1)
    edge = lambda x: _cell(room, x / F.col("total")) + F.col("gap") * F.col("i")
    return _weighed(sections).select("concert_id", "section_id", edge(F.col("run") - F.col("weight")).alias("x0"), edge(F.col("run")).alias("x1"))


def progress_rows(sections: DataFrame, width: int = 1200, most: int = 80) -> DataFrame:
    """What the bar of each concert shows while each of its sections (active_id) runs: concert_id, active_id,
    active_from, active_to, layer, section_id, x0, x1, state, scale.

    Layer 10 has a cell for each section (played, active or unplayed), 11 the fill of the active one, 12 its label
    with its width in percent. sections: concert_id, section_id, type, start, end, label. The active cell grows to
    hold its label; the others then keep one pixel and share the rest by weight. A concert with more sections than a
    bar may have gives one row, with the state too_many_sections."""
    cells = _weighed(sections)
    fits = cells.where(F.col("n") <= most)
    a = fits.select("concert_id", F.col("section_id").alias("active_id"), F.col("start").alias("active_from"), F.col("end").alias("active_to"), F.col("i").alias("_i"), F.col("weight").alias("_w"), F.col("run").alias("_run"), T.label_width("label").cast("long").alias("_asked"))
    j = a.join(fits.select("concert_id", "section_id", "i", "n", "gap", "weight", "run", "total"), "concert_id")
    room = F.lit(width) - F.col("gap") * (F.col("n") - 1)
    own = _cell(room, F.col("_run") / F.col("total")) - _cell(room, (F.col("_run") - F.col("_w")) / F.col("total"))
    current = F.least(F.greatest("_asked", own), room - (F.col("n") - 1))
    j = j.withColumns({"_room": room, "_own": own}).withColumn("_current", current)
    # before the place: the weight and the number of the other cells
    behind = F.col("i") > F.col("_i")
    others = F.col("run") - F.col("weight") - F.when(behind, F.col("_w")).otherwise(0.0)
    left = F.col("_room") - F.col("_current") - (F.col("n") - 1)
    share = lambda x: _cell(left, x / F.nullif(F.col("total") - F.col("_w"), F.lit(0.0)))
    start = F.coalesce(share(others), F.lit(0)) + F.col("i") - behind.cast("int") + F.when(behind, F.col("_current")).otherwise(0)
    size = F.when(F.col("i") == F.col("_i"), F.col("_current")).otherwise(1 + share(others + F.col("weight")) - share(others))
    plain = lambda x: _cell(F.col("_room"), x / F.col("total"))
    grown = F.col("_current") > F.col("_own")
    x0 = F.when(grown, start).otherwise(plain(F.col("run") - F.col("weight"))) + F.col("gap") * F.col("i")
    x1 = F.when(grown, start + size).otherwise(plain(F.col("run"))) + F.col("gap") * F.col("i")
    state = F.when(F.col("i") == F.col("_i"), "active").when(F.col("i") < F.col("_i"), "played").otherwise("unplayed")
    keys = ["concert_id", "active_id", "active_from", "active_to"]
    drawn = j.select(*keys, F.lit(10).alias("layer"), "section_id", x0.cast("long").alias("x0"), x1.cast("long").alias("x1"), state.alias("state"), "_asked")
    shown = drawn.where("state = 'active'")
    scale = F.least(F.lit(100.0), F.greatest(F.lit(1), F.col("x1") - F.col("x0") - 16) / F.greatest(F.lit(1), F.col("_asked") - 16) * 100)
    fill = shown.withColumns({"layer": F.lit(11), "state": F.lit("fill")})
    label = shown.withColumns({"scale": scale, "layer": F.lit(12), "state": F.lit("label"), "x0": F.col("x0") + 8})
    crowded = cells.where(F.col("n") > most).select("concert_id").distinct().withColumns({"layer": F.lit(10), "state": F.lit("too_many_sections")})
    out = drawn.unionByName(fill).unionByName(label, allowMissingColumns=True).unionByName(crowded, allowMissingColumns=True)
    return out.select(*keys, "layer", "section_id", "x0", "x1", "state", "scale")


def section_errors(sections: DataFrame, concerts: DataFrame) -> DataFrame:
    """Code for each broken section: bad_interval, outside_concert, duplicate_id, overlap."""
    w = Window.partitionBy("concert_id").orderBy("start", "section_id")
    out = sections.join(concerts, "concert_id").withColumns({"_previous": F.lag("end").over(w), "_same": F.count("*").over(Window.partitionBy("concert_id", "section_id"))})
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    codes = F.array(
        F.when(~(finite("start") & finite("end")) | (F.col("start") >= F.col("end")), "bad_interval"),
        F.when((F.col("start") < 0) | (F.col("end") > F.col("duration") + 0.001), "outside_concert"),
        F.when(F.col("_same") > 1, "duplicate_id"),
        F.when(F.col("start") < F.col("_previous") - 0.001, "overlap"),
    )
    return out.select("concert_id", "section_id", F.explode(F.array_compact(codes)).alias("code"))
