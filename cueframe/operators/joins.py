"""Joins by time: overlap, containment, nearest, position. The key of the recording is always an equi key;
ranges are met on nodes of a time tree, so a section never meets itself as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import round3

#: Seconds of a leaf of the time tree, children of a node (a power of two) and levels above the leaves.
LEAF, CHILDREN, LEVELS = 60.0, 8, 4


def cover(first: Column, last: Column, children: int = CHILDREN, levels: int = LEVELS) -> Column:
    """The fewest nodes (level, node) of the time tree that hold the leaves from first to last: at each level what does
    not fill a parent; the highest level has no parents."""
    start = F.struct(first.cast("long").alias("low"), (last + 1).cast("long").alias("high"), F.array().cast("array<struct<level:int,node:bigint>>").alias("nodes"))

    def nodes(low: Column, high: Column, level: Column) -> Column:
        run = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(run, lambda x: F.struct(level.cast("int").alias("level"), x.alias("node")))

    def step(acc: Column, level: Column) -> Column:
        low, high = acc["low"], acc["high"]
        up, down = F.ceil(low / children).cast("long"), F.floor(high / children).cast("long")
        part = (up < down) & (level < levels)
        here = F.when(part, F.concat(nodes(low, up * children, level), nodes(down * children, high, level))).otherwise(nodes(low, high, level))
        return F.struct(F.when(part, up).otherwise(0).alias("low"), F.when(part, down).otherwise(0).alias("high"), F.concat(acc["nodes"], here).alias("nodes"))

    many = F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda acc: acc["nodes"])
    return F.when(first == last, F.array(F.struct(F.lit(0).alias("level"), first.cast("long").alias("node")))).otherwise(many)


def above(nodes: Column) -> Column:
    """All nodes above the given ones."""
    parents = F.transform(nodes, lambda x: F.transform(F.sequence(F.lit(1), F.lit(LEVELS)), lambda k: F.when(k > x["level"], F.struct(k.alias("level"), F.floor(x["node"] / F.pow(F.lit(float(CHILDREN)), k - x["level"])).cast("long").alias("node")))))
    return F.array_distinct(F.filter(F.flatten(parents), lambda x: x.isNotNull()))


def overlapping(left: DataFrame, right: DataFrame, key: str, margin: float = 0.0, leaf: float = LEAF) -> DataFrame:
    """Pairs whose intervals (start, end) lie within `margin` of each other; left columns, and right ones with the
    prefix r_.

    Intervals stand on nodes of a time tree, a logarithmic number each, however long they are. Two overlap if a
    node of one is a node of the other or lies above one. A pair that meets at several nodes is taken at the one that
    holds the later start."""

    def placed(d: DataFrame, start: Column, end: Column, own_first: bool) -> DataFrame:
        d = d.withColumn("_nodes", cover(F.floor(start / leaf), F.floor(F.greatest(start, end) / leaf)))
        d = d.withColumn("_above", above(F.col("_nodes")))
        mark = lambda nodes, own: F.transform(nodes, lambda x: F.struct(F.lit(own).alias("own"), x["level"].alias("level"), x["node"].alias("node")))
        # left: its own nodes, and those above it; right: what may lie at or above it, and its own
        at = F.concat(mark(F.col("_nodes"), True), mark(F.col("_above"), False)) if own_first else F.concat(mark(F.concat("_nodes", "_above"), True), mark(F.col("_nodes"), False))
        return d.withColumn("_at", F.explode(at)).drop("_nodes", "_above")

    others = [c for c in right.columns if c != key]
    a = placed(left, F.col("start") - margin, F.col("end") + margin, True).withColumns({"_own": F.col("_at.own"), "_level": F.col("_at.level"), "_node": F.col("_at.node")}).drop("_at")
    b = placed(right.select(F.col(key).alias("_k"), *[F.col(c).alias(f"r_{c}") for c in others]), F.col("r_start"), F.col("r_end"), False)
    b = b.select("_k", F.col("_at.own").alias("_o"), F.col("_at.level").alias("_l"), F.col("_at.node").alias("_n"), *[f"r_{c}" for c in others])
    met = (F.col(key) == F.col("_k")) & (F.col("_own") == F.col("_o")) & (F.col("_level") == F.col("_l")) & (F.col("_node") == F.col("_n"))
    later = F.floor(F.floor(F.greatest(F.col("start") - margin, F.col("r_start")) / leaf) / F.pow(F.lit(float(CHILDREN)), F.col("_level"))) == F.col("_node")
    near = (F.col("r_end") >= F.col("start") - margin) & (F.col("r_start") <= F.col("end") + margin)
    return a.join(b, met & near & later).drop("_k", "_own", "_level", "_node", "_o", "_l", "_n")


#: The tree where one side are points: few levels, as a point stands on each of them.
POINT_CHILDREN, POINT_LEVELS = 64, 2


def holding(left: DataFrame, right: DataFrame, key: str, margin: float = 0.0, leaf: float = LEAF) -> DataFrame:
    """Pairs of intervals (start, end) in which the left one holds the right one, but for `margin` at either edge; columns
    as those of overlapping(), and the pairs that it has of these.

    What is held begins inside the other: it stands with its start alone, at one node of each level, and
    meets an interval that holds it at one of the nodes that cover the interval."""
    first, last = F.floor((F.col("start") - margin) / leaf), F.floor((F.col("end") + margin) / leaf)
    a = left.where(F.col("end") + margin >= F.col("start") - margin).withColumn("_at", F.explode(cover(first, last, POINT_CHILDREN, POINT_LEVELS)))
    a = a.withColumns({"_level": F.col("_at.level"), "_node": F.col("_at.node")}).drop("_at")
    place = F.floor(F.col("r_start") / leaf)
    at = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(place / POINT_CHILDREN**k).cast("long").alias("node")) for k in range(POINT_LEVELS + 1)])
    others = [c for c in right.columns if c != key]
    b = right.select(F.col(key).alias("_k"), *[F.col(c).alias(f"r_{c}") for c in others]).withColumn("_to", F.explode(at))
    b = b.select("_k", F.col("_to.level").alias("_l"), F.col("_to.node").alias("_n"), *[f"r_{c}" for c in others])
    met = (F.col(key) == F.col("_k")) & (F.col("_level") == F.col("_l")) & (F.col("_node") == F.col("_n"))
    near = (F.col("r_end") >= F.col("start") - margin) & (F.col("r_start") <= F.col("end") + margin)
    held = (F.col("r_start") >= F.col("start") - margin) & (F.col("r_end") <= F.col("end") + margin)
    return a.join(b, met & near & held).drop("_k", "_level", "_node", "_l", "_n")


def to_absolute(cues: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cues in concert time with their section's type, and those outside their section."""
    s = sections.select("concert_id", "section_id", F.col("type").alias("section_kind"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    out = cues.join(s, "section_id").withColumns({"start": F.col("start") + F.col("_s"), "end": F.col("end") + F.col("_s")})
    bad = (F.col("start") < F.col("_s") - 0.001) | (F.col("end") > F.col("_e") + 0.001) | (F.col("start") >= F.col("end"))
    return out.where(~bad).drop("_s", "_e"), out.where(bad).drop("_s", "_e")


def approval_chain(sections: DataFrame, package: DataFrame, status: DataFrame, gate: DataFrame, decision: DataFrame, assessment: DataFrame) -> DataFrame:
    """For each section the first rule of the approval chain that fails, or null. All six tables have
    section_id; the joins share one key and so one shuffle."""
    j = sections
    for part in (package, status, gate, decision, assessment):
        j = j.join(part, "section_id", "left")
    mc = F.col("type") == "mc"
    fault = (
        F.when(F.col("package_hash").isNull() | ~F.col("package_hash").eqNullSafe(F.col("section_hash")), "manifest_changed")
        .when(~F.col("status").eqNullSafe(F.lit("approved")), "not_approved")
        .when(~F.col("decision").eqNullSafe(F.lit("accept")) | ~F.col("decided_hash").eqNullSafe(F.col("gate_hash")), "bad_decision")
        .when(mc & ~F.col("assessed_hash").eqNullSafe(F.col("decided_assessment")), "assessment_changed")
        .when(F.coalesce("n_events", F.lit(0)) == 0, "missing_events")
        .when(~F.col("result_hash").eqNullSafe(F.col("gate_hash")), "result_changed")
    )
    return j.select("concert_id", "section_id", fault.alias("fault"))


def package_mismatches(sections: DataFrame, packages: DataFrame, fields: list[str]) -> DataFrame:
    """Names of the fields in which a package differs from its section."""
    p = packages.select("section_id", *[F.col(f).alias(f"_{f}") for f in fields])
    names = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]))
    return sections.join(p, "section_id").select("section_id", names.alias("fields")).where(F.size("fields") > 0)


def contained_in_gap(segments: DataFrame, gaps: DataFrame, margin: float = 0.15) -> DataFrame:
    """Each segment with the first gap that holds it, margins aside."""
    j = overlapping(segments, gaps, "section_id").where((F.col("start") >= F.col("r_start") + margin) & (F.col("end") <= F.col("r_end") - margin))
    first = F.min(F.struct("r_start", "r_end"))
    return j.groupBy("section_id", "id").agg(first.alias("g")).select("section_id", "id", F.col("g.r_start").alias("gap_start"), F.col("g.r_end").alias("gap_end"))


def speech_candidates(segments: DataFrame, lyrics: DataFrame, gaps: DataFrame, similarity: str | None = None) -> DataFrame:
    """Transcript segments (section_id, id, start, end, text, probability) that are no lyrics (section_id,
    start, end, text): their location, overlap and confidence. Each pair within 8 seconds is compared once,
    after length and duration have been asked for; sections without lyrics give nothing."""
    flat = segments.withColumn("_text", T.norm_layout(F.trim(F.coalesce("text", F.lit("")))))
    good = flat.where((F.col("end") - F.col("start") >= 0.45) & (F.length("_text") >= 4))
    bounds = lyrics.groupBy("section_id").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    # each text is normalised once, not for each pair
    near = overlapping(good.select("section_id", "id", "start", "end", "_text"), lyrics.select("section_id", "start", "end", T.norm_layout(F.col("text")).alias("n")), "section_id", 8.0)
    shared = F.greatest(F.lit(0.0), F.least("end", "r_end") - F.greatest("start", "r_start"))
    score = T.ratio(F.col("_text"), F.col("r_n"), junk=True)
    sums = near.withColumn("_sim", score).groupBy("section_id", "id").agg(F.sum(shared).alias("shared"), F.max("_sim").alias("similarity"))
    held = contained_in_gap(good, gaps).select("section_id", "id", F.lit(True).alias("in_gap"))
    j = good.join(bounds, "section_id").join(sums, ["section_id", "id"], "left").join(held, ["section_id", "id"], "left")
    ratio = F.least(F.lit(1.0), F.coalesce("shared", F.lit(0.0)) / (F.col("end") - F.col("start")))
    where = (
        F.when(F.col("end") <= F.col("first") - 0.25, "prelude")
        .when(F.col("start") >= F.col("last") + 0.25, "coda")
        .when(F.col("in_gap"), "instrumental_gap")
        .when(ratio <= 0.2, "uncovered_gap")
    )
    sim = F.coalesce("similarity", F.lit(0.0))
    told = F.coalesce(F.greatest(F.lit(-0.12), F.least(F.lit(0.1), (F.col("probability") - 0.65) * 0.4)), F.lit(0.0))
    sure = F.lit(0.72) + F.when(where == "uncovered_gap", 0.0).otherwise(0.12) + told + F.greatest(F.lit(0.0), 0.48 - sim) * 0.08
    out = j.withColumns({"location": where, "overlap_ratio": ratio, "similarity": sim, "confidence": F.greatest(F.lit(0.0), F.least(F.lit(0.99), sure))})
    out = out.where(F.col("location").isNotNull() & (sim < 0.48))
    return out.select("section_id", "id", round3(F.col("start")).alias("start"), round3(F.col("end")).alias("end"), "location", round3(F.col("overlap_ratio")).alias("overlap_ratio"), round3(F.col("similarity")).alias("similarity"), round3(F.col("confidence")).alias("confidence"))


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, order: str, tolerance: int) -> DataFrame:
    """Left rows (key, at, order) with the nearest right row (key, at, order) within the tolerance; of
    equally near ones the earliest in order. Times meet in buckets as wide as the tolerance."""
    width = max(1, tolerance)
    # rows that repeat are one here, and each is returned
    a = left.groupBy(*left.columns).agg(F.count("*").alias("_times")).withColumn("_b", F.explode(F.array(*[F.floor(F.col(at) / width) + d for d in (-1, 0, 1)])))
    b = right.select(F.col(key).alias("_k"), F.floor(F.col(at) / width).alias("_c"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key])
    near = a.join(b, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")) & (F.abs(F.col(at) - F.col(f"r_{at}")) <= tolerance))
    others = [c for c in right.columns if c != key]
    best = near.groupBy(*left.columns).agg(F.min_by(F.struct(*[f"r_{c}" for c in others]), F.struct(F.abs(F.col(at) - F.col(f"r_{at}")), F.col(f"r_{order}"))).alias("_m"), F.first("_times").alias("_times"))
    every = best.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return every.select(*left.columns, *[F.col(f"_m.r_{c}").alias(f"r_{c}") for c in others])


def matching_segments(cues: DataFrame, segments: DataFrame, margin: float = 0.05) -> DataFrame:
    """Segments inside a cue, margin aside."""
    return holding(cues, segments, "section_id", margin)


def phone_lines(phones: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phones (track_id, n, start, end, phone; silences among them) laid on the phones that the lines
    (track_id, line, phones) expect, by position. Returns line times, and the first mismatch by track."""
    # both sides are dealt by their track, so they meet as rows of one table in order of place, where a join would deal each
    # phone anew; a line is one row, before the phones from its first place on
    alone = lambda side: F.when(F.col("track_id").isNull(), F.lit(side))  # noqa: E731 (nothing meets without a track)
    heard = phones.where(~F.col("phone").isin("AP", "SP"))
    heard = heard.select("track_id", alone(1).alias("_alone"), F.row_number().over(Window.partitionBy("track_id").orderBy("n")).alias("i"), "start", "end", "phone")
    many = F.sum(F.size("phones")).over(Window.partitionBy("track_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    said = lines.where(F.size("phones") > 0).withColumn("i", (many - F.size("phones") + 1).cast("int"))
    said = said.select("track_id", alone(0).alias("_alone"), "i", F.struct("line", "phones", F.col("i").alias("first")).alias("_line"))
    order = Window.partitionBy("track_id", "_alone").orderBy("i", F.col("_line").isNull())
    rows = said.unionByName(heard, allowMissingColumns=True).withColumn("_in", F.last("_line", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place, size = F.col("i") - F.col("_in.first"), F.size("_in.phones")
    is_line, inside = F.col("_line").isNotNull(), F.col("_line").isNull() & (place < size)

    at = F.when(inside, F.col("i"))
    lost = F.sum(F.when(is_line, size).otherwise(0)) - F.count(at)
    timed = rows.where(F.col("_in.line").isNotNull() & (is_line | inside)).groupBy("track_id", F.col("_in.line").alias("line"))
    # what is heard are the first places, so a line of which phones are lost has lost its last one
    timed = timed.agg(F.min_by("start", at).alias("start"), F.max_by("end", at).alias("_end"), F.coalesce(lost, F.lit(0)).alias("lost"))
    timed = timed.select("track_id", "line", "start", F.when(F.col("lost") == 0, F.col("_end")).alias("end"), "lost")

    # a heard phone that no line expects, or another one; then the first expected one behind the last that is heard
    other = F.when(inside, ~F.get("_in.phones", place).eqNullSafe(F.col("phone"))).otherwise(~is_line)
    spoken = F.count(F.when(~is_line, 1)).over(Window.partitionBy("track_id", "_alone"))
    rest = F.transform("_in.phones", lambda x, k: F.when((F.col("_in.first") + k > F.col("_spoken")) & x.isNotNull(), F.col("_in.first") + k))
    wrong = rows.withColumn("_spoken", spoken).select("track_id", F.when(is_line, F.array_min(rest)).when(F.coalesce(other, F.lit(True)), F.col("i")).alias("_i"))
    return timed, wrong.groupBy("track_id").agg(F.min("_i").cast("int").alias("first_mismatch")).where("first_mismatch IS NOT NULL")


def clip_to_window(cues: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Cues that reach into a window (key, window_id, start, end), cut and counted from its start."""
    j = overlapping(cues, windows, key).where((F.col("r_end") > F.col("start")) & (F.col("r_start") < F.col("end")))
    return j.withColumns({"start": F.greatest("start", "r_start") - F.col("r_start"), "end": F.least("end", "r_end") - F.col("r_start")}).drop("r_start", "r_end")


def overlay_edits(rows: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (track_id, line, text, value) with sparse edits (track_id, line, text, value) laid over, and
    edits that do not apply: unknown line, changed text, blank value, or one of several for a line."""
    n = F.count("*").over(Window.partitionBy("track_id", "line"))
    e = edits.select("track_id", "line", F.col("text").alias("_t"), F.col("value").alias("_v"), n.alias("_n"))
    j = e.join(rows.select("track_id", "line", "text"), ["track_id", "line"], "left")
    code = F.when(F.col("_n") > 1, "duplicate").when(F.col("text").isNull(), "unknown_line").when(F.col("text") != F.col("_t"), "text_changed").when(F.trim(F.coalesce("_v", F.lit(""))) == "", "blank")
    checked = j.withColumn("code", code)
    good = checked.where("code IS NULL").select("track_id", "line", "_v")
    out = rows.join(good, ["track_id", "line"], "left").withColumn("value", F.coalesce("_v", "value")).drop("_v")
    return out, checked.where("code IS NOT NULL").select("track_id", "line", "code")


#: A prime, and a base of polynomials modulo it.
PRIME, BASE = 2147483647, 1318926965


def _power(exponent: Column) -> Column:
    """BASE ** exponent modulo PRIME, for exponents below 2**42, six bits at once."""
    out, base = F.lit(1).cast("long"), BASE
    for shift in range(0, 42, 6):
        powers = F.split(F.lit(" ".join(str(pow(base, k, PRIME)) for k in range(64))), " ").cast("array<bigint>")  # one literal, folded once
        out = out * F.get(powers, F.shiftright(exponent, shift).bitwiseAND(63).cast("int")) % PRIME
        base = pow(base, 64, PRIME)
    return out


def _rolled(rows: DataFrame) -> DataFrame:
    """rows (track_id, _i from 0, _t) with _a and _b: the polynomials of two hashes of the texts up to this one."""
    w = Window.partitionBy("track_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    powers = rows.withColumn("_power", _power(F.col("_i")))
    term = lambda salt: F.pmod(F.xxhash64("_t", F.lit(salt)), F.lit(PRIME)) * F.col("_power") % PRIME
    return powers.withColumns({f"_{s}": F.sum(term(s)).over(w) % PRIME for s in "ab"})


def timing_reference_match(expected: DataFrame, reference: DataFrame) -> DataFrame:
    """Where the whole expected run (track_id, pos, text, start) stands in the reference (track_id, pos,
    text, start, end) as a contiguous run; of several places the one that begins nearest, then first.

    Runs are found by a rolling hash over as many consecutive texts as are expected, two of them with hashes of
    their own, so lines that come again make no pairs; the texts of the run that is taken are then compared."""
    by_place = Window.partitionBy("track_id").orderBy("pos")
    place = (F.row_number().over(by_place) - 1).cast("long")
    e = expected.select("track_id", "pos", "start", T.norm_match(F.coalesce(F.col("text"), F.lit(""))).alias("_t"), place.alias("_i"))
    r = reference.select("track_id", F.col("pos").alias("ref_pos"), F.col("start").alias("ref_start"), F.col("end").alias("ref_end"), T.norm_match(F.coalesce(F.col("text"), F.lit(""))).alias("_t"), place.alias("_i"))
    want = _rolled(e).groupBy("track_id").agg(F.max("_i").alias("_last"), *[F.max_by(f"_{s}", "_i").alias(f"_want_{s}") for s in "ab"], F.max(F.when(F.col("_i") == 0, F.col("start"))).alias("_s"))
    sums = _rolled(r)
    # what stands before a run: the sums of the row before
    before = [F.coalesce(F.lag(f"_{s}").over(Window.partitionBy("track_id").orderBy("_i")), F.lit(0)).alias(f"_before_{s}") for s in "ab"]
    starts = sums.select("track_id", "_i", "_power", "ref_start", *before).join(want, "track_id").withColumn("_e", F.col("_i") + F.col("_last"))
    ends = sums.select("track_id", F.col("_i").alias("_e"), "_a", "_b")
    same = lambda s: F.pmod(F.col(f"_{s}") - F.col(f"_before_{s}"), F.lit(PRIME)) == F.col(f"_want_{s}") * F.col("_power") % PRIME
    near = starts.join(ends, ["track_id", "_e"]).where(same("a") & same("b"))
    best = near.groupBy("track_id").agg(F.min(F.struct(F.abs(F.col("ref_start") - F.col("_s")), "_i")).alias("_b")).select("track_id", F.col("_b._i").alias("_from"))
    run = e.join(best, "track_id").withColumn("_at", F.col("_i") + F.col("_from"))
    met = run.join(r.select("track_id", F.col("_i").alias("_at"), F.col("_t").alias("_rt"), "ref_pos", "ref_start", "ref_end"), ["track_id", "_at"])
    whole = F.min(F.col("_t") == F.col("_rt")).over(Window.partitionBy("track_id"))
    return met.withColumn("_whole", whole).where("_whole").select("track_id", "pos", "ref_pos", "ref_start", "ref_end", (F.col("ref_start") - F.col("start")).alias("start_delta"))


def import_timings(matches: DataFrame, cues: DataFrame, spans: DataFrame) -> DataFrame:
    """Matched reference times (track_id, pos, ref_start, ref_end, of J15) on the clock of the section, beside
    the cues (track_id, pos, start, end). spans: track_id, shift (what is added to a reference time: minus the
    section's start, or a clip's start), duration. code: imported_time_outside_section; accepted: no cue of the
    track has it."""
    t = matches.select("track_id", "pos", "ref_start", "ref_end").join(cues.select("track_id", "pos", "start", "end"), ["track_id", "pos"]).join(spans.select("track_id", "shift", "duration"), "track_id")
    t = t.withColumns({"_s": F.col("ref_start") + F.col("shift"), "_e": F.col("ref_end") + F.col("shift")})
    outside = (F.col("_s") < 0) | (F.col("_e") <= F.col("_s")) | (F.col("_e") > F.col("duration"))
    micro = lambda x: F.floor(x * 1000000 + 0.5) / 1000000
    out = t.select("track_id", "pos", "start", "end", micro(F.col("_s")).alias("imported_start"), micro(F.col("_e")).alias("imported_end"), micro(F.col("_s") - F.col("start")).alias("start_adjustment"), micro(F.col("_e") - F.col("end")).alias("end_adjustment"), F.when(outside, "imported_time_outside_section").alias("code"))
    return out.withColumn("accepted", F.count("code").over(Window.partitionBy("track_id")) == 0)


def propagate_timing(samples: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Deltas of a representative occurrence (group_id, offset, text, risks, start_delta, end_delta, duration; null
    deltas where nothing was imported) carried to the same place of others (group_id, occurrence, offset, text, start,
    end, duration, risks and mapping, the faults of the occurrence's rhythm), scaled by their length. start_reasons
    and end_reasons tell why an edge must not be moved; eligible: neither has one."""
    s = samples.select("group_id", "offset", F.col("text").alias("_t"), F.col("risks").alias("_risks"), "start_delta", "end_delta", F.col("duration").alias("_d"))
    j = occurrences.join(s, ["group_id", "offset"], "left")
    known = F.col("start_delta").isNotNull() & F.col("end_delta").isNotNull()
    scale = F.coalesce(F.col("duration") / F.col("_d"), F.lit(1.0))
    empty = F.array().cast("array<string>")
    shared = F.concat(
        F.coalesce("mapping", empty),
        F.when(~F.col("text").eqNullSafe(F.col("_t")), F.array(F.lit("text_mismatch"))).otherwise(empty),
        F.coalesce("_risks", empty), F.coalesce("risks", empty),
        F.when(~known, F.array(F.lit("representative_boundary_not_imported"))).otherwise(empty),
    )
    out = j.withColumn("_shared", shared)
    for edge in ("start", "end"):
        moved = F.when(known, F.col(f"{edge}_delta") * scale).otherwise(0.0)
        out = out.withColumn(f"new_{edge}", F.col(edge) + moved)
        far = F.when(F.abs(F.col(f"new_{edge}") - F.col(edge)) > 0.75, F.array(F.lit(f"{edge}_adjustment_exceeds_0_75_seconds"))).otherwise(empty)
        out = out.withColumn(f"{edge}_reasons", F.array_distinct(F.concat("_shared", far)))
    return out.select("group_id", "occurrence", "offset", "new_start", "new_end", "start_reasons", "end_reasons", ((F.size("start_reasons") == 0) & (F.size("end_reasons") == 0)).alias("eligible"))


def interpolate(times: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """Times (key, at) carried through anchors (key, x, y) with increasing x; outside them null.

    Times and anchors stand in one order of their key, where each time looks to the last anchor before it and the
    first behind it: no pairs are made."""
    rows = times.select(*times.columns, F.col("at").alias("_at"))
    marks = anchors.select(F.col(key), F.col("x").cast("double").alias("_at"), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("_p"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    # an anchor at a time's own place stands on both sides of it
    w = Window.partitionBy(key).orderBy("_at")
    before = F.last("_p", True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_p", True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    a, b = F.col("_a"), F.col("_b")
    value = F.when(a["x"] == b["x"], a["y"]).otherwise(a["y"] + (F.col("at") - a["x"]) / (b["x"] - a["x"]) * (b["y"] - a["y"]))
    # one anchor alone carries nothing
    many = F.count("_p").over(Window.partitionBy(key)) > 1
    found = both.withColumns({"_a": before, "_b": after, "_many": many}).where("_p IS NULL")
    return found.withColumn("value", F.when(F.col("_many") & a.isNotNull() & b.isNotNull(), value)).select(*times.columns, "value")


def structure_transfer(lines: DataFrame, parts: DataFrame, reference_cycle: str) -> DataFrame:
    """Reviewed times of one cycle carried to the others, part by part and line by line.
    lines: track_id, cycle, part, offset, start, end (times of the reference cycle are reviewed).
    parts: track_id, cycle, part, role, beats, n_lines, complete, start, end."""
    ref = parts.where(F.col("cycle") == reference_cycle).select("track_id", "part", *[F.col(c).alias(f"_{c}") for c in ("role", "beats", "n_lines", "complete", "start", "end")])
    pair = parts.where(F.col("cycle") != reference_cycle).join(ref, ["track_id", "part"], "left")
    reason = (
        F.when(F.col("_role").isNull(), "no_reference_part").when(F.col("role") != F.col("_role"), "role").when(F.col("beats") != F.col("_beats"), "beats")
        .when(F.col("n_lines") != F.col("_n_lines"), "line_count").when(~F.col("complete") | ~F.col("_complete"), "incomplete")
    )
    pair = pair.select("track_id", "cycle", "part", reason.alias("reason"), ((F.col("end") - F.col("start")) / (F.col("_end") - F.col("_start"))).alias("scale"), F.col("start").alias("to"), F.col("_start").alias("from"))
    reviewed = lines.where(F.col("cycle") == reference_cycle).select("track_id", "part", "offset", F.col("start").alias("a"), F.col("end").alias("b"))
    own = lines.where(F.col("cycle") != reference_cycle).select("track_id", "cycle", "part", "offset")
    j = own.join(pair, ["track_id", "cycle", "part"], "left").join(reviewed, ["track_id", "part", "offset"], "left")
    carried = lambda x: F.when(F.col("reason").isNull(), F.col("to") + (F.col(x) - F.col("from")) * F.col("scale"))
    out = j.select("track_id", "cycle", "part", "offset", carried("a").alias("start"), carried("b").alias("end"), "reason")
    w = Window.partitionBy("track_id").orderBy("start", "cycle", "part", "offset")
    touch = (F.col("start") < F.lag("end").over(w) - 0.001) | (F.col("end") > F.lead("start").over(w) + 0.001)
    good = out.where("start IS NOT NULL").withColumn("status", F.when(F.coalesce(touch, F.lit(False)), "overlap").otherwise("mapped"))
    return good.unionByName(out.where("start IS NULL").withColumn("status", F.lit("local_review")))


def merge_lrc(lines: DataFrame, translations: DataFrame, durations: DataFrame) -> DataFrame:
    """Lyric lines (track_id, ms, n, text) as cues with the translation (track_id, ms, n, text) that stands
    within 350 ms; chants keep themselves; a cue lasts until just before the next line, the last one six
    seconds at most. missing: no translation."""
    near = nearest(lines, translations, "track_id", "ms", "n", 350).select("track_id", "n", F.col("r_text").alias("_tr"))
    w = Window.partitionBy("track_id").orderBy("n")
    start, after = F.col("ms") / 1000.0, F.lead("ms").over(w) / 1000.0
    timed = lines.withColumns({"start": start, "_next": after}).join(durations, "track_id")
    end = F.when(F.col("_next").isNotNull(), F.greatest(F.col("start") + 0.05, F.col("_next") - 0.05)).otherwise(F.least("duration", F.col("start") + 6.0))
    out = timed.withColumn("end", end).join(near, ["track_id", "n"], "left")
    words = F.coalesce("_tr", F.when(T.is_ascii_chant(F.col("text")), F.col("text")))
    return out.select("track_id", "n", "start", "end", words.alias("translation"), "text", words.isNull().alias("missing"))
