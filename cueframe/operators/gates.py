"""Quality gates over cues: rows (section_id, pos, code, severity) for what is wrong or wants review.

Cues: section_id, pos, start, end, role, section_type, section_end and texts. pos is the order. One sort of
each section feeds all sequence gates; what looks at a row alone needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

EPSILON = 0.001
SOURCE_UNITS, TRANSLATION_UNITS = 56, 44
ROLES = ("lyric", "speech", "lyric_adlib")
LISTENED = ("user_manual_full_av_review", "continuous_av_review")
CONFIRMING = ("audio_review", "continuous_av_review", "user_correction")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _flags(df: DataFrame, checks: list[tuple[Column, str, str]], keys: list[str]) -> DataFrame:
    """A row for each check that holds: (condition, code, severity)."""
    codes = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))) for c, code, level in checks]))
    return df.select(*keys, F.inline(codes))


KEYS = ["section_id", "pos"]


def time_gates(cues: DataFrame) -> DataFrame:
    """Time, order, duration, section and overlap. Cues without finite times leave the sequence;
    order and overlap look at the cue just before."""
    s, e = F.col("start"), F.col("end")
    missing = s.isNull() | e.isNull()
    broken = cues.where(~(_finite(s) & _finite(e)))
    lost = _flags(broken, [(missing, "invalid_time", "hard"), (~missing, "non_finite_time", "hard")], KEYS)
    w = Window.partitionBy("section_id").orderBy("pos")
    whole = cues.where(_finite(s) & _finite(e)).withColumns({"_s": F.lag("start").over(w), "_e": F.lag("end").over(w)})
    length = e - s
    checks = [
        (s < F.col("_s") - EPSILON, "event_order_changed", "hard"),
        (s >= e, "invalid_time", "hard"),
        ((s < e) & (length < 0.2 - EPSILON), "unreadable_event_duration", "hard"),
        ((s < e) & (length >= 0.2 - EPSILON) & (length < 0.35 - EPSILON), "very_short_event_duration", "review"),
        ((s < -EPSILON) | (e > F.col("section_end") + EPSILON), "outside_section", "hard"),
        ((F.col("_e") >= 0) & (s < F.col("_e") - EPSILON), "overlap", "hard"),
    ]
    return lost.unionByName(_flags(whole, checks, KEYS))


def _has(evidence: Column, *starts: str) -> Column:
    return F.coalesce(F.exists(evidence, lambda x: F.lit(False) if not starts else _any(x, starts)), F.lit(False))


def _any(x: Column, starts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | x.startswith(s)
    return out


def text_gates(cues: DataFrame) -> DataFrame:
    """Empty texts, marks that MC text must not hold, and speech too long for a line.
    Needs source_text, translation."""
    source, translation = F.coalesce("source_text", F.lit("")), F.coalesce("translation", F.lit(""))
    mc = F.col("section_type") == "mc"
    flat = cues.withColumns({"_s": T.norm_layout(source), "_t": T.norm_layout(translation)})
    long = (T.display_units(source) > SOURCE_UNITS) | (T.display_units(translation) > TRANSLATION_UNITS)
    checks = [
        (F.col("_s") == "", "empty_source_text", "hard"),
        (F.col("_t") == "", "missing_translation", "hard"),
        (mc & T.has_disallowed_punctuation(source), "mc_disallowed_punctuation:source_text", "hard"),
        (mc & T.has_disallowed_punctuation(translation), "mc_disallowed_punctuation:translation", "hard"),
        (mc & (F.col("role") == "speech") & long, "overlong_mc_event", "hard"),
    ]
    return _flags(flat, checks, KEYS)


def role_gates(cues: DataFrame) -> DataFrame:
    """Roles, and the evidence that ad-libs and speech in songs need. Needs evidence."""
    song = F.col("section_type") == "song"
    role = F.coalesce("role", F.when(song, "lyric").otherwise("speech"))
    e = F.coalesce("evidence", F.array().cast("array<string>"))
    timed = _has(e, "asr_", "word_timing")
    listened = F.arrays_overlap(e, F.array(*map(F.lit, LISTENED)))
    adlib, speech = role == "lyric_adlib", song & (role == "speech")
    checks = [
        (~role.isin(*ROLES), "invalid_event_role", "hard"),
        (adlib & ~song, "lyric_adlib_outside_song", "hard"),
        (adlib & ~listened & ~timed, "lyric_adlib_missing_evidence", "hard"),
        (adlib, "lyric_adlib_review_required", "review"),
        (speech & ~timed, "embedded_speech_missing_asr_evidence", "hard"),
        (speech, "embedded_speech_review_required", "review"),
    ]
    return _flags(cues, checks, KEYS)


def variant_gates(cues: DataFrame) -> DataFrame:
    """Lyrics sung otherwise than written, and cues that join several lyric lines."""
    lyric = cues.where((F.col("section_type") == "song") & (F.coalesce("role", F.lit("lyric")) == "lyric"))
    flat = lyric.withColumns({"_c": T.norm_layout(F.col("canonical_source_text")), "_s": T.norm_layout(F.coalesce("source_text", F.lit("")))})
    differs = F.col("_c").isNotNull() & (F.col("_c") != F.col("_s"))
    listened = F.arrays_overlap(F.coalesce("evidence", F.array().cast("array<string>")), F.array(*map(F.lit, LISTENED)))
    span = F.col("lyric_line_span")
    joined = (F.size(span) == 2) & (F.get(span, F.lit(1)) > F.get(span, F.lit(0)))
    checks = [(differs & ~listened, "live_lyric_variant_missing_manual_av_evidence", "hard"), (differs, "live_lyric_variant_review_required", "review"), (F.coalesce(joined, F.lit(False)), "lyric_semantic_merge_review_required", "review")]
    return _flags(flat, checks, KEYS)


def omitted_span_gates(spans: DataFrame) -> DataFrame:
    """Spans (section_id, first, last, n_lines, evidence) of lines left out: inside the lyrics, heard,
    and apart from each other."""
    w = Window.partitionBy("section_id").orderBy("first", "last")
    listened = F.arrays_overlap(F.coalesce("evidence", F.array().cast("array<string>")), F.array(*map(F.lit, LISTENED)))
    checks = [
        ((F.col("first") < 1) | (F.col("last") > F.col("n_lines")) | (F.col("first") > F.col("last")), "invalid_omitted_span", "hard"),
        (~listened, "omitted_span_missing_evidence", "hard"),
        (F.col("first") <= F.col("_last"), "omitted_spans_overlap", "hard"),
    ]
    return _flags(spans.withColumn("_last", F.lag("last").over(w)), checks, ["section_id", "first", "last"])


def vocal_gates(cues: DataFrame, reports: DataFrame) -> DataFrame:
    """Lyrics that begin before anybody sings. reports: section_id, first_vocal_start."""
    lyric = cues.where((F.col("section_type") == "song") & (F.coalesce("role", F.lit("lyric")) == "lyric"))
    first = lyric.groupBy("section_id").agg(F.min_by("start", "pos").alias("first"), F.min("pos").alias("pos"))
    v = F.col("first_vocal_start")
    checks = [(v.isNull(), "missing_first_vocal_start", "review"), (v.isNotNull() & ~_finite(v), "non_finite_first_vocal_start", "hard"), (_finite(v) & (v - F.col("first") > 0.35), "lyrics_before_vocal", "hard")]
    return _flags(first.join(reports, "section_id", "left"), checks, KEYS)


def instrumental_gates(cues: DataFrame, gaps: DataFrame) -> DataFrame:
    """Lyrics inside instrumental gaps (section_id, start, end, confidence) that are sure enough."""
    sure = gaps.where(F.coalesce("confidence", F.lit(1.0)) >= 0.75).select("section_id", F.col("start").alias("gs"), F.col("end").alias("ge"))
    good = _finite(F.col("gs")) & _finite(F.col("ge")) & (F.col("ge") > F.col("gs"))
    bad = sure.where(~good).select("section_id", F.lit(None).cast("int").alias("pos"), F.lit("invalid_instrumental_gap").alias("code"), F.lit("hard").alias("severity"))
    lyric = cues.where((F.col("section_type") == "song") & (F.coalesce("role", F.lit("lyric")) == "lyric")).select("section_id", "pos", "start", "end")
    overlap = F.least("end", "ge") - F.greatest("start", "gs")
    hit = lyric.join(sure.where(good), "section_id").where(overlap > 0.25)
    return hit.select("section_id", "pos", F.lit("lyrics_in_instrumental_gap").alias("code"), F.lit("hard").alias("severity")).unionByName(bad)


def alignment_gates(reports: DataFrame) -> DataFrame:
    """Bands of the alignment figures of a section's report, and its boundary confidence."""
    c, x, s, a = (F.coalesce(k, F.lit(d)) for k, d in (("max_correction_seconds", 0.0), ("max_extrapolation_seconds", 0.0), ("alignment_slope", 1.0), ("first_reliable_anchor_ratio", 0.0)))
    checks = [
        (~(_finite(c) & _finite(x) & _finite(s) & _finite(a)), "non_finite_alignment_metric", "hard"),
        (c > 5.0, "excessive_correction", "hard"),
        ((c > 2.0) & (c <= 5.0), "large_correction", "review"),
        (x > 5.0, "excessive_extrapolation", "hard"),
        ((x > 2.0) & (x <= 5.0), "large_extrapolation", "review"),
        ((s < 0.75) | (s > 1.35), "unsafe_alignment_slope", "hard"),
        (((s >= 0.75) & (s < 0.85)) | ((s > 1.15) & (s <= 1.35)), "unusual_alignment_slope", "review"),
        (a > 0.2, "late_first_reliable_anchor", "review"),
        (F.coalesce("unsafe_reference_extrapolation", F.lit(False)), "unsafe_reference_extrapolation", "hard"),
        (F.coalesce("boundary_confidence", F.lit(0.5)) < 0.6, "low_boundary_confidence", "review"),
    ]
    return _flags(reports, checks, ["section_id"])


def presence_gates(sections: DataFrame, cues: DataFrame, reports: DataFrame) -> DataFrame:
    """Sections without cues or without a report."""
    some = cues.select("section_id").distinct().withColumn("_c", F.lit(True))
    told = reports.select("section_id").distinct().withColumn("_r", F.lit(True))
    joined = sections.select("section_id").join(some, "section_id", "left").join(told, "section_id", "left")
    return _flags(joined, [(F.col("_c").isNull(), "empty_section_events", "hard"), (F.col("_r").isNull(), "missing_section_report", "hard")], ["section_id"])


def gate_summary(flags: DataFrame, sections: DataFrame) -> DataFrame:
    """Failed if any hard flag else passed, with counts."""
    sums = flags.groupBy("section_id").agg(F.count_if(F.col("severity") == "hard").alias("hard"), F.count_if(F.col("severity") == "review").alias("review"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    out = sections.select("section_id").join(sums, "section_id", "left").na.fill(0, ["hard", "review"]).na.fill("", ["codes"])
    return out.withColumn("result", F.when(F.col("hard") > 0, "failed").otherwise("passed"))


def singing_gates(cues: DataFrame) -> DataFrame:
    """The first fault of a cue's singing_parts (text, mode, status, performer_ids, color, evidence)."""
    p = F.col("singing_parts")
    ids = lambda x: F.coalesce(x["performer_ids"], F.array().cast("array<string>"))
    n = lambda x: F.size(ids(x))
    every = lambda f: F.coalesce(F.forall(p, f), F.lit(False))
    fault = (
        F.when((F.col("section_type") != "song") | (F.coalesce("role", F.lit("lyric")) == "speech"), "not_a_lyric")
        .when(F.size(p) < 1, "no_parts")
        .when(~every(lambda x: F.coalesce(x["text"], F.lit("")) != ""), "part_without_text")
        .when(F.array_join(F.transform(p, lambda x: x["text"]), "") != F.trim("source_text"), "text_changed")
        .when(~every(lambda x: F.coalesce(x["mode"].isin("solo", "group", "unknown"), F.lit(False))), "mode")
        .when(~every(lambda x: F.coalesce(x["status"].isin("candidate", "confirmed"), F.lit(False))), "status")
        .when(~every(lambda x: F.forall(ids(x), lambda i: F.coalesce(F.trim(i) != "", F.lit(False)))), "performer_ids")
        .when(~every(lambda x: F.size(F.array_distinct(ids(x))) == n(x)), "performer_ids_repeat")
        .when(~every(lambda x: ((x["mode"] != "solo") | (n(x) == 1)) & ((x["mode"] != "group") | (n(x) != 1)) & ((x["mode"] != "unknown") | (n(x) == 0))), "performer_count")
        .when(~every(lambda x: (x["mode"] != "unknown") | (x["status"] == "candidate")), "unknown_confirmed")
        .when(~every(lambda x: x["color"].isNull() | ((x["mode"] == "solo") & x["color"].rlike("^#[0-9A-Fa-f]{6}$"))), "color")
        .when(~every(lambda x: F.coalesce(F.forall(x["evidence"], lambda e: F.coalesce((F.trim(e["basis"]) != "") & (F.trim(e["reference"]) != ""), F.lit(False))), F.lit(True))), "evidence")
        .when(~every(lambda x: (x["status"] != "confirmed") | F.coalesce(F.exists(x["evidence"], lambda e: e["basis"].isin(*CONFIRMING)), F.lit(False))), "unconfirmed")
    )
    return cues.where(p.isNotNull()).withColumn("fault", fault).where("fault IS NOT NULL").select(*KEYS, "fault")


def palette_gates(cues: DataFrame) -> DataFrame:
    """Confirmed solo parts whose colour is not the performer's first one in the concert."""
    parts = cues.select("concert_id", *KEYS, F.posexplode("singing_parts").alias("part", "x")).where("x.mode = 'solo' AND x.status = 'confirmed' AND x.color IS NOT NULL")
    one = parts.select("concert_id", *KEYS, "part", F.get("x.performer_ids", F.lit(0)).alias("performer"), F.upper("x.color").alias("color"))
    w = Window.partitionBy("concert_id", "performer").orderBy("section_id", "pos", "part")
    return one.withColumn("first_color", F.first("color").over(w)).where("color <> first_color")


def mc_policy(crowded: Column, speakers: Column, risks: Column, managed: Column) -> Column:
    """struct(level, mode, target) of an MC part."""
    row = lambda a, b, c: F.struct(F.lit(a).alias("level"), F.lit(b).alias("mode"), F.lit(c).alias("target"))
    return F.when(crowded | (speakers >= 3) | (F.size(risks) > 0), row("high", "manual", "draft")).when(managed, row("medium", "assisted", "review")).otherwise(row("low", "assisted", "review"))


def missing_review_points(required: Column, triggered: Column, reviewed: Column) -> Column:
    """Points asked for that were not reviewed."""
    return F.array_sort(F.array_except(F.array_union(required, triggered), reviewed))


def segmentation_review(seconds: Column, chinese: Column, japanese: Column) -> Column:
    """Why a cue should be split."""
    return F.array_compact(F.array(F.when(seconds > 8, "duration_gt_8s"), F.when(T.comment_width(chinese) > 20, "chinese_gt_20"), F.when(T.comment_width(japanese) > 28, "japanese_gt_28")))


def bilingual_gates(cues: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Times, overlap and both texts of bilingual cues (section_id, pos, start, end, chinese, japanese)."""
    w = Window.partitionBy("section_id").orderBy("pos")
    checks = [
        ((F.col("start") < 0) | (F.col("end") <= F.col("start")), "invalid_time", "hard"),
        (F.col("start") < F.col("_e") - tolerance, "overlap", "hard"),
        ((F.coalesce("chinese", F.lit("")) == "") | (F.coalesce("japanese", F.lit("")) == ""), "missing_text", "hard"),
    ]
    return _flags(cues.withColumn("_e", F.lag("end").over(w)), checks, KEYS)


def frozen_fields(source: DataFrame, edited: DataFrame) -> DataFrame:
    """An edited table (track_id, line, text, start, end) against its source, row by row."""
    a = source.select("track_id", "line", F.col("text").alias("_t"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.lit(True).alias("_in"))
    j = a.join(edited.withColumn("_out", F.lit(True)), ["track_id", "line"], "full")
    code = F.when(F.col("_out").isNull(), "line_lost").when(F.col("_in").isNull(), "line_added").when(~F.col("text").eqNullSafe(F.col("_t")), "text_changed").when(~(F.col("start") < F.col("end")), "illegal_time").when(~(F.col("start").eqNullSafe(F.col("_s")) & F.col("end").eqNullSafe(F.col("_e"))), "timing_changed")
    return j.withColumn("code", code).where("code IS NOT NULL").select("track_id", "line", "code")


def phone_line_flags(seconds: Column) -> Column:
    """G33"""
    return F.array_join(F.array_compact(F.array(F.when(seconds > 12, "duration_gt_12s"), F.when(seconds < 0.3, "duration_lt_0.3s"))), ",")


def media_pair_faults(original: DataFrame, render: DataFrame) -> DataFrame:
    """Probed files (media_id, width, height, duration, codec, audio_hash) that a render must match."""
    o = original.select("media_id", *[F.col(c).alias(f"_{c}") for c in ("width", "height", "duration", "audio_hash")])
    j = o.join(render, "media_id", "left")
    codes = F.array_compact(F.array(
        F.when(F.col("width").isNull(), "missing_render"),
        F.when((F.col("width") != F.col("_width")) | (F.col("height") != F.col("_height")), "size"),
        F.when(F.abs(F.col("duration") - F.col("_duration")) > 0.25, "duration"),
        F.when(F.col("codec") != "h264", "codec"),
        F.when(F.col("width").isNotNull() & F.col("audio_hash").isNull(), "no_audio"),
        F.when(F.col("audio_hash") != F.col("_audio_hash"), "audio_changed"),
    ))
    return j.select("media_id", F.explode(codes).alias("code"))


def stale_hashes(stored: DataFrame, current: DataFrame, what: list[str]) -> DataFrame:
    """Names of hashes by section that no longer agree with what they were taken from."""
    now = current.select("section_id", *[F.col(w).alias(f"_{w}") for w in what], F.lit(True).alias("_in"))
    j = stored.join(now, "section_id", "left")
    codes = [F.when(F.col("_in").isNotNull() & ~F.col(w).eqNullSafe(F.col(f"_{w}")), F.lit(f"stale_{w}")) for w in what]
    return j.select("section_id", F.explode(F.array_compact(F.array(F.when(F.col("_in").isNull(), F.lit("section_missing_from_manifest")), *codes))).alias("code"))


# What an MC assessment may say.
CLASSES = ("single_speaker", "managed_dialogue", "crowded_multi_speaker")
RISKS = ("overlapping_speech", "rapid_turn_taking", "speaker_identity_uncertain", "off_camera_speech", "crowd_interjections")
BASES = ("continuous_av_review", "audio_review", "video_review", "static_video_frames", "asr_word_timing")
HEARD = ("continuous_av_review", "audio_review")


def mc_assessment_failures(packages: DataFrame, assessments: DataFrame, version: str = "0.1.0") -> DataFrame:
    """Faults of MC assessments (section_id, schema_version, input_hash, classification, speaker_count, signals, evidence_basis,
    risk_level, manual_required, reflow_policy) against packages (section_id, input_hash); a package without one
    is a fault too, crowded and managed MC ask for review."""
    a = assessments.withColumnRenamed("input_hash", "_seen").withColumn("_in", F.lit(True))
    j = packages.select("section_id", "input_hash").join(a, "section_id", "left")
    known, counted = F.coalesce(F.col("classification").isin(*CLASSES), F.lit(False)), F.coalesce(F.col("speaker_count") >= 1, F.lit(False))
    values = lambda c, allowed: F.array_except(F.coalesce(c, F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))
    odd_signal = F.size(values("signals", RISKS)) > 0
    basis = F.coalesce("evidence_basis", F.array().cast("array<string>"))
    high = (F.col("classification") == CLASSES[2]) | (F.col("speaker_count") >= 3) | (F.size(F.coalesce("signals", F.array().cast("array<string>"))) > 0)
    level = F.when(high, "high").when(F.col("classification") == CLASSES[1], "medium").otherwise("low")
    policy = F.when(high, "draft_only").otherwise("review_required")
    judged = known & counted & ~odd_signal
    here = F.col("_in").isNotNull()
    checks = [
        (~here, "mc_complexity_missing", "hard"),
        (here & ~F.col("schema_version").eqNullSafe(F.lit(version)), "mc_complexity_schema_mismatch", "hard"),
        (here & ~F.col("_seen").eqNullSafe(F.col("input_hash")), "stale_mc_complexity_assessment", "hard"),
        (here & ~known, "invalid_mc_complexity_classification", "hard"),
        (here & ~counted, "invalid_mc_speaker_count", "hard"),
        (here & odd_signal, "invalid_mc_complexity_signal", "hard"),
        (here & ((F.size(basis) == 0) | (F.size(values(basis, BASES)) > 0)), "invalid_mc_complexity_evidence_basis", "hard"),
        (here & ~F.arrays_overlap(basis, F.array(*map(F.lit, HEARD))), "mc_complexity_missing_audio_review", "hard"),
        (here & judged & ~F.col("risk_level").eqNullSafe(level), "mc_complexity_risk_mismatch", "hard"),
        (here & judged & ~F.col("manual_required").eqNullSafe(high), "mc_manual_conform_policy_mismatch", "hard"),
        (here & judged & ~F.col("reflow_policy").eqNullSafe(policy), "mc_reflow_policy_mismatch", "hard"),
        (here & (F.col("classification") == CLASSES[2]), "crowded_mc_review_required", "review"),
        (here & (F.col("classification") == CLASSES[1]), "managed_mc_review_required", "review"),
    ]
    return _flags(j, checks, ["section_id"])


def events_digest(merged: DataFrame) -> DataFrame:
    """concert_id, number and SHA-256 of its merged cues (concert_id, section_id, pos, start, end, text), in order."""
    cue = F.struct("section_id", "pos", "start", "end", "text")
    return merged.groupBy("concert_id").agg(F.count("*").alias("n"), F.sha2(F.to_json(F.array_sort(F.collect_list(cue))), 256).alias("hash"))


def output_checks(concerts: DataFrame, coverage: DataFrame, merged: DataFrame, reports: DataFrame, documents: DataFrame) -> DataFrame:
    """Faults of what was written for a concert. concerts (concert_id, manifest_hash), coverage (concert_id, seen_hash,
    ready), merged cues (concert_id, section_id, pos, start, end, text), reports (concert_id, event_count, events_hash, result),
    documents (concert_id, text)."""
    own = events_digest(merged)
    lines = F.filter(F.split("text", "\r?\n"), lambda x: x.startswith("Dialogue:"))
    bare = F.filter(lines, lambda x: (F.size(F.split(x, ",", 10)) < 10) | (F.trim(F.get(F.split(x, ",", 10), F.lit(9))) == ""))
    docs = documents.select("concert_id", F.size(lines).alias("_lines"), F.size(bare).alias("_bare"))
    c = coverage.withColumn("_cov", F.lit(True))
    r = reports.withColumn("_rep", F.lit(True))
    j = concerts.join(own, "concert_id", "left").join(c, "concert_id", "left").join(r, "concert_id", "left").join(docs, "concert_id", "left").na.fill(0, ["n"])
    has = lambda x: F.col(x).isNotNull()
    checks = [
        (~has("_cov"), "missing_coverage_audit_report", "hard"),
        (has("_cov") & ~F.col("seen_hash").eqNullSafe(F.col("manifest_hash")), "stale_coverage_audit_report", "hard"),
        (has("_cov") & ~F.coalesce("ready", F.lit(False)), "concert_coverage_not_ready", "hard"),
        (~has("_rep"), "missing_merge_evidence", "hard"),
        (has("_rep") & ~F.col("event_count").eqNullSafe(F.col("n")), "output_event_count_mismatch", "hard"),
        (has("_rep") & ~F.col("result").eqNullSafe(F.lit("passed")), "output_report_not_passed", "hard"),
        (has("_rep") & ~F.col("events_hash").eqNullSafe(F.col("hash")), "output_events_content_mismatch", "hard"),
        (~has("_lines"), "missing_formal_output", "hard"),
        (has("_lines") & (F.col("_lines") != F.col("n")), "ass_event_count_mismatch", "hard"),
        (F.coalesce(F.col("_bare") > 0, F.lit(False)), "ass_empty_text", "hard"),
    ]
    return _flags(j, checks, ["concert_id"])
