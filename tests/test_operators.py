"""Operators on small literal tables with known results."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from cueframe.operators import align, audit, gates, joins, lyrics, metrics, reflow, repetition, signal, structure, timeline


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def sections(spark, *spans, concert="c"):
    return spark.createDataFrame([(concert, str(i), "song", float(a), float(b)) for i, (a, b) in enumerate(spans)], "concert_id string, section_id string, type string, start double, end double")


def concert(spark, duration):
    return spark.createDataFrame([("c", float(duration))], "concert_id string, duration double")


@pytest.mark.parametrize("duration,spans,want", [(100, [(10, 30), (35, 90)], [(0, 10, 10), (30, 35, 5), (90, 100, 10)]), (20, [(0.2, 10), (10.4, 20)], []), (50, [(0, 30), (5, 10), (40, 50)], [(30, 40, 10)])])
def test_gaps(spark, duration, spans, want):
    got = timeline.timeline_gaps(sections(spark, *spans), concert(spark, duration))
    assert rows(got, "start", "end", "duration") == [tuple(map(float, w)) for w in want]


def test_gap_decisions(spark):
    gaps = timeline.timeline_gaps(sections(spark, (10, 30), (35, 90)), concert(spark, 100))
    d = spark.createDataFrame([("c", 0.0, 10.4, "no_speech"), ("c", 30.0, 35.0, "unknown"), ("c", 91.0, 100.0, "credits")], "concert_id string, start double, end double, disposition string")
    assert rows(timeline.unresolved_gaps(gaps, d), "start") == [(30.0,), (90.0,)]


def test_fill_and_merge(spark):
    got = timeline.fill_timeline(sections(spark, (1, 3), (3, 5), (4, 6)), concert(spark, 8))
    assert rows(got, "start", "end", "label") == [(0.0, 1.0, "transition 1"), (1.0, 3.0, "song 1"), (3.0, 5.0, "song 2"), (4.0, 6.0, "song 3"), (6.0, 8.0, "transition 2")]
    w = spark.createDataFrame([("c", 0.0, 4.0), ("c", 4.005, 5.0), ("c", 5.1, 6.0), ("c", 1.0, 2.0)], "concert_id string, start double, end double")
    assert rows(timeline.merge_intervals(w), "start", "end") == [(0.0, 5.0), (5.1, 6.0)]


CUES = "section_id string, pos int, start double, end double, role string, section_type string, section_end double"


def test_time_gates(spark):
    nan = float("nan")
    data = [(0, 0.0, 1.0), (1, nan, 2.0), (2, 0.5, 0.6), (3, None, 1.0), (4, 0.4, 3.0), (5, 3.0, 3.3), (6, 5.0, 5.0), (7, 9.0, 11.0)]
    c = spark.createDataFrame([("s", p, a, b, "lyric", "song", 10.0) for p, a, b in data], CUES)
    assert rows(gates.time_gates(c), "pos", "code") == [
        (1, "non_finite_time"), (2, "overlap"), (2, "unreadable_event_duration"), (3, "invalid_time"), (4, "event_order_changed"), (4, "overlap"), (5, "very_short_event_duration"), (6, "invalid_time"), (7, "outside_section"),
    ]
    summary = gates.gate_summary(gates.time_gates(c), spark.createDataFrame([("s",), ("t",)], "section_id string"))
    assert rows(summary, "section_id", "result") == [("s", "failed"), ("t", "passed")]


def test_reports_of_known_failures(spark):
    lyric = spark.createDataFrame([("song04", 0, 0.0, 4.0, "lyric", "song", 300.0)], CUES)
    report = spark.createDataFrame([("song04", 26.88)], "section_id string, first_vocal_start double")
    gap = spark.createDataFrame([("song04", 0.0, 25.0, 0.98)], "section_id string, start double, end double, confidence double")
    codes = {r.code for r in gates.vocal_gates(lyric, report).unionByName(gates.instrumental_gates(lyric, gap)).collect()}
    assert codes == {"lyrics_before_vocal", "lyrics_in_instrumental_gap"}
    bad = spark.createDataFrame([("song05", 35.83, 35.83, 1.31, 0.72, True, 0.9)], "section_id string, max_correction_seconds double, max_extrapolation_seconds double, alignment_slope double, first_reliable_anchor_ratio double, unsafe_reference_extrapolation boolean, boundary_confidence double")
    assert {"excessive_extrapolation", "unsafe_reference_extrapolation", "excessive_correction", "unusual_alignment_slope"} <= {r.code for r in gates.alignment_gates(bad).collect()}


def test_singing_parts(spark):
    part = "struct<text:string,mode:string,status:string,performer_ids:array<string>,color:string,evidence:array<struct<basis:string,reference:string>>>"
    ev = [("audio_review", "0:01")]
    cases = [
        ([("ab", "solo", "confirmed", ["x"], "#ff0000", ev)], None),
        ([("a", "solo", "candidate", ["x"], None, None), ("b", "group", "candidate", [], None, None)], None),
        ([("a", "solo", "candidate", ["x"], None, None)], "text_changed"),
        ([("ab", "solo", "candidate", ["x", "y"], None, None)], "performer_count"),
        ([("ab", "group", "candidate", ["x", "x"], None, None)], "performer_ids_repeat"),
        ([("ab", "unknown", "confirmed", [], None, ev)], "unknown_confirmed"),
        ([("ab", "group", "candidate", [], "#ff0000", None)], "color"),
        ([("ab", "solo", "confirmed", ["x"], None, [("camera", "0:01")])], "unconfirmed"),
        ([], "no_parts"),
    ]
    df = spark.createDataFrame([("s", i, "ab", "lyric", "song", p) for i, (p, _) in enumerate(cases)], f"section_id string, pos int, source_text string, role string, section_type string, singing_parts array<{part}>")
    assert {r.pos: r.fault for r in gates.singing_gates(df).collect()} == {i: f for i, (_, f) in enumerate(cases) if f}


def test_lyric_cover(spark):
    lines = spark.createDataFrame([("s", i + 1, x) for i, x in enumerate("abcd")], "section_id string, line long, text string")
    cue = "section_id string, pos long, source_text string, canonical_source_text string, lyric_line_span array<long>"
    good = spark.createDataFrame([("s", 0, "ab", None, [1, 2]), ("s", 1, "D", "d", None)], cue)
    gone = spark.createDataFrame([("s", 3, 3)], "section_id string, first long, last long")
    assert align.lyric_cover(good, lines, gone).count() == 0
    bad = spark.createDataFrame([("s", 0, "a", None, None), ("s", 1, "x", None, None), ("s", 2, "d", None, [4, 4])], cue)
    assert rows(align.lyric_cover(bad, lines), "code", "n") == [("invalid_lyric_line_span", 1), ("lyrics_event_count_mismatch", 2), ("lyrics_text_or_order_changed", 1)]


def test_alignment_one_to_many(spark):
    kind = "k string, pos long, text string, start double, end double"
    h = spark.createDataFrame([("t", 0, "前半後半", 1.2, 4.3)], kind)
    r = spark.createDataFrame([("t", 0, "前半", 1.0, 2.0), ("t", 1, "後半", 2.1, 4.0)], kind)
    g = metrics.alignment_groups(metrics.char_links(h, r, "k"), h, r, "k")
    assert rows(g, "relation", "n_hyp", "n_ref", "start_error", "end_error") == [("1:N", 1, 2, 0.2, 0.3)]
    e = spark.createDataFrame([("t", 1, 2)], "k string, hypothesis long, reference long")
    m = metrics.timing_metrics(g, e, ["k"]).first()
    assert (m.coverage, m.split_pairs, m.near) == (1.0, 1, 1)


def test_links_never_cross(spark):
    kind = "k string, pos long, text string"
    h = spark.createDataFrame([("t", i, x) for i, x in enumerate(["abc", "dxe", "fgh", "abc", "zz"])], kind)
    r = spark.createDataFrame([("t", i, x) for i, x in enumerate(["ab", "cd", "efg", "h", "abczz"])], kind)
    links = sorted((x.h, x.r) for x in metrics.char_links(h, r, "k").collect())
    assert all(not (a < c and b > d) for a, b in links for c, d in links)


def test_speech_candidates(spark):
    seg = spark.createDataFrame([("s", 0, 1.0, 3.0, "みなさんこんばんは", None), ("s", 1, 10.1, 13.7, "光る空を見上げて", None), ("s", 2, 16.0, 18.0, "元気ですかみんな", 0.9)], "section_id string, id long, start double, end double, text string, probability double")
    lyric = spark.createDataFrame([("s", 10.0, 14.0, "光る空を見上げて"), ("s", 20.0, 24.0, "走り出す夜の中へ")], "section_id string, start double, end double, text string")
    gap = spark.createDataFrame([("s", 15.0, 19.0)], "section_id string, start double, end double")
    assert rows(joins.speech_candidates(seg, lyric, gap), "id", "location") == [(0, "prelude"), (2, "instrumental_gap")]


def test_overlapping_meets_each_pair_once(spark):
    a = spark.createDataFrame([("s", 1, 0.0, 500.0), ("s", 2, 130.0, 131.0)], "k string, id int, start double, end double")
    b = spark.createDataFrame([("s", 7, 10.0, 400.0), ("s", 8, 501.0, 502.0), ("t", 9, 0.0, 900.0)], "k string, id int, start double, end double")
    assert rows(joins.overlapping(a, b, "k"), "id", "r_id") == [(1, 7), (2, 7)]
    assert rows(joins.overlapping(a, b, "k", 1.5), "id", "r_id") == [(1, 7), (1, 8), (2, 7)]


def test_merge_lrc_and_interpolate(spark):
    kind = "track_id string, ms long, n long, text string"
    o = spark.createDataFrame([("t", 2000, 0, "line"), ("t", 5000, 1, "Oh"), ("t", 7000, 2, "line two")], kind)
    z = spark.createDataFrame([("t", 2030, 0, "行"), ("t", 7000, 1, "二行")], kind)
    d = spark.createDataFrame([("t", 12.0)], "track_id string, duration double")
    assert rows(joins.merge_lrc(o, z, d), "start", "end", "translation", "missing") == [(2.0, 4.95, "行", False), (5.0, 6.95, "Oh", False), (7.0, 12.0, "二行", False)]
    anchors = spark.createDataFrame([("t", 0.0, 10.0), ("t", 4.0, 15.0), ("t", 8.0, 18.0)], "k string, x double, y double")
    at = spark.createDataFrame([("t", 4.2), ("t", 8.0), ("t", 9.0)], "k string, at double")
    got = rows(joins.interpolate(at, anchors, "k"), "at", "value")
    assert got[0][1] == pytest.approx(15.15) and got[1] == (8.0, 18.0) and got[2] == (9.0, None)


def test_structure_transfer(spark):
    part = "track_id string, cycle string, part string, role string, beats int, n_lines long, complete boolean, start double, end double"
    parts = spark.createDataFrame([("t", "1", "A", "verse", 8, 1, True, 10.0, 20.0), ("t", "2", "A", "verse", 8, 1, True, 90.0, 102.5), ("t", "3", "A", "verse", 12, 1, True, 200.0, 210.0)], part)
    lines = spark.createDataFrame([("t", "1", "A", 0, 11.0, 15.0), ("t", "2", "A", 0, None, None), ("t", "3", "A", 0, None, None)], "track_id string, cycle string, part string, offset long, start double, end double")
    assert rows(joins.structure_transfer(lines, parts, "1"), "cycle", "start", "end", "status", "reason") == [("2", 91.25, 96.25, "mapped", None), ("3", None, None, "local_review", "beats")]


def test_beat_anchors(spark):
    parts = spark.createDataFrame([("t", "A", 0.0, 8.0, 8)], "track_id string, part string, start double, end double, beats int")
    onsets = spark.createDataFrame([("t", i, 1.0 if i == 410 else 0.0) for i in range(380, 430)], "track_id string, i long, value double")
    assert rows(structure.beat_anchors(parts, onsets), "beat", "time", "supported") == [(0, 0.0, False), (4, 4.1, True), (8, 8.0, False)]


SONG = "section_id string, pos long, role string, source_text string, canonical_source_text string, evidence array<string>, start double, end double"
TEXTS = "Aメロ一,Bメロ一,光る空,走り出す,Aメロ二,Bメロ二,光る空,走り出す".split(",")
TIMES = [(1, 2.5), (3, 4.5), (5, 6.5), (7, 8.5), (12, 13.5), (14, 15.5), (16, 17.5), (18, 19.5)]


def song(spark, role7="lyric", end8=19.5):
    times = [*TIMES[:7], (18, end8)]
    return spark.createDataFrame([("s", i, role7 if i == 6 else "lyric", x, None, [], float(a), float(b)) for i, (x, (a, b)) in enumerate(zip(TEXTS, times, strict=True))], SONG)


def test_repeated_block(spark):
    c = song(spark)
    g = repetition.repetition_groups(c)
    assert rows(g, "occurrence", "first", "last") == [(1, 2, 3), (2, 6, 7)]
    s = repetition.occurrence_stats(c, g).first()
    assert s.stable and s.drift == 0
    anchor = g.select("section_id", F.col("first").alias("anchor"), "last")
    assert rows(repetition.structure_boundary(c, anchor), "anchor", "sample_start") == [(2, 0), (6, 4)]
    assert repetition.repetition_groups(song(spark, "speech")).count() == 0
    late = song(spark, end8=19.8)
    assert repetition.occurrence_stats(late, repetition.repetition_groups(late)).first().drift > 0.03


def brute_block(tokens, least):
    best = None
    for size in range(len(tokens) // 2, least - 1, -1):
        places = {}
        for i in range(len(tokens) - size + 1):
            if None not in tokens[i : i + size]:
                places.setdefault(tuple(tokens[i : i + size]), []).append(i)
        for key, starts in places.items():
            chosen = []
            for s in starts:
                if not chosen or s >= chosen[-1] + size:
                    chosen.append(s)
            if len(chosen) > 1 and (best is None or (size, len(chosen), sum(map(len, key))) > best[0]):
                best = ((size, len(chosen), sum(map(len, key))), chosen)
    return (best[0][0], best[1]) if best else None


def test_longest_block_against_brute_force():
    import random

    r = random.Random(1)
    for _ in range(300):
        tokens = [r.choice(["a", "bb", "c", None, "dd"]) if r.random() < 0.9 else None for _ in range(r.randint(0, 14))]
        assert repetition.longest_block(tokens, 2) == brute_block(tokens, 2)


def test_fallback_sample(spark):
    kind = "section_id string, pos long, role string, start double, end double"
    c = spark.createDataFrame([("s", 0, "lyric", 0.0, 200.0), ("s", 1, "speech", 200.0, 201.0), ("s", 2, "lyric", 201.0, 210.0), ("s", 3, "lyric", 211.0, 300.0), ("s", 4, "lyric", 301.0, 500.0), ("t", 0, "lyric", 0.0, 300.0)], kind)
    assert rows(repetition.fallback_sample(c), "section_id", "first", "last", "n") == [("s", 2, 3, 2), ("t", 0, 0, 1)]


def test_collisions_in_order(spark):
    c = spark.createDataFrame([("s", 0, 0.0, 1.0, None, 2.2), ("s", 1, 2.0, 3.0, 2.1, 1.0), ("s", 2, 4.0, 5.0, 2.5, None)], "section_id string, pos long, start double, end double, new_start double, new_end double")
    assert rows(repetition.change_collisions(c), "pos", "edge", "eligible") == [(0, "end", False), (1, "end", False), (1, "start", True), (2, "start", False)]


CUE, WORD = "section_id string, pos long, start double, end double, text string", "section_id string, start double, end double, text string, probability double"


def proposed(spark, cues, words, **policy):
    out = align.propose_boundaries(spark.createDataFrame([("s", i, *c) for i, c in enumerate(cues)], CUE), spark.createDataFrame([("s", *w) for w in words], WORD), align.BoundaryPolicy(**policy))
    return out.orderBy("pos").collect()


def test_boundaries_that_are_far_or_unsure_stay(spark):
    far = proposed(spark, [(4.0, 5.0, "青い鳥")], [(2.0, 3.0, "青い鳥", None)])[0]
    assert far.status == "large_adjustment_keep_original" and (far.new_start, far.new_end) == (4.0, 5.0)
    assert far.reasons == "end_adjustment_exceeds_policy_without_strong_edge,start_adjustment_exceeds_policy_without_strong_edge"
    other = proposed(spark, [(1.0, 2.0, "青い鳥")], [(1.0, 2.0, "赤い花が咲く", None)])[0]
    assert other.status == "unmatched_keep_original" and other.score is None
    near = proposed(spark, [(1.0, 2.0, "青い鳥"), (2.5, 3.0, "海へ")], [(1.2, 1.9, "青い鳥", None), (2.52, 3.03, "海へ", None)])
    assert [(r.new_start, r.new_end, r.status) for r in near] == [(1.2, 1.9, "suggested"), (2.5, 3.0, "matched_keep_original")]
    # the similarity itself must be enough, not what is left of it after distance and length
    late = proposed(spark, [(1.0, 2.0, "abcde")], [(2.6, 3.6, "abcxx", None)], least_score=0.6)[0]
    assert late.score == 0.6 and late.status != "unmatched_keep_original"


def test_boundaries_move_far_by_sure_edges_and_hand_over(spark):
    words = [(1.0, 1.6, "こえ", 0.9), (1.6, 2.2, "こえ", 0.9), (2.2, 2.8, "きく", 0.9), (2.8, 3.4, "まで", 0.9), (3.4, 4.0, "ずっと", 0.9), (4.0, 4.6, "ずっと", 0.95), (4.6, 5.2, "ここ", 0.9)]
    first, second = proposed(spark, [(3.0, 5.0, "こえこえきくまでGo"), (5.1, 6.0, "ずっとずっとここ")], words)
    # the first cue's end has no anchor: it ends just before the anchored start of the next
    assert (first.new_start, first.new_end, first.resolution, first.status) == (1.0, 3.38, "end_from_next_sentence_start", "suggested_partial")
    assert (second.new_start, second.new_end, second.start_anchored) == (3.4, 5.2, True)
    unsure = proposed(spark, [(3.0, 5.0, "こえこえきくまで")], [(a, b, t, 0.5) for a, b, t, _ in words])[0]
    assert unsure.new_start == 3.0 and "start_adjustment" in unsure.reasons


def test_only_the_edge_that_collides_goes_back(spark):
    first, second = proposed(spark, [(1.0, 2.0, "何もない"), (2.3, 3.6, "青い鳥")], [(1.9, 3.2, "青い鳥", None)])
    assert (first.status, first.new_end) == ("unmatched_keep_original", 2.0)
    assert (second.new_start, second.new_end, second.status, second.reasons) == (2.3, 3.2, "suggested_partial", "start_candidate_overlaps_previous")
    # words that an earlier cue has used are gone: the second refrain takes the later words
    twice = proposed(spark, [(1.0, 2.0, "らら"), (1.5, 2.5, "らら")], [(1.1, 1.4, "らら", None), (1.6, 2.4, "らら", None)])
    assert [(r.new_start, r.new_end) for r in twice] == [(1.1, 1.4), (1.6, 2.4)]


LINE = "track_id string, line long, text string"


def test_align_lyrics(spark):
    o = spark.createDataFrame([("t", 0, "はじまりの歌", 0), ("t", 1, "二行目三行目", 4000), ("t", 2, "おわり", 16000)], f"{LINE}, start_ms long")
    y = spark.createDataFrame([("t", 0, "はじまりの歌", 0), ("t", 1, "二行目", 4000), ("t", 2, "三行目", 6000), ("t", 3, "余分な行", 9000), ("t", 4, "おわり", 16000)], f"{LINE}, ms long")
    assert rows(align.align_lyrics(o, y), "line", "first", "last", "similarity") == [(0, 0, 0, 1.0), (1, 1, 2, 1.0), (2, 4, 4, 1.0)]
    # a refrain that only time tells apart
    o = spark.createDataFrame([("t", 0, "始まる", 0), ("t", 1, "refrain", 1000), ("t", 2, "終わる", 100000)], f"{LINE}, start_ms long")
    y = spark.createDataFrame([("t", 0, "refrain", 0), ("t", 1, "あいだ", 50000), ("t", 2, "refrain", 99500), ("t", 3, "unsung", 100000)], f"{LINE}, ms long")
    assert rows(align.align_lyrics(o, y), "line", "first") == [(1, 0)]


def test_align_lyrics_finds_the_best_of_all_walks():
    r = random.Random(3)
    for _ in range(40):
        x, y = ["".join(r.choice("abc") for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 4))], ["".join(r.choice("abc") for _ in range(r.randint(1, 2))) for _ in range(r.randint(1, 5))]
        tx, ty = sorted(r.randrange(9000) for _ in x), sorted(r.randrange(9000) for _ in y)

        def worth(i, j, k):
            s = align._similar(x[i], "".join(y[j : j + k]))
            d = abs((tx[i] - tx[0]) / max(1, tx[-1] - tx[0]) - (ty[j] - ty[0]) / max(1, ty[-1] - ty[0]))
            return None if k > 1 and s != 1.0 else 2.4 * s - 0.8 * d - 0.35 + 0.6 * (s == 1.0)

        @functools.cache
        def best(i, j):
            if i == len(x) or j == len(y):
                return -0.55 * (len(x) - i + len(y) - j), ()
            options = [(t - 0.55, p) for t, p in (best(i + 1, j), best(i, j + 1))]
            for k in (1, 2, 3):
                if j + k <= len(y) and (w := worth(i, j, k)) is not None:
                    t, p = best(i + 1, j + k)
                    options.append((t + w, ((i, j, k), *p)))
            return max(options)

        total, walk = best(0, 0)
        got = align._pairing(x, tx, y, ty)
        kept = {(i, j, j + k - 1) for i, j, k in walk if align._similar(x[i], "".join(y[j : j + k])) >= 0.55}
        again = sum(worth(i, j, b - j + 1) for i, j, b, _, _ in got)
        assert {g[:3] for g in got} == kept or again >= sum(worth(i, j, b - j + 1) for i, j, b in kept) - 1e-9


def test_reference_translation(spark):
    o = spark.createDataFrame([("t", 0, "朝の歌", 1000), ("t", 1, "昼の歌だ", 3000), ("t", 2, "夕べの歌を", 12000), ("t", 3, "夜", 21000), ("t", 4, "ない", 30000), ("u", 0, "一つ", 0)], f"{LINE}, start_ms long")
    y = spark.createDataFrame([("t", 0, "朝の歌", 0, "morning"), ("t", 1, "昼の歌だ", 4000, "noon"), ("t", 2, "夕べの歌", 10000, "evening"), ("t", 3, "夜", 20000, ""), ("u", 0, "一つ", 0, "one")], f"{LINE}, ms long, translation string")
    got = align.reference_translation(align.align_lyrics(o, y), o, y)
    assert rows(got, "track_id", "line", "translation", "projected_ms", "delta_ms", "hint", "sure") == [
        ("t", 0, "morning", 1000, 0, "within-relative-range", True),
        ("t", 1, "noon", 5000, -2000, "relative-earlier", True),
        ("t", 2, "", 11000, 1000, "relative-later", False),  # the lyric is only a part of the cue
        ("t", 3, "", 21000, 0, "within-relative-range", False),
        ("t", 4, None, None, None, "unmatched", False),
        ("u", 0, "one", None, None, "relative-unavailable", True),
    ]


def test_reflow(spark):
    kind = "section_id string, pos long, start double, end double, source_text string, translation string, speakers array<string>, evidence array<string>"
    c = spark.createDataFrame([("s", 0, 0.0, 1.0, "それで", "然后", ["a"], []), ("s", 1, 1.2, 3.0, "行きました。", "去了。", ["a"], []), ("s", 2, 3.1, 4.0, "だから", "所以", ["a"], []), ("s", 3, 4.1, 6.0, "はい。", "是。", ["b"], [])], kind)
    assert rows(reflow.merge_short_prefixes(c), "pos", "source_text", "merged") == [(0, "それで行きました。", True), (2, "だから", False), (3, "はい。", False)]
    long = spark.createDataFrame([("s", 0, 0.0, 10.0, "長い文です。" * 4, "long text! " * 4), ("s", 1, 11.0, 12.0, "短い", "short")], "section_id string, pos long, start double, end double, source_text string, translation string")
    parts = reflow.split_events(long).orderBy("new_pos").collect()
    assert len(parts) > 2 and "".join(p.source_text for p in parts[:-1]) == "長い文です。" * 4
    assert all(a.end <= b.start for a, b in zip(parts, parts[1:], strict=False)) and parts[-1].source_text == "短い"


def test_signals(spark):
    import numpy as np

    x = np.zeros(4000)
    x[500:600] = x[2000:2100] = 1.0
    y = np.roll(x, 80)
    r, lag = signal.best_lag(signal.envelope(x, 100, 20), signal.envelope(y, 100, 20), 10)
    assert r >= 0.95 and lag == 4
    beat = np.tile([1.0] + [0.0] * 49, 20)
    assert any(abs(h["bpm"] - 120) < 1 for h in signal.hypotheses(beat, 10.0))
    df = spark.createDataFrame([("t", [0.0, 0.5, -1.0, 0.001])], "track_id string, samples array<double>")
    s = signal.audio_stability(df).first()
    assert s.silent_ratio == 0.5 and s.clip_ratio == 0.25
    assert rows(signal.waveform_peaks(df, 2), "k", "peak") == [(0, 0.5), (1, 1.0)]


def test_lyric_choice(spark):
    kind = "query_id int, hit_id long, title string, artist string, hit_title string, hit_artist string, lines long, coverage double, popularity double"
    c = spark.createDataFrame([(1, 1, "空", "Ann", "空", "Ann", 10, 0.5, 1.0), (1, 2, "空", "Ann", "空", "Ann B", 10, 1.0, 1.0), (1, 3, "空", "Ann", "空と海", "Ann", 10, 1.0, 9.0), (2, 4, "x", "y", "z", "y", 1, 1.0, 1.0)], kind)
    assert rows(lyrics.choose_candidate(c), "query_id", "hit_id") == [(1, 2)]


def test_audits(spark):
    a = spark.createDataFrame([("k", ["a", "b", "c", "d"])], "id string, items array<string>")
    b = spark.createDataFrame([("k", ["x", "b", "c", "a", "b"])], "id string, items array<string>")
    assert audit.longest_common_run(a, b, "id").first().run == 2
    posts = spark.createDataFrame([(1, "空の歌", "see https://ok.example/x BV1", "空", "BV1"), (2, "", "http://bad.example", "空", None)], "post_id int, title string, body string, song string, previous string")
    assert rows(audit.post_faults(posts, allowed=("ok.example",)), "post_id", "code") == [(2, "missing_title"), (2, "title_without_song"), (2, "url_not_allowed")]


def test_import_timings(spark):
    cues = spark.createDataFrame([("a", 0, "x", 1.0, 2.0), ("a", 1, "y", 3.0, 4.0), ("b", 0, "x", 0.1, 2.0), ("b", 1, "y", 8.0, 9.5), ("b", 2, "z", 9.5, 9.9)], "track_id string, pos long, text string, start double, end double")
    heard = spark.createDataFrame([("a", 7, "x", 101.5, 102.25), ("a", 8, "y", 103.0, 104.5), ("b", 0, "x", 49.9, 52.0), ("b", 1, "y", 58.0, 60.5), ("b", 2, "z", 59.0, 59.0)], "track_id string, pos long, text string, start double, end double")
    spans = spark.createDataFrame([("a", -100.0, 10.0), ("b", -50.0, 10.0)], "track_id string, shift double, duration double")
    got = joins.import_timings(joins.timing_reference_match(cues.drop("end"), heard), cues, spans)
    out = "imported_time_outside_section"
    assert rows(got, "track_id", "pos", "imported_start", "imported_end", "start_adjustment", "end_adjustment", "code", "accepted") == [
        ("a", 0, 1.5, 2.25, 0.5, 0.25, None, True), ("a", 1, 3.0, 4.5, 0.0, 0.5, None, True),
        ("b", 0, -0.1, 2.0, -0.2, 0.0, out, False), ("b", 1, 8.0, 10.5, 0.0, 1.0, out, False), ("b", 2, 9.0, 9.0, -0.5, -0.9, out, False),
    ]


def test_longest_fit_against_every_run():
    r = random.Random(3)
    for _ in range(400):
        n = r.randrange(1, 12)
        s = [round(r.uniform(0, 9), 1) for _ in range(n)]
        e = [round(x + r.uniform(-1, 4), 1) for x in s]
        want = (0, 0)
        for i in range(n):
            j = i + 1
            while j < n and not e[j] - s[i] > 3:
                j += 1
            want = max(want, (i, j - i), key=lambda x: x[1])
        assert repetition.longest_fit(s, e, 3) == want


def test_common_run_against_every_pair():
    r = random.Random(4)
    for _ in range(400):
        a, b = ([r.choice(["x", "y", "z", None]) for _ in range(r.randrange(9))] for _ in range(2))
        runs = [k for i in range(len(a)) for j in range(len(b)) for k in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + k] == b[j : j + k] and None not in a[i : i + k]]
        assert audit.common_run(a, b) == max(runs, default=0)
    assert audit.common_run(["la"] * 5000, ["la"] * 4000) == 4000


def test_common_run_rows(spark):
    a = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, ["q"])], "id long, items array<string>")
    b = spark.createDataFrame([(1, ["c"]), (2, ["x"]), (4, ["q"])], "id long, items array<string>")
    assert rows(audit.longest_common_run(a, b, "id"), "id", "run") == [(1, 0), (2, 0)]
    assert rows(audit.longest_common_run(a.limit(0), b, "id"), "id", "run") == []


def test_structure_boundary_against_every_cue(spark):
    r = random.Random(5)
    cues, anchors, want = [], [], []
    for section in range(6):
        t, own = 0.0, []
        for pos in range(200):
            t += r.choice([0.5, 1.0, 5.0])
            own.append((section, pos, t, t + r.uniform(0.2, 12), r.choice(["lyric", "lyric", "lyric", "speech"])))
        cues += own
        mine = sorted((a, min(199, a + r.randrange(4))) for a in r.sample(range(200), 12))
        anchors += [(section, *x) for x in mine]
        opens = [p for p in range(200) if p == 0 or own[p - 1][4] != "lyric" or own[p][2] - own[p - 1][3] >= 3.0]
        for a, last in mine:
            begin = max([p for p in opens if p <= a] + [x + 1 for _, x in mine if x + 1 <= a])
            want.append((section, a, next(p for p in range(begin, a + 1) if own[last][3] - own[p][2] <= 174 or p == a)))
    c = spark.createDataFrame(cues, "section_id long, pos long, start double, end double, role string")
    got = rows(repetition.structure_boundary(c, spark.createDataFrame(anchors, "section_id long, anchor long, last long")), "section_id", "anchor", "sample_start")
    assert sorted(got) == sorted(want)


def test_known_runs_against_every_run():
    draw = random.Random(9)
    for _ in range(300):
        lines = ["".join(draw.choice("ab") for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(0, 9))]
        texts = {"".join(draw.choice("ab") for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(0, 25))}
        every = {"".join(lines[i:k]) for i in range(len(lines)) for k in range(i + 1, len(lines) + 1)}
        assert repetition.known_runs(lines, texts) == texts & every


def test_known_runs_of_a_long_lyric_look_at_few_ends():
    """6000 lines, as many texts: by substrings of all texts from all lines it would not end."""
    lines = [f"line{k}" for k in range(6000)]
    texts = {*lines, *(f"other{k}" for k in range(6000)), "line5line6"}
    assert repetition.known_runs(lines, texts) == {*lines, "line5line6"}
