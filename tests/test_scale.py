"""Forms that hold for long recordings, against plain versions."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cueframe.functions import text as text_functions
from cueframe.operators import audit, joins, metrics, reflow, structure, timeline


def test_intervals_meet_once(spark):
    """Short, long and endless intervals, before and after zero, on and beside the limits of nodes."""
    r = random.Random(1)
    at = lambda: r.choice([r.uniform(-5000, 5000), 60.0 * r.randrange(-600, 600), r.uniform(0, 9e6)])
    length = lambda: r.choice([0.0, 1.0, 60.0, 479.9, r.uniform(0, 90_000), 3e6])
    sides = []
    for n in (70, 90):
        sides.append([(r.choice("ab"), i, s, s + length()) for i in range(n) for s in [at()]])
    left, right = (spark.createDataFrame(x, "k string, id long, start double, end double") for x in sides)
    for margin in (0.0, 8.0):
        got = [(x.id, x.r_id) for x in joins.overlapping(left, right, "k", margin).select("id", "r_id").collect()]
        want = [(a[1], b[1]) for a in sides[0] for b in sides[1] if a[0] == b[0] and b[3] >= a[2] - margin and b[2] <= a[3] + margin]
        assert sorted(got) == sorted(want)


def test_nodes_of_long_intervals_are_few(spark):
    df = spark.createDataFrame([(0, 0), (0, 1439), (5, 100_000), (-7, 9)], "a long, b long")
    nodes = [r.n for r in df.select(joins.cover(F.col("a"), F.col("b")).alias("n")).collect()]
    for (a, b), own in zip([(0, 0), (0, 1439), (5, 100_000), (-7, 9)], nodes, strict=True):
        leaves = sorted(x for n in own for x in range(n.node * 8**n.level, (n.node + 1) * 8**n.level))
        assert leaves == list(range(a, b + 1))
    assert [len(n) for n in nodes][:2] == [1, 12] and len(nodes[2]) < 60


def plain_match(want, have):
    texts = [t for _, t, _ in want]
    starts = [i for i in range(len(have) - len(texts) + 1) if [x[1] for x in have[i : i + len(texts)]] == texts]
    return min(starts, key=lambda i: (abs(have[i][2] - want[0][2]), i), default=None)


def test_runs_of_equal_lines(spark):
    r = random.Random(2)
    wanted, there, expect = [], [], {}
    for track in range(60):
        have = [(i, r.choice("ab" if track % 2 else "abcd"), 4.0 * i) for i in range(r.randint(0, 25))]
        if have and r.random() < 0.7:
            k = r.randrange(len(have))
            texts = [t for _, t, _ in have[k : k + r.randint(1, 6)]]
        else:
            texts = [r.choice("abz") for _ in range(r.randint(1, 4))]
        want = [(i, t, r.uniform(0, 100) + i) for i, t in enumerate(texts)]
        wanted += [(track, *x) for x in want]
        there += [(track, *x, x[2] + 1) for x in have]
        expect[track] = plain_match(want, have)
    # a refrain of very many equal lines
    wanted += [(99, i, "la", 1000.0 + i) for i in range(3000)]
    there += [(99, i, "la", float(i), i + 1.0) for i in range(10_000)]
    expect[99] = 1000
    got = joins.timing_reference_match(spark.createDataFrame(wanted, "track_id long, pos long, text string, start double"), spark.createDataFrame(there, "track_id long, pos long, text string, start double, end double")).collect()
    first = {x.track_id: x.ref_pos for x in got if x.pos == 0}
    assert first == {t: i for t, i in expect.items() if i is not None}
    assert len(got) == sum(sum(w[0] == t for w in wanted) for t in first)
    assert all(x.ref_pos - first[x.track_id] == x.pos for x in got)


@pytest.mark.parametrize("buckets", [2, 7, 4096])
def test_ranks_by_histograms(spark, buckets):
    r = random.Random(buckets)
    groups = {"one": [1.0], "same": [2.5] * 50, "odd": [r.gauss(0, 1) for _ in range(301)], "tied": [float(r.randrange(4)) for _ in range(200)], "far": [10.0 ** r.randint(-300, 300) for _ in range(77)], None: [0.0, -0.0, 1e-320, float("inf"), -float("inf"), 3.0]}
    for p in (0.0, 0.5, 0.9, 1.0):
        df = spark.createDataFrame([(k, x, p) for k, xs in groups.items() for x in [*xs, None]], "k string, x double, share double")
        got = {x.k: x.value for x in metrics.nearest_ranks(df, ["k"], buckets).collect()}
        assert got == {k: sorted(xs)[max(1, math.ceil(p * len(xs))) - 1] for k, xs in groups.items()}


def plain_links(h, r, least):
    """Blocks of the whole section."""
    a, b = "".join(h), "".join(r)
    own_a, own_b = ([i for i, t in enumerate(side) for _ in t] for side in (h, r))
    shared = {}
    for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        for i in range(m.size):
            pair = own_a[m.a + i], own_b[m.b + i]
            shared[pair] = shared.get(pair, 0) + 1
    return {(*p, n) for p, n in shared.items() if n >= least * min(len(h[p[0]]), len(r[p[1]]))}, (a, b)


def changed(r, lines, words):
    out = []
    for line in lines:
        kind = r.random()
        if kind < 0.2:
            k = r.randrange(len(line) + 1)
            out += [x for x in (line[:k], line[k:]) if x]
        elif kind < 0.3 and out:
            out[-1] += line
        elif kind < 0.4:
            out.append("".join(c if r.random() < 0.8 else r.choice("xyz") for c in line))
        elif kind < 0.45:
            out.append("".join(r.choice(words) for _ in range(4)))
        elif kind > 0.5:
            out.append(line)
    return out or ["x"]


def test_anchored_links_are_those_of_whole_sections(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 7))) for _ in range(400)]
    sections = {}
    for k in range(40):
        lines = ["".join(r.choice(words) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 30))]
        lines += lines[:2] if r.random() < 0.5 else []  # a refrain is no anchor
        sections[k] = (lines, changed(r, lines, words))
    rows = [spark.createDataFrame([(k, i, t) for k, s in sections.items() for i, t in enumerate(s[side])], "s long, pos long, text string") for side in (0, 1)]
    got, alone = ({}, {})
    for out, size in ((got, 8), (alone, 0)):
        for x in metrics.char_links(*rows, "s", anchor=size).collect():
            out.setdefault(x.s, set()).add((x.h, x.r, x.shared))
    held = 0
    for k, (h, s) in sections.items():
        want, _ = plain_links(h, s, 0.3)
        assert alone.get(k, set()) == want
        anchors = [(h.index(t), s.index(t), len(t)) for t in set(h) & set(s) if h.count(t) == s.count(t) == 1 and len(t) >= 8]
        if all(a in want for a in anchors):
            held += 1
            assert got.get(k, set()) == want
    assert held > 30
    chain = metrics.anchors(*[d.select("s", F.col("pos").alias("n"), "text") for d in rows], "s", 8)
    assert chain.count() > 100


def test_chains_rise(spark):
    r = random.Random(4)
    for _ in range(200):
        b = [r.randrange(30) for _ in range(r.randrange(12))]
        b = list(dict.fromkeys(b))
        a = list(range(len(b)))
        out = metrics._increasing(a, b)
        assert all(b[i] < b[j] for i, j in zip(out, out[1:], strict=False))
        longest = [1] * len(b)
        for j in range(len(b)):
            longest[j] += max([longest[i] for i in range(j) if b[i] < b[j]], default=0)
        assert len(out) == max(longest, default=0)


def test_a_long_section_falls_into_many_parts(spark):
    n = 20_000
    cues = spark.range(n).select(F.lit(1).alias("s"), F.col("id").alias("pos"), F.concat(F.lit("line number "), F.sha1(F.col("id").cast("string"))).alias("text"))
    other = cues.where("pos % 10 <> 3").withColumn("text", F.when(F.col("pos") % 10 == 5, F.concat(F.lit("new "), "text")).otherwise(F.col("text")))
    links = metrics.char_links(cues, other, "s")
    assert links.where("h = r").count() == n * 9 // 10 and links.count() == n * 9 // 10


def plain_lag(a, b, most):
    import numpy as np

    if len(a) != len(b):
        b = np.interp(np.linspace(0, len(b) - 1, len(a)), np.arange(len(b)), b)
    best = (-1.0, 0)
    most = max(0, min(most, len(a) - 4))
    for lag in range(-most, most + 1):
        x, y = (a[-lag:], b[:lag]) if lag < 0 else (a[: len(a) - lag], b[lag:])
        x, y = x - x.mean(), y - y.mean()
        size = np.linalg.norm(x) * np.linalg.norm(y)
        r = x @ y / size if size > 1e-12 else 0.0
        if r > best[0]:
            best = (r, lag)
    return best


def test_lags_at_once():
    import numpy as np

    from cueframe.operators import signal

    r = np.random.default_rng(5)
    for k in range(300):
        a, b = r.normal(size=r.integers(4, 80)), r.normal(size=r.integers(4, 80))
        if k % 4 == 1:
            a = np.tile(np.array([1.0, 0, 0, 2]), 12)
            b = a.copy()
        if k % 4 == 2:
            a = np.round(a)
            b = np.zeros_like(b) if k % 8 == 2 else 1e5 + np.round(b)
        most = int(r.integers(0, 30))
        got, want = signal.best_lag(a, b, most), plain_lag(a, b, most)
        assert abs(got[0] - min(1, max(0, want[0]))) <= 1e-9 and got[1] == want[1], k


def test_long_recordings_in_chunks(spark):
    import numpy as np

    from cueframe.operators import signal

    r = np.random.default_rng(6)
    rows, want = [], {}
    for track, n in enumerate((0, 30, 64, 79, 80, 81, 83, 88, 96, 100, 160, 163, 333, 1000)):
        x = r.normal(size=n) * np.repeat(r.random(n // 10 + 1), 10)[:n] if track != 10 else np.zeros(n)
        want[track] = signal.envelope(x, 40, 8)
        rows += [(track, c, x[c * 80 : c * 80 + 80].tolist()) for c in range(max(1, -(-n // 80)))]
    got = {}
    for x in signal.long_envelope(spark.createDataFrame(rows, "track_id int, chunk int, samples array<double>"), 40, 8).orderBy("track_id", "chunk").collect():
        got.setdefault(x.track_id, []).extend(x.onsets)
    for track, x in want.items():
        assert np.allclose(got[track], x, rtol=0, atol=1e-12), track
    assert signal.long_envelope(spark.createDataFrame([], "track_id int, chunk int, samples array<double>"), 40, 8).count() == 0


def plain_pairing(texts, times, lines, at):
    """Every cell of the table, one after another."""
    from cueframe.operators.align import GAP, _similar

    n, m = len(texts), len(lines)
    place = [[abs((t - times[0]) / max(1, times[-1] - times[0]) - (x - at[0]) / max(1, at[-1] - at[0])) for x in at] for t in times]
    total = [[-GAP * (i + j) if not i or not j else 0.0 for j in range(m + 1)] for i in range(n + 1)]
    step = {}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            options = [(total[i - 1][j] - GAP, -1, 0.0), (total[i][j - 1] - GAP, 0, 0.0)]
            for k in range(1, min(3, j) + 1):
                alike = _similar(texts[i - 1], "".join(lines[j - k : j]))
                if k > 1 and (alike != 1.0 or texts[i - 1] != "".join(lines[j - k : j])):
                    continue
                options.append((total[i - 1][j - k] + (2.4 * alike - 0.8 * place[i - 1][j - k] - 0.35 + 0.6 * (alike == 1.0)), k, alike))
            total[i][j], *step[i, j] = max(options, key=lambda o: o[0])
    found, i, j = [], n, m
    while i and j:
        k, alike = step[i, j]
        if k > 0 and alike >= GAP:
            found.append((i - 1, j - k, j - 1, alike, place[i - 1][j - k]))
        i, j = i - (k != 0), j - (1 if k == 0 else max(k, 0))
    return found[::-1]


def test_banded_walks_are_those_of_the_whole_table(monkeypatch):
    from cueframe.operators import align

    r = random.Random(7)
    compared = []
    real = align._similar
    monkeypatch.setattr(align, "_similar", lambda a, b: compared.append(1) or real(a, b))
    for _ in range(150):
        m = r.randint(1, 18)
        lines = ["".join(r.choice("abcde") for _ in range(r.randint(0, 8))) for _ in range(m)]
        at = [0]
        for _ in lines[1:]:
            at.append(at[-1] + r.choice([0, 1000, 4000]))
        texts, times, j = [], [], 0
        while j < m:
            k = r.choice([1, 1, 1, 2, 3])
            if r.random() < 0.8:
                t = "".join(lines[j : j + k])
                texts.append("".join(c if r.random() < 0.9 else r.choice("xyz") for c in t) if r.random() < 0.5 else t)
                times.append(at[j] + r.randint(-500, 500))
            j += k
        if texts:
            got, want = align._pairing(texts, times, lines, at), plain_pairing(texts, times, lines, at)
            assert [x[:3] for x in got] == [x[:3] for x in want]
            assert all(abs(a - b) < 1e-12 for x, y in zip(got, want, strict=True) for a, b in zip(x[3:], y[3:], strict=True))
    # a long track with few changes is compared within a narrow band only
    words = ["".join(r.choice("abcdefghij") for _ in range(12)) for _ in range(400)]
    compared.clear()
    got = align._pairing(words, list(range(400)), words, list(range(400)))
    assert [(i, j) for i, j, *_ in got] == [(i, i) for i in range(400)] and len(compared) < 400 * 400 / 4


def test_bars_add_weights_in_order(spark):
    """The whole weight of a bar is that of its last section, to the last bit, in whatever order the sections come."""
    r = random.Random(3)
    rows = [(c, i, "song", float(i), i + r.random() * 100 / 3) for c in range(40) for i in range(50)]
    r.shuffle(rows)
    got = timeline._weighed(spark.createDataFrame(rows, "concert_id long, section_id long, type string, start double, end double")).where("i = n - 1").collect()
    assert len(got) == 40 and all(x["run"] == x["total"] for x in got)


def test_long_texts_of_one_alphabet_are_compared_where_walks_lead(monkeypatch):
    """Missing and changed lines of like letters: the walk of all comparisons, by few of them."""
    from cueframe.operators import align

    r = random.Random(11)
    lines = ["".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(160)]
    kept = [i for i in range(160) if i % 7 != 6]
    texts = [lines[i][:40] + "xy" * 10 if i % 5 == 2 else lines[i] for i in kept]
    compared = []
    real = align._similar
    monkeypatch.setattr(align, "_similar", lambda a, b: compared.append(1) or real(a, b))
    got = align._pairing(texts, kept, lines, list(range(160)))
    assert [(x[0], x[1]) for x in got] == list(enumerate(kept)) and len(compared) < 160 * 4


def test_blocks_by_pieces_as_difflib(monkeypatch):
    r = random.Random(9)
    for k in range(400):
        a = "".join(r.choice("ab" if k % 2 else "abcdefgh") for _ in range(r.randint(0, 120)))
        b = "".join(c if r.random() < 0.9 else r.choice("abx") for c in a)[r.randint(0, 9) :] + a[: r.randint(0, 60)]
        got, want = [], []
        for out, blocks in ((got, metrics._matching(a, b)), (want, SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())):
            for x, y, n in blocks:
                out += [(x + i, y + i) for i in range(n)]
        assert got == want
    # two long texts that differ in few places meet in few pieces
    text = "".join(r.choice("abcdefghijklmnop") for _ in range(6000))
    other = "".join(c + ("." if i % 200 == 199 else "") for i, c in enumerate(text))
    sizes = []
    real = SequenceMatcher.find_longest_match
    monkeypatch.setattr(SequenceMatcher, "find_longest_match", lambda self, i, j, k, l: sizes.append((j - i) * sum(len(x) for x in self.b2j.values()) / max(1, len(self.b2j))) or real(self, i, j, k, l))
    assert sum(n for *_, n in metrics._blocks(text, other, False, False)) == 6000 and sum(sizes) < 6000 * 6000 / 100


def test_a_cue_that_its_words_spell_needs_no_blocks(monkeypatch):
    """Whole turns met by just their words: neither the matrix of all cells nor difflib is asked."""
    from collections import namedtuple

    from cueframe.operators import align, runs

    def none(*_):
        raise AssertionError("asked")

    monkeypatch.setattr(runs, "Blocks", none)
    monkeypatch.setattr(align, "SequenceMatcher", none)
    said = [f"w{k}x{k * k}" for k in range(300)]
    words = [(0.5 + 0.33 * k, 0.8 + 0.33 * k, w, 0.9) for k, w in enumerate(said)]
    cue = namedtuple("Cue", "start end t")(0.0, 99.0, "".join(said))
    p, used = align._proposal(cue, runs.Words(words), 0, align.BoundaryPolicy())
    assert (p["score"], p["coverage"], p["new"], used) == (1.0, 1.0, [0.5, 99.47], 300)


def test_powers_of_the_rolling_hash(spark):
    some = [0, 1, 2, 63, 64, 65, 4095, 4096, 999_999, 2**31, 2**40 + 12_345, 2**42 - 1]
    df = spark.createDataFrame([(k,) for k in some], "k bigint")
    assert {r[0]: r[1] for r in df.select("k", joins._power(F.col("k"))).collect()} == {k: pow(joins.BASE, k, joins.PRIME) for k in some}


def test_a_run_is_looked_up_with_few_shuffles(spark):
    """Both hashes of a side are rolled in one pass: before, each side was read and joined again for each hash."""
    e = spark.createDataFrame([(1, k, f"t{k}", float(k)) for k in range(3)], "track_id int, pos int, text string, start double")
    r = spark.createDataFrame([(1, k, f"t{k % 4}", float(k), k + 0.5) for k in range(12)], "track_id int, pos int, text string, start double, end double")
    out = joins.timing_reference_match(e, r)
    assert [(x.pos, x.ref_pos) for x in out.orderBy("pos").collect()] == [(0, 0), (1, 1), (2, 2)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 4


def test_holding_is_containment(spark):
    """Negative times, intervals that begin or end at a leaf's edge, long ones, ones turned round, and nulls."""
    r = random.Random(12)
    span = lambda: r.choice([0.0, 0.3, 5.0, 59.95, 60.0, 3600.0, 90_000.0, 3_000_000.0, -0.02, -7.0])
    make = lambda n: [(i, r.randrange(3), a, a + span()) for i in range(n) for a in [r.choice([-60.0, -0.05, 0.0, 59.95, 60.05, 3840.0, 245_760.0, r.uniform(-5000, 300_000)])]]
    left, right = make(250), make(250) + [(900, 0, None, 1.0), (901, 0, 1.0, None)]
    frames = [spark.createDataFrame(x, "id int, k int, start double, end double") for x in (left, right)]
    for margin in (0.0, 0.05):
        got = [(x.id, x.r_id) for x in joins.holding(*frames, "k", margin).select("id", "r_id").collect()]
        lies = lambda x, y: None not in y and x[1] == y[1] and y[2] >= x[2] - margin and y[3] <= x[3] + margin and y[3] >= x[2] - margin and y[2] <= x[3] + margin  # noqa: B023, E731
        want = sorted((x[0], y[0]) for x in left for y in right if lies(x, y))
        assert sorted(got) == want and len(want) > 100


def test_cues_are_cut_in_one_pass(spark):
    """Each text is looked through once, and the cues and their segments meet once."""
    cues = spark.createDataFrame([(1, 0, 0.0, 9.0, "One! Two!", "Eins! Zwei!")], "section_id int, pos long, start double, end double, source_text string, translation string")
    heard = spark.createDataFrame([(1, 0.0, 4.0, "One!", [(0.0, 4.0, "One!")]), (1, 4.0, 9.0, "Two!", [(4.0, 9.0, "Two!")])], "section_id int, start double, end double, text string, words array<struct<start:double,end:double,text:string>>")
    out = reflow.split_events(cues, heard)
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert max(line.count("regexp_replace") for line in plan) <= 4
    assert sum("MapInArrow" in line for line in plan) == 1 and not any("Union" in line for line in plan) and sum("Join Inner" in line for line in plan) == 1
    assert [(x.part, x.start, x.end, x.source_text, x.translation) for x in out.orderBy("new_pos").collect()] == [(0, 0.0, 3.98, "One!", "Eins!"), (1, 4.0, 9.0, "Two!", "Zwei!")]


def test_phones_meet_lines_by_place(spark):
    """Silences, other phones, too few and too many, lines without phones, no track; no phone is dealt a second time."""
    r = random.Random(3)
    phones, lines = [], []
    for t in [*range(150), None]:
        phones += [(t, 2 * n, float(n), n + 0.5, r.choice(["a", "a", "b", "AP", "SP", None])) for n in range(r.randint(0, 14))]
        lines += [(t, n, r.choice([None, []]) if r.random() < 0.1 else [r.choice(["a", "a", "a", "b", None]) for _ in range(r.randint(1, 4))]) for n in range(r.randint(0, 5))]
    p = spark.createDataFrame(phones, "track_id long, n long, start double, end double, phone string")
    timed, wrong = joins.phone_lines(p, spark.createDataFrame(lines, "track_id long, line long, phones array<string>"))
    want, first = {}, {}
    for t in [*range(150), None]:
        heard = [x for x in phones if x[0] == t and x[4] not in ("AP", "SP", None)]
        said = [(n, x) for u, n, own in lines if u == t for x in own or []]
        met = [] if t is None else list(zip(said, heard, strict=False))
        for i in range(len(said)):
            want.setdefault((t, said[i][0]), []).append(heard[i] if i < len(met) else None)
        faults = [i + 1 for i, ((_, x), h) in enumerate(met) if x != h[4]] + [i + 1 for i in range(len(met), len(said)) if said[i][1]] + [len(met) + 1] * (len(heard) > len(met))
        if faults:
            first[t] = min(faults)
    assert {(x.track_id, x.line): (x.start, x.end, x.lost) for x in timed.collect()} == {k: (v[0] and v[0][2], v[-1] and v[-1][3], v.count(None)) for k, v in want.items()}
    assert {x.track_id: x.first_mismatch for x in wrong.collect()} == first
    for out in (timed, wrong):
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_beats_meet_one_row_of_onsets(spark):
    """Ranges over the edge of a second, clamped at zero, without onsets, and turned round; parts are read once."""
    r = random.Random(5)
    parts = [(t, f"{t}{k}", a, a + r.choice([0.0, 2.0, 7.3, 8.0, 31.7, -3.0]), r.choice([1, 4, 5, 8, 12, 17])) for t in range(40) for k in range(4) for a in [r.choice([0.0, -0.3, 3.98, r.uniform(0, 20)])]]
    onsets = [(t, i, r.choice([1.0, 2.0, 30.0, 0.0, None])) for t in range(38) for i in r.sample(range(3000), 900)]
    frames = spark.createDataFrame(parts, "track_id int, part string, start double, end double, beats int"), spark.createDataFrame(onsets, "track_id int, i long, value double")
    want = []
    for t, part, a, b, beats in parts:
        want += [(part, 0, a, False), (part, beats, b, False)]
        for beat in range(4, beats, 4):
            step = (b - a) / beats
            at, radius = a + step * beat, min(0.25, step * 0.35)
            near = [(v, -i) for u, i, v in onsets if u == t and v is not None and max(0, math.ceil((at - radius) * 100)) <= i <= math.floor((at + radius) * 100)]
            told = near and max(near)[0] > max(1e-6, 2.5 * sum(v for v, _ in near) / len(near))
            want.append((part, beat, -max(near)[1] / 100.0 if told else at, bool(told)))
    out = structure.beat_anchors(*frames)
    assert sorted((x.part, x.beat, x.time, x.supported) for x in out.collect()) == sorted(want) and sum(x[3] for x in want) > 20
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan


def test_short_texts_do_without_difflib(monkeypatch):
    """With junk as without it, as a second text of fewer than 200 characters has none."""
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefg 日本") for _ in range(n))
    pairs = [(text(r.choice([3, 90, 250])), text(n)) for n in (1, 2, 50, 150, 198, 199, 200, 201, 320) for _ in range(12)]
    want = [min(len(x), len(y)) / max(len(x), len(y)) if x in y or y in x else SequenceMatcher(None, x, y).ratio() for x, y in pairs]
    asked = []
    monkeypatch.setattr(text_functions, "SequenceMatcher", lambda *p: asked.append(len(p[2])) or SequenceMatcher(*p))
    assert [text_functions._ratio(x, y, True) for x, y in pairs] == want
    assert asked and min(asked) >= 200


def test_speech_is_normalised_before_it_meets_lyrics(spark):
    """Pairs take finished texts."""
    row = "section_id int, id int, start double, end double, text string"
    heard = spark.createDataFrame([(1, 7, 0.0, 2.0, " Hello {x}there "), (1, 8, 30.0, 32.0, "something")], row).withColumn("probability", F.lit(0.8))
    lyrics = spark.createDataFrame([(1, 0, 4.0, 6.0, "hello"), (1, 1, 9.0, 11.0, None)], row)
    out = joins.speech_candidates(heard, lyrics, spark.createDataFrame([], "section_id int, start double, end double"))
    assert [(x.id, x.location, x.similarity) for x in out.orderBy("id").collect()] == [(8, "coda", 0.0)]  # the other one is half the same
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.split("\n") if "ArrowEvalPython [score" in x]
    assert len(lines) == 1 and "regexp_replace" not in lines[0] and "run(" not in lines[0]
    assert not any("regexp_replace" in x and "r_text" in x for x in plan.split("\n"))


def test_runs_are_measured_row_by_row(spark):
    """The items of a batch are no Python objects at once."""
    rows = [(1, [1, None, 2, 3]), (2, None), (3, [None]), (4, [5, 6])]
    a, b = spark.createDataFrame(rows, "id int, items array<int>"), spark.createDataFrame([(1, [2, 3, None]), (2, [1]), (3, [None]), (4, [])], "id int, items array<int>")
    out = audit.longest_common_run(a, b, "id")
    assert {x.id: x.run for x in out.collect()} == {1: 2, 2: 0, 3: 0, 4: 0}
    assert "MapInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_anchors_of_concerts_take_no_hash_tables(spark):
    """The latest end of each start comes from a sort."""
    from cueframe.plans import QUERIES

    out = QUERIES["j18_interpolate"](spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == out.sparkSession.read.parquet("/root/testdata/sf0.001/orders.parquet").count() and out.where("value IS NOT NULL").count() > 0
