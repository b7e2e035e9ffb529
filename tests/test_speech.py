"""Runs of words, readings, and cuts of speech cues."""

import random

import pytest

from cueframe.functions import text as T
from cueframe.operators import reflow
from cueframe.operators.runs import Blocks, Words, best_run


def plain_run(text, start, end, words, used, margin, least, per_second, per_character, fold=None):
    """Every run compared in full."""
    n, middle, top, top_rank = len(text), (start + end) / 2, None, None
    near = [k for k in range(used, len(words)) if words[k][1] >= start - margin and words[k][0] <= end + margin]
    for p, a in enumerate(near):
        run = ""
        for q in range(p, min(len(near), p + max(8, 2 * n + 4))):
            b = near[q]
            run += words[b][2]
            if b - a != q - p or len(run) > max(n + 4, int(n * 1.75)):
                break
            if len(run) < max(1, int(n * 0.45)):
                continue
            score = T._ratio(text, run, False)
            if fold:
                score = max(score, T._ratio(fold(text), fold(run), False))
            rank = score - per_second * abs((words[a][0] + words[b][1]) / 2 - middle) - per_character * abs(len(run) - n)
            if top_rank is None or (rank, -words[a][0]) > top_rank:
                top, top_rank = (score, a, b), (rank, -words[a][0])
    return top if top and top[0] >= least else None


@pytest.mark.parametrize("seed,fold", [(1, None), (2, T.kana_folded)])
def test_best_run_as_comparing_every_run(seed, fold):
    r = random.Random(seed)
    for _ in range(600):
        alphabet = r.choice(["ab", "abcdef", "あアいイかカきキんン", "abcdefghijklmnopqrstuvwxyz"])
        words, at = [], 0.0
        for _ in range(r.randint(0, 25)):
            at += r.choice([0, 0.1, 0.3, 2])
            words.append((at, at + r.choice([0.1, 0.3, 3]), "".join(r.choice(alphabet) for _ in range(r.randint(0, 5))), None))
        words.sort()
        base = "".join(w[2] for w in words)
        k = r.randrange(len(base) + 1)
        text = base[k : k + r.randint(0, 30)] if r.random() < 0.6 else "".join(r.choice(alphabet) for _ in range(r.randint(0, 20)))
        text = "".join(c if r.random() < 0.85 else r.choice(alphabet) for c in text)
        start = r.uniform(0, at + 1)
        args = (start, start + r.uniform(0.1, 6))
        rest = (r.randint(0, 3), 2.0, 0.55, 0.05, 0.01)
        assert best_run(text, *args, Words(words, fold), *rest) == (plain_run(text, *args, words, *rest, fold) if text else None)


def test_blocks_as_difflib():
    from difflib import SequenceMatcher

    r = random.Random(3)
    for _ in range(400):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(2))
        assert Blocks(a, b).at_least((0, len(a), 0, len(b)), 0) == sum(x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_runs_of_long_turns_end():
    r = random.Random(4)
    words = ["".join(r.choice("aeioutnsrh") for _ in range(r.randint(2, 8))) for _ in range(620)]
    timed = [(k * 0.33, k * 0.33 + 0.3, w, None) for k, w in enumerate(words[:310])]
    found = best_run("".join(words[5:305]), 5 * 0.33, 305 * 0.33, Words(timed), 0, 2.0, 0.55, 0.05, 0.01)
    assert found == (1.0, 5, 304)


def test_similarity_by_reading(spark):
    df = spark.createDataFrame([("カラオケ", "からおけ"), ("カラ", "からおけ"), ("空カラ", "空から"), ("abc", "ABC!"), ("", "x"), (None, "x")], "a string, b string")
    got = [r.s for r in df.select(T.similarity(df.a, df.b).alias("s")).collect()]
    assert got == [1.0, 0.5, 1.0, 1.0, 0.0, 0.0]
    assert [r.s for r in df.select(T.contained_similarity(df.a, df.b).alias("s")).collect()][:4] == [1.0, 0.5, 1.0, 1.0]


CUE = "section_id string, pos long, start double, end double, source_text string, translation string"
SEGMENT = "section_id string, start double, end double, text string, words array<struct<start:double,end:double,text:string>>"


def split(spark, cue, segments):
    heard = [("s", a, b, t, [(a, b, t)]) for a, b, t in segments]
    return reflow.split_events(spark.createDataFrame([("s", 0, *cue)], CUE), spark.createDataFrame(heard, SEGMENT)).orderBy("part").collect()


def test_cuts_at_timed_segments(spark):
    source, target = "私たちも今日でライブ納めなので 盛り上げて楽しんでいきたいと思いますよろしくね", "我们今天也是今年最后一场演出，所以一起尽情热闹、尽情享受吧！"
    heard = [(10.0, 11.8, "私たちも今日でライブ納めなので"), (11.8, 15.0, "盛り上げて楽しんでいきたいと思いますよろしくね")]
    out = split(spark, (10.0, 15.0, source, target), heard)
    assert [p.source_text for p in out] == ["私たちも今日でライブ納めなので", "盛り上げて楽しんでいきたいと思いますよろしくね"]
    assert [p.translation for p in out] == ["我们今天也是今年最后一场演出，", "所以一起尽情热闹、尽情享受吧！"]
    assert [(p.start, p.end) for p in out] == [(10.0, 11.78), (11.8, 15.0)]


def test_cuts_a_short_reply_by_its_words(spark):
    said = "ファンクラブにあげた動画でヒントとかも言ってたんだよね"
    out = split(spark, (53.84, 58.94, said + " 言ってた", "我们在发到粉丝俱乐部的视频里也给过提示吧？给过"), [(53.84, 58.24, said), (58.24, 58.94, "言ってた")])
    assert [(p.source_text, p.start) for p in out] == [(said, 53.84), ("言ってた", 58.24)] and out[1].translation == "给过"


def test_two_sentences_against_one(spark):
    out = split(spark, (20.0, 24.0, "今日は最後です。楽しもう", "今天是最后一场，一起享受吧"), [(20.0, 21.8, "今日は最後です"), (21.8, 24.0, "楽しもう")])
    assert [p.source_text for p in out] == ["今日は最後です。", "楽しもう"] and out[1].start == 21.8
    # without timed segments nothing tells of a second part, and long texts without sentence ends stay whole
    assert len(split(spark, (20.0, 24.0, "今日は最後です。楽しもう", "今天是最后一场，一起享受吧"), [])) == 1
    assert len(split(spark, (0.0, 90.0, "あ" * 200, "中" * 200), [])) == 1


def test_parts_are_bounded(spark):
    cues = [("s", 0, 0.0, 1.0, "一。二。三。", "a。b。c。"), ("s", 1, 2.0, 12.0, "一。" * 9, "a。" * 9), ("s", 2, 13.0, 14.0, "「はい。」", "「是。」"), ("s", 3, 15.0, 20.0, None, "x"), ("s", 4, 21.0, 25.0, "一。二。", "a！b")]
    out = reflow.split_events(spark.createDataFrame(cues, CUE).withColumn("merged", T.F.col("pos") == 4))
    assert {r.pos: r.n for r in out.groupBy("pos").agg(T.F.count("*").alias("n")).collect()} == {0: 2, 1: 6, 2: 1, 3: 1, 4: 1}
    assert [r.new_pos for r in out.orderBy("new_pos").collect()] == list(range(11))
    assert reflow.split_events(spark.createDataFrame([], CUE)).count() == 0


def test_metrics_count_cuts_and_joins_apart(spark):
    kind = CUE + ", speakers array<string>, evidence array<string>"
    cues = spark.createDataFrame([("s", 0, 0.0, 1.0, "今日が最後なので", "因为是最后", ["a"], []), ("s", 1, 1.2, 3.0, "楽しんでね", "请尽情享受", ["a"], []), ("s", 2, 4.0, 8.0, "一。二", "a。b", ["a"], [])], kind)
    m = reflow.reflow_metrics(cues, reflow.split_events(reflow.merge_short_prefixes(cues))).first()
    assert (m.cues_before, m.cues_after, m.splits, m.merges, m.source_units, m.translation_units) == (3, 3, 1, 1, 26, 20)
