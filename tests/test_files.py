"""The subtitle data source, post copies, previews and known lines."""

import pytest
from pyspark.sql import functions as F

from cueframe.operators import audit, lyrics, repetition
from cueframe.sources import datasource as ds
from cueframe.sources import readers

CUE = "name string, pos int, start double, end double, text string"
ROWS = [("a/one", 0, 0.0, 1.5, "hello"), ("a/one", 1, 3661.25, 3662.0, "two\nlines"), ("b", 0, 5.0, 6.07, "x"), ("c", 0, 1.0, 2.0, "été 日本")]


@pytest.mark.parametrize("kind", ds.KINDS)
def test_files_round_trip(spark, tmp_path, kind):
    path = f"file://{tmp_path}/files"
    ds.write_subtitles(spark.createDataFrame(ROWS, CUE).repartition(4), path, kind)
    got = ds.read_subtitles(spark, path, kind)
    assert got.schema.simpleString() == "struct<name:string,pos:int,start:double,end:double,text:string>"
    lrc = kind == "lrc"
    want = {(n, p, s, None if lrc else e, " ".join(t.split()) if lrc else t) for n, p, s, e, t in ROWS}
    assert set(map(tuple, got.collect())) == want
    # one file a task
    assert spark.read.format("subtitles").option("kind", kind).option("split_bytes", 1).load(path).rdd.getNumPartitions() == 3
    # more files beside, then all replaced
    ds.write_subtitles(spark.createDataFrame([("d", 0, 1.0, 2.0, "new")], CUE), path, kind)
    assert ds.read_subtitles(spark, path, kind).select("name").distinct().count() == 4
    ds.write_subtitles(spark.createDataFrame([("d", 0, 1.0, 2.0, "new")], CUE), path, kind, "overwrite")
    assert [r.name for r in ds.read_subtitles(spark, path, kind).collect()] == ["d"]
    assert sorted(p.name for p in (tmp_path / "files").iterdir() if p.is_file()) == [f"d.{kind}"] and not list((tmp_path / "files").glob("_aside*"))


def test_files_as_the_readers_of_tables_have_them(spark, tmp_path):
    srt = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nfirst\\Nsecond\r\n\r\n\r\nnote\n2\n00:01:00.000 --> 00:01:01.000\n\n3\n00:02:00,000 --> 00:02:01,000\n  last  \n"
    ass = "[Events]\nDialogue: 0,0:00:01.00,0:00:02.50,Default,,0,0,0,,{\\i1}a, b\\Nc\nComment: 0,0:00:01.00,0:00:02.50,D,,0,0,0,,x\nDialogue: 0,1:00:00.05,1:00:01.00,D,,0,0,0,, \n"
    lrc = "[ti:x]\n[00:01.50]one\n[01:02]two\n[00:03.00]\nplain\n"
    for kind, text, parse in (("srt", srt, lambda f: readers.parse_srt(f, "all")), ("ass", ass, readers.parse_ass), ("lrc", lrc, readers.parse_lrc)):
        (tmp_path / f"x.{kind}").write_text(text, encoding="utf-8", newline="")
        files = spark.createDataFrame([("x", text)], "path string, text string").withColumn("text", readers.plain("text"))
        got = ds.read_subtitles(spark, f"file://{tmp_path}", kind).orderBy("pos").collect()
        want = parse(files).orderBy("pos").collect()
        starts = [r.ms / 1000 if kind == "lrc" else r.start for r in want]
        assert [(r.pos, r.start, r.text) for r in got] == [(r.pos, s, r.text) for r, s in zip(want, starts, strict=True)] and got


def test_a_name_in_two_tasks_is_refused(spark, tmp_path):
    spark.dataSource.register(ds.SubtitleSource)
    rows = spark.createDataFrame([("a", 0, 0.0, 1.0, "x"), ("a", 1, 1.0, 2.0, "y")], CUE).repartition(2)
    with pytest.raises(Exception, match="several tasks"):
        rows.write.format("subtitles").mode("append").save(f"{tmp_path}/bad")
    assert not list(tmp_path.rglob("*.srt"))


COPY = """intro
## 微博
标题：Song of rain
## 小红书
标题：Song

First line
标题？no field

正文goes on
上一篇：old one
上一篇笔记ID：0123456789abcdef01234567
话题：#a
标签：#b
## B站
标题：
标题：Song again
正文：text https://other.example/x
上一篇：BV1234567890
"""


def test_copies(spark):
    df = spark.createDataFrame([(1, COPY), (2, "## B站\n标题：a\n标题：b\n## B站\n"), (3, ""), (4, None)], "copy_id long, text string")
    posts, faults = audit.parse_copies(df)
    got = {r.platform: r for r in posts.collect()}
    assert set(got) == {"微博", "小红书", "B站"}
    assert got["小红书"].body == "First line\n标题？no field\n\n正文goes on\n上一篇：old one" and got["小红书"].tags == "#b" and got["小红书"].title == "Song"
    assert got["B站"].title == "Song again" and got["B站"].body == "text https://other.example/x\n上一篇：BV1234567890"
    assert {tuple(r) for r in faults.collect()} == {(2, "B站", "platform_repeated"), (2, "B站", "field_repeated")}
    songs = spark.createDataFrame([(1, "Song")], "copy_id long, song string")
    assert {tuple(r) for r in audit.copy_faults(posts, songs, None, True).collect()} == {(1, "微博", "missing_post"), (1, "B站", "url_off_site")}


def test_preview_points(spark):
    cues = [("t", 0, 1.0, 2.0), ("t", 1, 3.0, 9.0), ("t", 2, 8.0, 8.5), ("u", 0, 0.0, 1.0)]
    got = sorted((r.track_id, r.label, r.pos) for r in lyrics.preview_points(spark.createDataFrame(cues, "track_id string, pos long, start double, end double")).collect())
    # a cue comes under its first label alone
    assert got == [("t", "early_sync", 0), ("t", "late_sync", 2), ("t", "middle_sync", 1), ("t", "overlap", 2), ("u", "early_sync", 0)]


def test_blocks_of_known_lines(spark):
    texts = ["a b", "c", "x", "a b", "c", "x", "d", "c"]
    c = spark.createDataFrame([("s", i, "lyric", t, None) for i, t in enumerate(texts)], "section_id string, pos long, role string, source_text string, canonical_source_text string")
    policy = repetition.RepetitionPolicy(min_block_events=2)
    every = [(r["first"], r["last"]) for r in repetition.repetition_groups(c, policy).orderBy("first").collect()]
    known = spark.createDataFrame([("s", 0, "A"), ("s", 1, "b!"), ("s", 2, "c"), ("s", 3, "d")], "section_id string, line int, text string")
    told = [(r["first"], r["last"]) for r in repetition.repetition_groups(c, policy, known).orderBy("first").collect()]
    assert every == [(0, 2), (3, 5)] and told == [(0, 1), (3, 4)]  # x is no line, and breaks blocks


def test_lines_that_begin_with_their_own_number_stay_whole(spark):
    """A trimming function must not take a line's place in its block for what it trims."""
    srt = "1\n00:00:01,000 --> 00:00:02,500\n0 first 0\n 1 second 1 \n"
    files = spark.createDataFrame([("x", srt)], "path string, text string")
    assert [r.text for r in readers.parse_srt(files, "all").collect()] == ["0 first 0\n1 second 1"]
    from cueframe.functions import text as T

    df = spark.createDataFrame([("0 zero 0\n 1 かな 1 ",)], "t string")
    assert tuple(df.select(T.split_bilingual(df.t).alias("p")).first().p) == ("0 zero 0", "1 かな 1")
