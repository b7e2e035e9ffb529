"""Files in and out."""

from cueframe.sources import readers, writers


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_srt(spark, tmp_path):
    path = put(tmp_path, "a.srt", "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\n译文\r\n原文\r\n\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n\r\n3\r\n00:01:00,000 --> 00:01:01,000\r\nlast\r\n")
    got = [(r.pos, r.start, r.end, r.text) for r in readers.read_srt(spark, path).orderBy("pos").collect()]
    assert got == [(0, 1.0, 2.5, "原文"), (1, 60.0, 61.0, "last")]
    assert readers.read_srt(spark, path, "first").orderBy("pos").first().text == "译文"
    assert readers.read_srt(spark, path, "all").orderBy("pos").first().text == "译文\n原文"


def test_ass(spark, tmp_path):
    path = put(tmp_path, "a.ass", "[Events]\nDialogue: 0,0:00:01.00,0:00:02.50,Default,,0,0,0,,a, b\\Nc\nComment: 0,0:00:01.00,0:00:02.00,,,,,,,no\nDialogue: short\n")
    assert [(r.start, r.end, r.text) for r in readers.read_ass(spark, path).collect()] == [(1.0, 2.5, "a, b\nc")]


def test_vtt_and_lrc(spark, tmp_path):
    vtt = put(tmp_path, "a.vtt", "WEBVTT\n\n00:01.000 --> 00:02.000 align:start\n<c>one</c> &amp; <00:00:01.500>two\n{x}three  four\n")
    assert [(r.start_ms, r.end_ms, r.text) for r in readers.read_vtt(spark, vtt).collect()] == [(1000, 2000, "one & two　three four")]
    lrc = put(tmp_path, "a.lrc", "[ti:x]\n[00:01.50]one\n[00:02.00]\n[01:00.00] two \n")
    assert [(r.ms, r.text) for r in readers.read_lrc(spark, lrc).orderBy("ms").collect()] == [(1500, "one"), (60000, "two")]


def test_lyric_lines(spark):
    df = spark.createDataFrame([("p", "My Song\nAnn\n[00:01.00]first\nMusic: x\n[tag]\nMy Song\n", ["my song", "ANN"])], "path string, text string, meta array<string>")
    assert [r.text for r in readers.parse_lyric_lines(df, metadata="meta").orderBy("line").collect()] == ["first", "My Song"]


def test_json(spark):
    texts = ['{"segments":[{"start":2,"end":3,"text":" b "},{"start":1,"end":2,"text":"a","words":[{"start":1,"end":1.5,"text":"a"},{"start":2,"end":1,"text":"x"}]},{"start":5,"end":4,"text":"no"}]}', '[{"start":0,"end":1,"text":"c"}]', '{"start":0,"end":1,"text":"d"}', "broken"]
    df = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    got = {(r.path, r.seg, r.text): len(r.words) for r in readers.parse_transcripts(df).collect()}
    assert got == {(0, 0, "a"): 1, (0, 1, "b"): 0, (1, 0, "c"): 0, (2, 0, "d"): 0}
    m = spark.createDataFrame([("a", '{"schema_version":"0.1.0","concert_id":"c","duration_seconds":9,"sections":[{"id":"s1","type":"song","start":0,"end":5}]}'), ("b", '{"schema_version":"7"}')], "path string, text string")
    concerts, sections, rejected = readers.parse_manifests(m)
    assert concerts.first().concert_id == "c" and sections.first().section_id == "s1" and [r.path for r in rejected.collect()] == ["b"]


def test_round_trip_and_sinks(spark, tmp_path):
    cues = spark.createDataFrame([("c", 1, 3.0, 4.0, "source {x}", None), ("c", 0, 1.0, 2.0, "first", "erste")], "concert_id string, pos int, start double, end double, source_text string, translation string")
    srt = writers.render_srt(cues, "concert_id")
    assert srt.first().text == "1\n00:00:01,000 --> 00:00:02,000\nerste\nfirst\n\n2\n00:00:03,000 --> 00:00:04,000\nsource {x}\n"
    back = readers.parse_srt(srt, keys=("concert_id",)).orderBy("pos").collect()
    assert [(r.start, r.text) for r in back] == [(1.0, "first"), (3.0, "source {x}")]
    assert "source ｛x｝" in writers.render_ass(cues).first().text
    writers.write_by_concert(cues, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert {r.size for r in readers.file_inventory(spark, str(tmp_path / "out")).collect()}
    writers.write_tsv(cues.select("pos", "source_text"), str(tmp_path / "t"))
    assert readers.read_tsv(spark, str(tmp_path / "t"), "pos int, source_text string").count() == 2


def test_colour_runs(spark):
    part = "struct<text:string,mode:string,status:string,color:string>"
    df = spark.createDataFrame([("c", 0.0, 1.0, "ab", None, [("a", "solo", "confirmed", "#112233"), ("b", "group", "candidate", None)])], f"concert_id string, start double, end double, source_text string, translation string, parts array<{part}>")
    assert "{\\1c&H332211&}a{\\r}b" in writers.render_ass(df, parts="parts").first().text
