"""Audits of texts, checklists and file trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def title_of(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def url_is_off_site(url: Column, own: list[str], forbidden: list[str]) -> Column:
    """Whether the host is a forbidden one (or below it) and not an own one."""
    on = lambda hosts: url.rlike(r"://(?:[^/?#]*\.)?(?:" + "|".join(h.replace(".", r"\.") for h in hosts) + r")(?:[/?#]|$)")
    return on(forbidden) & ~on(own)


def post_faults(posts: DataFrame, song: str = "song", most: int = 20, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Faults of post copies (post_id, platform, title, body, song, previous): missing fields, titles
    that are too long or do not hold the song, URLs beyond the allowed hosts, and no mark of the previous post."""
    hosts = F.transform(F.regexp_extract_all("body", F.lit(r"https?://([^/\s?#]+)"), F.lit(1)), F.lower)
    foreign = F.exists(hosts, lambda h: ~h.isin(*allowed) if allowed else F.lit(True))
    codes = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "missing_title"),
        F.when(F.trim(F.coalesce("body", F.lit(""))) == "", "missing_body"),
        F.when(F.length("title") > most, "title_too_long"),
        F.when(~F.contains("title", song), "title_without_song"),
        F.when(F.coalesce(foreign, F.lit(False)), "url_not_allowed"),
        F.when(F.col("previous").isNotNull() & ~F.coalesce(F.contains("body", "previous"), F.lit(False)), "previous_missing"),
    ))
    return posts.select("post_id", F.explode(codes).alias("code"))


# Platforms, the fields of a post and what a reference looks like.
PLATFORMS = ("微博", "小红书", "B站", "视频号")
NOTES, VIDEOS = PLATFORMS[1], PLATFORMS[2]
FIELDS = {"标题": "title", "正文": "body", "话题": "topics", "标签": "tags", "原视频": "source", "转载链接": "source", "上一篇笔记ID": "previous_note_id", "章节评论": "chapter_comment", "发布备注": "publishing_notes"}
FIELD_LINE = rf"^({'|'.join(FIELDS)})：(.*)$"
SECTION_LINE = rf"(?m)^##\s+({'|'.join(PLATFORMS)})\s*$"
ANY_URL = r"https?://[^\s<>）]+"
VIDEO_URL = r"^https?://(?:www\.)?bilibili\.com/"
VIDEO_REFERENCE, NOTE_REFERENCE, NOTE_ID = r"(?m)(?:上一篇|上一首)：.*\bBV[0-9A-Za-z]{10}\b", r"上一篇：\S", r"^[0-9a-f]{24}$"


def parse_copies(copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies (copy_id, text) as posts (copy_id, platform, and each field's text, empty where there is none), and
    faults (copy_id, platform, code): platform_repeated, field_repeated. A copy with a fault has no posts.

    A section begins with a line that names a platform, a field with its name and a colon; it goes on to the next
    field. Behind a title a blank line begins the body. A field that is named again may stand only where it was blank."""
    mark = "\x00"
    chunks = F.split(F.regexp_replace("text", SECTION_LINE, f"{mark}$1"), mark)
    parts = copies.select("copy_id", F.posexplode(F.slice(chunks, 2, F.greatest(F.size(chunks) - 1, F.lit(0)))).alias("section", "chunk"))
    lines = parts.select("copy_id", "section", F.posexplode(F.split("chunk", "\n")).alias("n", "line"))
    first = F.max(F.when(F.col("n") == 0, F.trim("line"))).over(Window.partitionBy("copy_id", "section"))
    w = Window.partitionBy("copy_id", "section").orderBy("n")
    known = F.create_map(*[F.lit(x) for item in FIELDS.items() for x in item])
    lines = lines.withColumns({"platform": first, "opens": F.try_element_at(known, F.nullif(F.regexp_extract("line", FIELD_LINE, 1), F.lit("")))}).where("n > 0")
    lines = lines.withColumn("begun", F.last("opens", True).over(w))
    blank = F.trim(F.regexp_replace("line", r"\s", "")) == ""
    lines = lines.withColumn("turns", F.when(F.col("opens").isNull() & blank & (F.col("begun") == "title"), "body"))
    lines = lines.withColumns({"field": F.last(F.coalesce("opens", "turns"), True).over(w), "run": F.count("opens").over(w)})
    # the blank line that begins a body is no part of it; later ones are
    turned = F.count("turns").over(Window.partitionBy("copy_id", "section", "run").orderBy("n"))
    lines = lines.where("field IS NOT NULL").withColumn("nth", turned).where(F.col("turns").isNull() | (F.col("nth") > 1))
    said = F.when(F.col("opens").isNotNull(), F.regexp_extract("line", FIELD_LINE, 2)).otherwise(F.col("line"))
    runs = lines.groupBy("copy_id", "section", "platform", "field", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", said.alias("s")))), lambda x: x["s"]), "\n").alias("text"), F.bool_or(F.col("opens").isNotNull()).alias("named"))
    runs = runs.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    own = Window.partitionBy("copy_id", "section", "field").orderBy("run")
    before = F.max(F.col("text") != "").over(own.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumns({"again": F.col("named") & F.coalesce(before, F.lit(False)), "later": F.lead("run").over(own), "later_named": F.lead("named").over(own)})
    # a blank field that is named again is replaced; a body behind a title goes on from one that stands already
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.coalesce("later_named", F.lit(False)), F.struct("run", "text")))), lambda x: x["text"]), "\n")
    fields = runs.groupBy("copy_id", "section", "field").agg(F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))
    sections = parts.select("copy_id", "section", F.trim(F.substring_index("chunk", "\n", 1)).alias("platform"))
    wide = fields.groupBy("copy_id", "section").agg(*[F.coalesce(F.max(F.when(F.col("field") == f, F.col("text"))), F.lit("")).alias(f) for f in dict.fromkeys(FIELDS.values())])
    names = [*dict.fromkeys(FIELDS.values())]
    posts = sections.join(wide, ["copy_id", "section"], "left").na.fill("", names)
    nth = F.row_number().over(Window.partitionBy("copy_id", "platform").orderBy("section"))
    posts = posts.withColumn("nth", nth)
    faults = posts.where("nth > 1").select("copy_id", "platform", F.lit("platform_repeated").alias("code")).unionByName(runs.where("again").select("copy_id", "platform", F.lit("field_repeated").alias("code"))).distinct()
    tags = F.coalesce(F.nullif("tags", F.lit("")), "topics").alias("tags")
    return posts.join(faults.select("copy_id"), "copy_id", "left_anti").select("copy_id", "platform", *[tags if n == "tags" else n for n in names if n != "topics"]), faults


def copy_faults(posts: DataFrame, songs: DataFrame | None = None, platforms: tuple[str, ...] | None = None, require_previous: bool = False) -> DataFrame:
    """(copy_id, platform, code) of posts as parse_copies() returns them: missing_post (none for a wanted platform,
    or one without title or body), url_in_body, url_off_site, previous_video_missing, previous_title_missing,
    previous_note_missing, title_without_song, title_too_long. songs: copy_id, song."""
    p = posts
    if platforms:
        wanted = posts.select("copy_id").distinct().select("copy_id", F.explode(F.array(*map(F.lit, platforms))).alias("platform"))
        p = wanted.join(posts, ["copy_id", "platform"], "left")
    title, body, note = (F.coalesce(c, F.lit("")) for c in ("title", "body", "previous_note_id"))
    whole = (title != "") & (body != "")
    urls = F.regexp_extract_all(body, F.lit(f"({ANY_URL})"), F.lit(1))
    notes, videos = F.col("platform") == NOTES, F.col("platform") == VIDEOS
    song = F.col("song") if songs is not None else F.lit(None).cast("string")
    j = p.join(songs.select("copy_id", "song"), "copy_id", "left") if songs is not None else p
    codes = F.array_compact(F.array(
        F.when(~whole, "missing_post"),
        F.when(whole & notes & (F.size(urls) > 0), "url_in_body"),
        F.when(whole & videos & F.exists(urls, lambda u: ~u.rlike(VIDEO_URL)), "url_off_site"),
        *([F.when(whole & videos & ~body.rlike(VIDEO_REFERENCE), "previous_video_missing"), F.when(whole & notes & ~body.rlike(NOTE_REFERENCE), "previous_title_missing"), F.when(whole & notes & ~note.rlike(NOTE_ID), "previous_note_missing")] if require_previous else []),
        F.when(F.col("title").isNotNull() & ~F.contains(title, song), "title_without_song"),
        F.when(song.isNotNull() & notes & (F.length(title) > 20), "title_too_long"),
    ))
    return j.select("copy_id", "platform", F.explode(codes).alias("code"))


def checklist_faults(lists: DataFrame, required: DataFrame) -> DataFrame:
    """Items (list_id, text) against required labels (label): each exactly once, and nothing unticked."""
    item = F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^- \[[ xX]\] .*$"), F.lit(0)))
    items = lists.select("list_id", item.alias("i")).select("list_id", F.trim(F.substring("i", 7, 1000000)).alias("label"), (F.substring("i", 4, 1) != " ").alias("ticked"))
    open_ = items.where(~F.col("ticked")).select("list_id", "label", F.lit("unticked").alias("code"))
    counts = items.groupBy("list_id", "label").agg(F.count("*").alias("n"))
    wanted = lists.select("list_id").distinct().crossJoin(F.broadcast(required.select("label").distinct()))  # a few fixed labels
    off = wanted.join(counts, ["list_id", "label"], "left").where("coalesce(n, 0) <> 1").select("list_id", "label", F.when(F.col("n").isNull(), "missing").otherwise("repeated").alias("code"))
    return open_.unionByName(off)


def inventory_diff(source: DataFrame, archive: DataFrame) -> DataFrame:
    """Missing, extra and changed files of two inventories (path, size, sha256)."""
    a = source.select("path", F.col("size").alias("_s"), F.col("sha256").alias("_h"), F.lit(True).alias("_a"))
    b = archive.select("path", "size", "sha256", F.lit(True).alias("_b"))
    same = F.col("_s").eqNullSafe(F.col("size")) & F.col("_h").eqNullSafe(F.col("sha256"))
    code = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~same, "changed")
    return a.join(b, "path", "full").withColumn("code", code).where("code IS NOT NULL").select("path", "code")


def delivery_ready(checks: DataFrame, required: list[str]) -> DataFrame:
    """Checks (track_id, version, name, ok): ready if all named ones are there and true."""
    good = checks.where("ok").groupBy("track_id", "version").agg(F.collect_set("name").alias("good"))
    every = checks.select("track_id", "version").distinct().join(good, ["track_id", "version"], "left")
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.coalesce("good", F.array().cast("array<string>"))))
    return every.select("track_id", "version", (F.size(missing) == 0).alias("ready"), F.array_join(missing, ",").alias("missing"))


def common_run(a: list[str | None], b: list[str | None]) -> int:
    """Length of the longest contiguous run that two lists share; nulls equal nothing. A run of a length implies one of each
    shorter length, so the length is found by bisection; runs are numbered by doubling, whatever their length."""
    both = [*a, *b]
    number = {x: i for i, x in enumerate(dict.fromkeys(both))}
    ranks = [np.array([len(both) + i if x is None else number[x] for i, x in enumerate(both)], dtype=np.int64)]

    def shared(n: int) -> bool:
        k = n.bit_length() - 1
        for level in range(len(ranks), k + 1):
            r, w = ranks[-1], 1 << (level - 1)
            ranks.append(np.unique(r[:-w] * (2 * len(both)) + r[w:], return_inverse=True)[1].astype(np.int64))
        r = ranks[k]
        runs = r[: len(both) - n + 1] * (2 * len(both)) + r[n - (1 << k) : n - (1 << k) + len(both) - n + 1]
        return bool(np.isin(runs[: len(a) - n + 1], runs[len(a) :]).any())

    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if shared(mid) else (low, mid - 1)
    return low


def longest_common_run(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Length of the longest contiguous run that the arrays (key, items) of both sides share, 0 for none; keys of both
    sides, one row each."""
    both = left.select(key, F.col("items").alias("_a")).join(right.select(key, F.col("items").alias("_b")), key)

    def measure(batches):
        for p in batches:
            # the items of one row at a time are Python objects
            runs = [common_run(a.as_py(), b.as_py()) if a.is_valid and b.is_valid else 0 for a, b in zip(p.column(1), p.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(runs, pa.int64())], names=[key, "run"])

    return both.mapInArrow(measure, f"`{key}` {left.schema[key].dataType.simpleString()}, run bigint")


def language_track(tracks: DataFrame, language: str) -> DataFrame:
    """Of a media's tracks (media_id, name, lang) the only one in the language, else the only one in
    its base language; automatic ones and chats never count."""
    from pyspark.sql import Window

    manual = tracks.where(~F.lower("name").rlike("auto|asr|live_chat"))
    base = language.split("-")[0].lower()
    rank = F.when(F.lower("lang") == language.lower(), 1).when(F.lower(F.substring_index("lang", "-", 1)) == base, 2)
    w = Window.partitionBy("media_id")
    best = manual.withColumn("_r", rank).where("_r IS NOT NULL").withColumn("_m", F.min("_r").over(w)).where("_r = _m")
    return best.withColumn("_n", F.count("*").over(w)).where("_n = 1").drop("_r", "_m", "_n")
