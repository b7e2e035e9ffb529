"""Repeated passages by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines chooses boundaries, so a passage is cut alike
wherever it stands. Three nested levels are cut at once: about four lines, about two lines, and every
line a chunk. Chunks with enough words whose hash occurs more than once are looked up in full: the first
occurrence (smallest doc_id, then place) stays, and a later one goes if its bytes equal the first one's.

With `runs` (the queries) no passage hangs on chance boundaries: every line begins a chunk that ends with
the line where the words are enough, and ends one that begins likewise. Both hang on the chunk's own words
alone, and a run of lines with enough words is the union of such chunks in it, so exactly the lines of runs
that stand earlier go, whatever the lines hold. Neighbouring chunks with one distance to their first
occurrence are compared as one passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, mix, schema_of, slices, span_hashes, stored, text_bytes, words


@dataclass(frozen=True)
class ChunkRule:
    """min_words: words that a chunk must hold to be removed. masks: a boundary stands where the rolling
    hash has no bit of the level's mask (3: every fourth line on average). runs: chunks of least length
    from and to every line instead of levels."""

    min_words: int = 50
    masks: tuple[int, ...] = (3, 1, 0)
    runs: bool = False


#: The rule of the queries: all lines of runs with enough words that stand earlier.
RUNS = ChunkRule(runs=True)


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the \\n-split lines of each text (an empty text has one)."""
    breaks = np.flatnonzero(data == 10)
    start, end = np.sort(np.concatenate([at[:-1], breaks + 1])), np.sort(np.concatenate([at[1:], breaks]))
    first = np.searchsorted(breaks, at[:-1]) + np.arange(len(at) - 1)
    row = np.zeros(len(start), np.int64)
    row[first[1:]] = 1
    return start, end, np.cumsum(row)


def _least_runs(word: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the shortest runs with enough words that begin or end with each line."""
    before, upto = np.searchsorted(word, start), np.searchsorted(word, end)
    line = np.arange(len(row))
    last = np.searchsorted(upto, before + least)
    first = np.searchsorted(before, upto - least, "right") - 1
    down, up = last < len(row), first >= 0
    a, b = np.concatenate([line[down], first[up]]), np.concatenate([last[down], line[up]])
    own = (row[a] == row[b]) & (a <= b)
    return a[own], b[own]


def chunks(docs: DataFrame, rule: ChunkRule) -> DataFrame:
    """doc_id, h, start, end (bytes in the text) of every chunk with enough words."""

    def spans_of(b: pa.RecordBatch, data: np.ndarray, at: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        s = np.unique(s, axis=0)
        ids = b.column(0).take(pa.array(s[:, 2]))
        base = at[s[:, 2]]
        return pa.RecordBatch.from_arrays([ids, pa.array(span_hashes(data, s[:, 0], s[:, 1]).view(np.int64)), pa.array(s[:, 0] - base), pa.array(s[:, 1] - base)], names=["doc_id", "h", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            data, at = text_bytes(b.column(1))
            start, end, row = _lines(data, at)
            word = words(data, at)[0]
            if rule.runs:
                a, b_ = _least_runs(word, start, end, row, rule.min_words)
                yield spans_of(b, data, at, np.stack([start[a], end[b_], row[a]], axis=1))
                continue
            h = span_hashes(data, start, end)
            before = np.zeros_like(h)
            before[1:] = np.where(row[1:] == row[:-1], h[:-1], np.uint64(0))
            roll = mix(h * np.uint64(3) + mix(before))
            last = np.ones(len(row), bool)
            last[:-1] = row[1:] != row[:-1]
            spans = []
            for mask in rule.masks:
                stop = np.flatnonzero(last | ((roll & np.uint64(mask)) == 0))
                go = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
                spans.append(np.stack([start[go], end[stop], row[go]], axis=1))
            s = np.concatenate(spans)
            enough = np.searchsorted(word, s[:, 1]) - np.searchsorted(word, s[:, 0]) >= rule.min_words
            yield spans_of(b, data, at, s[enough])

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(run, "doc_id bigint, h bigint, start bigint, end bigint")


def _outermost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document's spans those that no other one holds."""
    for b in batches:
        out = []
        for doc, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            upto = -1
            for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                if s["end"] > upto:
                    out.append((doc, s["h"], s["start"], s["end"]))
                    upto = s["end"]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "h", "start", "end"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed spans of each text, if they have the hash they should."""
    for b in slices(batches, "_text"):
        hs, parts = [], []
        for text, spans in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
            text = text or b""
            data = np.frombuffer(text, np.uint8)
            spans = [s for s in spans if s["end"] <= len(text)]
            found = span_hashes(data, np.array([s["start"] for s in spans], np.int64), np.array([s["end"] for s in spans], np.int64)).view(np.int64)
            for s, h in zip(spans, found.tolist(), strict=True):
                if h == s["h"]:
                    hs.append(h)
                    parts.append(text[s["start"] : s["end"]])
        yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(parts, pa.binary())], names=["h", "bytes"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's spans as passages: what overlaps or touches at one distance to the source is one."""
    for b in batches:
        out = []
        for doc, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            now = None
            for s in sorted(spans, key=lambda s: (s["src"], s["start"] - s["at"], s["start"])):
                if now and (s["src"], s["start"] - s["at"]) == (now[3], now[1] - now[4]) and s["start"] <= now[2] + 1:
                    now[2] = max(now[2], s["end"])
                else:
                    now = [doc, s["start"], s["end"], s["src"], s["at"]]
                    out.append(now)
        rows = [(d, a, e, src, at, at + e - a) for d, a, e, src, at in out]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "end", "src", "src_start", "src_end"])


def _sources(column: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed spans of each row's text; rows without spans are null."""
    for b in batches:
        b = b.filter(b.column(0).is_valid())
        rows = []
        for doc, text, spans in zip(b.column(0).field("_id").to_pylist(), b.column(0).field(column).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
            text = text or b""
            rows += [(doc, s["src_start"], s["src_end"], text[s["src_start"] : s["src_end"]]) for s in spans if s["src_end"] <= len(text)]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["src", "src_start", "src_end", "bytes"])


def _without(text: bytes, spans: list[dict]) -> tuple[list[bytes], int, int, int]:
    """Lines that stay, number of lines, of lines removed, of words removed."""
    lines = text.split(b"\n")
    if not spans:
        return lines, len(lines), 0, 0
    gone = []
    for a, e in sorted((s["start"], s["end"]) for s in spans if text[s["start"] : s["end"]] == s["bytes"]):
        if gone and a <= gone[-1][1]:
            gone[-1][1] = max(e, gone[-1][1])
        else:
            gone.append([a, e])
    keep, at, k, n_words = [], 0, 0, 0
    for line in lines:
        while k < len(gone) and gone[k][1] < at:
            k += 1
        if k < len(gone) and gone[k][0] <= at and at + len(line) <= gone[k][1]:
            n_words += len(line.split())
        else:
            keep.append(line)
        at += len(line) + 1
    return keep, len(lines), len(lines) - len(keep), n_words


def _gone_chunks(given: DataFrame, text: str, groups: DataFrame, later: DataFrame) -> DataFrame:
    """_id, _gone: spans of each document that may go, with the bytes that they must have."""
    spans = later.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "h")).alias("spans"))
    spans = stored(spans.mapInArrow(_outermost, "doc_id bigint, h bigint, start bigint, end bigint"), "spans")
    # the texts are shuffled by doc_id once, for the first occurrences and for the result
    firsts = groups.join(spans.select("h").distinct(), "h").select(F.col("_first.doc_id").alias("_id"), F.struct("h", "_first.start", "_first.end").alias("_s"))
    firsts = firsts.groupBy("_id").agg(F.collect_list("_s").alias("_spans"))
    wanted = given.join(firsts, "_id").select(F.col(text).alias("_text"), "_spans").mapInArrow(_cut_out, "h bigint, bytes binary").dropDuplicates(["h"])
    return spans.join(wanted, "h").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start", "end", "bytes")).alias("_gone"))


def _gone_runs(given: DataFrame, text: str, groups: DataFrame, later: DataFrame) -> DataFrame:
    """The same for runs, whose chunks overlap: one that overlaps its own first occurrence stays."""
    apart = (F.col("doc_id") != F.col("_first.doc_id")) | (F.col("_first.end") <= F.col("start"))
    span = F.struct("start", "end", F.col("_first.doc_id").alias("src"), F.col("_first.start").alias("at"))
    spans = later.where(apart).groupBy("doc_id").agg(F.collect_list(span).alias("spans"))
    spans = stored(spans.mapInArrow(_passages, "doc_id bigint, start bigint, end bigint, src bigint, src_start bigint, src_end bigint"), "passages")
    source = ["src", "src_start", "src_end"]
    firsts = spans.select(source).distinct().groupBy(F.col("src").alias("_id")).agg(F.collect_list(F.struct("src_start", "src_end")).alias("_spans"))
    # ids with several texts have several candidates; only equal bytes count in the end
    # the rows whole and by an outer join, as for the result, so that both take one shuffle of the texts
    row = F.when(F.col("_spans").isNotNull(), F.struct(*given.columns))
    wanted = given.join(firsts, "_id", "left").select(row.alias("_row"), "_spans").mapInArrow(partial(_sources, text), "src bigint, src_start bigint, src_end bigint, bytes binary").dropDuplicates([*source, "bytes"])
    return spans.join(wanted, source).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start", "end", "bytes")).alias("_gone"))


def remove_repeats(docs: DataFrame, rule: ChunkRule = ChunkRule()) -> DataFrame:
    """docs with text replaced by what stays, and n_lines, n_removed_lines, n_removed_words, kept_sha256.

    Lines end at \\n. A null text stays null and counts as one empty line. Rows with a null doc_id stay as
    they are. Rows that repeat doc_id and text are one document: what the first occurrence keeps, all of
    them keep. Columns of docs with the names of the new ones give way (in any case of letters); all others
    stay, whatever their names. An empty table gives an empty one.
    """
    new = ["n_lines", "n_removed_lines", "n_removed_words", "kept_sha256"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    found = stored(chunks(docs, rule), "chunks")
    place = F.struct("doc_id", "start", "end")
    groups = found.groupBy("h").agg(F.count("*").alias("_n"), F.min(place).alias("_first")).where("_n > 1").drop("_n")
    groups = stored(groups, "repeats")
    # columns are told by place, so that no name can clash
    at = [docs.columns.index(c) for c in ("doc_id", "text")]
    given = by_place(docs).withColumn("_id", F.col(f"c{at[0]}").cast("long"))
    later = found.join(groups, "h").where(place != F.col("_first"))
    gone = (_gone_runs if rule.runs else _gone_chunks)(given, f"c{at[1]}", groups, later)
    joined = given.join(gone, "_id", "left").select("_gone", *[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 + at[1]):
            texts, counts = [], []
            for text, gone in zip(b.column(1 + at[1]).cast(pa.binary()).to_pylist(), b.column(0).to_pylist(), strict=True):
                keep, *n = _without(text or b"", gone or [])
                kept = b"\n".join(keep)
                texts.append(None if text is None else kept)
                counts.append((*n, hashlib.sha256(kept).hexdigest()))
            cols = list(b.columns[1:])
            cols[at[1]] = pa.array(texts, pa.binary()).cast(pa.string())
            stats = [pa.array(c, k) for c, k in zip(zip(*counts, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, *stats], names=[*b.schema.names[1:], *new])

    added = "n_lines bigint, n_removed_lines bigint, n_removed_words bigint, kept_sha256 string"
    return joined.mapInArrow(run, schema_of(docs, added)).toDF(*docs.columns, *new)


#: The rows under RUNS: a line goes if a shortest run with 50 words that holds it stands earlier, apart from it.
SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
), split AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM texts
), counted AS (
    SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM split
), lines AS (
    SELECT *, sum(n) OVER d - n AS before, sum(n) OVER d AS upto, sum(length(line) + 1) OVER d - length(line) AS begins, sum(length(line) + 1) OVER d AS ends
    FROM counted WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
    SELECT a.doc_id, a.i, min(b.i) AS j FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.upto >= a.before + 50 GROUP BY ALL
    UNION SELECT b.doc_id, max(a.i), b.i FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND a.before <= b.upto - 50 GROUP BY ALL
), cut AS (
    SELECT r.doc_id, r.i, r.j, substr(t.text, CAST(a.begins AS BIGINT), CAST(b.ends - a.begins AS BIGINT)) AS x
    FROM runs r JOIN texts t ON r.doc_id = t.doc_id JOIN lines a ON r.doc_id = a.doc_id AND r.i = a.i JOIN lines b ON r.doc_id = b.doc_id AND r.j = b.i
), firsts AS (
    SELECT doc_id, i, j, min(row(doc_id, i, j)) OVER (PARTITION BY x) AS f FROM cut
), gone AS (
    SELECT DISTINCT g.doc_id, l.i FROM firsts g JOIN lines l ON g.doc_id = l.doc_id AND l.i BETWEEN g.i AND g.j
    WHERE row(g.doc_id, g.i, g.j) <> g.f AND (g.doc_id <> g.f[1] OR g.f[3] < g.i)
)
SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed_lines, CAST(coalesce(sum(l.n) FILTER (g.i IS NOT NULL), 0) AS BIGINT) AS n_removed_words,
    sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""
