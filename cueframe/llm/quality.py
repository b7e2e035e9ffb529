"""Rules on text quality: counts over words and lines, and compression bands.

The bands: the ratio (text bytes / zstandard bytes) of the whole text and of each fixed chunk must lie
between a lower and an upper limit that depend on the length compressed. A high ratio is repetition, a
low one is text that does not compress (random characters, encoded data). Every byte of every text is in
a chunk. Short texts compress badly whatever they hold, so the lowest class has no lower limit. Limits hang on
the script as well, as a character of one byte compresses otherwise than one of three; they are learnt from
documents labelled clean (learn()), where there are enough of them, and else those of prose at large.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, mix, schema_of, slices, span_hashes, text_bytes, words


#: Parts of a class and script that limits need; what is left of a lower one.
LEARN_PARTS, LOWER_ROOM = 200, 1.15
Classes = tuple[tuple[int, float, float], ...]


def script_of(text: memoryview | bytes) -> int:
    """1: most bytes are of characters of two bytes, 2: of three or four, 0: any other text."""
    data = np.frombuffer(text, np.uint8)
    wide, two = 3 * np.count_nonzero(data >= 0xE0), 2 * np.count_nonzero((data >= 0xC0) & (data < 0xE0))
    return 2 if 2 * wide > len(data) else 1 if 2 * two > len(data) else 0


@dataclass(frozen=True)
class Bands:
    """bands: for each script (see script_of) its classes (bytes from, least ratio, greatest ratio), the last that fits
    holds. The limits given here are wide ones, within which licences, manuals and prose of several languages stand.
    chunk: bytes of a fixed chunk; what is left over is a chunk of its own, or, if shorter than least_rest,
    the last `chunk` bytes are. A text shorter than `chunk` is one chunk. A text fails by its whole ratio,
    or if more than chunk_share of its chunks fail."""

    bands: tuple[Classes, ...] = (
        ((0, 0.0, 1.9), (128, 1.04, 2.2), (256, 1.22, 2.6), (512, 1.3, 2.8), (1024, 1.46, 3.0), (2048, 1.6, 3.2), (4096, 1.7, 3.4), (8192, 1.8, 4.0)),
        ((0, 0.0, 2.6), (128, 1.04, 3.0), (256, 1.2, 3.4), (512, 1.3, 3.8), (1024, 1.4, 4.2), (2048, 1.5, 4.5), (4096, 1.6, 5.0), (8192, 1.7, 5.5)),
        ((0, 0.0, 2.2), (128, 1.0, 2.4), (256, 1.05, 2.6), (512, 1.1, 2.8), (1024, 1.15, 3.0), (2048, 1.2, 3.4), (4096, 1.25, 3.8), (8192, 1.3, 4.2)),
    )
    chunk: int = 4096
    least_rest: int = 256
    chunk_share: float = 0.1
    level: int = 1


@dataclass(frozen=True)
class BaseRules:
    min_words: int = 50
    max_repeat_percent: int = 50


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _inside(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flags)])
    return run[at[1:]] - run[at[:-1]]


def _firsts(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether it is the first of its (row, key), and how many there are of these."""
    order = np.lexsort((np.arange(len(key)), key, row))
    r, k = row[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    group = np.cumsum(new) - 1
    size = np.bincount(group, minlength=0)[group] if len(group) else group
    first, many = np.empty(len(key), bool), np.empty(len(key), np.int64)
    first[order], many[order] = new, size
    return first, many


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data, at = text_bytes(texts)
    rows = len(texts)
    start, end, row = words(data, at)
    n_words = np.bincount(row, minlength=rows)
    point = (data & 0xC0) != 0x80
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    out = {"n_words": n_words, "word_chars": _inside(point & ~blank, at), "n_symbols": _inside(_SYMBOL[data], at)}
    # lines that hold a word, each as one hash
    first, last = np.ones(rows, bool), at[1:]
    breaks = np.flatnonzero(data == 10)
    line_start = np.concatenate([at[:-1][first], breaks + 1])
    line_end = np.concatenate([last, breaks])
    line_start.sort()
    line_end.sort()
    # a text that ends in a line break ends in an empty line: both sides sort alike
    line_row = np.searchsorted(at[1:], line_end, "left")
    inked = np.searchsorted(start, line_start, "left") < np.searchsorted(start, line_end, "left")
    s, e, r = line_start[inked], line_end[inked], line_row[inked]
    first_line, _ = _firsts(r, span_hashes(data, s, e))
    out["n_dup_lines"] = np.bincount(r[~first_line], minlength=rows)
    # 3-word windows
    h = span_hashes(data, start, end)
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        w = mix(h[:-2] * np.uint64(3) + mix(h[1:-1]) * np.uint64(5) + mix(h[2:] + np.uint64(7)) * np.uint64(11))
        ok = np.flatnonzero(row[:-2] == row[2:])
        _, many = _firsts(row[ok], w[ok])
        again = ok[many > 1]
        for k in range(3):
            covered[again + k] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=rows)
    return out


def chunk_starts(n: int, bands: Bands) -> list[int]:
    cuts = list(range(0, n, bands.chunk))
    if len(cuts) > 1 and n - cuts[-1] < bands.least_rest:
        cuts[-1] = n - bands.chunk
    return cuts


def in_bands(text: memoryview | bytes, bands: Bands, compress) -> tuple[bool, float, int, int]:
    """Whether the text stays in its bands, its ratio, the chunks judged and those that fail."""

    def ok(part) -> tuple[bool, float]:
        ratio = len(part) / len(compress(part))
        low, high = [(lo, hi) for least, lo, hi in bands.bands[script_of(part)] if len(part) >= least][-1]
        return low <= ratio <= high, ratio

    if not len(text):
        return True, 0.0, 0, 0
    whole, ratio = ok(text)
    cuts = chunk_starts(len(text), bands)
    n = len(cuts)
    bad = sum(not ok(text[i : i + bands.chunk])[0] for i in cuts) if n > 1 else int(not whole)
    return whole and bad <= bands.chunk_share * n, ratio, n, bad


def judge(docs: DataFrame, base: BaseRules = BaseRules(), bands: Bands = Bands(), text_column: str = "text") -> DataFrame:
    """Adds to each row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    ratio, n_chunks, n_bad_chunks, kept.

    Words are runs of characters other than space and U+0009 to U+000D. Null text: no words (fails
    min_words). The empty text keeps its bands. Columns of docs with one of these names give way (in any
    case of letters); all others stay, whatever their names. No row goes, rows do not influence each other,
    repeated rows are judged alike, an empty table gives an empty one, and no shuffle is made.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    added = ", ".join(f"{n} bigint" for n in names) + ", base_failed boolean, ratio double, n_chunks bigint, n_bad_chunks bigint, kept boolean"
    new = [x.split()[0] for x in added.split(", ")]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new and c != text_column])
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level).compress
        for b in slices(batches, at):
            m = measure(b.column(at))
            failed = (m["n_words"] < base.min_words) | (100 * m["n_repeat_words"] > base.max_repeat_percent * m["n_words"])
            data, cuts = text_bytes(b.column(at))
            view = memoryview(np.ascontiguousarray(data))
            verdict = [in_bands(view[i:j], bands, compress) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            cols = [*b.columns, *[pa.array(m[n].astype(np.int64)) for n in names], pa.array(failed), pa.array([v[1] for v in verdict], pa.float64()), pa.array([v[2] for v in verdict], pa.int64()), pa.array([v[3] for v in verdict], pa.int64()), pa.array([bool(v[0] and not f) for v, f in zip(verdict, failed, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *new])

    # each text goes to Python once; columns are told by place, so that no name can clash
    return by_place(docs).mapInArrow(run, schema_of(docs, added)).toDF(*docs.columns, *new)


def labelled(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """docs (doc_id and others) labelled clean (quality = 1, not toxic), with half (0 or 1, by hash of the id). most: ids that are
    used at most, those of least hash (none: all)."""
    clean = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_d")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("_q"), F.max(F.coalesce("toxic", F.lit(0))).alias("_t")).where("_q = 1 AND _t <> 1")
    ids = clean.select("_d")
    if most is not None:
        ids = ids.orderBy(F.xxhash64("_d"), "_d").limit(most)
    others = [c for c in docs.columns if c != "doc_id"]
    return docs.select(F.col("doc_id").cast("long").alias("_d"), *others).join(ids, "_d").select(*others, F.pmod(F.xxhash64("_d", F.lit("half")), F.lit(2)).alias("half"))


def learn(docs: DataFrame, labels: DataFrame, base: BaseRules = BaseRules(), bands: Bands = Bands(), most: int | None = None, half: int | None = None) -> Bands:
    """Bands whose limits are the quantiles 0.001 and 0.999 of whole texts and chunks of all documents labelled clean that
    pass the base rules, by script and length, with room: a lower limit is the quantile / 1.15, an upper one the
    quantile * 1.25 below 2048 bytes, where the ratio hangs on the vocabulary, and * 1.02 from there. most, half: to
    learn from fewer, as for a test on the others. Classes of which there are too few keep the limits of `bands`.

    Texts are measured where they lie; only the numbers of their parts meet the labels, and are counted by ratio."""
    starts = [c[0] for c in bands.bands[0]]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level).compress
        for b in slices(batches, 1):
            m = measure(b.column(1))
            good = (m["n_words"] >= base.min_words) & (100 * m["n_repeat_words"] <= base.max_repeat_percent * m["n_words"])
            data, cuts = text_bytes(b.column(1))
            view, rows, docs_, ids = memoryview(np.ascontiguousarray(data)), [], [], b.column(0).to_pylist()
            for at in np.flatnonzero(good).tolist():
                i, j = int(cuts[at]), int(cuts[at + 1])
                own = chunk_starts(j - i, bands)
                for a, e in [(i, j), *[(i + c, min(j, i + c + bands.chunk)) for c in own if len(own) > 1]]:
                    rows.append((script_of(view[a:e]), sum(e - a >= s for s in starts) - 1, (e - a) / len(compress(view[a:e]))))
                    docs_.append(ids[at])
            cols = [docs_, *(list(zip(*rows, strict=True)) or [[]] * 3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["doc_id", "script", "class", "ratio"])

    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(parts, "doc_id bigint, script int, class int, ratio double")
    known = labelled(measured, labels, most)
    known = known if half is None else known.where(F.col("half") == half)
    # ratios to four places, so that a class has few of them, however many parts there are
    counts = known.groupBy("script", "class", F.round("ratio", 4).alias("ratio")).agg(F.count("*").alias("n"))
    found = counts.groupBy("script", "class").agg(F.sum("n").alias("n"), F.percentile("ratio", F.array(F.lit(0.001), F.lit(0.999)), F.col("n")).alias("q"))
    limits = {(r["script"], r["class"]): r["q"] for r in found.where(F.col("n") >= LEARN_PARTS).collect()}  # a few classes

    def of(script: int, k: int, least: int, low: float, high: float) -> tuple[int, float, float]:
        if (script, k) not in limits:
            return least, low, high
        a, b = limits[script, k]
        return least, a / LOWER_ROOM if k else 0.0, b * (1.25 if least < 2048 else 1.02)

    return replace(bands, bands=tuple(tuple(of(s, k, *c) for k, c in enumerate(classes)) for s, classes in enumerate(bands.bands)))
