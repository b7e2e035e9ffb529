"""How filters of a corpus interact: what each removes, alone, after others and in every order.

Five filters look at whole texts: (A) under 200 words, (B) under half of the words distinct, (C) more than
2 capitals A to Z in 100 code points, (D) any of `#$%&*|`, (E) equal to the text of a smaller doc_id. The
first four hang on the text alone. For E, texts are dealt by range: the limits between ranges are prefixes
of texts, as long as frequent beginnings need (a beginning that many texts share is split by longer ones).
Each task inserts the full texts into compressed tries, whose terminals hold the smallest id and the rows
that have it; a row with a larger id is a duplicate. A first trie of this kind runs before the shuffle, so
that of a text a task sends one copy, however many it has read. Failures are bits of a mask; counts by
part and mask, which are few, give all 120 orders.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, slices, stored

LETTERS = "ABCDE"
DUPLICATE = 16
#: Bytes of labels that a trie holds before it is traversed and begun anew.
TRIE_BYTES = 32 << 20
#: Ranges that limits on the driver tell apart (beyond them, a range is split by a checksum of the texts),
#: and sampled texts for each; both bound the driver's lists and shift only the balance of tasks.
MOST_RANGES, PER_RANGE = 4096, 16
#: Bytes of texts' beginnings, each taken where the one before is shared by too many.
HEADS = (16, 128, 1024, 8192)

_NOT_CAPITAL = bytes(range(256)).translate(None, bytes(range(65, 91)))
_FOLLOWS = bytes(range(0x80, 0xC0))
_MARKS = re.compile(rb"[#$%&*|]").search


def failures(text: bytes) -> int:
    """Bits 1, 2, 4 and 8 for the filters A to D."""
    words = text.split()  # at space and U+0009 to U+000D
    n = len(words)
    capitals, points = len(text.translate(None, _NOT_CAPITAL)), len(text.translate(None, _FOLLOWS))
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 2 * points) << 2 | (_MARKS(text) is not None) << 3


class Node:
    __slots__ = ("edges", "least", "mask", "rows")

    def __init__(self):
        self.edges: dict[int, list] = {}  # by first byte: label and node below
        self.least: int | None = None
        self.rows: dict[str, int] = {}  # by part, of the smallest id
        self.mask = 0


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the common beginning of label and text[at:], by bisection."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if text.startswith(label[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A compressed trie of whole texts: an edge is labelled with all bytes up to the next fork or end."""

    def __init__(self):
        self.root, self.size = Node(), 0

    def terminal(self, text: bytes) -> Node:
        node, at = self.root, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                below = Node()
                node.edges[text[at]] = [text[at:], below]
                self.size += len(text) - at + 400
                return below
            label, below = edge
            if not text.startswith(label, at):
                k = _common(label, text, at)
                fork = Node()
                fork.edges[label[k]] = [label[k:], below]
                edge[:] = [label[:k], fork]
                self.size += 400
                label, below = edge
            node, at = below, at + len(label)
        return node

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        stack = [(b"", self.root)]
        while stack:
            text, node = stack.pop()
            if node.least is not None:
                yield text, node
            stack += [(text + label, below) for label, below in node.edges.values()]


class Firsts:
    """Rows put into a trie; those that a smaller id of the same text beats come out as duplicates."""

    def __init__(self):
        self.trie = Trie()

    def add(self, text: bytes, doc: int, part: str, mask: int, n: int, out: list[tuple]) -> None:
        node = self.trie.terminal(text)
        if node.least is not None and doc > node.least:
            out.append((doc, part, node.mask | DUPLICATE, n))
            return
        if node.least is None or doc < node.least:
            out += [(node.least, p, node.mask | DUPLICATE, k) for p, k in node.rows.items()]
            node.least, node.mask, node.rows = doc, mask, {}
        node.rows[part] = node.rows.get(part, 0) + n

    def full(self) -> bool:
        return self.trie.size > TRIE_BYTES

    def drain(self) -> Iterator[tuple[bytes, int, str, int, int]]:
        for text, node in self.trie.terminals():
            for part, n in node.rows.items():
                yield text, node.least, part, node.mask, n
        self.trie = Trie()


def range_limits(texts: DataFrame, ranges: int) -> list[bytes]:
    """Ascending beginnings of texts between which about equally many texts lie (texts: one binary column).

    Found on a sample of about PER_RANGE texts a range. Beginnings of 16 bytes that more than two ranges' worth
    of it share give way to their longer beginnings, and so on.
    """
    (name,), many = texts.columns, texts.count()
    sample = stored(texts.sample(min(1.0, ranges * PER_RANGE / max(many, 1)), seed=17), "sampled-texts")
    counts, hot = {}, None
    for before, size in zip((0, *HEADS), HEADS, strict=False):
        now = sample if hot is None else sample.where(F.substring(name, 1, before).isin(hot))
        found = {bytes(r["head"]): r["n"] for r in now.groupBy(F.substring(name, 1, size).alias("head")).agg(F.count("*").alias("n")).collect()}
        counts |= found
        hot = [h for h, n in found.items() if n > 2 * PER_RANGE and len(h) == size]
        if not hot or size == HEADS[-1]:
            break
        for h in hot:
            del counts[h]
    forget(sample)
    limits, room = [], PER_RANGE
    for head in sorted(counts):
        if room <= 0:
            limits.append(head)
            room = PER_RANGE
        room -= counts[head]
    return limits


_LIGHT = "doc_id bigint, part string, mask int, n bigint"
_SENT = pa.schema([("lot", pa.int32()), ("text", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def masks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """doc_id, part, mask, n: the filters that each document fails (bits 1 to 16 for A to E), and how many
    equal rows have them.

    Null text is an empty one, a null part an empty string. Equal ids do not beat one another, and a null
    id neither beats nor is beaten. Other columns are not read, whatever their names. An empty table gives
    an empty one.
    """
    spark = docs.sparkSession
    lots = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = min(lots, MOST_RANGES)
    within = -(-lots // ranges)
    given = docs.select(F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"), F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"))
    limits = range_limits(given.select("text"), ranges)

    def lot(text: bytes) -> int:
        return bisect_right(limits, text) * within + (zlib.crc32(text) % within if within > 1 else 0)

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, k = Firsts(), 0

        def sent() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for text, *row in firsts.drain():
                rows.append((lot(text), text, *row))
                size += len(text)
                if size > 4 << 20:
                    yield _batch(rows, _SENT)
                    rows, size = [], 0
            yield _batch(rows, _SENT)

        for b in slices(batches):
            done: list[tuple] = []
            for text, doc, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if doc is None:
                    done.append((doc, part, failures(text), 1))
                else:
                    firsts.add(text, doc, part, failures(text), 1, done)
            # known duplicates have no text and are dealt evenly
            yield _batch([((k := k + 1) % lots, None, *row) for row in done], _SENT)
            if firsts.full():
                yield from sent()
        yield from sent()

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, last = Firsts(), None
        for b in batches:
            done: list[tuple] = []
            for text, *row in zip(*[b.column(i).to_pylist() for i in range(1, 6)], strict=True):
                if text is None:
                    done.append(tuple(row))
                    continue
                if text != last and firsts.full():  # in order, no text comes again
                    done += [row for _, *row in firsts.drain()]
                firsts.add(text, *row, done)
                last = text
            yield _batch(done, _OUT)
        yield _batch([row for _, *row in firsts.drain()], _OUT)

    sent = "lot int, text binary, " + _LIGHT
    return given.mapInArrow(before, sent).repartitionById(lots, "lot").sortWithinPartitions("text").mapInArrow(after, _LIGHT)


def by_mask(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents, and of them those labelled quality = 1 and toxic = 1."""
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    told = rows.join(told.where("doc_id IS NOT NULL AND (good OR toxic)"), "doc_id")
    none = F.lit(0).cast("long")
    counts = rows.groupBy("part", "mask").agg(F.sum("n").alias("n")).withColumns({"good": none, "toxic": none})
    marked = told.groupBy("part", "mask").agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    both = counts.unionByName(marked.withColumn("n", none))
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def _steps() -> str:
    """Every order's steps: the filter's bit and the bits of the filters before it."""
    steps = []
    for order in permutations(LETTERS):
        bits = [1 << LETTERS.index(x) for x in order]
        steps += [{"o": "".join(order), "s": k + 1, "b": bits[k], "e": sum(bits[:k])} for k in range(5)]
    return json.dumps(steps)


def interactions(counts: DataFrame) -> DataFrame:
    """One row for each part, order and step, from counts by part and mask."""
    step = F.from_json(F.lit(_steps()), "array<struct<o:string,s:int,b:int,e:int>>")
    x = counts.select("*", F.explode(step).alias("x")).select("*", "x.*")
    mask, bit, earlier = F.col("mask"), F.col("b"), F.col("e")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(earlier) != 0

    def total(condition, value="n"):
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long")

    # of the k filters that a document fails, each is the first one in 120 / k of all orders
    share = F.expr("n * (120 DIV greatest(bit_count(mask), 1))")
    return x.groupBy("part", F.col("o").alias("filter_order"), F.col("s").alias("step")).agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, share).otherwise(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs: doc_id, text, source; labels: doc_id, quality, toxic (several rows of an id: any that says 1; an
    id without a row, or a null, says nothing). See masks() for nulls, ties and empty tables. Repeated rows
    count each. The masks are stored, as counts and labels both read them.
    """
    return interactions(by_mask(stored(masks(docs), "masks"), labels))


SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), masks AS (
    SELECT doc_id, part,
        (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)::INT AS mask
    FROM words
), told AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), counts AS (
    SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM masks LEFT JOIN told USING (doc_id) GROUP BY part, mask
), letters(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS o, [a.b, b.b, c.b, d.b, e.b] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5
), steps AS (
    SELECT o, s, bits[s] AS b, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS e FROM orders, generate_series(1, 5) AS g(s)
)
SELECT part, o AS filter_order, s::INT AS step,
    sum(CASE WHEN mask & (b | e) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & b <> 0 AND mask & e = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & b <> 0 AND mask & e <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = b THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & b <> 0 AND mask & e = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & b <> 0 AND mask & e = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
    sum(sum(CASE WHEN mask & b <> 0 AND mask & e = 0 THEN n ELSE 0 END)) OVER (PARTITION BY part, b)::BIGINT AS shapley
FROM counts, steps GROUP BY part, o, s, b
"""
