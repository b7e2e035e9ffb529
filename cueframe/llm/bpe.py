"""Byte-level BPE by merge replay over a corpus of words.

The pieces (words between spaces, and marks) that the corpus holds most often are counted by Spark over all texts, and
each is replayed once for the whole corpus, in partitions; the table of their ids goes to the workers.
A piece that is not in it is replayed where it is met, and kept while memory allows.

A replay takes many distinct words at once: their bytes form one long array of tokens, and an inverted
index maps each mergeable pair (by the rank of what it makes) to its positions there. The ranks are taken
in order, every position of the rank is merged and only the two pairs beside it are indexed anew.
Texts are then strings of finished pieces, put together by Arrow.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, forget, kind_cuts, pieces_between, slices, stored, text_bytes

#: Pieces that the table of the corpus holds at most (about 30 bytes each; results do not depend on it).
TABLE_PIECES = 1 << 17
#: Bytes of finished pieces, about, that a Python worker keeps beside the table during a task.
KEPT_BYTES = 96 << 20
#: Text bytes that are counted or encoded at once.
BATCH_BYTES = 4 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Ranks(dict):
    """bytes to rank, the way back, and the rank of what each pair of tokens makes."""

    def __init__(self, given: dict[bytes, int]):
        super().__init__(given)
        self.made = {r: t for t, r in given.items()}
        self.of_byte = np.array([given[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for t, r in given.items():
            for i in range(1, len(t)):
                if (a := given.get(t[:i])) is not None and (b := given.get(t[i:])) is not None:
                    pairs[a << 20 | b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.results = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that each pair makes, -1 for none or where a side is negative."""
        if not len(self.keys):
            return np.full(len(a), -1, np.int64)
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.results[at], -1)


#: Places of one rank from which they are merged by numpy rather than one by one.
MANY = 24


def replay(words: list[bytes], ranks: Ranks) -> list[list[int]]:
    """Token ids of each word. The lowest rank goes first, its leftmost position first; a word that
    is a token itself is not taken apart."""
    open_words = [w for w in words if w not in ranks]
    sizes = np.array([len(w) for w in open_words], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = int(sizes.sum())
    # one place more, so that -1 (no neighbour) reads a token that makes no pair
    tokens = np.full(n + 1, -1, np.int64)
    tokens[:n] = ranks.of_byte[np.frombuffer(b"".join(open_words), np.uint8)]
    rights, lefts = np.arange(1, n + 2), np.arange(-1, n)
    full = sizes > 0
    rights[ends[full] - 1] = -1
    lefts[starts[full]] = -1
    rank = ranks.of_pairs(tokens[:n], tokens[rights[:n]])
    places = np.flatnonzero(rank >= 0)
    places = places[np.argsort(rank[places], kind="stable")]
    keys, cuts = np.unique(rank[places], return_index=True)
    index = {k: p.tolist() for k, p in zip(keys.tolist(), np.split(places, cuts[1:]), strict=True)} if len(keys) else {}
    heap = keys.tolist()
    token, right, left = memoryview(tokens), memoryview(rights), memoryview(lefts)
    made_by = ranks.pairs.get

    def add(s: int, at: list[int]) -> None:
        if s in index:
            index[s] += at
        else:
            index[s] = at
            heapq.heappush(heap, s)

    def merge_all(r: int, at: np.ndarray) -> bool:
        """Merges all places of a rank at once, unless one of them bears on another's turn."""
        i = np.unique(at)
        j = rights[i]
        now = ranks.of_pairs(tokens[i], tokens[j]) == r
        i, j = i[now], j[now]
        if not len(i):
            return True
        a, b = lefts[i], rights[j]
        joined = np.zeros(len(i), bool)  # beside the place before, which is merged as well
        joined[1:] = a[1:] == j[:-1]
        if (i[1:] == j[:-1]).any():
            return False
        ta, tb = tokens[a], tokens[b]
        ta[joined] = r
        tb[:-1][joined[1:]] = r
        same = np.full(len(i), r)
        before, behind = ranks.of_pairs(ta, same), ranks.of_pairs(same, tb)
        if ((before >= 0) & (before <= r)).any() or ((behind >= 0) & (behind <= r)).any():
            return False
        tokens[i], tokens[j], rights[i] = r, -1, b
        lefts[b[b >= 0]] = i[b >= 0]
        a = lefts[i]
        new, at = np.concatenate([before, behind]), np.concatenate([a, i])
        new, at = new[(some := new >= 0)], at[some]
        order = np.argsort(new, kind="stable")
        new, at = new[order], at[order].tolist()
        cuts = [0, *(np.flatnonzero(new[1:] != new[:-1]) + 1).tolist(), len(at)]
        for p, q in zip(cuts[:-1], cuts[1:], strict=True):
            if q > p:
                add(int(new[p]), at[p:q])
        return True

    while heap:
        r = heapq.heappop(heap)
        at = index.pop(r, None)
        if not at or (len(at) >= MANY and merge_all(r, np.array(at))):
            continue
        at.sort()
        for k, i in enumerate(at):
            t, j = token[i], right[i]
            if t < 0 or j < 0 or made_by(t << 20 | token[j], -1) != r:
                continue
            token[i], token[j] = r, -1
            right[i] = b = right[j]
            lower = False
            if b >= 0:
                left[b] = i
                if (s := made_by(r << 20 | token[b], -1)) >= 0:
                    add(s, [i])
                    lower = s <= r
            a = left[i]
            if a >= 0 and (s := made_by(token[a] << 20 | r, -1)) >= 0:
                add(s, [a])
                lower = lower or s <= r
            if lower:  # a pair that goes before the places left over: they wait
                add(r, at[k + 1 :])
                break
    flat = tokens[:n]
    alive = flat >= 0
    upto = np.concatenate([[0], np.cumsum(alive)])
    flat = flat[alive].tolist()
    parts = iter(zip(upto[starts].tolist(), upto[ends].tolist(), strict=True)) if len(sizes) else iter(())
    out = []
    for w in words:
        if w in ranks:
            out.append([ranks[w]])
        else:
            i, j = next(parts)
            out.append(flat[i:j])
    return out


def _numbers(ids: bytes | memoryview) -> list[int]:
    return [int(x) for x in bytes(ids).split(b",") if x]


def _one(parts: list[tuple[bytes, int, bytes]]) -> tuple[bytes, int, bytes]:
    return b"".join([p[0] for p in parts]), sum(p[1] for p in parts), b"".join([p[2] for p in parts])


class Codec:
    """Encodes texts; a piece is (decimal ids with a comma behind each, their number, the bytes they decode to)."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = Ranks(load_ranks(path))
        self.find = regex.compile(pattern).findall
        spaces = [c.encode() for c in regex.findall(r"\s", "".join(map(chr, range(0x3001))))]
        self.ascii_space, self.leads = np.zeros(256, bool), np.zeros(256, bool)
        self.ascii_space[[c[0] for c in spaces if len(c) == 1]] = True
        self.wide_space = tuple(c for c in spaces if len(c) > 1)
        self.leads[[c[0] for c in self.wide_space]] = True
        self.kept = Kept(KEPT_BYTES)
        self.table: dict[str, tuple[bytes, int, bytes]] = {}
        self.table_name = None

    def load(self, name, table: dict[str, bytes]) -> None:
        """The table of the corpus (piece to ids); ids are decoded as any others."""
        if self.table_name != name:
            self.table = {p: self._piece(_numbers(ids)) for p, ids in table.items()}
            self.table_name = name

    def _piece(self, ids: list[int]) -> tuple[bytes, int, bytes]:
        return "".join([f"{x}," for x in ids]).encode(), len(ids), b"".join(map(self.ranks.made.__getitem__, ids))

    def pieces(self, keys: list[str]) -> list[tuple[bytes, int, bytes]]:
        """The piece of each key: strings that the pattern cuts as it would within their texts."""
        table, kept = self.table.get, self.kept.get
        out = [table(k) or kept(k) for k in keys]
        unknown = [i for i, x in enumerate(out) if x is None]
        if not unknown:
            return out
        words = [self.find(keys[i]) for i in unknown]
        made = {w: table(w) or kept(w) for w in {w for ws in words for w in ws}}
        new = [w for w, x in made.items() if x is None]
        for w, ids in zip(new, replay([w.encode() for w in new], self.ranks), strict=True):
            made[w] = self._piece(ids)
            self.kept.put(w, made[w])
        for i, ws in zip(unknown, words, strict=True):
            parts = [made[w] for w in ws]
            out[i] = parts[0] if len(parts) == 1 else _one(parts)
            if len(parts) > 1:
                self.kept.put(keys[i], out[i])
        return out

    def cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of texts begin, and which texts must be cut by the pattern as a whole.

        A match begins at a single space before a character that is no white space, and none reaches
        across it, nor from one kind of ASCII character to another; so the parts between are encoded
        apart. A text in which white space meets a space, or that ends in one, is taken whole.
        """
        space = np.flatnonzero(data == 32)
        behind = data[np.minimum(space + 1, len(data) - 1)] if len(data) else space
        last = np.zeros(len(data) + 1, bool)
        last[at[1:]] = True
        odd = last[space + 1] | self.ascii_space[behind]
        for k in np.flatnonzero(self.leads[behind] & ~odd):
            odd[k] = bytes(data[space[k] + 1 : space[k] + 4]).startswith(self.wide_space)
        whole = np.zeros(len(at) - 1, bool)
        whole[np.searchsorted(at, space[odd], "right") - 1] = True
        cut = kind_cuts(data, at)
        cut[space] = True
        return np.flatnonzero(cut), whole

    def encode(self, texts: pa.Array) -> tuple[list[memoryview], np.ndarray, list[memoryview]]:
        """Of each text (nulls are empty) the ids joined by commas, their number, and the bytes decoded."""
        data, at = text_bytes(texts)
        starts, whole = self.cut(data, at)
        begins = np.searchsorted(starts, at)
        coded = pieces_between(data, starts)
        place = coded.indices.to_numpy()
        keep = ~np.repeat(whole, np.diff(begins))
        used = np.unique(place[keep])
        row_of = np.zeros(len(coded.dictionary), np.int64)
        row_of[used] = np.arange(len(used))
        rows = self.pieces(coded.dictionary.take(pa.array(used)).to_pylist())
        row = row_of[place]
        for i in np.flatnonzero(whole):  # one row for all of the text
            row[begins[i]] = len(rows)
            keep[begins[i]] = True
            rows.append(_one(self.pieces(self.find(bytes(data[at[i] : at[i + 1]]).decode()))))
        upto = np.concatenate([[0], np.cumsum(keep)])[begins]
        row = row[keep]
        counts = np.array([r[1] for r in rows], np.int64)
        total = np.concatenate([[0], np.cumsum(counts[row])])[upto]
        ids, back = (_joined([r[k] for r in rows], row, upto) for k in (0, 2))
        return [x[:-1] for x in ids], np.diff(total), back


def _joined(values: list[bytes], at: np.ndarray, upto: np.ndarray) -> list[memoryview]:
    """For each text the values at its places, one after another."""
    taken = pa.array(values, pa.large_binary()).take(pa.array(at))
    data, ends = text_bytes(taken)
    view, cuts = memoryview(np.ascontiguousarray(data)), ends[upto].tolist()
    return [view[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def corpus_table(docs: DataFrame, rank_file: str, pattern: str, text_column: str = "text", most: int = TABLE_PIECES) -> DataFrame:
    """piece, ids: the pieces that the texts hold most often, at most `most` of them,
    each replayed once. Every occurrence in every text is counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for b in slices(batches, 0, BATCH_BYTES):
            data, at = text_bytes(b.column(0))
            starts, whole = c.cut(data, at)
            coded = pieces_between(data, starts)
            apart = ~np.repeat(whole, np.diff(np.searchsorted(starts, at)))
            n = np.bincount(coded.indices.to_numpy()[apart], minlength=len(coded.dictionary))
            some = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([coded.dictionary.filter(some).cast(pa.string()), pa.array(n).filter(some)], names=["piece", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for b in batches:
            keys = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([x[0] for x in c.pieces(keys)], pa.binary())], names=["piece", "ids"])
        c.kept.clear()

    counted = docs.select(F.col(text_column).alias("text")).mapInArrow(count, "piece string, n bigint")
    counted = stored(counted.groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1"), "pieces")
    level = F.floor(F.log2("n")).cast("int")
    sizes = sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("many")).collect(), reverse=True)  # at most 64 rows
    total, least = 0, 64
    for r in sizes:
        total += r["many"]
        if total > most:
            break
        least = r["level"]
    out = stored(counted.where(level >= least).select("piece").repartition("piece").mapInArrow(encode, "piece string, ids binary"), "piece-ids")
    forget(counted)
    return out


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again: id, n_tokens, ids_sha256 (of the decimal
    ids joined by commas), decoded_sha256 and, if asked for, ids.

    rank_file is read on each executor. Null text: as empty (no tokens). Other columns are not read,
    whatever their names. Repeated rows give repeated results; an empty table gives an empty one.
    """
    schema = f"{id_column} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    spark = docs.sparkSession
    # at most TABLE_PIECES rows pass through the driver
    table = corpus_table(docs, rank_file, pattern, text_column)
    known = spark.sparkContext.broadcast({r["piece"]: r["ids"] for r in table.toArrow().to_pylist()})
    name = table.stored_at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        c.load(name, known.value)
        for b in slices(batches, 1, BATCH_BYTES):
            ids, n, back = c.encode(b.column(1))
            cols = [b.column(0), pa.array(n), *[pa.array([hashlib.sha256(x).hexdigest() for x in col], pa.string()) for col in (ids, back)]]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(map(_numbers, ids), pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        c.kept.clear()

    return docs.select(F.col(id_column).cast("long").alias(id_column), F.col(text_column).alias("_text")).mapInArrow(run, schema)

