"""Packing by retrieval: a window holds a seed document and its nearest unused neighbours.

Texts are tokenized once; terms are token ids, so document frequencies of the whole corpus are one count
for each id of the vocabulary. A document is dealt to a shard by the term that wins a draw weighted by
inverse document frequency, so documents that share rare terms tend to meet. Shards are bounded: terms
of few documents share one, those of many are split by the rows' own numbers. Within a shard an inverted
index with BM25 weights (frequencies and mean length of the corpus) answers each seed with its unused
neighbours, best first, and these fill the window. The neighbour that reaches its end is cut there and is
the next window's seed, so windows are full; the last one of a shard is cut at powers of two, the lengths
that need no padding. A shard therefore leaves none.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, kind_cuts, mix, pieces_between, slices, stored, text_bytes

#: Tokens and documents of a shard, about.
SHARD_TOKENS, SHARD_DOCS = 1 << 20, 1 << 14
#: Bytes of finished pieces that a Python worker keeps, text bytes that are tokenized at once.
KEPT_BYTES, BATCH_BYTES = 96 << 20, 4 << 20
K1, B = 1.2, 0.75
#: The share of an index's documents that are unused, below which it is made smaller.
STALE = 0.8
#: Words that are tokenized in one row; how byte-level vocabularies write a space.
ROW_WORDS, SPACE = 512, "\u0120"
#: One space, then characters that are no space (nor a part of special tokens), white space neither first nor last.
_EDGE = r"[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}<|]"
WORD = rf"^ {_EDGE}(?:[^ <|]*{_EDGE})?\z"

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class ByteIds:
    """Token ids of texts, each vocabulary entry two bytes (four beyond 65536 entries).

    Matches of the tokenizer's pattern never reach from a character that is no white space to one that
    is, nor from one kind of ASCII character to another; the parts between are encoded once each. A text
    that holds one of the tokenizer's special tokens goes through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = "|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values())
        self.vocabulary = self.whole.get_vocab_size()
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.spaced = np.zeros(self.vocabulary, bool)
        self.spaced[[i for token, i in self.whole.get_vocab(with_added_tokens=False).items() if token[0] == SPACE]] = True
        self.clear()

    def clear(self) -> None:
        """Forgets the pieces that are known."""
        self.pieces, self.coded = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _known(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids as bytes, and for each of the pieces, which are distinct, where its own stand there."""
        place = pc.index_in(pieces, value_set=self.pieces)
        new = pieces.filter(place.is_null())
        # words behind one space stand apart also in a row of them, where each begins with the only tokens that do
        word = pc.match_substring_regex(new, WORD)
        words, rest = new.filter(word), new.filter(pc.invert(word))
        place, word = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), word.to_numpy(zero_copy_only=False)
        place[place < 0] = len(self.pieces) + np.where(word, np.cumsum(word) - 1, len(words) + np.cumsum(~word) - 1)
        coded = pa.concat_arrays([self.coded, self._words(words), self._each(rest)])
        if coded.nbytes + self.pieces.nbytes + new.nbytes < KEPT_BYTES:
            self.pieces, self.coded = pa.concat_arrays([self.pieces, words, rest]), coded
        else:
            self.pieces, self.coded = pieces, coded.take(pa.array(place))
        return coded, place

    def _words(self, words: pa.Array) -> pa.Array:
        data, at = text_bytes(words)
        rows = [data[i:j].tobytes().decode() for i, j in pairwise([*at[:-1:ROW_WORDS].tolist(), len(data)])]
        ids = self._ids(rows)[0]
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(words):
            raise ValueError("a word has not one token with a space")
        return self._bytes(ids, np.append(starts, len(ids)))

    def _each(self, pieces: pa.Array) -> pa.Array:
        return self._bytes(*self._ids(pieces.to_pylist()))

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
        return np.fromiter(chain.from_iterable(ids), self.kind, at[-1]), at

    @staticmethod
    def _bytes(ids: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64) * ids.itemsize), pa.py_buffer(ids)])

    @staticmethod
    def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where pieces begin: as kind_cuts(), and before ASCII white space behind a character beyond ASCII.
        Characters of white space beyond ASCII are C2 85, C2 A0, E1 9A 80, E2 80 .., E2 81 9F and E3 80 80."""
        cut = kind_cuts(data, at)
        if len(data) > 3:
            last, before, first = data[2:-1], data[1:-2], data[:-3]
            wide = (before == 0xC2) & ((last == 0x85) | (last == 0xA0)) | (last == 0x80) & (((first == 0xE1) & (before == 0x9A)) | ((first == 0xE3) & (before == 0x80))) | (first == 0xE2) & ((before == 0x80) | ((before == 0x81) & (last == 0x9F)))
            cut[3:] |= _BLANK[data[3:]] & (last >= 0x80) & ~wide
        return np.flatnonzero(cut)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each begins; nulls are empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        apart = np.flatnonzero(pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)) if self.special else []
        data, at = text_bytes(texts)
        starts = self.cuts(data, at)
        coded = pieces_between(data, starts)
        known, place = self._known(coded.dictionary)
        taken = known.take(pa.array(place[coded.indices.to_numpy()]))
        raw, ends = text_bytes(taken)
        ids, upto = np.frombuffer(np.ascontiguousarray(raw), self.kind), ends[np.searchsorted(starts, at)] // self.kind.itemsize
        if len(apart):
            parts = np.split(ids, upto[1:-1])
            for i in apart:
                parts[i] = np.array(self.whole.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, self.kind)
            ids, upto = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, upto


_ids: dict[str, ByteIds] = {}


def byte_ids(path: str) -> ByteIds:
    if path not in _ids:
        _ids[path] = ByteIds(path)
    return _ids[path]


def tokenized(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """doc_id, lot (a number of the row), n, ids: the ids of each text with the end id behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = byte_ids(tokenizer_file), 0
        for b in slices(batches, 1, BATCH_BYTES):
            ids, upto = coder.encode(b.column(1))
            ids = np.insert(ids, upto[1:], end_id)
            upto = (upto + np.arange(len(upto))).astype(np.int64)
            doc = b.column(0)
            lots = mix(doc.fill_null(0).to_numpy().astype(np.uint64) * np.uint64(1_000_003) + np.arange(seen, seen + len(doc), dtype=np.uint64)) >> np.uint64(33)
            seen += len(doc)
            values = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(upto * ids.itemsize), pa.py_buffer(np.ascontiguousarray(ids))])
            yield pa.RecordBatch.from_arrays([doc, pa.array(lots.astype(np.int64)), pa.array(np.diff(upto)), values.cast(pa.binary())], names=["doc_id", "lot", "n", "ids"])
        coder.clear()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    return given.mapInArrow(run, "doc_id bigint, lot bigint, n bigint, ids binary")


def frequencies(rows: DataFrame, vocabulary: int, kind: np.dtype) -> tuple[np.ndarray, int, int]:
    """For each term the documents that hold it, the number of documents, and of tokens: a count for each
    entry of the vocabulary, however large the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            data, at = text_bytes(b.column(0))
            ids, at = np.frombuffer(np.ascontiguousarray(data), kind), at // kind.itemsize
            for i in range(0, b.num_rows, 64):
                own = at[i : i + 65]
                both = np.repeat(np.arange(len(own) - 1, dtype=np.uint32) * np.uint32(vocabulary), np.diff(own)) + ids[own[0] : own[-1]]
                both.sort()
                first = np.append(True, both[1:] != both[:-1])[: len(both)]
                total += np.bincount(both[first] % np.uint32(vocabulary), minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "docs"])

    counts = rows.select("ids").mapInArrow(run, "term int, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs"))
    df = np.zeros(vocabulary, np.int64)
    for r in counts.collect():  # at most a row for each entry of the vocabulary
        df[r["term"]] = r["docs"]
    many, tokens = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return df, many, tokens


def weights(df: np.ndarray, many: int) -> np.ndarray:
    """Inverse document frequency ln((N - df + 0.5) / (df + 0.5)), 0 where a term stands in half of all documents or more."""
    return np.maximum(np.log((many - df + 0.5) / (df + 0.5)), 0.0)


def draws(idf: np.ndarray) -> np.ndarray:
    """Each term's place in a draw that terms win in proportion to their weight; terms without weight come last."""
    u = ((mix(np.arange(1, len(idf) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    place = np.empty(len(idf), np.int64)
    place[np.argsort(-np.log(u) / np.maximum(idf, 1e-9), kind="stable")] = np.arange(len(idf))
    return place


def dealt(rows: DataFrame, idf: np.ndarray, kind: np.dtype) -> DataFrame:
    """rows with their shard."""
    place = draws(idf).astype(np.int32)

    def keys(b: pa.RecordBatch, column: int) -> np.ndarray:
        data, at = text_bytes(b.column(column))
        ids, at = np.frombuffer(np.ascontiguousarray(data), kind), at // kind.itemsize
        return np.minimum.reduceat(place[ids], at[:-1]) if b.num_rows else np.zeros(0, np.int32)  # no row is empty

    def key_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, tokens = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        for b in batches:
            key = keys(b, 1)
            np.add.at(docs, key, 1)
            np.add.at(tokens, key, b.column(0).to_numpy())
        some = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(docs[some]), pa.array(tokens[some])], names=["key", "docs", "tokens"])

    sizes = rows.select("n", "ids").mapInArrow(key_sizes, "key int, docs bigint, tokens bigint").groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    first, many = np.zeros(len(place), np.int64), np.ones(len(place), np.int64)
    shard, docs, tokens = -1, SHARD_DOCS, SHARD_TOKENS
    for r in sorted(sizes.collect()):  # at most a row for each entry of the vocabulary
        parts = max(-(-r["tokens"] // SHARD_TOKENS), -(-r["docs"] // SHARD_DOCS))
        docs, tokens = docs + r["docs"], tokens + r["tokens"]
        if parts > 1 or docs > SHARD_DOCS or tokens > SHARD_TOKENS:
            shard, docs, tokens = shard + 1, r["docs"], r["tokens"]
        first[r["key"]], many[r["key"]] = shard, parts
        if parts > 1:
            shard, docs, tokens = shard + parts - 1, SHARD_DOCS, SHARD_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = keys(b, 3)
            shard = first[key] + b.column(1).to_numpy() % many[key]
            yield pa.RecordBatch.from_arrays([pa.array(shard), b.column(0), b.column(2), b.column(3)], names=["shard", "doc_id", "n", "ids"])

    return rows.mapInArrow(run, "shard bigint, doc_id bigint, n bigint, ids binary")


class Index:
    """BM25 over the documents of a shard. ids: all their tokens; at: where each document begins."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, idf: np.ndarray, mean: float):
        size = np.diff(at)
        self.many, self.idf = len(size), idf
        wide = np.uint32 if self.many <= 1 << 16 and len(idf) <= 1 << 16 else np.uint64
        bits = wide(16 if wide is np.uint32 else 32)
        word = ids[idf[ids] > 0].astype(wide)
        doc = np.repeat(np.arange(self.many, dtype=wide), size)[idf[ids] > 0]
        both, tf = np.unique(word << bits | doc, return_counts=True)
        term, self.doc = (both >> bits).astype(np.int64), (both & (wide(1) << bits) - wide(1)).astype(np.int64)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.doc] / mean))
        self.upto = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(idf)))])
        self.asked = np.zeros(len(idf), bool)

    def keep(self, some: np.ndarray) -> None:
        """Forgets the entries of all other documents; the places of documents stay."""
        own = some[self.doc]
        self.upto = np.concatenate([[0], np.cumsum(own)])[self.upto]
        self.doc, self.weight = self.doc[own], self.weight[own]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Of each document for the distinct terms of a query."""
        self.asked[ids] = True
        terms = np.flatnonzero(self.asked)
        self.asked[terms] = False
        first, n = self.upto[terms], self.upto[terms + 1] - self.upto[terms]
        place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.doc[place], self.weight[place], minlength=self.many)


def fill(ids: np.ndarray, at: np.ndarray, idf: np.ndarray, mean: float, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length). Seeds in order; neighbours by falling score, then in order."""
    index, unused = Index(ids, at, idf, mean), np.ones(len(at) - 1, bool)
    held = len(unused)
    size, out, window, room = np.diff(at).tolist(), [], [], capacity
    cut: tuple[int, int] | None = None  # a document that begins the next window, and where
    for seed in range(len(size)):
        while unused[seed] or cut:
            doc, start = cut or (seed, 0)
            unused[doc], cut, ranked = False, None, None
            while True:
                take = min(room, size[doc] - start)
                window.append((doc, start, take))
                room -= take
                if start + take < size[doc]:
                    cut = (doc, start + take)
                if not room:
                    out.append(window)
                    window, room = [], capacity
                    break
                if ranked is None:  # asked once the seed leaves room
                    left = np.flatnonzero(unused)
                    if len(left) < held * STALE:  # used documents are looked through no more
                        index.keep(unused)
                        held = len(left)
                    score = index.scores(ids[at[doc] : at[doc + 1]])[left] if len(left) else left
                    ranked = iter(left[np.argsort(-score, kind="stable")].tolist())
                doc, start = next(ranked, -1), 0
                if doc < 0:
                    break
                unused[doc] = False
    return out + [s for s in _powers(window) if s]


def _powers(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces of a window that is not full, in sequences whose lengths are powers of two."""
    total = sum(n for _, _, n in window)
    pieces = list(reversed(window))
    for bit in reversed(range(total.bit_length())):
        want, own = total & 1 << bit, []
        while want:
            doc, start, n = pieces.pop()
            take = min(n, want)
            own.append((doc, start, take))
            want -= take
            if take < n:
                pieces.append((doc, start + take, n - take))
        yield own


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of docs (doc_id, text).

    Null text: as empty (the end id alone). Repeated rows are packed each; a null doc_id is one as any
    other. Other columns are not read, whatever their names. An empty table gives an empty one. Ids stand
    in the shared folder until their shards are filled. In the result, sequence_id is the shard's number
    times 2**32 and a number within it.
    """
    coder = byte_ids(tokenizer_file)
    kind = coder.kind
    rows = stored(tokenized(docs, tokenizer_file, end_id), "token-ids")
    df, many, tokens = frequencies(rows, coder.vocabulary, kind)
    idf, mean = weights(df, many), tokens / max(many, 1)

    def shard(table: pa.Table) -> pa.Table:
        key = table["shard"][0].as_py()
        order = np.lexsort((table["n"].to_numpy(), table["doc_id"].fill_null(-1).to_numpy()))
        table = table.take(pa.array(order)).combine_chunks()
        data, at = text_bytes(table["ids"])
        ids, at = np.frombuffer(np.ascontiguousarray(data), kind), at // kind.itemsize
        wide, doc_ids, sizes = ids.astype("<u4"), table["doc_id"].to_pylist(), np.diff(at).tolist()
        out = []
        for k, sequence in enumerate(fill(ids, at, idf, mean, capacity)):
            offset = 0
            for doc, start, n in sequence:
                crc = zlib.crc32(wide[at[doc] + start : at[doc] + start + n])
                out.append((doc_ids[doc], start, n, crc, sizes[doc], key << 32 | k, offset))
                offset += n
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    out = stored(dealt(rows, idf, kind).groupBy("shard").applyInArrow(shard, schema), "packed")
    forget(rows)
    return out
