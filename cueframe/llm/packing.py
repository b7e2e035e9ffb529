"""Packing documents into sequences by linear grouping and best fit.

Only the histogram of piece lengths (at most `capacity` counts) reaches the driver, where the plan is
made; the pieces stay distributed and look up their place by length and rank within that length.

The plan: lengths above a fraction of the capacity are large. Sorted, they are cut into groups of equal
cardinality and each is rounded up to its group's largest length. Configurations of these few sizes are
optimised (each the fullest that the sizes left allow, with the largest size left in it, used as often as
counts allow). Actual documents take the places of rounded ones, which frees their difference, and the
small lengths are put, longest first, into the sequence with the least sufficient room.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, kind_cuts, pieces_between, slices, stored, text_bytes
from .sharding import numbered

#: Bytes of finished words, about, that a Python worker keeps during a task.
KEPT_BYTES = 64 << 20
#: Text bytes that are tokenized at once.
BATCH_BYTES = 4 << 20
RANK_BUCKETS = 256
#: Words that are tokenized in one row; how the vocabulary marks the end of a word; words that are one piece to it.
ROW_WORDS, WORD_END = 512, "</w>"
_LETTERS = re.compile("[a-zà-öø-ÿ]+ *").fullmatch


#: ASCII capitals as small letters, ASCII white space as spaces.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[9:14] = 32


class WordIds:
    """Token ids (little-endian unsigned 32 bit) of texts. The tokenizer drops white space and never
    reaches across it, nor from ASCII letters to digits or marks; the parts between are encoded once each. A text that holds one of the
    tokenizer's special tokens goes through the tokenizer whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = "|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values())
        # lower-casing may make what looks like a special token of a word that is none
        self.words = Tokenizer.from_file(path)
        self.words.encode_special_tokens = True
        vocabulary = self.words.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.kept = Kept(KEPT_BYTES)

    def _known(self, words: list[str]) -> list[bytes]:
        out = [self.kept.get(w) for w in words]
        todo = [i for i, x in enumerate(out) if x is None]
        # words of small letters stand apart also in a row of them, where each ends with the only tokens that end one
        plain = [i for i in todo if _LETTERS(words[i])]
        rows = [" ".join([words[i] for i in plain[k : k + ROW_WORDS]]) for k in range(0, len(plain), ROW_WORDS)]
        ids = [np.array(e.ids, "<u4") for e in self.words.encode_batch_fast(rows, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.zeros(0, "<u4")
        raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        for i, j, k in zip(plain, [0, *ends][: len(ends)], ends, strict=True):
            out[i] = raw[j:k]
        rest = [i for i in todo if out[i] is None]
        encoded = self.words.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, encoded, strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        for i in todo:
            self.kept.put(words[i], out[i])
        return out

    def encode(self, texts: pa.Array) -> list[memoryview | bytes]:
        """The ids of each text; nulls are empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        apart = pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False) if self.special else np.zeros(len(texts), bool)
        data, at = text_bytes(texts)
        data = _PLAIN[data]
        cut = kind_cuts(data, at)
        cut[1:] |= (data[:-1] == 32) & (data[1:] != 32)
        starts = np.flatnonzero(cut)
        coded = pieces_between(data, starts)
        words = self._known(coded.dictionary.to_pylist())
        taken = pa.array(words, pa.large_binary()).take(coded.indices)
        ids, ends = text_bytes(taken)
        view, upto = memoryview(np.ascontiguousarray(ids)), ends[np.searchsorted(starts, at)].tolist()
        out = [view[i:j] for i, j in zip(upto[:-1], upto[1:], strict=True)]
        for i in np.flatnonzero(apart):
            out[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _ids:
        _ids[path] = WordIds(path)
    return _ids[path]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each text and id 0, cut at the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer_file)
        for b in slices(batches, 1, BATCH_BYTES):
            rows = []
            for doc, own in zip(b.column(0).to_pylist(), ids.encode(b.column(1)), strict=True):
                n = len(own) // 4 + 1
                for k, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    crc = zlib.crc32(own[4 * at : 4 * (at + size)])
                    rows.append((doc, k, at, size, zlib.crc32(b"\0\0\0\0", crc) if at + size == n else crc))
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        ids.kept.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Plan:
    """Places for counts of lengths. entries: (length, first rank, last rank + 1, first sequence, pieces
    of this length in each sequence, offset of the first of them)."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int, large_from: int):
        self.capacity, self.entries, self.sequences = capacity, [], 0
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (sequences, first of them)
        self.open = 0  # bit r: some sequence has room r
        counts = {n: c for n, c in counts.items() if c}
        if counts.get(capacity):
            self.entries.append((capacity, 0, counts[capacity], 0, 1, 0))
            self.sequences = counts[capacity]
        self._large({n: c for n, c in counts.items() if large_from <= n < capacity}, groups)
        for n in sorted((n for n in counts if n < large_from and n < capacity), reverse=True):
            self._best_fit(n, counts[n])

    def _keep(self, room: int, many: int, first: int) -> None:
        if room and many:
            self.room[room].append((many, first))
            self.open |= 1 << room

    def _large(self, counts: dict[int, int], groups: int) -> None:
        total = sum(counts.values())
        if not total:
            return
        each = -(-total // min(groups, total))
        # groups: rounded size and segments [length, first rank, count], longest first
        sizes: list[int] = []
        segments: list[list[list[int]]] = []
        left = 0
        for n in sorted(counts, reverse=True):
            at, c = 0, counts[n]
            while c:
                if not left:
                    if len(counts) <= groups or not sizes or sizes[-1] != n:
                        sizes.append(n)
                        segments.append([])
                    left = counts[n] if len(counts) <= groups else each
                take = min(left, c)
                segments[-1].append([n, at, take])
                at, c, left = at + take, c - take, left - take
        stock = [sum(s[2] for s in seg) for seg in segments]
        while any(stock):
            config = self._fullest(sizes, stock)
            times = min(stock[g] // m for g, m in config.items())
            slots = []
            for g, m in config.items():
                stock[g] -= m * times
                slots += [self._take(segments[g], times) for _ in range(m)]
            self._substitute(slots, times)

    def _fullest(self, sizes: list[int], stock: list[int]) -> dict[int, int]:
        """Sizes whose sum comes nearest to the capacity, with the largest one that is left."""
        top = next(g for g, c in enumerate(stock) if c)
        space = self.capacity - sizes[top]
        limit = (1 << (space + 1)) - 1
        reach, steps = 1, []
        for g in range(top, len(sizes)):
            for _ in range(min(stock[g] - (g == top), space // sizes[g])):
                new = (reach | reach << sizes[g]) & limit
                if new == reach:
                    break
                steps.append((g, reach))
                reach = new
            if reach >> space & 1:
                break
        at, config = reach.bit_length() - 1, {top: 1}
        for g, before in reversed(steps):
            if not before >> at & 1:
                at -= sizes[g]
                config[g] = config.get(g, 0) + 1
        return config

    @staticmethod
    def _take(segments: list[list[int]], many: int) -> list[tuple[int, int, int]]:
        out = []
        while many:
            n, at, c = segments[0]
            take = min(c, many)
            out.append((n, at, take))
            segments[0][1:] = [at + take, c - take]
            if c == take:
                segments.pop(0)
            many -= take
        return out

    def _substitute(self, slots: list[list[tuple[int, int, int]]], times: int) -> None:
        """Sequences with equal actual lengths become one run, whose room is known exactly."""
        ends = sorted({sum(s[2] for s in slot[: i + 1]) for slot in slots for i in range(len(slot))})
        where = [[0, 0] for _ in slots]  # segment, used of it
        done = 0
        for end in ends:
            many, offset = end - done, 0
            for k, slot in enumerate(slots):
                seg, used = where[k]
                n, at, c = slot[seg]
                self.entries.append((n, at + used, at + used + many, self.sequences, 1, offset))
                offset += n
                where[k] = [seg, used + many] if used + many < c else [seg + 1, 0]
            self._keep(self.capacity - offset, many, self.sequences)
            self.sequences += many
            done = end

    def _best_fit(self, n: int, count: int) -> None:
        at = 0
        while count:
            fits = self.open >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                many, first = self.room[room].pop()
                if not self.room[room]:
                    self.open &= ~(1 << room)
            else:
                room, first = self.capacity, self.sequences
                many = -(-count // (room // n))
                self.sequences += many
            k = room // n
            full = min(many, count // k)
            if full:
                self.entries.append((n, at, at + full * k, first, k, self.capacity - room))
                self._keep(room - k * n, full, first)
                at, count, first, many = at + full * k, count - full * k, first + full, many - full
            if many and count:  # fewer are left than one sequence takes
                self.entries.append((n, at, at + count, first, count, self.capacity - room))
                self._keep(room - count * n, 1, first)
                at, count, first, many = at + count, 0, first + 1, many - 1
            self._keep(room, many, first)


#: Group counts that are tried; with fewer large lengths than groups, each length is a group.
GROUPS = (48, 192, 768)


def best_plan(counts: dict[int, int], capacity: int) -> Plan:
    """The plan with the fewest sequences among several group counts and limits between large and small."""
    tries = (Plan(counts, capacity, g, max(2, capacity // f)) for g in GROUPS for f in (3, 6, 12))
    return min(tries, key=lambda p: p.sequences)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text).

    Texts are tokenized once, and no text or token is shuffled. Null text: as empty (id 0 alone). Only
    documents above the capacity are cut. Repeated rows are packed each; a null doc_id is one as any other.
    An empty table gives an empty one.
    """
    cut = stored(pieces(docs, tokenizer_file, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = np.array(sorted(best_plan(counts, capacity).entries), np.int64).reshape(-1, 6)
    keys = plan[:, 0] << 44 | plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(5).to_numpy()
            length = b.column(3).to_numpy()
            e = plan[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            k = rank - e[:, 1]
            cols = [*b.columns[:5], pa.array(e[:, 3] + k // e[:, 4]), pa.array(e[:, 5] + k % e[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = numbered(cut, ["length"], ["doc_id", "piece", "ids_crc32"], F.struct("doc_id", "piece", "ids_crc32"), RANK_BUCKETS)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("slot").cast("long").alias("slot"))
    return ranked.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
