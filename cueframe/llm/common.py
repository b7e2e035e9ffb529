"""Shared helpers: the shared folder of the cluster, and text columns as byte arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that are worked on at once inside a task; one longer document is taken alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_table(spark: SparkSession, sf_dir: str, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one only where none is set and driver and
    executors are one process (tests, a bench); on a cluster a missing one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cueframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of stored() tables that nothing reads any more."""
    for df in tables:
        forget_path(df.sparkSession, df.stored_at)


def forget_path(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def private(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of docs is called so."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for k in range(len(taken) + 1) if (n := "_" * k + name).lower() not in taken) for name in names]


def by_place(docs: DataFrame) -> DataFrame:
    """docs with its columns renamed by their place (c0, c1, ...): no name of theirs can clash."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def schema_of(docs: DataFrame, added: str = "") -> str:
    """The schema of by_place(docs), and columns added behind."""
    return ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)] + [added] * bool(added))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins (nulls are empty)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: int | str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about so many bytes of text, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        at = text_bytes(b.column(column))[1]
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Two primes below 2**31 and a base for each: the spans' polynomials are taken modulo both, so that two
#: different spans of n bytes agree by a share of (n / 2**31)**2 of all bases at most. (Modulo a power of two
#: there are spans that agree for every base.)
FIELDS = ((2147483647, 1318926965), (2147483629, 867530983))
_STEP = 1 << 22
_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 to base**n modulo the prime."""
    p = np.ones(n + 1, np.uint32)
    done = 1
    while done <= n:
        more = min(done, n + 1 - done)
        p[done : done + more] = p[:more].astype(np.uint64) * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += more
    return p


def powers(field: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the field's base, and their inverses. Kept for a slice; a longer text's are not."""
    if field in _kept and len(_kept[field][0]) > n:
        return _kept[field]
    prime, base = FIELDS[field]
    size = max(n, SLICE_BYTES)
    both = _powers(base, prime, size), _powers(pow(base, -1, prime), prime, size)
    if size == SLICE_BYTES:
        _kept[field] = both
    return both


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, from running sums over all bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    parts = []
    for field, (prime, _) in enumerate(FIELDS):
        p = np.uint64(prime)
        up, down = powers(field, len(data))
        run = np.zeros(len(data) + 1, np.uint64)
        for i in range(0, len(data), _STEP):  # a step's sum stays below 2**62
            j = min(i + _STEP, len(data))
            np.cumsum((data[i:j].astype(np.uint64) + np.uint64(1)) * up[i:j], out=run[i + 1 : j + 1])
            run[i + 1 : j + 1] += run[i] % p
        parts.append((run[ends] % p + p - run[starts] % p) % p * down[starts] % p)
    return mix((parts[0] << np.uint64(32) | parts[1]) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes other than space and U+0009 to U+000D."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~_SPACE[data]
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:] = ~ink[:-1]
    last[:-1] = ~ink[1:]
    edge = at[(at > 0) & (at < n)]
    first[edge] = True
    last[edge - 1] = True
    starts, ends = np.flatnonzero(ink & first), np.flatnonzero(ink & last) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)


#: Kinds of ASCII characters: letters, digits, marks, white space; 0 for all other bytes.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 4


def kind_cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each byte: at the start of a text, and between ASCII characters of different
    kinds, but not behind white space, nor behind an apostrophe (it may begin a contraction)."""
    kind = _KIND[data]
    cut = np.zeros(len(data), bool)
    before, now = kind[:-1], kind[1:]
    cut[1:] = (before != now) & (before > 0) & (now > 0) & (before != 4) & (data[:-1] != 39)
    cut[at[:-1][at[:-1] < len(data)]] = True
    return cut


def pieces_between(data: np.ndarray, starts: np.ndarray) -> pa.DictionaryArray:
    """The strings that begin at the starts (the first is 0) and reach to the next, as a dictionary."""
    ends = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()


class Kept:
    """Finished pieces of a worker, the longest unused ones dropped in two steps as memory fills."""

    def __init__(self, most: int):
        self.most, self.young, self.old, self.used = most, {}, {}, 0

    def get(self, key):
        if (found := self.young.get(key)) is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        self.young[key] = value
        self.used += 240 + 3 * len(key)
        if self.used > self.most // 2:
            self.old, self.young, self.used = self.young, {}, 0

    def clear(self) -> None:
        self.young, self.old, self.used = {}, {}, 0
