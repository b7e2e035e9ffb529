"""Near-duplicates by b-bit MinHash.

Each text becomes its set of hashed word shingles, 384 minima, 32 band keys of four minima each, and a
signature of the minima's four low bits packed into 24 longs. Texts with equal sets are one class, and
only its smallest id goes on. Members of a band bucket are compared with two of its members, chosen by
hash. Where a bucket then still holds several components, members outside its largest one are compared with
all members of other components: the signatures are compared inside that join, so no list of all pairs of a
group is made. A pair is kept for the exact comparison if the similarity that the signatures' bit counts
tell, corrected for the low bits that agree by chance, may reach the threshold.
The exact comparison takes the full shingle sets; before it, inside the same join, a second small sketch
of the whole set drops pairs that cannot pass it: each shingle flips one of 2048 bits, so two sketches
differ in no more bits than the sets differ in shingles, and this bound loses no link. For texts up to some
thousand words it is nearly the exact difference, so a group of texts that are just too far apart leaves no
candidates. Components come from distributed stars.

Two texts with similarity 0.75 share no band with probability 6e-6, and are lost by the signature (a bound
four standard errors low) with 3e-5; more similar ones far more rarely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, forget, mix, slices, span_hashes, stored, text_bytes, words
from .graph import components

HASHES, BITS = 384, 4
BANDS, ROWS = 32, 4
_draw = np.random.default_rng(20240607)
_A = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_TERMS = _draw.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = 0x1111111111111111
_CHANCE = 2.0**-BITS
#: Standard errors that an estimate may lie below the threshold.
SIGMAS = 4
#: Bits that the shingles of a set flip.
FLIPS = 2048
#: Members of a hot bucket that one task compares with its hubs or with members of other components.
SPLIT = 256
#: Members of a bucket that all others of it are compared with first.
HUBS = 2
#: Document ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class NearRule:
    shingle: int = 5
    percent: int = 75  # 100 * intersection >= percent * union


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, of words with A-Z lower-cased."""
    data, at = text_bytes(texts)
    data = ascii_lower(data)
    start, end, row = words(data, at)
    h = span_hashes(data, start, end)
    n = len(h)
    out, empty = [np.zeros(0, np.uint64)] * len(texts), np.zeros(0, np.uint64)
    if not n:
        return out
    full = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        full += h[j : n - k + 1 + j] * _TERMS[j] if len(full) else empty
    full = mix(full)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= k:
            out[i] = np.unique(full[a : b - k + 1])
        elif b > a:
            out[i] = mix(np.array([(h[a:b] * _TERMS[8 : 8 + b - a]).sum(dtype=np.uint64) ^ np.uint64(b - a)], np.uint64))
    return out


def minima(s: np.ndarray) -> np.ndarray:
    m = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(m, (s[i : i + 512, None] * _A + _B).min(axis=0), out=m)
    return mix(m)


def flipped(s: np.ndarray) -> np.ndarray:
    """The bits that the set's shingles flip an odd number of times, as longs."""
    at = (mix(s ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - FLIPS.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=FLIPS).astype(np.uint8) & 1).view(np.uint64)


def signatures(docs: DataFrame, rule: NearRule) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (together the set's name), sig (24 longs), bands, flips (32 longs)."""
    band_no = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shifts = (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            sets = shingle_sets(b.column(1), rule.shingle)
            name = np.zeros((len(sets), 2), np.uint64)
            m = np.zeros((len(sets), HASHES), np.uint64)
            flips = np.zeros((len(sets), FLIPS // 64), np.uint64)
            for i, s in enumerate(sets):
                if len(s):
                    name[i] = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
                    m[i] = minima(s)
                    flips[i] = flipped(s)
            packed = ((m & np.uint64((1 << BITS) - 1)).reshape(len(m), -1, 64 // BITS) << shifts).sum(axis=2, dtype=np.uint64)
            r = m[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
            keys = mix(r[:, :, 0] * _TERMS[16] + r[:, :, 1] * _TERMS[17] + r[:, :, 2] * _TERMS[18] + r[:, :, 3] * _TERMS[19] + band_no)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1).view(np.int64))) for x in (packed, np.ascontiguousarray(keys), flips)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.ascontiguousarray(name[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(name[:, 1]).view(np.int64)), *lists], names=["doc_id", "n_shingles", "k1", "k2", "sig", "bands", "flips"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(run, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, sig array<bigint>, bands array<bigint>, flips array<bigint>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the share of minima whose low bits agree, less what agrees by chance."""
    unlike = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        for shift in (1, 2):  # any bit of four that differs
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        unlike = unlike + F.bit_count(x.bitwiseAND(F.lit(_LOW)))
    return ((F.lit(1.0) - unlike / F.lit(float(HASHES))) - _CHANCE) / (1 - _CHANCE)


def _flips_allow(rule: NearRule, x: str, y: str) -> Column:
    """Whether the flipped bits leave the threshold possible: by the bound, and by four standard errors of
    the bits that so many differing shingles flip."""
    apart = F.lit(0)
    for i in range(FLIPS // 64):
        apart = apart + F.bit_count(F.col(f"f{x}")[i].bitwiseXOR(F.col(f"f{y}")[i]))
    most = (F.col(f"n{x}") + F.col(f"n{y}")) * ((100 - rule.percent) / (100 + rule.percent))
    expected = FLIPS / 2 * (1 - F.exp(-2 / FLIPS * most))
    error = F.sqrt(FLIPS / 4 * (1 - F.exp(-4 / FLIPS * most)))
    return apart <= F.least(most + 1e-6, expected + SIGMAS * error)


def _may_link(rule: NearRule, x: str, y: str) -> Column:
    """Whether sizes, signatures and flipped bits leave a similarity of the threshold possible."""
    t = rule.percent / 100
    agree = _CHANCE + (1 - _CHANCE) * t
    least = t - SIGMAS * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - _CHANCE)
    sizes = F.least(f"n{x}", f"n{y}") * 100 >= F.greatest(f"n{x}", f"n{y}") * rule.percent
    return sizes & (estimate(F.col(f"s{x}"), F.col(f"s{y}")) >= least) & _flips_allow(rule, x, y)


def _as(x: str) -> list[Column]:
    """A text's id, signature, size and flips as one side of a pair."""
    return [F.col("b").alias(x), F.col("sig").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"), F.col("flips").alias(f"f{x}")]


def _split(n: Column) -> Column:
    return F.ceil(n / SPLIT).cast("int")


def _confirmed(pairs: DataFrame, docs: DataFrame, rule: NearRule) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough. pairs is stored, and deleted after. The ids wanted go to
    the texts as a broadcast while they are few, else both are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            sets = shingle_sets(b.column(1), rule.shingle)
            cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], names=["id", "shingles"])

    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    ids = F.broadcast(ids) if 2 * pairs.count() <= BROADCAST_IDS else ids.hint("merge")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).join(ids, "doc_id", "left_semi")
    sets = stored(texts.mapInArrow(run, "id bigint, shingles array<bigint>"), "sets")
    a, b = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"_{x}")) for x in "ab")
    both = F.size(F.array_intersect("_a", "_b"))
    # of a pair both sets travel; merged, so that growth does not change the plan
    passed = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(both * 100 >= (F.size("_a") + F.size("_b") - both) * rule.percent).select("a", "b")
    out = stored(passed, "confirmed")
    forget(sets, pairs)
    return out


def near_duplicates(docs: DataFrame, rule: NearRule = NearRule()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text). Other columns are not read,
    whatever their names.

    Texts with fewer words than a shingle are one shingle; null texts and texts without words have none
    and link with nothing. Rows that share a doc_id are one node. Rows with a null doc_id link with
    nothing, have a null component_id and are kept. An empty table gives an empty one.
    """
    sigs = stored(signatures(docs, rule), "signatures")
    usable = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("a"))
    reps = stored(usable.join(classes.select(F.col("a").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi"), "classes")
    buckets = reps.select(F.col("doc_id").alias("b"), F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("b").alias("_x"), F.max("b").alias("_y"), F.count("*").alias("n")).where("_x <> _y").select("band", _split(F.col("n")).alias("splits"))
    # a hot bucket is dealt to several tasks, each with the hubs
    dealt = buckets.join(shared, "band").select("band", "b", "splits", F.pmod(F.xxhash64("b"), F.col("splits")).cast("int").alias("part"))
    members = stored(dealt, "buckets")
    hubs = members.groupBy("band").agg(F.max("splits").alias("splits"), F.array_distinct(F.array(*[F.min_by("b", F.xxhash64("b", F.lit(i))) for i in range(HUBS)])).alias("hubs"))
    hubs = hubs.select("band", "splits", F.explode("hubs").alias("b")).select("band", "b", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("part"))
    signed = reps.select(F.col("doc_id").alias("b"), "sig", "n_shingles", "flips")
    asked = hubs.join(signed, "b").select("band", "part", *_as("x"))
    each = members.join(signed, "b").select("band", "part", *_as("y"))
    meet = (asked["band"] == each["band"]) & (asked["part"] == each["part"]) & (F.col("x") != F.col("y"))
    few = asked.join(each, meet & _may_link(rule, "x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = _confirmed(stored(few, "likely"), docs, rule)
    # nodes whose component is not found to the end only have a bucket searched that need not be
    found = stored(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), 2), "components")

    named = members.join(found, members["b"] == found["node"], "left").select("band", "b", F.coalesce("component", "b").alias("c"))
    split = named.groupBy("band").agg(F.min("c").alias("_x"), F.max("c").alias("_y")).where("_x <> _y").select("band")
    rows = stored(named.join(split, "band", "left_semi"), "open")
    forget(members)
    sizes = rows.groupBy("band", "c").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band").agg(F.max_by("c", F.struct("n", "c")).alias("main"), _split(F.sum("n") - F.max("n")).alias("splits"))
    left = rows.join(reps.select(F.col("doc_id").alias("b"), "sig", "n_shingles", "flips", "bands"), "b").join(main, "band")
    side = F.pmod(F.xxhash64("b"), F.col("splits")).cast("int")
    outside = left.where("c <> main").select("band", "main", side.alias("part"), F.col("c").alias("cx"), F.col("bands").alias("bx"), *_as("x"))
    inside = left.select("band", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("part"), F.col("c").alias("cy"), F.col("bands").alias("by"), *_as("y"))
    # of two outside members, the smaller id asks
    ask = (outside["band"] == inside["band"]) & (outside["part"] == inside["part"]) & (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") < F.col("y")))
    # every bucket that such a pair shares is open: it is taken in the first one
    shares = F.filter(F.zip_with("bx", "by", lambda p, q: F.when(p == q, p)), lambda v: v.isNotNull())
    rest = outside.join(inside, ask & _may_link(rule, "x", "y") & (F.get(shares, F.lit(0)) == outside["band"])).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    last = _confirmed(stored(rest, "likely"), docs, rule)
    forget(rows, found)
    found = components(links.unionByName(last).select(F.col("a").alias("u"), F.col("b").alias("v")))

    ends = classes.join(found, classes["a"] == found["node"], "left").select("k1", "k2", F.coalesce("component", "a").alias("_c"))
    single = sigs.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = usable.select("doc_id", "n_shingles", "k1", "k2").join(ends, ["k1", "k2"]).select("doc_id", "n_shingles", F.col("_c").alias("component_id"))
    return linked.unionByName(single).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: Whole sets as lists of texts; documents with equal sets are one class, as above.
SQL = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), words AS (
    SELECT doc_id, len(ws) AS n, unnest(ws) AS t, generate_subscripts(ws, 1) AS i FROM texts
), runs AS (
    SELECT doc_id, n, i, concat_ws(' ', t, lead(t, 1) OVER d, lead(t, 2) OVER d, lead(t, 3) OVER d, lead(t, 4) OVER d) AS x FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), sets AS (
    SELECT doc_id, list_sort(list(DISTINCT x)) AS s FROM runs WHERE i <= greatest(1, n - 4) GROUP BY doc_id
    UNION ALL SELECT doc_id, [] FROM texts WHERE len(ws) = 0
), classes AS (
    SELECT s, len(s) AS n, min(doc_id) AS a FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s
), shingles AS (
    SELECT a, n, unnest(s) AS x FROM classes
), common AS (
    SELECT l.a AS a, r.a AS b, l.n AS n, r.n AS m, count(*) AS shared FROM shingles l JOIN shingles r ON l.x = r.x AND l.a < r.a AND 100 * least(l.n, r.n) >= 75 * greatest(l.n, r.n) GROUP BY ALL
), links AS (
    SELECT a, b FROM common WHERE 100 * shared >= 75 * (n + m - shared)
), ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a
), ends AS (
    SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a
)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(ends.c, classes.a, doc_id) AS component_id, doc_id IS NOT DISTINCT FROM coalesce(ends.c, classes.a, doc_id) AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s AND doc_id IS NOT NULL LEFT JOIN ends ON classes.a = ends.a
"""
