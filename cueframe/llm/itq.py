"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learnt on a bounded sample so that the signs of the rotated vectors lose little (iterative
quantisation); the signs are a 64-bit code. The cosine is an angle seen from the origin, so vectors are rotated as
they are: signs seen from their mean would tell apart vectors that lie close together beside it. The code is cut into substrings, one hash table for
each: close vectors agree in at least one of them. Large labels take longer substrings and, as these agree
less often, further tables of bits drawn anew, so that as many links are found as by the short ones. Members of a bucket are compared block against block
with their original vectors, so only vectors with the cosine asked for are linked, and a pair that met in
an earlier table is passed over. A task returns link counts and a spanning forest of its links, never the
pairs. Equal vectors are one representative throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components


@dataclass(frozen=True)
class ItqRule:
    """cosine: of a link. sample: rows that the rotation is learnt on, of least hash of their vector. lengths:
    vector lengths, the most frequent ones, whose rotation is learnt; others take random directions. rounds: of
    the rotation. bits: of a substring (8 tables of 8 bits; longer ones, in more tables, for a larger label).
    radius: bits of the code in which candidates may differ (at the cosine 0.98 about 4 of 64 do). block: rows of
    a block."""

    cosine: float = 0.98
    sample: int = 8192
    lengths: int = 64
    rounds: int = 40
    bits: int = 8
    radius: int = 20
    block: int = 1024


def learn_rotation(x: np.ndarray, bits: int = 64, rounds: int = 40, seed: int = 1) -> np.ndarray:
    """Projection (dimensions x bits) whose signs quantise the rows of x best."""
    dim = x.shape[1]
    rng = np.random.default_rng(seed)
    moment = x.T @ x / max(1, len(x)) + 1e-9 * np.eye(dim)
    _, axes = np.linalg.eigh(moment)
    axes = axes[:, ::-1][:, :bits]
    if axes.shape[1] < bits:  # fewer dimensions than bits: random directions for the rest
        extra = rng.standard_normal((dim, bits - axes.shape[1]))
        axes = np.concatenate([axes, extra / np.linalg.norm(extra, axis=0)], axis=1)
    v = x @ axes
    r = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(rounds if len(x) else 0):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(b.T @ v)
        r = (u @ w).T
    return axes @ r


def drawn_rotation(dim: int, bits: int = 64) -> np.ndarray:
    """Random directions, the same for every vector of this length."""
    return np.random.default_rng(dim).standard_normal((dim, bits))


def codes(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    signs = (x @ projection >= 0).astype(np.uint64)
    return (signs << np.arange(signs.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable() -> Column:
    """Whether a row may link: an id, a label, and a vector without null or non-finite parts and not zero."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x.isNotNull() & (x != 0))
    given = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
    return given & F.coalesce(~bad, F.lit(False)) & F.coalesce(some, F.lit(False))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that the links (a, b) connect it with."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            return root
        root = least


#: Share of signs that differ between vectors at the cosine 0.98, about.
_DIFFER = 0.064


def table_masks(bits: int) -> list[int]:
    """The bits of the code in each table, as 64-bit numbers. First the code cut into substrings, then draws
    of as many bits, until random codes that differ in _DIFFER of their signs miss each other no more often
    than by 8 tables of 8 bits."""
    masks = [((1 << bits) - 1) << (t * bits) for t in range(64 // bits)]
    rng = np.random.default_rng(bits)
    differ = rng.random((20_000, 64)) < _DIFFER
    apart = np.ones(len(differ), bool)
    for m in masks:
        apart &= differ[:, [k for k in range(64) if m >> k & 1]].any(axis=1)
    most = (1 - (1 - _DIFFER) ** 8) ** 8 * len(differ)
    while apart.sum() > most:
        at = rng.choice(64, bits, replace=False)
        masks.append(sum(1 << int(k) for k in at))
        apart &= differ[:, at].any(axis=1)
    return masks


def _bits(n: int, least: int) -> int:
    """Bits of a substring for a label of n vectors."""
    return max(least, min(16, int(np.log2(max(1, n))) - 12))


def _keys(masks: list[int]) -> Column:
    """The code's bits in each table."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.col("code").bitwiseAND(F.lit(m).cast("long")) for m in signed])


def _links(x: np.ndarray, code: np.ndarray, own: np.ndarray, i: int, j: int, earlier: np.ndarray, rule: ItqRule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the blocks i and j that are links, and have not met in an earlier table."""
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    out = [np.zeros((2, 0), np.int64)]
    step = max(1, (1 << 16) // max(1, len(right)))
    for s in range(0, len(left), step):
        a = left[s : s + step]
        unlike = code[a][:, None] ^ code[right][None, :]
        near = np.bitwise_count(unlike) <= rule.radius
        if i == j:
            near &= a[:, None] < right[None, :]
        p, q = np.nonzero(near)
        unlike, p, q = unlike[p, q], a[p], right[q]
        for mask in earlier:
            apart = unlike & mask != 0
            unlike, p, q = unlike[apart], p[apart], q[apart]
        linked = np.einsum("ij,ij->i", x[p], x[q]) >= rule.cosine
        out.append(np.stack([p[linked], q[linked]]))
    p, q = np.concatenate(out, axis=1)
    return p, q


def link(vectors: DataFrame, rule: ItqRule = ItqRule()) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Vectors of different lengths never link. Vectors that are null, zero or hold null or non-finite parts,
    and rows without a label, link with nothing and are kept; a null vec_id has a null component_id.
    Each row is a vector of its own, also where rows repeat or share a vec_id. Other columns are not read,
    whatever their names. An empty table gives an empty one.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    good = vectors.where(usable())
    # -0.0 as 0.0, so that equal vectors have one form
    good = good.withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0.0)))
    # the written table fixes the number of each class of equal vectors
    reps = stored(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("many")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    # only labels with longer substrings are collected: each holds 2**(bits + 13) vectors at least
    large = reps.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= 1 << (rule.bits + 13)).collect()
    dims = [r["d"] for r in reps.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(rule.lengths).collect()]
    longer = {r["label"]: b for r in large if (b := _bits(r["n"], rule.bits)) > rule.bits}
    masks = {b: table_masks(b) for b in {rule.bits, *longer.values()}}
    models = {}
    for d in dims:
        sample = reps.where(F.size("embedding") == d).orderBy(F.xxhash64("embedding"), "embedding").limit(rule.sample).select("embedding").toArrow().column(0).combine_chunks()
        models[d] = learn_rotation(_unit(sample), 64, rule.rounds)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            out = np.zeros(b.num_rows, np.uint64)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                out[at] = codes(_unit(b.column(2).take(pa.array(at))), models[d] if d in models else drawn_rotation(d))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(out.view(np.int64))], names=["rep", "many", "embedding", "label", "code"])

    label_type = reps.schema["label"].dataType.simpleString()
    coded = stored(reps.select("rep", "many", "embedding", "label").mapInArrow(code, f"rep bigint, many bigint, embedding array<double>, label {label_type}, code bigint"), "codes")
    bits = F.lit(rule.bits)
    part = _keys(masks[rule.bits])
    for b in sorted(set(longer.values())):
        these = F.col("label").isin([x for x, n in longer.items() if n == b])
        part, bits = F.when(these, _keys(masks[b])).otherwise(part), F.when(these, b).otherwise(bits)
    bucket = ["label", "d", "t", "key"]
    keyed = coded.select("label", F.size("embedding").alias("d"), "rep", F.posexplode(part).alias("t", "key"))
    sizes = keyed.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / rule.block).cast("int")).drop("n")
    # each row is in one block of its bucket, and goes to every pair of blocks that holds it
    placed = keyed.join(sizes, bucket).withColumn("own", F.pmod(F.xxhash64("rep", "t"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = other.select(*bucket, "rep", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    pair = F.xxhash64(*bucket, "i", "j")
    rows = dealt.join(coded.select("rep", "label", "embedding", "many", "code", F.size("embedding").alias("d")), ["rep", "label", "d"])
    rows = rows.select(pair.alias("pair"), F.struct(*bucket, "i", "j").alias("at"), bits.alias("bits"), "own", "rep", "many", "code", "embedding").repartition("pair").sortWithinPartitions("pair", "at")

    def compare(run: pa.Table) -> pa.RecordBatch:
        at, bits = run.column("at")[0].as_py(), run.column("bits")[0].as_py()
        x = _unit(run.column("embedding").combine_chunks())
        rep, many, own, code = (run.column(n).to_numpy() for n in ("rep", "many", "own", "code"))
        earlier = np.array(masks[bits][: at["t"]], np.uint64)
        p, q = _links(x, code.view(np.uint64), own, at["i"], at["j"], earlier, rule)
        n = np.zeros(len(rep), np.int64)
        np.add.at(n, p, many[q])
        np.add.at(n, q, many[p])
        hit = n > 0
        return pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in (rep, n, rep[_forest(len(rep), p, q)])], names=["rep", "n", "root"])

    def compare_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of rows of one pair of blocks, which may reach over batches."""
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            key = t.column("pair").to_numpy()
            ends = [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
            for i, j in zip([0, *ends[:-1]], ends, strict=False):
                yield from runs_of(t.slice(i, j - i))
            rest = t.slice(ends[-1]) if ends else t
        if rest is not None and rest.num_rows:
            yield from runs_of(rest)

    def runs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Where two pairs of blocks share a hash, they are told by their place."""
        places = t.column("at").to_pylist()
        cuts = [0, *[k for k in range(1, len(places)) if places[k] != places[k - 1]], len(places)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if j - i > 1:
                yield compare(t.slice(i, j - i))

    found = stored(rows.mapInArrow(compare_all, "rep bigint, n bigint, root bigint"), "found")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    # a component's name is the smallest vec_id of its vectors
    named = named.join(reps.select(F.col("rep").alias("node"), "least"), "node")
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    named = named.join(names, "component").select("node", "name")
    of_rep = reps.join(counts, "rep", "left").join(named, reps["rep"] == named["node"], "left")
    of_rep = of_rep.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("name", "least").alias("component_id"))
    linked = good.join(of_rep, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = vectors.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x,
        label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0 AS good
    FROM embeddings
), pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    WHERE a.good AND b.good AND list_cosine_similarity(a.x, b.x) >= 0.98
), reach AS (
    SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
    vec_id = least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS kept
FROM v
"""
