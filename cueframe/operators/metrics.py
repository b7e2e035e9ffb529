"""Scores of machine timing against a reviewed reference."""

from __future__ import annotations

import os
from bisect import bisect_left
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import round3


#: Parts between anchors that one call of a helper matches.
PARTS_AT_ONCE = 32
#: Sizes of the pieces by which common blocks are found, the last one a character.
PIECES = (32, 8, 3, 1)
#: Buckets of a histogram by which a rank is narrowed down.
BUCKETS = 4096


def nearest_ranks(values: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The nearest-rank quantile of each key: rows of (keys, x, share), the same share for all rows of a key; returns
    keys, value.

    Two histograms between the least and the greatest value narrow the rank down to the values of one bucket of a
    bucket, and these are counted by value. So no task holds the values of a key: only buckets, and at last distinct
    values, stand in order. Without a finite least and greatest value there is one bucket."""
    lo, hi, w = F.col("_lo"), F.col("_hi"), Window.partitionBy(*keys)
    state = values.groupBy(*keys).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.greatest(F.lit(1), F.ceil(F.count("x") * F.max("share"))).cast("long").alias("_rank"))
    near = values.select(*keys, "x").where(F.col("x").isNotNull())

    def chosen(counts: DataFrame, order: str) -> DataFrame:
        """The first group of each key with which the rank is reached, and the rank within it."""
        upto = F.sum("_n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        reached = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
        return reached.withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_n"))

    def inside(state: DataFrame) -> DataFrame:
        own = state.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_lo", "_hi", "_rank")
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        return near.join(own, [*same, F.col("x").between(lo, hi)]).drop(*[f"_k{i}" for i in range(len(keys))])

    for _ in range(2):
        width = (hi - lo) / buckets
        bucket = F.when((width > 0) & (width < float("inf")), F.least(F.lit(buckets - 1), F.floor((F.col("x") - lo) / width))).otherwise(0)
        found = inside(state).groupBy(*keys, bucket.alias("_b")).agg(F.count("*").alias("_n"), F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.first("_rank").alias("_rank"))
        state = chosen(found, "_b")
    counted = inside(state).groupBy(*keys, "x").agg(F.count("*").alias("_n"), F.first("_rank").alias("_rank"))
    return chosen(counted, "x").select(*keys, F.col("x").alias("value"))


def error_stats(errors: DataFrame, keys: list[str], error: str) -> DataFrame:
    """A1: count, nearest-rank median and p90 of the absolute error, maximum, signed median."""
    known = errors.where(F.col(error).isNotNull())
    shares = {"median": (F.abs(error), 0.5), "p90": (F.abs(error), 0.9), "signed_median": (F.col(error), 0.5)}
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), x.cast("double").alias("x"), F.lit(p).alias("share")) for n, (x, p) in shares.items()]))
    ranks = nearest_ranks(known.select(*keys, wanted.alias("_w")).select(*keys, "_w.*"), [*keys, "measure"])
    named = ranks.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == n, F.col("value"))).alias(n) for n in shares])
    counts = known.groupBy(*keys).agg(F.count("*").alias("count"), round3(F.max(F.abs(error))).alias("maximum"))
    own = named.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *shares)
    out = counts.join(own, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return out.select(*keys, "count", *[round3(F.col(c)).alias(c) for c in ("median", "p90")], "maximum", round3(F.col("signed_median")).alias("signed_median"))


def timing_metrics(pairs: DataFrame, events: DataFrame, keys: list[str], frame_rate: float | None = None) -> DataFrame:
    """A2: pairs (keys, n_hyp, n_ref, start_error, end_error) and event counts (keys, hypothesis, reference): coverage,
    splits, merges and buckets of the start error; pairs below a frame are left out if a rate is given."""
    small = F.abs("start_error") < 1.0 / frame_rate if frame_rate else F.lit(False)
    at = F.abs("start_error")
    sums = pairs.groupBy(*keys).agg(
        F.sum("n_hyp").alias("_matched"),
        F.count_if(~small).alias("matched_pairs"),
        F.count_if(~small & (F.col("n_hyp") == 1) & (F.col("n_ref") > 1)).alias("split_pairs"),
        F.count_if(~small & (F.col("n_hyp") > 1) & (F.col("n_ref") == 1)).alias("merge_pairs"),
        F.count_if(~small & (at <= 0.20)).alias("near"),
        F.count_if(~small & (at > 0.20) & (at <= 0.75)).alias("middle"),
        F.count_if(~small & (at > 0.75)).alias("far"),
    )
    counts = ["_matched", "matched_pairs", "split_pairs", "merge_pairs", "near", "middle", "far"]
    out = events.join(sums, keys, "left").na.fill(0, counts)
    return out.withColumn("coverage", F.when(F.col("hypothesis") > 0, F.col("_matched") / F.col("hypothesis")).otherwise(0.0)).drop("_matched")


def coverage_by_threshold(pairs: DataFrame, keys: list[str], limits: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A3: share of pairs whose start and end error stay within each limit."""
    aggs = [F.avg((F.abs(f"{e}_error") <= t).cast("int")).alias(f"{e}_{int(t * 100)}") for e in ("start", "end") for t in limits]
    return pairs.groupBy(*keys).agg(*aggs)


def _increasing(a: list[int], b: list[int]) -> list[int]:
    """Places of a longest chain in which b rises, where a does."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(b)
    for i in sorted(range(len(a)), key=lambda i: a[i]):
        k = bisect_left(ends, b[i])
        ends[k : k + 1], last[k : k + 1] = [b[i]], [i]
        before[i] = last[k - 1] if k else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def anchors(hypothesis: DataFrame, reference: DataFrame, key: str, least: int) -> DataFrame:
    """(key, h, r): cues (key, n, text) with a text of at least so many characters that stands once on either side, of
    these a longest chain that goes forward on both. Only numbers of cues meet in one task by key."""
    once = [d.where(F.length("text") >= least).groupBy(key, "text").agg(F.min("n").alias(n), F.count("*").alias("_c")).where("_c = 1").drop("_c") for d, n in ((hypothesis, "h"), (reference, "r"))]
    pairs = once[0].join(once[1], [key, "text"]).select(key, "h", "r")

    def chain(pairs: pd.DataFrame) -> pd.DataFrame:
        return pairs.iloc[_increasing(pairs["h"].tolist(), pairs["r"].tolist())]

    return pairs.groupBy(key).applyInPandas(chain, pairs.schema)


def _between(rows: DataFrame, chain: DataFrame, key: str, side: str) -> DataFrame:
    """rows (key, n, ...) with their part, the number of anchors before them, and whether they are one."""
    own = rows.join(chain.select(key, F.col(side).alias("n"), F.lit(1).alias("_a")), [key, "n"], "left")
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return own.withColumn("part", F.coalesce(F.sum("_a").over(w), F.lit(0)))


def _matching(a: str, b: str) -> list[tuple[int, int, int]]:
    """The matching blocks of difflib, neighbours apart. A longest block of `size` characters or more is a longest run of
    pieces of that size, which begins at the same place, so long blocks are found by pieces that come seldom; a part that
    holds none is searched by shorter pieces."""
    by_size: dict[int, SequenceMatcher] = {}
    found, todo = [], [(0, len(a), 0, len(b), 0)]
    while todo:
        i, j, k, l, level = todo.pop()
        for step in range(level, len(PIECES)):
            size = PIECES[step]
            if min(j - i, l - k) < size:
                continue
            if size not in by_size:
                by_size[size] = SequenceMatcher(None, *([t[x : x + size] for x in range(len(t) - size + 1)] for t in (a, b)), autojunk=False)
            x, y, run = by_size[size].find_longest_match(i, j - size + 1, k, l - size + 1)
            if run:
                run += size - 1
                found.append((x, y, run))
                todo += [(i, x, k, y, step), (x + run, j, y + run, l, step)]
                break
    return sorted(found)


def _blocks(a: str, b: str, opens: bool, closes: bool) -> list[tuple[int, int, int]]:
    """Matching blocks of two parts. Beside an anchor the block that holds it goes on as far as both agree."""
    n = len(os.path.commonprefix([a, b])) if opens else 0
    a, b = a[n:], b[n:]
    m = len(os.path.commonprefix([a[::-1], b[::-1]])) if closes else 0
    inner = _matching(a[: len(a) - m], b[: len(b) - m])
    return [(0, 0, n), *((x + n, y + n, size) for x, y, size in inner), (n + len(a) - m, n + len(b) - m, m)]


def char_links(hypothesis: DataFrame, reference: DataFrame, key: str, least: float = 0.3, anchor: int = 8) -> DataFrame:
    """A4: (key, h, r, shared) of cues (key, pos, text) whose texts share matching blocks of the concatenated N2 texts,
    by at least `least` of the shorter one.

    Equal cues that stand once on either side are anchors: a longest chain of them cuts a section into parts, which
    are matched each for itself, in tasks of their own. The blocks are those of the whole section wherever its own
    blocks hold the anchors. anchor: characters that an anchor has at least; 0: none are used."""
    sides = []
    for d in (hypothesis, reference):
        flat = d.select(key, "pos", T.norm_match(F.coalesce(F.col("text"), F.lit(""))).alias("text")).where("text <> ''")
        sides.append(flat.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pos")).cast("long")))
    kind = sides[0].schema[key].dataType.simpleString()
    chain = anchors(*sides, key, anchor) if anchor else sides[0].where(F.lit(False)).select(key, F.col("n").alias("h"), F.col("n").alias("r"))
    last = chain.groupBy(key).agg(F.count("*").alias("_last"))
    h, r = (_between(d, chain, key, side) for d, side in zip(sides, ("h", "r"), strict=True))
    fixed = h.where("_a = 1").select(key, "part", F.col("pos").alias("h"), F.length("text").cast("long").alias("shared"))
    fixed = fixed.join(r.where("_a = 1").select(key, "part", F.col("pos").alias("r")), [key, "part"]).select(key, "h", "r", "shared")
    # under names of their own, so that sides of one table cannot be mixed up; several parts go to a helper at once
    lot = F.floor(F.col("part") / PARTS_AT_ONCE).alias("_lot")
    rest = [d.where("_a IS NULL").join(last, key, "left").select(F.col(key).alias("_key"), lot, F.col("part").alias("_part"), F.col("pos").alias("_pos"), "text", (F.col("part") < F.coalesce("_last", F.lit(0))).alias("closes")) for d in (h, r)]

    def blocks(h: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        rows, both = [], [dict(list(side.sort_values("_pos").groupby("_part"))) for side in (h, r)]
        for part in sorted(both[0].keys() & both[1].keys()):
            (a, own_a, len_a), (b, own_b, len_b) = [("".join(d["text"]), [p for p, t in zip(d["_pos"], d["text"], strict=True) for _ in t], dict(zip(d["_pos"], d["text"].str.len(), strict=True))) for d in (side[part] for side in both)]
            shared: dict[tuple[int, int], int] = {}
            for x, y, size in _blocks(a, b, part > 0, bool(both[0][part]["closes"].iloc[0])):
                for i in range(size):
                    pair = own_a[x + i], own_b[y + i]
                    shared[pair] = shared.get(pair, 0) + 1
            rows += [(h["_key"].iloc[0], x, y, n) for (x, y), n in shared.items() if n >= least * min(len_a[x], len_b[y])]
        return pd.DataFrame(rows, columns=[key, "h", "r", "shared"])

    parts = rest[0].groupBy("_key", "_lot").cogroup(rest[1].groupBy("_key", "_lot")).applyInPandas(blocks, f"{key} {kind}, h bigint, r bigint, shared bigint")
    return fixed.unionByName(parts)


def alignment_groups(links: DataFrame, hypothesis: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """A5: groups of linked cues, their relation and timing errors. Blocks match in order, so links never
    cross: sorted, a group ends where both sides move on."""
    w = Window.partitionBy(key).orderBy("h", "r")
    new = (F.col("h") != F.lag("h").over(w)) & (F.col("r") != F.lag("r").over(w))
    island = links.withColumn("_new", F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).withColumn("g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = island.groupBy(key, "g").agg(F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.countDistinct("h").alias("n_hyp"), F.countDistinct("r").alias("n_ref"))
    at = lambda d, pos, what, name: d.select(key, F.col("pos").alias(pos), F.col(what).alias(name))
    j = g.join(at(hypothesis, "h0", "start", "hs"), [key, "h0"]).join(at(hypothesis, "h1", "end", "he"), [key, "h1"]).join(at(reference, "r0", "start", "rs"), [key, "r0"]).join(at(reference, "r1", "end", "re"), [key, "r1"])
    side = lambda c: F.when(F.col(c) == 1, "1").otherwise("N")
    return j.select(key, "h0", "h1", "r0", "r1", "n_hyp", "n_ref", F.concat(side("n_hyp"), F.lit(":"), side("n_ref")).alias("relation"), round3(F.col("hs") - F.col("rs")).alias("start_error"), round3(F.col("he") - F.col("re")).alias("end_error"))


def unmatched(cues: DataFrame, links: DataFrame, key: str, side: str) -> DataFrame:
    """A5: cues without a link; side: h or r."""
    return cues.join(links.select(key, F.col(side).alias("pos")).distinct(), [key, "pos"], "left_anti")


def benchmark_report(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Cue errors (keys, pos, start_error, review) before and after a propagation: how many were
    moved, made worse, and need less review."""
    b = before.select(*keys, "pos", F.col("start_error").alias("_b"), F.col("review").alias("_rb"))
    j = b.join(after, [*keys, "pos"])
    moved = F.col("start_error") != F.col("_b")
    worse = F.abs("start_error") > F.abs("_b") + 0.001
    out = j.groupBy(*keys).agg(F.count("*").alias("cues"), F.count_if(moved).alias("propagated"), F.count_if(moved & worse).alias("worsened"), F.count_if("_rb").alias("review_before"), F.count_if("review").alias("review_after"))
    return out.withColumn("review_reduction", F.when(F.col("review_before") > 0, 1 - F.col("review_after") / F.col("review_before")).otherwise(0.0))
