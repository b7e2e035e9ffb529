"""Repeated blocks of lyrics within a section."""

from __future__ import annotations

import bisect
import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Places of cues that a range of places is looked up by.
PLACES = 64


@dataclass(frozen=True)
class RepetitionPolicy:
    min_block_events: int = 2
    max_group_duration_drift: float = 0.12
    structure_gap_seconds: float = 3.0
    padding_seconds: float = 3.0
    max_clip_seconds: float = 180.0

    @property
    def core_seconds(self) -> float:
        return self.max_clip_seconds - 2 * self.padding_seconds


def risk_codes(cues: DataFrame) -> DataFrame:
    """Adds the sorted risk codes of each cue, from its role, its variant text and its evidence."""
    e = F.transform(F.coalesce("evidence", F.array().cast("array<string>")), F.lower)
    says = lambda *ws: F.exists(e, lambda x: x.rlike("|".join(ws)))
    role = F.coalesce("role", F.lit("lyric"))
    variant = F.col("canonical_source_text").isNotNull() & (T.norm_match(F.col("canonical_source_text")) != T.norm_match(F.coalesce("source_text", F.lit(""))))
    codes = F.array(
        F.when(role == "speech", "speech").when(role == "lyric_adlib", "lyric_adlib").when(role != "lyric", "non_lyric_role"),
        F.when(variant, "live_lyric_variant"), F.when(says("audience", "crowd"), "audience_singing"), F.when(says("omitted", "missing"), "omitted_lyric"),
    )
    return cues.withColumn("risk_codes", F.array_sort(F.array_compact(codes)))


def longest_block(tokens: list[str | None], least: int) -> tuple[int, list[int]] | None:
    """Length and starts of the best block that stands at least twice without overlap: the longest, then the most
    often, then the one with the most characters, then the first.

    A block of some length holds one of each shorter length, so the longest is found by bisection; each step
    sorts the places of that length by a hash of their texts."""
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(t, len(number) + 1) if t else 0 for t in tokens], np.int64)
    breaks = np.concatenate([[0], np.cumsum(ids == 0)])
    many = len(ids) + 1
    # names of blocks of 1, 2, 4, ... lines: equal names, equal texts; a block is named by two that cover it
    names = [ids]
    while (w := 1 << len(names) - 1) * 2 <= len(ids):
        names.append(np.unique(names[-1][:-w] * many + names[-1][w:], return_inverse=True)[1])

    def groups(size: int) -> list[np.ndarray]:
        """The starts of each text of this length that stands twice or more without overlap, from the left."""
        k = size.bit_length() - 1
        whole = np.flatnonzero(breaks[size:] == breaks[:-size])
        of = np.unique(names[k][whole] * many + names[k][whole + size - (1 << k)], return_inverse=True)[1]
        again = np.bincount(of)[of] > 1
        whole, of = whole[again], of[again]
        order = np.argsort(of, kind="stable")
        out = []
        for starts in np.split(whole[order], np.flatnonzero(np.diff(of[order])) + 1):
            if len(starts) > 1 and starts[-1] - starts[0] >= size:
                apart = [int(starts[0])]
                while (n := np.searchsorted(starts, apart[-1] + size)) < len(starts):
                    apart.append(int(starts[n]))
                out.append(np.array(apart))
        return out

    low, high = least - 1, len(ids) // 2  # a block of `low` lines is known (or nothing), none above `high`
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if groups(middle) else (low, middle - 1)
    if low < least:
        return None
    best = max(groups(low), key=lambda g: (len(g), sum(len(t) for t in tokens[g[0] : g[0] + low]), -g[0]))
    return low, best.tolist()


def repetition_groups(cues: DataFrame, policy: RepetitionPolicy = RepetitionPolicy(), known: DataFrame | None = None) -> DataFrame:
    """Occurrences (section_id, occurrence, first, last) of each section's longest repeated block of lyric
    texts. cues: section_id, pos, role, source_text, canonical_source_text. known (section_id, line, text): the lyric;
    only texts that are one or more of its lines in a row may be part of a block, others break it, as speech does."""
    token = F.when(F.coalesce("role", F.lit("lyric")) == "lyric", T.norm_match(F.coalesce("canonical_source_text", "source_text", F.lit(""))))
    flat = cues.select("section_id", "pos", token.alias("token"))
    kind = cues.schema["section_id"].dataType.simpleString()
    # a text that comes once can only break blocks: sections without a repeated text need no search. Empty texts are
    # left out behind the grouping, as a filter on normalised texts would normalise them once more
    rows = _in_rows(flat, "pos", "token").select("section_id", "cues.pos", "cues.token")
    sung = F.filter("token", lambda x: x != "")
    rows = rows.where(F.size(sung) > F.size(F.array_distinct(sung)))
    if known is not None:
        text = T.norm_match(F.coalesce("text", F.lit("")))
        lyric = _in_rows(known.select("section_id", "line", text.alias("t")), "line", "t")
        rows = rows.join(lyric.select("section_id", F.filter("cues.t", lambda x: x != "").alias("lines")), "section_id")

    def search(batches):
        for b in batches:
            out = []
            for section, pos, tokens, *lyric in b.itertuples(index=False):
                if lyric:
                    runs = known_runs(list(lyric[0]), {t for t in tokens if t})
                    tokens = [t if t in runs else None for t in tokens]
                found = longest_block(list(tokens), policy.min_block_events)
                out += [(section, k + 1, pos[s], pos[s + found[0] - 1]) for k, s in enumerate(found[1])] if found else []
            yield pd.DataFrame(out, columns=["section_id", "occurrence", "first", "last"])

    return rows.mapInPandas(search, f"section_id {kind}, occurrence int, first bigint, last bigint")


def known_runs(lines: list[str], texts: set[str]) -> set[str]:
    """The texts that are one or more of the lines in a row. From each line, only ends that are as far away as some text
    is long are looked at."""
    joined, ends, sizes = "".join(lines), [0, *itertools.accumulate(map(len, lines))], {len(t) for t in texts}
    at, most, out = set(ends), max(sizes, default=0), set()
    for i, e in enumerate(ends[:-1]):
        upto = bisect.bisect_right(ends, e + most, i + 1)
        if len(sizes) < upto - i:
            far = [n for n in sizes if e + n in at]
        else:
            far = [x - e for x in ends[i + 1 : upto] if x - e in sizes]
        out.update(joined[e : e + n] for n in far)
    return out & texts


def occurrence_stats(cues: DataFrame, occurrences: DataFrame, policy: RepetitionPolicy = RepetitionPolicy()) -> DataFrame:
    """A10: times and risks of each occurrence, and the group's median duration, drift and stability."""
    j = risk_codes(cues).join(occurrences.withColumnRenamed("section_id", "_s"), (F.col("section_id") == F.col("_s")) & F.col("pos").between(F.col("first"), F.col("last")))
    per = j.groupBy("section_id", "occurrence").agg(F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("risk_codes")))).alias("risks"))
    per = per.withColumn("duration", F.col("end") - F.col("start"))
    median = per.groupBy("section_id").agg(F.percentile("duration", F.lit(0.5)).alias("median"))
    out = per.join(median, "section_id").withColumn("drift", F.max(F.abs(F.col("duration") / F.col("median") - 1)).over(Window.partitionBy("section_id")))
    return out.withColumn("stable", F.col("drift") <= policy.max_group_duration_drift)


def structure_boundary(cues: DataFrame, anchors: DataFrame, policy: RepetitionPolicy = RepetitionPolicy()) -> DataFrame:
    """For each anchor (section_id, anchor, last) the first cue of a sample: the last one before the anchor that
    follows speech, a long pause or an earlier occurrence, moved on until the sample fits a clip."""
    w = Window.partitionBy("section_id").orderBy("pos")
    lyric = F.coalesce("role", F.lit("lyric")) == "lyric"
    c = cues.withColumn("_l", lyric).withColumn("_start", F.coalesce(~F.lag("_l").over(w) | (F.col("start") - F.lag("end").over(w) >= policy.structure_gap_seconds), F.lit(True)))
    # what an anchor is told by the cues and the earlier occurrences up to it: the greatest place where a sample may begin
    event = lambda d, pos, begin, anchor, last: d.select("section_id", F.col(pos).cast("long").alias("pos"), begin.cast("long").alias("_begin"), anchor.cast("long").alias("anchor"), last.cast("long").alias("last"))
    none = F.lit(None)
    after = anchors.withColumn("_after", F.col("last") + 1)
    events = event(c, "pos", F.when(F.col("_start"), F.col("pos")), none, none).unionByName(event(after, "_after", F.col("_after"), none, none)).unionByName(event(after, "anchor", none, F.col("anchor"), F.col("last")))
    upto = Window.partitionBy("section_id").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    edge = events.withColumn("_from", F.coalesce(F.max("_begin").over(upto), F.lit(0))).where("anchor IS NOT NULL").select("section_id", "anchor", "last", "_from").distinct()
    ends = cues.select("section_id", F.col("pos").alias("last"), F.col("end").alias("_until"))
    # anchors meet the cues between their first place and themselves by blocks of places
    block = lambda x: F.floor(x / PLACES)
    spans = edge.join(ends, ["section_id", "last"]).withColumn("_b", F.explode(F.sequence(block(F.col("_from")), block(F.col("anchor")))))
    fit = spans.join(c.select("section_id", "pos", "start", block(F.col("pos")).alias("_b")), ["section_id", "_b"]).where((F.col("pos") >= F.col("_from")) & (F.col("pos") <= F.col("anchor")))
    good = (F.col("_until") - F.col("start") <= policy.core_seconds) | (F.col("pos") == F.col("anchor"))
    return fit.where(good).groupBy("section_id", "anchor", "last").agg(F.min("pos").alias("sample_start"))


def longest_fit(starts: list[float], ends: list[float], most: float) -> tuple[int, int]:
    """Place and number of the longest run of cues whose ends are no more than `most` after its first start; the first cue always
    counts, and the first of equally long runs is taken."""
    best, falling, at = (0, 0), [], []  # negated ends, and places, of the cues behind that end later than all between
    for i in range(len(starts) - 1, -1, -1):
        k = bisect.bisect_left(falling, True, key=lambda x: not -x - starts[i] > most)  # noqa: B023
        n = (at[k - 1] if k else len(starts)) - i
        if n >= best[1]:
            best = (i, n)
        while falling and -falling[-1] <= ends[i]:
            falling.pop()
            at.pop()
        falling.append(-ends[i])
        at.append(i)
    return best


def fallback_sample(cues: DataFrame, policy: RepetitionPolicy = RepetitionPolicy()) -> DataFrame:
    """The longest run of lyrics that fits a clip, the first of equally long ones; its first cue always
    belongs to it."""
    w = Window.partitionBy("section_id").orderBy("pos")
    lyric = cues.withColumn("_i", F.row_number().over(w)).where(F.coalesce("role", F.lit("lyric")) == "lyric")
    run = (F.col("_i") - F.row_number().over(w)).alias("run")
    lyric = lyric.select("section_id", run, F.col("pos").cast("long").alias("pos"), F.coalesce("start", F.lit(float("inf"))).alias("start"), F.coalesce("end", F.lit(float("-inf"))).alias("end"))
    kind = cues.schema["section_id"].dataType.simpleString()

    def search(batches):
        for b in batches:
            rows = []
            for section, own in zip(b["section_id"], b["cues"], strict=True):
                at, best = 0, (0, 0)
                for _, same in itertools.groupby(own, key=lambda c: c["run"]):
                    same = list(same)
                    first, n = longest_fit([c["start"] for c in same], [c["end"] for c in same], policy.core_seconds)
                    best = max(best, (at + first, n), key=lambda x: x[1])
                    at += len(same)
                rows.append((section, own[best[0]]["pos"], own[best[0] + best[1] - 1]["pos"], best[1]))
            yield pd.DataFrame(rows, columns=["section_id", "first", "last", "n"])

    return _in_rows(lyric, "pos", "run", "start", "end").mapInPandas(search, f"section_id {kind}, first bigint, last bigint, n bigint")


def _in_rows(cues: DataFrame, *columns: str) -> DataFrame:
    """section_id, cues: one row for each section, its cues in the order of the first column."""
    return cues.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("cues"))


def change_collisions(cues: DataFrame) -> DataFrame:
    """Proposed edges (section_id, pos, start, end, new_start, new_end; null: none) that would give a cue no length or
    make it overlap its neighbour. Each edge is looked at in order and stays only if what was settled before
    allows it, so a section is worked through as one row."""
    kind = cues.schema["section_id"].dataType.simpleString()

    def settle(batches):
        for b in batches:
            rows = []
            for section, own in zip(b["section_id"], b["cues"], strict=True):
                s, e = [c["start"] for c in own], [c["end"] for c in own]
                for k, cue in enumerate(own):
                    for edge in ("start", "end"):
                        value = cue["new_" + edge]
                        if value is None:
                            continue
                        start, end = (value, e[k]) if edge == "start" else (s[k], value)
                        short = end - start <= 0
                        before = edge == "start" and k > 0 and start < e[k - 1] - 0.001
                        after = edge == "end" and k + 1 < len(s) and end > s[k + 1] + 0.001
                        if not (short or before or after):
                            s[k], e[k] = start, end
                        rows.append((section, cue["pos"], edge, not (short or before or after)))
            yield pd.DataFrame(rows, columns=["section_id", "pos", "edge", "eligible"])

    return _in_rows(cues, "pos", "start", "end", "new_start", "new_end").mapInPandas(settle, f"section_id {kind}, pos bigint, edge string, eligible boolean")


def apply_changes(cues: DataFrame, changes: DataFrame) -> DataFrame:
    """Cues (section_id, pos, text, start, end) with eligible edges (section_id, pos, text, new_start, new_end) in place, and a
    code where the text was changed or the result is out of order."""
    c = changes.select("section_id", "pos", F.col("text").alias("_t"), "new_start", "new_end")
    j = cues.join(c, ["section_id", "pos"], "left")
    same = F.col("_t").isNull() | (F.col("_t") == F.col("text"))
    moved = j.select("section_id", "pos", "text", F.when(same, F.coalesce("new_start", "start")).otherwise(F.col("start")).alias("start"), F.when(same, F.coalesce("new_end", "end")).otherwise(F.col("end")).alias("end"), (~same).alias("_changed"))
    w = Window.partitionBy("section_id").orderBy("pos")
    code = F.when(F.col("_changed"), "text_changed").when(F.col("start") >= F.col("end"), "no_duration").when(F.col("start") < F.lag("end").over(w) - 0.001, "overlap")
    return moved.withColumn("code", code).drop("_changed")
