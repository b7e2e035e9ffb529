"""Sequential work inside one recording: lyric cover, lyric alignment, boundary proposals. Groups are small and many;
each is worked through in one Arrow batch."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from difflib import Match, SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.blocks import matching_blocks
from .runs import Words, best_run


def lyric_cover(cues: DataFrame, lines: DataFrame, omitted: DataFrame | None = None) -> DataFrame:
    """Whether the lyric cues (section_id, pos, source_text, canonical_source_text, lyric_line_span) walk through all lyric
    lines (section_id, line from 1, text) in order. omitted: section_id, first, last. Rows: section_id, code, n."""
    c = cues.select("section_id", "pos", T.norm_layout(F.coalesce(F.nullif("canonical_source_text", F.lit("")), "source_text", F.lit(""))).alias("t"), F.col("lyric_line_span").alias("span"))
    flat = lines.select("section_id", "line", T.norm_layout(F.col("text")).alias("t")).groupBy("section_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]).alias("lines"))
    own = c.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("pos", "t", "span"))).alias("cues"))
    j = flat.join(own, "section_id", "left")
    skip = omitted.groupBy("section_id").agg(F.map_from_entries(F.collect_list(F.struct("first", "last"))).alias("skip")) if omitted is not None else None
    j = j.join(skip, "section_id", "left") if skip is not None else j.withColumn("skip", F.lit(None).cast("map<bigint,bigint>"))
    kind = lines.schema["section_id"].dataType.simpleString()

    def walk(batches):
        for b in batches:
            rows = []
            for section, texts, own_cues, gaps in zip(b["section_id"], b["lines"], b["cues"], b["skip"], strict=True):
                gaps = dict(gaps) if gaps is not None else {}

                def onward(at: int, gaps=gaps) -> int:
                    while at in gaps:
                        at = gaps[at] + 1
                    return at

                at, bad, other = onward(1), 0, 0
                for cue in own_cues if own_cues is not None else []:
                    span = cue["span"]
                    first, last = (at, at) if span is None else (span[0], span[1]) if len(span) == 2 else (-1, -1)
                    if first != at or last < first or last > len(texts):
                        bad += 1
                        continue
                    other += "".join(texts[first - 1 : last]) != cue["t"]
                    at = onward(int(last) + 1)
                for code, n in (("invalid_lyric_line_span", bad), ("lyrics_text_or_order_changed", other), ("lyrics_event_count_mismatch", abs(len(texts) + 1 - at))):
                    if n:
                        rows.append((section, code, n))
            yield pd.DataFrame(rows, columns=["section_id", "code", "n"])

    return j.select("section_id", "lines", "cues", "skip").mapInPandas(walk, f"section_id {kind}, code string, n bigint")


def _similar(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    r = SequenceMatcher(None, a, b).ratio()
    return max(r, min(len(a), len(b)) / max(len(a), len(b))) if a in b or b in a else r


GAP, MOST_LINES = 0.55, 3
#: What a pair earns at most, and the share of the time that the first band reaches to either side.
MOST_WORTH, FIRST_BAND = 2.65, 0.05
#: Walks after which all texts of the band are compared.
MOST_ROUNDS = 64


def _band(u: np.ndarray, v: np.ndarray, width: float) -> np.ndarray:
    """Cells (after i cues and j lines) whose shares of the time differ by the width at most, and what joins them."""
    near = np.abs(u[:, None] - v[None, :]) <= width
    last = near.shape[1] - 1
    low = np.where(near.any(axis=1), near.argmax(axis=1), last)
    high = np.where(near.any(axis=1), last - near[:, ::-1].argmax(axis=1), 0)
    low[0], high[-1] = 0, last
    low = np.minimum.accumulate(low[::-1])[::-1]
    high = np.maximum.accumulate(high)
    high[:-1] = np.maximum(high[:-1], low[1:])
    j = np.arange(last + 1)
    return (j >= low[:, None]) & (j <= high[:, None])


def _pairing(texts: list[str], times: list[int], lines: list[str], at: list[int]) -> list[tuple[int, int, int, float, float]]:
    """(cue, first line, last line, similarity, place) of the best walk through cues and lines.

    Totals are taken diagonal by diagonal within a band of the time. What a walk that leaves the band could reach at most
    is known; unless the best walk within reaches more, the band is widened. Texts count first with what their
    characters allow at most, and those that the best walk takes are compared, until it takes none that is not: no
    other walk can reach more, and none that comes first can reach as much."""
    n, m = len(texts), len(lines)
    u, v = (np.array(t, float) - t[0] for t in (times, at))
    u, v = u / max(1, times[-1] - times[0]), v / max(1, at[-1] - at[0])
    place = np.abs(u[:, None] - v[None, :])
    # runs of several lines count only where they are the whole text
    whole: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        whole.setdefault(t, []).append(i)
    runs = np.zeros((MOST_LINES + 1, n, m), bool)  # by lines, cue and last line
    for k in range(2, MOST_LINES + 1):
        for j in range(m - k + 1):
            if (text := "".join(lines[j : j + k])) and text in whole:
                runs[k, whole[text], j + k - 1] = True
    i, j = np.ogrid[: n + 1, : m + 1]
    matched = np.minimum(i, j) + np.minimum(n - i, m - j)
    most = MOST_WORTH * matched - GAP * (n - matched) - GAP * np.maximum(0, m - MOST_LINES * matched)
    alike, sure = _at_most(texts, lines)
    known: dict[tuple[str, str], float] = {}
    width, rounds, whole_run = FIRST_BAND, 0, _worth(np.ones_like(place), place)
    while True:
        open_ = _band(np.append(0.0, u), np.append(0.0, v), width)
        total, taken = _totals(open_, _worth(alike, place), whole_run, runs)
        if not open_.all() and total[n, m] <= most[~open_].max() + 1e-9:
            width *= 2
            continue
        walk = _walk(taken)
        rounds += 1
        asked = [(i, j) for i, j, k in walk if k == 1 and not sure[i, j]] if rounds < MOST_ROUNDS else np.argwhere(open_[1:, 1:] & ~sure).tolist()
        if not asked:
            break
        for x, y in asked:
            pair = texts[x], lines[y]
            if pair not in known:
                known[pair] = _similar(*pair)
            alike[x, y], sure[x, y] = known[pair], True
    found = []
    for i, j, k in walk:
        s = float(alike[i, j]) if k == 1 else 1.0
        if s >= GAP:
            found.append((i, j - k + 1, j, s, float(place[i, j - k + 1])))
    return found[::-1]


def _at_most(texts: list[str], lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What the similarity of each text and line is at most, by the characters that both hold, and whether it is just that."""
    n, m = len(texts), len(lines)
    a, b = ({}, {})
    for side, own in ((texts, a), (lines, b)):
        for i, t in enumerate(side):
            for c, k in Counter(t).items():
                own.setdefault(c, []).append((i, k))
    shared = np.zeros((n, m), np.int64)
    for c in a.keys() & b.keys():
        (x, p), (y, q) = (np.array(side[c]).T for side in (a, b))
        shared[np.ix_(x, y)] += np.minimum.outer(p, q)
    size_a, size_b = (np.array([len(t) for t in side], np.int64) for side in (texts, lines))
    place = {t: i for i, t in enumerate(dict.fromkeys([*texts, *lines]))}
    same = np.equal.outer([place[t] for t in texts], [place[t] for t in lines])
    both = size_a[:, None] + size_b[None, :]
    # texts that are not the same differ in a character at least
    shared -= ~same & (2 * shared == both) & (both > 0)
    alike = np.where(same & (both > 0), 1.0, 2.0 * shared / np.maximum(both, 1))
    return alike, same | (shared <= 0)


def _walk(taken: np.ndarray) -> list[tuple[int, int, int]]:
    """(cue, last line, number of lines) of the steps that take both, from the last one on."""
    out, i, j = [], taken.shape[0] - 1, taken.shape[1] - 1
    while i and j:
        k = int(taken[i, j])
        if k > 0:
            out.append((i - 1, j - 1, k))
        i, j = i - (k != 0), j - (1 if k == 0 else max(k, 0))
    return out


def _worth(alike: np.ndarray, place: np.ndarray) -> np.ndarray:
    return 2.4 * alike - 0.8 * place - 0.35 + 0.6 * (alike == 1.0)


def _totals(open_: np.ndarray, worth: np.ndarray, whole: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best total up to each open cell, and the lines that its last step takes (-1: a cue is left out, 0: a line is).
    whole: what an exact run from a line on earns. All cells of a diagonal are filled at once; of equal totals the first of: no cue, no line, one line, several."""
    n, m = open_.shape[0] - 1, open_.shape[1] - 1
    total, taken = np.full((n + 1, m + 1), -np.inf), np.zeros((n + 1, m + 1), np.int8)
    total[0], total[:, 0] = -GAP * np.arange(m + 1), -GAP * np.arange(n + 1)
    total[~open_] = -np.inf
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        i = i[open_[i, d - i]]
        j = d - i
        best, step = total[i - 1, j] - GAP, np.full(len(i), -1, np.int8)
        options = [(0, total[i, j - 1] - GAP), (1, total[i - 1, j - 1] + worth[i - 1, j - 1])]
        for k in range(2, MOST_LINES + 1):
            first = np.maximum(j - k, 0)
            value = total[i - 1, first] + whole[i - 1, np.minimum(first, m - 1)]
            options.append((k, np.where((j >= k) & runs[k, i - 1, j - 1], value, -np.inf)))
        for k, value in options:
            better = value > best
            best, step = np.where(better, value, best), np.where(better, np.int8(k), step)
        total[i, j], taken[i, j] = best, step
    return total, taken


def align_lyrics(official: DataFrame, lyrics: DataFrame) -> DataFrame:
    """(track_id, line, first, last, similarity, place): official cues (track_id, line, text, start_ms) on runs of
    one to three lyric lines (track_id, line, text, ms), by the best total over the whole track. A cue or line without
    a partner costs 0.55; a match earns 2.4 times the similarity less 0.35 and 0.8 times the distance of the two
    times, each as a share of its own list's span; an exact one 0.6 more. Runs of several lines must match exactly.
    Pairs below 0.55 are dropped. A track is one recording, so its lines are one group."""
    # under names of their own, so that a later join with the same tables cannot mix them up
    track, line = F.col("track_id").alias("track"), F.col("line").alias("row")
    a = official.select(track, line, F.col("start_ms").alias("at"), T.norm_lyric(F.coalesce("text", F.lit(""))).alias("t"))
    b = lyrics.select(track, line, F.col("ms").alias("at"), T.norm_lyric(F.coalesce("text", F.lit(""))).alias("t"))
    kind = official.schema["track_id"].dataType.simpleString()
    names = ["track_id", "line", "first", "last", "similarity", "place"]

    def align(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        left, right = left.sort_values("row"), right.sort_values("row")
        cue, line = left["row"].tolist(), right["row"].tolist()
        pairs = _pairing(left["t"].tolist(), left["at"].tolist(), right["t"].tolist(), right["at"].tolist())
        return pd.DataFrame([(left["track"].iloc[0], cue[i], line[j], line[k], s, d) for i, j, k, s, d in pairs], columns=names)

    return a.groupBy("track").cogroup(b.groupBy("track")).applyInPandas(align, f"track_id {kind}, line bigint, first bigint, last bigint, similarity double, place double")


def reference_translation(pairs: DataFrame, official: DataFrame, lyrics: DataFrame) -> DataFrame:
    """For each official cue (track_id, line, text, start_ms) what its lyric lines (track_id, line, text, ms,
    translation) tell: first, last, similarity, translation, projected_ms, delta_ms, hint.

    The translation is joined if all lines have one and neither text holds the other without being equal to it; sure
    tells whether it may be taken (similarity 0.72 or more). The first and the last exact match carry lyric times
    over to the recording; with fewer than two, or no time between them, the hint is relative-unavailable. A cue
    that begins 750 ms or more before its projected time is relative-earlier, behind it relative-later."""
    ly = lyrics.select("track_id", F.col("line").alias("_l"), F.col("ms").alias("_ms"), "translation", T.norm_lyric(F.coalesce("text", F.lit(""))).alias("_x"))
    own = official.select("track_id", "line", "start_ms", T.norm_lyric(F.coalesce("text", F.lit(""))).alias("_o"))
    parts = F.array_sort(F.collect_list(F.struct("_l", "_x", F.coalesce("translation", F.lit("")).alias("_t"), "_ms")))
    runs = pairs.join(ly, "track_id").where(F.col("_l").between(F.col("first"), F.col("last"))).groupBy("track_id", "line", "first", "last", "similarity").agg(parts.alias("_p"))
    j = runs.join(own, ["track_id", "line"], "right").withColumns({"_text": F.array_join(F.transform("_p", lambda x: x["_x"]), ""), "_at": F.get("_p", F.lit(0))["_ms"]})
    exact = F.when(F.col("_text") == F.col("_o"), F.struct("line", "_at", "start_ms"))
    ends = j.groupBy("track_id").agg(F.min(exact).alias("_a"), F.max(exact).alias("_b"))
    span = F.col("_b._at") - F.col("_a._at")
    known = F.col("_p").isNotNull() & F.coalesce(span > 0, F.lit(False))
    projected = F.when(known, F.col("_a.start_ms") + F.bround((F.col("_at") - F.col("_a._at")) / span * (F.col("_b.start_ms") - F.col("_a.start_ms"))).cast("long"))
    delta = F.col("start_ms") - projected
    hint = F.when(F.col("_p").isNull(), "unmatched").when(~known, "relative-unavailable").when(delta <= -750, "relative-earlier").when(delta >= 750, "relative-later").otherwise("within-relative-range")
    part = (F.col("_text") != F.col("_o")) & (F.contains("_text", "_o") | F.contains("_o", "_text"))
    whole = F.forall("_p", lambda x: x["_t"] != "") & ~part
    translation = F.when(F.col("_p").isNotNull(), F.when(whole, F.array_join(F.transform("_p", lambda x: x["_t"]), " ")).otherwise(""))
    out = j.join(ends, "track_id").select("track_id", "line", "first", "last", "similarity", translation.alias("translation"), projected.alias("projected_ms"), delta.alias("delta_ms"), hint.alias("hint"))
    return out.withColumn("sure", F.coalesce((F.col("translation") != "") & (F.col("similarity") >= 0.72), F.lit(False)))


@dataclass(frozen=True)
class BoundaryPolicy:
    window_seconds: float = 2.0
    least_score: float = 0.55
    per_second: float = 0.05
    per_character: float = 0.01
    least_adjustment: float = 0.05
    most_adjustment: float = 0.75
    edge_characters: int = 2
    strong_characters: int = 4
    strong_probability: float = 0.75
    handoff: float = 0.02
    least_seconds: float = 0.2


def _edges(text: str, run: list[tuple], first: int, policy: BoundaryPolicy) -> dict:
    """How the text's two ends lie on the characters of a run of words: for start and end a time, the number of
    characters and the mean word probability, or none; the share of the text that is met; the word behind the last."""
    clock, owner = [], []
    for k, (start, end, t, _) in enumerate(run):
        step = (end - start) / len(t) if t else 0.0
        clock += [(start + step * i, start + step * (i + 1)) for i in range(len(t))]
        owner += [k] * len(t)
    blocks = [Match(*b) for b in matching_blocks(text, "".join(w[2] for w in run))]
    enough = min(policy.edge_characters, len(text))

    def edge(b, time: float) -> tuple[float, int, float | None]:
        sure = [p for k in sorted(set(owner[b.b : b.b + b.size])) if (p := run[k][3]) is not None and p == p]
        return time, b.size, sum(sure) / len(sure) if sure else None

    opening = next((b for b in blocks if b.a == 0 and b.size >= enough), None)
    closing = next((b for b in blocks[::-1] if b.a + b.size == len(text) and b.size >= enough), None)
    return {
        "start": opening and edge(opening, clock[opening.b][0]),
        "end": closing and edge(closing, clock[closing.b + closing.size - 1][1]),
        "coverage": sum(b.size for b in blocks) / len(text),
        "used": first + (owner[max(b.b + b.size for b in blocks) - 1] + 1 if blocks else len(run)),
    }


def _proposal(cue, words: Words, used: int, policy: BoundaryPolicy) -> tuple[dict, int]:
    """What becomes of one cue, and the first word that the next one may use."""
    out = {"was": (cue.start, cue.end), "new": [cue.start, cue.end], "score": None, "status": "unmatched_keep_original", "reasons": set(), "notes": set(), "anchored": (False, False), "coverage": None}
    hit = best_run(cue.t, cue.start, cue.end, words, used, policy.window_seconds, policy.least_score, policy.per_second, policy.per_character)
    if not hit:
        return out, used
    score, a, b = hit
    found = _edges(T.kana_folded(cue.t), [(x, y, T.kana_folded(t), sure) for x, y, t, sure in words.words[a : b + 1]], a, policy)
    sides = (found["start"], found["end"])
    out |= {"score": round(score, 4), "coverage": round(found["coverage"], 4), "anchored": tuple(s is not None for s in sides)}
    used = max(used, found["used"])
    if not any(sides):
        out["status"] = "edge_unanchored_keep_original"
        out["reasons"] = {"missing_sentence_edge_phonetic_anchor"}
        return out, used
    new = list(out["was"])
    for k, (side, name) in enumerate(zip(sides, ("start", "end"), strict=True)):
        if not side:
            continue
        time, size, sure = side
        time = max(0.0, time) if k == 0 else time
        strong = size >= policy.strong_characters and sure is not None and sure >= policy.strong_probability
        if abs(time - new[k]) > policy.most_adjustment and not strong:
            out["reasons"].add(f"{name}_adjustment_exceeds_policy_without_strong_edge")
        else:
            new[k] = time
    if all(abs(x - y) < policy.least_adjustment for x, y in zip(new, out["was"], strict=True)):
        out["status"] = "large_adjustment_keep_original" if out["reasons"] else "matched_keep_original"
    elif new[1] - new[0] < policy.least_seconds:
        out["status"] = "unsafe_duration_keep_original"
        out["reasons"].add("candidate_duration_below_minimum")
    else:
        out["status"] = "suggested_partial" if out["reasons"] or not all(sides) else "suggested"
        out["new"] = new
    out["new"] = [round(x, 3) for x in out["new"]]
    return out, used


def _settle(proposals: list[dict], policy: BoundaryPolicy) -> None:
    """Neighbours that collide. An end without an anchor hands over just before an anchored start; else the
    edges that were moved go back."""
    movable = {"suggested", "suggested_partial"}
    back: set[int] = set()
    moved: set[int] = set()
    for k, (left, right) in enumerate(zip(proposals, proposals[1:], strict=False)):
        if left["new"][1] <= right["new"][0]:
            continue
        free = left["status"] in movable, right["status"] in movable
        if all(free) and not left["anchored"][1] and right["anchored"][0]:
            hand = round(right["new"][0] - policy.handoff, 3)
            if hand - left["new"][0] >= policy.least_seconds:
                left["new"][1] = hand
                left["notes"].add("end_from_next_sentence_start")
                moved.add(k)
                continue
        if free[0] and left["new"][1] != left["was"][1]:
            left["new"][1] = left["was"][1]
            left["reasons"].add("end_candidate_overlaps_next")
            back.add(k)
        if free[1] and right["new"][0] != right["was"][0]:
            right["new"][0] = right["was"][0]
            right["reasons"].add("start_candidate_overlaps_previous")
            back.add(k + 1)
    for k in moved | back:
        p = proposals[k]
        same = all(round(x - y, 3) == 0 for x, y in zip(p["new"], p["was"], strict=True))
        p["status"] = "neighbor_conflict_keep_original" if k in back and same else "suggested_partial"


def propose_boundaries(cues: DataFrame, words: DataFrame, policy: BoundaryPolicy = BoundaryPolicy()) -> DataFrame:
    """New edges of cues (section_id, pos, start, end, text) from timed words (section_id, start, end, text
    and, if known, probability): new_start, new_end, score, coverage, start_anchored, end_anchored, status, reasons,
    resolution (lists joined by commas).

    Per cue, in order, the best run of neighbouring words near it, beyond those that earlier cues have used: the
    similarity, less 0.05 a second between the centres and 0.01 a character of difference, ranks; the similarity alone
    must reach 0.55. An edge is moved to the time of the character that the cue's first or last characters
    match; far only if enough characters match in words that are sure. Then neighbours that collide are settled.
    Similarity is the greater of those of N2 texts and of their readings, edges lie on readings (kana_folded). A
    section is one recording, so its cues and words are one group."""
    c = cues.select("section_id", "pos", "start", "end", T.norm_match(F.coalesce("text", F.lit(""))).alias("t"))
    sure = F.col("probability") if "probability" in words.columns else F.lit(None)
    w = words.select("section_id", "start", "end", F.col("text").alias("raw"), T.norm_match(F.coalesce("text", F.lit(""))).alias("t"), sure.cast("double").alias("sure"))
    kind = cues.schema["section_id"].dataType.simpleString()
    cols = ["section_id", "pos", "new_start", "new_end", "score", "coverage", "start_anchored", "end_anchored", "status", "reasons", "resolution"]

    def propose(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("pos")
        ws = Words(list(right.sort_values(["start", "end", "raw"])[["start", "end", "t", "sure"]].itertuples(index=False, name=None)), T.kana_folded)
        proposals, used = [], 0
        for cue in left.itertuples(index=False):
            p, used = _proposal(cue, ws, used, policy)
            proposals.append(p)
        _settle(proposals, policy)
        rows = [(cue.section_id, cue.pos, *p["new"], p["score"], p["coverage"], *p["anchored"], p["status"], ",".join(sorted(p["reasons"])), ",".join(sorted(p["notes"]))) for cue, p in zip(left.itertuples(index=False), proposals, strict=True)]
        return pd.DataFrame(rows, columns=cols)

    return c.groupBy("section_id").cogroup(w.groupBy("section_id")).applyInPandas(propose, f"section_id {kind}, pos bigint, new_start double, new_end double, score double, coverage double, start_anchored boolean, end_anchored boolean, status string, reasons string, resolution string")
