"""Speech cues: joining short openings, cutting turns of several sentences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import CLOSERS, SOFT, STRONG, _units
from .joins import matching_segments

SOURCE_UNITS, TRANSLATION_UNITS = 56, 44


def speakers(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """U4: distinct non-empty speakers of a cue (section_id, pos, speaker) and of its segments (section_id, pos, speaker)."""
    own = cues.select("section_id", "pos", F.trim("speaker").alias("s")).unionByName(segments.select("section_id", "pos", F.trim("speaker").alias("s")))
    return own.groupBy("section_id", "pos").agg(F.array_sort(F.collect_set(F.when(F.col("s") != "", F.col("s")))).alias("speakers"))


def may_open(source: Column, translation: Column, seconds: Column, evidence: Column) -> Column:
    """Whether a cue is a short unfinished opening that the next one may take up."""
    short = (T.display_units(source) <= 20) & (T.display_units(translation) <= 16) & (seconds > 0) & (seconds <= 1.8)
    open_ = ~T.has_strong_end(source) & ~T.has_strong_end(translation) & ~T.is_short_reply(source)
    return (F.trim(source) != "") & (F.trim(translation) != "") & short & open_ & (T.has_unfinished_tail(source) | T.has_continuation_evidence(evidence))


def merge_short_prefixes(cues: DataFrame) -> DataFrame:
    """Cues (section_id, pos, start, end, source_text, translation, speakers, evidence) with short openings joined to the
    cue after them. Pairs are disjoint and taken from the left: in a chain of cues that could all join, those at
    odd places open a pair."""
    w = Window.partitionBy("section_id").orderBy("pos")
    gap = F.lead("start").over(w) - F.col("end")
    same = F.lead("speakers").over(w)
    talk = (F.size("speakers") == 0) | (F.size(same) == 0) | (F.array_sort("speakers") == F.array_sort(same))
    can = may_open(F.col("source_text"), F.col("translation"), F.col("end") - F.col("start"), F.col("evidence")) & (gap >= -0.001) & (gap <= 0.8) & talk
    flag = cues.withColumn("_can", F.coalesce(can, F.lit(False)))
    flag = flag.withColumn("_i", F.row_number().over(w))
    flag = flag.withColumn("_chain", F.col("_i") - F.sum(F.when(F.col("_can"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("section_id", "_chain", "_can").orderBy("pos"))
    flag = flag.withColumn("_opens", F.col("_can") & (place % 2 == 1))
    tail = F.coalesce(F.lag("_opens").over(w), F.lit(False))
    glue = lambda a, b: F.concat(F.rtrim(a), F.when(F.rtrim(a).rlike("[A-Za-z0-9]$") & F.ltrim(b).rlike("^[A-Za-z0-9]"), F.lit(" ")).otherwise(""), F.ltrim(b))
    out = flag.withColumns({"_tail": tail, "_s": F.lead("source_text").over(w), "_t": F.lead("translation").over(w), "_e": F.lead("end").over(w)}).where("NOT _tail")
    join = lambda c, n: F.when(F.col("_opens"), glue(F.col(c), F.col(n))).otherwise(F.col(c))
    return out.select("section_id", "pos", "start", F.when(F.col("_opens"), F.col("_e")).otherwise(F.col("end")).alias("end"), join("source_text", "_s").alias("source_text"), join("translation", "_t").alias("translation"), F.col("_opens").alias("merged"))


LEAST_PART, LEAST_SHIFT, PART_GAP, MOST_PARTS = 0.45, 0.35, 0.02, 6
# What a cut costs beside its distance to the wished share of the width.
AT_STRONG, AT_SEGMENT, AT_SPACE, AT_SOFT, ELSEWHERE, IN_WORD, TOO_WIDE = 0.0, 0.03, 0.06, 0.1, 0.55, 0.8, 0.1


def sentences(text: Column) -> Column:
    """Sentences of a text: one more than the sentence marks that something other than closing quotes follows."""
    marks = F.length(text) - F.length(F.regexp_replace(text, f"[{STRONG}]", ""))
    return marks - text.rlike(f"[{STRONG}][{CLOSERS}]*[{T.SPACE}]*$").cast("int") + 1


def is_timed(words: Column) -> Column:
    """Whether a segment has a word with both times."""
    return F.coalesce(F.exists(words, lambda w: w["start"].isNotNull() & w["end"].isNotNull()), F.lit(False))


def parts_told(source: Column, translation: Column, seconds: Column, whole: Column) -> Column:
    """What the texts of a cue tell of its parts, before its segments are known: most, the parts that it may have, at most
    one in 0.45 seconds, and six; each, whether both texts have equally many sentences, two or more; other, whether
    one has two and the other one."""

    def told(x: Column) -> Column:
        a, b = x["a"], x["b"]
        each, other = (a == b) & (a > 1), (F.least(a, b) == 1) & (F.greatest(a, b) == 2)
        count = F.when(each, a).when(other | (F.greatest(a, b) == 1), 2).otherwise(1)
        most = F.when(whole, 1).otherwise(F.least(count, F.greatest(F.lit(1), F.floor(seconds / LEAST_PART)), F.lit(MOST_PARTS))).cast("int")
        return F.struct(most.alias("most"), each.alias("each"), other.alias("other"))

    # a transform binds the sentences: they are counted once, however often they are asked for
    both = F.struct(sentences(source).alias("a"), sentences(translation).alias("b"))
    return F.get(F.transform(F.array(both), told), F.lit(0))


def part_count(told: Column, segments: Column) -> Column:
    """Parts of a cue. As many as sentences, if both texts have equally many; two if one text has two and the
    other one, or if both have one and a timed segment before the last has an unfinished end, as far as two segments with timed
    words stand in the cue. No more than parts_told() has."""
    timed = F.filter(segments, lambda s: s["timed"])
    open_ = F.exists(F.slice(timed, F.lit(1), F.greatest(F.lit(0), F.size(timed) - 1)), lambda s: s["open"])
    two = (F.size(timed) >= 2) & (told["other"] | open_)
    return F.when((told["most"] > 1) & (told["each"] | two), told["most"]).otherwise(1)


class Cuts:
    """Places where a text may be cut, and what each costs."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        units = [_units(c) for c in text]
        self.width = np.concatenate([[0], np.cumsum(units)])
        self.total = max(1, int(self.width[-1]))
        self.ink = np.concatenate([[0], np.cumsum([not c.isspace() for c in text])])

    def sentence_ends(self) -> list[int]:
        out = []
        for i, c in enumerate(self.text[:-1], 1):
            if c in STRONG:
                while i < self.n and self.text[i] in CLOSERS:
                    i += 1
                if self.ink[-1] > self.ink[i]:
                    out.append(i)
        return out

    def at_share(self, share: float) -> int:
        at = int(np.searchsorted(self.width, self.total * share))
        return max(1, self.n - 1) if at > self.n else max(1, at)

    def kinds(self, liked: set[int]) -> np.ndarray:
        out = np.full(self.n, ELSEWHERE)
        for i in range(1, self.n):
            before, after = self.text[i - 1], self.text[i]
            if before in STRONG:
                out[i] = AT_STRONG
            elif i in liked:
                out[i] = AT_SEGMENT
            elif before.isspace() or after.isspace():
                out[i] = AT_SPACE
            elif before in SOFT:
                out[i] = AT_SOFT
        return out

    def inside(self) -> np.ndarray:
        """Whether an ASCII word reaches across each place."""
        letter = np.array([c.isascii() and c.isalnum() for c in self.text])
        return np.concatenate([[False], letter[:-1] & letter[1:]])


def cut_text(text: str, n: int, most: int, wished: list[float] | None = None, segments: list[float] | None = None) -> tuple[list[str], list[float]]:
    """n parts of a text and the shares of its width at the cuts; nothing if it can't be cut into so many.

    At inner sentence ends, if there are as many as needed. Else one cut after the other where the distance
    to the wished share (even ones, if none are given), the kind of the place and parts wider than `most` cost least;
    places at the shares of `segments` are liked."""
    cuts = Cuts(text := text.strip())
    places = cuts.sentence_ends()
    exact = len(places) == n - 1
    if not exact:
        places, before = [], 0
        base, inside = cuts.kinds({cuts.at_share(s) for s in segments or [] if 0 < s < 1}), cuts.inside()
        for k in range(1, n):
            share = wished[k - 1] if wished and k <= len(wished) else k / n
            spots = np.arange(before + 1, cuts.n)
            spots = spots[(cuts.ink[spots] > cuts.ink[before]) & (cuts.ink[-1] > cuts.ink[spots])]
            if len(spots):
                left, right = cuts.width[spots] - cuts.width[before], cuts.width[-1] - cuts.width[spots]
                cost = base[spots] + np.maximum(0, left - most) / most * TOO_WIDE + np.maximum(0, right - most * (n - k)) / most * TOO_WIDE
                cost = np.where(inside[spots], cost + IN_WORD, cost)
                before = int(spots[np.argmin(np.abs(cuts.width[spots] / cuts.total - share) + cost)])
            else:
                before = max(before + 1, min(cuts.n - 1, cuts.at_share(share)))
            places.append(before)
    parts = [text[a:b].strip() for a, b in zip([0, *places], [*places, cuts.n], strict=True)]
    if not exact and not all(parts):
        return [], []
    return parts, [float(cuts.width[p] / cuts.total) for p in places]


def cut_times(start: float, end: float, shares: list[float], segments: list) -> list[float]:
    """Times of the cuts: the end of the word whose share of all words' width is nearest, among those that leave 0.35
    seconds to the cut before and to each part behind; without one the share of the time, moved into these bounds."""
    words = [w for s in segments for w in (s["words"] if s["words"] is not None and len(s["words"]) else [s])]
    widths = np.cumsum([max(1, sum(map(_units, w["text"] or ""))) for w in words])
    marks = [(float(x / widths[-1]), float(w["end"])) for x, w in zip(widths[:-1], words[:-1], strict=True)]
    out, before = [], start
    for k, share in enumerate(shares):
        low, high = before + LEAST_SHIFT, end - LEAST_SHIFT * (len(shares) - k)
        near = [m for m in marks if low <= m[1] <= high]
        before = round(min(near, key=lambda m: abs(m[0] - share))[1] if near else min(max(low, start + (end - start) * share), high), 3)  # noqa: B023
        out.append(before)
    return out


def split_events(cues: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Cues (section_id, pos, start, end, source_text, translation and, if known, evidence, merged) cut into
    sentences, renumbered. segments (section_id, start, end, text, words: array of start, end, text) inside a cue tell
    where; cues that were joined from openings stay whole. Both texts are cut into equally many parts or neither
    is. Columns: section_id, pos, part, start, end, source_text, translation, merged, new_pos."""
    kind = cues.schema["section_id"].dataType.simpleString()
    word = "array<struct<start:double,end:double,text:string>>"
    found = f"array<struct<start:double,end:double,text:string,words:{word},timed:boolean,open:boolean>>"
    joined = F.coalesce(F.col("merged"), F.lit(False)) if "merged" in cues.columns else F.lit(False)
    told = F.coalesce(F.array_contains("evidence", "timed_prefix_merge"), F.lit(False)) if "evidence" in cues.columns else F.lit(False)
    base = cues.select("section_id", "pos", "start", "end", F.coalesce("source_text", F.lit("")).alias("source_text"), F.coalesce("translation", F.lit("")).alias("translation"), joined.alias("merged"), (joined | told).alias("_whole"))
    base = base.withColumn("_told", parts_told(F.col("source_text"), F.col("translation"), F.col("end") - F.col("start"), F.col("_whole"))).drop("_whole")
    if segments is None:
        base = base.withColumn("_g", F.array().cast(found))
    else:
        heard = segments.select("section_id", "start", "end", "text", F.col("words").cast(word).alias("words"))
        heard = heard.withColumns({"timed": is_timed(F.col("words")), "open": T.has_unfinished_tail(F.coalesce("text", F.lit("")))})
        met = matching_segments(base.where("_told.most > 1").select("section_id", "pos", "start", "end"), heard)
        own = met.groupBy("section_id", "pos").agg(F.array_sort(F.collect_list(F.struct(*[F.col(f"r_{c}").alias(c) for c in ("start", "end", "text", "words", "timed", "open")]))).alias("_g"))
        base = base.join(own, ["section_id", "pos"], "left").withColumn("_g", F.coalesce("_g", F.array().cast(found)))
    base = base.withColumn("_n", part_count(F.col("_told"), F.col("_g"))).drop("_told")
    names = ["section_id", "pos", "part", "start", "end", "source_text", "translation", "merged"]
    base = base.select(*[F.lit(0).alias(c) if c == "part" else c for c in names], "_n", F.when(F.col("_n") > 1, F.col("_g")).alias("_g"))

    def cut(batches):
        for b in batches:
            many = pc.greater(b.column("_n"), 1)
            yield b.filter(pc.invert(many)).select(names)
            rows = []
            for x in b.filter(many).to_pylist():
                start, end, heard = x["start"], x["end"], x["_g"]
                widths = np.cumsum([max(1, sum(map(_units, s["text"] or ""))) for s in heard])
                shares = [float(w / widths[-1]) for w in widths[:-1]]
                source, at = cut_text(x["source_text"], x["_n"], SOURCE_UNITS, segments=shares)
                target, _ = cut_text(x["translation"], x["_n"], TRANSLATION_UNITS, wished=at)
                if not source or not target:
                    rows.append({c: x[c] for c in names})
                    continue
                times = [start, *cut_times(start, end, at, heard), end]
                for k in range(x["_n"]):
                    edges = {"part": k, "start": round(times[k], 3), "end": round(times[k + 1] - (PART_GAP if k < x["_n"] - 1 else 0.0), 3)}
                    rows.append({"section_id": x["section_id"], "pos": x["pos"], **edges, "source_text": source[k], "translation": target[k], "merged": x["merged"]})
            yield pa.RecordBatch.from_pylist(rows, b.select(names).schema)

    parts = base.mapInArrow(cut, f"section_id {kind}, pos bigint, part int, start double, end double, source_text string, translation string, merged boolean")
    number = F.row_number().over(Window.partitionBy("section_id").orderBy("pos", "part")) - 1
    return parts.withColumn("new_pos", number)


def reflow_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of each section the cues before and after, those that were cut, those joined to an opening, and the widest
    source text and translation. after: as split_events() returns it."""
    old = before.groupBy("section_id").agg(F.count("*").alias("cues_before"))
    units = lambda c: F.max(T.display_units(F.coalesce(c, F.lit(""))))
    new = after.groupBy("section_id").agg(F.count("*").alias("cues_after"), F.count_if(F.col("part") == 1).alias("splits"), F.count_if((F.col("part") == 0) & F.col("merged")).alias("merges"), units("source_text").alias("source_units"), units("translation").alias("translation_units"))
    return old.join(new, "section_id", "left").na.fill(0)
