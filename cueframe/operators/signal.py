"""Onsets, rhythm and loudness of sample arrays. A row holds one recording or one occurrence, so arrays never
explode unless a job counts samples; numpy works inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RhythmPolicy:
    frame_samples: int = 400
    hop_samples: int = 160
    max_lag_seconds: float = 0.5
    least_correlation: float = 0.75
    most_drift: float = 0.03


def _over(kind: str, f: Callable, *columns: Column) -> Column:
    @F.pandas_udf(kind)
    def run(*batch: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*batch, strict=True)])

    return run(*columns)


def smoothed(x: np.ndarray) -> np.ndarray:
    return np.convolve(x, np.full(3, 1 / 3), "same") if len(x) >= 3 else x


def envelope(samples: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """Rises of the loudness of overlapping frames, smoothed, the strongest 1."""
    x = np.asarray(samples, float)
    if len(x) < frame:
        return np.zeros(0)
    power = np.lib.stride_tricks.sliding_window_view(x * x, frame)[::hop].mean(axis=1)
    rise = smoothed(np.maximum(0, np.diff(np.sqrt(power), prepend=np.sqrt(power[0]))))
    top = rise.max(initial=0)
    return rise / top if top > 0 else rise


def correlations(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Correlation of a with b moved by -most to most places: products of all lags by one Fourier transform, means and
    spreads of the parts that overlap by running sums."""
    n, lags = len(a), np.arange(-most, most + 1)
    a, b = a - a.mean(), b - b.mean()
    size = 1 << (2 * n - 1).bit_length()
    both = np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)[lags]
    many = n - np.abs(lags)

    def parts(x: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and sums of squares of what is left of x without its first `ahead` places, or without its last -ahead ones."""
        first, last = np.maximum(0, ahead), n + np.minimum(0, ahead)
        runs = [np.concatenate([[0.0], np.cumsum(y)]) for y in (x, x * x)]
        return runs[0][last] - runs[0][first], runs[1][last] - runs[1][first]

    (sa, qa), (sb, qb) = parts(a, -lags), parts(b, lags)
    spread = np.sqrt(np.maximum(0, qa - sa * sa / many)) * np.sqrt(np.maximum(0, qb - sb * sb / many))
    return np.where(spread > 1e-12, (both - sa * sb / many) / np.maximum(spread, 1e-300), 0.0)


def _correlation(a: np.ndarray, b: np.ndarray, lag: int) -> float:
    x, y = (a[-lag:], b[:lag]) if lag < 0 else (a[: len(a) - lag], b[lag:])
    x, y = x - x.mean(), y - y.mean()
    size = np.linalg.norm(x) * np.linalg.norm(y)
    return float(x @ y / size) if size > 1e-12 else 0.0


def best_lag(a: np.ndarray, b: np.ndarray, most: int) -> tuple[float, int]:
    """Greatest correlation of a with b moved by up to `most` places, and the place; of equal ones the first. All places
    are told at once, those that come near the greatest are then taken one by one."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if min(len(a), len(b)) < 4:
        return 0.0, 0
    if len(a) != len(b):
        b = np.interp(np.linspace(0, len(b) - 1, len(a)), np.arange(len(b)), b)
    most = max(0, min(most, len(a) - 4))
    told = correlations(a, b, most)
    # sums of parts that hardly vary lose digits; such places are taken one by one as well
    near = np.flatnonzero((told >= told.max() - 1e-7) | (np.abs(told) > 1))
    best = (-1.0, 0)
    for lag in (near - most).tolist():
        r = _correlation(a, b, lag)
        if r > best[0]:
            best = (r, lag)
    return min(1.0, max(0.0, best[0])), best[1]


def signature(onsets: np.ndarray, most: int = 400) -> np.ndarray:
    """Autocorrelation of the onsets without its slow trend and without the shortest lags."""
    x = np.asarray(onsets, float)
    if len(x) < 8:
        return np.zeros(0)
    x = x - x.mean()
    n = 1 << (2 * len(x) - 1).bit_length()
    power = np.abs(np.fft.rfft(x, n)) ** 2
    r = np.fft.irfft(power, n)[: min(len(x), most)]
    if abs(r[0]) <= 1e-12:
        return np.zeros(0)
    r = r / abs(r[0])
    width = min(51, len(r) - (len(r) % 2 == 0))
    if width >= 3:
        r = r - np.convolve(r, np.full(width, 1 / width), "same")
    return r[5:] if len(r) > 10 else r


def hypotheses(onsets: np.ndarray, seconds: float) -> list[dict]:
    """Tempos (onsets in hundredths of a second): local maxima of the autocorrelation between 0.3 and 1.5 s."""
    x = np.asarray(onsets, float)
    if len(x) < 320 or x.max(initial=0) <= 1e-6:
        return []
    x = smoothed(x)
    x = x - x.mean()
    lags = range(30, min(151, len(x) // 3))
    score = []
    for lag in lags:
        a, b = x[:-lag], x[lag:]
        size = np.sqrt((a @ a) * (b @ b))
        score.append(float(a @ b / size) if size else 0.0)
    peaks = [k for k, s in enumerate(score) if s >= 0.2 and (k == 0 or s >= score[k - 1]) and (k + 1 == len(score) or s >= score[k + 1])]
    out = []
    for k in sorted(peaks, key=lambda k: -round(score[k], 6))[:5]:
        beats = seconds / (lags[k] * 0.01)
        out.append({"bpm": round(60 / (lags[k] * 0.01), 3), "beats": round(beats, 3), "groups_of_4": round(beats / 4, 3), "groups_of_8": round(beats / 8, 3), "correlation": round(score[k], 6)})
    return out


def onset_envelope(samples: Column, frame: int = 400, hop: int = 160) -> Column:
    """D1"""
    return _over("array<double>", lambda x: envelope(x, frame, hop), samples)


def long_envelope(chunks: DataFrame, frame: int = 400, hop: int = 160) -> DataFrame:
    """D1 of recordings that stand in rows of chunks (track_id, chunk from 0, samples), each but the last a multiple of hop
    and at least frame + 4 * hop long: (track_id, chunk, onsets), the frames that begin in each chunk, as of the
    whole recording.

    A chunk borrows the first frame of samples of the next one, then two loudness values of the chunk before and one
    of the next, and the recording's peak comes from all chunks. No row holds more than a chunk and a frame."""
    kind = "array<double>"
    at = [F.col("track_id"), F.col("chunk")]
    ahead = chunks.select("track_id", (F.col("chunk") - 1).alias("chunk"), F.slice("samples", 1, frame).alias("_more"))
    own = chunks.select(*at, F.col("samples").cast(kind).alias("_x")).join(ahead.withColumn("_more", F.col("_more").cast(kind)), ["track_id", "chunk"], "left")

    def loudness(x, more) -> np.ndarray:
        """Of the frames that begin in x, as far as they end in x or what follows."""
        n = len(x)
        x = np.concatenate([x, more[: frame - 1]])
        if len(x) < frame:
            return np.zeros(0)
        power = np.lib.stride_tricks.sliding_window_view(x * x, frame)[: n : hop].mean(axis=1)
        return np.sqrt(power)

    rms = own.select(*at, _over(kind, loudness, F.col("_x"), F.coalesce("_more", F.array().cast(kind))).alias("_rms"))
    last = lambda k: rms.select("track_id", (F.col("chunk") + 1).alias("chunk"), F.slice("_rms", F.greatest(F.lit(1), F.size("_rms") - k + 1), k).alias("_before"))
    first = rms.select("track_id", (F.col("chunk") - 1).alias("chunk"), F.slice("_rms", 1, 1).alias("_after"))
    none = F.array().cast(kind)
    j = rms.join(last(2), ["track_id", "chunk"], "left").join(first, ["track_id", "chunk"], "left")

    def rises(x, before, after) -> np.ndarray:
        """Smoothed rises of x; with nothing before or after, the recording begins or ends here."""
        y = np.concatenate([before, x, after])
        if not len(x):
            return np.zeros(0)
        rise = np.maximum(0, np.diff(y, prepend=y[0]))
        return smoothed(rise)[len(before) : len(before) + len(x)]

    # without a frame of its own a last chunk lends none, and the chunk before it is the end
    out = j.select(*at, _over(kind, rises, F.col("_rms"), F.coalesce("_before", none), F.coalesce("_after", none)).alias("_o"))
    top = out.groupBy("track_id").agg(F.max(F.coalesce(F.array_max("_o"), F.lit(0.0))).alias("_top"))
    return out.join(top, "track_id").select(*at, F.when(F.col("_top") > 0, F.transform("_o", lambda v: v / F.col("_top"))).otherwise(F.col("_o")).alias("onsets"))


def lag_correlation(a: Column, b: Column, most: int) -> Column:
    """struct(correlation, lag)"""

    @F.pandas_udf("correlation double, lag int")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_lag(p, q, most) if p is not None and q is not None else (None, None) for p, q in zip(x, y, strict=True)], columns=["correlation", "lag"])

    return run(a, b)


def rhythm_signature(onsets: Column) -> Column:
    """D3"""
    return _over("array<double>", signature, onsets)


def pattern_correlation(a: Column, b: Column) -> Column:
    """D3: correlation of two rhythm signatures"""

    def score(x, y):
        p, q = signature(x), signature(y)
        return best_lag(p, q, min(20, max(0, min(len(p), len(q)) - 4)))[0]

    return _over("double", score, a, b)


def rhythm_hypotheses(tracks: DataFrame) -> DataFrame:
    """The five best tempos of each row (track_id, onsets, seconds)."""
    kind = "array<struct<bpm:double,beats:double,groups_of_4:double,groups_of_8:double,correlation:double>>"
    found = tracks.select("track_id", _over(kind, hypotheses, F.col("onsets"), F.col("seconds")).alias("h"))
    return found.select("track_id", F.posexplode("h").alias("place", "h")).select("track_id", "place", "h.*")


def rhythm_mapping(occurrences: DataFrame, policy: RhythmPolicy = RhythmPolicy(), rate: int = 16_000) -> DataFrame:
    """Each occurrence (group_id, occurrence, onsets, duration, risks) against its group's representative
    (representative: true): pattern correlation, lag, duration ratio and whether that is sure enough."""
    most = max(0, round(policy.max_lag_seconds * rate / policy.hop_samples))
    rep = occurrences.where("representative").select("group_id", F.col("onsets").alias("_o"), F.col("duration").alias("_d"))
    j = occurrences.where("NOT representative").join(rep, "group_id")
    lag = lag_correlation(F.col("_o"), F.col("onsets"), most)
    ratio = F.col("duration") / F.col("_d")
    out = j.select("group_id", "occurrence", pattern_correlation(F.col("_o"), F.col("onsets")).alias("correlation"), (lag["lag"] * policy.hop_samples / rate).alias("lag_seconds"), ratio.alias("duration_ratio"), F.abs(ratio - 1).alias("drift"), (F.size("risks") > 0).alias("risky"))
    sure = (F.col("correlation") >= policy.least_correlation) & (F.col("drift") <= policy.most_drift) & ~F.col("risky")
    return out.withColumn("sure", sure)


def audio_stability(samples: DataFrame) -> DataFrame:
    """Rms, silent and clipped shares and the score of rows (track_id, samples), by functions on arrays. A recording
    without samples is silent and scores 0."""
    n = F.greatest(F.lit(1), F.size("samples"))
    total = lambda f: F.aggregate(F.transform("samples", f), F.lit(0.0), lambda a, x: a + x)
    share = lambda test: F.size(F.filter("samples", test)) / n
    bare = F.size("samples") == 0
    out = samples.where("samples IS NOT NULL").select("track_id", F.sqrt(total(lambda x: x.cast("double") * x.cast("double")) / n).alias("rms"), F.when(bare, 1.0).otherwise(share(lambda x: F.abs(x) < 0.002)).alias("silent_ratio"), share(lambda x: F.abs(x) >= 0.999).alias("clip_ratio"))
    return out.withColumn("score", F.least(F.lit(1.0), F.col("rms") / 0.08) * (1 - F.col("silent_ratio")) * (1 - F.col("clip_ratio")))


def waveform_peaks(samples: DataFrame, n: int) -> DataFrame:
    """N equal buckets of each row's samples (track_id, samples), the greatest absolute value of each, divided by the
    row's greatest. Arrays are cut in place; nothing is exploded but the buckets."""
    size = F.size("samples")
    edge = lambda k: F.rint(k * size / F.lit(n)).cast("int")
    k = F.col("k")
    cut = samples.select("track_id", "samples", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    part = F.slice("samples", edge(k) + 1, F.greatest(F.lit(0), edge(k + 1) - edge(k)))
    peaks = cut.select("track_id", "k", F.coalesce(F.array_max(F.transform(part, lambda x: F.abs(x.cast("double")))), F.lit(0.0)).alias("p"))
    top = F.max("p").over(Window.partitionBy("track_id"))
    return peaks.select("track_id", "k", F.when(top > 0, F.floor(F.col("p") / top * 10000 + 0.5) / 10000).otherwise(0.0).alias("peak"))


def representative(occurrences: DataFrame) -> DataFrame:
    """The best occurrence of each group (asr, peer, stability, clean, boundary: shares from 0 to 1), first on ties."""
    score = 0.35 * F.col("asr") + 0.30 * F.col("peer") + 0.20 * F.col("stability") + 0.10 * F.col("clean") + 0.05 * F.col("boundary")
    w = Window.partitionBy("group_id").orderBy(F.desc("score"), "occurrence")
    return occurrences.withColumn("score", score).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def occurrence_quality(cues: DataFrame, occurrences: DataFrame, durations: DataFrame) -> DataFrame:
    """Of each occurrence (section_id, occurrence, first, last: positions) its start and end, the share of its cues
    (section_id, pos, start, end, evidence) whose evidence was heard, and how far it stands from the section's ends as a
    share of half its duration (section_id, duration)."""
    heard = F.lower(F.concat_ws(" ", "evidence")).rlike("asr|word|vocal")
    own = occurrences.select(F.col("section_id").alias("_s"), "occurrence", "first", "last")
    j = cues.join(own, (F.col("section_id") == F.col("_s")) & F.col("pos").between(F.col("first"), F.col("last")))
    g = j.groupBy("section_id", "occurrence").agg(F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.avg(heard.cast("int")).alias("_c"))
    micro = lambda x: F.bround(x, 6)
    edge = F.least(F.col("start"), F.greatest(F.lit(0.0), F.col("duration") - F.col("end")))
    near = F.least(F.lit(1.0), edge / F.greatest(F.lit(1.0), F.col("duration") / 2))
    return g.join(durations, "section_id").select("section_id", "occurrence", "start", "end", micro(F.col("_c")).alias("evidence_coverage"), micro(near).alias("boundary_score"))
