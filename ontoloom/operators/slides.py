"""Slides in sequences of frames: samples, distances, noise thresholds and transitions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import dot


def samples(videos: DataFrame, step: int = 12) -> DataFrame:
    """video, frame: every step-th frame from the first on, and the last, of videos(video, frames)."""
    at = F.when(F.col("frames") > step, F.sequence(F.lit(1), F.col("frames") - step, F.lit(step))).otherwise(F.array().cast("array<int>"))
    at = F.array_distinct(F.concat(at, F.array(F.col("frames"))))
    return videos.where("frames > 0").select("video", F.explode(at).alias("frame"))


def steps(frames: DataFrame) -> DataFrame:
    """video, frame, before, distance: how far each frame of frames(video, frame, vector) is from the one before it."""
    w = Window.partitionBy("video").orderBy("frame")
    rows = frames.select("video", "frame", "vector", F.lag("frame").over(w).alias("before"), F.lag("vector").over(w).alias("last"))
    return rows.where("before is not null").select("video", "frame", "before", (1 - dot(F.col("vector"), F.col("last"))).alias("distance"))


def thresholds(distances: DataFrame, low: float = 0.0001, high: float = 0.01, times: float = 5.0, default: float = 0.05) -> DataFrame:
    """video, threshold: some times the median of the distances that are noise, or a default without any."""
    noise = F.when((F.col("distance") > low) & (F.col("distance") < high), F.col("distance"))
    return distances.groupBy("video").agg(F.coalesce(F.median(noise) * times, F.lit(default)).alias("threshold"))


Judge = Callable[[int, int], tuple[bool, float]]


def transition(judge: Judge, left: int, right: int) -> tuple[int, float] | None:
    """Where between two frames a slide changes, by halving; judge says whether two frames differ, and by how much.

    Neighbours are taken as they are.  Of two halves that both change, the one with the greater distance counts, the
    first of equals.
    """
    differ, distance = judge(left, right)
    middle = (left + right) // 2
    if middle in (left, right):
        return left, distance
    if not differ:
        return None
    found = [x for x in (transition(judge, left, middle), transition(judge, middle, right)) if x]
    return max(found, key=lambda x: x[1]) if found else None


def transitions(judge: Judge, sampled: list[int]) -> list[int]:
    """The frames at which slides change between sampled ones, with the first and the last, unless these repeat others."""
    if not sampled:
        return []
    found = [transition(judge, a, b) for a, b in zip(sampled, sampled[1:])]
    out = [sampled[0], *(x[0] for x in found if x and x[0] < sampled[-1]), sampled[-1]]
    if len(out) >= 2 and not judge(out[0], out[1])[0]:
        out = out[1:]
    if len(out) >= 2 and not judge(out[-2], out[-1])[0]:
        out = out[:-1]
    return out


def detected(frames: DataFrame, limits: DataFrame, step: int = 12, similar: float = 0.95) -> DataFrame:
    """video, slide: the frames of frames(video, frame, vector) at which a new slide begins.

    Two frames differ if their distance is at least the threshold of limits(video, threshold) and their hashes, of which
    bits are brighter neighbours, agree in at most a share `similar`.  A video is the work of one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        x = np.stack(pdf["vector"].to_numpy()).astype(float)
        bits = x[:, 1:] > x[:, :-1]
        least = float(pdf["threshold"].iloc[0])

        def judge(a: int, b: int) -> tuple[bool, float]:
            distance = float(1 - x[a - 1] @ x[b - 1])
            return distance >= least and float((bits[a - 1] == bits[b - 1]).mean()) <= similar, distance

        n = len(pdf)
        sampled = [*range(1, n - step + 1, step)] if n > step else []
        places = transitions(judge, [*sampled, *([n] if n not in sampled else [])])
        return pd.DataFrame({"video": [pdf["video"].iloc[0]] * len(places), "slide": pdf["frame"].to_numpy()[[p - 1 for p in places]]})

    kind = frames.schema["video"].dataType.simpleString()
    return frames.join(limits, "video").groupBy("video").applyInPandas(run, f"video {kind}, slide long")
