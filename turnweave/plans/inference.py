"""Scores from a user's function over sliding chunks of audio.

The function gets a batch of chunks as a pandas Series of sample lists and returns a Series of score
lists (frames by classes, flattened); it runs as a pandas UDF, and everything around it is native."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.operators import frames
from turnweave.runtime import ship_package


def audio_chunks(audio: DataFrame, duration: float, step: float) -> DataFrame:
    """Complete chunks at every step and a zero-padded last one if samples are left over: uri, chunk, samples."""
    rate = F.col("sample_rate")
    size, hop = F.rint(F.lit(duration) * rate).cast("int"), F.rint(F.lit(step) * rate).cast("int")
    n = F.size("samples")
    whole = F.greatest(F.floor((n - size) / hop) + 1, F.lit(0)).cast("int")
    extra = ((n < size) | ((n - size) % hop > 0)).cast("int")
    rows = audio.withColumn("chunk", F.explode(F.sequence(F.lit(0), whole + extra - 1)))
    part = F.slice("samples", F.col("chunk") * hop + 1, size)
    return rows.select("uri", F.col("chunk").cast("long").alias("chunk"), F.concat(part, F.array_repeat(F.lit(0.0), size - F.size(part))).alias("samples"), "sample_rate")


def infer_whole(audio: DataFrame, score: Callable[[pd.Series], pd.Series], classes: int = 1) -> DataFrame:
    """Scores of whole files, without chunks: uri, frame, k, score. For a function that gives one vector a file, ``classes`` is its length and the frame 0."""
    ship_package(audio.sparkSession)
    apply = F.pandas_udf(score, "array<double>")
    rows = audio.select("uri", F.posexplode(apply("samples")).alias("i", "score"))
    return rows.select("uri", F.expr(f"i div {classes}").cast("long").alias("frame"), (F.col("i") % classes).cast("long").alias("k"), "score")


def infer_crop(audio: DataFrame, regions: DataFrame, score: Callable[[pd.Series], pd.Series], classes: int = 1) -> DataFrame:
    """Scores of parts of files (uri, start, end in seconds), each as a whole: uri, start, end, frame, k, score."""
    rate = F.col("sample_rate")
    a, n = F.floor(F.col("start") * rate).cast("int"), F.rint((F.col("end") - F.col("start")) * rate).cast("int")
    parts = audio.join(regions.select("uri", "start", "end"), "uri").withColumn("samples", F.slice("samples", a + 1, n))
    ship_package(audio.sparkSession)
    apply = F.pandas_udf(score, "array<double>")
    rows = parts.select("uri", "start", "end", F.posexplode(apply("samples")).alias("i", "score"))
    return rows.select("uri", "start", "end", F.expr(f"i div {classes}").cast("long").alias("frame"), (F.col("i") % classes).cast("long").alias("k"), "score")


def infer(audio: DataFrame, score: Callable[[pd.Series], pd.Series], classes: int, duration: float, step: float | None = None, pre_aggregation: Callable[[DataFrame], DataFrame] | None = None, skip_aggregation: bool = False, frame_step: float | None = None, frames_per_chunk: int | None = None) -> DataFrame:
    """chunk_frames (uri, chunk, frame, k, score), or their overlap-add on the frames of the file. A step is a tenth of the duration by default and no longer than it."""
    step = step or 0.1 * duration
    if step > duration:
        raise ValueError("the step is longer than the chunks")
    ship_package(audio.sparkSession)
    apply = F.pandas_udf(score, "array<double>")
    rows = audio_chunks(audio, duration, step).select("uri", "chunk", F.posexplode(apply("samples")).alias("i", "score"))
    scores = rows.select("uri", "chunk", F.expr(f"i div {classes}").alias("frame"), (F.col("i") % classes).cast("long").alias("k"), "score")
    if pre_aggregation:
        scores = pre_aggregation(scores)
    if skip_aggregation:
        return scores
    if not frame_step or not frames_per_chunk:
        raise ValueError("aggregation needs the frames' step and number")
    return frames.overlap_add(scores, frames_per_chunk, step, frame_step)
