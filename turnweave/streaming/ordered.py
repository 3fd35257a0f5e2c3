"""Streaming forms of the ordered operators. An engine extra: batch and stream give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnweave.runtime import ship_package


def hysteresis_stream(frames: DataFrame, onset: float, offset: float | None = None, initial: bool = False) -> DataFrame:
    """Streamed scores (uri, frame, score) with ``active``: the state of each uri is one boolean.

    Frames of a uri must arrive in order from batch to batch; within a batch they are sorted."""
    ship_package(frames.sparkSession)
    off = onset if offset is None else offset

    def each(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on = state.get[0] if state.exists else initial
        pdf = pd.concat(list(parts)).sort_values("frame", kind="stable")
        out = []
        for y in pdf["score"].fillna(0.0):
            on = True if y > onset else False if y < off else on
            out.append(on)
        state.update((on,))
        yield pdf.assign(active=out)[["uri", "frame", "score", "active"]]

    return frames.select("uri", "frame", "score").groupBy("uri").applyInPandasWithState(each, "uri string, frame long, score double, active boolean", "active boolean", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str, late: str, time: str = "ts", keys: tuple[str, ...] = ("uri",)) -> DataFrame:
    """Sessions of events no further apart than the gap, closed once the watermark has passed them: the streaming form of gap filling."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(*keys, w.alias("session")).agg(F.count(F.lit(1)).alias("events")).select(*keys, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "events")


def speaking_time_stream(turns: DataFrame, window: str, late: str, time: str = "ts") -> DataFrame:
    """Speaking time of each label in tumbling windows."""
    return turns.withWatermark(time, late).groupBy("uri", "label", F.window(time, window).alias("w")).agg(F.sum("duration").alias("duration"), F.count(F.lit(1)).alias("turns")).select("uri", "label", F.col("w.start").alias("start"), "duration", "turns")
