"""The causal subset as Structured Streaming: hourly aggregates with a watermark, and the filters as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyloom.functions import columns as c
from skyloom.operators.kernels import TrendNoise, first_trend, next_trend


def hourly_stream(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Means by hour and station of a stream with ts, station, ws and wd; rows later than `late` are dropped by the watermark."""
    return (
        stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "station")
        .agg(F.count("*").alias("n"), F.avg("ws").alias("ws"), c.circular_mean("wd").alias("wd"), F.max("ws").alias("peak"))
        .select(F.col("w.start").alias("hour"), "station", "n", "ws", "wd", "peak")
    )


def sessions_stream(stream: DataFrame, gap: str = "10 minutes", late: str = "2 hours") -> DataFrame:
    """Events of a station that follow one another within `gap`."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "station").agg(F.count("*").alias("n"), F.max("ws").alias("peak")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "station", "n", "peak")


def filtered_stream(stream: DataFrame, noise: TrendNoise = TrendNoise(), keep: int = 30) -> DataFrame:  # noqa: B008
    """Level, trend and trailing mean of `keep` rows for each row of a stream (station, ts, ws), in order within a batch.

    The state of a station is the filter's five numbers and a ring of the last values: bounded. The step is that of the batch filter.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        trend, ring = (tuple(state.get[:5]), list(state.get[5])) if state.exists else (None, [])
        out = []
        for row in pd.concat(list(batches)).sort_values("ts").itertuples(index=False):
            trend = next_trend(trend or first_trend(float(row.ws), noise), float(row.ws), noise)
            ring = [*ring, float(row.ws)][-keep:]
            out.append((key[0], row.ts, trend[0], trend[1], sum(ring) / len(ring)))
        state.update((*trend, ring))
        yield pd.DataFrame(out, columns=["station", "ts", "level", "trend", "trailing"])

    return stream.groupBy("station").applyInPandasWithState(
        advance, "station long, ts timestamp, level double, trend double, trailing double", "level double, trend double, top double, side double, corner double, ring array<double>", "append", GroupStateTimeout.NoTimeout
    )
