"""Structured Streaming forms: windowed means with a watermark, an outlier test and a filter with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(events: DataFrame, window: str, late: str, by: str = "site", ts: str = "ts") -> DataFrame:
    """(window, site, n, mean, sd) of tumbling windows; events later than `late` are left out. Works on streams and on tables.

    Of a table, events without a time have a null window; a stream leaves them out.
    """
    stats = (F.count("z").alias("n"), F.avg("z").alias("mean"), F.stddev_pop("z").alias("sd"))
    timed = events.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(*stats)
    if events.isStreaming:
        return timed
    untimed = events.where(F.col(ts).isNull()).groupBy(by).agg(*stats)
    return timed.unionByName(untimed.withColumn("window", F.lit(None).cast(timed.schema["window"].dataType)))


def _kalman_step(q: float, r: float, p0: float):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        x, p = state.get if state.exists else (0.0, p0)
        out = []
        for pdf in batches:
            for t, z in zip(pdf["ts"], pdf["z"], strict=True):
                p += q
                gain = p / (p + r)
                x, p = x + gain * (z - x), (1 - gain) * p
                out.append((key[0], t, x, p))
        state.update((x, p))
        yield pd.DataFrame(out, columns=["site", "ts", "xf", "pf"])

    return run


def kalman_stream(events: DataFrame, q: float, r: float, p0: float = 1e3) -> DataFrame:
    """A scalar random-walk filter per site with its state in the state store, in order of arrival within a batch."""
    return events.groupBy("site").applyInPandasWithState(_kalman_step(q, r, p0), "site long, ts timestamp, xf double, pf double", "x double, p double", "append", "NoTimeout")
