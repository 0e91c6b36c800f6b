"""Neighbourhoods as rows: a target with arrays of its neighbours, solved in Arrow batches by NumPy kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gather(neighbours: DataFrame, fields: Sequence[str], name: str) -> DataFrame:
    """(k, <name>): a target's neighbours in their order, nmax at most, as an array of structs."""
    item = F.struct("place", *fields)
    return neighbours.groupBy("k").agg(F.sort_array(F.collect_list(item)).alias(name))


def matrix(items, fields: Sequence[str]) -> np.ndarray:
    """Neighbours × fields of one row's array; empty for null."""
    if items is None or len(items) == 0:
        return np.zeros((0, len(fields)))
    return np.array([[np.nan if i[f] is None else i[f] for f in fields] for i in items], dtype=float)


def solve_rows(rows: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Applies a kernel to batches of gathered rows, dealt over all shuffle partitions: rows are small and kernels are not, so partitions must not be coalesced by bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield kernel(pdf)

    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.columns[0])
    return dealt.mapInPandas(run, schema)
