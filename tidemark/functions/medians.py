"""Medians of all rows so far, in n log n: two heaps walk along each series, instead of a percentile over an ever-growing frame."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heappushpop

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType


class Running:
    """The median of the values added so far: the lower half in a heap of negated values, the upper half in another."""

    def __init__(self) -> None:
        self.lower: list[float] = []
        self.upper: list[float] = []

    def add(self, x: float) -> None:
        if len(self.lower) == len(self.upper):
            heappush(self.lower, -heappushpop(self.upper, x))
        else:
            heappush(self.upper, -heappushpop(self.lower, -x))

    @property
    def median(self) -> float | None:
        if len(self.lower) > len(self.upper):
            return -self.lower[0]
        return 0.5 * -self.lower[0] + 0.5 * self.upper[0] if self.lower else None


def with_expanding_median(df: DataFrame, value: str, name: str, key: str = "symbol", by: str = "date") -> DataFrame:
    """Adds the median of `value` over the rows so far of each series, this one included; missing values don't count, and before the first one there is none.

    Rows are shuffled by the key and sorted, as a window would have it, and stream through a task in batches; of a series the task keeps its values (32 bytes or so each),
    not its rows. All other columns pass through as they are.
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), Running()
        for b in batches:
            out = []
            for k, v in zip(b.column(key).to_pylist(), b.column(value).to_pylist(), strict=True):
                if k != now:
                    now, state = k, Running()
                if v is not None:
                    state.add(v)
                out.append(state.median)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, name])

    rows = df.repartition(key).sortWithinPartitions(key, by)
    return rows.mapInArrow(run, StructType(df.schema.fields).add(name, DoubleType()))
