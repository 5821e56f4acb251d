"""The same columns on a stream: rows are a function of their key, so batch and stream agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.instance import Maker, _fresh


def make_stream(maker: Maker, rows_per_second: int = 10) -> DataFrame:
    """timestamp, and a row for each tick of the rate source, whose numbers are dense from 0."""
    ticks = maker.instance.spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return make_on_stream(maker, ticks, "value", ["timestamp"], dense_from=0)


def make_on_stream(maker: Maker, stream: DataFrame, key: str, keep: list[str] | None = None, dense_from: int | None = None) -> DataFrame:
    """As make_onto(). A stream can't rank its keys: sequences need keys that are known to be dense, and the first of them; without that they are refused."""
    row = _fresh(["_row"], [*stream.columns, *maker.names()])
    sequence = None if dense_from is None else F.col(row) - F.lit(dense_from) + F.lit(1)
    return maker._select(stream.withColumn(row, F.col(f"`{key}`")), keep if keep is not None else [key], lambda raw: maker.compile(F.col(row), sequence, raw=raw))
