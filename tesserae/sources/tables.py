"""Reading tables, and making as a data source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_made(df: DataFrame, path: str, files: int | None = None) -> None:
    """Rows are generated where they are written; without `files` there is no shuffle."""
    (df.repartition(files) if files else df).write.mode("overwrite").parquet(path)


def made_view(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> None:
    """A schema's rows under a name that SQL can read; nothing is stored."""
    make().createOrReplaceTempView(name)
