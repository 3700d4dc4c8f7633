"""Rows dealt over tasks. A table of few bytes is read by one task, and a small shuffle is joined into one, however much work its rows are."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: tasks a core
TASKS = 3


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt over tasks by the hash of the columns, for work that is long for the bytes of a row."""
    return df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism, *columns)
