"""New columns from the text of each row, in Arrow batches, whatever the other columns are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import slices


def with_columns(docs: DataFrame, inputs: list[Column], new: str, make: Callable[..., list[pa.Array]], drop: tuple[str, ...] = ()) -> DataFrame:
    """docs without `drop`, plus the columns of the DDL text `new`, which `make` computes from slices of the inputs (the first is
    a text and bounds a slice). Rows stay; columns named like a new one, in any case, are replaced."""
    added = StructType.fromDDL(new)
    lost = {c.lower() for c in (*drop, *added.names)}
    keep = [c for c in docs.columns if c.lower() not in lost]
    row = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in keep)) if keep else F.struct(F.lit(0).alias("none"))
    rows = docs.select(row.alias("row"), *(c.alias(f"in{i}") for i, c in enumerate(inputs)))
    schema = StructType([rows.schema["row"], *added.fields])
    names, n = schema.names, len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "in0"):
            yield pa.RecordBatch.from_arrays([part.column(0), *make(*(part.column(i + 1) for i in range(n)))], names=names)

    made = rows.mapInArrow(run, schema)
    return made.select(*(["row.*"] if keep else []), *(f"`{c}`" for c in added.names))



def unused(columns: list[str]) -> str:
    """A prefix that none of the columns begins with, in any case."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix
