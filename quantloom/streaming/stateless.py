"""Operators over streams.

Row-wise operators (projection, absence, coercion, value parsing, factor codes,
markers) run on a streaming DataFrame as they are.  What follows row order or
sees a whole cell runs per micro-batch, merged into a maintained table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quantloom.functions.values import blank_to_null
from quantloom.operators.axis import q
from quantloom.operators.layers import Layer


def clean(df: DataFrame) -> DataFrame:
    """Blanks and NaN to null, rows without anything dropped; works on streams."""
    out = df.select(*[blank_to_null(q(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
    present = F.lit(False)
    for c in out.columns:
        present = present | q(c).isNotNull()
    return out.filter(present)


def parse(df: DataFrame, layers: list[Layer]) -> DataFrame:
    """Layer values of a stream, each by its own rules."""
    values = {x.name: x.parsed(df) for x in layers}
    return df.select(*[values[c].alias(c) if c in values else q(c) for c in df.columns])


def windowed_sums(df: DataFrame, time: str, keys: list[str], value: str, width: str, late: str) -> DataFrame:
    """Sums of tumbling windows; rows later than ``late`` are not counted."""
    own = df.withWatermark(time, late).groupBy(F.window(q(time), width).alias("window"), *[q(k) for k in keys])
    return own.agg(F.sum(q(value)).alias(value), F.count("*").alias("n_rows"))


def per_batch(df: DataFrame, apply: Callable[[DataFrame], DataFrame], path: str) -> DataStreamWriter:
    """Run a batch operator on every micro-batch; a repeated batch replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        apply(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(write)
