"""Dense and sparse forms, relations between levels, and stored labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.errors import EXAMPLES, InputPreparationError, some
from quantloom.operators.axis import q
from quantloom.operators.joins import block_lookup
from quantloom.result import OBS, VAR


def to_sparse(wide: DataFrame, row: str, columns: dict[str, int], value: str = "value", fill=None) -> DataFrame:
    """Cells of a dense table that differ from the fill: row, obs_pos, value."""
    cells = wide.select(q(row), F.explode(F.array(*[F.struct(F.lit(p).cast("long").alias(OBS), q(c).alias(value)) for c, p in columns.items()])).alias("_c")).select(q(row), f"_c.{OBS}", f"_c.{value}")
    keep = F.col(value).isNotNull() if fill is None else ~F.col(value).eqNullSafe(F.lit(fill)) & F.col(value).isNotNull()
    return cells.filter(keep)


def to_dense(cells: DataFrame, rows: DataFrame, row: str, labels: list[int], value: str = "value", fill=None) -> DataFrame:
    """One row for each of ``rows`` and one column a label; absent cells are the fill."""
    wide = rows.select(q(row)).join(cells.groupBy(q(row)).pivot(OBS, labels).agg(F.first(value)), row, "left")
    return wide.select(q(row), *[(F.coalesce(q(str(p)), F.lit(fill)) if fill is not None else q(str(p))).alias(str(p)) for p in labels])


def level_offsets(sizes: DataFrame) -> DataFrame:
    """First global position of each level; ``sizes`` has level, order and size (a row a level)."""
    from pyspark.sql import Window

    before = Window.orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("level", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("start"))


def to_global(edges: DataFrame, offsets: DataFrame) -> DataFrame:
    """Edges between levels as (row, column, value) over all features."""
    a = F.broadcast(offsets.select(F.col("level").alias("source"), F.col("start").alias("_a")))
    b = F.broadcast(offsets.select(F.col("level").alias("target"), F.col("start").alias("_b")))
    return edges.join(a, "source").join(b, "target").select((F.col("row") + F.col("_a")).alias("row"), (F.col("column") + F.col("_b")).alias("column"), "value")


def to_levels(flat: DataFrame, offsets: DataFrame) -> DataFrame:
    """The inverse: which levels a global row and column fall in, and where."""
    side = lambda df, column, level: block_lookup(df, offsets.select(F.col("start").alias("_s"), F.col("level").alias(level)), column, "_s").withColumn(column, q(column) - F.col("_s")).drop("_s")
    return side(side(flat, "row", "source"), "column", "target").select("source", "row", "target", "column", "value")


def json_label(*columns: Column) -> Column:
    """Several (or typed) key columns as one stored label."""
    return F.to_json(F.array(*[c.cast("string") for c in columns]), {"ignoreNullFields": "false"})


def embedded_json(col: Column, schema: str) -> Column:
    """JSON text inside a column as a typed value; broken text is null."""
    return F.from_json(col, schema, {"mode": "PERMISSIVE"})


def with_samples(rows: DataFrame, samples: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """Rows with what is known of their sample; broadcast while the sample table is counted small."""
    return rows.join(F.broadcast(samples) if samples.count() <= most else samples, key, "left")


def placeable_factors(df: DataFrame, key: str, factor: str, value: str) -> DataFrame:
    """Factors with at most one value for each key, which can stand as columns of the key's axis."""
    each = df.groupBy(q(key), q(factor)).agg(F.count_distinct(q(value)).alias("_n"), F.count("*").alias("_rows"))
    return each.groupBy(q(factor)).agg(F.count("*").alias("n_keys"), F.sum("_rows").alias("n_rows"), (F.max("_n") <= 1).alias("placeable"))


def surviving(disagreements: DataFrame, axis: DataFrame, keys: list[str]) -> DataFrame:
    """Disagreements of keys that are still on the axis."""
    on = None
    for k in keys:
        same = disagreements[f"`{k}`"].eqNullSafe(axis[f"`{k}`"])
        on = same if on is None else on & same
    return disagreements.join(axis, on, "left_semi")


def require_square(cells: DataFrame, n_obs: int, n_var: int) -> None:
    """Cells lie on the grid."""
    bad = cells.filter((q(OBS) < 0) | (q(OBS) >= n_obs) | (q(VAR) < 0) | (q(VAR) >= n_var)).select(VAR, OBS).limit(EXAMPLES).collect()
    if bad:
        raise InputPreparationError(f"cells outside {n_obs} x {n_var}: {some(tuple(r) for r in bad)}")
