"""Joins whose cardinality is part of their meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.errors import EXAMPLES, InputPreparationError, some
from quantloom.functions.text import quoted
from quantloom.operators.axis import q
from quantloom.store.shared import written


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equality that matches missing with missing; planned as a hash or merge join."""
    on = None
    for a, b in pairs:
        same = left[f"`{a}`"].eqNullSafe(right[f"`{b}`"])
        on = same if on is None else on & same
    return on


def require_unique(df: DataFrame, keys: list[str], what: str, nulls: bool = False) -> None:
    """Keys are unique and, unless allowed, present."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | q(k).isNull()
    if not nulls and df.filter(missing).limit(1).count():
        raise InputPreparationError(f"{what} has rows without {', '.join(keys)}")
    bad = df.groupBy(*[q(k) for k in keys]).count().filter("count > 1").limit(EXAMPLES).collect()
    if bad:
        raise InputPreparationError(f"{what} repeats {', '.join(keys)}: {some(tuple(r)[:-1] for r in bad)}")


def left_unique(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], what: str, check: bool = True) -> DataFrame:
    """Left join with at most one match a row (m:1)."""
    if check:
        require_unique(right, [b for _, b in pairs], what, nulls=True)
    return left.join(right, null_safe(left, right, pairs), "left")


def require_referenced(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], what: str) -> None:
    """Every present key of the left side exists on the right (anti join is empty)."""
    keys = [a for a, _ in pairs]
    present = F.lit(True)
    for k in keys:
        present = present & q(k).isNotNull()
    bad = left.filter(present).join(right, null_safe(left, right, pairs), "left_anti").select(*[q(k) for k in keys]).distinct().limit(EXAMPLES).collect()
    if bad:
        raise InputPreparationError(f"{what}: no match for {some(tuple(r) for r in bad)}")


def exploded_ids(df: DataFrame, keep: dict[str, str], ids: str, name: str, delimiter: str = ";") -> DataFrame:
    """One row for each id of a packed id list; a row without ids gives a null id."""
    token = F.explode_outer(F.split(q(ids).cast("string"), quoted(delimiter)))
    rows = df.select(*[q(c).cast("string").alias(n) for c, n in keep.items()], token.alias(name))
    return rows.withColumn(name, F.when(F.trim(q(name)) != "", F.trim(q(name))))


def relationships(links: list[tuple[str, DataFrame]], on: str) -> DataFrame:
    """Tuples of related features: full outer joins on a shared id, then without it, distinct.

    The relation of ids alone is collapsed before any wide column is joined to it.
    """
    out = None
    for _, frame in links:
        out = frame if out is None else out.join(frame, on, "full")
    return out.drop(on).distinct()


def block_lookup(values: DataFrame, blocks: DataFrame, position: str, start: str) -> DataFrame:
    """The block a global position falls in: greatest start at or below it (as-of, backward).

    Positions and starts go through one sort of their union in ranges of starts,
    so it stays an equi-partitioned window; no cross product is made.
    """
    marks = blocks.select(q(start).alias("_at"), F.struct(*[q(c).alias(c) for c in blocks.columns]).alias("_block"), F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in values.schema.fields) + ">").alias("_row"))
    rows = values.select(q(position).alias("_at"), F.lit(None).cast(marks.schema["_block"].dataType).alias("_block"), F.struct(*[q(c).alias(c) for c in values.columns]).alias("_row"))
    both = written(marks.unionByName(rows).repartitionByRange("_at").withColumn("_p", F.spark_partition_id()), "blocks")
    order = Window.partitionBy("_p").orderBy("_at", F.col("_row").isNotNull())
    local = both.withColumn("_own", F.last("_block", ignorenulls=True).over(order))
    tails = both.filter(F.col("_block").isNotNull()).groupBy("_p").agg(F.max_by("_block", "_at").alias("_tail"))
    tails = both.select("_p").distinct().join(tails, "_p", "left")
    carried = tails.select(F.col("_p").alias("_q"), F.last("_tail", ignorenulls=True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    done = local.filter(F.col("_row").isNotNull()).join(F.broadcast(carried), F.col("_p") == F.col("_q"))
    return done.select("_row.*", F.coalesce("_own", "_carry").alias("_b")).filter(F.col("_b").isNotNull()).select(*[q(c) for c in values.columns], "_b.*")


def spread_factor(df: DataFrame, keys: list[str], factor: str, value: str, factors: list[str], order: str) -> DataFrame:
    """One column for each factor value: the first value in row order."""
    rows = df.groupBy(*[q(k) for k in keys]).pivot(factor, factors)
    return rows.agg(F.min_by(q(value), q(order)))


def fold_rows(df: DataFrame, keys: list[str], columns: list[str], order: str, separator: str = "|") -> DataFrame:
    """One row a key: a column's one value, or all distinct rows' values joined in order.

    Missing counts as a value and is written ``null``.
    """
    rows = df.groupBy(*[q(k) for k in keys], *[q(c) for c in columns]).agg(F.min(q(order)).alias("_o"))
    out = []
    for i, c in enumerate(columns):
        v = q(c).cast("string")
        one = F.min(v).eqNullSafe(F.max(v)) & ((F.count(v) == F.count("*")) | (F.count(v) == 0))
        listed = F.array_sort(F.collect_list(F.struct("_o", F.coalesce(v, F.lit("null")).alias("v"))))
        out.append(F.when(one, F.min(v)).otherwise(F.array_join(F.transform(listed, lambda x: x["v"]), separator)).alias(c))
    return rows.groupBy(*[q(k) for k in keys]).agg(*out)
