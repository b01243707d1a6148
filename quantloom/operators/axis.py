"""Axes: one row for each key tuple, with a value policy for every payload column.

Row order is data: every function takes the name of an ordinal column, and
"first" and all ties follow it.  A null key component is an identity of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.errors import EXAMPLES, AggregateTypeError, CanonicalKeyCollisionError, some
from quantloom.functions.values import Notation, as_number
from quantloom.store.shared import written


def q(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def field(df: DataFrame, name: str):
    return next(f.dataType for f in df.schema.fields if f.name == name)


@dataclass(frozen=True)
class Policy:
    """How one payload column gets its value: first, min, max or best_row."""

    how: str = "first"
    by: str | None = None  # best_row: the ranking column
    best: str = "highest"


def rank_of(number: Column, best: str, order: Column) -> Column:
    """Sort key of a ranked row: rank, null last, ties in row order."""
    signed = -number if best == "highest" else number
    return F.struct(number.isNull().alias("none"), signed.alias("rank"), order.alias("order"))


def policy_value(df: DataFrame, name: str, policy: Policy, order: str, notation: Notation = Notation()) -> Column:
    """The aggregate of one payload column under its policy."""
    value, at = q(name), q(order)
    if policy.how == "first":
        return F.min_by(value, F.when(value.isNotNull(), at))
    if policy.how in ("min", "max"):
        number = as_number(value, field(df, name), notation)
        number = F.when(~F.isnan(number), number)
        return F.min_by(value, F.when(number.isNotNull(), rank_of(number, "highest" if policy.how == "max" else "lowest", at)))
    if policy.how == "best_row":
        number = as_number(q(policy.by), field(df, policy.by), notation)
        return F.min_by(value, rank_of(F.when(~F.isnan(number), number), policy.best, at))
    raise ValueError(f"unknown policy {policy.how!r}")


def build_axis(df: DataFrame, keys: list[str], payload: list[str], order: str) -> DataFrame:
    """First row of each key tuple, by row order: keys, payload, and the ordinal."""
    if not payload:
        return df.groupBy(*[q(k) for k in keys]).agg(F.min(q(order)).alias(order))
    first = F.min_by(F.struct(*[q(c).alias(f"c{i}") for i, c in enumerate(payload)]), q(order))
    rows = df.groupBy(*[q(k) for k in keys]).agg(F.min(q(order)).alias(order), first.alias("_first"))
    return rows.select(*[q(k) for k in keys], *[F.col(f"_first.c{i}").alias(c) for i, c in enumerate(payload)], q(order))


def build_features(df: DataFrame, keys: list[str], policies: dict[str, Policy], order: str, notation: Notation = Notation()) -> DataFrame:
    """Feature axis in one aggregation: each column by its policy.

    Columns taken by ``first`` get a companion ``<name>?`` that tells whether a key
    has more than one present value.
    """
    out = [F.min(q(order)).alias(order)]
    for name, policy in policies.items():
        out.append(policy_value(df, name, policy, order, notation).alias(name))
        if policy.how == "first":
            out.append((~F.min(q(name)).eqNullSafe(F.max(q(name)))).alias(f"{name}?"))
    return df.groupBy(*[q(k) for k in keys]).agg(*out)


def disagreements(df: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """Keys with several present values of a column, and the first five in row order."""
    present = df.filter(q(name).isNotNull()).groupBy(*[q(k) for k in keys], q(name)).agg(F.min(q(order)).alias("_o"))
    found = present.groupBy(*[q(k) for k in keys]).agg(F.count("*").alias("n_values"), F.array_sort(F.collect_list(F.struct("_o", q(name).alias("v")))).alias("_all")).filter("n_values > 1")
    return found.select(*[q(k) for k in keys], "n_values", F.transform(F.slice("_all", 1, EXAMPLES), lambda x: x["v"]).alias("examples"))


def best_rows(df: DataFrame, keys: list[str], by: str, best: str, order: str) -> DataFrame:
    """The best-ranked row of each key: a semi join of the rows with the winners."""
    number = as_number(q(by), field(df, by))
    winners = df.groupBy(*[q(k).alias(f"_w{i}") for i, k in enumerate(keys)]).agg(F.min_by(q(order), rank_of(number, best, q(order))).alias("_wo"))
    on = q(order) == F.col("_wo")
    for i, k in enumerate(keys):
        on = on & q(k).eqNullSafe(F.col(f"_w{i}"))
    return df.join(winners, on, "left_semi")


def require_numeric(df: DataFrame, name: str, notation: Notation = Notation()) -> None:
    """Present text that is no number ends an aggregate over numbers."""
    number = as_number(q(name), field(df, name), notation)
    bad = df.filter(q(name).isNotNull() & number.isNull()).select(q(name).cast("string").alias("v")).distinct().orderBy("v").limit(EXAMPLES).collect()
    if bad:
        raise AggregateTypeError(f"{name} holds text that is no number, such as {some(r[0] for r in bad)}")


def complete_keys(axis: DataFrame, keys: list[str]) -> DataFrame:
    """Axis rows whose final key has no missing part."""
    keep = F.lit(True)
    for k in keys:
        value = q(k)
        kind = field(axis, k).typeName()
        keep = keep & value.isNotNull() & (~F.isnan(value) if kind in ("double", "float") else F.lit(True))
    return axis.filter(keep)


def require_injective(axis: DataFrame, keys: list[str]) -> None:
    """Each final key comes from one raw row."""
    bad = axis.groupBy(*[q(k) for k in keys]).count().filter("count > 1").limit(EXAMPLES).collect()
    if bad:
        raise CanonicalKeyCollisionError(f"distinct raw keys give one final key ({', '.join(keys)}): {some(tuple(r)[:-1] for r in bad)}")


def positions(axis: DataFrame, order: str, name: str) -> DataFrame:
    """Dense positions in row order.

    Only for axes (one row a feature or sample), and without a global window: rows
    are range-partitioned and each partition starts after those before it.
    """
    spark = axis.sparkSession
    ranged = axis.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), q(order)).withColumn("_p", F.spark_partition_id())
    # range bounds are sampled: written once, so that both uses see the same partitions
    local = written(ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(q(order)))), "positions")
    before = local.groupBy("_p").agg(F.max("_r").alias("_n"))  # one row for each partition
    before = before.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return local.join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn(name, (F.col("_b") + F.col("_r") - 1).cast("long")).drop("_p", "_r", "_q", "_b")


def to_positions(facts: DataFrame, axis: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Facts with the position of their key; facts of dropped keys leave.

    Null-safe equi-join; Spark broadcasts the axis when it is small enough.
    """
    small = axis.select(*[q(k).alias(f"_k{i}") for i, k in enumerate(keys)], q(position))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = q(k).eqNullSafe(F.col(f"_k{i}")) if i == 0 else on & q(k).eqNullSafe(F.col(f"_k{i}"))
    return facts.join(small, on).drop(*[f"_k{i}" for i in range(len(keys))])
