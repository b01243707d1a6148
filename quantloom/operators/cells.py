"""Repeated cells: what to do when one (feature, observation) has several rows.

Each policy is a single aggregation over all layers of a cell; the checks are one
aggregation more and raise typed errors with at most five examples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.errors import EXAMPLES, DuplicateCellError, some
from quantloom.functions.values import Notation, as_number
from quantloom.operators.axis import field, q, rank_of, require_numeric


@dataclass(frozen=True)
class CellPolicy:
    """mode error, same, sum or keep_best; the others only with keep_best."""

    mode: str = "error"
    by: str | None = None
    best: str = "highest"
    sums: tuple[str, ...] = ()


def repeated(df: DataFrame, cell: list[str]) -> DataFrame:
    """Cells with more than one row, and how many."""
    return df.groupBy(*[q(c) for c in cell]).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def require_single(df: DataFrame, cell: list[str]) -> None:
    """A second row counts, even an empty one."""
    bad = repeated(df, cell).limit(EXAMPLES).collect()
    if bad:
        raise DuplicateCellError(f"cells with several rows: {some(tuple(r) for r in bad)}")


def require_same(df: DataFrame, cell: list[str], layers: list[str]) -> None:
    """Present values of a cell agree; empty rows give way."""
    for layer in layers:
        pass
    differ = [(~F.min(q(n)).eqNullSafe(F.max(q(n)))).alias(f"_d{i}") for i, n in enumerate(layers)]
    checked = df.groupBy(*[q(c) for c in cell]).agg(*differ)
    any_ = F.lit(False)
    for i in range(len(layers)):
        any_ = any_ | F.col(f"_d{i}")
    bad = checked.filter(any_).limit(EXAMPLES).collect()
    if bad:
        raise DuplicateCellError(f"cells whose rows differ: {some(tuple(r)[: len(cell)] for r in bad)}")


def keep_same(df: DataFrame, cell: list[str], layers: list[str], order: str) -> DataFrame:
    return df.groupBy(*[q(c) for c in cell]).agg(*[F.min_by(q(n), F.when(q(n).isNotNull(), q(order))).alias(n) for n in layers], F.min(q(order)).alias(order))


def sum_cells(df: DataFrame, cell: list[str], layers: list[str], order: str | None = None, notation: Notation = Notation()) -> DataFrame:
    """Sums of present values; null where no value is present."""
    sums = [F.sum(F.when(~F.isnan(n := as_number(q(name), field(df, name), notation)), n)).alias(name) for name in layers]
    return df.groupBy(*[q(c) for c in cell]).agg(*sums, *([F.min(q(order)).alias(order)] if order else []))


def keep_best(df: DataFrame, cell: list[str], layers: list[str], policy: CellPolicy, order: str, notation: Notation = Notation()) -> DataFrame:
    """One winning row for all layers, except the summed ones; one aggregation."""
    number = as_number(q(policy.by), field(df, policy.by), notation)
    rank = rank_of(F.when(~F.isnan(number), number), policy.best, q(order))
    kept = [n for n in layers if n not in policy.sums]
    best = F.min_by(F.struct(*[q(n).alias(f"c{i}") for i, n in enumerate(kept)], F.lit(1).alias("_")), rank)
    sums = [F.sum(F.when(~F.isnan(n := as_number(q(name), field(df, name), notation)), n)).alias(name) for name in policy.sums]
    rows = df.groupBy(*[q(c) for c in cell]).agg(best.alias("_best"), *sums, F.min(q(order)).alias(order))
    return rows.select(*[q(c) for c in cell], *[F.col(f"_best.c{kept.index(n)}").alias(n) if n in kept else q(n) for n in layers], q(order))


def resolve(df: DataFrame, cell: list[str], layers: list[str], policy: CellPolicy, order: str, notation: Notation = Notation(), check: bool = True) -> DataFrame:
    """One row for each cell under the policy."""
    extra = [policy.by] if policy.mode == "keep_best" and policy.by not in layers else []
    if policy.mode == "error":
        if check:
            require_single(df, cell)
        return df.select(*[q(c) for c in cell], *[q(n) for n in layers], q(order))
    if policy.mode == "same":
        if check:
            require_same(df, cell, layers)
        return keep_same(df, cell, layers, order)
    if policy.mode == "sum":
        if check:
            for name in layers:
                require_numeric(df, name, notation)
        return sum_cells(df, cell, layers, order, notation)
    if policy.mode == "keep_best":
        if check:
            for name in (policy.by, *policy.sums):
                require_numeric(df, name, notation)
        return keep_best(df, cell, layers + extra, policy, order, notation).select(*[q(c) for c in cell], *[q(n) for n in layers], q(order))
    raise ValueError(f"unknown mode {policy.mode!r}")
