"""Layers: text to final values, what could not be read, and what is uninformative."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.errors import EXAMPLES, LayerContractError, LayerValueError, some
from quantloom.functions.values import Notation, absent, as_number, encode_factor, regex_capture, sentinel
from quantloom.operators.axis import field, q

#: A layer is effectively empty below the first share while another reaches the second.
EMPTY_BELOW, FILLED_FROM = 0.001, 0.5


@dataclass(frozen=True)
class NumericLayer:
    """A numeric layer: sentinels, an upper bound for missing, tokens, an optional capture."""

    name: str
    kind: str = "number"  # number or integer
    missing_values: tuple[float, ...] = ()
    missing_at_or_below: float | None = None
    missing_tokens: tuple[str, ...] = ()
    pattern: str | None = None
    notation: Notation = Notation()

    def _number(self, df: DataFrame) -> Column:
        raw = q(self.name)
        if self.pattern:
            return as_number(regex_capture(raw, self.pattern), _STRING, self.notation)
        return as_number(raw, field(df, self.name), self.notation)

    def _token(self) -> Column:
        if not self.missing_tokens:
            return F.lit(False)
        return F.coalesce(F.trim(q(self.name).cast("string")).isin(*self.missing_tokens), F.lit(False))

    def present(self, df: DataFrame) -> Column:
        """Whether a raw value claims its cell: unreadable text does, sentinels don't."""
        missing = absent(q(self.name), field(df, self.name)) | self._token()
        return ~(F.coalesce(missing, F.lit(True)) | sentinel(self._number(df), self.missing_values, self.missing_at_or_below))

    def parsed(self, df: DataFrame) -> Column:
        number = self._number(df)
        number = F.when(~F.isnan(number), number)
        number = F.when(~(self._token() | sentinel(number, self.missing_values, self.missing_at_or_below)), number)
        return number.try_cast("long") if self.kind == "integer" else number

    def unreadable(self, df: DataFrame) -> Column:
        """Present text that is no number."""
        return q(self.name).isNotNull() & ~self._token() & self._number(df).isNull()

    def fractional(self, df: DataFrame) -> Column:
        number = self._number(df)
        return F.coalesce(number != F.floor(number), F.lit(False)) if self.kind == "integer" else F.lit(False)


@dataclass(frozen=True)
class FactorLayer:
    """A categorical layer: labels to codes, unknown ones to -1."""

    name: str
    categories: tuple[tuple[str, int], ...] = ()

    def present(self, df: DataFrame) -> Column:
        return q(self.name).isNotNull()

    def parsed(self, df: DataFrame) -> Column:
        return encode_factor(q(self.name), dict(self.categories))

    def unreadable(self, df: DataFrame) -> Column:
        return q(self.name).isNotNull() & ~q(self.name).cast("string").isin(*[k for k, _ in self.categories])

    def fractional(self, df: DataFrame) -> Column:
        return F.lit(False)


from pyspark.sql.types import StringType  # noqa: E402

_STRING = StringType()
Layer = NumericLayer | FactorLayer


def mask_absent(df: DataFrame, layers: list[Layer]) -> DataFrame:
    """Raw values that don't claim their cell become null before cells are resolved."""
    masks = {x.name: F.when(x.present(df), q(x.name)) for x in layers}
    return df.select(*[masks[c].alias(c) if c in masks else q(c) for c in df.columns])


def parse_layers(df: DataFrame, layers: list[Layer]) -> DataFrame:
    values = {x.name: x.parsed(df) for x in layers}
    return df.select(*[values[c].alias(c) if c in values else q(c) for c in df.columns])


def diagnose(df: DataFrame, layers: list[Layer]) -> dict[str, dict]:
    """Unreadable tokens of all layers in one job: count, distinct count, five sorted examples."""
    out = []
    for i, x in enumerate(layers):
        bad = x.unreadable(df)
        token = F.when(bad, q(x.name).cast("string"))
        out += [F.count(token).alias(f"n{i}"), F.count_distinct(token).alias(f"d{i}"), F.sum(x.fractional(df).cast("long")).alias(f"f{i}")]
    if not out:
        return {}
    row = df.agg(*out).first()
    found = {}
    for i, x in enumerate(layers):
        if row[f"f{i}"]:
            raise LayerValueError(f"integer layer {x.name!r} holds {row[f'f{i}']} fractional values")
        if row[f"n{i}"]:
            shown = df.filter(x.unreadable(df)).select(q(x.name).cast("string").alias("v")).distinct().orderBy("v").limit(EXAMPLES).collect()
            found[x.name] = {"count": row[f"n{i}"], "distinct": row[f"d{i}"], "examples": [r[0] for r in shown]}
    return found


def occupancy(cells: DataFrame, layers: list[str], n_cells: int | None = None) -> dict[str, float]:
    """Share of filled cells of each layer, in one job."""
    row = cells.agg(F.count("*").alias("n"), *[F.count(F.when(~absent(q(n), field(cells, n)), 1)).alias(f"c{i}") for i, n in enumerate(layers)]).first()
    total = n_cells or row["n"]
    return {n: (row[f"c{i}"] / total if total else 0.0) for i, n in enumerate(layers)}


def require_filled(shares: dict[str, float], primary: str) -> list[str]:
    """Layers that are effectively empty; the primary one must not be."""
    if max(shares.values(), default=0.0) < FILLED_FROM:
        empty = [n for n, s in shares.items() if s == 0.0]
    else:
        empty = [n for n, s in shares.items() if s < EMPTY_BELOW]
    if primary in empty:
        raise LayerContractError(f"primary layer {primary!r} is empty while others are filled: {some(shares.items())}")
    return empty


def uninformative(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Columns that are ``empty`` or ``single-valued`` (every row filled, two or more, one value)."""
    if not columns:
        return {}
    row = df.agg(F.count("*").alias("n"), *[x for i, c in enumerate(columns) for x in (F.count(F.when(~absent(q(c), field(df, c)), 1)).alias(f"c{i}"), F.min(q(c)).eqNullSafe(F.max(q(c))).alias(f"s{i}"))]).first()
    out = {}
    for i, c in enumerate(columns):
        if row[f"c{i}"] == 0:
            out[c] = "empty"
        elif row[f"c{i}"] == row["n"] >= 2 and row[f"s{i}"]:
            out[c] = "single-valued"
    return out


def prune(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Drop the uninformative ones of some columns (eager: the schema depends on data)."""
    found = uninformative(df, columns)
    return df.drop(*found), found
