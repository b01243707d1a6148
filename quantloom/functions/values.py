"""What counts as missing, and how text becomes numbers: column expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A number as written under the plain notation; Java's suffixes ("1.5d") are no numbers.
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$|^[+-]?(?i:nan|inf|infinity)$"
# The spellings of booleans that a numeric column may hold.
TRUE, FALSE = ("True", "true", "TRUE"), ("False", "false", "FALSE")
UNKNOWN_CODE = -1


@dataclass(frozen=True)
class Notation:
    decimal_mark: str = "."
    thousands_marks: tuple[str, ...] = ()


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def blank_to_null(col: Column, dtype: T.DataType) -> Column:
    """Blank text and NaN are null."""
    if isinstance(dtype, T.StringType):
        return F.when(col.rlike(r"\S"), col)
    return F.when(~F.isnan(col), col) if is_float(dtype) else col


def normalize_missing(df: DataFrame) -> DataFrame:
    """Blanks and NaN to null in all columns; rows that are null throughout leave."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    clean = df.select(*[blank_to_null(F.col(f"`{n}`"), k).alias(n) for n, k in kinds.items()])
    return clean.filter(F.coalesce(*[F.col(f"`{n}`").isNotNull().cast("string") for n in kinds], F.lit("x")).isNotNull() & _any_present(kinds))


def _any_present(names) -> Column:
    found = F.lit(False)
    for n in names:
        found = found | F.col(f"`{n}`").isNotNull()
    return found


def absent(col: Column, dtype: T.DataType) -> Column:
    return col.isNull() | F.isnan(col) if is_float(dtype) else col.isNull()


def drop_tokens(col: Column, tokens: tuple[str, ...]) -> Column:
    """Declared missing tokens, compared without surrounding blanks, are null."""
    return F.when(~F.coalesce(F.trim(col.cast("string")).isin(*tokens), F.lit(False)), col) if tokens else col


def as_number(col: Column, dtype: T.DataType, notation: Notation = Notation()) -> Column:
    """Lenient number: null where the text is none under the notation."""
    if is_number(dtype):
        return col.cast("double")
    text = col.cast("string")
    plain = text
    for mark in notation.thousands_marks:
        plain = F.replace(plain, F.lit(mark), F.lit(""))
    if notation.decimal_mark != ".":
        plain = F.replace(plain, F.lit(notation.decimal_mark), F.lit("."))
    number = F.when(plain.rlike(NUMBER), plain.try_cast("double"))
    return F.when(text.isin(*TRUE), 1.0).when(text.isin(*FALSE), 0.0).otherwise(number)


def strict_number(col: Column, tokens: tuple[str, ...] = ()) -> Column:
    """Declared tokens to null, the rest cast strictly: other text ends the query."""
    return drop_tokens(col, tokens).cast("double")


def sentinel(number: Column, values: tuple[float, ...] = (), at_or_below: float | None = None) -> Column:
    """Whether a number is one of the declared stand-ins for missing; never null."""
    found = F.lit(False)
    if values:
        found = found | number.isin(*[float(v) for v in values])
    if at_or_below is not None:
        found = found | (number <= float(at_or_below))
    return F.coalesce(found, F.lit(False))


def regex_capture(col: Column, pattern: str) -> Column:
    """The one capture of a Java pattern; null without a match."""
    text = col.cast("string")
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


# ------------------------------------------------------------------ axis types
def to_string(col: Column) -> Column:
    return col.cast("string")


def to_double(col: Column, dtype: T.DataType) -> Column:
    """Finite number or null; text that is no finite number is reported by ``unreadable``."""
    number = as_number(col, dtype) if not is_number(dtype) else col.cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def to_long(col: Column, dtype: T.DataType) -> Column:
    number = to_double(col, dtype)
    whole = F.when((number == F.floor(number)) & (F.abs(number) < 9.3e18), number).try_cast("long")
    if is_number(dtype):
        return whole
    text = F.trim(col.cast("string"))
    return F.coalesce(F.when(text.rlike(r"^[+-]?\d{1,19}$"), text.try_cast("long")), whole)


def to_boolean(col: Column) -> Column:
    text = F.lower(F.trim(col.cast("string")))
    return F.when(text.isin("true", "1", "1.0"), True).when(text.isin("false", "0", "0.0"), False)


COERCE = {"string": lambda c, k: to_string(c), "number": to_double, "integer": to_long, "boolean": lambda c, k: to_boolean(c)}


def unreadable(source: Column, coerced: Column) -> Column:
    """Present in the source and lost in the coercion."""
    return source.isNotNull() & coerced.isNull()


# ---------------------------------------------------------------------- factors
def encode_factor(col: Column, categories: dict[str, int], unknown: int = UNKNOWN_CODE) -> Column:
    """Code of a label; null and undeclared labels have the unknown code."""
    out = F.lit(unknown)
    for label, code in reversed(list(categories.items())):
        out = F.when(col.cast("string") == label, code).otherwise(out)
    return out.cast("int")


def decode_factor(col: Column, categories: dict[str, int]) -> Column:
    out = F.lit(None).cast("string")
    for label, code in reversed(list(categories.items())):
        out = F.when(col == code, label).otherwise(out)
    return out


def remap_strict(col: Column, mapping: dict, kind: str) -> Column:
    """Mapped values; a value outside the mapping ends the query."""
    out = F.raise_error(F.concat(F.lit("value without a mapping: "), F.coalesce(col.cast("string"), F.lit("null")))).cast(kind)
    for key, value in reversed(list(mapping.items())):
        out = F.when(col == key, F.lit(value).cast(kind)).otherwise(out)
    return out
