"""Delimited text: dialect from a bounded probe, then an all-text projected scan."""

from __future__ import annotations

import codecs
import csv
import gzip
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.errors import AmbiguousDialectError, IncompatibleSourceError
from quantloom.functions.values import Notation
from quantloom.operators.axis import q

PROBE_ROWS, PROBE_BYTES = 500, 8 << 20
_CODECS = {"utf8": "utf-8", "utf8-lossy": "utf-8", "windows-1252": "cp1252", "cp1252": "cp1252"}


@dataclass(frozen=True)
class Dialects:
    """What a rule allows: candidates in order."""

    delimiters: tuple[str, ...] = ("\t",)
    notations: tuple[Notation, ...] = (Notation(),)
    encodings: tuple[str, ...] = ("utf8",)
    quote: str = '"'


# Delimiters of the extensions.
DELIMITER_OF = {".tsv": "\t", ".txt": "\t", ".csv": ","}


@dataclass(frozen=True)
class Dialect:
    delimiter: str = "\t"
    notation: Notation = field(default_factory=Notation)
    encoding: str = "utf8"
    quote: str = '"'


def plain_suffix(path: str | Path) -> str:
    name = str(path).lower().removesuffix(".gz")
    return Path(name).suffix


def _head(path: Path, size: int = PROBE_BYTES) -> bytes:
    with (gzip.open(path, "rb") if path.suffix == ".gz" else path.open("rb")) as f:
        return f.read(size)


def encoding_of(path: Path, candidates: tuple[str, ...]) -> str:
    """The first candidate that decodes the probe."""
    if len(candidates) == 1:
        return candidates[0]
    head = _head(path)
    for name in candidates:
        if name == "utf8-lossy":
            return name
        try:
            codecs.getincrementaldecoder(_CODECS[name])().decode(head, final=False)
            return name
        except UnicodeDecodeError:
            continue
    raise IncompatibleSourceError(f"{path}: none of the encodings {list(candidates)} decodes the first {len(head)} bytes")


def _text(path: Path, encoding: str) -> str:
    return _head(path).decode(_CODECS[encoding], "replace").removeprefix("﻿")


def header_of(path: Path, delimiter: str, encoding: str = "utf8", quote: str = '"') -> tuple[str, ...]:
    rows = csv.reader(_text(path, encoding).splitlines(), delimiter=delimiter, quotechar=quote)
    return tuple(next(rows, []))


def detect_delimiter(path: Path, accepts: Callable[[tuple[str, ...]], bool], dialects: Dialects, encoding: str) -> tuple[str, tuple[str, ...]]:
    """The one delimiter under which the header is acceptable."""
    fits = [(d, h) for d in dialects.delimiters if accepts(h := header_of(path, d, encoding, dialects.quote))]
    if not fits:
        raise IncompatibleSourceError(f"{path}: no usable header under the delimiters {list(dialects.delimiters)}")
    if len(fits) > 1:
        raise AmbiguousDialectError(f"{path}: usable headers under several delimiters {[d for d, _ in fits]}")
    return fits[0]


def detect_notation(path: Path, delimiter: str, dialects: Dialects, encoding: str) -> Notation:
    """Decimal mark by evidence of at most 500 rows: digits after a mark that are not three."""
    if len(dialects.notations) == 1:
        return dialects.notations[0]
    usable = [n for n in dialects.notations if n.decimal_mark != delimiter]
    if not usable:
        raise IncompatibleSourceError(f"{path}: every declared decimal mark is the delimiter {delimiter!r}")
    if len(usable) == 1:
        return usable[0]
    rows = csv.reader(_text(path, encoding).splitlines(), delimiter=delimiter, quotechar=dialects.quote)
    next(rows, None)
    seen = set()
    for _, row in zip(range(PROBE_ROWS), rows, strict=False):
        for mark in {n.decimal_mark for n in usable}:
            if any((m := re.fullmatch(rf"-?\d+{re.escape(mark)}(\d+)", cell)) and len(m[1]) != 3 for cell in row):
                seen.add(mark)
    if len(seen) > 1:
        raise AmbiguousDialectError(f"{path}: fields read as decimals under several marks {sorted(seen)}")
    return next((n for n in usable if n.decimal_mark in seen), usable[0])


def resolve(path: str | Path, dialects: Dialects, accepts: Callable[[tuple[str, ...]], bool] = lambda h: True) -> tuple[Dialect, tuple[str, ...]]:
    path = Path(path)
    encoding = encoding_of(path, dialects.encodings)
    delimiter, header = detect_delimiter(path, accepts, dialects, encoding)
    return Dialect(delimiter, detect_notation(path, delimiter, dialects, encoding), encoding, dialects.quote), header


def read(spark: SparkSession, path: str | Path, dialect: Dialect, header: tuple[str, ...], columns: list[str] | None = None, ordinal: str = "_ord") -> DataFrame:
    """All columns as text, projected; row order in ``ordinal``.

    Spark prunes the parser to the projection, and gzip is read as it is (in one task,
    as the format allows no other way).
    """
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in header)
    rows = spark.read.schema(schema).csv(str(path), sep=dialect.delimiter, quote=dialect.quote, escape=dialect.quote, header=True, encoding=_CODECS[dialect.encoding], multiLine=False, enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="", emptyValue="")
    return rows.select(*[q(c) for c in (columns or header)], F.monotonically_increasing_id().alias(ordinal))


def read_inferred(spark: SparkSession, path: str | Path) -> DataFrame:
    """Annotation tables: types inferred, repeated headers told apart."""
    path = Path(path)
    delimiter = DELIMITER_OF.get(plain_suffix(path), "\t")
    header = header_of(path, delimiter)
    seen: dict[str, int] = {}
    names = []
    for c in header:
        seen[c] = seen.get(c, 0) + 1
        names.append(c if seen[c] == 1 else f"{c}.{seen[c]}")
    return spark.read.csv(str(path), sep=delimiter, header=True, inferSchema=True).toDF(*names)


@dataclass(frozen=True)
class Provenance:
    name: str
    sha256: str
    size: int
    columns: tuple[str, ...]
    rows: int | None = None


def provenance(path: str | Path, columns: tuple[str, ...], rows: int | None = None) -> Provenance:
    digest, size = hashlib.sha256(), 0
    with Path(path).open("rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
            size += len(chunk)
    return Provenance(Path(path).name, digest.hexdigest(), size, columns, rows)
