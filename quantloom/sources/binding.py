"""From a path and a declared format to a frame and its header."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.errors import IncompatibleSourceError
from quantloom.functions.values import Notation
from quantloom.sources import delimited, workbook
from quantloom.sources.delimited import Dialects, plain_suffix

SUFFIXES = (".tsv", ".txt", ".csv", ".parquet", ".xlsx")


def files_of(path: str | Path, name: str | None = None) -> list[Path]:
    """A file itself; in a folder the named member (plain or gzipped) or all tables."""
    path = Path(path)
    if not path.is_dir() or plain_suffix(path) == ".parquet":
        return [path]
    if name:
        found = [p for p in (path / name, path / f"{name}.gz") if p.exists()]
        if not found:
            raise IncompatibleSourceError(f"{path} has no {name}")
        return found[:1]
    return sorted(p for p in path.iterdir() if plain_suffix(p) in SUFFIXES)


def claim(path: str | Path, extensions: tuple[str, ...]) -> str:
    """The declared extension of a file; gzip only for text."""
    suffix = plain_suffix(path)
    if suffix not in extensions:
        raise IncompatibleSourceError(f"{path}: extension {suffix!r} is not among {list(extensions)}")
    if str(path).lower().endswith(".gz") and suffix not in delimited.DELIMITER_OF:
        raise IncompatibleSourceError(f"{path}: only delimited text may be gzipped")
    return suffix


def read_table(spark: SparkSession, path: str | Path, dialects: Dialects | None = None, sheet: str | None = None, accepts=lambda h: True, columns: list[str] | None = None) -> tuple[DataFrame, tuple[str, ...], Notation]:
    """Frame with ``_ord``, full header, and number notation of one file."""
    suffix = plain_suffix(path)
    if suffix in delimited.DELIMITER_OF:
        own = dialects or Dialects(delimiters=(delimited.DELIMITER_OF[suffix],))
        dialect, header = delimited.resolve(path, own, accepts)
        return delimited.read(spark, path, dialect, header, columns), header, dialect.notation
    if suffix == ".parquet":
        df = spark.read.parquet(str(path))
        header = tuple(df.columns)
        if not accepts(header):
            raise IncompatibleSourceError(f"{path}: the header lacks required columns")
        kept = df.select(*[F.col(f"`{c}`") for c in (columns or header)], F.monotonically_increasing_id().alias("_ord"))
        return kept, header, Notation()
    if suffix == ".xlsx":
        df = workbook.read_sheet(spark, path, sheet or workbook.sheet_names(path)[0])
        header = tuple(c for c in df.columns if c != "_ord")
        if not accepts(header):
            raise IncompatibleSourceError(f"{path}: the header lacks required columns")
        return df.select(*[F.col(f"`{c}`") for c in (columns or header)], "_ord"), header, Notation()
    raise IncompatibleSourceError(f"{path}: no reader for {suffix!r}")
