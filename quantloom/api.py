"""The public interface: compile rules against inputs, parse, read, write, annotate."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quantloom.errors import IncompatibleSourceError, RuleNotApplicable, RuleUnavailableError
from quantloom.functions.values import Notation
from quantloom.operators.align import observation_groups
from quantloom.operators.annotate import annotate_all
from quantloom.operators.axis import q
from quantloom.operators.prepare import PREPARATIONS
from quantloom.plans.execute import execute
from quantloom.plans.resolve import Plan, missing_columns, resolve
from quantloom.plans.rules import Catalog, Document
from quantloom.result import Levels
from quantloom.sources import binding, delimited, workbook
from quantloom.sources.delimited import Dialects
from quantloom.store.formats import read_levels, write_levels
from quantloom.store.sidecar import publish

__all__ = ["Compiler", "Conversion", "Catalog", "Document", "annotate_all", "observation_groups", "publish", "read_levels", "write_levels"]


def _dialects(table: dict, suffix: str) -> Dialects:
    own = table["input"]
    delimiters = own.get("delimiter", {}).get("candidates") if isinstance(own.get("delimiter"), dict) else own.get("delimiter")
    numbers = own.get("numbers", {})
    notations = tuple(Notation(d, tuple(t for t in numbers.get("thousands_candidates", ()) if t != d)) for d in numbers.get("decimal_candidates", (".",)))
    encodings = own.get("encoding", {}).get("candidates") if isinstance(own.get("encoding"), dict) else own.get("encoding")
    return Dialects(
        tuple(delimiters) if delimiters else (delimited.DELIMITER_OF.get(suffix, "\t"),),
        notations,
        tuple(encodings) if isinstance(encodings, (list, tuple)) else ((encodings,) if encodings else ("utf8",)),
    )


@dataclass
class Conversion:
    """Compiled levels of one input; ``parse`` runs them."""

    spark: SparkSession
    document: Document
    path: Path
    levels: list[str]
    parameters: dict[str, Any] | None = None
    timings: dict[str, float] = field(default_factory=dict)
    plans: dict[str, Plan] = field(default_factory=dict)

    def _prepared(self, table: dict):
        how = PREPARATIONS[table["prepare"]["how"]]
        files = binding.files_of(self.path)
        frames, headers = {}, {}
        for f in files:
            if delimited.plain_suffix(f) == ".xlsx":
                for s in workbook.sheet_names(f):
                    frames[s] = workbook.read_sheet(self.spark, f, s)
                    headers[s] = tuple(c for c in frames[s].columns if c != "_ord")
            else:
                df, header, _ = binding.read_table(self.spark, f, _dialects(table, delimited.plain_suffix(f)))
                frames[f.name], headers[f.name] = df, header
        roles = how.identify(headers)
        if not roles:
            raise IncompatibleSourceError(f"{self.path}: no table for preparation {table['prepare']['how']!r}")
        joined = how.join({r: frames[n] for r, n in roles.items()})
        # the order of the joined rows is that of the rows they come from, table by table
        orders = [c for c in joined.columns if c == "_ord" or c.endswith("._ord")]
        return joined.select(*[q(c) for c in joined.columns if c not in orders], F.struct(*[q(c).alias(f"o{i}") for i, c in enumerate(orders)]).alias("_ord")), Notation()

    def _source(self, table: dict, level: str):
        if table.get("prepare"):
            df, notation = self._prepared(table)
            return df, tuple(c for c in df.columns if c != "_ord"), notation
        rule = self.document.rule(level, self.parameters)
        accepts = lambda h: not missing_columns(rule, h)
        own = table["input"]
        errors = []
        for f in binding.files_of(self.path, own.get("file_name")):
            try:
                suffix = binding.claim(f, tuple(own["extensions"]))
                return binding.read_table(self.spark, f, _dialects(table, suffix), own.get("sheet_name"), accepts)
            except IncompatibleSourceError as e:
                errors.append(str(e))
        raise IncompatibleSourceError("; ".join(errors) or f"{self.path}: no input file")

    def parse(self, prune: bool = False) -> Levels:
        """All levels of the input; levels whose gate excludes it are left out if others fit."""
        done, left = {}, []
        for level in self.levels:
            began = time.perf_counter()
            table = self.document.table_of(level)
            try:
                rule = self.document.rule(level, self.parameters)
            except RuleNotApplicable as e:
                left.append(e)
                continue
            df, header, notation = self._source(table, level)
            plan = self.plans[level] = resolve(rule, header, notation)
            done[level] = execute(plan, df if "_ord" in df.columns else df.select(*[q(c) for c in df.columns]), prune)
            self.timings[level] = time.perf_counter() - began
        if not done:
            raise left[0] if left else RuleUnavailableError("no level to convert")
        return Levels(done, self.document.hierarchy, metadata={"software": self.document.name, "parameters": self.parameters or {}})


class Compiler:
    """Find the rules for an input: by document, by software and version, or by its header."""

    def __init__(self, spark: SparkSession, path: str | Path, document: Document, levels: list[str] | None = None, parameters: dict[str, Any] | None = None):
        self.spark, self.path, self.document, self.parameters = spark, Path(path), document, parameters
        self.levels = levels or document.levels()

    @classmethod
    def from_rule(cls, spark: SparkSession, path: str | Path, rule: str | Path | dict, levels: list[str] | None = None, parameters: dict | None = None) -> Compiler:
        return cls(spark, path, Document(rule) if isinstance(rule, dict) else Document.load(rule), levels, parameters)

    @classmethod
    def from_software(cls, spark: SparkSession, path: str | Path, catalog: Catalog, software: str, version: str | None = None, levels: list[str] | None = None, parameters: dict | None = None) -> Compiler:
        header = cls._header(path) if version is None else ()
        return cls(spark, path, catalog.detect(software, version, header), levels, parameters)

    @classmethod
    def detect(cls, spark: SparkSession, path: str | Path, catalog: Catalog, levels: list[str] | None = None, parameters: dict | None = None) -> Compiler:
        return cls(spark, path, catalog.detect(None, None, cls._header(path)), levels, parameters)

    @staticmethod
    def _header(path: str | Path) -> tuple[str, ...]:
        files = binding.files_of(path)
        suffix = delimited.plain_suffix(files[0])
        if suffix in delimited.DELIMITER_OF:
            return delimited.header_of(files[0], delimited.DELIMITER_OF[suffix], "utf8-lossy")
        if suffix == ".parquet":
            import pyarrow.parquet as pq

            return tuple(pq.read_schema(files[0]).names)
        return tuple(c for c in workbook.sheet_rows(files[0], workbook.sheet_names(files[0])[0])[0] if c)

    def compile(self) -> Conversion:
        return Conversion(self.spark, self.document, self.path, self.levels, self.parameters)
