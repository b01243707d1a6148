"""Rule documents: schema, composition of base and level, detection.

A document is JSON.  Its models forbid unknown fields.  ``effective`` merges a
table's base with one level: mappings key by key, lists by concatenation, sourced
columns before computed ones; then shorthands (defaults, ``{sample}``, source
prefixes) are written out.
"""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any, Literal

from pydantic import BaseModel, ConfigDict, Field, ValidationError, model_validator

from quantloom.errors import AmbiguousRuleError, ConversionError, RuleDetectionError, RuleNotApplicable, RuleUnavailableError
from quantloom.result import HIERARCHIES

COMPUTED = ("coalesce", "join_nonempty", "stripped_sequence", "proforma_sequence", "proforma_ion", "proforma_fragment", "decoy", "contaminant", "unmarked")


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid", frozen=True)


class ColumnRule(Strict):
    """A sourced or computed axis column."""

    name: str
    source: str | None = None
    source_prefix: str | None = None
    type: Literal["string", "number", "integer", "boolean"] = "string"
    required: bool = True
    version: str | None = None
    roles: tuple[str, ...] = ()
    separator: str | None = None
    missing_tokens: tuple[str, ...] = ()
    per_feature: Literal["first", "min", "max", "best_row"] = "first"
    how: str | None = None
    inputs: tuple[str, ...] = ()
    equals: str | None = None
    prefix: str | None = None
    case_sensitive: bool = True
    unknown_policy: Literal["preserve", "drop", "error"] = "preserve"
    syntax: str = "vendor_sequence"
    note: str | None = None

    @model_validator(mode="after")
    def _one_kind(self):
        if self.source is None and self.how is None:
            raise ValueError(f"column {self.name!r} has neither a source nor a computation")
        if self.how is not None and self.how not in COMPUTED:
            raise ValueError(f"column {self.name!r}: unknown computation {self.how!r}")
        return self


class ValuePattern(Strict):
    mode: Literal["none", "regex"] = "none"
    pattern: str | None = None


class LayerRule(Strict):
    name: str
    source: str
    source_prefix: str | None = None
    encoding_mode: Literal["numeric", "factor"] = "numeric"
    type: Literal["number", "integer"] = "number"
    required: bool = False
    version: str | None = None
    roles: tuple[str, ...] = ()
    missing_values: tuple[float | str, ...] = ()
    missing_tokens: tuple[str, ...] = ()
    value_pattern: ValuePattern = ValuePattern()
    categories: dict[str, int] = Field(default_factory=dict)
    note: str | None = None

    @property
    def bound(self) -> float | None:
        found = [v for v in self.missing_values if isinstance(v, str)]
        if len(found) > 1 or any(not v.startswith("<=") for v in found):
            raise ConversionError(f"layer {self.name!r}: at most one bound such as '<=0'")
        return float(found[0][2:]) if found else None

    @property
    def sentinels(self) -> tuple[float, ...]:
        return tuple(float(v) for v in self.missing_values if not isinstance(v, str))


class RepeatedCells(Strict):
    mode: Literal["error", "same", "sum", "keep_best"] = "error"
    by: str | None = None
    best: Literal["highest", "lowest"] = "highest"
    sum: tuple[str, ...] = ()

    @model_validator(mode="after")
    def _ranked(self):
        if (self.mode == "keep_best") != (self.by is not None) or (self.sum and self.mode != "keep_best"):
            raise ValueError("by belongs to keep_best, and sum only to it")
        return self


class Measurements(Strict):
    primary_layer: str
    sample_layer: str | None = None
    repeated_cells: RepeatedCells = RepeatedCells()
    layers: tuple[LayerRule, ...]


class Axis(Strict):
    obs_keys: tuple[str, ...]
    var_keys: tuple[str, ...]

    @model_validator(mode="after")
    def _unique(self):
        for keys in (self.obs_keys, self.var_keys):
            if not keys or len(set(keys)) < len(keys):
                raise ValueError("axis keys are unique and not empty")
        return self


class Fragments(Strict):
    label_strategy: Literal["positional", "column"] = "positional"
    value_columns: tuple[str, ...]
    delimiter: str = ";"
    label_output: str = "fragment_label"
    label_column: str | None = None
    label_required: bool = False


class RankRows(Strict):
    by: str
    best: Literal["highest", "lowest"] = "highest"


class Columns(Strict):
    obs: tuple[ColumnRule, ...] = ()
    var: tuple[ColumnRule, ...] = ()


class EffectiveRule(Strict):
    """One level after composition."""

    level: str
    shape: Literal["long", "wide"]
    axis: Axis
    measurements: Measurements
    columns: Columns
    fragments: Fragments | None = None
    rank_rows: RankRows | None = None
    sequence_syntax: dict[str, dict[str, Any]] = Field(default_factory=dict)
    modification_map: dict[str, str] = Field(default_factory=dict)
    forbidden_columns: tuple[str, ...] = ()
    requires_search_parameters: dict[str, Any] = Field(default_factory=dict)
    sample_name: str | None = None

    @model_validator(mode="after")
    def _references(self):
        known: set[str] = set()
        if self.fragments:
            known.add(self.fragments.label_output)
        sourced = {c.name for c in self.columns.var if c.how is None or c.source}
        for c in self.columns.var:
            if c.how is not None and (missing := [i for i in c.inputs if i not in known and i not in sourced]):
                raise ValueError(f"computed column {c.name!r} needs {missing}, which come later or nowhere")
            known.add(c.name)
        if lost := [k for k in self.axis.var_keys if k not in known]:
            raise ValueError(f"feature keys {lost} are no columns")
        names = {x.name for x in self.measurements.layers}
        if self.measurements.primary_layer not in names:
            raise ValueError(f"primary layer {self.measurements.primary_layer!r} is not declared")
        best = [c.name for c in self.columns.var if c.per_feature == "best_row"]
        if best and self.rank_rows is None:
            raise ValueError(f"columns {best} take the best row, but no rank_rows is declared")
        return self


def merge(base: Any, own: Any) -> Any:
    """Mappings merge by key, lists concatenate, other values are replaced."""
    if isinstance(base, dict) and isinstance(own, dict):
        return {k: merge(base[k], own[k]) if k in base and k in own else own.get(k, base.get(k)) for k in {**base, **own}}
    if isinstance(base, list) and isinstance(own, list):
        return base + own
    return own


_LEVEL_FIELDS = {"axis", "measurements", "columns", "fragments", "rank_rows", "sequence_syntax", "modification_map", "forbidden_columns", "requires_search_parameters"}


def effective(table: dict, level: str, parameters: dict[str, Any] | None = None) -> EffectiveRule:
    """The rule of one level of one table; a gate that excludes the input raises."""
    base, own = table.get("base", {}), table.get("levels", {}).get(level)
    if own is None:
        raise RuleUnavailableError(f"level {level!r} is not among {sorted(table.get('levels', {}))}")
    both = merge(base, own)
    for key, wanted in both.get("requires_search_parameters", {}).items():
        if parameters is None or key not in parameters:
            raise RuleNotApplicable(f"level {level!r} needs the search parameter {key!r}")
        if parameters[key] != wanted:
            raise RuleNotApplicable(f"level {level!r} is for {key} = {wanted!r}, not {parameters[key]!r}")
    for change in both.get("search_parameter_overrides", []):
        when = change.get("when_search_parameters", {})
        if parameters and all(parameters.get(k) == v for k, v in when.items()):
            both = merge(both, {"measurements": {"primary_layer": change["primary_layer"]}})
    defaults = both.get("defaults", {})
    prefix = both.get("source_prefix", "")
    sample = both.get("sample_pattern", "(?P<sample>.+)")

    def written(entry: dict, kind: str) -> dict:
        given = {k: v for k, v in defaults.get(kind, {}).items() if "how" not in entry or entry.get("source") or k not in ("type", "required", "per_feature")}
        out = given | entry
        if out.get("source") is not None:
            out["source"] = (out.get("source_prefix") if out.get("source_prefix") is not None else prefix) + out["source"]
        return out

    columns = both.get("columns", {})
    axis_columns = {k: sorted((written(c, k) for c in columns.get(k, [])), key=lambda c: c.get("how") is not None and c.get("source") is None) for k in ("obs", "var")}
    shape = table["input"]["shape"]
    measured = dict(both.get("measurements", {}))
    layers = []
    for layer in measured.get("layers", []):
        out = defaults.get("layers", {}) | layer
        own_prefix = out.get("source_prefix") if out.get("source_prefix") is not None else prefix
        if shape == "wide" and "{sample}" in out["source"]:
            head, _, tail = out["source"].partition("{sample}")
            out["source"] = f"^{re.escape(own_prefix + head)}{sample}{re.escape(tail)}$"
        elif shape == "long":
            out["source"] = own_prefix + out["source"]
        if out.get("encoding_mode") == "factor":
            out.pop("type", None)
        layers.append(out)
    measured["layers"] = layers
    fields = {k: both[k] for k in _LEVEL_FIELDS if k in both} | {"measurements": measured, "columns": axis_columns, "level": level, "shape": shape}
    if shape == "wide":
        fields["sample_name"] = both["axis"]["obs_keys"][0]
    try:
        return EffectiveRule.model_validate(fields)
    except ValidationError as e:
        raise ConversionError(f"rule of level {level!r}: {e}") from e


class Document:
    """A rule document: software, version pattern, tables and their levels."""

    def __init__(self, content: dict):
        for key in ("software_name", "software_version_pattern", "tables"):
            if key not in content:
                raise ConversionError(f"a rule document needs {key!r}")
        self.content = content
        self.name, self.pattern = content["software_name"], content["software_version_pattern"]
        self.hierarchy = content.get("hierarchy", "lfq")
        self.tables = content["tables"]
        if self.hierarchy not in HIERARCHIES:
            raise ConversionError(f"unknown hierarchy {self.hierarchy!r}")
        seen: set[str] = set()
        for table in self.tables:
            for level in table.get("levels", {}):
                if level not in HIERARCHIES[self.hierarchy]:
                    raise ConversionError(f"level {level!r} is not of hierarchy {self.hierarchy!r}")
                if level in seen:
                    raise ConversionError(f"level {level!r} is in two tables")
                seen.add(level)

    @classmethod
    def load(cls, path: str | Path) -> Document:
        return cls(json.loads(Path(path).read_text()))

    def admits(self, version: str | None) -> bool:
        return version is not None and re.search(self.pattern, version) is not None

    def levels(self) -> list[str]:
        return [n for t in self.tables for n in t.get("levels", {})]

    def table_of(self, level: str) -> dict:
        for table in self.tables:
            if level in table.get("levels", {}):
                return table
        raise RuleUnavailableError(f"{self.name}: no level {level!r}; there are {self.levels()}")

    def rule(self, level: str, parameters: dict[str, Any] | None = None) -> EffectiveRule:
        return effective(self.table_of(level), level, parameters)

    def by_signature(self, header: tuple[str, ...]) -> bool:
        """Whether a header alone tells this variant: required and forbidden columns."""
        for table in self.tables:
            own = table["input"].get("without_parameter_file")
            if own and set(own.get("required_columns", [])) <= set(header) and not set(own.get("forbidden_columns", [])) & set(header):
                return True
        return False


class Catalog:
    """Documents of a folder or list."""

    def __init__(self, documents: list[Document]):
        self.documents = documents

    @classmethod
    def folder(cls, path: str | Path) -> Catalog:
        return cls([Document.load(p) for p in sorted(Path(path).rglob("rules.json"))])

    def get(self, software: str, level: str | None = None) -> list[Document]:
        return [d for d in self.documents if d.name.lower() == software.lower() and (level is None or level in d.levels())]

    def detect(self, software: str | None = None, version: str | None = None, header: tuple[str, ...] = (), level: str | None = None) -> Document:
        """The one document that fits the software, its version or the header's signature."""
        own = self.documents if software is None else self.get(software, level)
        if not own:
            raise RuleUnavailableError(f"no rules for {software!r}" + (f" at level {level!r}" if level else ""))
        if version is not None:
            fits = [d for d in own if d.admits(version)]
        else:
            fits = [d for d in own if d.by_signature(header)] or [d for d in own if any(accepts_header(d, lv, header) for lv in ([level] if level else d.levels()))]
        if not fits:
            raise RuleDetectionError(f"no rule of {software or 'the catalog'} fits version {version!r} and the header")
        if len(fits) > 1:
            raise AmbiguousRuleError(f"several rules fit: {[(d.name, d.pattern) for d in fits]}")
        return fits[0]


def accepts_header(document: Document, level: str, header: tuple[str, ...]) -> bool:
    """Whether a header has what a level requires."""
    from quantloom.plans.resolve import missing_columns

    try:
        rule = document.rule(level)
    except RuleDetectionError:
        return False
    return not missing_columns(rule, header) and not set(rule.forbidden_columns) & set(header)


def json_schema() -> dict:
    """The published JSON Schema of an effective rule."""
    return EffectiveRule.model_json_schema()
