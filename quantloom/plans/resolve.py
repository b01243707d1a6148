"""From an effective rule and an observed header to a plan: names only, no data."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from quantloom.errors import IncompatibleSourceError, LayerContractError
from quantloom.functions.values import Notation
from quantloom.operators.cells import CellPolicy
from quantloom.operators.layers import FactorLayer, Layer, NumericLayer
from quantloom.operators.layout import match_samples
from quantloom.plans.rules import ColumnRule, EffectiveRule


@dataclass(frozen=True)
class Plan:
    """Everything a level's execution needs."""

    rule: EffectiveRule
    obs: tuple[ColumnRule, ...]
    var: tuple[ColumnRule, ...]
    computed: tuple[ColumnRule, ...]
    layers: tuple[Layer, ...]
    sources: dict[str, str]  # layer -> column (long)
    samples: dict[str, dict[str, str]]  # sample -> layer -> column (wide)
    raw_keys: tuple[str, ...]
    cells: CellPolicy
    notation: Notation = field(default_factory=Notation)
    label_column: str | None = None  # where fragments get their labels, if the header has it

    def projection(self) -> list[str]:
        """The physical columns that the level reads."""
        own = [c.source for c in (*self.obs, *self.var)] + list(self.sources.values()) + [c for s in self.samples.values() for c in s.values()]
        own.append(self.label_column)
        return list(dict.fromkeys(c for c in own if c))

    def snapshot(self) -> dict[str, Any]:
        """The plan as plain JSON."""
        return json.loads(json.dumps({
            "level": self.rule.level, "shape": self.rule.shape, "projection": self.projection(), "raw_keys": self.raw_keys, "samples": self.samples,
            "layers": [asdict(x) for x in self.layers], "computed": [c.name for c in self.computed], "cells": asdict(self.cells), "notation": asdict(self.notation),
        }))


def _versions(columns, header: set[str], what: str) -> list:
    """Of entries of one name (alternatives by version) the one whose source is there."""
    by_name: dict[str, list] = {}
    for c in columns:
        by_name.setdefault(c.name, []).append(c)
    out = []
    for name, own in by_name.items():
        if len(own) == 1:
            out.append(own[0])
            continue
        there = [c for c in own if c.source in header]
        if len(there) > 1:
            raise IncompatibleSourceError(f"{what} {name!r}: several of its sources are present: {[c.source for c in there]}")
        out.append(there[0] if there else own[0])
    return out


def missing_columns(rule: EffectiveRule, header: tuple[str, ...]) -> list[str]:
    names = set(header)
    out = [c.source for k in ("obs", "var") for c in _versions(getattr(rule.columns, k), names, k) if c.source and c.required and c.source not in names]
    if rule.shape == "wide":
        primary = next(x for x in rule.measurements.layers if x.name == rule.measurements.primary_layer)
        if not match_samples(list(header), {primary.name: primary.source}):
            out.append(primary.source)
    else:
        for x in _versions(rule.measurements.layers, names, "layer"):
            if (x.required or x.name == rule.measurements.primary_layer) and x.source not in names:
                out.append(x.source)
    return out


def _layer(rule, notation: Notation) -> Layer:
    if rule.encoding_mode == "factor":
        return FactorLayer(rule.name, tuple(rule.categories.items()))
    pattern = rule.value_pattern.pattern if rule.value_pattern.mode == "regex" else None
    return NumericLayer(rule.name, rule.type, rule.sentinels, rule.bound, rule.missing_tokens, pattern, notation)


def resolve(rule: EffectiveRule, header: tuple[str, ...], notation: Notation = Notation()) -> Plan:
    """Check the header and bind every name of the rule to it."""
    names = set(header)
    if bad := sorted(set(rule.forbidden_columns) & names):
        raise IncompatibleSourceError(f"level {rule.level!r} refuses tables with {bad}")
    if lost := missing_columns(rule, header):
        raise IncompatibleSourceError(f"level {rule.level!r} misses {lost}")
    obs = tuple(c for c in _versions(rule.columns.obs, names, "column") if c.source in names)
    var_all = _versions(rule.columns.var, names, "column")
    var = tuple(c for c in var_all if c.source in names)
    label = {rule.fragments.label_output} if rule.fragments else set()
    there = {c.name for c in var} | label
    computed = []
    for c in var_all:
        if c.how is None or c.name in there and c.source in names and c.how is not None and not c.inputs:
            continue
        have = [i for i in c.inputs if i in there]
        # coalesce, joins and markers do with what is there; the others need all inputs
        if c.how == "unmarked" or len(have) == len(c.inputs) or (c.how in ("coalesce", "join_nonempty") and have) or c.how in ("decoy", "contaminant"):
            computed.append(c.model_copy(update={"inputs": tuple(have)}))
            there.add(c.name)
    by_name = {c.name: c for c in computed}

    def raw(name: str) -> list[str]:
        return [r for i in by_name[name].inputs for r in raw(i)] if name in by_name else [name]

    raw_keys = tuple(dict.fromkeys(r for k in rule.axis.var_keys for r in raw(k)))
    layer_rules = _versions(rule.measurements.layers, names, "layer")
    sources, samples = {}, {}
    if rule.shape == "wide":
        accounted = {c.source for c in var}
        samples = match_samples(list(header), {x.name: x.source for x in layer_rules}, accounted)
        kept = {n for own in samples.values() for n in own}
        anchor = rule.measurements.sample_layer or rule.measurements.primary_layer
        samples = {s: own for s, own in samples.items() if anchor in own}
        if not samples:
            raise LayerContractError(f"level {rule.level!r}: no sample column matches {anchor!r}")
        layer_rules = [x for x in layer_rules if x.name in kept]
    else:
        layer_rules = [x for x in layer_rules if x.source in names]
        sources = {x.name: x.source for x in layer_rules}
    label_column = None
    if rule.fragments and rule.fragments.label_strategy == "column":
        label_column = rule.fragments.label_column if rule.fragments.label_column in names else None
        if label_column is None and rule.fragments.label_required:
            raise IncompatibleSourceError(f"level {rule.level!r} misses the fragment labels {rule.fragments.label_column!r}")
    repeated = rule.measurements.repeated_cells
    policy = CellPolicy(repeated.mode, repeated.by, repeated.best, tuple(n for n in repeated.sum if n in {x.name for x in layer_rules}))
    return Plan(rule, obs, var, tuple(computed), tuple(_layer(x, notation) for x in layer_rules), sources, samples, raw_keys, policy, notation, label_column)
