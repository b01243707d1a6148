"""Results: two keyed axes and sparse layers for each level, as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.errors import ConversionError, StorageLabelError

OBS, VAR = "obs_pos", "var_pos"

# Level identities of each hierarchy, fine to coarse.
HIERARCHIES = {
    "lfq": ("peptidoform_fragment", "peptidoform_ion", "peptidoform", "peptide", "protein", "gene"),
    "psm": ("psm",),
    "ptm_site": ("ptm_site",),
}


@dataclass(frozen=True)
class LayerInfo:
    """kind number, integer or factor; role measurement or auxiliary."""

    name: str
    kind: str = "number"
    role: str = "measurement"
    categories: dict[str, int] = field(default_factory=dict)
    roles: tuple[str, ...] = ()

    @property
    def fill(self):
        return -1 if self.kind == "factor" else None


@dataclass(frozen=True)
class Level:
    """One quantification level.

    ``cells`` has obs_pos, var_pos and one column a layer; a missing row or value
    is the layer's fill.  ``obsp`` and ``varp`` are (row, column, value) frames.
    """

    name: str
    obs: DataFrame
    var: DataFrame
    cells: DataFrame
    obs_keys: tuple[str, ...]
    var_keys: tuple[str, ...]
    layers: dict[str, LayerInfo]
    primary: str | None = None
    var_roles: dict[str, tuple[str, ...]] = field(default_factory=dict)
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    varm: dict[str, DataFrame] = field(default_factory=dict)
    obsp: dict[str, DataFrame] = field(default_factory=dict)
    varp: dict[str, DataFrame] = field(default_factory=dict)
    uns: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.primary is not None:
            info = self.layers.get(self.primary)
            if info is None:
                raise ConversionError(f"primary layer {self.primary!r} is not among {sorted(self.layers)}")
            if info.role == "auxiliary":
                raise ConversionError(f"auxiliary layer {self.primary!r} can't be primary")

    def layer(self, name: str) -> DataFrame:
        """Present cells of one layer: var_pos, obs_pos, value."""
        info = self.layers[name]
        keep = F.col(f"`{name}`").isNotNull() if info.fill is None else F.col(f"`{name}`") != info.fill
        return self.cells.filter(keep).select(VAR, OBS, F.col(f"`{name}`").alias("value"))

    def wide(self, name: str, labels: list[int] | None = None) -> DataFrame:
        """One row a feature, one column an observation; absent cells are the fill."""
        labels = labels if labels is not None else [r[0] for r in self.obs.select(OBS).orderBy(OBS).collect()]
        prefix = free_prefix("obs", self.var.columns)
        rows = self.var.select(VAR).join(self.layer(name).groupBy(VAR).pivot(OBS, labels).agg(F.first("value")), VAR, "left")
        fill = self.layers[name].fill
        cols = [F.coalesce(F.col(f"`{p}`"), F.lit(fill)) if fill is not None else F.col(f"`{p}`") for p in labels]
        return rows.select(VAR, *[c.alias(f"{prefix}{p}") for c, p in zip(cols, labels, strict=True)])

    def with_layers(self, cells: DataFrame, infos: dict[str, LayerInfo]) -> Level:
        """More layers on the same axes."""
        return replace(self, cells=self.cells.join(cells, [VAR, OBS], "full"), layers=self.layers | infos)

    def abundance_layers(self) -> list[str]:
        return [n for n, i in self.layers.items() if "abundance" in i.roles]


def free_prefix(wanted: str, taken: list[str]) -> str:
    """A column prefix that no existing name begins with."""
    for n in range(100):
        prefix = wanted + "_" * (n + 1)
        if not any(t.startswith(prefix) for t in taken):
            return prefix
    raise StorageLabelError(f"no free prefix from {wanted!r}")


@dataclass(frozen=True)
class Levels:
    """Levels of one input, annotation tables, relations between features, hierarchy."""

    levels: dict[str, Level]
    hierarchy: str = "lfq"
    tables: dict[str, tuple[DataFrame, tuple[str, ...]]] = field(default_factory=dict)
    relations: dict[str, DataFrame] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        order = HIERARCHIES.get(self.hierarchy)
        if order is None:
            raise ConversionError(f"unknown hierarchy {self.hierarchy!r}")
        if unknown := set(self.levels) - set(order):
            raise ConversionError(f"levels {sorted(unknown)} are not of hierarchy {self.hierarchy!r}")
        object.__setattr__(self, "levels", dict(sorted(self.levels.items(), key=lambda x: order.index(x[0]))))

    def __getitem__(self, name: str) -> Level:
        return self.levels[name]

    def with_annotation_table(self, name: str, frame: DataFrame, keys: tuple[str, ...]) -> Levels:
        return replace(self, tables=self.tables | {name: (frame, keys)})

    def with_feature_relation(self, name: str, edges: DataFrame) -> Levels:
        """Edges (source, row, target, column, value) between features of levels."""
        return replace(self, relations=self.relations | {name: edges})
