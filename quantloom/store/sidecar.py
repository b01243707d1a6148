"""The JSON view beside a result: schemas and statistics, no data."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import functions as F

from quantloom.operators.axis import q
from quantloom.operators.stats import factor_counts, grid_quartiles, layer_moments, null_counts, observation_moments, relation_blocks
from quantloom.result import OBS, VAR, Level, Levels


def _plain(row) -> dict:
    return {k: (v if not isinstance(v, float) or v == v else None) for k, v in row.asDict().items()}


def describe_level(level: Level) -> dict:
    axes = {}
    for axis, frame in (("obs", level.obs), ("var", level.var)):
        missing = null_counts(frame).first().asDict()
        axes[axis] = {"rows": frame.count(), "columns": {f.name: {"type": f.dataType.simpleString(), "nulls": missing[f.name]} for f in frame.schema.fields}}
    layers = {}
    for name, info in level.layers.items():
        own = {"kind": info.kind, "role": info.role}
        if info.kind == "factor":
            own |= _plain(factor_counts(level.cells, name, list(info.categories.values())).first())
        else:
            own |= _plain(layer_moments(level.cells, name).first()) | {"quartiles": _plain(grid_quartiles(level.cells, name, [OBS, VAR]).first())}
            own["observations"] = [_plain(r) for r in observation_moments(level.cells, name).orderBy(q(OBS)).collect()]
        layers[name] = own
    return {"obs_keys": list(level.obs_keys), "var_keys": list(level.var_keys), "primary": level.primary, "axes": axes, "layers": layers}


def describe(result: Levels) -> dict:
    return {
        "hierarchy": result.hierarchy, "metadata": result.metadata, "levels": {n: describe_level(x) for n, x in result.levels.items()},
        "relations": {n: [r.asDict() for r in relation_blocks(f).orderBy("source", "target").collect()] for n, f in result.relations.items()},
        "tables": {n: {"keys": list(k), "rows": f.agg(F.count("*")).first()[0]} for n, (f, k) in result.tables.items()},
    }


def publish(result: Levels, path: str) -> Path:
    """Write ``<path>.json`` at once; a stale one goes first."""
    target = Path(f"{path}.json")
    target.unlink(missing_ok=True)
    part = target.with_name(f".{target.name}.part")
    part.write_text(json.dumps(describe(result), indent=1, default=str))
    os.replace(part, target)
    return target
