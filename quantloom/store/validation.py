"""Checks of a result before it is written or after it is read: few aggregations, typed errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.errors import ResultIOError
from quantloom.operators.axis import q
from quantloom.result import OBS, VAR, Level, Levels


def _axis(level: Level, axis: DataFrame, keys: tuple[str, ...], position: str) -> int:
    row = axis.agg(
        F.count("*").alias("n"), F.count_distinct(F.struct(*[q(k) for k in keys])).alias("d"), F.count_distinct(position).alias("p"),
        F.min(position).alias("lo"), F.max(position).alias("hi"), *[F.count(q(k)).alias(f"k{i}") for i, k in enumerate(keys)],
    ).first()
    if row["n"] and (row["d"] != row["n"] or any(row[f"k{i}"] != row["n"] for i in range(len(keys)))):
        raise ResultIOError(f"{level.name}: keys {keys} are not unique and present")
    if row["n"] and (row["p"], row["lo"], row["hi"]) != (row["n"], 0, row["n"] - 1):
        raise ResultIOError(f"{level.name}: positions {position} are not 0 to {row['n'] - 1}")
    return row["n"]


def validate_level(level: Level) -> None:
    n_obs, n_var = _axis(level, level.obs, level.obs_keys, OBS), _axis(level, level.var, level.var_keys, VAR)
    checks = [F.count_if((q(OBS) < 0) | (q(OBS) >= n_obs) | (q(VAR) < 0) | (q(VAR) >= n_var) | q(OBS).isNull() | q(VAR).isNull()).alias("out"), F.count("*").alias("n")]
    for i, (name, info) in enumerate(level.layers.items()):
        if name not in level.cells.columns:
            raise ResultIOError(f"{level.name}: no column for layer {name!r}")
        bad = ~q(name).isin(-1, *info.categories.values()) if info.kind == "factor" else F.lit(False)
        checks.append(F.count_if(F.coalesce(bad, F.lit(False))).alias(f"f{i}"))
    row = level.cells.agg(*checks).first()
    if row["out"]:
        raise ResultIOError(f"{level.name}: {row['out']} cells are outside {n_obs} x {n_var}")
    for i, name in enumerate(level.layers):
        if row[f"f{i}"]:
            raise ResultIOError(f"{level.name}: {row[f'f{i}']} codes of {name!r} are not declared")
    if row["n"] and level.cells.groupBy(VAR, OBS).count().filter("count > 1").limit(1).count():
        raise ResultIOError(f"{level.name}: cells repeat")
    for what, frames, n in (("obsp", level.obsp, n_obs), ("varp", level.varp, n_var)):
        for slot, frame in frames.items():
            if frame.filter((F.col("row") < 0) | (F.col("row") >= n) | (F.col("column") < 0) | (F.col("column") >= n)).limit(1).count():
                raise ResultIOError(f"{level.name}: {what} {slot!r} leaves the axis")


def validate(result: Levels) -> None:
    for level in result.levels.values():
        validate_level(level)
    for name, edges in result.relations.items():
        for side, column in (("source", "row"), ("target", "column")):
            known = None
            for level in result.levels.values():
                own = level.var.select(F.lit(level.name).alias("_l"), F.col(VAR).alias("_p"))
                known = own if known is None else known.unionByName(own)
            if edges.join(known, (edges[side] == known["_l"]) & (edges[column] == known["_p"]), "left_anti").limit(1).count():
                raise ResultIOError(f"relation {name!r} has an unknown {side}")
