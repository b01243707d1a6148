"""Observation alignment: bring levels to one shared observation axis, or keep them apart."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.axis import positions, q, to_positions
from quantloom.result import OBS, Level, Levels


def is_bijection(mapping: DataFrame, left: list[str], right: list[str]) -> bool:
    """Complete, without missing parts, and one to one; one aggregation."""
    row = mapping.agg(
        F.count("*").alias("n"), F.count_distinct(F.struct(*[q(c) for c in left])).alias("a"), F.count_distinct(F.struct(*[q(c) for c in right])).alias("b"),
        *[F.count(q(c)).alias(f"c{i}") for i, c in enumerate([*left, *right])],
    ).first()
    return bool(row["n"]) and all(v == row["n"] for v in row)


def rename_keys(level: Level, mapping: DataFrame, keys: list[str]) -> Level | None:
    """The level keyed by other observation keys, if the mapping is a bijection that covers it.

    Refused (None) where the mapping is no bijection, does not cover all
    observations, or would overwrite authored columns.
    """
    old = list(level.obs_keys)
    added = [k for k in keys if k not in old]
    own = mapping.select(*[q(k) for k in dict.fromkeys([*keys, *old])]).distinct()
    if set(added) & set(level.obs.columns) or not is_bijection(own, keys, old):
        return None
    kinds = {f.name: f.dataType for f in own.schema.fields}
    if any(level.obs.schema[k].dataType != kinds[k] for k in old):
        return None
    joined = level.obs.join(own, old, "inner")
    if joined.count() != level.obs.count():
        return None
    return replace(level, obs=joined, obs_keys=tuple(keys), uns=level.uns | {"observation_keys_original": old})


def spine(levels: list[Level]) -> DataFrame:
    """Ordered union of the observation keys: levels in order, then their own row order."""
    keys = list(levels[0].obs_keys)
    frames = [x.obs.select(*[q(k) for k in keys], F.struct(F.lit(i).alias("level"), q(OBS).alias("pos")).alias("_o")) for i, x in enumerate(levels)]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    return positions(rows.groupBy(*[q(k) for k in keys]).agg(F.min("_o").alias("_o")), "_o", "_new").drop("_o")


def share_axis(levels: dict[str, Level]) -> dict[str, Level]:
    """All levels on the union of their observations; cells keep their observation."""
    own = list(levels.values())
    keys = list(own[0].obs_keys)
    axis = spine(own).persist()
    out = {}
    for name, x in levels.items():
        moves = to_positions(x.obs.select(*[q(k) for k in keys], OBS), axis, keys, "_new").select(F.col(OBS).alias("_old"), "_new")
        small = F.broadcast(moves) if moves.count() <= 1_000_000 else moves

        def moved(df: DataFrame, column: str, small=small) -> DataFrame:
            names = df.columns
            return df.join(small, q(column) == F.col("_old")).select(*[(F.col("_new").alias(c) if c == column else q(c)) for c in names])

        obs = axis.join(x.obs.drop(OBS), keys, "left").withColumnRenamed("_new", OBS)
        out[name] = replace(
            x, obs=obs, cells=moved(x.cells, OBS), obsp={k: moved(moved(f, "row"), "column") for k, f in x.obsp.items()},
            obsm={k: axis.select(F.col("_new").alias(OBS)).join(moved(f, OBS), OBS, "left") for k, f in x.obsm.items()},
        )
    return out


def observation_groups(result: Levels, mappings: dict[tuple[str, ...], DataFrame] | None = None) -> list[Levels]:
    """Levels that can share observations together; each group is written on its own.

    ``mappings`` has, for key tuples, frames that relate them to other keys.
    """
    groups: list[dict[str, Level]] = []
    for name, x in result.levels.items():
        for g in groups:
            head = next(iter(g.values()))
            if x.obs_keys == head.obs_keys:
                g[name] = x
                break
            mapping = (mappings or {}).get(tuple(x.obs_keys))
            renamed = rename_keys(x, mapping, list(head.obs_keys)) if mapping is not None and set(head.obs_keys) <= set(mapping.columns) else None
            if renamed is not None:
                g[name] = renamed
                break
        else:
            groups.append({name: x})
    out = []
    for g in groups:
        edges = {}
        for key, frame in result.relations.items():
            kept = frame.filter(F.col("source").isin(*g) & F.col("target").isin(*g))
            if kept.limit(1).count() or not frame.limit(1).count():
                edges[key] = kept
        out.append(replace(result, levels=share_axis(g) if len(g) > 1 else g, relations=edges))
    return out


def select_observations(level: Level, keep: DataFrame) -> Level:
    """The level with only some observations (positions in ``keep``), renumbered throughout."""
    kept = positions(level.obs.join(keep.select(F.col(OBS)), OBS, "left_semi"), OBS, "_new")
    kept = kept.persist()
    moves = kept.select(F.col(OBS).alias("_old"), "_new")
    small = F.broadcast(moves) if moves.count() <= 1_000_000 else moves

    def moved(df: DataFrame, column: str) -> DataFrame:
        names = df.columns
        return df.join(small, q(column) == F.col("_old")).select(*[(F.col("_new").alias(c) if c == column else q(c)) for c in names])

    return replace(
        level, obs=kept.drop(OBS).withColumnRenamed("_new", OBS), cells=moved(level.cells, OBS),
        obsp={k: moved(moved(f, "row"), "column") for k, f in level.obsp.items()}, obsm={k: moved(f, OBS) for k, f in level.obsm.items()},
    )
