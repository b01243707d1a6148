"""Result stores by suffix: a Parquet folder (native) and a DuckDB file at the edge.

A folder is written under a temporary name and moved into place, the manifest
last; readers refuse what has no manifest, another format or version.
"""

from __future__ import annotations

import json
import re
import shutil
import uuid
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.errors import ResultIOError
from quantloom.result import OBS, VAR, LayerInfo, Level, Levels
from quantloom.store.validation import validate

FORMAT, VERSION = "quantloom-result", 1


def safe_name(name: str, taken: set[str]) -> str:
    """A physical name for a logical one: plain characters, unique without case."""
    base = re.sub(r"[^A-Za-z0-9_.-]", "_", name).strip(".") or "_"
    out, n = base, 1
    while out.lower() in {t.lower() for t in taken}:
        n += 1
        out = f"{base}_{n}"
    taken.add(out)
    return out


def _manifest(result: Levels) -> dict:
    taken: set[str] = set()
    levels = {}
    for name, x in result.levels.items():
        frames = {"obs": x.obs, "var": x.var, "cells": x.cells} | {f"{kind}/{slot}": f for kind in ("obsm", "varm", "obsp", "varp") for slot, f in getattr(x, kind).items()}
        levels[name] = {
            "obs_keys": list(x.obs_keys), "var_keys": list(x.var_keys), "primary": x.primary, "uns": x.uns, "var_roles": {k: list(v) for k, v in x.var_roles.items()},
            "layers": {n: {"kind": i.kind, "role": i.role, "categories": i.categories, "roles": list(i.roles)} for n, i in x.layers.items()},
            "files": {k: safe_name(f"{name}.{k.replace('/', '.')}", taken) for k in frames},
            "schemas": {k: json.loads(f.schema.json()) for k, f in frames.items()},
        }
    extra = {k: {n: {"file": safe_name(f"{k}.{n}", taken)} for n in own} for k, own in (("tables", result.tables), ("relations", result.relations))}
    for n, (f, keys) in result.tables.items():
        extra["tables"][n] |= {"keys": list(keys), "schema": json.loads(f.schema.json())}
    for n, f in result.relations.items():
        extra["relations"][n] |= {"schema": json.loads(f.schema.json())}
    return {"format": FORMAT, "version": VERSION, "hierarchy": result.hierarchy, "metadata": result.metadata, "levels": levels} | extra


def _frames(result: Levels, manifest: dict):
    for name, x in result.levels.items():
        for key, file in manifest["levels"][name]["files"].items():
            kind, _, slot = key.partition("/")
            yield file, getattr(x, kind)[slot] if slot else getattr(x, kind)
    for n, (f, _) in result.tables.items():
        yield manifest["tables"][n]["file"], f
    for n, f in result.relations.items():
        yield manifest["relations"][n]["file"], f


def _stored(df: DataFrame) -> DataFrame:
    """Columns Parquet can't hold (null type) as text; the manifest keeps their type."""
    return df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_parquet(result: Levels, path: str) -> None:
    validate(result)
    manifest = _manifest(result)
    target = Path(path)
    staging = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    try:
        for file, frame in _frames(result, manifest):
            rows = _stored(frame)
            if {VAR, OBS} <= set(rows.columns):
                rows = rows.repartitionByRange(VAR, OBS).sortWithinPartitions(VAR, OBS)
            rows.write.option("compression", "zstd").parquet(str(staging / file))
        (staging / "manifest.json").write_text(json.dumps(manifest, indent=1))
        if target.exists():
            shutil.rmtree(target)
        staging.rename(target)
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def _check(manifest: dict, where: str) -> None:
    if manifest.get("format") != FORMAT or manifest.get("version") != VERSION:
        raise ResultIOError(f"{where}: not a result of format {FORMAT} {VERSION}")


def _restore(manifest: dict, load, only: str | None) -> Levels:
    def frame(file: str, schema: dict) -> DataFrame:
        kinds = T.StructType.fromJson(schema)
        df = load(file)
        if set(df.columns) != set(kinds.fieldNames()):
            raise ResultIOError(f"{file}: columns differ from the manifest")
        return df.select(*[F.col(f"`{f.name}`").cast(f.dataType) if not isinstance(f.dataType, T.NullType) else F.lit(None).alias(f.name) for f in kinds.fields])

    if only and only not in manifest["levels"]:
        raise ResultIOError(f"no level {only!r} among {sorted(manifest['levels'])}")
    levels = {}
    for name, m in manifest["levels"].items():
        if only and name != only:
            continue
        own = {k: frame(f, m["schemas"][k]) for k, f in m["files"].items()}
        slots = {kind: {k.split("/", 1)[1]: f for k, f in own.items() if k.startswith(kind + "/")} for kind in ("obsm", "varm", "obsp", "varp")}
        layers = {n: LayerInfo(n, i["kind"], i["role"], i["categories"], tuple(i["roles"])) for n, i in m["layers"].items()}
        levels[name] = Level(name, own["obs"], own["var"], own["cells"], tuple(m["obs_keys"]), tuple(m["var_keys"]), layers, m["primary"], {k: tuple(v) for k, v in m["var_roles"].items()}, uns=m["uns"], **slots)
    result = Levels(levels, manifest["hierarchy"], metadata=manifest["metadata"])
    if only is None:
        result = replace(result, tables={n: (frame(t["file"], t["schema"]), tuple(t["keys"])) for n, t in manifest["tables"].items()}, relations={n: frame(t["file"], t["schema"]) for n, t in manifest["relations"].items()})
    return result


def read_parquet(spark: SparkSession, path: str, level: str | None = None) -> Levels:
    file = Path(path) / "manifest.json"
    if not file.exists():
        raise ResultIOError(f"{path} has no manifest")
    manifest = json.loads(file.read_text())
    _check(manifest, path)
    return _restore(manifest, lambda f: spark.read.parquet(str(Path(path) / f)), level)


def write_duckdb(result: Levels, path: str) -> None:
    """Frames go through Parquet files into tables of a database that is swapped in whole."""
    import duckdb

    validate(result)
    manifest = _manifest(result)
    target = Path(path)
    staging = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    parts = Path(f"{staging}.parts")
    try:
        with duckdb.connect(str(staging)) as con:
            for i, (file, frame) in enumerate(_frames(result, manifest)):
                _stored(frame).write.parquet(str(parts / str(i)))
                con.execute(f'CREATE TABLE "{file}" AS SELECT * FROM read_parquet(\'{parts / str(i)}/*.parquet\')')
            con.execute("CREATE TABLE manifest (content VARCHAR)")
            con.execute("INSERT INTO manifest VALUES (?)", [json.dumps(manifest)])
        staging.replace(target)
    finally:
        shutil.rmtree(parts, ignore_errors=True)
        staging.unlink(missing_ok=True)


def read_duckdb(spark: SparkSession, path: str, level: str | None = None) -> Levels:
    import duckdb

    if not Path(path).exists():
        raise ResultIOError(f"{path} does not exist")
    parts = Path(f"{path}.{uuid.uuid4().hex}.read")
    parts.mkdir()
    with duckdb.connect(path, read_only=True) as con:
        try:
            manifest = json.loads(con.execute("SELECT content FROM manifest").fetchall()[0][0])
        except duckdb.Error as e:
            raise ResultIOError(f"{path} has no manifest") from e
        _check(manifest, path)
        names: dict[str, str] = {}

        def load(file: str) -> DataFrame:
            names[file] = str(parts / f"{len(names)}.parquet")
            with duckdb.connect(path, read_only=True) as own:
                own.execute(f"COPY \"{file}\" TO '{names[file]}' (FORMAT parquet)")
            return spark.read.parquet(names[file])

        return _restore(manifest, load, level)


FORMATS = {".parquet": (write_parquet, read_parquet), ".duckdb": (write_duckdb, read_duckdb)}
#: Formats of the same contract that need packages this library does not depend on.
UNAVAILABLE = {".h5ad": "anndata", ".h5mu": "mudata"}


def _format(path: str):
    suffix = Path(path).suffix
    if suffix in UNAVAILABLE:
        raise ResultIOError(f"{suffix} needs the package {UNAVAILABLE[suffix]}; write .parquet and convert there")
    if suffix not in FORMATS:
        raise ResultIOError(f"no result format for {suffix!r}; known: {sorted(FORMATS)}")
    return FORMATS[suffix]


def write_levels(result: Levels, path: str) -> None:
    _format(path)[0](result, path)


def read_levels(spark: SparkSession, path: str, level: str | None = None) -> Levels:
    return _format(path)[1](spark, path, level)
