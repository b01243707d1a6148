"""mzTab text: sections by line prefix, then long tables of a section and axis."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.errors import EXAMPLES, MzTabFormatError, some
from quantloom.operators.axis import q
from quantloom.operators.joins import fold_rows

# Header prefix of each row prefix.
SECTIONS = {"PRT": "PRH", "PEP": "PEH", "PSM": "PSH", "SML": "SMH", "SMF": "SFH", "SME": "SEH", "NUC": "NUH", "OLI": "OLH", "OSM": "OSH"}


@dataclass(frozen=True)
class MzTab:
    """Metadata (line, key, value), comments (line, text) and one frame a section."""

    metadata: DataFrame
    comments: DataFrame
    sections: dict[str, DataFrame]

    def keys(self, pattern: str) -> list[tuple[str, str]]:
        """Metadata entries by key pattern; metadata is a header of bounded size."""
        return [(r["key"], r["value"]) for r in self.metadata.filter(F.col("key").rlike(pattern)).orderBy("line").collect()]


def split(spark: SparkSession, path: str) -> MzTab:
    """One scan of the lines; sections are filters of it, so a large section stays distributed."""
    lines = spark.read.text(str(path)).select(F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", r"\r$", "").alias("t"))
    lines = lines.filter(F.trim("t") != "").select("line", F.split("t", "\t").alias("f"))
    lines = lines.select("line", "f", F.trim(F.get("f", F.lit(0))).alias("p"))
    known = ["MTD", "COM", *SECTIONS, *SECTIONS.values()]
    bad = lines.filter(~F.col("p").isin(*known)).select("p").distinct().limit(EXAMPLES).collect()
    if bad:
        raise MzTabFormatError(f"{path}: unknown line prefix {some(r[0] for r in bad)}")
    heads = {r["p"]: (r["line"], r["f"]) for r in _one_header(lines.filter(F.col("p").isin(*SECTIONS.values())), path)}
    present = {r["p"]: r["first"] for r in lines.filter(F.col("p").isin(*SECTIONS)).groupBy("p").agg(F.min("line").alias("first")).collect()}
    sections = {}
    for name, head in SECTIONS.items():
        if head not in heads:
            if name in present:
                raise MzTabFormatError(f"{path}: {name} rows without a {head} header")
            continue
        at, fields = heads[head]
        if name in present and present[name] < at:
            raise MzTabFormatError(f"{path}: {name} row before its {head} header")
        names = [x.strip() for x in fields[1:]]
        while names and not names[-1]:
            names.pop()
        if "" in names or len(set(names)) < len(names):
            raise MzTabFormatError(f"{path}: {head} has unnamed or repeated columns")
        rows = lines.filter(F.col("p") == name)
        width = len(names)
        beyond = F.exists(F.slice("f", width + 2, F.size("f")), lambda x: F.trim(x) != "")
        if rows.filter(beyond).limit(1).count():
            raise MzTabFormatError(f"{path}: {name} row has values beyond its {width}-column header")
        sections[name] = rows.select("line", *[F.coalesce(F.get("f", F.lit(i + 1)), F.lit("")).alias(c) for i, c in enumerate(names)])
    rest = lambda n: F.trim(F.array_join(F.slice("f", n, F.size("f")), "\t"))
    meta = lines.filter(F.col("p") == "MTD").select("line", F.trim(F.coalesce(F.get("f", F.lit(1)), F.lit(""))).alias("key"), rest(3).alias("value"))
    comments = lines.filter(F.col("p") == "COM").select("line", rest(2).alias("text"))
    return MzTab(meta, comments, sections)


def _one_header(heads: DataFrame, path) -> list:
    rows = heads.limit(1000).collect()
    names = [r["p"] for r in rows]
    if repeated := {n for n in names if names.count(n) > 1}:
        raise MzTabFormatError(f"{path}: second header {sorted(repeated)}")
    return rows


def sample_columns(columns: list[str], axis: str) -> dict[str, dict[str, str]]:
    """sample -> value name -> column, for columns such as ``abundance_assay[1]``."""
    found: dict[str, dict[str, str]] = {}
    for c in columns:
        m = re.fullmatch(rf"(.+?)_{axis}\[(\d+)\](.*)", c)
        if m:
            found.setdefault(f"{axis}[{m[2]}]", {})[m[1] + m[3]] = c
    return found


def long_table(section: DataFrame, axis: str, keys: list[str]) -> DataFrame:
    """One row for each feature and sample of an axis (ms_run, assay or study_variable)."""
    samples = sample_columns(section.columns, axis)
    values = list(dict.fromkeys(v for own in samples.values() for v in own))
    rows = [F.struct(F.lit(s).alias(axis), *[(q(own[v]) if v in own else F.lit(None).cast("string")).alias(v) for v in values]) for s, own in samples.items()]
    if not rows:
        return section.select("line", *[q(k) for k in keys]).limit(0)
    flat = section.select("line", *[q(k) for k in keys], F.explode(F.array(*rows)).alias("x"))
    return flat.select("line", *[q(k) for k in keys], "x.*").na.replace("null", None)


def runs_of(section: DataFrame, column: str = "spectra_ref") -> DataFrame:
    """One row for each run that a row's spectra references name; none gives a null run."""
    tokens = F.transform(F.split(q(column), r"\|"), lambda x: F.regexp_extract(x, r"ms_run\[(\d+)\]", 1))
    return section.select("*", F.explode_outer(F.array_distinct(F.filter(tokens, lambda x: x != ""))).alias("run"))


def folded(section: DataFrame, name: str) -> DataFrame:
    """Rows written once for each protein, as one row a feature."""
    if name == "PSM" and {"PSM_ID", "spectra_ref"} <= set(section.columns):
        keys = ["PSM_ID", "spectra_ref"]
    elif name == "PEP" and (own := {"accession", "unique", "database", "database_version"} & set(section.columns)):
        keys = [c for c in section.columns if c != "line" and c not in own]
    else:
        return section
    return fold_rows(section, keys, [c for c in section.columns if c not in (*keys, "line")], "line")


def entity_walk(references: dict[str, dict[str, list[str]]], start: list[str], barred: frozenset[str] = frozenset()) -> list[str]:
    """Entities reached from some: first along references, then against them past barred kinds.

    Metadata entities (runs, assays, variables) are a bounded header, walked on the driver.
    """
    kind = lambda e: re.sub(r"\[\d+\]$", "", e)
    seen = dict.fromkeys(start)
    queue = list(start)
    while queue:
        e = queue.pop(0)
        for x in (x for targets in references.get(e, {}).values() for x in targets):
            if x not in seen:
                seen[x] = None
                queue.append(x)
    queue = list(seen)
    while queue:
        e = queue.pop(0)
        for owner, refs in references.items():
            if owner not in seen and kind(owner) not in barred and any(e in t for t in refs.values()):
                seen[owner] = None
                queue.append(owner)
    return list(seen)


def write_long(mztab: MzTab, folder: str, axes: tuple[str, ...] = ("assay", "study_variable", "ms_run")) -> list[str]:
    """One Parquet table for each section and axis, and the metadata."""
    made = []
    for name, section in mztab.sections.items():
        section = folded(section, name)
        if "line" not in section.columns:
            section = section.withColumn("line", F.lit(0))
        keys = [c for c in section.columns if c != "line" and not re.search(r"_(?:assay|study_variable|ms_run)\[\d+\]", c)]
        for axis in axes:
            if sample_columns(section.columns, axis):
                long_table(section, axis, keys).write.mode("overwrite").parquet(f"{folder}/{name}_{axis}")
                made.append(f"{name}_{axis}")
    mztab.metadata.write.mode("overwrite").parquet(f"{folder}/metadata")
    return [*made, "metadata"]
