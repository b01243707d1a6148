"""Physical shapes to one facts frame: keys, an ordinal, and one column a layer.

All layers stay columns of the same row until cells are resolved, so a table is
shuffled once, not once a layer.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.errors import EXAMPLES, IncompatibleSourceError, PackedLengthError, some
from quantloom.functions.text import column_label, packed_split, positional_label
from quantloom.operators.axis import q


def with_ordinal(df: DataFrame, name: str = "_ord") -> DataFrame:
    """Row order of files: file name, then row in the file, where the source tells it."""
    if name in df.columns:
        return df
    try:
        return df.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias(name))
    except Exception:  # the source has no row index: one scan keeps the order of its splits
        return df.select("*", F.monotonically_increasing_id().alias(name))


def long_facts(df: DataFrame, keys: list[str], layers: dict[str, str], order: str) -> DataFrame:
    """Long tables are facts already: layers by name."""
    return df.select(*[q(k) for k in keys], *[q(source).alias(name) for name, source in layers.items() if name not in keys], q(order))


def match_samples(columns: list[str], patterns: dict[str, str], accounted: set[str] = frozenset()) -> dict[str, dict[str, str]]:
    """Header columns of each sample: sample -> layer -> column.

    Patterns are Python regular expressions with a ``sample`` group; columns that
    axes read are left out.  Samples come in header order.
    """
    found: dict[str, dict[str, str]] = {}
    for layer, pattern in patterns.items():
        shape = re.compile(pattern)
        for column in columns:
            if column in accounted:
                continue
            m = shape.search(column)
            if m and m["sample"]:
                own = found.setdefault(m["sample"], {})
                if layer in own:
                    raise IncompatibleSourceError(f"sample {m['sample']!r} has two columns for layer {layer!r}: {own[layer]!r}, {column!r}")
                own[layer] = column
    return found


def wide_facts(df: DataFrame, keys: list[str], samples: dict[str, dict[str, str]], layers: list[str], order: str, sample: str = "sample") -> DataFrame:
    """Unpivot all layers of all samples in one pass; a missing column is null."""
    kinds = {name: _widest(df, [own[name] for own in samples.values() if name in own]) for name in layers}
    rows = [F.struct(F.lit(s).alias(sample), F.lit(i).alias("_s"), *[(q(own[n]).cast(kinds[n]) if n in own else F.lit(None).cast(kinds[n])).alias(n) for n in layers]) for i, (s, own) in enumerate(samples.items())]
    flat = df.select(*[q(k) for k in keys], q(order), F.explode(F.array(*rows)).alias("_x"))
    return flat.select(*[q(k) for k in keys], F.col("_x")[sample].alias(sample), *[F.col("_x")[n].alias(n) for n in layers], F.struct(F.col("_x._s").alias("s"), q(order).alias("o")).alias(order))


def _widest(df: DataFrame, columns: list[str]) -> str:
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    own = {kinds[c] for c in columns}
    if not own:
        return "string"
    if "string" in own:
        return "string"
    return next(iter(own)) if len(own) == 1 else "double"


def widen(facts: DataFrame, keys: list[str], sample: str, value: str, labels: list[str]) -> DataFrame:
    """Long to wide for a known list of samples (no extra job to find them)."""
    return facts.groupBy(*[q(k) for k in keys]).pivot(sample, labels).agg(F.first(q(value), ignorenulls=True))


def require_parallel(df: DataFrame, packed: dict[str, str], keys: list[str]) -> None:
    """Packed lists of one row have the same number of tokens."""
    sizes = [F.size(packed_split(q(c), d)) for c, d in packed.items()]
    if len(sizes) < 2:
        return
    uneven = F.lit(False)
    for s in sizes[1:]:
        uneven = uneven | (s != sizes[0])
    bad = df.filter(uneven).select(*[q(k) for k in keys], *[s.alias(f"n{i}") for i, s in enumerate(sizes)]).limit(EXAMPLES).collect()
    if bad:
        raise PackedLengthError(f"packed lists {', '.join(packed)} differ in length: {some(tuple(r) for r in bad)}")


def packed_facts(df: DataFrame, keys: list[str], values: dict[str, str], delimiter: str, order: str, label: str = "label", labels_from: str | None = None, label_required: bool = False) -> DataFrame:
    """One row for each token of parallel packed lists.

    ``values`` maps layer names to packed columns.  Labels are ``frag_<n>`` or the
    first segment of the tokens of a label column.  A row without tokens gives one
    row with a null label, so its keys stay; with ``label_required`` it leaves.
    """
    packed = dict(values) | ({"_label": labels_from} if labels_from else {})
    split = df.select(*[q(k) for k in keys], q(order), *[packed_split(q(c), delimiter).alias(f"_p_{n}") for n, c in packed.items()])
    zipped = split.select(*[q(k) for k in keys], q(order), F.posexplode_outer(F.arrays_zip(*[q(f"_p_{n}") for n in packed])).alias("_i", "_t"))
    name = column_label(F.col("_t")["_p__label"]) if labels_from else F.when(F.col("_i").isNotNull(), positional_label(F.col("_i") + 1))
    rows = zipped.select(*[q(k) for k in keys], name.alias(label), *[F.col("_t")[f"_p_{n}"].alias(n) for n in values], F.struct(q(order).alias("o"), F.col("_i").alias("i")).alias(order))
    return rows.filter(q(label).isNotNull()) if label_required else rows


def union_all(frames: list[DataFrame], fill: bool = False) -> DataFrame:
    """Rows of all frames by column name; ``fill`` allows missing columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=fill)
    return out


def ordered_distinct(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.groupBy(*[q(k) for k in keys]).agg(F.min(q(order)).alias(order))
