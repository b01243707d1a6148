"""Sample annotation: match observations with annotation rows, then keep, require or select."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.errors import EXAMPLES, AnnotationError, some
from quantloom.functions.text import ms_basename, sanitize_name
from quantloom.operators.align import select_observations
from quantloom.operators.axis import q
from quantloom.result import OBS, Level, Levels

#: Names of either side that a fuzzy match compares in one task.
FUZZY_BLOCK = 512
_KEY = re.compile(r"(?i)^(?:channel|relative|raw|file|run)")


def tokens(name: str | None) -> str:
    return " ".join(re.findall(r"[a-z0-9]+", (name or "").lower()))


def similarity(left: str, right: str) -> float:
    """Ratio of matching characters between the alphanumeric tokens of two names."""
    return SequenceMatcher(None, tokens(left), tokens(right), autojunk=False).ratio()


def _block_best(near: int):
    """Of one block of observations and one of rows, the pairs among the best of their observation or row.

    A pair whose upper bound is below both is not scored in full.
    """

    def run(observations, rows):
        import pandas as pd

        left = [(o, tokens(a)) for o, a in zip(observations[OBS], observations["a"], strict=True)]
        by_obs: dict[int, list] = {o: [] for o, _ in left}
        best: dict[tuple[int, int], float] = {}
        matcher = SequenceMatcher(None, autojunk=False)
        for r, b in zip(rows["_row"], rows["b"], strict=True):
            matcher.set_seq2(tokens(b))
            by_row: list = []
            for o, a in left:
                own = by_obs[o]
                floor = min(-own[-1][0] if len(own) == near else -1.0, -by_row[-1][0] if len(by_row) == 2 else -1.0)
                matcher.set_seq1(a)
                if matcher.real_quick_ratio() < floor or matcher.quick_ratio() < floor:
                    continue
                score = matcher.ratio()
                own.append((-score, r))
                own.sort()
                del own[near:]
                by_row.append((-score, o))
                by_row.sort()
                del by_row[2:]
            best.update({(o, r): -s for s, o in by_row})
        best.update({(o, r): -s for o, own in by_obs.items() for s, r in own})
        return pd.DataFrame([(o, r, s) for (o, r), s in best.items()], columns=[OBS, "_row", "score"])

    return run


def annotation_key(columns: list[str]) -> str:
    """The one column that names runs; SDRF files name theirs."""
    if {"comment[data file]", "assay name"} & {c.lower() for c in columns}:
        return next(c for c in columns if c.lower() == "comment[data file]")
    found = [c for c in columns if _KEY.match(c)]
    if len(found) != 1:
        raise AnnotationError(f"annotation needs one column that names runs, found {found}")
    return found[0]


def require_label_free(df: DataFrame) -> None:
    """Multiplexed SDRF rows are refused."""
    label = next((c for c in df.columns if c.lower() == "comment[label]"), None)
    if label is None:
        return
    bad = df.filter(~F.lower(q(label)).contains("label free")).select(q(label)).distinct().limit(EXAMPLES).collect()
    if bad:
        raise AnnotationError(f"only label-free annotation is supported: {some(r[0] for r in bad)}")


def clean_names(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Plain column names; a name that comes up twice gets a number."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        name = c if c in keep else sanitize_name(c)
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}.{seen[name]}")
    return df.toDF(*out)


def match_exact(obs: DataFrame, key: str, table: DataFrame, table_key: str, alias: str | None = None, basename: bool = False) -> DataFrame:
    """(obs_pos, annotation row) pairs by equal (optionally base) names or aliases.

    Two rows under one name, or two observations under one normalised name, are refused.
    """
    norm = (lambda c: ms_basename(c)) if basename else (lambda c: c.cast("string"))
    names = table.select(q("_row"), norm(q(table_key)).alias("_n"))
    if alias and alias in table.columns:
        names = names.unionByName(table.select(q("_row"), F.explode(F.split(q(alias).cast("string"), r"\s*;\s*")).alias("_n")).withColumn("_n", norm(F.col("_n"))))
    names = names.filter(F.col("_n").isNotNull()).distinct()
    bad = names.groupBy("_n").count().filter("count > 1").limit(EXAMPLES).collect()
    if bad:
        raise AnnotationError(f"annotation rows share a name: {some(r[0] for r in bad)}")
    own = obs.select(OBS, norm(q(key)).alias("_n"))
    if basename:
        bad = own.filter(F.col("_n").isNotNull()).groupBy("_n").count().filter("count > 1").limit(EXAMPLES).collect()
        if bad:
            raise AnnotationError(f"observations share a base name: {some(r[0] for r in bad)}")
    return own.join(names, "_n").select(OBS, "_row")


def match_fuzzy(obs: DataFrame, key: str, table: DataFrame, table_key: str, cutoff: float, margin: float, near: int = 3) -> tuple[DataFrame, DataFrame]:
    """Exact pairs, then mutual best pairs of the rest; and near misses of what stays open.

    A pair needs the cutoff, and the margin over the runner-up on both sides.  Every
    observation is compared with every row, in blocks of ``FUZZY_BLOCK`` names a side;
    a block returns only what may be among the best, so no side or product has a limit.
    """
    exact = match_exact(obs, key, table, table_key).persist()
    left = obs.join(exact.select(OBS), OBS, "left_anti").select(OBS, q(key).cast("string").alias("a")).persist()
    right = table.join(exact.select("_row"), "_row", "left_anti").select("_row", q(table_key).cast("string").alias("b")).persist()
    n_left, n_right = (max(1, -(-side.count() // FUZZY_BLOCK)) for side in (left, right))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    one = left.withColumn("_lb", dealt(OBS, n_left)).withColumn("_rb", every(n_right)).groupBy("_lb", "_rb")
    other = right.withColumn("_rb", dealt("_row", n_right)).withColumn("_lb", every(n_left)).groupBy("_lb", "_rb")
    scored = one.cogroup(other).applyInPandas(_block_best(max(near, 2)), f"{OBS} long, _row long, score double")
    by_obs, by_row = Window.partitionBy(OBS).orderBy(F.desc("score"), "_row"), Window.partitionBy("_row").orderBy(F.desc("score"), OBS)
    ranked = scored.select("*", F.row_number().over(by_obs).alias("ro"), F.lead("score", 1, 0.0).over(by_obs).alias("so"), F.row_number().over(by_row).alias("rr"), F.lead("score", 1, 0.0).over(by_row).alias("sr")).persist()
    pairs = ranked.filter((F.col("ro") == 1) & (F.col("rr") == 1) & (F.col("score") >= cutoff) & (F.col("score") - F.col("so") >= margin) & (F.col("score") - F.col("sr") >= margin))
    found = exact.unionByName(pairs.select(OBS, "_row"))
    misses = ranked.join(pairs.select(OBS), OBS, "left_anti").filter(F.col("ro") <= near).select(OBS, "_row", "score")
    return found, misses


@dataclass(frozen=True)
class Coverage:
    matched: int
    only_observations: int
    only_annotation: int
    observation_examples: tuple = ()
    annotation_examples: tuple = ()


def coverage(obs: DataFrame, key: str, table: DataFrame, table_key: str, pairs: DataFrame) -> Coverage:
    """Counts and up to five examples in both directions."""
    lone = obs.join(pairs.select(OBS), OBS, "left_anti")
    spare = table.join(pairs.select("_row"), "_row", "left_anti")
    examples = lambda df, k: tuple(r[0] for r in df.select(q(k).cast("string")).orderBy(q(k)).limit(EXAMPLES).collect())
    return Coverage(pairs.count(), lone.count(), spare.count(), examples(lone, key), examples(spare, table_key))


def annotate(level: Level, table: DataFrame, table_key: str | None = None, *, unmatched: str = "keep", include: str | None = None, fuzzy: tuple[float, float] | None = None, basename: bool = False, alias: str = "alias") -> tuple[Level, Coverage]:
    """The level with annotation columns on its observations.

    ``unmatched``: ``keep`` (null metadata), ``error`` (all must match), ``drop``
    (only matched ones stay; with ``include`` only where that Boolean is true).
    No match at all is always an error.
    """
    if unmatched not in ("keep", "error", "drop"):
        raise ValueError(f"unmatched is keep, error or drop, not {unmatched!r}")
    require_label_free(table)
    key = table_key or annotation_key(table.columns)
    if len(level.obs_keys) != 1:
        raise AnnotationError(f"annotation matches one observation key, not {level.obs_keys}")
    own_key = level.obs_keys[0]
    clean = clean_names(table, (key,)).withColumn("_row", F.monotonically_increasing_id()).persist()
    columns = [c for c in clean.columns if c not in (key, "_row")]
    if clash := set(columns) & set(level.obs.columns):
        raise AnnotationError(f"annotation columns exist already: {sorted(clash)}")
    if fuzzy:
        pairs, _ = match_fuzzy(level.obs, own_key, clean, key, *fuzzy)
    else:
        pairs = match_exact(level.obs, own_key, clean, key, alias, basename)
    pairs = pairs.persist()
    seen = coverage(level.obs, own_key, clean, key, pairs)
    if not seen.matched:
        raise AnnotationError(f"no observation matches the annotation; observations {seen.observation_examples}, annotation {seen.annotation_examples}")
    if unmatched == "error" and seen.only_observations:
        raise AnnotationError(f"{seen.only_observations} observations are without annotation: {some(seen.observation_examples)}")
    obs = level.obs.join(pairs, OBS, "left").join(clean.drop(key), "_row", "left")
    level = replace(level, obs=obs.drop("_row"), uns=level.uns | {"annotation": {"matched": seen.matched, "unmatched": seen.only_observations, "policy": unmatched}})
    if unmatched == "drop":
        keep = pairs.select(OBS)
        if include:
            if include not in columns or clean.schema[include].dataType.typeName() != "boolean":
                raise AnnotationError(f"selection column {include!r} must be a Boolean annotation column")
            hit = pairs.join(clean, "_row")
            if hit.filter(q(include).isNull()).limit(1).count():
                raise AnnotationError(f"selection column {include!r} is missing for matched observations")
            keep = hit.filter(q(include)).select(OBS)
        level = select_observations(level, keep)
    return level, seen


def annotate_all(result: Levels, table: DataFrame, **options) -> tuple[Levels, dict[str, Coverage]]:
    done = {n: annotate(x, table, **options) for n, x in result.levels.items()}
    return replace(result, levels={n: d[0] for n, d in done.items()}), {n: d[1] for n, d in done.items()}
