"""Statistics of layers for the sidecar: single aggregations, nothing collected but results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.axis import q
from quantloom.store.shared import written

OBSERVATIONS = 100
SAMPLE = 100_000


def finite(col: Column) -> Column:
    return F.coalesce(F.abs(col.cast("double")) < float("inf"), F.lit(False))


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows with their rank in key order (``_rank``, from 0): ranks in range partitions, after the sizes of those before."""
    parts = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[q(k) for k in keys]).withColumn("_p", F.spark_partition_id())
    local = written(parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*[q(k) for k in keys])) - 1), name)
    sizes = local.groupBy("_p").agg(F.count("*").alias("_n"))  # one row for each partition
    before = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return local.join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn("_rank", F.col("_b") + F.col("_r"))


def six_numbers(df: DataFrame, name: str) -> DataFrame:
    """min, first quartile, median, mean, third quartile, max of present values (linear quantiles).

    Values are counted first, so a hot value is one row; a quantile is read off the running
    counts of range partitions, which no task holds as a whole.
    """
    x = q(name).cast("double")
    counts = written(df.filter(finite(q(name))).groupBy(x.alias("x")).agg(F.count("*").alias("n")), "value-counts")
    moments = counts.agg(F.min("x").alias("min"), F.max("x").alias("max"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("total"))
    parts = counts.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x").withColumn("_p", F.spark_partition_id())
    upto = F.sum("n").over(Window.partitionBy("_p").orderBy("x"))
    local = written(parts.withColumn("_upto", upto), "value-ranks")
    sizes = local.groupBy("_p").agg(F.sum("n").alias("_n"))
    before = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    ranks = local.join(F.broadcast(before), F.col("_p") == F.col("_q")).select("x", (F.col("_b") + F.col("_upto")).alias("upto")).join(F.broadcast(moments.select("total")))
    out = []
    for share, label in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
        at = (F.col("total") - 1) * F.lit(share)
        low = F.min(F.when(F.col("upto") > F.floor(at), F.col("x")))
        high = F.min(F.when(F.col("upto") > F.ceil(at), F.col("x")))
        weight = F.max(at - F.floor(at))
        out.append((low + (high - low) * weight).alias(label))
    return moments.drop("total").join(F.broadcast(ranks.agg(*out))).select("min", "q1", "median", "mean", "q3", "max")


def _moments(name: str) -> list[Column]:
    v = q(name).cast("double")
    x = F.when(finite(v), v)
    return [
        F.count("*").alias("total"), F.count(x).alias("finite"), F.count_if(v.isNull()).alias("nulls"), F.count_if(F.isnan(v)).alias("nans"),
        F.count_if(v == float("inf")).alias("pos_inf"), F.count_if(v == float("-inf")).alias("neg_inf"), F.count_if(v == 0).alias("zeros"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"),
    ]


def layer_moments(cells: DataFrame, name: str) -> DataFrame:
    return cells.agg(*_moments(name))


def observation_moments(cells: DataFrame, name: str, obs: str = "obs_pos", first: int = OBSERVATIONS) -> DataFrame:
    """Moments of each of the first observations (a report of a fixed size)."""
    return cells.filter(q(obs) < first).groupBy(q(obs)).agg(*_moments(name))


def grid_quartiles(cells: DataFrame, name: str, keys: list[str], most: int = SAMPLE) -> DataFrame:
    """Quartiles of at most ``most`` finite cells on an even grid over the ordered cells.

    Below the limit all cells count.  Ranks come from range partitions and their
    sizes, not from one sorted task.
    """
    own = cells.filter(finite(q(name))).select(*[q(k) for k in keys], q(name).cast("double").alias("_v"))
    n = own.count()
    if n > most:
        local = _ranked(own, keys, "grid")
        # rank r is on the grid i * (n - 1) // (most - 1) if some i maps to it
        own = local.filter(F.expr(f"((_rank * {most - 1} + {n - 2}) div {n - 1}) * {n - 1} div {most - 1} = _rank"))
    p = F.percentile(F.col("_v"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return own.agg(p[0].alias("q1"), p[1].alias("median"), p[2].alias("q3"), F.count("*").alias("n_sampled"))


def factor_counts(cells: DataFrame, name: str, codes: list[int]) -> DataFrame:
    known = q(name).isin(*codes)
    return cells.agg(F.count_if(known).alias("known"), F.count_if(~F.coalesce(known, F.lit(False))).alias("missing"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row: missing values of each column."""
    return df.agg(*[F.count_if(q(c).isNull()).alias(c) for c in df.columns])


def relation_blocks(edges: DataFrame) -> DataFrame:
    """Edges between each pair of levels."""
    return edges.groupBy("source", "target").agg(F.count("*").alias("n_edges"))
