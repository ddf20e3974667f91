"""Percentile intervals by resampling units or clusters, with draws that do not depend on partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKETS = 64


def dense_index(df: DataFrame, order: Sequence[Column], name: str = "index", groups: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """0..n-1 (in each group) by a total order of hash buckets and `order` inside them; no global window over rows.

    Any fixed numbering serves a resampling, so rows are numbered inside hash buckets and the
    bucket sizes (`buckets` rows a group; raise it with the rows) are added up.
    """
    b = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = b.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*groups) if groups else W.partitionBy()
    before = whole.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    numbered = b.withColumn("_r", F.row_number().over(W.partitionBy(*groups, "_b").orderBy(*order)) - 1)
    offsets = offsets if groups else F.broadcast(offsets)
    return numbered.join(offsets, [*groups, "_b"]).withColumn(name, F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")


def poisson_steps(rate: float = 1.0, most: int = 13) -> list[int]:
    """The Poisson distribution function at 0, 1, 2 ... on the scale of 32 bits: a number has as many counts as steps it reaches."""
    term, total, out = math.exp(-rate), 0.0, []
    for k in range(most):
        total += term
        out.append(math.floor(total * 2**32))
        term *= rate / (k + 1)
    return out


def draw_key(unit: Sequence[str], seed: int) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in unit])


def resampled(units: DataFrame, unit: Sequence[str], draws: int = 2000, seed: int = 42) -> DataFrame:
    """Each row once for every draw its unit is in, with `draw` and `weight`: how often the unit was drawn.

    The Poisson bootstrap: a unit's count in a draw is Poisson with mean 1, read from the md5 sum of seed, draw and unit. Counts are made
    where the rows are and do not depend on the number of units, so nothing is numbered or joined, and the
    sums by draw that follow are made in each task first.
    """
    number = F.conv(F.substring(F.md5(draw_key(unit, seed)), 1, 8), 16, 10).cast("bigint")
    first, *more = poisson_steps()
    weight = F.lit(1)
    for step in more:
        weight = weight + (F.col("_u") >= step).cast("int")
    # a few units become many rows: they are spread over as many tasks as a shuffle has
    spread = units.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), *unit)
    drawn = spread.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_u", number)
    return drawn.where(F.col("_u") >= first).withColumn("weight", weight).drop("_u")


def _interval(samples: DataFrame, observed: DataFrame, alpha: float) -> DataFrame:
    out = samples.agg(F.percentile("v", [alpha / 2, 1 - alpha / 2]).alias("q"), F.count("v").alias("n_draws"))
    return out.select(
        observed.select("v").scalar().alias("observed"), F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), "n_draws"
    )


def mean_interval(df: DataFrame, value: Column, unit: Sequence[str], draws: int = 2000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Interval of a mean (a recall of 0/1 hits); `unit` is the episode key or a cluster of episodes.

    A drawn cluster brings all its members. No rows give nulls.
    """
    units = df.groupBy(*unit).agg(F.count(F.lit(1)).alias("size"), F.sum(value.cast("double")).alias("total"))
    w = resampled(units, unit, draws, seed)
    per = w.groupBy("draw").agg((F.sum(F.col("weight") * F.col("total")) / F.sum(F.col("weight") * F.col("size"))).alias("v"))
    return _interval(per, df.agg(F.avg(value.cast("double")).alias("v")), alpha)


def difference_interval(df: DataFrame, a: Column, b: Column, unit: Sequence[str], draws: int = 2000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Interval of a paired difference of means: both sides see the same draws."""
    return mean_interval(df, a.cast("double") - b.cast("double"), unit, draws, seed, alpha)


def median_interval(df: DataFrame, value: Column, unit: Sequence[str], draws: int = 2000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Interval of a median; a drawn unit counts as often as it was drawn."""
    rows = df.withColumn("_v", value.cast("double")).where(F.col("_v").isNotNull())
    merged = rows.groupBy(*unit, "_v").agg(F.count(F.lit(1)).alias("_c"))
    # equal values of a draw are one row from here on
    counts = resampled(merged, unit, draws, seed).groupBy("draw", "_v").agg(F.sum(F.col("weight") * F.col("_c")).alias("_n"))
    per = counts.groupBy("draw").agg(F.percentile("_v", 0.5, F.col("_n")).alias("v"))
    return _interval(per, rows.agg(F.percentile("_v", 0.5).alias("v")), alpha)
