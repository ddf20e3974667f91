"""Running totals and exact quantiles over values of any number of rows.

A plain running window over a whole table would pull it into one task. Here equal
values are first merged (map-side), approximate quantiles of the merged values only
choose where to split them into balanced ranges, each range is scanned on its own, and
the totals of the earlier ranges are added. The result does not depend on the splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weekwatch.session import cut_lineage

RANGES = 64


def cumulative_by_value(
    df: DataFrame, groups: list[str], value: str, sums: list[str], ranges: int = RANGES
) -> DataFrame:
    """One row per (groups, value) with `sums` added up and `cum_*` (ascending, inclusive) and `all_*`."""
    if not groups:
        # one constant group: the same plan for both, without a window over everything
        return cumulative_by_value(df.withColumn("_one", F.lit(1)), ["_one"], value, sums, ranges).drop("_one")
    merged = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(*[F.sum(s).alias(s) for s in sums])
    )
    points = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cut = F.percentile_approx(value, points, F.lit(1000)).alias("_cuts")
    # one row of at most `ranges` cut points per group
    with_cuts = merged.join(merged.groupBy(*groups).agg(cut), groups)
    ranged = with_cuts.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = ranged.groupBy(*groups, "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    # at most `ranges` rows per group
    whole = W.partitionBy(*groups)
    earlier = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *groups,
        "_range",
        *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"all_{s}") for s in sums],
    )
    inside = W.partitionBy(*groups, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.join(offsets, [*groups, "_range"])
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.sum(s).over(inside) + F.col(f"_o_{s}"))
    return out.drop("_range", *[f"_o_{s}" for s in sums])


def exact_percentiles(
    df: DataFrame, groups: list[str], value: str, qs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per entry of `qs`, plus `n`."""
    counted = df.withColumn("_n", F.col(weight) if weight else F.lit(1).cast("bigint"))
    cum = cumulative_by_value(counted, groups, value, ["_n"])
    v = F.col(value).cast("double")

    def at(rank):
        return F.min(F.when(F.col("cum__n") > rank, v))

    aggs, final = [F.max("all__n").alias("n")], []
    for name, q in qs.items():
        pos = F.lit(float(q)) * (F.col("all__n") - 1)
        aggs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}")]
        frac = F.lit(float(q)) * (F.col("n") - 1)
        frac = frac - F.floor(frac)
        final.append(
            (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * frac).alias(name)
        )
    agg = cum.groupBy(*groups).agg(*aggs) if groups else cum.agg(*aggs)
    return agg.select(*groups, "n", *final)


def row_numbers(df: DataFrame, order: list, name: str) -> DataFrame:
    """1..n by a total order. Ranges of the order are sorted on their own and the sizes of the earlier ones are added.

    The ranges are checkpointed, as a second sampling could draw other ones.
    """
    in_order = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    # one row per range
    sizes = in_order.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    number = F.col("_id") - F.shiftleft("_part", 33) + F.col("_o") + 1
    return in_order.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, number).drop("_id", "_part", "_o")


def dense_ranks(df: DataFrame, value: Column, name: str, descending: bool = True) -> DataFrame:
    """Dense rank by a value, nulls last: the distinct values are numbered, so a frequent value is one row until the join."""
    keyed = df.withColumn("_v", value)
    ranks = row_numbers(keyed.select("_v").distinct(), [F.desc_nulls_last("_v") if descending else F.asc_nulls_last("_v")], name)
    return keyed.join(ranks.withColumnRenamed("_v", "_w"), F.col("_v").eqNullSafe(F.col("_w"))).drop("_v", "_w")
