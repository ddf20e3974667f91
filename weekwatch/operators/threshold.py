"""Local alert thresholds from earlier years only, and the states they give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from weekwatch.contracts import MIN_GENERAL, MIN_SEASONAL, SEASON_HALF_WIDTH, THRESHOLD_Q

BY = ("place", "kind")
STATE_COLUMNS = ("threshold", "threshold_type", "n_history", "state", "week_mean", "week_std", "week_n")


def alert_state(grid: DataFrame, value: str = "cases", by: Sequence[str] = BY, suffix: str = "") -> DataFrame:
    """Adds threshold, its type and sample size, the 0/1/null state and the same-week history.

    Seasonal: 90th percentile of the same place in earlier years, weeks within two of the
    row's week without wrapping the year, if there are 15 values; else of the whole earlier
    history if there are 20; else undefined. Each history row is sent to the five weeks it
    counts for, so one window per (place, kind, week) replaces a self join.
    """
    week = F.col("epi_week")
    reach = F.sequence(
        F.greatest(F.lit(1), week - SEASON_HALF_WIDTH), F.least(F.lit(53), week + SEASON_HALF_WIDTH)
    )
    earlier = W.partitionBy(*by, "_target").orderBy("epi_year").rangeBetween(W.unboundedPreceding, -1)
    history = W.partitionBy(*by).orderBy("epi_year").rangeBetween(W.unboundedPreceding, -1)
    v = F.col(value)
    same_week = F.when(F.col("epi_week") == F.col("_target"), v)
    seasonal = (
        grid.withColumn("_target", F.explode(reach))
        .withColumns(
            {
                "_sp": F.percentile(v, THRESHOLD_Q).over(earlier),
                "_sn": F.count(v).over(earlier),
                "_wm": F.avg(same_week).over(earlier),
                "_ws": F.stddev_pop(same_week).over(earlier),
                "_wn": F.count(same_week).over(earlier),
            }
        )
        .where(F.col("epi_week") == F.col("_target"))
        .drop("_target")
    )
    both = seasonal.withColumns(
        {"_gp": F.percentile(v, THRESHOLD_Q).over(history), "_gn": F.count(v).over(history)}
    )
    is_seasonal, is_general = F.col("_sn") >= MIN_SEASONAL, F.col("_gn") >= MIN_GENERAL
    # rounded far below any meaning, so that a value equal to its threshold compares equal
    limit = F.rint(F.when(is_seasonal, F.col("_sp")).when(is_general, F.col("_gp")) * 1e9) / 1e9
    out = both.withColumns(
        {
            f"threshold{suffix}": limit,
            f"threshold_type{suffix}": F.when(is_seasonal, "sazonal").when(is_general, "geral").otherwise("indefinido"),
            f"n_history{suffix}": F.when(is_seasonal, F.col("_sn")).otherwise(F.col("_gn")),
            f"state{suffix}": F.when(v > limit, 1.0).when(limit.isNotNull(), 0.0),
            f"week_mean{suffix}": F.col("_wm"),
            f"week_std{suffix}": F.col("_ws"),
            f"week_n{suffix}": F.col("_wn"),
        }
    )
    return out.drop("_sp", "_sn", "_wm", "_ws", "_wn", "_gp", "_gn")


def experimental_state(states: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Alternative target: above the same-week mean and two rises in a row; null without history."""
    w = W.partitionBy(*by).orderBy("week_index")
    one, two = F.lag("cases", 1).over(w), F.lag("cases", 2).over(w)
    known = F.col("week_mean").isNotNull() & two.isNotNull()
    hit = (F.col("cases") > F.col("week_mean")) & (F.col("cases") > one) & (one > two)
    return states.withColumn("state_alt", F.when(known, F.when(hit, 1.0).otherwise(0.0)))
