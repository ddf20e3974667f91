"""Observed priority of places in a reference week, in one conditional pass over the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weekwatch.contracts import SEASON_HALF_WIDTH
from weekwatch.functions.numbers import (
    RATIO_EPS, TREND_UP, change_pct, pct, rate_100k, round_even, trend_label,
)

RECENT = 4


def reference_week(grid: DataFrame, year: int | None = None, week: int | None = None) -> DataFrame:
    """One row: the asked week, or the latest one present, with its index."""
    rows = grid.select("epi_year", "epi_week", "week_index")
    if year is not None and week is not None:
        rows = rows.where((F.col("epi_year") == year) & (F.col("epi_week") == week))
    return rows.agg(F.max(F.struct("week_index", "epi_year", "epi_week")).alias("r")).select("r.*")


def observed_priority(grid: DataFrame, year: int | None = None, week: int | None = None, window: int = RECENT) -> DataFrame:
    """Cases now, in the last and the previous window, change, seasonal mean of earlier years, ratio, rates."""
    ref = reference_week(grid, year, week)
    idx, y, w = (ref.select(c).scalar() for c in ("week_index", "epi_year", "epi_week"))
    at = F.col("week_index")
    cases = F.col("cases")
    now = at == idx
    season = (F.col("epi_year") < y) & F.col("epi_week").between(
        F.greatest(F.lit(1), w - SEASON_HALF_WIDTH), F.least(F.lit(53), w + SEASON_HALF_WIDTH)
    )
    out = grid.groupBy("place", "place_name", "region", "kind").agg(
        F.sum(F.when(now, cases)).alias("cases_week"),
        F.sum(F.when(at.between(idx - window + 1, idx), cases)).alias("cases_recent"),
        F.sum(F.when(at.between(idx - 2 * window + 1, idx - window), cases)).alias("cases_before"),
        F.avg(F.when(season, cases)).alias("season_mean"),
        F.count_if(season).alias("season_n"),
        F.max(F.when(now, F.col("population"))).alias("population"),
        F.max(F.when(now, F.col("population_type"))).alias("population_type"),
        F.max(F.when(now, F.col("density"))).alias("density"),
    ).where(F.col("cases_week").isNotNull())
    recent = F.coalesce("cases_recent", F.lit(0))
    return out.withColumns(
        {
            "rate_week": rate_100k(F.col("cases_week"), F.col("population")),
            "rate_recent": rate_100k(recent, F.col("population")),
            "change_pct": change_pct(recent, F.col("cases_before")),
            "history_ratio": round_even(recent / (F.coalesce("season_mean", F.lit(0.0)) * window + RATIO_EPS), 2),
        }
    ).withColumn("trend", trend_label(F.col("change_pct")))


def situation(priority: DataFrame) -> DataFrame:
    """City figures per kind: totals first, one division each."""
    now, before = F.sum(F.coalesce("cases_recent", F.lit(0))), F.sum(F.coalesce("cases_before", F.lit(0)))
    out = priority.groupBy("kind").agg(
        F.sum("cases_week").alias("cases_week"),
        now.alias("cases_recent"),
        before.alias("cases_before"),
        F.count_if(F.col("cases_week") > 0).alias("places_with_case"),
        F.count_if(F.col("trend") == TREND_UP).alias("places_rising"),
        F.count_if(F.col("history_ratio") > 1.0).alias("places_above_history"),
        F.count(F.lit(1)).alias("n_places"),
        F.sum("population").alias("_pop"),
    )
    change = F.when(F.col("cases_before") > 0, pct((F.col("cases_recent") - F.col("cases_before")), F.col("cases_before"), 1))
    return out.withColumns(
        {"change_pct": change, "rate_recent": rate_100k(F.col("cases_recent"), F.col("_pop"))}
    ).withColumn("trend", trend_label(F.col("change_pct"))).drop("_pop")


RANKINGS = {
    "volume": "cases_recent", "rate": "rate_recent", "growth": "change_pct", "deviation": "history_ratio",
}


def observed_rankings(priority: DataFrame) -> DataFrame:
    """Four separate rankings in long form, undefined values last, ties by place."""
    from pyspark.sql import Window as W

    items = F.array(*[F.struct(F.lit(n).alias("ranking"), F.col(c).cast("double").alias("value")) for n, c in RANKINGS.items()])
    long = priority.select("place", "kind", F.explode(items).alias("_i")).select("place", "kind", "_i.*")
    order = W.partitionBy("kind", "ranking").orderBy(F.desc_nulls_last("value"), "place")
    return long.withColumn("position", F.row_number().over(order))
