"""Descriptive tables over the weekly grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weekwatch.functions.numbers import pct, rate_100k, round_even
from weekwatch.functions.ordered import row_numbers
from weekwatch.operators.weather import real_cell_rows, real_station_rows

WEEK = ["epi_year", "epi_week"]


def _has_station(c: str = "valid_days_week"):
    return F.coalesce(c, F.lit(0)) > 0


def week_coverage(grid: DataFrame) -> DataFrame:
    """Per week: cases, places with cases, rows with a real reading, mean rain."""
    return grid.groupBy(*WEEK).agg(
        F.min("week_start").alias("week_start"),
        F.sum("cases").alias("cases"),
        F.count_if(F.col("cases") > 0).alias("rows_with_case"),
        F.count_if(_has_station()).alias("rows_with_reading"),
        F.avg("rain_week").alias("rain_mean"),
    )


def place_totals(grid: DataFrame) -> DataFrame:
    return grid.groupBy("place", "place_name").agg(
        F.sum("cases").alias("cases"),
        F.min("area_km2").alias("area_km2"),
        F.count_if(F.col("cases") > 0).alias("rows_with_case"),
        F.min("source").alias("source"),
        F.min("station_km").alias("station_km"),
    )


def kpis(grid: DataFrame) -> DataFrame:
    week = F.col("epi_year") * 100 + F.col("epi_week")
    return grid.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("cases").alias("cases"),
        F.countDistinct("place").alias("n_places"),
        F.min("epi_year").alias("first_year"),
        F.max("epi_year").alias("last_year"),
        F.countDistinct(week).alias("n_weeks"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
        F.countDistinct(F.when(F.col("cases") > 0, F.col("place"))).alias("places_with_case"),
        F.countDistinct(F.when(_has_station(), F.col("place"))).alias("places_with_reading"),
        pct(F.count_if(_has_station()), F.count(F.lit(1)), 4).alias("pct_rows_with_reading"),
    )


def weekly_series(grid: DataFrame, per_kind: bool = True) -> DataFrame:
    keys = WEEK + ["week_start"] + (["kind"] if per_kind else [])
    return grid.groupBy(*keys).agg(F.sum("cases").alias("cases"))


def kinds_by_year(grid: DataFrame) -> DataFrame:
    return grid.groupBy("epi_year", "kind").agg(F.sum("cases").alias("cases"))


def seasonality(grid: DataFrame) -> DataFrame:
    """Sum per (year, week) first, then total, mean and observed years per week."""
    per_year = grid.groupBy(*WEEK).agg(F.sum("cases").alias("cases"))
    return per_year.groupBy("epi_week").agg(
        F.sum("cases").alias("total"), F.avg("cases").alias("mean_per_year"), F.countDistinct("epi_year").alias("n_years")
    )


def year_by_week(grid: DataFrame, first_week: int = 1, last_week: int = 53) -> DataFrame:
    """Week x year heat map: one column per week, absent weeks as 0."""
    weeks = list(range(first_week, last_week + 1))
    wide = grid.groupBy("epi_year").pivot("epi_week", weeks).agg(F.sum("cases"))
    return wide.select("epi_year", *[F.coalesce(F.col(str(w)), F.lit(0)).alias(f"w{w:02d}") for w in weeks])


def region_by_year(grid: DataFrame, years: list[int]) -> DataFrame:
    wide = grid.groupBy("region").pivot("epi_year", years).agg(F.sum("cases"))
    return wide.select("region", *[F.coalesce(F.col(str(y)), F.lit(0)).alias(f"y{y}") for y in years])


def station_coverage(grid: DataFrame) -> DataFrame:
    has = _has_station()
    n_places = F.countDistinct("place")
    with_places = F.countDistinct(F.when(has, F.col("place")))
    return grid.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(has).alias("rows_with_reading"),
        pct(F.count_if(has), F.count(F.lit(1)), 4).alias("pct_rows"),
        with_places.alias("places_with_reading"),
        n_places.alias("n_places"),
        pct(with_places, n_places, 2).alias("pct_places"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.when(has, F.col("epi_year")))), lambda y: y.cast("string")), ",").alias("years"),
        F.countDistinct(F.when(has, F.col("station"))).alias("n_stations"),
        F.array_join(F.array_sort(F.collect_set(F.when(has, F.col("source")))), ",").alias("sources"),
    )


def station_coverage_by_year(grid: DataFrame) -> DataFrame:
    has = _has_station()
    n_places = F.countDistinct("place")
    with_places = F.countDistinct(F.when(has, F.col("place")))
    return grid.groupBy("epi_year").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(has).alias("rows_with_reading"),
        pct(F.count_if(has), F.count(F.lit(1)), 4).alias("pct_rows"),
        with_places.alias("places_with_reading"),
        pct(with_places, n_places, 2).alias("pct_places"),
    )


def station_coverage_by_place(grid: DataFrame) -> DataFrame:
    weeks = grid.agg(F.countDistinct(F.col("epi_year") * 100 + F.col("epi_week")).alias("n")).select("n").scalar()
    has = _has_station()
    return grid.groupBy("place", "place_name").agg(F.count_if(has).alias("rows_with_reading")).withColumn(
        "pct_weeks", pct(F.col("rows_with_reading"), weeks, 2)
    )


def station_coverage_grid(grid: DataFrame) -> DataFrame:
    """(year, week) with the share of places that have a reading; weeks without any stay as 0."""
    n_places = grid.agg(F.countDistinct("place").alias("n")).select("n").scalar()
    return grid.groupBy(*WEEK).agg(
        F.countDistinct(F.when(_has_station(), F.col("place"))).alias("places_with_reading")
    ).withColumn("pct_places", pct(F.col("places_with_reading"), n_places, 2))


def rain_series(grid: DataFrame) -> DataFrame:
    """Weekly mean rain over rows with a real reading; weeks without one are absent, not 0."""
    return real_station_rows(grid).groupBy(*WEEK, "week_start").agg(
        F.avg("rain_week").alias("rain_mean"), F.countDistinct("place").alias("n_places")
    )


def rate_coverage_by_year(grid: DataFrame) -> DataFrame:
    return grid.groupBy("epi_year").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("rate_1w").alias("rows_with_rate"),
        pct(F.count("rate_1w"), F.count(F.lit(1)), 2).alias("pct_rows"),
    )


def cell_coverage(grid: DataFrame) -> DataFrame:
    has = _has_station("cell_rain_valid_days")
    weekly = real_cell_rows(grid).groupBy(*WEEK).agg(F.countDistinct("cell_rain_1w").alias("n"))
    return grid.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(has).alias("rows_with_cell"),
        pct(F.count_if(has), F.count(F.lit(1)), 4).alias("pct_rows"),
        F.countDistinct(F.when(has, F.col("rain_cell"))).alias("n_rain_cells"),
        F.countDistinct(F.when(has, F.col("temp_cell"))).alias("n_temp_cells"),
    ).withColumn("distinct_values_median", weekly.agg(F.percentile("n", 0.5).alias("m")).select("m").scalar())


def double_coverage_by_year(grid: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return grid.groupBy("epi_year").agg(
        n.alias("n_rows"),
        pct(F.count_if(_has_station("cell_rain_valid_days")), n, 2).alias("pct_cell"),
        pct(F.count_if(_has_station()), n, 2).alias("pct_station"),
    )


CELL_MEANS = {
    "rain_mm": "cell_rain_1w", "temp_mean": "cell_temp_mean", "temp_min": "cell_temp_min",
    "temp_max": "cell_temp_max", "humidity": "cell_humidity",
}


def cell_series(grid: DataFrame) -> DataFrame:
    """City means per week after one row per place and week (weather repeats over kinds)."""
    once = real_cell_rows(grid).groupBy("place", *WEEK, "week_start").agg(
        *[F.max(c).alias(c) for c in CELL_MEANS.values()]
    )
    return once.groupBy(*WEEK, "week_start").agg(
        *[F.avg(c).alias(n) for n, c in CELL_MEANS.items()], F.count(F.lit(1)).alias("n_places")
    )


def cell_seasonality(grid: DataFrame) -> DataFrame:
    return cell_series(grid).groupBy("epi_week").agg(
        F.avg("rain_mm").alias("rain_mean"),
        F.avg("temp_mean").alias("temp_mean"),
        F.avg("humidity").alias("humidity_mean"),
        F.countDistinct("epi_year").alias("n_years"),
    )


def rank_places(grid: DataFrame, top_n: int | None = 10, ascending: bool = False) -> DataFrame:
    """Places by total cases with their position; TakeOrdered when a limit is given, ranges of the order otherwise."""
    from pyspark.sql import Window as W

    totals = grid.groupBy("place", "place_name").agg(F.sum("cases").alias("cases"))
    order = [F.asc("cases") if ascending else F.desc("cases"), F.asc("place")]
    if top_n is None:
        return row_numbers(totals, order, "position")
    # at most top_n rows
    return totals.orderBy(*order).limit(top_n).withColumn("position", F.row_number().over(W.orderBy(*order)))


def yearly_cases(grid: DataFrame, factor: float = 1.5) -> DataFrame:
    """Cases and rate per year, years at or above factor x the median, the peak year and week."""
    cases = grid.groupBy("epi_year").agg(F.sum("cases").alias("cases"))
    pop = (
        grid.groupBy("place", "epi_year").agg(F.max("population").alias("p"))
        .groupBy("epi_year").agg(F.sum("p").alias("population"))
    )
    median = cases.agg(F.percentile("cases", 0.5).alias("m")).select("m").scalar()
    peak = cases.agg(F.max_by("epi_year", F.struct("cases", -F.col("epi_year"))).alias("y")).select("y").scalar()
    week = seasonality(grid).agg(F.max_by("epi_week", F.struct("mean_per_year", -F.col("epi_week"))).alias("w")).select("w").scalar()
    return cases.join(pop, "epi_year", "left").withColumns(
        {
            "rate": round_even(rate_100k(F.col("cases"), F.col("population")), 1),
            "high_year": (median > 0) & (F.col("cases") >= factor * median),
            "peak_year": F.col("epi_year") == peak,
            "peak_week": week,
        }
    )


def small_places(states: DataFrame) -> DataFrame:
    """Places with median population up to the quarter quantile: events by weekly and 4-week rate."""
    per = states.groupBy("place").agg(F.percentile("population", 0.5).alias("median_population"))
    cut = per.agg(F.percentile("median_population", 0.25).alias("q")).select("q").scalar()
    small = per.select("place", (F.col("median_population") <= cut).alias("small"))
    return states.join(small, "place").groupBy("small").agg(
        F.countDistinct("place").alias("n_places"),
        F.count_if(F.col("state_rate") == 1).alias("weekly_events"),
        F.count_if(F.col("state_rate_4w") == 1).alias("four_week_events"),
    )


def moving_average(series: DataFrame, value: str, window: int = 4, by: tuple[str, ...] = ("kind",)) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy(*by).orderBy("week_start").rowsBetween(-(window - 1), 0)
    return series.withColumn(f"{value}_ma{window}", F.avg(value).over(w))


def latest_week(grid: DataFrame) -> DataFrame:
    return grid.agg(F.max(F.struct("epi_year", "epi_week")).alias("w")).select("w.*")


def weeks_newest_first(grid: DataFrame, limit: int | None = None) -> DataFrame:
    out = grid.select(*WEEK, "week_start").distinct().orderBy(F.desc("week_start"))
    return out.limit(limit) if limit else out


def table_span(grid: DataFrame) -> DataFrame:
    """First week start, last week end and the distinct places: inputs of a backfill request."""
    return grid.agg(
        F.min("week_start").alias("first_day"), F.max("week_end").alias("last_day"), F.countDistinct("place").alias("n_places")
    )


def distinct_centroids(grid: DataFrame) -> DataFrame:
    return grid.groupBy("place").agg(F.min("place_name").alias("place_name"), F.min("lat").alias("lat"), F.min("lon").alias("lon"))
