"""Population beside the counts: rolling rates from summed cases, never from summed rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from weekwatch.functions.numbers import rate_100k, round_even

ROLLING = {"rate_4w": 4, "rate_8w": 8, "rate_12w": 12, "rate_year": 52}


def join_population(grid: DataFrame, population: DataFrame) -> DataFrame:
    """(place, epi_year) lookup; a missing pair stays null. The table is (places x years) small."""
    return grid.join(population, ["place", "epi_year"], "left")


def missing_population(grid: DataFrame, population: DataFrame) -> DataFrame:
    """Places and years of the grid without a population row."""
    return grid.select("place", "epi_year").distinct().join(population, ["place", "epi_year"], "left_anti")


def add_rates(grid: DataFrame) -> DataFrame:
    """Density and the five rates; windows divide their summed cases by the row's own population."""
    trail = W.partitionBy("place", "kind").orderBy("week_index")
    pop = F.col("population")
    out = {
        "density": round_even(F.try_divide(pop, F.col("area_km2")), 2),
        "rate_1w": rate_100k(F.col("cases"), pop),
    }
    for name, n in ROLLING.items():
        out[name] = rate_100k(F.sum("cases").over(trail.rowsBetween(-(n - 1), 0)), pop)
    return grid.withColumns(out)


def population_block(grid: DataFrame, population: DataFrame) -> DataFrame:
    return add_rates(join_population(grid.drop("population", "population_type"), population))


def all_kinds(grid: DataFrame, label: str = "TOTAL") -> DataFrame:
    """Explicit total over diseases: summed cases, the population once, one division."""
    keys = ["place", "place_name", "epi_year", "epi_week", "week_start", "week_end"]
    aggs = [F.sum("cases").alias("cases")]
    has_pop = "population" in grid.columns
    if has_pop:
        aggs += [F.max("population").alias("population"), F.max("population_type").alias("population_type")]
    out = grid.groupBy(*keys).agg(*aggs).withColumn("kind", F.lit(label))
    return out.withColumn("rate_combined", rate_100k(F.col("cases"), F.col("population"))) if has_pop else out


def city_population(grid: DataFrame) -> DataFrame:
    """(kind, epi_year, city_population): each place counted once per year."""
    return (
        grid.groupBy("kind", "place", "epi_year")
        .agg(F.max("population").alias("population"))
        .groupBy("kind", "epi_year")
        .agg(F.sum("population").alias("city_population"))
    )


def city_series(grid: DataFrame) -> DataFrame:
    """Weekly city totals per kind with the rate from totals; series_index is 0, 1, 2, ... per kind."""
    weekly = grid.groupBy("kind", "epi_year", "epi_week", "week_start").agg(F.sum("cases").alias("cases"))
    order = W.partitionBy("kind").orderBy("week_start")
    out = weekly.withColumn("series_index", F.row_number().over(order) - 1)
    if "population" not in grid.columns:
        return out.withColumn("city_population", F.lit(None).cast("bigint")).withColumn("rate", F.lit(None).cast("double"))
    return out.join(city_population(grid), ["kind", "epi_year"], "left").withColumn(
        "rate", rate_100k(F.col("cases"), F.col("city_population"))
    )
