"""The driver's tables in the roles of the surveillance model.

place = nation, kind = order status, notification = order of a customer of that nation,
station = supplier, daily rain = quantities shipped by a supplier on a day,
population = customers of a nation grown by a fixed rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weekwatch.functions import dates
from weekwatch.operators import grid as G

# the kinds that gates and filters expect; grids take theirs from the data
KINDS = ("F", "O", "P")
FIRST_YEAR = 1995


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def places(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey").cast("bigint")
    return read(spark, sf, "nation").select(
        key.alias("place"),
        F.col("n_name").alias("place_name"),
        F.col("n_regionkey").cast("bigint").alias("region"),
        (F.lit(10.0) + 3 * key).alias("area_km2"),
        (F.lit(-8.0) - ((key * 7) % 25) * F.lit(0.01)).alias("lat"),
        (F.lit(-34.9) - ((key * 11) % 25) * F.lit(0.01)).alias("lon"),
    )


def customer_place(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("place")
    )


def case_counts(spark: SparkSession, sf: str) -> DataFrame:
    """(place, kind, week_start, cases).

    Orders are counted per customer, kind and week before they meet the customer table, so
    a customer with a third of all orders sends a handful of rows into the join.
    """
    week = dates.sunday_of(F.col("o_orderdate").cast("date"))
    per_customer = (
        read(spark, sf, "orders")
        .groupBy("o_custkey", F.col("o_orderstatus").alias("kind"), week.alias("week_start"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_customer.join(customer_place(spark, sf), "o_custkey")
        .groupBy("place", "kind", "week_start")
        .agg(F.sum("n").alias("cases"))
    )


def last_complete_year(spark: SparkSession, sf: str) -> int:
    """The last epidemiological year whose last week has orders; one number, read from one column."""
    newest = dates.sunday_of(F.max(F.col("o_orderdate").cast("date")))
    return read(spark, sf, "orders").agg(newest.alias("w")).select(dates.epi_year(F.date_add("w", 7)) - 1).first()[0]


def grid(spark: SparkSession, sf: str, whole_years: bool = False) -> DataFrame:
    """Dense counts over the observed weeks (or the whole epidemiological years), kinds and span from the counts."""
    return G.dense_grid(case_counts(spark, sf), places(spark, sf), whole_years=whole_years)


def base_population(spark: SparkSession, sf: str) -> DataFrame:
    return (
        read(spark, sf, "customer")
        .groupBy(F.col("c_nationkey").cast("bigint").alias("place"))
        .agg(F.count(F.lit(1)).alias("base"))
    )


def population(spark: SparkSession, sf: str) -> DataFrame:
    """(place, epi_year, population, population_type): 2 % of the base per year, up to the year after the last order."""
    year = F.col("epi_year")
    last = read(spark, sf, "orders").agg((dates.epi_year(F.max(F.col("o_orderdate").cast("date"))) + 1).alias("y")).select("y").scalar()
    return (
        base_population(spark, sf)
        .withColumn("_last", last)
        .withColumn("epi_year", F.explode(F.sequence(F.lit(FIRST_YEAR), F.col("_last").cast("int"))))
        .select(
            "place",
            "epi_year",
            (F.col("base") * (100 + 2 * (year - FIRST_YEAR))).cast("bigint").alias("population"),
            F.when(year <= 1996, "censo").when(year <= 1999, "estimativa").otherwise("projecao").alias("population_type"),
        )
    )


def stations(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(
        key.alias("station"),
        F.col("s_name").alias("station_name"),
        F.element_at(F.array(F.lit("APAC"), F.lit("CEMADEN"), F.lit("INMET")), (key % 3 + 1).cast("int")).alias("source"),
        (F.lit(-8.0) - ((key * 37) % 1000) * F.lit(0.0003)).alias("lat"),
        (F.lit(-34.9) - ((key * 53) % 1000) * F.lit(0.0003)).alias("lon"),
    )


def daily_rain(spark: SparkSession, sf: str) -> DataFrame:
    """(station, day, rain_mm): quantities shipped; a day without rows has no reading."""
    return (
        read(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("station"), F.col("l_shipdate").cast("date").alias("day"))
        .agg(F.sum("l_quantity").alias("rain_mm"))
    )


def cell_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Long gridded table: rain on 7 coarse cells (ERA5), temperature and humidity on 5 (ERA5-LAND), from one scan."""
    key = F.col("l_suppkey")
    cells = F.array(
        F.struct(F.lit("ERA5").alias("layer"), F.concat(F.lit("R"), (key % 7).cast("string")).alias("cell")),
        F.struct(F.lit("ERA5-LAND").alias("layer"), F.concat(F.lit("T"), (key % 5).cast("string")).alias("cell")),
    )
    items = read(spark, sf, "lineitem").select(F.explode(cells).alias("c"), F.col("l_shipdate").cast("date").alias("day"), "l_quantity", "l_tax", "l_discount")
    days = items.groupBy("c.layer", "c.cell", "day").agg(
        F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"), F.min("l_tax").alias("t"), F.max("l_discount").alias("d")
    )
    rain = F.col("layer") == "ERA5"
    mean = F.col("q") / F.col("n")
    return days.select(
        "layer", "cell", "day",
        F.when(rain, F.col("q") / 10).alias("rain_mm"),
        F.when(~rain, F.lit(20.0) + mean / 10).alias("temp_mean"),
        F.when(~rain, F.lit(15.0) + F.col("t") * 100).alias("temp_min"),
        F.when(~rain, F.lit(25.0) + F.col("d") * 100).alias("temp_max"),
        F.when(~rain, F.lit(50.0) + mean).alias("humidity"),
    )


def place_cells(spark: SparkSession, sf: str) -> DataFrame:
    """(place, layer, cell): two maps in long form."""
    p = places(spark, sf).select("place")
    rain = p.select("place", F.lit("ERA5").alias("layer"), F.concat(F.lit("R"), (F.col("place") % 7).cast("string")).alias("cell"))
    temp = p.select("place", F.lit("ERA5-LAND").alias("layer"), F.concat(F.lit("T"), (F.col("place") % 5).cast("string")).alias("cell"))
    return rain.unionByName(temp)
