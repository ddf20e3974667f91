"""Readings per week: hourly to daily, trailing windows read at each week end, gridded cells.

A week-end window never needs a dense daily series: a reading of day d belongs to the windows
of the at most four week ends in [d, d+27], so every daily row is sent to those week ends and
summed there with map-side combine. `dense_daily` and `trailing_daily` give the daily form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weekwatch import contracts as C
from weekwatch.contracts import CELL_LIMITS, TEMPERATURE_RANGE
from weekwatch.functions.numbers import between_or_null, round_even
from weekwatch.operators import routing

DAYS = (7, 14, 21, 28)


def hourly_to_daily(hourly: DataFrame, keys: Sequence[str] = ("station", "day")) -> DataFrame:
    """Sums and extremes per station and day; rain is null only when no hour was valid."""
    aggs = [F.sum("rain").alias("rain_mm"), F.count("rain").alias("valid_hours")]
    for name in ("temperature", "humidity"):
        if name in hourly.columns:
            aggs += [
                F.min(name).alias(f"{name}_min"),
                F.max(name).alias(f"{name}_max"),
                F.avg(name).alias(f"{name}_mean"),
            ]
    return hourly.groupBy(*keys).agg(*aggs)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Overlapping snapshots: the latest row of a key wins. An aggregate, so a hot key combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def daily_rules() -> list[tuple[Column, str]]:
    """Reject reasons of a daily reading, first match wins."""
    rules = [
        (F.col("day").isNull(), C.NO_DAY),
        (F.col("station").isNull(), C.NO_STATION),
        (F.col("rain_mm") < 0, C.NEGATIVE_RAIN),
    ]
    for name in ("humidity_min", "humidity_max", "humidity_mean"):
        rules.append((~F.col(name).between(0, 100), f"{name} fora de 0-100"))
    return rules


def validate_daily(daily: DataFrame) -> DataFrame:
    """Adds reject_reason and temperature_warnings (a count that never rejects)."""
    low, high = TEMPERATURE_RANGE
    odd = sum(
        F.when(~F.col(c).between(low, high), 1).otherwise(0)
        for c in ("temperature_min", "temperature_max", "temperature_mean")
    )
    return routing.first_failing(daily, daily_rules()).withColumn("temperature_warnings", odd)


def bounded_cells(cells: DataFrame, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Implausible values become null while the row and its other values survive."""
    return cells.withColumns(
        {c: between_or_null(F.col(c), lo, hi) for c, (lo, hi) in (limits or CELL_LIMITS).items()}
    )


def out_of_range_counts(cells: DataFrame, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row per limited column: how many non-null values fall outside."""
    lim = limits or CELL_LIMITS
    counts = cells.agg(*[F.count_if(~F.col(c).between(lo, hi)).alias(c) for c, (lo, hi) in lim.items()])
    return counts.unpivot([], list(lim), "column_name", "out_of_range")


def _to_week_ends(daily: DataFrame, weeks_back: int) -> DataFrame:
    """One row per reading and week end it can reach; `age` is the distance in days."""
    own = F.date_add(F.date_sub("day", F.dayofweek("day") - 1), 6)
    return daily.withColumn(
        "week_end", F.explode(F.transform(F.sequence(F.lit(0), F.lit(weeks_back - 1)), lambda k: F.date_add(own, k * 7)))
    ).withColumn("age", F.datediff("week_end", "day"))


def station_windows(daily: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """(station, week_end) with 7/14/21/28-day sums, valid days and the week's own figures."""
    near = _to_week_ends(daily, 4).where(F.col("rain_mm").isNotNull())
    rain = F.col("rain_mm")
    week = F.col("age") < 7
    aggs = [F.sum(F.when(F.col("age") < n, rain)).alias(f"rain_{n}d") for n in DAYS]
    aggs += [F.count_if(F.col("age") < n).alias(f"valid_days_{n}d") for n in (7, 28)]
    aggs += [
        F.max(F.when(week, rain)).alias("rain_day_max"),
        F.when(F.count_if(week) > 0, F.count_if(week & (rain > 0))).alias("rain_days"),
    ]
    return near.groupBy(*keys, "week_end").agg(*aggs).withColumn(
        "rain_day_mean", F.col("rain_7d") / F.when(F.col("valid_days_7d") > 0, F.col("valid_days_7d"))
    )


def add_station_weather(grid: DataFrame, place_station: DataFrame, daily: DataFrame) -> DataFrame:
    """Weather of the mapped station as known at the week end; nothing later is read.

    Only readings of mapped stations are aggregated. Counts become 0 where a station is mapped
    but silent; amounts stay null.
    """
    mapped = place_station.select(F.col("place"), "station", "source", F.col("distance_km").alias("station_km"))
    used = mapped.select("station").distinct()
    windows = station_windows(daily.join(used, "station", "left_semi"))
    out = grid.join(mapped, "place", "left").join(windows, ["station", "week_end"], "left")
    has = F.col("station").isNotNull()
    for c in ("valid_days_7d", "valid_days_28d", "rain_days"):
        out = out.withColumn(c, F.when(has, F.coalesce(c, F.lit(0))))
    return out.withColumns(
        {
            "rain_week": F.col("rain_7d"),
            "valid_days_week": F.col("valid_days_7d"),
            "completeness": round_even(F.col("valid_days_7d") / 7, 3),
        }
    )


def dense_daily(daily: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Every day between a station's first and last reading, absent days as null.

    Each reading brings the days up to the next one, so the readings are scanned and shuffled once, for the same
    windows that follow.
    """
    next_day = F.lead("day").over(W.partitionBy(*keys).orderBy("day"))
    last = F.greatest("day", F.date_sub("_next", 1))
    filled = daily.withColumn("_next", next_day).withColumn("_day", F.explode(F.sequence("day", last)))
    others = [c for c in daily.columns if c not in (*keys, "day")]
    return filled.select(*keys, F.col("_day").alias("day"), *[F.when(F.col("_day") == F.col("day"), F.col(c)).alias(c) for c in others])


def trailing_daily(dense: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """What a rolling window with min_periods=1 gives each day of the dense series.

    Every window is a whole number of weeks, so one 7-row frame is computed and the longer sums
    add its values of 7, 14 and 21 rows before: a quarter of the frame work.
    """
    w = W.partitionBy(*keys).orderBy("day")
    week = w.rowsBetween(-6, 0)
    base = dense.withColumns({"_s": F.sum("rain_mm").over(week), "_n": F.count("rain_mm").over(week)})
    zero = F.lit(0)
    out, total, days = {}, F.coalesce("_s", zero), F.col("_n")
    for n in DAYS:
        if n > 7:
            total = total + F.coalesce(F.lag("_s", n - 7).over(w), zero)
            days = days + F.coalesce(F.lag("_n", n - 7).over(w), zero)
        out[f"rain_{n}d"], out[f"valid_days_{n}d"] = F.when(days > 0, total), days
    return base.withColumns(out).drop("_s", "_n")


def cell_windows(cells: DataFrame, rain_layer: str = "ERA5", temp_layer: str = "ERA5-LAND") -> tuple[DataFrame, DataFrame]:
    """(cell, week_end) rain sums over 1..4 weeks and the week's temperature and humidity."""
    near = _to_week_ends(cells.where(F.col("layer") == rain_layer).select("cell", "day", "rain_mm"), 4)
    rain = near.groupBy(F.col("cell").alias("rain_cell"), "week_end").agg(
        *[F.sum(F.when(F.col("age") < 7 * n, F.col("rain_mm"))).alias(f"cell_rain_{n}w") for n in (1, 2, 3, 4)],
        F.count(F.when(F.col("age") < 7, F.col("rain_mm"))).alias("cell_rain_valid_days"),
    )
    own = _to_week_ends(
        cells.where(F.col("layer") == temp_layer).select("cell", "day", "temp_mean", "temp_min", "temp_max", "humidity"), 1
    )
    temp = own.groupBy(F.col("cell").alias("temp_cell"), "week_end").agg(
        F.avg("temp_mean").alias("cell_temp_mean"),
        F.min("temp_min").alias("cell_temp_min"),
        F.max("temp_max").alias("cell_temp_max"),
        F.avg("humidity").alias("cell_humidity"),
        F.count("temp_mean").alias("cell_temp_valid_days"),
    )
    return rain, temp


def add_cell_weather(grid: DataFrame, place_cells: DataFrame, cells: DataFrame, rain_layer: str = "ERA5", temp_layer: str = "ERA5-LAND") -> DataFrame:
    """Gridded block of Gold 1.1: lookup of the two cells of a place, then the week-end windows."""
    maps = place_cells.groupBy("place").agg(
        F.max(F.when(F.col("layer") == rain_layer, F.col("cell"))).alias("rain_cell"),
        F.max(F.when(F.col("layer") == temp_layer, F.col("cell"))).alias("temp_cell"),
    )
    rain, temp = cell_windows(cells, rain_layer, temp_layer)
    out = grid.join(maps, "place", "left").join(rain, ["rain_cell", "week_end"], "left").join(temp, ["temp_cell", "week_end"], "left")
    out = out.withColumns(
        {
            "cell_rain_valid_days": F.when(F.col("rain_cell").isNotNull(), F.coalesce("cell_rain_valid_days", F.lit(0))),
            "cell_temp_valid_days": F.when(F.col("temp_cell").isNotNull(), F.coalesce("cell_temp_valid_days", F.lit(0))),
        }
    )
    return out.withColumn("cell_coverage", round_even(F.col("cell_rain_valid_days") / 7, 3))


def enrich_cell_weather(grid: DataFrame, place_cells: DataFrame, cells: DataFrame) -> DataFrame:
    """Same block computed at place x week (a third of the rows) and joined back; rerun-safe."""
    from weekwatch.contracts import GRIDDED_BLOCK

    bare = grid.drop(*GRIDDED_BLOCK)
    weeks = bare.select("place", "week_start", "week_end").distinct()
    block = add_cell_weather(weeks, place_cells, cells).drop("week_end")
    return bare.join(block, ["place", "week_start"], "left")


def real_station_rows(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("valid_days_week", F.lit(0)) > 0)


def real_cell_rows(df: DataFrame) -> DataFrame:
    """No gridded block at all gives no rows."""
    if "cell_rain_valid_days" not in df.columns:
        return df.where(F.lit(False))
    return df.where(F.coalesce("cell_rain_valid_days", F.lit(0)) > 0)


def daily_of_places(place_station: DataFrame, daily: DataFrame) -> DataFrame:
    """Left join on (station, source): codes collide between sources."""
    return place_station.select("place", "station", "source").join(daily, ["station", "source"], "left")
