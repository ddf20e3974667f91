"""Stations and places: last reading, eligibility, nearest station, containment, coverage."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weekwatch import contracts as C
from weekwatch.contracts import STATION_IDLE_DAYS, STATION_SOURCES
from weekwatch.functions import geo
from weekwatch.functions.numbers import pct, round_even
from weekwatch.functions.text import clean_text
from weekwatch.operators import routing

CELL_DEG = 0.01  # finest search cell; each level doubles it
LEVELS = 16  # 0.01 * 2**15 covers the globe


def last_reading(daily: DataFrame, keys: Sequence[str] = ("source", "station")) -> DataFrame:
    complete = daily.where(F.col("day").isNotNull() & F.col("station").isNotNull())
    return complete.groupBy(*keys).agg(F.max("day").alias("last_reading"))


def eligibility(
    stations: DataFrame, daily: DataFrame, reference: Column, sources: Sequence[str] = STATION_SOURCES,
    idle_days: int = STATION_IDLE_DAYS,
) -> DataFrame:
    """Stations of the listed sources with the first exclusion reason, null when eligible.

    Source and code together name a station: codes collide between sources.
    """
    known = stations.where(F.col("source").isin(*sources)).join(last_reading(daily), ["source", "station"], "left")
    rules = [
        (F.col("lat").isNull() | F.col("lon").isNull(), C.NO_COORDINATES),
        ((F.abs("lat") > 90) | (F.abs("lon") > 180), C.COORDINATES_OUT),
        (F.col("last_reading").isNull(), C.NO_READING),
        (F.datediff(reference, "last_reading") > idle_days, C.IDLE_STATION.format(days=idle_days)),
    ]
    return routing.first_failing(known, rules)


def _cell(c: Column, level: Column) -> Column:
    return F.floor(c / (F.lit(CELL_DEG) * F.pow(F.lit(2.0), level))).cast("bigint")


def nearest_station(places: DataFrame, stations: DataFrame) -> DataFrame:
    """The one nearest station of each place; ties by source, then code. Exact at any size.

    No pair of all places and stations is ever formed. Stations at the same spot are merged
    first. Station counts per cell of a pyramid of grids give, for every place, the finest level
    whose 3x3 neighbourhood is not empty; that bounds the distance, and only the cells inside the
    bound are joined. Places without any station within the coarsest level get no row.
    """
    spots = stations.groupBy("lat", "lon").agg(F.min(F.struct("source", "station")).alias("best")).where(
        F.col("lat").isNotNull() & F.col("lon").isNotNull()
    )
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    occupied = (
        spots.withColumn("level", F.explode(levels))
        .select("level", _cell(F.col("lat"), F.col("level")).alias("cy"), _cell(F.col("lon"), F.col("level")).alias("cx"))
        .distinct()
    )
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    probes = (
        places.select("place", "lat", "lon")
        .withColumn("level", F.explode(levels))
        .withColumn("dy", F.explode(around))
        .withColumn("dx", F.explode(around))
        .select(
            "place", "lat", "lon", "level",
            (_cell(F.col("lat"), F.col("level")) + F.col("dy")).alias("cy"),
            (_cell(F.col("lon"), F.col("level")) + F.col("dx")).alias("cx"),
        )
    )
    found = probes.join(occupied, ["level", "cy", "cx"]).groupBy("place", "lat", "lon").agg(F.min("level").alias("level"))
    # a hit in the 3x3 block lies within sqrt(8) cells: search that far in kilometres
    size = F.lit(CELL_DEG) * F.pow(F.lit(2.0), F.col("level"))
    reach_deg = size * math.sqrt(8.0)
    widest = F.least(F.abs("lat") + reach_deg, F.lit(89.0))
    reach_y = F.ceil(reach_deg / size)
    reach_x = F.ceil(reach_deg / size / F.cos(F.radians(widest)))
    cells = (
        found.withColumn("ry", reach_y.cast("int"))
        .withColumn("rx", reach_x.cast("int"))
        .withColumn("dy", F.explode(F.sequence(-F.col("ry"), F.col("ry"))))
        .withColumn("dx", F.explode(F.sequence(-F.col("rx"), F.col("rx"))))
        .select(
            "place", "lat", "lon", "level",
            (_cell(F.col("lat"), F.col("level")) + F.col("dy")).alias("cy"),
            (_cell(F.col("lon"), F.col("level")) + F.col("dx")).alias("cx"),
        )
    )
    used = found.select("level").distinct()
    placed = spots.withColumn("level", F.explode(levels)).join(F.broadcast(used), "level", "left_semi").select(
        "level", _cell(F.col("lat"), F.col("level")).alias("cy"), _cell(F.col("lon"), F.col("level")).alias("cx"),
        F.col("lat").alias("slat"), F.col("lon").alias("slon"), "best",
    )
    km = geo.distance_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
    best = cells.join(placed, ["level", "cy", "cx"]).groupBy("place").agg(
        F.min(F.struct(km.alias("km"), F.col("best.source").alias("source"), F.col("best.station").alias("station"))).alias("b")
    )
    return best.select(
        "place", F.col("b.station").alias("station"), F.col("b.source").alias("source"), round_even(F.col("b.km"), 3).alias("distance_km")
    )


def inside(points: DataFrame, polygons: DataFrame, key: str = "place", cell: float = 0.02) -> DataFrame:
    """Left join of points (lon, lat) to the polygon that contains them, null when outside.

    Polygons are sent to the grid cells of their bounding box, points to their own cell; the
    equi-join leaves only candidates for the even-odd test.
    """
    xs = F.transform(F.flatten("rings"), lambda p: p["x"])
    ys = F.transform(F.flatten("rings"), lambda p: p["y"])
    at = lambda c: F.floor(c / F.lit(cell)).cast("bigint")
    boxes = (
        polygons.select(F.col(key).alias("_poly"), "rings", at(F.array_min(xs)).alias("x0"), at(F.array_max(xs)).alias("x1"), at(F.array_min(ys)).alias("y0"), at(F.array_max(ys)).alias("y1"))
        .withColumn("cx", F.explode(F.sequence("x0", "x1")))
        .withColumn("cy", F.explode(F.sequence("y0", "y1")))
        .select("_poly", "rings", "cx", "cy")
    )
    tagged = points.withColumn("_pid", F.struct("source", "station"))
    located = tagged.select("_pid", "lon", "lat", at(F.col("lon")).alias("cx"), at(F.col("lat")).alias("cy"))
    hits = (
        located.join(boxes, ["cx", "cy"])
        .where(geo.contains(F.col("rings"), F.col("lon"), F.col("lat")))
        .groupBy("_pid")
        .agg(F.min("_poly").alias(key))
    )
    return tagged.join(hits, "_pid", "left").drop("_pid")


def places_with_station(points_in_places: DataFrame, places: DataFrame) -> DataFrame:
    """Per place whether at least one station lies inside."""
    has = points_in_places.where(F.col("place").isNotNull()).select("place").distinct().withColumn("_h", F.lit(True))
    return places.select("place").join(has, "place", "left").select("place", F.coalesce("_h", F.lit(False)).alias("has_station"))


def representative_points(polygons: DataFrame) -> DataFrame:
    """(place, lon, lat, point_method): the centroid when inside, else a point on the widest inside stretch."""
    metric = geo.reproject(F.col("rings"))
    with_fallback = polygons.withColumns(
        {"_in": geo.contains(F.col("rings"), F.col("centroid_lon"), F.col("centroid_lat")), "_alt": geo.scanline_point(metric)}
    ).withColumn("_alt", geo.from_utm(F.col("_alt.x"), F.col("_alt.y")))
    return with_fallback.select(
        "place",
        F.when(F.col("_in"), F.col("centroid_lon")).otherwise(F.col("_alt.lon")).alias("lon"),
        F.when(F.col("_in"), F.col("centroid_lat")).otherwise(F.col("_alt.lat")).alias("lat"),
        F.when(F.col("_in"), "centroide").otherwise("representative_point_fallback").alias("point_method"),
    )


def place_station_map(places: DataFrame, stations: DataFrame, daily: DataFrame, reference: Column, idle_days: int = STATION_IDLE_DAYS, station_place: DataFrame | None = None) -> DataFrame:
    """Eligibility, nearest station and whether that station lies in the place itself."""
    good = routing.valid(eligibility(stations, daily, reference, idle_days=idle_days))
    near = nearest_station(places, good)
    home = (station_place if station_place is not None else stations.select("source", "station", F.lit(None).cast("bigint").alias("home")))
    return near.join(home, ["source", "station"], "left").withColumn(
        "own_station", F.coalesce(F.col("home") == F.col("place"), F.lit(False))
    ).drop("home").withColumn("method", F.lit("nearest_station"))


def mapping_coverage(mapping: DataFrame, total_places: Column) -> DataFrame:
    d = F.col("distance_km")
    q = F.percentile("distance_km", [0.5, 0.9, 0.95])
    return mapping.agg(
        F.count(F.lit(1)).alias("n_mapped"),
        F.countDistinct("station").alias("n_stations"),
        F.avg(d).alias("mean"), q.alias("q"), F.max(d).alias("km_max"), F.min(d).alias("km_min"),
        F.count_if("own_station").alias("n_own"), F.count_if(~F.col("own_station")).alias("n_other"),
    ).select(
        "n_mapped", "n_stations",
        pct(F.col("n_mapped"), total_places, 2).alias("pct_mapped"),
        round_even(F.col("mean"), 3).alias("km_mean"),
        round_even(F.col("q")[0], 3).alias("km_median"),
        round_even(F.col("q")[1], 3).alias("km_p90"),
        round_even(F.col("q")[2], 3).alias("km_p95"),
        "km_max", "km_min", "n_own", "n_other",
    )


def farthest_places(mapping: DataFrame, top: int = 10) -> DataFrame:
    return mapping.orderBy(F.desc("distance_km"), "place").limit(top).select("place", "station", "distance_km")


def most_used_stations(mapping: DataFrame, top: int = 10) -> DataFrame:
    return mapping.groupBy("station").agg(F.count(F.lit(1)).alias("n_places")).orderBy(F.desc("n_places"), "station").limit(top)


def join_status(register: DataFrame, status: DataFrame) -> DataFrame:
    """Register x status by cleaned name: rain gauges only, the last status of a name wins.

    Register rows without a status keep station null, so they can be counted.
    """
    by_name = (
        status.where(F.col("station_type") == 1)
        .withColumn("_n", clean_text(F.col("name")))
        .where(F.col("_n").isNotNull())
        .groupBy("_n")
        .agg(F.max_by("station", "row_id").alias("station"))
    )
    return register.withColumn("_n", clean_text(F.col("name"))).join(by_name, "_n", "left").drop("_n")


def unmatched_register(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count_if(F.col("station").isNull()).alias("n_without_status"), F.count(F.lit(1)).alias("n_register"))


def station_profile(hourly: DataFrame) -> DataFrame:
    """Per station: period, distinct days, expected days, coverage, duplicate hours, null share.

    Hours are merged first, so the distinct counts below see one row per station and hour.
    """
    per_hour = hourly.groupBy("station", "day", "hour").agg(
        F.count(F.lit(1)).alias("n"), F.count("rain").alias("n_rain")
    )
    per_day = per_hour.groupBy("station", "day").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("dup"), F.sum("n_rain").alias("n_rain")
    )
    out = per_day.groupBy("station").agg(
        F.sum("n").alias("n_rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count(F.lit(1)).alias("days"), F.sum("dup").alias("duplicate_hours"), F.sum("n_rain").alias("_r"),
    )
    expected = F.datediff("last_day", "first_day") + 1
    return out.withColumns(
        {
            "expected_days": expected,
            "coverage_pct": pct(F.col("days"), expected, 2),
            "null_pct": pct((F.col("n_rows") - F.col("_r")), F.col("n_rows"), 2),
        }
    ).drop("_r")


def station_findings(profile: DataFrame, limit_pct: float = 20.0) -> DataFrame:
    """One row per station and broken rule."""
    rules = F.array_compact(
        F.array(
            F.when(F.col("null_pct") > limit_pct, "null share above limit"),
            F.when(F.col("duplicate_hours") > 0, "duplicate hours"),
            F.when(F.col("coverage_pct") < 100 - limit_pct, "days missing"),
        )
    )
    return profile.select("station", F.explode(rules).alias("finding"))
