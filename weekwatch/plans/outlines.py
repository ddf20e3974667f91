"""Registered queries: outlines of places, stations in them, coordinates, station names, yearly partitions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weekwatch import contracts as C
from weekwatch.functions import geo
from weekwatch.functions.numbers import round_even
from weekwatch.operators import stations as St, territory
from weekwatch.plans import tables as T
from weekwatch.plans.registry import query
from weekwatch.plans.sqltext import r, sql
from weekwatch.session import checkpoint_dir
from weekwatch.sources import tables

OUTER, INNER = 0.01234, 0.00456  # half diagonals in degrees


def diamond(half: float):
    """A closed ring around a place's coordinates."""
    corner = lambda dx, dy: F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    return F.array(corner(half, 0.0), corner(0.0, half), corner(-half, 0.0), corner(0.0, -half), corner(half, 0.0))


def outlines(spark, sf):
    """Every place a diamond; those of odd number have a hole in the middle."""
    p = T.places(spark, sf)
    rings = F.when(F.col("place") % 2 == 1, F.array(diamond(OUTER), diamond(INNER))).otherwise(F.array(diamond(OUTER)))
    return p.select("place", "place_name", "region", F.col("lon").alias("centroid_lon"), F.col("lat").alias("centroid_lat"), rings.alias("rings"))


_AWAY = "abs(s.lon - p.lon) + abs(s.lat - p.lat)"
_INSIDE = {
    "instations": f"SELECT s.source, s.station, min(p.place) AS place FROM stations s LEFT JOIN places p ON {_AWAY} < {OUTER} AND (p.place % 2 = 0 OR {_AWAY} > {INNER}) GROUP BY 1, 2"
}


@query("stations_in_places", sql("SELECT * FROM instations", _INSIDE))
def stations_in_places(spark, sf):
    return St.inside(T.stations(spark, sf), outlines(spark, sf)).select("source", "station", "place")


@query("places_with_station", sql("SELECT place, place IN (SELECT place FROM instations WHERE place IS NOT NULL) AS has_station FROM places", _INSIDE))
def places_with_station(spark, sf):
    return St.places_with_station(stations_in_places(spark, sf), T.places(spark, sf))


@query("representative_points", sql("""
SELECT place, CASE WHEN place % 2 = 1 THEN 'representative_point_fallback' ELSE 'centroide' END AS point_method, true AS inside, place % 2 = 0 AS at_centroid FROM places"""))
def representative_points(spark, sf):
    """The point of a place lies in its outline; only a place with a hole in the middle needs another point than its centroid."""
    o = outlines(spark, sf)
    p = St.representative_points(o).join(o, "place")
    at = (F.abs(F.col("lon") - F.col("centroid_lon")) < 1e-9) & (F.abs(F.col("lat") - F.col("centroid_lat")) < 1e-9)
    return p.select("place", "point_method", geo.contains(F.col("rings"), F.col("lon"), F.col("lat")).alias("inside"), at.alias("at_centroid"))


@query("metric_round_trip", sql(f"SELECT station, {r('lon', 7)} AS lon, {r('lat', 7)} AS lat, true AS in_zone FROM stations"))
def metric_round_trip(spark, sf):
    """Coordinates to metres of the zone and back."""
    s = T.stations(spark, sf).withColumn("m", geo.to_utm(F.col("lon"), F.col("lat")))
    back = s.withColumn("g", geo.from_utm(F.col("m.x"), F.col("m.y")))
    zone = F.col("m.x").between(100_000, 900_000) & F.col("m.y").between(9_000_000, 9_300_000)
    return back.select("station", round_even(F.col("g.lon"), 7).alias("lon"), round_even(F.col("g.lat"), 7).alias("lat"), zone.alias("in_zone"))


def raw_outlines(spark, sf):
    """Outlines with one defect by the place's number: crossing, open, absent, without a code, with the code of another."""
    k = F.col("place") % 7
    ring = diamond(OUTER)
    crossing = F.array(F.get(ring, F.lit(0)), F.get(ring, F.lit(2)), F.get(ring, F.lit(1)), F.get(ring, F.lit(3)), F.get(ring, F.lit(0)))
    rings = F.when(k == 1, F.array(crossing)).when(k == 2, F.array(F.slice(ring, 1, 4))).when(k != 3, F.array(ring))
    code = F.when(k == 4, F.lit(None)).when(k == 5, F.col("place") - 5).otherwise(F.col("place")).cast("string")
    return T.places(spark, sf).orderBy("place").coalesce(1).select(
        code.alias("CBAIRRCODI"), F.when(k == 6, F.lit(None)).otherwise(F.col("place_name")).alias("EBAIRRNOME"), F.lit(None).cast("string").alias("EBAIRRNOMEOF"),
        F.col("region").cast("string").alias("CRPAAACODI"), F.lit("1").alias("CMICROCODI"), rings.alias("rings"), F.when(k != 3, "Polygon").alias("geometry_type"),
    )


@query("outline_rules", sql(f"""
SELECT CASE WHEN place % 7 = 4 THEN NULL WHEN place % 7 = 5 THEN place - 5 ELSE place END AS place,
 CASE place % 7 WHEN 1 THEN '{C.BAD_GEOMETRY}' WHEN 2 THEN '{C.BAD_GEOMETRY}' WHEN 3 THEN '{C.NO_GEOMETRY}' WHEN 4 THEN '{C.NO_PLACE}' WHEN 5 THEN '{C.DUPLICATE_PLACE}' WHEN 6 THEN '{C.NO_PLACE_NAME}' END AS reject_reason FROM places"""))
def outline_rules(spark, sf):
    """The rule that refuses each outline."""
    return territory.conform_outlines(raw_outlines(spark, sf), "r", "run").select(F.col("place").cast("bigint").alias("place"), "reject_reason")


@query("outline_profile", sql(f"""
SELECT count(*) AS n_features, count(*) FILTER (place % 7 = 3) AS n_null, count(*) FILTER (place % 7 = 2) AS n_invalid, {r(f'min(lon) FILTER (place % 7 <> 3) - {OUTER}', 7)} AS min_lon, {r(f'max(lat) FILTER (place % 7 <> 3) + {OUTER}', 7)} AS max_lat FROM places"""))
def outline_profile(spark, sf):
    p = territory.outline_profile(raw_outlines(spark, sf))
    return p.select("n_features", "n_null", "n_invalid", round_even(F.col("min_lon"), 7).alias("min_lon"), round_even(F.col("max_lat"), 7).alias("max_lat"))


_STATUS = {
    "regs": "SELECT CAST(s_suppkey AS BIGINT) AS id, 'GAUGE ' || CAST(s_suppkey % 60 AS VARCHAR) AS n FROM supplier",
    "stat": "SELECT 'GAUGE ' || CAST(s_suppkey % 45 AS VARCHAR) AS n, arg_max(1000 + s_suppkey, s_suppkey) AS station FROM supplier WHERE s_suppkey % 3 = 1 GROUP BY 1",
}


def register_with_status(spark, sf):
    s, k = T.read(spark, sf, "supplier"), F.col("s_suppkey")
    name = lambda n: F.concat(F.lit("Gauge "), (k % n).cast("string"))
    status = s.select(F.lower(name(45)).alias("name"), (k % 3).alias("station_type"), (k + 1000).alias("station"), k.alias("row_id"))
    return St.join_status(s.select(k.alias("id"), F.concat(F.lit("  "), name(60)).alias("name")), status)


@query("register_status", sql("SELECT id, station FROM regs LEFT JOIN stat USING (n)", _STATUS))
def register_status(spark, sf):
    """Register rows with the last status of their cleaned name, rain gauges only."""
    return register_with_status(spark, sf).select("id", "station")


@query("register_without_status", sql("SELECT count(*) FILTER (station IS NULL) AS n_without_status, count(*) AS n_register FROM regs LEFT JOIN stat USING (n)", _STATUS))
def register_without_status(spark, sf):
    return St.unmatched_register(register_with_status(spark, sf))


@query("yearly_partitions_rewritten", sql("""
SELECT place, kind, ano, CASE WHEN ano >= 1997 THEN 2 * n ELSE n END AS n
FROM (SELECT place, kind, year(week_start) AS ano, CAST(sum(cases) AS BIGINT) AS n FROM counts GROUP BY ALL)"""))
def yearly_partitions_rewritten(spark, sf):
    """A table by year of which a second run replaces some years, read back as one table."""
    path = f"{checkpoint_dir(spark)}/years-{uuid.uuid4().hex}"
    counts = T.case_counts(spark, sf).groupBy("place", "kind", F.year("week_start").alias("ano")).agg(F.sum("cases").alias("n"))
    tables.write_years(counts, path)
    tables.write_years(counts.where("ano >= 1997").withColumn("n", F.col("n") * 2), path)
    return tables.read_prefix(spark, path, counts.schema).select(*counts.columns)
