"""Place outlines: metric area and centroid, validity, rules and quality profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weekwatch import contracts as C
from weekwatch.functions import geo
from weekwatch.functions.text import clean_code, clean_text
from weekwatch.operators import routing

# Attribute names of the outline file.
ATTRIBUTES = ("CBAIRRCODI", "EBAIRRNOME", "EBAIRRNOMEOF", "CRPAAACODI", "CMICROCODI")


def crossing_features(polygons: DataFrame, key: str) -> DataFrame:
    """Keys of polygons with two crossing edges of one ring.

    Edges are exploded and sent to the cells of a grid sized by the mean edge; only edges that
    meet in a cell are compared, never all pairs of a ring.
    """
    edges = (
        polygons.select(key, F.posexplode("rings").alias("ring", "r"))
        .select(key, "ring", F.size("r").alias("n"), F.posexplode(F.arrays_zip(F.slice("r", F.lit(1), F.size("r") - 1).alias("a"), F.slice("r", F.lit(2), F.size("r") - 1).alias("b"))).alias("i", "e"))
        .select(key, "ring", "n", "i", F.col("e.a").alias("a"), F.col("e.b").alias("b"))
    )
    dx, dy = F.abs(F.col("a.x") - F.col("b.x")), F.abs(F.col("a.y") - F.col("b.y"))
    size = edges.groupBy(key, "ring").agg(F.greatest(F.avg(F.greatest(dx, dy)), F.lit(1e-12)).alias("c"))
    at = lambda c: F.floor(c / F.col("c")).cast("bigint")
    spread = (
        edges.join(size, [key, "ring"])
        .withColumn("cx", F.explode(F.sequence(at(F.least("a.x", "b.x")), at(F.greatest("a.x", "b.x")))))
        .withColumn("cy", F.explode(F.sequence(at(F.least("a.y", "b.y")), at(F.greatest("a.y", "b.y")))))
        .drop("c")
    )
    other = spread.select(key, "ring", "cx", "cy", F.col("i").alias("j"), F.col("a").alias("c"), F.col("b").alias("d"))
    met = spread.join(other, [key, "ring", "cx", "cy"]).where(
        (F.col("j") > F.col("i") + 1) & ~((F.col("i") == 0) & (F.col("j") == F.col("n") - 2))
    )

    def side(p: str, q: str, s: str):
        return (F.col(f"{q}.x") - F.col(f"{p}.x")) * (F.col(f"{s}.y") - F.col(f"{p}.y")) - (F.col(f"{q}.y") - F.col(f"{p}.y")) * (F.col(f"{s}.x") - F.col(f"{p}.x"))

    crosses = (side("a", "b", "c") * side("a", "b", "d") < 0) & (side("c", "d", "a") * side("c", "d", "b") < 0)
    return met.where(crosses).select(key).distinct()


def conform_outlines(raw: DataFrame, resource: str, run_id: str) -> DataFrame:
    """Cleaned attributes, metric area (km2), centroid in degrees and the first failing rule per row."""
    df = raw.withColumn("_row", F.monotonically_increasing_id()).select(
        "_row", clean_code(F.col("CBAIRRCODI")).alias("place"), clean_text(F.col("EBAIRRNOME")).alias("place_name"),
        clean_code(F.col("EBAIRRNOMEOF")).alias("official_name"), clean_code(F.col("CRPAAACODI")).alias("region"), clean_code(F.col("CMICROCODI")).alias("micro_region"), "rings",
    )
    metric = geo.reproject(F.col("rings"))
    df = df.withColumn("_m", metric).withColumns(
        {"area_km2": geo.polygon_area(F.col("_m")) / 1e6, "_c": geo.polygon_centroid(F.col("_m"))}
    )
    df = df.withColumn("_g", geo.from_utm(F.col("_c.x"), F.col("_c.y"))).withColumns(
        {"centroid_lon": F.col("_g.lon"), "centroid_lat": F.col("_g.lat"), "crs": F.lit("EPSG:4326"), "_source_resource_id": F.lit(resource), "_ingestion_run_id": F.lit(run_id)}
    ).drop("_m", "_c", "_g")
    crossing = crossing_features(df, "_row").withColumn("_x", F.lit(True))
    df = df.join(crossing, "_row", "left")
    ring_ok = lambda r: (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.element_at(r, -1))
    closed = F.forall("rings", ring_ok) & (F.size("rings") > 0)
    first = df.where(F.col("place").isNotNull()).groupBy("place").agg(F.min("_row").alias("_first"))
    df = df.join(first, "place", "left").withColumn("_dup", F.coalesce(F.col("_row") != F.col("_first"), F.lit(False))).drop("_first")
    rules = [
        (F.col("rings").isNull(), C.NO_GEOMETRY),
        (~closed | F.coalesce("_x", F.lit(False)), C.BAD_GEOMETRY),
        (F.col("place").isNull(), C.NO_PLACE),
        (F.col("_dup"), C.DUPLICATE_PLACE),
        (F.col("place_name").isNull(), C.NO_PLACE_NAME),
        (F.col("area_km2").isNull() | (F.col("area_km2") <= 0), C.BAD_AREA),
        ((F.abs("centroid_lat") > 90) | (F.abs("centroid_lon") > 180), C.CENTROID_OUT),
    ]
    return routing.first_failing(df, rules).drop("_row", "_x", "_dup")


def outline_profile(raw: DataFrame) -> DataFrame:
    """Features, null and open geometries, types, bounds and always-null attributes in one row."""
    xs = F.transform(F.flatten("rings"), lambda p: p["x"])
    ys = F.transform(F.flatten("rings"), lambda p: p["y"])
    attrs = [c for c in raw.columns if c not in ("rings", "geometry_type")]
    open_ring = F.exists("rings", lambda r: (F.size(r) < 4) | (F.get(r, F.lit(0)) != F.element_at(r, -1)))
    out = raw.agg(
        F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("rings").isNull()).alias("n_null"), F.count_if(open_ring).alias("n_invalid"),
        F.array_sort(F.collect_set("geometry_type")).alias("types"),
        F.min(F.array_min(xs)).alias("min_lon"), F.max(F.array_max(xs)).alias("max_lon"), F.min(F.array_min(ys)).alias("min_lat"), F.max(F.array_max(ys)).alias("max_lat"),
        *[F.count(c).alias(f"_n_{i}") for i, c in enumerate(attrs)],
    )
    always_null = F.array_compact(F.array(*[F.when(F.col(f"_n_{i}") == 0, F.lit(c)) for i, c in enumerate(attrs)]))
    return out.withColumn("always_null", always_null).drop(*[f"_n_{i}" for i in range(len(attrs))])
