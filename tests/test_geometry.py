import math

from conftest import rows
from pyspark.sql import functions as F

from weekwatch.contracts import RINGS
from weekwatch.functions import geo
from weekwatch.operators import stations, territory


def square(x, y, side):
    return [[(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]]


# a U shape whose centroid lies in its gap
U = [[(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (2.0, 3.0), (2.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0), (0.0, 0.0)]]


def frame(spark, items, key="place"):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("rings", RINGS)])
    return spark.createDataFrame(items, schema)


def test_area_centroid_containment(spark):
    hole = square(0.0, 0.0, 4.0) + square(1.0, 1.0, 1.0)
    df = frame(spark, [(1, square(2.0, 3.0, 2.0)), (2, hole), (3, U)])
    got = {r[0]: r for r in df.select("place", geo.polygon_area(F.col("rings")), geo.polygon_centroid(F.col("rings")), geo.contains(F.col("rings"), F.lit(1.5), F.lit(1.5))).collect()}
    assert got[1][1] == 4.0 and tuple(got[1][2]) == (3.0, 4.0) and got[1][3] is False
    assert got[2][1] == 15.0 and got[2][3] is False
    assert got[3][1] == 7.0 and got[3][3] is False


def test_projection_round_trip_and_metres(spark):
    df = spark.createDataFrame([(-34.9, -8.05), (-33.0, -8.0), (-35.2, -7.5)], "lon double, lat double")
    u = df.withColumn("u", geo.to_utm(F.col("lon"), F.col("lat")))
    back = u.withColumn("g", geo.from_utm(F.col("u.x"), F.col("u.y")))
    for r in back.collect():
        assert abs(r["g"]["lon"] - r["lon"]) < 1e-8 and abs(r["g"]["lat"] - r["lat"]) < 1e-8
    mid = u.where("lon = -33.0").first()["u"]
    assert abs(mid["x"] - 500000.0) < 1e-6
    # a small step north: projected length against the meridian arc of the ellipsoid
    a, b = spark.range(1).select(geo.to_utm(F.lit(-33.0), F.lit(-8.0)).alias("a"), geo.to_utm(F.lit(-33.0), F.lit(-7.99)).alias("b")).first()
    e2 = 0.0066943800229
    arc = 6378137.0 * (1 - e2) / (1 - e2 * math.sin(math.radians(7.995)) ** 2) ** 1.5 * math.radians(0.01)
    assert abs((b["y"] - a["y"]) - 0.9996 * arc) < 1e-3


def test_representative_point_is_inside(spark):
    small = [[(-34.9 + x / 100, -8.0 + y / 100) for x, y in U[0]]]
    df = frame(spark, [(1, square(-34.9, -8.0, 0.02)), (2, small)])
    metric = df.withColumn("c", geo.polygon_centroid(F.col("rings"))).select("place", "rings", F.col("c.x").alias("centroid_lon"), F.col("c.y").alias("centroid_lat"))
    pts = stations.representative_points(metric)
    got = {r["place"]: r["point_method"] for r in pts.collect()}
    assert got == {1: "centroide", 2: "representative_point_fallback"}
    inside = pts.join(df, "place").where(geo.contains(F.col("rings"), F.col("lon"), F.col("lat")))
    assert inside.count() == 2


def test_points_in_places(spark):
    polys = frame(spark, [(i, square(-35.0 + 0.02 * (i % 10), -8.1 + 0.02 * (i // 10), 0.02)) for i in range(94)])
    pts = spark.createDataFrame([("A", "1", -34.99, -8.09), ("A", "2", -34.81, -8.09), ("B", "1", 0.0, 0.0)], "source string, station string, lon double, lat double")
    got = {(r["source"], r["station"]): r["place"] for r in stations.inside(pts, polys).collect()}
    assert got == {("A", "1"): 0, ("A", "2"): 9, ("B", "1"): None}
    cover = dict(rows(stations.places_with_station(stations.inside(pts, polys), polys)))
    assert cover[0] and cover[9] and sum(cover.values()) == 2


def test_nearest_station_against_brute_force(spark):
    import random

    rnd = random.Random(7)
    places = [(i, rnd.uniform(-60, 60), rnd.uniform(-170, 170)) for i in range(40)]
    st = [(i, "APAC" if i % 2 else "CEMADEN", rnd.gauss(-8, 0.2), rnd.gauss(-35, 0.2)) for i in range(150)]
    st += [(1000 + i, "APAC", rnd.uniform(-60, 60), rnd.uniform(-170, 170)) for i in range(20)]
    places += [(100 + i, rnd.gauss(-8, 0.2), rnd.gauss(-35, 0.2)) for i in range(30)]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * geo.EARTH_KM * math.asin(math.sqrt(h))

    want = {p[0]: min((km(p[1], p[2], s[2], s[3]), s[1], s[0]) for s in st) for p in places}
    p = spark.createDataFrame(places, "place bigint, lat double, lon double")
    s = spark.createDataFrame(st, "station bigint, source string, lat double, lon double")
    got = {r["place"]: (r["station"], round(r["distance_km"], 3)) for r in stations.nearest_station(p, s).collect()}
    assert got == {k: (v[2], round(v[0], 3)) for k, v in want.items()}


def test_outline_rules_and_profile(spark):
    bow = [[(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]]
    open_ring = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]
    ok = square(-34.9, -8.0, 0.02)
    data = [("1", "Pina", "Pina", "1", "1", "Polygon", ok), ("1", "Dup", "x", "1", "1", "Polygon", ok), (None, "x", "x", "1", "1", "Polygon", ok), ("4", " ", "x", "1", "1", "Polygon", ok), ("5", "x", "x", "1", "1", "Polygon", open_ring), ("6", "x", "x", "1", "1", None, None), ("7", "Bow", "x", "1", "1", "Polygon", [[(-34.9 + x / 50, -8.0 + y / 50) for x, y in bow[0]]])]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*territory.ATTRIBUTES, "geometry_type")] + [T.StructField("rings", RINGS)])
    raw = spark.createDataFrame(data, schema).coalesce(1)
    out = territory.conform_outlines(raw, "r", "run")
    got = [(r["place"], r["reject_reason"]) for r in out.collect()]
    reasons = {}
    for k, v in got:
        reasons.setdefault(k, []).append(v)
    assert sorted(reasons["1"], key=str) == sorted([None, "codigo_bairro duplicado"], key=str)
    assert reasons[None] == ["codigo_bairro ausente"] and reasons["4"] == ["nome_bairro vazio"]
    assert reasons["5"][0].startswith("geometry invalida") and reasons["6"] == ["geometry nula"] and reasons["7"][0].startswith("geometry invalida")
    good = out.where("reject_reason is null").first()
    side = 0.02 * math.pi * 6371.0 / 180
    assert abs(good["area_km2"] - side * side * math.cos(math.radians(7.99))) < 0.05
    assert abs(good["centroid_lat"] + 7.99) < 1e-4 and abs(good["centroid_lon"] + 34.89) < 1e-4
    prof = territory.outline_profile(raw).first()
    assert (prof["n_features"], prof["n_null"], prof["n_invalid"], prof["types"]) == (7, 1, 1, ["Polygon"])


def test_geojson_scan(spark, tmp_path):
    import json

    from weekwatch.sources import json_sources as J

    feat = lambda code, kind, coords: {"type": "Feature", "properties": {"CBAIRRCODI": code}, "geometry": {"type": kind, "coordinates": coords}}
    sq = [[list(p) for p in square(0.0, 0.0, 1.0)[0]]]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feat("1", "Polygon", sq), feat("2", "MultiPolygon", [sq, sq])]}))
    got = {r["CBAIRRCODI"]: len(r["rings"]) for r in J.polygons(spark, str(tmp_path / "g.json"), ["CBAIRRCODI"]).collect()}
    assert got == {"1": 1, "2": 2}
