import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weekwatch.contracts import GRIDDED_BLOCK
from weekwatch.operators import grid as G, rates, weather as Wx
from weekwatch.plans import tables as T

D = dt.date


def test_grid_keeps_every_case_and_fills_real_zeros(spark, sf):
    g, c = T.grid(spark, sf), T.case_counts(spark, sf)
    G.require_conserved(c, g)
    with pytest.raises(ValueError):
        G.require_conserved(c, g.where("place <> 3"))
    n = g.agg(F.countDistinct("place"), F.countDistinct("kind"), F.countDistinct("week_start"), F.count("*")).first()
    assert n[0] * n[1] * n[2] == n[3]


def test_period_and_name_matching(spark):
    ev = spark.createDataFrame(
        [("1", "D", "202002", "Pina", "x"), ("2", "D", "202002", " pina ", "y"), ("3", "Z", "202003", "BOA VISTA", "z"), ("4", "D", "999999", "Pina", "x"), ("5", "D", None, None, "x")],
        "id string, kind string, week string, place_name string, _run string",
    )
    places = spark.createDataFrame([(1, "PINA"), (2, "BOA VISTA")], "place bigint, place_name string")
    p = G.match_official_places(G.with_period(ev, "week"), places)
    assert rows(p.select("id", "official_place", "name_status", "epi_week"), "id") == [
        ("1", 1, "matched", 2), ("2", 1, "matched", 2), ("3", 2, "matched", 3), ("4", 1, "matched", None), ("5", None, "null_name", None)]
    dup = spark.createDataFrame([(1, "a", "r1"), (1, "a", "r2"), (2, "a", "r1")], "k int, v string, _run string")
    assert G.exact_duplicates_removed(dup).count() == 2


def test_checked_join_refuses_duplicate_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")
    assert G.checked_join(left, right.limit(1), ["k"]).count() == 2
    with pytest.raises(Exception, match="key is not unique"):
        G.checked_join(left, right, ["k"]).collect()
    with pytest.raises(Exception, match="key is not unique"):
        G.checked_join(left, right.limit(1), ["k"], validate="1:1").collect()


def week_of(spark):
    return spark.createDataFrame(
        [(1, "D", 2024, 2, D(2024, 1, 7), D(2024, 1, 13)), (2, "D", 2024, 2, D(2024, 1, 7), D(2024, 1, 13)), (3, "D", 2024, 2, D(2024, 1, 7), D(2024, 1, 13))],
        "place bigint, kind string, epi_year int, epi_week int, week_start date, week_end date",
    )


def mapping(spark):
    return spark.createDataFrame([(1, 10, "A", 1.0), (2, 11, "A", 2.0)], "place bigint, station bigint, source string, distance_km double")


READINGS = [(10, D(2024, 1, 7), 5.0), (10, D(2024, 1, 9), 0.0), (10, D(2023, 12, 20), 7.0), (10, D(2023, 12, 16), 100.0), (10, D(2024, 1, 10), None)]


def daily(spark, extra=()):
    return spark.createDataFrame([*READINGS, *extra], "station bigint, day date, rain_mm double")


def test_station_windows_missing_is_not_zero(spark):
    out = {r["place"]: r for r in Wx.add_station_weather(week_of(spark), mapping(spark), daily(spark)).collect()}
    one = out[1]
    assert (one["rain_7d"], one["rain_14d"], one["rain_28d"]) == (5.0, 5.0, 12.0)
    assert (one["valid_days_7d"], one["valid_days_28d"], one["rain_days"], one["rain_day_max"], one["rain_day_mean"]) == (2, 3, 1, 5.0, 2.5)
    assert one["completeness"] == 0.286
    silent, unmapped = out[2], out[3]
    assert silent["rain_week"] is None and silent["valid_days_week"] == 0 and silent["rain_days"] == 0 and silent["completeness"] == 0.0
    assert unmapped["station"] is None and unmapped["valid_days_week"] is None and unmapped["completeness"] is None


def test_no_reading_after_the_week_changes_anything(spark):
    a = rows(Wx.add_station_weather(week_of(spark), mapping(spark), daily(spark)), "place")
    b = rows(Wx.add_station_weather(week_of(spark), mapping(spark), daily(spark, [(10, D(2024, 1, 14), 9999.0), (10, D(2024, 2, 1), 9999.0)])), "place")
    assert a == b


def test_week_end_windows_equal_rolling_windows_over_the_dense_series(spark, sf):
    d = T.daily_rain(spark, sf)
    dense = Wx.trailing_daily(Wx.dense_daily(d)).where(F.dayofweek("day") == 7)
    w = Wx.station_windows(d).select("station", F.col("week_end").alias("day"), *[f"rain_{n}d" for n in Wx.DAYS], "valid_days_7d", "valid_days_28d")
    j = dense.select("station", "day", *[F.col(f"rain_{n}d").alias(f"d{n}") for n in Wx.DAYS], F.col("valid_days_28d").alias("v28")).join(w, ["station", "day"], "left")
    bad = j.where(" OR ".join(f"NOT (d{n} <=> rain_{n}d)" for n in Wx.DAYS) + " OR NOT (v28 <=> coalesce(valid_days_28d, 0))")
    assert j.count() > 100 and bad.count() == 0


def test_cell_enrichment_is_rerun_safe(spark, sf):
    g = rates.population_block(T.grid(spark, sf), T.population(spark, sf))
    once = Wx.enrich_cell_weather(g, T.place_cells(spark, sf), T.cell_daily(spark, sf))
    twice = Wx.enrich_cell_weather(once, T.place_cells(spark, sf), T.cell_daily(spark, sf))
    assert set(GRIDDED_BLOCK) <= set(once.columns) and sorted(once.columns) == sorted(twice.columns)
    G.require_conserved(g, twice)


def test_keep_last_and_bounds(spark):
    df = spark.createDataFrame([("c", 1, "r1", 5.0), ("c", 1, "r2", None), ("c", 2, "r1", 600.0)], "cell string, d int, run string, rain_mm double")
    assert sorted(rows(Wx.keep_last(df, ["cell", "d"], ["run"]))) == [("c", 1, "r2", None), ("c", 2, "r1", 600.0)]
    assert rows(Wx.bounded_cells(df, {"rain_mm": (0.0, 500.0)}).where("d = 2").select("rain_mm")) == [(None,)]


def test_rates_sum_cases_before_dividing(spark):
    cases = [(1, "a", "D", 2024, w, c, 2.0, w) for w, c in enumerate((1, 2, 3, 4), 1)] + [(2, "b", "D", 2024, w, 0, 2.0, w) for w in range(1, 5)]
    g = spark.createDataFrame(cases, "place bigint, place_name string, kind string, epi_year int, epi_week int, cases bigint, area_km2 double, week_index int")
    pop = spark.createDataFrame([(1, 2024, 100000, "censo"), (2, 2024, 0, "censo")], "place bigint, epi_year int, population bigint, population_type string")
    out = {(r["place"], r["epi_week"]): r for r in rates.population_block(g, pop).collect()}
    assert out[(1, 4)]["rate_4w"] == 10.0 and out[(1, 4)]["rate_1w"] == 4.0 and out[(1, 4)]["density"] == 50000.0
    assert out[(2, 4)]["rate_4w"] is None and out[(2, 4)]["rate_1w"] is None
    assert rates.population_block(g, pop.where("place = 1")).where("place = 2 and rate_1w is not null").count() == 0


def test_observed_counts_on_the_same_pass(spark):
    df, watch = G.observed(spark.range(10).toDF("id"), "t", n=F.count(F.lit(1)), big=F.count_if(F.col("id") > 6))
    df.collect()
    assert watch.get == {"n": 10, "big": 3}
