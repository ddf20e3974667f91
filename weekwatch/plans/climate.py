"""Registered queries: stations, trailing weather, gridded cells, coverage, association."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekwatch.functions import geo
from weekwatch.functions.numbers import round_even
from weekwatch.operators.learning import years_of
from weekwatch.operators import association as A, explore, rates, routing, stations as S, weather as Wx
from weekwatch.plans import tables as T
from weekwatch.plans.registry import query
from weekwatch.plans.sqltext import distance as _dist, r, rate, sql, state_block
from weekwatch.plans.weekly import rounded, with_rates


def near(spark, sf):
    return S.nearest_station(T.places(spark, sf), T.stations(spark, sf))


def gold_station(spark, sf):
    return Wx.add_station_weather(with_rates(spark, sf), near(spark, sf), T.daily_rain(spark, sf))


def gold(spark, sf):
    return Wx.add_cell_weather(gold_station(spark, sf), T.place_cells(spark, sf), T.cell_daily(spark, sf))


# --- stations --------------------------------------------------------------------------

@query("nearest_station", sql("SELECT * FROM near"))
def nearest_station(spark, sf):
    return near(spark, sf)


@query("station_last_reading", sql("SELECT source, station, max(day) AS last_reading FROM daily JOIN stations USING (station) GROUP BY 1, 2"))
def station_last_reading(spark, sf):
    daily = T.daily_rain(spark, sf).join(T.stations(spark, sf).select("station", "source"), "station")
    return S.last_reading(daily)


_ELIG = {"elig": """
SELECT s.station, s.source, s.lat, s.lon, d.last_reading, CASE WHEN d.last_reading IS NULL THEN 'sem leitura em silver_clima_diario'
 WHEN (SELECT max(day) FROM daily) - d.last_reading > 5 THEN 'ultima leitura ha mais de 5 dias (estacao considerada inativa)' END AS reject_reason
FROM stations s LEFT JOIN (SELECT station, max(day) AS last_reading FROM daily GROUP BY 1) d USING (station) WHERE s.source IN ('APAC', 'CEMADEN')"""}


def eligible(spark, sf):
    st = T.stations(spark, sf)
    daily = T.daily_rain(spark, sf)
    tagged = daily.join(st.select("station", "source"), "station")
    ref = daily.agg(F.max("day").alias("d")).select("d").scalar()
    return S.eligibility(st, tagged, ref, idle_days=5)


@query("station_eligibility", sql("SELECT station, source, last_reading, reject_reason FROM elig", _ELIG))
def station_eligibility(spark, sf):
    return eligible(spark, sf).select("station", "source", "last_reading", "reject_reason")


@query("station_exclusion_counts", sql("SELECT reject_reason, count(*) AS n_rows FROM elig GROUP BY 1", _ELIG))
def station_exclusion_counts(spark, sf):
    return routing.reason_counts(eligible(spark, sf))


_MAP = {**_ELIG, "pmap": f"""
SELECT place, station, source, distance_km, home = place AS own_station, 'nearest_station' AS method FROM (
 SELECT p.place, s.station, s.source, CAST(s_nationkey AS BIGINT) AS home, {r(_dist('p.lat', 'p.lon', 's.lat', 's.lon'), 3)} AS distance_km,
 row_number() OVER (PARTITION BY p.place ORDER BY {_dist('p.lat', 'p.lon', 's.lat', 's.lon')}, s.source, s.station) AS rn
 FROM places p CROSS JOIN elig s JOIN supplier ON s_suppkey = s.station WHERE s.reject_reason IS NULL) WHERE rn = 1"""}


def mapping(spark, sf):
    st = T.stations(spark, sf)
    daily = T.daily_rain(spark, sf)
    home = T.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("station"), F.col("s_nationkey").cast("bigint").alias("home"))
    ref = daily.agg(F.max("day").alias("d")).select("d").scalar()
    return S.place_station_map(
        T.places(spark, sf), st, daily.join(st.select("station", "source"), "station"), ref, 5,
        st.select("source", "station").join(home, "station"),
    )


@query("place_station_map", sql("SELECT * FROM pmap", _MAP))
def place_station_map(spark, sf):
    return mapping(spark, sf)


@query("mapping_coverage", sql(f"""
SELECT count(*) AS n_mapped, count(DISTINCT station) AS n_stations, {r('100e0 * count(*) / (SELECT count(*) FROM nation)', 2)} AS pct_mapped, {r('avg(distance_km)', 3)} AS km_mean,
 {r('median(distance_km)', 3)} AS km_median, {r('quantile_cont(distance_km, 0.9)', 3)} AS km_p90, {r('quantile_cont(distance_km, 0.95)', 3)} AS km_p95, max(distance_km) AS km_max, min(distance_km) AS km_min,
 count(*) FILTER (own_station) AS n_own, count(*) FILTER (NOT own_station) AS n_other FROM pmap""", _MAP))
def mapping_coverage(spark, sf):
    total = T.places(spark, sf).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return S.mapping_coverage(mapping(spark, sf), total)


@query("farthest_places", sql("SELECT place, station, distance_km FROM pmap ORDER BY distance_km DESC, place LIMIT 10", _MAP))
def farthest_places(spark, sf):
    return S.farthest_places(mapping(spark, sf))


@query("most_used_stations", sql("SELECT station, count(*) AS n_places FROM pmap GROUP BY 1 ORDER BY n_places DESC, station LIMIT 10", _MAP))
def most_used_stations(spark, sf):
    return S.most_used_stations(mapping(spark, sf))


@query("daily_weather_of_places", sql("SELECT n.place, n.station, n.source, d.day, d.rain_mm FROM near n LEFT JOIN (SELECT * FROM daily JOIN stations USING (station)) d ON d.station = n.station AND d.source = n.source"))
def daily_weather_of_places(spark, sf):
    daily = T.daily_rain(spark, sf).join(T.stations(spark, sf).select("station", "source"), "station")
    return Wx.daily_of_places(near(spark, sf), daily)


# --- hourly readings (events) --------------------------------------------------------------

def hourly(spark, sf):
    """event = one reading of station user_id; click values are rain, the others carry temperature."""
    e = T.read(spark, sf, "events")
    v = F.col("value")
    return e.select(
        F.col("user_id").alias("station"), F.col("ts").cast("date").alias("day"), F.hour("ts").alias("hour"), "ts", "event_id",
        F.when(F.col("event_type") != "error", v).alias("rain"),
        F.when(F.col("event_type") == "view", v).alias("temperature"),
        F.when(F.col("event_type") == "click", v).alias("humidity"),
    )


_HOURLY = {"hourly": """
SELECT user_id AS station, CAST(ts AS DATE) AS day, hour(ts) AS hour, ts, event_id, CASE WHEN event_type <> 'error' THEN value END AS rain,
 CASE WHEN event_type = 'view' THEN value END AS temperature, CASE WHEN event_type = 'click' THEN value END AS humidity FROM events"""}
_DAYAGG = f"""
SELECT station, day, {r('sum(rain)', 4)} AS rain_mm, count(rain) AS valid_hours, min(temperature) AS temperature_min, max(temperature) AS temperature_max, {r('avg(temperature)')} AS temperature_mean,
 min(humidity) AS humidity_min, max(humidity) AS humidity_max, {r('avg(humidity)')} AS humidity_mean FROM hourly GROUP BY 1, 2"""


@query("hourly_to_daily", sql(_DAYAGG, _HOURLY))
def hourly_to_daily(spark, sf):
    return rounded(Wx.hourly_to_daily(hourly(spark, sf)), rain_mm=4, temperature_mean=6, humidity_mean=6)


@query("daily_reading_rules", sql(f"""
SELECT station, day, CASE WHEN rain_mm < 0 THEN 'precipitacao_mm negativa' WHEN humidity_min NOT BETWEEN 0 AND 100 THEN 'humidity_min fora de 0-100' WHEN humidity_max NOT BETWEEN 0 AND 100 THEN 'humidity_max fora de 0-100'
 WHEN humidity_mean NOT BETWEEN 0 AND 100 THEN 'humidity_mean fora de 0-100' END AS reject_reason,
 CAST(coalesce(CAST(temperature_min NOT BETWEEN 10 AND 42 AS INTEGER), 0) + coalesce(CAST(temperature_max NOT BETWEEN 10 AND 42 AS INTEGER), 0) + coalesce(CAST(temperature_mean NOT BETWEEN 10 AND 42 AS INTEGER), 0) AS BIGINT) AS temperature_warnings FROM dayagg""", {**_HOURLY, "dayagg": _DAYAGG}))
def daily_reading_rules(spark, sf):
    d = rounded(Wx.hourly_to_daily(hourly(spark, sf)), rain_mm=4, temperature_mean=6, humidity_mean=6)
    return Wx.validate_daily(d).select("station", "day", "reject_reason", "temperature_warnings")


@query("readings_keep_last", sql("""
SELECT station, day, hour, event_id, rain FROM (SELECT *, row_number() OVER (PARTITION BY station, day, hour ORDER BY ts DESC, event_id DESC) AS rn FROM hourly) WHERE rn = 1""", _HOURLY))
def readings_keep_last(spark, sf):
    return Wx.keep_last(hourly(spark, sf), ["station", "day", "hour"], ["ts", "event_id"]).select("station", "day", "hour", "event_id", "rain")


@query("readings_keep_first", sql("""
SELECT station, day, hour, event_id, rain FROM (SELECT *, row_number() OVER (PARTITION BY station, day, hour ORDER BY ts, event_id) AS rn FROM hourly) WHERE rn = 1""", _HOURLY))
def readings_keep_first(spark, sf):
    return Wx.keep_first(hourly(spark, sf), ["station", "day", "hour"], ["ts", "event_id"]).select("station", "day", "hour", "event_id", "rain")


_PROFILE = {**_HOURLY, "prof": f"""
SELECT station, CAST(sum(n) AS BIGINT) AS n_rows, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS days, CAST(sum(n - 1) AS BIGINT) AS duplicate_hours,
 max(day) - min(day) + 1 AS expected_days, {r('100e0 * count(DISTINCT day) / (max(day) - min(day) + 1)', 2)} AS coverage_pct, {r('100e0 * (sum(n) - sum(nr)) / sum(n)', 2)} AS null_pct
FROM (SELECT station, day, hour, count(*) AS n, count(rain) AS nr FROM hourly GROUP BY ALL) GROUP BY station"""}


@query("station_profile", sql("SELECT * FROM prof", _PROFILE))
def station_profile(spark, sf):
    return S.station_profile(hourly(spark, sf))


@query("station_findings", sql("""
SELECT station, 'null share above limit' AS finding FROM prof WHERE null_pct > 20 UNION ALL SELECT station, 'duplicate hours' FROM prof WHERE duplicate_hours > 0
UNION ALL SELECT station, 'days missing' FROM prof WHERE coverage_pct < 80""", _PROFILE))
def station_findings(spark, sf):
    return S.station_findings(S.station_profile(hourly(spark, sf)))


# --- weather windows ---------------------------------------------------------------------------

_DAILYW = ["rain_7d", "rain_14d", "rain_21d", "rain_28d"]


@query("trailing_daily_rain", sql("""
SELECT station, d.day, rain_mm, """ + ", ".join(f"sum(rain_mm) OVER (PARTITION BY station ORDER BY d.day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS rain_{n}d, count(rain_mm) OVER (PARTITION BY station ORDER BY d.day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS valid_days_{n}d" for n in (7, 14, 21, 28)) + """
FROM (SELECT station, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT station, min(day) AS lo, max(day) AS hi FROM daily GROUP BY 1)) d LEFT JOIN daily USING (station, day)"""))
def trailing_daily_rain(spark, sf):
    return Wx.trailing_daily(Wx.dense_daily(T.daily_rain(spark, sf)))


_STN = ["station", "source", "station_km", "rain_week", "rain_day_max", "rain_days", "valid_days_week", "completeness", *_DAILYW, "valid_days_7d", "valid_days_28d"]


@query("station_weather_block", sql(f"SELECT place, kind, week_index, {', '.join(_STN)}, {r('rain_day_mean')} AS rain_day_mean FROM wx"))
def station_weather_block(spark, sf):
    return rounded(gold_station(spark, sf).select("place", "kind", "week_index", *_STN, "rain_day_mean"), rain_day_mean=6)


_CELLC = ["cell_rain_1w", "cell_rain_2w", "cell_rain_3w", "cell_rain_4w", "cell_temp_mean", "cell_temp_min", "cell_temp_max", "cell_humidity"]
_CELLK = ["rain_cell", "temp_cell", "cell_rain_valid_days", "cell_temp_valid_days", "cell_coverage"]
_CELLSQL = f"SELECT place, kind, week_index, {', '.join(_CELLK)}, {', '.join(f'{r(c)} AS {c}' for c in _CELLC)} FROM gold"


@query("cell_weather_block", sql(_CELLSQL))
def cell_weather_block(spark, sf):
    g = Wx.add_cell_weather(T.grid(spark, sf), T.place_cells(spark, sf), T.cell_daily(spark, sf))
    return rounded(g.select("place", "kind", "week_index", *_CELLK, *_CELLC), **{c: 6 for c in _CELLC})


@query("cell_weather_enrichment", sql(_CELLSQL))
def cell_weather_enrichment(spark, sf):
    g = Wx.enrich_cell_weather(T.grid(spark, sf), T.place_cells(spark, sf), T.cell_daily(spark, sf))
    return rounded(g.select("place", "kind", "week_index", *_CELLK, *_CELLC), **{c: 6 for c in _CELLC})


_LIM = {"rain_mm": (0.0, 30.0), "temp_mean": (22.0, 23.0), "temp_min": (-10.0, 45.0), "temp_max": (0.0, 30.0), "humidity": (0.0, 100.0)}


@query("implausible_to_null", sql("SELECT layer, cell, day, " + ", ".join(f"{r(f'CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END')} AS {c}" for c, (lo, hi) in _LIM.items()) + " FROM cells"))
def implausible_to_null(spark, sf):
    return rounded(Wx.bounded_cells(T.cell_daily(spark, sf), _LIM), **{c: 6 for c in _LIM})


@query("out_of_range_counts", sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} NOT BETWEEN {lo} AND {hi}) AS out_of_range FROM cells" for c, (lo, hi) in _LIM.items())))
def out_of_range_counts(spark, sf):
    return Wx.out_of_range_counts(T.cell_daily(spark, sf), _LIM)


@query("rows_with_station_reading", sql("SELECT place, kind, week_index, rain_week FROM wx WHERE coalesce(valid_days_week, 0) > 0"))
def rows_with_station_reading(spark, sf):
    return Wx.real_station_rows(gold_station(spark, sf)).select("place", "kind", "week_index", "rain_week")


@query("cell_distances", sql(f"""
SELECT place, n.station, {r(_dist('p.lat', 'p.lon', 's.lat', 's.lon'), 4)} AS km, printf('%.4f_%.4f', s.lat, s.lon) AS cell FROM near n JOIN places p USING (place) JOIN stations s ON s.station = n.station"""))
def cell_distances(spark, sf):
    st = T.stations(spark, sf).select("station", F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    j = near(spark, sf).join(T.places(spark, sf).select("place", "lat", "lon"), "place").join(st, "station")
    return j.select(
        "place", "station", round_even(geo.distance_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")), 4).alias("km"),
        geo.cell_id(F.col("slat"), F.col("slon")).alias("cell"),
    )


# --- coverage and series --------------------------------------------------------------------------

@query("week_coverage", sql(f"""
SELECT epi_year, epi_week, min(week_start) AS week_start, CAST(sum(cases) AS BIGINT) AS cases, count(*) FILTER (cases > 0) AS rows_with_case, count(*) FILTER (coalesce(valid_days_week, 0) > 0) AS rows_with_reading, {r('avg(rain_week)')} AS rain_mean
FROM wx GROUP BY 1, 2"""))
def week_coverage(spark, sf):
    return rounded(explore.week_coverage(gold_station(spark, sf)), rain_mean=6)


@query("place_totals", sql("""
SELECT place, place_name, CAST(sum(cases) AS BIGINT) AS cases, min(area_km2) AS area_km2, count(*) FILTER (cases > 0) AS rows_with_case, min(source) AS source, min(station_km) AS station_km FROM wx GROUP BY 1, 2"""))
def place_totals(spark, sf):
    return explore.place_totals(gold_station(spark, sf))


_HAS = "coalesce(valid_days_week, 0) > 0"


@query("epidemiological_kpis", sql(f"""
SELECT count(*) AS n_rows, CAST(sum(cases) AS BIGINT) AS cases, count(DISTINCT place) AS n_places, min(epi_year) AS first_year, max(epi_year) AS last_year, count(DISTINCT epi_year * 100 + epi_week) AS n_weeks,
 (SELECT string_agg(kind, ',' ORDER BY kind) FROM (SELECT DISTINCT kind FROM wx)) AS kinds, count(DISTINCT place) FILTER (cases > 0) AS places_with_case, count(DISTINCT place) FILTER ({_HAS}) AS places_with_reading,
 {r(f'100e0 * count(*) FILTER ({_HAS}) / count(*)', 4)} AS pct_rows_with_reading FROM wx"""))
def epidemiological_kpis(spark, sf):
    return explore.kpis(gold_station(spark, sf))


@query("weekly_series_by_kind", sql("SELECT epi_year, epi_week, week_start, kind, CAST(sum(cases) AS BIGINT) AS cases FROM grid GROUP BY ALL"))
def weekly_series_by_kind(spark, sf):
    return explore.weekly_series(T.grid(spark, sf))


@query("weekly_series_total", sql("SELECT epi_year, epi_week, week_start, CAST(sum(cases) AS BIGINT) AS cases FROM grid GROUP BY ALL"))
def weekly_series_total(spark, sf):
    return explore.weekly_series(T.grid(spark, sf), per_kind=False)


@query("kinds_by_year", sql("SELECT epi_year, kind, CAST(sum(cases) AS BIGINT) AS cases FROM grid GROUP BY ALL"))
def kinds_by_year(spark, sf):
    return explore.kinds_by_year(T.grid(spark, sf))


@query("seasonality", sql(f"""
SELECT epi_week, CAST(sum(c) AS BIGINT) AS total, {r('avg(c)')} AS mean_per_year, count(DISTINCT epi_year) AS n_years FROM (SELECT epi_year, epi_week, sum(cases) AS c FROM grid GROUP BY ALL) GROUP BY 1"""))
def seasonality(spark, sf):
    return rounded(explore.seasonality(T.grid(spark, sf)), mean_per_year=6)


@query("year_by_week_pivot", sql("SELECT epi_year, " + ", ".join(f"CAST(coalesce(sum(cases) FILTER (epi_week = {w}), 0) AS BIGINT) AS w{w:02d}" for w in range(1, 54)) + " FROM grid GROUP BY 1"))
def year_by_week_pivot(spark, sf):
    return explore.year_by_week(T.grid(spark, sf))


@query("region_by_year_pivot", sql("SELECT region, " + ", ".join(f"CAST(coalesce(sum(cases) FILTER (epi_year = {y}), 0) AS BIGINT) AS y{y}" for y in range(1995, 2002)) + " FROM grid GROUP BY 1"))
def region_by_year_pivot(spark, sf):
    g = T.grid(spark, sf)
    return explore.region_by_year(g, years_of(g))


@query("station_coverage", sql(f"""
SELECT count(*) AS n_rows, count(*) FILTER ({_HAS}) AS rows_with_reading, {r(f'100e0 * count(*) FILTER ({_HAS}) / count(*)', 4)} AS pct_rows, count(DISTINCT place) FILTER ({_HAS}) AS places_with_reading, count(DISTINCT place) AS n_places,
 {r(f'100e0 * count(DISTINCT place) FILTER ({_HAS}) / count(DISTINCT place)', 2)} AS pct_places, (SELECT string_agg(CAST(epi_year AS VARCHAR), ',' ORDER BY epi_year) FROM (SELECT DISTINCT epi_year FROM wx WHERE {_HAS})) AS years,
 count(DISTINCT station) FILTER ({_HAS}) AS n_stations, (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT DISTINCT source FROM wx WHERE {_HAS})) AS sources FROM wx"""))
def station_coverage(spark, sf):
    return explore.station_coverage(gold_station(spark, sf))


@query("station_coverage_by_year", sql(f"""
SELECT epi_year, count(*) AS n_rows, count(*) FILTER ({_HAS}) AS rows_with_reading, {r(f'100e0 * count(*) FILTER ({_HAS}) / count(*)', 4)} AS pct_rows, count(DISTINCT place) FILTER ({_HAS}) AS places_with_reading,
 {r(f'100e0 * count(DISTINCT place) FILTER ({_HAS}) / count(DISTINCT place)', 2)} AS pct_places FROM wx GROUP BY 1"""))
def station_coverage_by_year(spark, sf):
    return explore.station_coverage_by_year(gold_station(spark, sf))


@query("station_coverage_by_place", sql(f"""
SELECT place, place_name, count(*) FILTER ({_HAS}) AS rows_with_reading, {r(f'100e0 * count(*) FILTER ({_HAS}) / (SELECT count(*) FROM cal)', 2)} AS pct_weeks FROM wx GROUP BY 1, 2"""))
def station_coverage_by_place(spark, sf):
    return explore.station_coverage_by_place(gold_station(spark, sf))


@query("station_coverage_heat_map", sql(f"""
SELECT epi_year, epi_week, count(DISTINCT place) FILTER ({_HAS}) AS places_with_reading, {r(f'100e0 * count(DISTINCT place) FILTER ({_HAS}) / (SELECT count(*) FROM places)', 2)} AS pct_places FROM wx GROUP BY 1, 2"""))
def station_coverage_heat_map(spark, sf):
    return explore.station_coverage_grid(gold_station(spark, sf))


@query("rain_series", sql(f"SELECT epi_year, epi_week, week_start, {r('avg(rain_week)')} AS rain_mean, count(DISTINCT place) AS n_places FROM wx WHERE {_HAS} GROUP BY ALL"))
def rain_series(spark, sf):
    return rounded(explore.rain_series(gold_station(spark, sf)), rain_mean=6)


@query("rate_coverage_by_year", sql(f"SELECT epi_year, count(*) AS n_rows, count(rate_1w) AS rows_with_rate, {r('100e0 * count(rate_1w) / count(*)', 2)} AS pct_rows FROM rates GROUP BY 1"))
def rate_coverage_by_year(spark, sf):
    return explore.rate_coverage_by_year(with_rates(spark, sf))


@query("cell_coverage", sql(f"""
SELECT count(*) AS n_rows, count(*) FILTER (cell_rain_valid_days > 0) AS rows_with_cell, {r('100e0 * count(*) FILTER (cell_rain_valid_days > 0) / count(*)', 4)} AS pct_rows,
 count(DISTINCT rain_cell) FILTER (cell_rain_valid_days > 0) AS n_rain_cells, count(DISTINCT temp_cell) FILTER (cell_rain_valid_days > 0) AS n_temp_cells,
 (SELECT median(n) FROM (SELECT count(DISTINCT cell_rain_1w) AS n FROM gold WHERE cell_rain_valid_days > 0 GROUP BY epi_year, epi_week)) AS distinct_values_median FROM gold"""))
def cell_coverage(spark, sf):
    return explore.cell_coverage(gold(spark, sf))


@query("double_coverage_by_year", sql(f"""
SELECT epi_year, count(*) AS n_rows, {r('100e0 * count(*) FILTER (cell_rain_valid_days > 0) / count(*)', 2)} AS pct_cell, {r(f'100e0 * count(*) FILTER ({_HAS}) / count(*)', 2)} AS pct_station FROM gold GROUP BY 1"""))
def double_coverage_by_year(spark, sf):
    return explore.double_coverage_by_year(gold(spark, sf))


_CS = {"cellser": """
SELECT epi_year, epi_week, week_start, avg(cell_rain_1w) AS rain_mm, avg(cell_temp_mean) AS temp_mean, avg(cell_temp_min) AS temp_min, avg(cell_temp_max) AS temp_max, avg(cell_humidity) AS humidity, count(*) AS n_places
FROM gold WHERE kind = 'F' AND cell_rain_valid_days > 0 GROUP BY ALL"""}
_M5 = ["rain_mm", "temp_mean", "temp_min", "temp_max", "humidity"]


def cell_gold(spark, sf):
    return Wx.add_cell_weather(with_rates(spark, sf), T.place_cells(spark, sf), T.cell_daily(spark, sf))


@query("cell_series", sql("SELECT epi_year, epi_week, week_start, n_places, " + ", ".join(f"{r(c)} AS {c}" for c in _M5) + " FROM cellser", _CS))
def cell_series(spark, sf):
    return rounded(explore.cell_series(cell_gold(spark, sf)), **{c: 6 for c in _M5})


@query("cell_seasonality", sql(f"SELECT epi_week, {r('avg(rain_mm)')} AS rain_mean, {r('avg(temp_mean)')} AS temp_mean, {r('avg(humidity)')} AS humidity_mean, count(DISTINCT epi_year) AS n_years FROM cellser GROUP BY 1", _CS))
def cell_seasonality(spark, sf):
    return rounded(explore.cell_seasonality(cell_gold(spark, sf)), rain_mean=6, temp_mean=6, humidity_mean=6)


@query("rank_places", sql("SELECT place, place_name, CAST(sum(cases) AS BIGINT) AS cases, row_number() OVER (ORDER BY sum(cases) DESC, place) AS position FROM grid GROUP BY 1, 2 ORDER BY position LIMIT 10"))
def rank_places(spark, sf):
    return explore.rank_places(T.grid(spark, sf))


@query("rank_places_ascending", sql("SELECT place, place_name, CAST(sum(cases) AS BIGINT) AS cases, row_number() OVER (ORDER BY sum(cases), place) AS position FROM grid GROUP BY 1, 2"))
def rank_places_ascending(spark, sf):
    return explore.rank_places(T.grid(spark, sf), None, ascending=True)


@query("yearly_cases", sql(f"""
SELECT y.*, {r(rate('cases', 'population'), 1)} AS rate, (SELECT median(cases) FROM yr) > 0 AND cases >= 1.5 * (SELECT median(cases) FROM yr) AS high_year,
 epi_year = (SELECT epi_year FROM yr ORDER BY cases DESC, epi_year LIMIT 1) AS peak_year,
 (SELECT epi_week FROM (SELECT epi_week, avg(c) AS m FROM (SELECT epi_year, epi_week, sum(cases) AS c FROM grid GROUP BY ALL) GROUP BY 1) ORDER BY m DESC, epi_week LIMIT 1) AS peak_week
FROM (SELECT epi_year, cases, CAST(p AS BIGINT) AS population FROM yr JOIN (SELECT epi_year, sum(population) AS p FROM pop GROUP BY 1) USING (epi_year)) y""", {"yr": "SELECT epi_year, CAST(sum(cases) AS BIGINT) AS cases FROM grid GROUP BY 1"}))
def yearly_cases(spark, sf):
    return explore.yearly_cases(with_rates(spark, sf))


@query("latest_week", sql("SELECT epi_year, epi_week FROM cal ORDER BY week_start DESC LIMIT 1"))
def latest_week(spark, sf):
    return explore.latest_week(T.grid(spark, sf))


@query("weeks_newest_first", sql("SELECT epi_year, epi_week, week_start FROM cal ORDER BY week_start DESC LIMIT 20"))
def weeks_newest_first(spark, sf):
    return explore.weeks_newest_first(T.grid(spark, sf), 20)


@query("table_span", sql("SELECT min(week_start) AS first_day, max(week_end) AS last_day, (SELECT count(*) FROM places) AS n_places FROM cal"))
def table_span(spark, sf):
    return explore.table_span(T.grid(spark, sf))


@query("distinct_centroids", sql("SELECT place, place_name, lat, lon FROM places"))
def distinct_centroids(spark, sf):
    return explore.distinct_centroids(T.grid(spark, sf))


@query("small_places", sql("""
SELECT small, count(DISTINCT place) AS n_places, count(*) FILTER (s1 = 1) AS weekly_events, count(*) FILTER (s4 = 1) AS four_week_events FROM (
 SELECT a.place, a.state AS s1, b.state AS s4, m.med <= (SELECT quantile_cont(med, 0.25) FROM mp) AS small FROM rstates a JOIN rstates4 b USING (place, kind, week_index) JOIN mp m USING (place)) GROUP BY 1""", {
    "rthr": state_block("rates", "rate_1w"),
    "rstates": "SELECT *, CASE WHEN rate_1w > threshold THEN 1e0 WHEN threshold IS NOT NULL THEN 0e0 END AS state FROM rthr",
    "rthr4": state_block("rates", "rate_4w"),
    "rstates4": "SELECT *, CASE WHEN rate_4w > threshold THEN 1e0 WHEN threshold IS NOT NULL THEN 0e0 END AS state FROM rthr4",
    "mp": "SELECT place, median(population) AS med FROM rates GROUP BY 1",
}))
def small_places(spark, sf):
    from weekwatch.operators import threshold

    s = threshold.alert_state(with_rates(spark, sf), "rate_1w", suffix="_rate")
    return explore.small_places(threshold.alert_state(s, "rate_4w", suffix="_rate_4w"))


# --- association -----------------------------------------------------------------------------------

@query("window_correlations", sql(" UNION ALL ".join(
    f"SELECT CAST({n} AS BIGINT) AS window_days, count(*) AS n, {r(f'corr(cases, rain_{n}d)', 4)} AS pearson, count(*) >= 30 AS reliable FROM wx WHERE rain_{n}d IS NOT NULL"
    for n in (7, 14, 21, 28))))
def window_correlations(spark, sf):
    return A.window_correlations(gold_station(spark, sf))


def _rank(c: str, part: str) -> str:
    return f"rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2e0"


@query("grid_correlations", sql(f"""
SELECT CAST(n AS BIGINT) AS window_weeks, CAST(n * 7 AS BIGINT) AS window_days, count(*) AS n, {r('corr(cases, x)', 4)} AS pearson, {r('corr(ry, rx)', 4)} AS spearman, count(*) >= 30 AS reliable FROM (
 SELECT *, {_rank('x', 'n')} AS rx, {_rank('cases', 'n')} AS ry FROM (""" + " UNION ALL ".join(f"SELECT {n} AS n, cases, {r(f'cell_rain_{n}w', 9)} AS x FROM gold WHERE cell_rain_valid_days > 0 AND cell_rain_{n}w IS NOT NULL" for n in (1, 2, 3, 4)) + ")) GROUP BY n"))
def grid_correlations(spark, sf):
    return A.grid_correlations(cell_gold(spark, sf))


@query("correlation_matrix", sql(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM wx WHERE {_HAS}"
    for i, a in enumerate(A.MATRIX_COLUMNS) for b in A.MATRIX_COLUMNS[i:])))
def correlation_matrix(spark, sf):
    return rounded(A.correlation_matrix(gold_station(spark, sf)), r=6)


@query("rain_scatter", sql("SELECT place, place_name, epi_year, epi_week, kind, rain_14d AS rain_mm, cases FROM wx WHERE rain_14d IS NOT NULL"))
def rain_scatter(spark, sf):
    return A.scatter(gold_station(spark, sf), "rain_14d")


_PAIRS = {"prs": f"SELECT place, epi_year, epi_week, {r('rain_week', 9)} AS station_mm, {r('cell_rain_1w', 9)} AS grid_mm FROM gold WHERE kind = 'F' AND cell_rain_valid_days > 0 AND {_HAS}"}


@query("source_agreement", sql(f"""
SELECT count(*) AS n, {r('corr(grid_mm, station_mm)', 4)} AS pearson, {r('corr(rg, rs)', 4)} AS spearman, {r('avg(abs(grid_mm - station_mm))', 3)} AS mae, {r('sqrt(avg((grid_mm - station_mm) * (grid_mm - station_mm)))', 3)} AS rmse,
 {r('avg(grid_mm - station_mm)', 3)} AS bias, {r('CASE WHEN sum(station_mm) > 0 THEN sum(grid_mm) / sum(station_mm) END', 4)} AS total_ratio,
 {r('avg(CAST((grid_mm >= 20) = (station_mm >= 20) AS INTEGER)) * 100', 2)} AS wet_agreement_pct, {r('avg(CAST(grid_mm >= 20 AS INTEGER)) FILTER (station_mm >= 20) * 100', 2)} AS wet_recall_pct
FROM (SELECT *, {_rank('grid_mm', 'g')} AS rg, {_rank('station_mm', 'g')} AS rs FROM (SELECT *, 1 AS g FROM prs))""", _PAIRS))
def source_agreement(spark, sf):
    return A.agreement(A.both_sources(gold(spark, sf)))


@query("source_agreement_city", sql(f"""
SELECT count(*) AS n_weeks, {r('corr(g, s)', 4)} AS pearson, {r('corr(rg, rs)', 4)} AS spearman FROM (SELECT *, {_rank('g', 'o')} AS rg, {_rank('s', 'o')} AS rs FROM
 (SELECT epi_year, epi_week, 1 AS o, avg(grid_mm) AS g, avg(station_mm) AS s FROM prs GROUP BY ALL))""", _PAIRS))
def source_agreement_city(spark, sf):
    return A.city_agreement(A.both_sources(gold(spark, sf)))


@query("source_agreement_by_place", sql(f"SELECT place, count(*) AS n_weeks, {r('corr(grid_mm, station_mm)', 4)} AS pearson FROM prs GROUP BY 1 HAVING count(*) >= 10", _PAIRS))
def source_agreement_by_place(spark, sf):
    return A.place_agreement(A.both_sources(gold(spark, sf)))


def lag_pairs(spark, sf):
    g = cell_gold(spark, sf)
    return A.city_pairs(rates.city_series(g), explore.cell_series(g), {c: c for c in _M5}, {"casos": "cases", "incidencia": "rate"})


_LAGS = {**_CS, "prw": " UNION ALL ".join(
    f"SELECT s.kind, '{t}' AS target, '{v}' AS variable, s.series_index, s.epi_week, CAST(s.{c} AS DOUBLE) AS y, {r(f'w.{v}', 9)} AS x FROM series s JOIN cellser w USING (epi_year, epi_week)"
    for t, c in (("casos", "cases"), ("incidencia", "rate")) for v in _M5),
    "prs2": "SELECT *, false AS adjusted FROM prw UNION ALL SELECT kind, target, variable, series_index, epi_week, " + r("y - avg(y) OVER p", 9) + " AS y, " + r("x - avg(x) OVER p", 9) + " AS x, true FROM prw WINDOW p AS (PARTITION BY kind, target, variable, epi_week)",
    "pos": "SELECT *, row_number() OVER (PARTITION BY kind, target, variable, adjusted ORDER BY series_index) AS t FROM prs2",
    "lagged": "SELECT a.kind, a.target, a.variable, a.adjusted, CAST(k AS BIGINT) AS lag, a.y, b.x FROM pos a CROSS JOIN (SELECT unnest(generate_series(0, 12)) AS k) JOIN pos b ON b.kind = a.kind AND b.target = a.target AND b.variable = a.variable AND b.adjusted = a.adjusted AND b.t = a.t - k",
    "lagtab": f"""SELECT kind, target, variable, adjusted, lag, {r('corr(rx, ry)', 4)} AS spearman, count(*) AS n, count(*) >= 30 AS reliable FROM (
 SELECT *, {_rank('x', 'kind, target, variable, adjusted, lag')} AS rx, {_rank('y', 'kind, target, variable, adjusted, lag')} AS ry FROM lagged WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY ALL"""}


@query("lag_correlations", sql("SELECT kind, target, variable, lag, spearman, n, reliable FROM lagtab WHERE NOT adjusted", _LAGS))
def lag_correlations(spark, sf):
    return A.lag_correlations(lag_pairs(spark, sf)).drop("p_value")


@query("lag_correlation_p_values")
def lag_correlation_p_values(spark, sf):
    return A.lag_correlations(lag_pairs(spark, sf))


@query("seasonal_residuals", sql(f"SELECT kind, target, variable, series_index, {r('y', 5)} AS y, {r('x', 5)} AS x FROM prs2 WHERE adjusted", _LAGS))
def seasonal_residuals(spark, sf):
    return rounded(A.remove_season(lag_pairs(spark, sf)).select("kind", "target", "variable", "series_index", "y", "x"), y=5, x=5)
