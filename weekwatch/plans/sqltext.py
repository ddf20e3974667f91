"""Building blocks of the oracle SQL: named common table expressions, joined on demand.

`sql(body)` prefixes the blocks the body names (and the ones those name).
"""

from __future__ import annotations

import re

ONE = "1e0"


def r(expr: str, digits: int = 6) -> str:
    """Half-even rounding in the same arithmetic as the Spark side."""
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits})"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def sunday(d: str) -> str:
    return f"({d} - CAST(dayofweek({d}) AS INTEGER))"


def week_one(y: str) -> str:
    j4 = f"make_date(CAST({y} AS INTEGER), 1, 4)"
    return f"({j4} - CAST(dayofweek({j4}) AS INTEGER))"


def rate(cases: str, pop: str) -> str:
    return f"(CASE WHEN {pop} > 0 THEN 100000e0 * {cases} / {pop} END)"


def pct_change(now: str, before: str) -> str:
    return (
        f"(CASE WHEN {before} > 0 THEN {r(f'100e0 * ({now} - {before}) / {before}', 1)} "
        f"WHEN {before} = 0 AND {now} <> 0 THEN CAST('inf' AS DOUBLE) END)"
    )


def trend(c: str) -> str:
    return (
        f"(CASE WHEN {c} IS NULL THEN 'sem base de comparação' WHEN {c} >= 20 THEN 'em alta' "
        f"WHEN {c} <= -20 THEN 'em queda' ELSE 'estável' END)"
    )


def distance(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a, b = f"radians({lat1})", f"radians({lat2})"
    return (
        f"(2 * 6371.0088e0 * asin(sqrt(pow(sin(({b} - {a}) / 2), 2) + cos({a}) * cos({b}) * "
        f"pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"
    )


BLOCKS: dict[str, str] = {}

BLOCKS["notif"] = (
    "SELECT CAST(c_nationkey AS BIGINT) AS place, o_orderstatus AS kind, CAST(o_orderdate AS DATE) AS day, "
    f"o_orderkey AS id, {sunday('CAST(o_orderdate AS DATE)')} AS week_start "
    "FROM orders JOIN customer ON o_custkey = c_custkey"
)
BLOCKS["counts"] = "SELECT place, kind, week_start, count(*) AS cases FROM notif GROUP BY ALL"
BLOCKS["places"] = (
    "SELECT CAST(n_nationkey AS BIGINT) AS place, n_name AS place_name, CAST(n_regionkey AS BIGINT) AS region, "
    "10e0 + 3 * n_nationkey AS area_km2, -8e0 - ((CAST(n_nationkey AS BIGINT) * 7) % 25) * 1e-2 AS lat, "
    "-34.9e0 - ((CAST(n_nationkey AS BIGINT) * 11) % 25) * 1e-2 AS lon FROM nation"
)
BLOCKS["kinds"] = "SELECT unnest(['F', 'O', 'P']) AS kind"
BLOCKS["wspan"] = f"SELECT {sunday('CAST(min(o_orderdate) AS DATE)')} AS lo, {sunday('CAST(max(o_orderdate) AS DATE)')} AS hi FROM orders"
BLOCKS["weeks"] = "SELECT CAST(g AS DATE) AS week_start, CAST(lo AS DATE) AS first_week FROM wspan, LATERAL (SELECT unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS g)"
BLOCKS["cal"] = (
    "SELECT week_start, CAST(week_start + 6 AS DATE) AS week_end, year(week_start + 3) AS epi_year, "
    f"(week_start - {week_one('year(week_start + 3)')}) // 7 + 1 AS epi_week, (week_start - first_week) // 7 AS week_index FROM weeks"
)
BLOCKS["grid"] = (
    "SELECT p.*, k.kind, c.*, coalesce(n.cases, 0) AS cases FROM places p CROSS JOIN kinds k CROSS JOIN cal c "
    "LEFT JOIN counts n ON n.place = p.place AND n.kind = k.kind AND n.week_start = c.week_start"
)
BLOCKS["base_pop"] = "SELECT CAST(c_nationkey AS BIGINT) AS place, count(*) AS base FROM customer GROUP BY 1"
BLOCKS["pop"] = (
    "SELECT place, y AS epi_year, CAST(base * (100 + 2 * (y - 1995)) AS BIGINT) AS population, "
    "CASE WHEN y <= 1996 THEN 'censo' WHEN y <= 1999 THEN 'estimativa' ELSE 'projecao' END AS population_type "
    "FROM base_pop CROSS JOIN (SELECT unnest(generate_series(1995, 2002)) AS y)"
)


def _roll(n: int) -> str:
    return f"sum(cases) OVER (PARTITION BY place, kind ORDER BY week_index ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


BLOCKS["rates"] = (
    "SELECT *, " + r("population / area_km2", 2) + " AS density, " + rate("cases", "population") + " AS rate_1w, "
    + ", ".join(f"{rate(_roll(n), 'population')} AS {c}" for c, n in (("rate_4w", 4), ("rate_8w", 8), ("rate_12w", 12), ("rate_year", 52)))
    + " FROM grid LEFT JOIN pop USING (place, epi_year)"
)


def state_block(source: str, value: str) -> str:
    """Seasonal and general thresholds by self joins on earlier years."""
    return f"""
SELECT t.*, 
  round_even((CASE WHEN s.n >= 15 THEN s.p WHEN coalesce(g.n, 0) >= 20 THEN g.p END) * 1e9, 0) / 1e9 AS threshold,
  CASE WHEN s.n >= 15 THEN 'sazonal' WHEN coalesce(g.n, 0) >= 20 THEN 'geral' ELSE 'indefinido' END AS threshold_type,
  CASE WHEN s.n >= 15 THEN s.n ELSE coalesce(g.n, 0) END AS n_history,
  s.wm AS week_mean, s.ws AS week_std, coalesce(s.wn, 0) AS week_n
FROM {source} t
LEFT JOIN (
  SELECT a.place, a.kind, a.epi_year, a.epi_week, count(h.{value}) AS n, quantile_cont(h.{value}, 0.9) AS p,
    avg(h.{value}) FILTER (h.epi_week = a.epi_week) AS wm, stddev_pop(h.{value}) FILTER (h.epi_week = a.epi_week) AS ws,
    count(h.{value}) FILTER (h.epi_week = a.epi_week) AS wn
  FROM {source} a JOIN {source} h ON h.place = a.place AND h.kind = a.kind AND h.epi_year < a.epi_year
    AND h.epi_week BETWEEN greatest(1, a.epi_week - 2) AND least(53, a.epi_week + 2)
  GROUP BY ALL) s ON s.place = t.place AND s.kind = t.kind AND s.epi_year = t.epi_year AND s.epi_week = t.epi_week
LEFT JOIN (
  SELECT a.place, a.kind, a.epi_year, count(h.{value}) AS n, quantile_cont(h.{value}, 0.9) AS p
  FROM (SELECT DISTINCT place, kind, epi_year FROM {source}) a JOIN {source} h
    ON h.place = a.place AND h.kind = a.kind AND h.epi_year < a.epi_year
  GROUP BY ALL) g ON g.place = t.place AND g.kind = t.kind AND g.epi_year = t.epi_year"""


BLOCKS["thr"] = state_block("rates", "cases")
BLOCKS["states"] = "SELECT *, CASE WHEN cases > threshold THEN 1e0 WHEN threshold IS NOT NULL THEN 0e0 END AS state FROM thr"
_W = "(PARTITION BY place, kind ORDER BY week_index)"


def _last(n: int) -> str:
    return f"(PARTITION BY place, kind ORDER BY week_index ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


BLOCKS["feat0"] = (
    "SELECT *, cases AS cases_t, state AS state_t, "
    + ", ".join(f"lag(cases, {k}) OVER {_W} AS lag_{k}" for k in (1, 2, 3, 4))
    + ", "
    + ", ".join(f"avg(cases) OVER {_last(n)} AS mean_{n}w" for n in (2, 4, 8))
    + f", CAST(sum(cases) OVER {_last(4)} AS BIGINT) AS sum_4w, max(cases) OVER {_last(4)} AS max_4w FROM states"
)
BLOCKS["feats"] = (
    "SELECT *, cases - lag_1 AS trend_1w, cases / (threshold + 1) AS threshold_ratio, "
    "(cases - week_mean) / (week_std + 1) AS z_score, cases / (mean_4w + 1) AS recent_ratio, "
    "cases - lag_1 AS delta_1w, cases - lag_2 AS delta_2w, cases - 2 * lag_1 + lag_2 AS acceleration, "
    "(cases - lag_1) / (lag_1 + 1e0) AS growth, "
    "CASE WHEN NOT coalesce(cases_t > lag_1, false) THEN 0e0 WHEN NOT coalesce(lag_1 > lag_2, false) THEN 1e0 "
    "WHEN NOT coalesce(lag_2 > lag_3, false) THEN 2e0 WHEN NOT coalesce(lag_3 > lag_4, false) THEN 3e0 ELSE 4e0 END AS rising_weeks, "
    "month(week_end) AS month, quarter(week_end) AS quarter, "
    "sin(2 * pi() * epi_week / 53) AS week_sin, cos(2 * pi() * epi_week / 53) AS week_cos FROM feat0"
)


def episode_block(source: str, state: str) -> str:
    return f"""
SELECT place, kind, min(week_index) AS start_index, max(week_index) AS end_index, arg_min(epi_year, week_index) AS start_year,
  arg_min(epi_week, week_index) AS start_week, count(*) AS weeks, CAST(sum(cases) AS DOUBLE) AS total_cases, CAST(max(cases) AS DOUBLE) AS peak_cases
FROM (SELECT *, week_index - row_number() OVER (PARTITION BY place, kind ORDER BY week_index) AS run FROM {source} WHERE {state} = 1)
GROUP BY place, kind, run"""


def onset_block(source: str, state: str, prefix: str = "onset_h") -> str:
    w = "(PARTITION BY place, kind ORDER BY week_index)"
    inner = f"""SELECT *, CASE WHEN coalesce({state} = 1, false) AND coalesce(lag({state}) OVER {w}, 0) <> 1 THEN 1 ELSE 0 END AS onset,
  CASE WHEN {state} IS NULL THEN 1 ELSE 0 END AS undef FROM {source}"""
    cols = ", ".join(
        f"CASE WHEN lead(week_index, {h}) OVER {w} IS NOT NULL THEN CASE WHEN max(onset) OVER (PARTITION BY place, kind ORDER BY week_index ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = 1 THEN 1e0 "
        f"WHEN max(undef) OVER (PARTITION BY place, kind ORDER BY week_index ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = 0 THEN 0e0 END END AS {prefix}{h}"
        for h in (1, 2, 3)
    )
    return f"SELECT * EXCLUDE (undef), {cols} FROM ({inner})"


BLOCKS["eps"] = episode_block("states", "state")
BLOCKS["onsets"] = onset_block("feats", "state")
BLOCKS["alerts"] = "SELECT place, kind, week_index + 1 AS alert_index FROM feats WHERE cases_t > lag_1 AND lag_1 > lag_2"
BLOCKS["judged"] = """
SELECT e.*, d.w AS detection_index, d.w IS NOT NULL AS detected, e.start_index - d.w AS lead_weeks,
  CASE WHEN e.start_index - d.w >= 1 THEN 'antecipado' WHEN e.start_index - d.w = 0 THEN 'simultaneo'
       WHEN e.start_index - d.w < 0 THEN 'tardio' ELSE 'perdido' END AS verdict
FROM eps e LEFT JOIN (SELECT e.place, e.kind, e.start_index, min(a.alert_index) AS w FROM eps e JOIN alerts a
  ON a.place = e.place AND a.kind = e.kind AND a.alert_index BETWEEN e.start_index - 4 AND e.end_index GROUP BY ALL) d
USING (place, kind, start_index)"""
BLOCKS["falses"] = """
SELECT a.place, a.kind, a.alert_index FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM eps e WHERE e.place = a.place AND e.kind = a.kind
  AND a.alert_index BETWEEN e.start_index - 4 AND e.end_index)"""
BLOCKS["ranked"] = (
    "SELECT *, row_number() OVER (PARTITION BY kind, week_index ORDER BY threshold_ratio DESC NULLS LAST, place) AS position FROM onsets"
)
# stations and weather
BLOCKS["stations"] = (
    "SELECT s_suppkey AS station, s_name AS station_name, ['APAC', 'CEMADEN', 'INMET'][s_suppkey % 3 + 1] AS source, "
    "-8e0 - ((s_suppkey * 37) % 1000) * 3e-4 AS lat, -34.9e0 - ((s_suppkey * 53) % 1000) * 3e-4 AS lon FROM supplier"
)
BLOCKS["daily"] = "SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS rain_mm FROM lineitem GROUP BY 1, 2"
BLOCKS["near"] = (
    "SELECT place, station, source, distance_km FROM (SELECT p.place, s.station, s.source, "
    + r(distance("p.lat", "p.lon", "s.lat", "s.lon"), 3)
    + " AS distance_km, row_number() OVER (PARTITION BY p.place ORDER BY "
    + distance("p.lat", "p.lon", "s.lat", "s.lon")
    + ", s.source, s.station) AS rn FROM places p CROSS JOIN stations s) WHERE rn = 1"
)


def _ago(n: int, f: str = "sum(d.rain_mm)") -> str:
    return f"{f} FILTER (d.day > c.week_end - {n})"


BLOCKS["stwin"] = (
    "SELECT n.station, c.week_end, "
    + ", ".join(f"{_ago(n)} AS rain_{n}d" for n in (7, 14, 21, 28))
    + f", {_ago(7, 'count(d.rain_mm)')} AS valid_days_7d, {_ago(28, 'count(d.rain_mm)')} AS valid_days_28d, "
    f"{_ago(7, 'max(d.rain_mm)')} AS rain_day_max, count(*) FILTER (d.day > c.week_end - 7 AND d.rain_mm > 0) AS rain_days, "
    f"{_ago(7)} / nullif({_ago(7, 'count(d.rain_mm)')}, 0) AS rain_day_mean "
    "FROM (SELECT DISTINCT station FROM near) n CROSS JOIN cal c JOIN daily d ON d.station = n.station AND d.day BETWEEN c.week_end - 27 AND c.week_end GROUP BY 1, 2"
)
BLOCKS["wx"] = (
    "SELECT g.*, n.station, n.source, n.distance_km AS station_km, w.rain_7d, w.rain_14d, w.rain_21d, w.rain_28d, "
    "CASE WHEN n.station IS NOT NULL THEN coalesce(w.valid_days_7d, 0) END AS valid_days_7d, "
    "CASE WHEN n.station IS NOT NULL THEN coalesce(w.valid_days_28d, 0) END AS valid_days_28d, "
    "CASE WHEN n.station IS NOT NULL THEN coalesce(w.rain_days, 0) END AS rain_days, w.rain_day_max, w.rain_day_mean, "
    "w.rain_7d AS rain_week, CASE WHEN n.station IS NOT NULL THEN coalesce(w.valid_days_7d, 0) END AS valid_days_week, "
    + r("CASE WHEN n.station IS NOT NULL THEN coalesce(w.valid_days_7d, 0) END / 7e0", 3)
    + " AS completeness FROM rates g LEFT JOIN near n ON n.place = g.place LEFT JOIN stwin w ON w.station = n.station AND w.week_end = g.week_end"
)
BLOCKS["cells"] = """
SELECT 'ERA5' AS layer, 'R' || CAST(l_suppkey % 7 AS VARCHAR) AS cell, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) / 10 AS rain_mm,
  CAST(NULL AS DOUBLE) AS temp_mean, CAST(NULL AS DOUBLE) AS temp_min, CAST(NULL AS DOUBLE) AS temp_max, CAST(NULL AS DOUBLE) AS humidity
FROM lineitem GROUP BY 2, 3
UNION ALL
SELECT 'ERA5-LAND', 'T' || CAST(l_suppkey % 5 AS VARCHAR), CAST(l_shipdate AS DATE), NULL, 20e0 + sum(l_quantity) / count(*) / 10,
  15e0 + min(l_tax) * 100, 25e0 + max(l_discount) * 100, 50e0 + sum(l_quantity) / count(*) FROM lineitem GROUP BY 2, 3"""
BLOCKS["cellrain"] = (
    "SELECT x.cell AS rain_cell, c.week_end, "
    + ", ".join(f"sum(x.rain_mm) FILTER (x.day > c.week_end - {7 * n}) AS cell_rain_{n}w" for n in (1, 2, 3, 4))
    + ", count(x.rain_mm) FILTER (x.day > c.week_end - 7) AS cell_rain_valid_days FROM cells x JOIN cal c ON x.day BETWEEN c.week_end - 27 AND c.week_end "
    "WHERE x.layer = 'ERA5' GROUP BY 1, 2"
)
BLOCKS["celltemp"] = (
    "SELECT x.cell AS temp_cell, c.week_end, avg(x.temp_mean) AS cell_temp_mean, min(x.temp_min) AS cell_temp_min, max(x.temp_max) AS cell_temp_max, "
    "avg(x.humidity) AS cell_humidity, count(x.temp_mean) AS cell_temp_valid_days FROM cells x JOIN cal c ON x.day BETWEEN c.week_end - 6 AND c.week_end "
    "WHERE x.layer = 'ERA5-LAND' GROUP BY 1, 2"
)
BLOCKS["gold"] = (
    "SELECT g.*, 'R' || CAST(g.place % 7 AS VARCHAR) AS rain_cell, 'T' || CAST(g.place % 5 AS VARCHAR) AS temp_cell, "
    "a.* EXCLUDE (rain_cell, week_end, cell_rain_valid_days), coalesce(a.cell_rain_valid_days, 0) AS cell_rain_valid_days, "
    "b.* EXCLUDE (temp_cell, week_end, cell_temp_valid_days), coalesce(b.cell_temp_valid_days, 0) AS cell_temp_valid_days, "
    + r("coalesce(a.cell_rain_valid_days, 0) / 7e0", 3)
    + " AS cell_coverage FROM wx g LEFT JOIN cellrain a ON a.rain_cell = 'R' || CAST(g.place % 7 AS VARCHAR) AND a.week_end = g.week_end "
    "LEFT JOIN celltemp b ON b.temp_cell = 'T' || CAST(g.place % 5 AS VARCHAR) AND b.week_end = g.week_end"
)
BLOCKS["series"] = (
    "SELECT s.*, CAST(p.city_population AS BIGINT) AS city_population, " + rate("s.cases", "p.city_population")
    + " AS rate FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY week_start) - 1 AS series_index FROM "
    "(SELECT kind, epi_year, epi_week, week_start, CAST(sum(cases) AS BIGINT) AS cases FROM grid GROUP BY ALL)) s "
    "LEFT JOIN (SELECT epi_year, CAST(sum(population) AS BIGINT) AS city_population FROM pop GROUP BY 1) p USING (epi_year)"
)


# Blocks that several others read are kept once instead of being inlined.
_SHARED = {"grid", "rates", "states", "thr", "feats", "onsets", "ranked", "wx", "gold", "eps", "alerts", "judged", "falses", "cal", "cells", "daily", "series", "near"}


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    blocks = {**BLOCKS, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, block in blocks.items():
            if re.search(rf"\b{name}\b", text) and name not in needed and block is not text:
                visit(block)
                if name not in needed:
                    needed.append(name)

    visit(body)
    shared = _SHARED | set(extra or {})
    parts = [f"{n} AS {'MATERIALIZED ' if n in shared else ''}({blocks[n].strip()})" for n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


# --- resampling -------------------------------------------------------------------------------


def drawn(source: str, unit: list[str], measures: str, draws: int = 2000, seed: int = 42) -> str:
    """Rows of (draw, weight, unit, measures): the units of a table with their Poisson counts from md5 sums."""
    from weekwatch.operators.bootstrap import poisson_steps

    key = " || '|' || ".join([f"'{seed}'", "CAST(draw AS VARCHAR)", *[f"coalesce(CAST({c} AS VARCHAR), '')" for c in unit]])
    return (
        f"SELECT * FROM (SELECT *, len(list_filter({poisson_steps()}, lambda t: t <= CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT))) AS weight "
        f"FROM (SELECT {', '.join(unit)}, {measures} FROM {source} GROUP BY ALL) u, (SELECT unnest(range({draws})) AS draw) d) WHERE weight > 0"
    )


def interval_of_mean(source: str, value: str, unit: list[str]) -> str:
    per = f"SELECT draw, sum(weight * total) / sum(weight * size) AS v FROM ({drawn(source, unit, f'count(*) AS size, CAST(sum({value}) AS DOUBLE) AS total')}) GROUP BY draw"
    return (
        f"SELECT (SELECT {r(f'avg({value})')} FROM {source}) AS observed, {r('quantile_cont(v, 0.025)')} AS low, {r('quantile_cont(v, 0.975)')} AS high, count(v) AS n_draws FROM ({per})"
    )


def interval_of_median(source: str, value: str, unit: list[str]) -> str:
    counts = f"SELECT draw, v, CAST(sum(weight * c) AS BIGINT) AS n FROM ({drawn(f'(SELECT * FROM {source} WHERE {value} IS NOT NULL)', unit, f'CAST({value} AS DOUBLE) AS v, count(*) AS c')}) GROUP BY draw, v"
    cum = f"SELECT *, sum(n) OVER (PARTITION BY draw ORDER BY v) AS upto, sum(n) OVER (PARTITION BY draw) AS total FROM ({counts})"
    per = f"SELECT draw, (min(v) FILTER (upto > (total - 1) // 2) + min(v) FILTER (upto > total // 2)) / 2 AS v FROM ({cum}) GROUP BY draw"
    return (
        f"SELECT (SELECT CAST(median({value}) AS DOUBLE) FROM {source}) AS observed, {r('quantile_cont(v, 0.025)')} AS low, {r('quantile_cont(v, 0.975)')} AS high, count(v) AS n_draws FROM ({per})"
    )
