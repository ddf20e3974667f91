"""Registered queries: forecast, star schema, measures, gates, freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekwatch.contracts import LAG_SENTENCE
from weekwatch.operators import association, forecasting as M, gates, rates, routing, star
from weekwatch.plans import climate, tables as T
from weekwatch.plans.registry import query
from weekwatch.plans.sqltext import r, rate, sql, week_one
from weekwatch.plans.weekly import _BT, backtest, rounded, with_rates
from weekwatch.session import cut_lineage

# the last complete year of the driver's tables, for the SQL; the Spark side reads it from the data
LAST_YEAR = 2000


def folds(spark, sf):
    """Three backtest folds before the last complete year."""
    last = T.last_complete_year(spark, sf)
    return (last - 3, last - 2, last - 1)


def series(spark, sf):
    """City series of the complete years; later weeks are not treated as observed."""
    s = rates.city_series(T.grid(spark, sf)).where(F.col("epi_year") <= T.last_complete_year(spark, sf))
    # one row per kind and week of the calendar; every method and fold reads it
    return cut_lineage(s.select("kind", "epi_year", "epi_week", "week_start", "series_index", "cases"))


def _fold_blocks(folds: str, targets: str, p: str = "") -> dict[str, str]:
    """The forecast blocks of some folds; `p` comes before the names of those that depend on them."""
    return {
        "ser": f"SELECT kind, epi_year, epi_week, week_start, series_index, cases FROM series WHERE epi_year <= {LAST_YEAR}",
        f"{p}trn": f"SELECT s.*, f AS fold FROM ser s, (SELECT unnest({folds}) AS f) WHERE epi_year <= f",
        f"{p}tgt": targets,
        f"{p}whole": f"SELECT kind, fold, avg(cases) AS mn, max(series_index) AS li, max(epi_year) AS ly, regr_slope(cases, series_index) AS sl, regr_intercept(cases, series_index) AS ic FROM {p}trn GROUP BY ALL",
        f"{p}weekly_": f"SELECT t.kind, t.fold, t.epi_week, max(cases) FILTER (epi_year = ly) AS nv, avg(cases) AS wm, avg(cases - (sl * series_index + ic)) AS rs FROM {p}trn t JOIN {p}whole USING (kind, fold) GROUP BY ALL",
        f"{p}fc0": f"SELECT t.*, w.mn, w.li, w.sl, w.ic, k.nv, k.wm, k.rs FROM {p}tgt t JOIN {p}whole w USING (kind, fold) LEFT JOIN {p}weekly_ k USING (kind, fold, epi_week)",
        f"{p}fc": " UNION ALL ".join(
            f"SELECT kind, fold, '{m}' AS method, epi_year, epi_week, week_start, step, actual, greatest({e}, 0e0) AS predicted FROM {p}fc0"
            for m, e in (("seasonal_naive", "coalesce(CAST(nv AS DOUBLE), mn)"), ("week_mean", "coalesce(wm, mn)"), ("trend_season", "sl * (li + step) + ic + coalesce(rs, 0)"))
        ),
        "btab0": "SELECT kind, fold, method, count(*) AS n_weeks, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse, arg_max({'st': step, 'w': epi_week, 'v': actual}, actual * 1e6 - step) AS o, arg_max({'st': step, 'w': epi_week, 'v': predicted}, round_even(predicted * 1e9, 0) * 1e3 - step) AS p FROM fc GROUP BY ALL",
        "btab": """SELECT b.kind, b.fold, b.method, b.fold + 1 AS target_year, b.n_weeks, b.mae, b.rmse, CASE WHEN n.mae > 0 THEN b.mae / n.mae END AS mase, b.o.w AS peak_week, b.p.w AS peak_week_predicted, b.p.st - b.o.st AS peak_shift, b.p.v - b.o.v AS peak_size_error
 FROM btab0 b JOIN btab0 n ON n.kind = b.kind AND n.fold = b.fold AND n.method = 'seasonal_naive'""",
        "msum": "SELECT kind, method, count(mase) AS n_folds, median(mase) AS mase_median, median(abs(peak_shift)) FILTER (mase IS NOT NULL) AS shift_median FROM btab GROUP BY ALL",
        "win": "SELECT kind, method FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round_even(mase_median * 1e9, 0), shift_median, list_position(['seasonal_naive', 'week_mean', 'trend_season'], method)) AS rn FROM msum WHERE mase_median IS NOT NULL) WHERE rn = 1",
    }


_BACK = _fold_blocks(
    "[1997, 1998, 1999]",
    "SELECT kind, epi_year - 1 AS fold, epi_year, epi_week, week_start, CAST(cases AS DOUBLE) AS actual, row_number() OVER (PARTITION BY kind, epi_year ORDER BY epi_week) AS step FROM ser WHERE epi_year - 1 IN (1997, 1998, 1999)",
)


@query("rule_forecasts", sql(f"SELECT kind, CAST(fold AS BIGINT) AS fold, method, epi_year, epi_week, step, actual, {r('predicted', 5)} AS predicted FROM fc", _BACK))
def rule_forecasts(spark, sf):
    f = M.all_forecasts(series(spark, sf), folds(spark, sf), with_holt_winters=False)
    return rounded(f.select("kind", "fold", "method", "epi_year", "epi_week", "step", "actual", "predicted"), predicted=5)


@query("holt_winters_forecasts")
def holt_winters_forecasts(spark, sf):
    s = series(spark, sf)
    return M.holt_winters_forecasts(M.in_folds(s, folds(spark, sf)), M.observed_targets(s, folds(spark, sf)))


@query("forecast_backtest", sql(f"""
SELECT kind, CAST(fold AS BIGINT) AS fold, method, CAST(target_year AS BIGINT) AS target_year, n_weeks, {r('mae', 5)} AS mae, {r('rmse', 5)} AS rmse, {r('mase', 5)} AS mase, peak_week, peak_week_predicted, peak_shift, {r('peak_size_error', 5)} AS peak_size_error FROM btab""", _BACK))
def forecast_backtest(spark, sf):
    b = M.backtest(M.all_forecasts(series(spark, sf), folds(spark, sf), with_holt_winters=False))
    return rounded(b, mae=5, rmse=5, mase=5, peak_size_error=5)


def series_mean(train, target):
    """A user's model: the mean of the training weeks, of which it asks for 200."""
    if len(train) < 200:
        raise ValueError(f"{len(train)} weeks are too few")
    return [train["cases"].mean()] * len(target)


@query("backtest_of_a_failing_model", sql(f"""
SELECT kind, CAST(fold AS BIGINT) AS fold, 'series_mean' AS method, CAST(fold + 1 AS BIGINT) AS target_year, CASE WHEN n >= 200 THEN n_weeks END AS n_weeks, CASE WHEN n >= 200 THEN {r('mae', 5)} END AS mae,
 CASE WHEN n < 200 THEN 'ValueError: ' || CAST(n AS VARCHAR) || ' weeks are too few' END AS reason
FROM (SELECT t.kind, t.fold, count(*) AS n_weeks, avg(abs(t.actual - w.mn)) AS mae FROM tgt t JOIN whole w USING (kind, fold) GROUP BY ALL) JOIN (SELECT kind, fold, count(*) AS n FROM trn GROUP BY ALL) USING (kind, fold)""", _BACK))
def backtest_of_a_failing_model(spark, sf):
    """A model that fails in the first folds leaves the figures of the others."""
    s, f = series(spark, sf), folds(spark, sf)
    out = cut_lineage(M.custom_forecasts(M.in_folds(s, f), M.observed_targets(s, f), "series_mean", series_mean))
    done = M.backtest(out).select("kind", "fold", "method", "target_year", "n_weeks", "mae")
    return rounded(done.unionByName(M.failed_folds(out), allowMissingColumns=True), mae=5)


@query("forecast_backtest_all_methods")
def forecast_backtest_all_methods(spark, sf):
    return M.backtest(M.all_forecasts(series(spark, sf), folds(spark, sf)))


_COV = {**_BACK, "errs": "SELECT kind, fold, method, actual - predicted AS err FROM fc",
"bnd": "SELECT a.kind, a.fold, a.method, quantile_cont(b.err, 0.1) AS l8, quantile_cont(b.err, 0.9) AS h8, quantile_cont(b.err, 0.025) AS l9, quantile_cont(b.err, 0.975) AS h9 FROM (SELECT DISTINCT kind, fold, method FROM errs) a JOIN errs b ON b.kind = a.kind AND b.method = a.method AND b.fold <> a.fold GROUP BY ALL"}


@query("band_coverage_left_out", sql(f"""
SELECT kind, CAST(fold AS BIGINT) AS fold, method, {r('avg(CAST(err BETWEEN l8 AND h8 AS INTEGER))', 4)} AS coverage_80, {r('avg(CAST(err BETWEEN l9 AND h9 AS INTEGER))', 4)} AS coverage_95 FROM errs JOIN bnd USING (kind, fold, method) GROUP BY ALL""", _COV))
def band_coverage_left_out(spark, sf):
    f = M.all_forecasts(series(spark, sf), folds(spark, sf), with_holt_winters=False)
    return rounded(M.coverage_left_out(f, folds(spark, sf)), coverage_80=4, coverage_95=4)


@query("forecast_method_summary", sql(f"SELECT kind, method, n_folds, {r('mase_median', 5)} AS mase_median, shift_median FROM msum", _BACK))
def forecast_method_summary(spark, sf):
    b = M.backtest(M.all_forecasts(series(spark, sf), folds(spark, sf), with_holt_winters=False))
    return rounded(M.method_summary(b), mase_median=5)


@query("forecast_method_choice", sql("SELECT * FROM win", _BACK))
def forecast_method_choice(spark, sf):
    return M.choose_method(M.method_summary(M.backtest(M.all_forecasts(series(spark, sf), folds(spark, sf), with_holt_winters=False))))


_NEXT = f"""SELECT kind, {LAST_YEAR} AS fold, {LAST_YEAR + 1} AS epi_year, w AS epi_week, CAST({week_one(str(LAST_YEAR + 1))} + CAST(7 * (w - 1) AS INTEGER) AS DATE) AS week_start, CAST(NULL AS DOUBLE) AS actual, w AS step
FROM kinds, (SELECT unnest(generate_series(1, ({week_one(str(LAST_YEAR + 2))} - {week_one(str(LAST_YEAR + 1))}) // 7)) AS w)"""
_FUT = {k: v for k, v in _fold_blocks(f"[{LAST_YEAR}]", _NEXT, "f").items() if k in ("ser", "ftrn", "ftgt", "fwhole", "fweekly_", "ffc0", "ffc")}
_PROJ = {**_BACK, **_FUT, "perr": "SELECT kind, quantile_cont(actual - predicted, 0.1) AS l8, quantile_cont(actual - predicted, 0.9) AS h8, quantile_cont(actual - predicted, 0.025) AS l9, quantile_cont(actual - predicted, 0.975) AS h9 FROM fc JOIN win USING (kind, method) GROUP BY kind",
"prj": f"""SELECT kind, method, CAST(epi_year AS BIGINT) AS epi_year, epi_week, week_start, CAST(round_even(predicted, 0) AS BIGINT) AS cases, CAST(round_even(greatest(0, predicted + l8), 0) AS BIGINT) AS low_80, CAST(round_even(predicted + h8, 0) AS BIGINT) AS high_80,
 CAST(round_even(greatest(0, predicted + l9), 0) AS BIGINT) AS low_95, CAST(round_even(predicted + h9, 0) AS BIGINT) AS high_95 FROM ffc JOIN win USING (kind, method) JOIN perr USING (kind)"""}


def projected(spark, sf):
    return M.projection(series(spark, sf), folds(spark, sf), with_holt_winters=False)


@query("year_projection", sql("SELECT * FROM prj", _PROJ))
def year_projection(spark, sf):
    return projected(spark, sf)


@query("year_projection_all_methods")
def year_projection_all_methods(spark, sf):
    return M.projection(series(spark, sf), folds(spark, sf))


@query("simulated_bands")
def simulated_bands(spark, sf):
    s = series(spark, sf)
    return M.simulated_bands(M.holt_winters(M.in_folds(s, (T.last_complete_year(spark, sf),))), 53, paths=1000)


_ART = "SELECT kind, epi_year, epi_week, week_start, true AS is_observed, cases, CAST(NULL AS BIGINT) AS low_80, CAST(NULL AS BIGINT) AS high_80, CAST(NULL AS BIGINT) AS low_95, CAST(NULL AS BIGINT) AS high_95 FROM ser UNION ALL SELECT kind, epi_year, epi_week, week_start, false, cases, low_80, high_80, low_95, high_95 FROM prj"


@query("observed_and_projected", sql(_ART, _PROJ))
def observed_and_projected(spark, sf):
    return M.observed_and_projected(series(spark, sf), projected(spark, sf))


@query("expected_peak", sql("SELECT kind, epi_week, cases, week_start FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY cases DESC, epi_week) AS rn FROM prj) WHERE rn = 1", _PROJ))
def expected_peak(spark, sf):
    return M.expected_peak(projected(spark, sf))


@query("comparable_mean", sql(f"SELECT kind, {r('avg(m)')} AS comparable_mean FROM prj LEFT JOIN (SELECT kind, epi_week, avg(cases) AS m FROM ser GROUP BY ALL) USING (kind, epi_week) GROUP BY 1", _PROJ))
def comparable_mean(spark, sf):
    return rounded(M.comparable_mean(series(spark, sf), projected(spark, sf)), comparable_mean=6)


@query("future_years", sql("SELECT DISTINCT epi_year FROM grid WHERE epi_year > 2000"))
def future_years(spark, sf):
    return routing.future_years(T.grid(spark, sf), 2000)


# --- star schema -------------------------------------------------------------------------------

@query("place_dimension", sql("SELECT place, place_name, region, area_km2, lat, lon FROM places"))
def place_dimension(spark, sf):
    return star.place_dimension(T.grid(spark, sf))


@query("week_dimension", sql("""
SELECT epi_year * 100 + epi_week AS week_id, epi_year, epi_week, week_start, CAST(week_start + 6 AS DATE) AS week_end FROM (SELECT epi_year, epi_week, week_start FROM cal UNION SELECT epi_year, epi_week, week_start FROM prj)""", _PROJ))
def week_dimension(spark, sf):
    return star.week_dimension(T.grid(spark, sf), projected(spark, sf))


@query("kind_dimension", sql("SELECT kind FROM kinds"))
def kind_dimension(spark, sf):
    return star.kind_dimension(T.grid(spark, sf))


_RT = ["rate_1w", "rate_4w", "rate_8w", "rate_12w", "rate_year"]


@query("weekly_fact", sql(f"SELECT epi_year * 100 + epi_week AS week_id, place, kind, cases, population, population_type, density, {', '.join(f'{r(c)} AS {c}' for c in _RT)} FROM rates"))
def weekly_fact(spark, sf):
    return rounded(star.weekly_fact(with_rates(spark, sf)), **{c: 6 for c in _RT})


_CF = ["station", "source", "station_km", "rain_week", "rain_day_mean", "rain_day_max", "rain_days", "valid_days_week", "completeness", "rain_7d", "rain_14d", "rain_21d", "rain_28d", "valid_days_7d", "valid_days_28d"]
_CG = ["rain_cell", "temp_cell", "cell_rain_1w", "cell_rain_2w", "cell_rain_3w", "cell_rain_4w", "cell_temp_mean", "cell_temp_min", "cell_temp_max", "cell_humidity", "cell_rain_valid_days", "cell_temp_valid_days", "cell_coverage"]
_CR = {"rain_day_mean", "cell_rain_1w", "cell_rain_2w", "cell_rain_3w", "cell_rain_4w", "cell_temp_mean", "cell_temp_min", "cell_temp_max", "cell_humidity"}


@query("climate_fact", sql("SELECT epi_year * 100 + epi_week AS week_id, place, " + ", ".join(f"{r(c)} AS {c}" if c in _CR else c for c in _CF + _CG) + " FROM gold WHERE kind = 'F'"))
def climate_fact(spark, sf):
    return rounded(star.climate_fact(climate.gold(spark, sf)), **{c: 6 for c in _CR})


_BF = ["rank", "priority_score", "cases_t", "cases_next_3w", "onset_in_3w", "weeks_to_onset"]


@query("backtest_fact", sql(f"SELECT epi_year * 100 + epi_week AS week_id, place, kind, rank, priority_score, cases_t, cases_next_3w, onset_h3 AS onset_in_3w, weeks_to_onset FROM bt", _BT))
def backtest_fact(spark, sf):
    return star.backtest_fact(backtest(spark, sf), _BF)


@query("projection_fact", sql(f"SELECT epi_year * 100 + epi_week AS week_id, * EXCLUDE (epi_year, epi_week, week_start) FROM ({_ART})", _PROJ))
def projection_fact(spark, sf):
    return star.projection_fact(M.observed_and_projected(series(spark, sf), projected(spark, sf)))


def lag_table(spark, sf):
    return association.raw_and_adjusted(climate.lag_pairs(spark, sf))


@query("climate_association_fact", sql("SELECT kind, target, variable, adjusted, lag, spearman, n, reliable FROM lagtab", climate._LAGS))
def climate_association_fact(spark, sf):
    return lag_table(spark, sf).drop("p_value")


@query("raw_against_adjusted_lags", sql("""
SELECT kind, target, variable, lag, max(spearman) FILTER (NOT adjusted) AS raw, max(spearman) FILTER (adjusted) AS adjusted, max(n) FILTER (NOT adjusted) AS n_raw, max(n) FILTER (adjusted) AS n_adjusted FROM lagtab GROUP BY 1, 2, 3, 4""", climate._LAGS))
def raw_against_adjusted_lags(spark, sf):
    return association.raw_against_adjusted(lag_table(spark, sf))


@query("strongest_lag", sql(f"""
SELECT kind, target, variable, lag, spearman, n, printf('{LAG_SENTENCE}', lag, CASE WHEN lag = 1 THEN 'semana' ELSE 'semanas' END, spearman, n) AS sentence
FROM (SELECT *, row_number() OVER (PARTITION BY kind, target, variable ORDER BY abs(spearman) DESC, lag) AS rn FROM lagtab WHERE NOT adjusted AND reliable AND spearman IS NOT NULL) WHERE rn = 1""", climate._LAGS))
def strongest_lag(spark, sf):
    return association.strongest_lag(association.lag_correlations(climate.lag_pairs(spark, sf)))


@query("star_checks", sql(" UNION ALL ".join(f"SELECT '{c}' AS \"check\", CAST(0 AS BIGINT) AS n" for c in (
    "dim_place unique", "dim_week unique", "dim_kind unique", "dim_place size", "weekly unique", "weekly place known", "weekly week_id known", "weekly kind known",
    "weekly cases not negative", "weekly no probability column", "climate unique", "climate place known", "climate week_id known", "climate no probability column"))))
def star_checks(spark, sf):
    g = with_rates(spark, sf)
    wx = climate.gold_station(spark, sf)
    return star.star_checks(
        star.place_dimension(g), star.week_dimension(g), star.kind_dimension(g),
        {"weekly": (star.weekly_fact(g), ["week_id", "place", "kind"]), "climate": (star.climate_fact(wx), ["week_id", "place"])}, 25,
    )


@query("fact_without_dimension", sql("SELECT DISTINCT place FROM grid WHERE place NOT IN (SELECT place FROM places WHERE region <> 4)"))
def fact_without_dimension(spark, sf):
    from weekwatch.operators.grid import orphans

    return orphans(T.grid(spark, sf), T.places(spark, sf).where(F.col("region") != 4), "place")


@query("weekly_measures", sql(f"""
SELECT week_id, cases, CAST(sum(cases) OVER (ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS cases_4w, lag(cases) OVER (ORDER BY week_start) AS cases_before, {r('(cases - lag(cases) OVER (ORDER BY week_start)) / nullif(lag(cases) OVER (ORDER BY week_start), 0)')} AS change
FROM (SELECT epi_year * 100 + epi_week AS week_id, week_start, CAST(sum(cases) AS BIGINT) AS cases FROM grid GROUP BY ALL)"""))
def weekly_measures(spark, sf):
    g = with_rates(spark, sf)
    return rounded(star.weekly_measures(star.weekly_fact(g), star.week_dimension(g)), change=6)


@query("place_measures", sql(f"""
SELECT * REPLACE ({r('rate', 5)} AS rate, {r('rate_4w', 5)} AS rate_4w), dense_rank() OVER (ORDER BY cases DESC) AS rank_cases, dense_rank() OVER (ORDER BY {r('rate', 9)} DESC) AS rank_rate FROM (
SELECT place, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(cases) FILTER ((SELECT max(week_start) FROM cal) - week_start < 28) AS BIGINT) AS cases_4w, {r('avg(population)')} AS population,
 CAST(sum(cases) FILTER (week_start = (SELECT max(week_start) FROM cal)) AS BIGINT) AS cases_last_week, (SELECT max(epi_year * 100 + epi_week) FROM cal) AS last_week,
 {rate('sum(cases)', 'avg(population)')} AS rate, {rate('sum(cases) FILTER ((SELECT max(week_start) FROM cal) - week_start < 28)', 'avg(population)')} AS rate_4w FROM rates GROUP BY place)"""))
def place_measures(spark, sf):
    g = with_rates(spark, sf)
    return rounded(star.place_measures(star.weekly_fact(g), star.week_dimension(g)), population=6, rate=5, rate_4w=5)


# --- gates and freshness --------------------------------------------------------------------------

@query("gate_findings", sql("""
SELECT * FROM (SELECT 'gold_casos_nao_negativos' AS gate, 'CRITICO' AS severity, count(*) FILTER (cases < 0) AS n FROM brk UNION ALL SELECT 'gold_casos_sem_nulo', 'CRITICO', count(*) FILTER (cases IS NULL) FROM brk
UNION ALL SELECT 'gold_semana_tem_7_dias', 'CRITICO', count(*) FILTER (week_end - week_start <> 6) FROM brk UNION ALL SELECT 'gold_integridade_territorio:sobrando', 'CRITICO', (SELECT count(*) FROM places WHERE region = 4)
UNION ALL SELECT 'gold_n_bairros', 'CRITICO', abs(count(DISTINCT place) - 24) FROM brk UNION ALL SELECT 'gold_colunas_obrigatorias', 'CRITICO', 1) WHERE n > 0""",
{"brk": "SELECT place, kind, epi_year, epi_week, week_start, CAST(week_end + CASE WHEN region = 1 THEN 1 ELSE 0 END AS DATE) AS week_end, CASE WHEN region = 2 AND cases > 1 THEN -1 WHEN region = 3 AND cases > 1 THEN NULL ELSE cases END AS cases FROM grid"}))
def gate_findings(spark, sf):
    g = T.grid(spark, sf)
    region, cases = F.col("region"), F.col("cases")
    broken = g.withColumns(
        {
            "week_end": F.when(region == 1, F.date_add("week_end", 1)).otherwise(F.col("week_end")),
            "cases": F.when((region == 2) & (cases > 1), F.lit(-1)).when((region == 3) & (cases > 1), F.lit(None)).otherwise(cases),
        }
    )
    land = T.places(spark, sf).where(region != 4).select("place")
    return gates.gate_findings(broken, land, 24, T.KINDS, required=["place", "population"])


@query("gate_findings_clean", sql("SELECT 'gold_integridade_territorio' AS gate, 'AVISO' AS severity, CAST(1 AS BIGINT) AS n FROM grid LIMIT 1"))
def gate_findings_clean(spark, sf):
    return gates.gate_findings(climate.gold(spark, sf), None, 25, T.KINDS)


_REF = "DATE '2001-10-15'"
_FR = {"fre": f"""
SELECT dataset, d AS newest_event, w AS newest_week, {_REF} - d AS lag_days, CAST(lim AS BIGINT) AS limit_days, CASE WHEN d IS NULL THEN 'DESCONHECIDO' WHEN {_REF} - d <= lim THEN 'ATUAL' ELSE 'ATRASADO' END AS status FROM (
 SELECT 'epidemiologia' AS dataset, 120 AS lim, max(week_end) AS d, max(printf('%d-%02d', epi_year, epi_week)) AS w FROM gold
 UNION ALL SELECT 'territorio', 1095, NULL, NULL UNION ALL SELECT 'clima_estacao', 30, max(week_end), max(printf('%d-%02d', epi_year, epi_week)) FROM gold WHERE valid_days_week > 0
 UNION ALL SELECT 'clima_grade', 30, max(week_end), max(printf('%d-%02d', epi_year, epi_week)) FROM gold WHERE cell_rain_valid_days > 0)"""}


def fresh(spark, sf):
    return gates.freshness(climate.gold(spark, sf), F.lit("2001-10-15").cast("date"))


@query("freshness", sql("SELECT * FROM fre", _FR))
def freshness(spark, sf):
    return fresh(spark, sf)


@query("current_period_gate", sql("""
SELECT lag_days // 7 <= 4 AS available, CASE WHEN lag_days // 7 > 4 THEN 'epidemiological_data_stale' END AS reason, lag_days // 7 AS weeks_behind, CAST(4 AS BIGINT) AS limit_weeks, newest_week FROM fre WHERE dataset = 'epidemiologia'""", _FR))
def current_period_gate(spark, sf):
    return gates.current_period(fresh(spark, sf))
