"""Registered queries: grid, rates, thresholds, features, episodes, alerts, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weekwatch.functions.numbers import round_even
from weekwatch.operators import bootstrap as B, episodes as E, explore, features as X, grid as G, priority as P, ranking as R, rates, threshold
from weekwatch.plans import tables as T
from weekwatch.plans.registry import query
from weekwatch.plans.sqltext import episode_block, interval_of_mean, onset_block, pct_change, r, rate, sql, state_block, trend, week_one
from weekwatch.session import cut_lineage

SCORES = {"history": "threshold_ratio", "growth": "growth", "recent": "recent_ratio"}


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Rounds the named columns half-even for comparison."""
    return df.withColumns({c: round_even(F.col(c), d) for c, d in digits.items()})


def with_rates(spark, sf):
    return rates.population_block(T.grid(spark, sf), T.population(spark, sf))


def with_states(spark, sf):
    return threshold.alert_state(with_rates(spark, sf))


def with_features(spark, sf):
    return X.case_features(with_states(spark, sf))


def raised_alerts(features: DataFrame) -> DataFrame:
    """Two rises in a row announce the next week."""
    c, a, b = F.col("cases_t"), F.col("lag_1"), F.col("lag_2")
    return features.where((c > a) & (a > b)).select("place", "kind", (F.col("week_index") + 1).alias("alert_index"))


def judged(spark, sf):
    f = with_features(spark, sf)
    eps = E.episodes(f)
    alerts = raised_alerts(f)
    return E.anticipation(alerts, eps), E.false_alerts(alerts, eps), alerts


def ranked(spark, sf):
    return R.weekly_rank(E.onset_targets(with_features(spark, sf)), "threshold_ratio")


# --- the slice --------------------------------------------------------------------------

@query(
    "top_places_latest_week",
    sql(f"""
SELECT kind, place, place_name, epi_year, epi_week, cases, {r('rate_4w')} AS rate_4w, position FROM (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY rate_4w DESC NULLS LAST, place) AS position
  FROM rates WHERE week_index = (SELECT max(week_index) FROM cal)) WHERE position <= 5"""),
)
def top_places_latest_week(spark, sf):
    g = with_rates(spark, sf)
    last = explore.latest_week(g)
    y, w = last.select("epi_year").scalar(), last.select("epi_week").scalar()
    now = g.where((F.col("epi_year") == y) & (F.col("epi_week") == w))
    top = R.weekly_rank(now, "rate_4w").where(F.col("position") <= 5)
    return rounded(top.select("kind", "place", "place_name", "epi_year", "epi_week", "cases", "rate_4w", "position"), rate_4w=6)


@query("case_counts", sql(f"""
SELECT place, kind, year(week_start + 3) AS epi_year, (week_start - {week_one('year(week_start + 3)')}) // 7 + 1 AS epi_week, cases FROM counts"""))
def case_counts(spark, sf):
    from weekwatch.functions import dates

    return T.case_counts(spark, sf).select(
        "place", "kind", dates.epi_year(F.col("week_start")).alias("epi_year"), dates.epi_week(F.col("week_start")).alias("epi_week"), "cases"
    )


@query("dense_grid", sql("SELECT place, place_name, region, kind, week_start, week_end, epi_year, epi_week, week_index, cases FROM grid"))
def dense_grid(spark, sf):
    return T.grid(spark, sf).select(
        "place", "place_name", "region", "kind", "week_start", "week_end", "epi_year", "epi_week", "week_index", "cases"
    )


@query("dense_grid_whole_years", sql(f"""
SELECT p.place, k.kind, year(w + 3) AS epi_year, (w - {week_one('year(w + 3)')}) // 7 + 1 AS epi_week, coalesce(c.cases, 0) AS cases
FROM (SELECT CAST(unnest(generate_series({week_one('year(lo + 3)')}, CAST({week_one('(year(hi + 3) + 1)')} - 7 AS DATE), INTERVAL 7 DAY)) AS DATE) AS w FROM wspan) x
CROSS JOIN places p CROSS JOIN kinds k LEFT JOIN counts c ON c.place = p.place AND c.kind = k.kind AND c.week_start = w"""))
def dense_grid_whole_years(spark, sf):
    return T.grid(spark, sf, whole_years=True).select("place", "kind", "epi_year", "epi_week", "cases")


@query("place_attributes_joined", sql("SELECT place, kind, epi_year, epi_week, cases, area_km2, region, lat, lon FROM grid"))
def place_attributes_joined(spark, sf):
    bare = T.grid(spark, sf).select("place", "kind", "epi_year", "epi_week", "cases")
    attrs = T.places(spark, sf).select("place", "area_km2", "region", "lat", "lon")
    return G.checked_join(bare, attrs, ["place"])


@query("global_week_index", sql("""
SELECT g.place, g.kind, g.epi_year, g.epi_week, c.i AS week_index FROM grid g JOIN
(SELECT epi_year, epi_week, row_number() OVER (ORDER BY week_start) - 1 AS i FROM cal) c USING (epi_year, epi_week)"""))
def global_week_index(spark, sf):
    return X.week_index(T.grid(spark, sf).drop("week_index")).select("place", "kind", "epi_year", "epi_week", "week_index")


@query("grid_conservation", sql("""
SELECT (SELECT count(*) FROM counts) AS rows_before, (SELECT count(*) FROM grid) AS rows_after,
 (SELECT CAST(sum(cases) AS BIGINT) FROM counts) AS total_before, (SELECT CAST(sum(cases) AS BIGINT) FROM grid) AS total_after,
 (SELECT sum(cases) FROM counts) = (SELECT sum(cases) FROM grid) AS conserved"""))
def grid_conservation(spark, sf):
    return G.conservation(T.case_counts(spark, sf), T.grid(spark, sf))


@query("rates_by_window", sql(f"""
SELECT place, kind, epi_year, epi_week, cases, population, population_type, density,
 {', '.join(f"{r(c)} AS {c}" for c in ('rate_1w', 'rate_4w', 'rate_8w', 'rate_12w', 'rate_year'))} FROM rates"""))
def rates_by_window(spark, sf):
    cols = ["rate_1w", "rate_4w", "rate_8w", "rate_12w", "rate_year"]
    return rounded(
        with_rates(spark, sf).select("place", "kind", "epi_year", "epi_week", "cases", "population", "population_type", "density", *cols),
        **{c: 6 for c in cols},
    )


@query("total_of_kinds", sql(f"""
SELECT 'TOTAL' AS kind, place, place_name, epi_year, epi_week, week_start, week_end, CAST(sum(cases) AS BIGINT) AS cases,
 max(population) AS population, max(population_type) AS population_type, {r(rate('sum(cases)', 'max(population)'))} AS rate_combined
FROM rates GROUP BY place, place_name, epi_year, epi_week, week_start, week_end"""))
def total_of_kinds(spark, sf):
    return rounded(rates.all_kinds(with_rates(spark, sf)), rate_combined=6)


@query("city_series", sql(f"SELECT kind, epi_year, epi_week, week_start, cases, series_index, city_population, {r('rate')} AS rate FROM series"))
def city_series(spark, sf):
    return rounded(rates.city_series(with_rates(spark, sf)), rate=6)


@query("moving_average", sql(f"""
SELECT kind, week_start, cases, {r('avg(cases) OVER (PARTITION BY kind ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)')} AS cases_ma4 FROM series"""))
def moving_average(spark, sf):
    s = rates.city_series(T.grid(spark, sf))
    return rounded(explore.moving_average(s, "cases").select("kind", "week_start", "cases", "cases_ma4"), cases_ma4=6)


# --- thresholds, features -------------------------------------------------------------------

_STATE = f"place, kind, epi_year, epi_week, cases, {r('threshold')} AS threshold, threshold_type, n_history, state, {r('week_mean')} AS week_mean, {r('week_std')} AS week_std, week_n"


def _state_out(df):
    return rounded(
        df.select("place", "kind", "epi_year", "epi_week", "cases", "threshold", "threshold_type", "n_history", "state", "week_mean", "week_std", "week_n"),
        threshold=6, week_mean=6, week_std=6,
    )


@query("alert_thresholds", sql(f"SELECT {_STATE} FROM states"))
def alert_thresholds(spark, sf):
    return _state_out(with_states(spark, sf))


_RATE_STATES = {
    "rthr": state_block("rates", "rate_1w"),
    "rstates": "SELECT *, CASE WHEN rate_1w > threshold THEN 1e0 WHEN threshold IS NOT NULL THEN 0e0 END AS state FROM rthr",
}


@query("rate_thresholds", sql(f"""
SELECT place, kind, epi_year, epi_week, {r('rate_1w')} AS rate_1w, {r('threshold', 4)} AS threshold_rate, threshold_type AS threshold_type_rate, state AS state_rate,
 {r('week_mean', 4)} AS week_mean_rate, {r('week_std', 4)} AS week_std_rate FROM rstates""", _RATE_STATES))
def rate_thresholds(spark, sf):
    s = threshold.alert_state(with_rates(spark, sf), "rate_1w", suffix="_rate")
    return rounded(
        s.select("place", "kind", "epi_year", "epi_week", "rate_1w", "threshold_rate", "threshold_type_rate", "state_rate", "week_mean_rate", "week_std_rate"),
        rate_1w=6, threshold_rate=4, week_mean_rate=4, week_std_rate=4,
    )


@query("experimental_target", sql("""
SELECT place, kind, week_index, CASE WHEN week_mean IS NOT NULL AND l2 IS NOT NULL THEN CASE WHEN cases > week_mean AND cases > l1 AND l1 > l2 THEN 1e0 ELSE 0e0 END END AS state_alt
FROM (SELECT *, lag(cases, 1) OVER w AS l1, lag(cases, 2) OVER w AS l2 FROM states WINDOW w AS (PARTITION BY place, kind ORDER BY week_index))"""))
def experimental_target(spark, sf):
    return threshold.experimental_state(with_states(spark, sf)).select("place", "kind", "week_index", "state_alt")


_FEAT = ["cases_t", "lag_1", "lag_2", "lag_3", "lag_4", "mean_2w", "mean_4w", "mean_8w", "sum_4w", "max_4w", "trend_1w", "state_t"]
_R6 = ["mean_2w", "mean_4w", "mean_8w"]


@query("lag_and_rolling_features", sql(
    "SELECT place, kind, week_index, " + ", ".join(f"{r(c)} AS {c}" if c in _R6 else c for c in _FEAT) + " FROM feats"))
def lag_and_rolling_features(spark, sf):
    return rounded(with_features(spark, sf).select("place", "kind", "week_index", *_FEAT), **{c: 6 for c in _R6})


_MOM = ["threshold_ratio", "z_score", "recent_ratio", "growth"]


@query("momentum_features", sql(
    "SELECT place, kind, week_index, delta_1w, delta_2w, acceleration, rising_weeks, " + ", ".join(f"{r(c)} AS {c}" for c in _MOM) + " FROM feats"))
def momentum_features(spark, sf):
    return rounded(
        with_features(spark, sf).select("place", "kind", "week_index", "delta_1w", "delta_2w", "acceleration", "rising_weeks", *_MOM),
        **{c: 6 for c in _MOM},
    )


@query("calendar_features", sql(f"""
SELECT place, kind, week_index, month, quarter, {r('week_sin')} AS week_sin, {r('week_cos')} AS week_cos, {r('ln(1 + population)')} AS log_population FROM feats"""))
def calendar_features(spark, sf):
    f = X.calendar_features(with_rates(spark, sf)).withColumn("log_population", F.log1p("population"))
    return rounded(f.select("place", "kind", "week_index", "month", "quarter", "week_sin", "week_cos", "log_population"), week_sin=6, week_cos=6, log_population=6)


def with_rate_features(spark, sf):
    both = threshold.alert_state(with_features(spark, sf), "rate_1w", suffix="_rate")
    return X.rate_features(both)


_RF = ["rate_t", "rate_lag_1", "rate_lag_4", "rate_delta", "rate_threshold_ratio", "rate_deviation"]


@query("rate_features", sql(f"""
SELECT place, kind, week_index, state AS rate_state_t, {r('rate_1w')} AS rate_t, {r('lag(rate_1w, 1) OVER w')} AS rate_lag_1, {r('lag(rate_1w, 4) OVER w')} AS rate_lag_4,
 {r('rate_1w - lag(rate_1w, 1) OVER w')} AS rate_delta, {r('rate_1w / (threshold + 1)')} AS rate_threshold_ratio, {r('(rate_1w - week_mean) / (week_std + 1)')} AS rate_deviation
FROM rstates WINDOW w AS (PARTITION BY place, kind ORDER BY week_index)""", _RATE_STATES))
def rate_features(spark, sf):
    s = X.rate_features(threshold.alert_state(with_rates(spark, sf), "rate_1w", suffix="_rate"))
    return rounded(s.select("place", "kind", "week_index", "rate_state_t", *_RF), **{c: 6 for c in _RF})


# --- episodes, targets, alerts ----------------------------------------------------------------

@query("episodes", sql("SELECT * FROM eps"))
def episodes(spark, sf):
    return E.episodes(with_states(spark, sf))


@query("rate_episodes", sql("SELECT * FROM reps", {**_RATE_STATES, "reps": episode_block("rstates", "state")}))
def rate_episodes(spark, sf):
    return E.episodes(threshold.alert_state(with_rates(spark, sf), "rate_1w", suffix="_rate"), "state_rate")


@query("onset_targets", sql("SELECT place, kind, week_index, onset, onset_h1, onset_h2, onset_h3 FROM onsets".replace(" onset,", " CAST(onset AS BIGINT) AS onset,")))
def onset_targets(spark, sf):
    return E.onset_targets(with_states(spark, sf)).select("place", "kind", "week_index", "onset", "onset_h1", "onset_h2", "onset_h3")


@query("rate_onset_targets", sql("SELECT place, kind, week_index, rate_onset_h1, rate_onset_h2, rate_onset_h3 FROM ronsets", {**_RATE_STATES, "ronsets": onset_block("rstates", "state", "rate_onset_h")}))
def rate_onset_targets(spark, sf):
    s = threshold.alert_state(with_rates(spark, sf), "rate_1w", suffix="_rate")
    return E.onset_targets(s, "state_rate", prefix="rate_onset_h").select("place", "kind", "week_index", "rate_onset_h1", "rate_onset_h2", "rate_onset_h3")


@query("state_target", sql("""
SELECT place, kind, week_index, lead(state, 2) OVER w AS target_state, lead(cases, 2) OVER w AS target_cases, week_index + 2 AS target_index
FROM states WINDOW w AS (PARTITION BY place, kind ORDER BY week_index)"""))
def state_target(spark, sf):
    return E.state_target(with_states(spark, sf), 2).select("place", "kind", "week_index", "target_state", "target_cases", "target_index")


@query("alert_anticipation", sql("SELECT place, kind, start_index, end_index, detected, verdict, lead_weeks, detection_index FROM judged"))
def alert_anticipation(spark, sf):
    return judged(spark, sf)[0].select("place", "kind", "start_index", "end_index", "detected", "verdict", "lead_weeks", "detection_index")


@query("false_alerts", sql("SELECT * FROM falses"))
def false_alerts(spark, sf):
    return judged(spark, sf)[1]


@query("anticipation_summary", sql(f"""
SELECT count(*) AS n_episodes, count(*) FILTER (detected) AS n_detected, count(*) FILTER (NOT detected) AS n_missed, {r('avg(CAST(detected AS INTEGER))')} AS detection_rate,
 count(*) FILTER (verdict = 'antecipado') AS n_early, count(*) FILTER (verdict = 'simultaneo') AS n_simultaneous, count(*) FILTER (verdict = 'tardio') AS n_late,
 {r('avg(lead_weeks)')} AS lead_mean, median(lead_weeks) AS lead_median, (SELECT count(*) FROM falses) AS n_false_alerts FROM judged"""))
def anticipation_summary(spark, sf):
    j, f, _ = judged(spark, sf)
    return rounded(E.anticipation_summary(j, f), detection_rate=6, lead_mean=6)


@query("anticipation_by_place", sql("""
SELECT place, count(*) AS n_episodes, count(*) FILTER (detected) AS n_detected, count(*) FILTER (NOT detected) AS n_missed, median(lead_weeks) AS lead_median,
 coalesce(max(n), 0) AS n_false FROM judged LEFT JOIN (SELECT place, count(*) AS n FROM falses GROUP BY 1) USING (place) GROUP BY place"""))
def anticipation_by_place(spark, sf):
    j, f, _ = judged(spark, sf)
    return E.anticipation_by_place(j, f)


@query("anticipation_by_year", sql(f"""
SELECT start_year, count(*) AS n_episodes, count(*) FILTER (detected) AS n_detected, {r('count(*) FILTER (detected) / count(*)')} AS detection_rate FROM judged GROUP BY 1"""))
def anticipation_by_year(spark, sf):
    return rounded(E.anticipation_by_year(judged(spark, sf)[0]), detection_rate=6)


@query("weekly_alert_load", sql(f"""
SELECT {r('avg(n)')} AS alerted_mean, median(n) AS alerted_median, max(n) AS alerted_max,
 (SELECT {r('avg(m)')} FROM (SELECT count(*) AS m FROM falses GROUP BY alert_index)) AS false_mean,
 (SELECT median(m) FROM (SELECT count(*) AS m FROM falses GROUP BY alert_index)) AS false_median,
 (SELECT count(DISTINCT alert_index) FROM falses) AS weeks_with_false FROM (SELECT count(*) AS n FROM alerts GROUP BY alert_index)"""))
def weekly_alert_load(spark, sf):
    _, f, a = judged(spark, sf)
    return rounded(E.weekly_load(a, f), alerted_mean=6, false_mean=6)


@query("false_alert_runs", sql(f"""
SELECT count(*) AS n_runs, {r('avg(n)')} AS mean_weeks, max(n) AS max_weeks FROM (SELECT count(*) AS n FROM
 (SELECT *, alert_index - row_number() OVER (PARTITION BY place, kind ORDER BY alert_index) AS run FROM falses) GROUP BY place, kind, run)"""))
def false_alert_runs(spark, sf):
    return rounded(E.false_runs(judged(spark, sf)[1]), mean_weeks=6)


@query("largest_episodes", sql("""
SELECT place, kind, start_index, total_cases FROM (SELECT *, row_number() OVER (ORDER BY total_cases DESC, place, kind, start_index) AS rn, count(*) OVER () AS n FROM eps)
WHERE rn <= greatest(1, ceil(n * 1e-1))"""))
def largest_episodes(spark, sf):
    return E.largest_episodes(E.episodes(with_states(spark, sf))).select("place", "kind", "start_index", "total_cases")


_OV = {**_RATE_STATES, "reps": episode_block("rstates", "state")}


@query("episode_overlap", sql(f"""
SELECT count(e.place) AS n_a, count(q.place) AS n_b, count(*) FILTER (e.place IS NOT NULL AND q.place IS NOT NULL) AS n_both,
 count(*) FILTER (q.place IS NULL) AS n_only_a, count(*) FILTER (e.place IS NULL) AS n_only_b, {r('count(*) FILTER (e.place IS NOT NULL AND q.place IS NOT NULL) / nullif(count(*), 0)')} AS jaccard
FROM eps e FULL JOIN reps q ON q.place = e.place AND q.kind = e.kind AND q.start_index = e.start_index""", _OV))
def episode_overlap(spark, sf):
    s = with_rates(spark, sf)
    a = E.episodes(threshold.alert_state(s))
    b = E.episodes(threshold.alert_state(s, "rate_1w", suffix="_rate"), "state_rate")
    return rounded(E.episode_overlap(a, b), jaccard=6)


@query("episode_overlap_by_region", sql("""
SELECT region, coalesce(a, 0) AS n_a, coalesce(b, 0) AS n_b FROM (SELECT region, count(*) AS a FROM eps JOIN places USING (place) GROUP BY 1)
FULL JOIN (SELECT region, count(*) AS b FROM reps JOIN places USING (place) GROUP BY 1) USING (region)""", _OV))
def episode_overlap_by_region(spark, sf):
    s = with_rates(spark, sf)
    regions = T.places(spark, sf).select("place", "region")
    a = E.episodes(threshold.alert_state(s)).join(regions, "place")
    b = E.episodes(threshold.alert_state(s, "rate_1w", suffix="_rate"), "state_rate").join(regions, "place")
    return E.overlap_by(a, b, "region")


# --- ranking -----------------------------------------------------------------------------------

@query("weekly_ranking", sql(f"SELECT kind, week_index, place, {r('threshold_ratio')} AS threshold_ratio, position FROM ranked"))
def weekly_ranking(spark, sf):
    return rounded(
        R.weekly_rank(with_features(spark, sf), "threshold_ratio").select("kind", "week_index", "place", "threshold_ratio", "position"),
        threshold_ratio=6,
    )


_BT = {"bt": f"""
SELECT *, row_number() OVER (PARTITION BY kind, week_index ORDER BY recent_ratio DESC NULLS LAST, place) AS rank,
 row_number() OVER (PARTITION BY kind, week_index ORDER BY threshold_ratio DESC NULLS LAST, place) AS rank_history_ratio,
 row_number() OVER (PARTITION BY kind, week_index ORDER BY growth DESC NULLS LAST, place) AS rank_growth,
 {r('100e0 * (row_number() OVER (PARTITION BY kind, week_index ORDER BY recent_ratio NULLS FIRST, place DESC) - 1) / greatest(count(*) OVER (PARTITION BY kind, week_index) - 1, 1)', 1)} AS priority_score,
 lead(cases, 1) OVER w + lead(cases, 2) OVER w + lead(cases, 3) OVER w AS cases_next_3w,
 CASE WHEN lead(entry, 1) OVER w = 1 THEN 1e0 WHEN lead(entry, 2) OVER w = 1 THEN 2e0 WHEN lead(entry, 3) OVER w = 1 THEN 3e0 END AS weeks_to_onset
FROM (SELECT *, CASE WHEN state_t = 1 AND lag(state_t) OVER v = 0 THEN 1 ELSE 0 END AS entry FROM onsets WINDOW v AS (PARTITION BY place, kind ORDER BY week_index))
WINDOW w AS (PARTITION BY place, kind ORDER BY week_index)"""}


def backtest(spark, sf):
    return R.backtest_rows(E.onset_targets(with_features(spark, sf)), "recent_ratio")


@query("priority_backtest", sql("""
SELECT place, kind, epi_year, epi_week, rank, priority_score, rank_history_ratio, rank_growth, cases_t, cases_next_3w, onset_h3 AS onset_in_3w, weeks_to_onset FROM bt""", _BT))
def priority_backtest(spark, sf):
    return backtest(spark, sf).select(
        "place", "kind", "epi_year", "epi_week", "rank", "priority_score", "rank_history_ratio", "rank_growth",
        "cases_t", "cases_next_3w", "onset_in_3w", "weeks_to_onset",
    )


@query("latest_priority", sql("""
SELECT epi_year AS reference_year, epi_week AS reference_week, CAST(3 AS BIGINT) AS forecast_horizon, place_name, place, kind, region, priority_score, rank,
 'weekwatch_v1' AS model_version, week_end AS data_cutoff FROM bt WHERE week_index = (SELECT max(week_index) FROM cal)""", _BT))
def latest_priority(spark, sf):
    return R.latest_week_slice(backtest(spark, sf), "weekwatch_v1")


@query("recall_at_k", sql(f"""
SELECT CAST(k AS BIGINT) AS k, {r('sum(h) / sum(n)')} AS recall_micro, {r('avg(h / n)')} AS recall_macro, CAST(sum(n) AS BIGINT) AS n_positive, count(*) AS n_weeks FROM
 (SELECT k, kind, week_index, count(*) FILTER (position <= k) AS h, count(*) AS n FROM ranked, (SELECT unnest([5, 10, 20]) AS k) WHERE onset_h3 = 1 GROUP BY ALL) GROUP BY k"""))
def recall_at_k(spark, sf):
    return rounded(R.recall_at_k(ranked(spark, sf), "onset_h3"), recall_micro=6, recall_macro=6)


@query("precision_at_k", sql(f"""
SELECT CAST(k AS BIGINT) AS k, {r('avg(p)')} AS precision_mean, {r('median(p)')} AS precision_median, count(*) AS n_weeks FROM
 (SELECT k, kind, week_index, avg(onset_h3) AS p FROM ranked, (SELECT unnest([5, 10, 15, 20]) AS k) WHERE position <= k GROUP BY ALL) GROUP BY k"""))
def precision_at_k(spark, sf):
    return rounded(R.precision_at_k(ranked(spark, sf), "onset_h3"), precision_mean=6, precision_median=6)


_BEST = {"best": """
SELECT e.place, e.kind, e.start_index, e.start_year, b.position AS best_position, e.start_index - b.week_index AS lead_weeks, s.position AS position_at_start FROM eps e
LEFT JOIN (SELECT e.place, e.kind, e.start_index, x.position, x.week_index, row_number() OVER (PARTITION BY e.place, e.kind, e.start_index ORDER BY x.position, x.week_index) AS rn
  FROM eps e JOIN ranked x ON x.place = e.place AND x.kind = e.kind AND x.week_index BETWEEN e.start_index - 4 AND e.start_index - 1) b
  ON b.place = e.place AND b.kind = e.kind AND b.start_index = e.start_index AND b.rn = 1
LEFT JOIN ranked s ON s.place = e.place AND s.kind = e.kind AND s.week_index = e.start_index"""}


@query("best_rank_before_episode", sql("SELECT * FROM best", _BEST))
def best_rank_before_episode(spark, sf):
    x = ranked(spark, sf)
    return R.best_before_start(x, E.episodes(x))


@query("rank_before_episode_summary", sql(f"""
SELECT count(*) AS n_episodes, count(best_position) AS n_ranked_before, {r('avg(best_position)')} AS position_mean, median(best_position) AS position_median, {r('avg(lead_weeks)')} AS lead_mean,
 {', '.join(f"{r(f'avg(CAST(best_position <= {k} AS INTEGER)) * 100')} AS pct_top_{k}" for k in (5, 10, 20))} FROM best""", _BEST))
def rank_before_episode_summary(spark, sf):
    x = ranked(spark, sf)
    s = R.position_summary(R.best_before_start(x, E.episodes(x)))
    return rounded(s, position_mean=6, lead_mean=6, pct_top_5=6, pct_top_10=6, pct_top_20=6)


@query("unbroken_top_k", sql("""
SELECT e.place, e.kind, e.start_index, e.start_year, CAST(coalesce(min(CASE WHEN coalesce(x.position > 10, true) THEN b END) - 1, 4) AS BIGINT) AS weeks_in_top
FROM eps e CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS b) LEFT JOIN ranked x ON x.place = e.place AND x.kind = e.kind AND x.week_index = e.start_index - b GROUP BY ALL"""))
def unbroken_top_k(spark, sf):
    x = ranked(spark, sf)
    return R.unbroken_top_k(x, E.episodes(x))


@query("active_before_episode", sql("""
SELECT e.place, e.kind, e.start_index, coalesce(s.state = 1, false) AS active_before FROM eps e LEFT JOIN states s ON s.place = e.place AND s.kind = e.kind AND s.week_index = e.start_index - 4"""))
def active_before_episode(spark, sf):
    s = with_states(spark, sf)
    return R.active_before(s, E.episodes(s)).select("place", "kind", "start_index", "active_before")


_JAC = {"jac": """
SELECT a.kind, a.week_index, coalesce(m, 0) / CAST(a.n + b.n - coalesce(m, 0) AS DOUBLE) AS jaccard, coalesce(m, 0) AS n_kept, CAST(10 AS BIGINT) AS k
FROM (SELECT kind, week_index, count(*) AS n FROM ranked WHERE position <= 10 GROUP BY ALL) a
JOIN (SELECT kind, week_index, count(*) AS n FROM ranked WHERE position <= 10 GROUP BY ALL) b ON b.kind = a.kind AND b.week_index = a.week_index + 1
LEFT JOIN (SELECT x.kind, x.week_index, count(*) AS m FROM ranked x JOIN ranked y ON y.kind = x.kind AND y.place = x.place AND y.week_index = x.week_index + 1
  WHERE x.position <= 10 AND y.position <= 10 GROUP BY ALL) c ON c.kind = a.kind AND c.week_index = a.week_index"""}


@query("top_k_jaccard", sql(f"SELECT kind, week_index, {r('jaccard')} AS jaccard, n_kept, k FROM jac", _JAC))
def top_k_jaccard(spark, sf):
    return rounded(R.top_k_jaccard(ranked(spark, sf)), jaccard=6)


@query("ranking_stability", sql(f"SELECT k, count(*) AS n_pairs, {r('avg(jaccard)')} AS jaccard_mean, {r('median(jaccard)')} AS jaccard_median FROM jac GROUP BY k", _JAC))
def ranking_stability(spark, sf):
    return rounded(R.stability(R.top_k_jaccard(ranked(spark, sf))), jaccard_mean=6, jaccard_median=6)


@query("operating_load", sql(f"""
SELECT CAST(k AS BIGINT) AS k, count(DISTINCT (kind, week_index)) AS n_weeks, count(*) AS n_listed, {r('count(*) / count(DISTINCT (kind, week_index))')} AS listed_per_week,
 count(*) FILTER (onset_h3 = 1) AS with_episode, count(*) FILTER (onset_h3 = 0) AS without_episode, count(*) FILTER (onset_h3 IS NULL) AS undefined_outcome,
 {r('count(*) FILTER (onset_h3 = 0) * 100e0 / nullif(count(onset_h3), 0)')} AS pct_without_episode
FROM ranked, (SELECT unnest([5, 10, 15, 20]) AS k) WHERE position <= k GROUP BY k"""))
def operating_load(spark, sf):
    return rounded(R.operating_load(ranked(spark, sf)), listed_per_week=6, pct_without_episode=6)


@query("decision_week_outcome", sql("""
SELECT kind, count(*) FILTER (position <= 10 AND onset_h3 = 1) AS hits, count(*) FILTER (position <= 10 AND onset_h3 <> 1) AS false_alerts, count(*) FILTER (position > 10 AND onset_h3 = 1) AS missed
FROM ranked WHERE epi_year = 2000 AND epi_week = 20 GROUP BY kind"""))
def decision_week_outcome(spark, sf):
    return R.week_outcome(ranked(spark, sf), 2000, 20, 10)


def master(spark, sf):
    f = with_features(spark, sf)
    return R.episode_master(f, E.episodes(f), f, T.places(spark, sf), SCORES)


def _master_sql() -> dict[str, str]:
    parts = []
    for m, c in SCORES.items():
        parts.append(
            f"SELECT '{m}' AS method, place, kind, week_index, row_number() OVER (PARTITION BY kind, week_index ORDER BY CAST({c} AS DOUBLE) DESC NULLS LAST, place) AS position FROM feats"
        )
    out = {"mranked": " UNION ALL ".join(parts)}
    out["mbest"] = """
SELECT e.place, e.kind, e.start_index, x.method, x.position, x.week_index,
 row_number() OVER (PARTITION BY e.place, e.kind, e.start_index, x.method ORDER BY x.position, x.week_index) AS rn
FROM eps e JOIN mranked x ON x.place = e.place AND x.kind = e.kind AND x.week_index BETWEEN e.start_index - 4 AND e.start_index - 1"""
    cols = []
    for m in SCORES:
        cols.append(f"max(b.position) FILTER (b.method = '{m}') AS {m}_best_position")
        cols.append(f"max(e.start_index - b.week_index) FILTER (b.method = '{m}') AS {m}_lead_weeks")
        cols += [f"CAST(coalesce(max(CAST(b.position <= {k} AS INTEGER)) FILTER (b.method = '{m}'), 0) AS BIGINT) AS {m}_hit_{k}" for k in (5, 10, 15, 20)]
    out["master"] = f"""
SELECT e.place, e.kind, e.start_index, e.start_year, e.total_cases, p.region, coalesce(s.state = 1, false) AS active_before, {', '.join(cols)}
FROM eps e JOIN places p ON p.place = e.place LEFT JOIN states s ON s.place = e.place AND s.kind = e.kind AND s.week_index = e.start_index - 4
LEFT JOIN mbest b ON b.place = e.place AND b.kind = e.kind AND b.start_index = e.start_index AND b.rn = 1
GROUP BY e.place, e.kind, e.start_index, e.start_year, e.total_cases, p.region, s.state"""
    return out


_MASTER = _master_sql()


@query("episode_master", sql("SELECT * EXCLUDE (total_cases) FROM master", _MASTER))
def episode_master(spark, sf):
    return master(spark, sf)


@query("recall_by_region", sql(f"SELECT region, count(*) AS n_episodes, {r('avg(history_hit_10)')} AS history_hit_10, {r('avg(growth_hit_10)')} AS growth_hit_10 FROM master GROUP BY 1", _MASTER))
def recall_by_region(spark, sf):
    return rounded(R.recall_by_group(master(spark, sf), "region", ["history_hit_10", "growth_hit_10"]), history_hit_10=6, growth_hit_10=6)


@query("leave_one_year_out", sql(f"""
SELECT y AS left_out, count(*) AS n_episodes, {r('avg(history_hit_10)')} AS recall_model, {r('avg(growth_hit_10)')} AS recall_baseline
FROM (SELECT DISTINCT start_year AS y FROM master) JOIN master ON start_year <> y GROUP BY y""", _MASTER))
def leave_one_year_out(spark, sf):
    return rounded(R.leave_one_out(master(spark, sf), "start_year", "history_hit_10", "growth_hit_10"), recall_model=6, recall_baseline=6)


@query("best_baseline_per_k", sql("""
SELECT CAST(k AS BIGINT) AS k, baseline, """ + r("recall") + """ AS recall FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY recall DESC, baseline DESC) AS rn FROM ("""
    + " UNION ALL ".join(f"SELECT {k} AS k, '{b}' AS baseline, avg({b}_hit_{k}) AS recall FROM master" for k in (5, 10, 15, 20) for b in ("growth", "recent"))
    + ")) WHERE rn = 1", _MASTER))
def best_baseline_per_k(spark, sf):
    return rounded(R.best_baseline(master(spark, sf), ["growth", "recent"]), recall=6)


@query("episode_slices", sql(f"""
SELECT slice, count(*) AS n_episodes, {r('avg(history_hit_10)')} AS recall, quantile_cont(history_lead_weeks, 0.25) AS lead_p25, median(history_lead_weeks) AS lead_median, quantile_cont(history_lead_weeks, 0.75) AS lead_p75
FROM (SELECT 'all' AS slice, * FROM master UNION ALL SELECT 'large', * FROM master WHERE total_cases >= (SELECT quantile_cont(total_cases, 0.9) FROM eps)
 UNION ALL SELECT CASE WHEN active_before THEN 'relapse' ELSE 'new' END, * FROM master) GROUP BY slice""", _MASTER))
def episode_slices(spark, sf):
    f = with_features(spark, sf)
    eps = E.episodes(f)
    m = R.episode_master(f, eps, f, T.places(spark, sf), SCORES)
    return rounded(R.episode_slices(m, eps, "history_hit_10", "history_lead_weeks"), recall=6)


@query("critical_places", sql("SELECT place, count(*) AS n_episodes, CAST(sum(1 - history_hit_10) AS BIGINT) AS n_missed FROM master GROUP BY 1 ORDER BY n_missed DESC, place LIMIT 10", _MASTER))
def critical_places(spark, sf):
    return R.critical_places(master(spark, sf), "history_hit_10")


def _evidence_sql() -> str:
    ks = (5, 10, 15, 20)
    hits = [f"avg(history_hit_{k}) AS history_hit_{k}" for k in ks]
    long = lambda section, key, src, cols: " UNION ALL ".join(
        f"SELECT 'weekwatch_v1' AS candidate, '{section}' AS section, CAST({key} AS VARCHAR) AS key, '{c}' AS metric, {r(f'CAST({c} AS DOUBLE)')} AS value FROM ({src})" for c in cols
    )
    hit_names = [f"history_hit_{k}" for k in ks]
    parts = [long(f"by_{n}", c, f"SELECT {c}, {', '.join(hits)} FROM master GROUP BY 1", hit_names) for n, c in (("year", "start_year"), ("region", "region"), ("place", "place"))]
    ends = ["observed", "low", "high"]
    parts.append(long("intervals", "k", " UNION ALL ".join(f"SELECT {k} AS k, * FROM ({interval_of_mean('master', f'history_hit_{k}', ['place'])})" for k in ks), ends))
    parts.append(long("differences", "k", " UNION ALL ".join(f"SELECT {k} AS k, * FROM ({interval_of_mean('master', f'(history_hit_{k} - growth_hit_{k})', ['place'])})" for k in ks), ends))
    parts.append(long("leave_one_year_out", "y", "SELECT y, avg(history_hit_10) AS recall_model, avg(growth_hit_10) AS recall_baseline FROM (SELECT DISTINCT start_year AS y FROM master) JOIN master ON start_year <> y GROUP BY y", ["recall_model", "recall_baseline"]))
    return " UNION ALL ".join(parts)


def evidence(spark, sf) -> dict:
    """The sections of the bundle that come from the episode master."""
    m = cut_lineage(master(spark, sf))
    ks = (5, 10, 15, 20)
    hits, ends = [f"history_hit_{k}" for k in ks], ["observed", "low", "high"]

    def each(interval):
        out = None
        for k in ks:
            one = interval(k).withColumn("k", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return out

    return {
        "by_year": (R.recall_by_group(m, "start_year", hits), "start_year", hits),
        "by_region": (R.recall_by_group(m, "region", hits), "region", hits),
        "by_place": (R.recall_by_group(m, "place", hits), "place", hits),
        "intervals": (each(lambda k: B.mean_interval(m, F.col(f"history_hit_{k}"), ["place"])), "k", ends),
        "differences": (each(lambda k: B.difference_interval(m, F.col(f"history_hit_{k}"), F.col(f"growth_hit_{k}"), ["place"])), "k", ends),
        "leave_one_year_out": (R.leave_one_out(m, "start_year", "history_hit_10", "growth_hit_10"), "left_out", ["recall_model", "recall_baseline"]),
    }


@query("evidence_bundle")
def evidence_bundle(spark, sf):
    x = ranked(spark, sf)
    more = {
        "recall": (R.recall_at_k(x, "onset_h3"), "k", ["recall_micro", "recall_macro"]),
        "load": (R.operating_load(x), "k", ["n_listed", "pct_without_episode"]),
    }
    return rounded(R.evidence_bundle(more | evidence(spark, sf), "weekwatch_v1"), value=6)


@query("evidence_of_episodes", sql(_evidence_sql(), _MASTER))
def evidence_of_episodes(spark, sf):
    """The bundle's sections from the episode master: groups, intervals, paired differences, years left out."""
    return rounded(R.evidence_bundle(evidence(spark, sf), "weekwatch_v1"), value=6)


# --- observed priority ------------------------------------------------------------------------

_PRI = {"ref": "SELECT epi_year AS y, epi_week AS w, week_index AS i FROM cal WHERE week_index = (SELECT max(week_index) FROM cal)",
"pri0": f"""
SELECT place, place_name, region, kind, CAST(sum(cases) FILTER (week_index = i) AS BIGINT) AS cases_week, CAST(sum(cases) FILTER (week_index BETWEEN i - 3 AND i) AS BIGINT) AS cases_recent,
 CAST(sum(cases) FILTER (week_index BETWEEN i - 7 AND i - 4) AS BIGINT) AS cases_before,
 avg(cases) FILTER (epi_year < y AND epi_week BETWEEN greatest(1, w - 2) AND least(53, w + 2)) AS season_mean,
 count(*) FILTER (epi_year < y AND epi_week BETWEEN greatest(1, w - 2) AND least(53, w + 2)) AS season_n,
 max(population) FILTER (week_index = i) AS population, max(population_type) FILTER (week_index = i) AS population_type, max(density) FILTER (week_index = i) AS density
FROM rates, ref GROUP BY 1, 2, 3, 4""",
"pri": f"""
SELECT *, {rate('cases_week', 'population')} AS rate_week, {rate('cases_recent', 'population')} AS rate_recent, {pct_change('cases_recent', 'cases_before')} AS change_pct,
 {r('cases_recent / (coalesce(season_mean, 0) * 4 + 1e0)', 2)} AS history_ratio, {trend(pct_change('cases_recent', 'cases_before'))} AS trend FROM pri0"""}


@query("observed_priority", sql(f"SELECT * REPLACE ({r('season_mean')} AS season_mean, {r('rate_week')} AS rate_week, {r('rate_recent')} AS rate_recent) FROM pri", _PRI))
def observed_priority(spark, sf):
    return rounded(P.observed_priority(with_rates(spark, sf)), season_mean=6, rate_week=6, rate_recent=6)


@query("situation_kpis", sql(f"""
SELECT kind, cases_week, cases_recent, cases_before, places_with_case, places_rising, places_above_history, n_places, change_pct, {r('rate_recent')} AS rate_recent, {trend('change_pct')} AS trend FROM (
SELECT kind, CAST(sum(cases_week) AS BIGINT) AS cases_week, CAST(sum(cases_recent) AS BIGINT) AS cases_recent, CAST(sum(cases_before) AS BIGINT) AS cases_before,
 count(*) FILTER (cases_week > 0) AS places_with_case, count(*) FILTER (trend = 'em alta') AS places_rising, count(*) FILTER (history_ratio > 1) AS places_above_history, count(*) AS n_places,
 CASE WHEN sum(cases_before) > 0 THEN {r('100e0 * (sum(cases_recent) - sum(cases_before)) / sum(cases_before)', 1)} END AS change_pct,
 {rate('sum(cases_recent)', 'sum(population)')} AS rate_recent FROM pri GROUP BY kind)""", _PRI))
def situation_kpis(spark, sf):
    return rounded(P.situation(P.observed_priority(with_rates(spark, sf))), rate_recent=6)


@query("observed_rankings", sql(" UNION ALL ".join(
    f"SELECT place, kind, '{n}' AS ranking, {r(f'CAST({c} AS DOUBLE)')} AS value, row_number() OVER (PARTITION BY kind ORDER BY CAST({c} AS DOUBLE) DESC NULLS LAST, place) AS position FROM pri"
    for n, c in P.RANKINGS.items()), _PRI))
def observed_rankings(spark, sf):
    return rounded(P.observed_rankings(P.observed_priority(with_rates(spark, sf))), value=6)
