"""Registered queries: data sets, models, intervals, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weekwatch.operators import bootstrap as B, episodes as E, evaluation as V, features as X, learning as L, ranking as R, threshold
from weekwatch.plans.climate import cell_gold
from weekwatch.plans.registry import query
from weekwatch.plans.sqltext import interval_of_mean, interval_of_median, onset_block, r, sql, sunday
from weekwatch.plans.weekly import _MASTER, _RATE_STATES, master, rounded, with_features, with_rates, with_states
from weekwatch.session import checkpoint_dir, cut_lineage
from weekwatch.streaming import readings as SR, weekly as SW

KEY = ["place", "kind", "week_index"]
NAMES = X.feature_names()


def _nn(cols) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


_SQLNAMES = [c for c in NAMES]
_FULL = {"lab": "SELECT *, lead(state, 1) OVER w AS target_state FROM onsets WINDOW w AS (PARTITION BY place, kind ORDER BY week_index)"}


def _metrics_sql(target: str, src: str) -> str:
    full = f"{target} IS NOT NULL AND {_nn(_SQLNAMES)}"
    return f"""SELECT count(*) AS rows_before, count(*) FILTER ({target} IS NULL) AS target_undefined, count(*) FILTER ({target} IS NOT NULL AND NOT ({_nn(_SQLNAMES)})) AS feature_null, count(*) FILTER ({full}) AS rows_final,
 count(*) FILTER ({full} AND {target} = 1) AS n_positive, count(*) FILTER ({full} AND {target} = 0) AS n_negative FROM {src}"""


@query("state_dataset_metrics", sql(_metrics_sql("target_state", "lab"), _FULL))
def state_dataset_metrics(spark, sf):
    return L.dataset_metrics(E.state_target(with_features(spark, sf), 1), "target_state", NAMES)


@query("onset_dataset_metrics", sql(_metrics_sql("onset_h3", "onsets")))
def onset_dataset_metrics(spark, sf):
    return L.dataset_metrics(E.onset_targets(with_features(spark, sf)), "onset_h3", NAMES)


_XR = ["mean_2w", "mean_4w", "mean_8w", "week_sin", "week_cos", "week_mean", "threshold_ratio", "z_score", "recent_ratio", "growth", "lat", "lon", "area_km2"]


@query("onset_dataset", sql("SELECT place, kind, week_index, CAST(onset_h3 AS BIGINT) AS label, " + ", ".join(f"{r(c)} AS {c}" if c in _XR else c for c in _SQLNAMES) + f" FROM onsets WHERE onset_h3 IS NOT NULL AND {_nn(_SQLNAMES)}"))
def onset_dataset(spark, sf):
    d, names = L.onset_dataset(with_states(spark, sf))
    return rounded(d.select(*KEY, "label", *names), **{c: 6 for c in _XR})


@query("state_dataset", sql(f"SELECT place, kind, week_index, CAST(target_state AS BIGINT) AS label, rising_weeks, max_4w FROM lab WHERE target_state IS NOT NULL AND {_nn(_SQLNAMES)}", _FULL))
def state_dataset(spark, sf):
    d, _ = L.state_dataset(with_states(spark, sf))
    return d.select(*KEY, "label", "rising_weeks", "max_4w")


_RATED = {
    **_RATE_STATES,
    "rons": onset_block("rstates", "state", "rate_onset_h"),
    "rfull": """SELECT f.*, o.rate_onset_h3, o.rate_1w AS rate_t, lag(o.rate_1w, 1) OVER w AS rate_lag_1, lag(o.rate_1w, 2) OVER w AS rate_lag_2, lag(o.rate_1w, 3) OVER w AS rate_lag_3, lag(o.rate_1w, 4) OVER w AS rate_lag_4,
 o.rate_1w - lag(o.rate_1w, 1) OVER w AS rate_delta, o.state AS rate_state_t, o.week_mean AS week_mean_rate, ln(1 + f.population) AS log_population, o.rate_1w / (o.threshold + 1) AS rate_threshold_ratio, (o.rate_1w - o.week_mean) / (o.week_std + 1) AS rate_deviation
 FROM feats f JOIN rons o USING (place, kind, week_index) WINDOW w AS (PARTITION BY f.place, f.kind ORDER BY week_index)""",
}
_RR = [*_XR, "rate_t", "rate_lag_1", "rate_lag_2", "rate_lag_3", "rate_lag_4", "rate_4w", "rate_8w", "rate_delta", "rate_threshold_ratio", "rate_deviation", "week_mean_rate", "log_population", "density"]
_RKEY = "place, kind, week_index, CAST(rate_onset_h3 AS BIGINT) AS label, "


def _composition_sql(variant: str) -> str:
    names = X.variant_names(variant)
    return sql(f"SELECT {_RKEY}" + ", ".join(f"{r(c, 5)} AS {c}" if c in _RR else c for c in names) + f" FROM rfull WHERE rate_onset_h3 IS NOT NULL AND {_nn(names)}", _RATED)


def composition(spark, sf, variant):
    d, names = L.rate_onset_dataset(with_rates(spark, sf), variant=variant)
    return rounded(d.select(*KEY, "label", *names), **{c: 5 for c in _RR if c in names})


@query("rate_onset_dataset", _composition_sql("v2_casos_incidencia"))
def rate_onset_dataset(spark, sf):
    return composition(spark, sf, "v2_casos_incidencia")


@query("rate_onset_cases_only", _composition_sql("v1_features"))
def rate_onset_cases_only(spark, sf):
    return composition(spark, sf, "v1_features")


@query("rate_onset_cases_population", _composition_sql("v1_mais_populacao"))
def rate_onset_cases_population(spark, sf):
    return composition(spark, sf, "v1_mais_populacao")


@query("rate_onset_rates_only", _composition_sql("v2_incidencia"))
def rate_onset_rates_only(spark, sf):
    return composition(spark, sf, "v2_incidencia")


@query("rate_onset_cases_rates_population", _composition_sql("v2_casos_incidencia_populacao"))
def rate_onset_cases_rates_population(spark, sf):
    return composition(spark, sf, "v2_casos_incidencia_populacao")


def small_set(spark, sf):
    return cut_lineage(L.onset_dataset(with_states(spark, sf))[0].select(*KEY, "epi_year", "epi_week", "label", *[n for n in NAMES if n != "epi_week"]))


def split(df):
    role = V.temporal_split(F.col("epi_year"), 1998, 1999)
    return [df.where(role == r_) for r_ in ("treino", "validacao", "teste")]


@query("logistic_regression_scores")
def logistic_regression_scores(spark, sf):
    train, _, test = split(small_set(spark, sf))
    return L.predict(L.fit_logistic(train, NAMES), test, NAMES).select(*KEY, "label", "probability")


@query("boosted_tree_scores")
def boosted_tree_scores(spark, sf):
    train, _, test = split(small_set(spark, sf))
    return L.predict(L.fit_trees(train, NAMES), test, NAMES).select(*KEY, "label", "probability")


@query("calibrated_brier")
def calibrated_brier(spark, sf):
    train, val, test = split(small_set(spark, sf))
    model = L.fit_logistic(train, NAMES)
    # the curve is fitted and judged on scores as rows, without the model in their plan
    val, test = [cut_lineage(L.predict(model, rows, NAMES).select("label", "probability")) for rows in (val, test)]
    fixed = cut_lineage(L.calibrate(val, method="isotonic")(test))
    before = V.brier(fixed, "probability", "label").withColumn("stage", F.lit("before"))
    return before.unionByName(V.brier(fixed, "calibrated", "label").withColumn("stage", F.lit("after")))


@query("permutation_importance")
def permutation_importance(spark, sf):
    train, _, test = split(small_set(spark, sf))
    return L.permutation_importance(L.fit_logistic(train, NAMES), test, NAMES, KEY)


@query("importance_stability")
def importance_stability(spark, sf):
    """Every fold's model and the loss of average precision on its own test year."""
    data = small_set(spark, sf)
    models = L.walk_forward_models(data, NAMES, L.years_of(data), [{}], L.fit_logistic)
    return L.importance_stability(L.importance_by_fold(data, NAMES, KEY, models))


@query("walk_forward_onset")
def walk_forward_onset(spark, sf):
    data = small_set(spark, sf)
    scored = L.walk_forward_scores(data, NAMES, L.years_of(data), L.fit_logistic)
    return L.walk_forward_table(cut_lineage(scored.select("fold", "label", "probability")))


@query("walk_forward_state")
def walk_forward_state(spark, sf):
    """Spread over the folds of the state target's average precision."""
    data, names = L.state_dataset(with_states(spark, sf))
    data = cut_lineage(data.select("epi_year", "label", *names))
    return L.fold_spread(L.walk_forward_table(L.walk_forward_scores(data, names, L.years_of(data), L.fit_logistic)))


@query("walk_forward_recall")
def walk_forward_recall(spark, sf):
    data = small_set(spark, sf)
    s = L.walk_forward_scores(data, NAMES, L.years_of(data), L.fit_logistic)
    ranked = R.weekly_rank(s, "probability")
    return R.recall_at_k(ranked, "label", by=("kind", "week_index"))


@query("hyper_parameter_grid")
def hyper_parameter_grid(spark, sf):
    data = small_set(spark, sf)
    return L.small_grid(data, NAMES, L.years_of(data), [{"penalty": p} for p in (0.0, 0.001, 0.01, 0.1)], L.fit_logistic)


@query("feature_group_ablation")
def feature_group_ablation(spark, sf):
    groups = {"base": X.BASE, "momentum": X.MOMENTUM, "history": X.LOCAL_HISTORY}
    data = small_set(spark, sf)
    return L.group_ablation(data, L.years_of(data), groups, L.fit_logistic)


@query("variant_decision")
def variant_decision(spark, sf):
    data = small_set(spark, sf)
    lean = [n for n in NAMES if n not in X.MOMENTUM]
    years = L.years_of(data)
    a = L.walk_forward_scores(data, NAMES, years, L.fit_logistic)
    b = L.walk_forward_scores(data, lean, years, L.fit_logistic)
    a, b = cut_lineage(a.select(*KEY, "fold", "label", "probability")), cut_lineage(b.select(*KEY, "fold", F.col("probability").alias("other")))
    L.require_same_rows(a, b, KEY)
    gain = a.join(b, [*KEY, "fold"]).withColumn("d", F.pow(F.col("other") - F.col("label"), 2.0) - F.pow(F.col("probability") - F.col("label"), 2.0))
    interval = B.mean_interval(gain, F.col("d"), ["place", "fold"])
    return L.adopt_variant(interval, gain.groupBy("fold").agg(F.avg("d").alias("difference")))


WEATHER_K = (5, 10)


@query("weather_recall")
def weather_recall(spark, sf):
    """Episodes found by the ranking without and with gridded weather: the same rows, folds and draws, adopted or not."""
    states = threshold.alert_state(cell_gold(spark, sf))
    data, names = L.onset_dataset(states, cell_weather=True)
    data = cut_lineage(data.select(*KEY, "epi_year", "epi_week", "label", *[n for n in names if n != "epi_week"]))
    years = L.years_of(data)
    sides = [L.walk_forward_scores(data, n, years, L.fit_logistic).select(*KEY, "fold", "label", "probability") for n in (NAMES, names)]
    a, b = [cut_lineage(side.withColumn("variant", F.lit(v))) for side, v in zip(sides, "ab")]
    L.require_same_rows(a, b, KEY)
    eps = E.episodes(states).where(F.col("start_year").isin(L.folds_of(data, years)))
    hits = cut_lineage(L.paired_hits(a.unionByName(b), eps, WEATHER_K))
    out = None
    for k in WEATHER_K:
        row = L.paired_decision(hits, f"a_hit_{k}", f"b_hit_{k}", list(R.EP)).withColumn("k", F.lit(k))
        out = row if out is None else out.unionByName(row)
    recalls = hits.agg(*[F.avg(f"{v}_hit_{k}").alias(f"{v}_{k}") for v in "ab" for k in WEATHER_K], F.count(F.lit(1)).alias("n_episodes"))
    by_k = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"a_{k}").alias("recall_without"), F.col(f"b_{k}").alias("recall_with")) for k in WEATHER_K]))
    return recalls.select("n_episodes", by_k.alias("r")).select("n_episodes", "r.*").join(out, "k")


_ADOPT = "coalesce(low > 0, false) AND (SELECT bool_and(d > 0) FROM (SELECT avg({b} - {a}) AS d FROM master GROUP BY start_year))"


@query("rule_adoption", sql(" UNION ALL ".join(
    f"SELECT observed, low, high, {_ADOPT.format(a=f'growth_hit_{k}', b=f'history_hit_{k}')} AS adopt, {k}::BIGINT AS k FROM ({interval_of_mean('master', f'(history_hit_{k} - growth_hit_{k})', list(R.EP))})" for k in (5, 10)
), _MASTER))
def rule_adoption(spark, sf):
    """The same decision between two rules of ranking: local history against growth."""
    m = cut_lineage(master(spark, sf))
    out = None
    for k in WEATHER_K:
        row = L.paired_decision(m, f"growth_hit_{k}", f"history_hit_{k}", list(R.EP)).withColumn("k", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return rounded(out, **_ENDS)


_UNITS = (("episode", ["place", "kind", "start_index"]), ("place", ["place"]), ("place_year", ["place", "start_year"]))
_ENDS = {"observed": 6, "low": 6, "high": 6}


@query("recall_interval", sql(" UNION ALL ".join(f"SELECT *, '{label}' AS unit FROM ({interval_of_mean('master', 'history_hit_10', unit)})" for label, unit in _UNITS), _MASTER))
def recall_interval(spark, sf):
    m = cut_lineage(master(spark, sf))
    out = None
    for label, unit in _UNITS:
        one = B.mean_interval(m, F.col("history_hit_10"), unit).withColumn("unit", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return rounded(out, **_ENDS)


@query("recall_difference_interval", sql(interval_of_mean("master", "(history_hit_10 - growth_hit_10)", ["place"]), _MASTER))
def recall_difference_interval(spark, sf):
    m = cut_lineage(master(spark, sf))
    return rounded(B.difference_interval(m, F.col("history_hit_10"), F.col("growth_hit_10"), ["place"]), **_ENDS)


@query("lead_median_interval", sql(interval_of_median("master", "history_lead_weeks", ["place", "kind", "start_index"]), _MASTER))
def lead_median_interval(spark, sf):
    m = cut_lineage(master(spark, sf))
    return rounded(B.median_interval(m, F.col("history_lead_weeks"), ["place", "kind", "start_index"]), **_ENDS)


# --- streams -----------------------------------------------------------------------------------

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark, sf):
    """The events file as a stream of station readings."""
    e = spark.readStream.schema(EVENTS).parquet(f"{sf}/event[s].parquet")
    return e.select(
        F.col("user_id").alias("station"), F.col("ts").cast("timestamp").alias("ts"), F.hour("ts").alias("hour"), "event_id",
        F.when(F.col("event_type") != "error", F.col("value")).alias("rain"), "event_type",
    )


@query("streamed_daily_readings", sql(f"""
SELECT user_id AS station, CAST(ts AS DATE) AS day, {r("sum(value) FILTER (event_type <> 'error')", 4)} AS rain_mm, count(value) FILTER (event_type <> 'error') AS valid_hours FROM events GROUP BY 1, 2"""))
def streamed_daily_readings(spark, sf):
    return rounded(SR.run_to_table(spark, SR.daily_readings(event_stream(spark, sf)), "daily", ["station", "day"]), rain_mm=4)


@query("streamed_weekly_counts", sql(f"""
SELECT user_id % 25 AS place, event_type AS kind, {sunday('CAST(ts AS DATE)')} AS week_start, count(*) AS cases FROM events GROUP BY 1, 2, 3"""))
def streamed_weekly_counts(spark, sf):
    e = event_stream(spark, sf).select((F.col("station") % 25).alias("place"), F.col("event_type").alias("kind"), "ts")
    return SR.run_to_table(spark, SW.weekly_counts(e), "weekly", ["place", "kind", "week_start"])


@query("streamed_episodes", sql("""
SELECT e.place, e.kind, e.start_index, e.end_index, e.start_year, e.start_week, e.weeks, e.total_cases, e.peak_cases, e.end_index = l.last AS open
FROM eps e JOIN (SELECT place, kind, max(week_index) AS last FROM states WHERE state IS NOT NULL GROUP BY 1, 2) l USING (place, kind)"""))
def streamed_episodes(spark, sf):
    """Weeks with their states, read as a stream that stops after the first half of the years and starts again."""
    columns = ["place", "kind", F.col("week_start").cast("timestamp").alias("week_start"), "week_index", "epi_year", "epi_week", "cases", "state"]
    weeks = cut_lineage(with_states(spark, sf).select(*columns))
    base = f"{checkpoint_dir(spark)}/episodes-{uuid.uuid4().hex}"
    years, out = L.years_of(weeks), None
    for half in (years[: len(years) // 2], years[len(years) // 2 :]):
        weeks.where(F.col("epi_year").isin(half)).write.mode("append").parquet(f"{base}/weeks")
        stream = SW.episodes_so_far(spark.readStream.schema(weeks.schema).parquet(f"{base}/weeks"))
        with SW.rocksdb_states(spark):
            SR.upsert_available(stream, f"{base}/table", f"{base}/checkpoint")
        out = stream.schema
    written = spark.read.schema(StructType([*out.fields, StructField(SR.EPOCH, LongType())])).parquet(f"{base}/table")
    return SR.newest_rows(written, ["place", "kind", "start_index"]).select(*out.names)


@query("streamed_first_readings", sql("SELECT DISTINCT user_id AS station, CAST(ts AS DATE) AS day, hour(ts) AS hour FROM events"))
def streamed_first_readings(spark, sf):
    e = event_stream(spark, sf).withColumn("day", F.col("ts").cast("date"))
    return SR.run_to_table(spark, SR.first_of_key(e, ["station", "day", "hour"], "40 days"), "first").select("station", "day", "hour")


@query("streamed_latest_readings", sql("""
SELECT user_id AS station, CAST(ts AS DATE) AS day, hour(ts) AS hour, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), hour(ts) ORDER BY ts DESC, event_id DESC) = 1"""))
def streamed_latest_readings(spark, sf):
    e = event_stream(spark, sf).withColumn("day", F.col("ts").cast("date"))
    return SR.merge_to_table(spark, e, "latest", ["station", "day", "hour"], ["ts", "event_id"], "day").select("station", "day", "hour", "event_id", "event_type")
