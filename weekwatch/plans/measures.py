"""Registered queries: population, evaluation, diagnostics, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekwatch.operators import episodes as E, evaluation as V, population as Pop, profile, rates, threshold
from weekwatch.plans import climate, tables as T
from weekwatch.plans.registry import query
from weekwatch.plans.sqltext import r, rate, sql
from weekwatch.plans.weekly import rounded, with_features, with_rate_features, with_states

A, B, C = ("p95", 1995), ("p98", 1998), ("p00", 2000)


def checkpoints(spark, sf):
    """Three checkpoints per place from its customers."""
    b = F.col("base")
    return T.base_population(spark, sf).select(
        "place", (b * 100).alias("p95"), (b * (100 + F.col("place") % 7)).alias("p98"), (b * (95 + (F.col("place") % 11) * 3)).alias("p00")
    )


def totals(spark, sf):
    """Official totals 1995..2003: 1 % a year on all customers; 2001 is not published."""
    n = T.read(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n"))
    raw = n.withColumn("epi_year", F.explode(F.sequence(F.lit(1995), F.lit(2003)))).select(
        "epi_year", F.when(F.col("epi_year") != 2001, F.col("n") * (100 + F.col("epi_year") - 1995)).alias("total")
    )
    return Pop.official_totals(raw)


def estimates(spark, sf):
    """Yearly estimates 1995..1998: the share of a place in 1995 applied to each total."""
    cp = checkpoints(spark, sf)
    sums = cp.agg(F.sum("p95").alias("s")).select("s").scalar()
    t = totals(spark, sf).where(F.col("epi_year") <= 1998)
    years = cp.withColumn("epi_year", F.explode(F.sequence(F.lit(1995), F.lit(1998))))
    return years.join(F.broadcast(t), "epi_year").select("place", "epi_year", F.rint(F.col("p95") / sums * F.col("total")).alias("population"))


_POP = {
    "cps": "SELECT place, base * 100 AS p95, base * (100 + place % 7) AS p98, base * (95 + (place % 11) * 3) AS p00 FROM base_pop",
    "tot": "SELECT y AS epi_year, CASE WHEN y = 2001 THEN sqrt((n * 105e0) * (n * 107e0)) ELSE n * (100 + y - 1995) * 1e0 END AS total FROM (SELECT count(*) AS n FROM customer), (SELECT unnest(generate_series(1995, 2003)) AS y)",
    "seg": "SELECT place, CAST(y AS BIGINT) AS epi_year, p98 * pow(pow(p00 * 1e0 / p98, 1e0 / 2), y - 1998) AS prelim FROM cps, (SELECT unnest([1999]) AS y)",
    "segs": "SELECT s.place, s.epi_year, s.prelim * f.factor AS population, f.total AS reference_total, f.factor FROM seg s JOIN (SELECT epi_year, any_value(total) AS total, any_value(total) / sum(prelim) AS factor FROM seg JOIN tot USING (epi_year) GROUP BY 1) f USING (epi_year)",
    "held": """SELECT place, pr * f AS predicted, real, abs(pr * f - real) AS abs_error, 100 * abs(pr * f - real) / real AS pct_error, pr * f - real AS bias FROM
 (SELECT place, p95 * pow(pow(p00 * 1e0 / p95, 1e0 / 5), 3) AS pr, CAST(p98 AS DOUBLE) AS real FROM cps), (SELECT (SELECT total FROM tot WHERE epi_year = 1998) / sum(p95 * pow(pow(p00 * 1e0 / p95, 1e0 / 5), 3)) AS f FROM cps)""",
    "praw": " UNION ALL ".join(
        f"SELECT '{m}' AS method, place, y AS epi_year, p00 * pow({g}, y - 2000) AS raw FROM cps, (SELECT unnest([2001, 2002, 2003]) AS y)"
        for m, g in (("fixed_share", "1e0"), ("long_trend", "pow(p00 * 1e0 / p95, 1e0 / 5)"), ("recent_trend", "pow(p00 * 1e0 / p98, 1e0 / 2)"))
    ),
    "proj": "SELECT method, place, epi_year, raw * total / s AS population FROM praw JOIN (SELECT method, epi_year, sum(raw) AS s FROM praw GROUP BY ALL) USING (method, epi_year) JOIN tot USING (epi_year)",
    "disp": "SELECT method, avg(s) AS dispersion FROM (SELECT method, epi_year, stddev_samp(g) AS s FROM (SELECT *, population / lag(population) OVER (PARTITION BY method, place ORDER BY epi_year) - 1 AS g FROM proj) WHERE g IS NOT NULL GROUP BY ALL) GROUP BY 1",
    "bestm": f"SELECT method FROM disp ORDER BY {r('dispersion', 12)}, list_position(['fixed_share', 'long_trend', 'recent_trend'], method) LIMIT 1",
    "fullp": """
SELECT place, epi_year, round_even(p95 / (SELECT sum(p95) FROM cps) * total, 0) AS population, CASE WHEN epi_year = 1995 THEN 'censo_observado' ELSE 'estimativa_intercensitaria' END AS population_type,
 CASE WHEN epi_year = 1995 THEN 'censo_direto' ELSE 'participacao_proporcional' END AS method, CASE WHEN epi_year = 1998 THEN 1998 ELSE 1995 END AS checkpoint_before, CASE WHEN epi_year = 1995 THEN 1995 ELSE 1998 END AS checkpoint_after
 FROM cps, tot WHERE epi_year <= 1998
UNION ALL SELECT place, epi_year, population, 'estimativa_intercensitaria', 'cagr_reconciliado', 1998, 2000 FROM segs
UNION ALL SELECT place, 2000, CAST(p00 AS DOUBLE), 'censo_observado', 'censo_direto', 2000, 2000 FROM cps
UNION ALL SELECT place, epi_year, population, 'projecao_pos_censo', method, 2000, NULL FROM proj WHERE method = (SELECT method FROM bestm)""",
}


@query("official_totals", sql(f"SELECT epi_year, {r('total')} AS total FROM tot", _POP))
def official_totals(spark, sf):
    return rounded(totals(spark, sf), total=6)


@query("population_gap_years", sql(f"SELECT place, epi_year, {r('population', 5)} AS population, {r('reference_total', 5)} AS reference_total, {r('factor')} AS factor FROM segs", _POP))
def population_gap_years(spark, sf):
    anchors = checkpoints(spark, sf).select("place", F.col("p98").alias("p0"), F.col("p00").alias("p1"))
    return rounded(Pop.scaled_growth(anchors, 1998, 2000, [1999], totals(spark, sf)), population=5, reference_total=5, factor=6)


@query("population_hold_out", sql(f"""
SELECT {r('avg(abs_error)', 4)} AS mae, {r('avg(pct_error)', 5)} AS mape_pct, {r('avg(bias)', 4)} AS bias_mean, {r('max(pct_error)', 5)} AS max_pct_error, (SELECT place FROM held ORDER BY pct_error DESC, place LIMIT 1) AS worst_place, count(*) AS n_places FROM held""", _POP))
def population_hold_out(spark, sf):
    held = Pop.hold_out(checkpoints(spark, sf), A, B, C, totals(spark, sf))
    return rounded(Pop.hold_out_summary(held), mae=4, mape_pct=5, bias_mean=4, max_pct_error=5)


@query("population_atypical_places", sql(f"""
SELECT place, p95 AS population_start, p00 AS population_end, {r('100e0 * (p00 - p95) / p95')} AS change_pct, p00 < 6000 AS very_small, 100e0 * (p00 - p95) / p95 > 50 AS high_growth, p00 < p95 AS shrinking
FROM cps WHERE p00 < 6000 OR 100e0 * (p00 - p95) / p95 > 50 OR p00 < p95""", _POP))
def population_atypical_places(spark, sf):
    return rounded(Pop.atypical_places(checkpoints(spark, sf), "p95", "p00", small=6000), change_pct=6)


@query("population_projection_methods", sql(f"SELECT method, {r('dispersion', 9)} AS dispersion FROM disp", _POP))
def population_projection_methods(spark, sf):
    p = Pop.projections(checkpoints(spark, sf), A, B, C, [2001, 2002, 2003], totals(spark, sf))
    return rounded(Pop.growth_dispersion(p), dispersion=9)


@query("population_steadiest_method", sql("SELECT method FROM bestm", _POP))
def population_steadiest_method(spark, sf):
    p = Pop.projections(checkpoints(spark, sf), A, B, C, [2001, 2002, 2003], totals(spark, sf))
    return Pop.steadiest_method(Pop.growth_dispersion(p))


def full_population(spark, sf):
    return Pop.full_series(estimates(spark, sf), checkpoints(spark, sf), totals(spark, sf), A, B, C, [1999], [2001, 2002, 2003])


@query("population_series", sql("""
SELECT place, epi_year, CAST(round_even(population, 0) AS BIGINT) AS population, population_type, method, CAST(checkpoint_before AS BIGINT) AS checkpoint_before, CAST(checkpoint_after AS BIGINT) AS checkpoint_after FROM fullp""", _POP))
def population_series(spark, sf):
    return full_population(spark, sf)


@query("population_reconciliation", sql(f"""
SELECT epi_year, p AS places_total, {r('total', 5)} AS official_total, {r('p - total', 5)} AS difference, {r('100e0 * (p - total) / total', 4)} AS difference_pct FROM
 (SELECT epi_year, CAST(sum(round_even(population, 0)) AS BIGINT) AS p FROM fullp GROUP BY 1) LEFT JOIN tot USING (epi_year)""", _POP))
def population_reconciliation(spark, sf):
    return rounded(Pop.reconciliation(full_population(spark, sf), totals(spark, sf)), official_total=5, difference=5)


@query("missing_population", sql("SELECT place, epi_year FROM (SELECT DISTINCT place, epi_year FROM grid) WHERE epi_year NOT BETWEEN 1996 AND 1999"))
def missing_population(spark, sf):
    some = T.population(spark, sf).where(F.col("epi_year").between(1996, 1999))
    return rates.missing_population(T.grid(spark, sf), some)


_SENS = {
    **_POP,
    "errs": "SELECT row_number() OVER (ORDER BY e) AS rank, e, count(*) OVER () AS n FROM (SELECT 100e0 * bias / real AS e FROM held WHERE real <> 0)",
    "reps": """SELECT place, epi_year, replica, population, population_type, CAST('0x' || substr(md5('42|' || CAST(replica AS VARCHAR) || '|' || CAST(place AS VARCHAR) || '|' || CAST(epi_year AS VARCHAR)), 1, 12) AS BIGINT) % (SELECT max(n) FROM errs) + 1 AS hit
 FROM pop, (SELECT unnest(range(20)) AS replica)""",
    "pert": """SELECT place, epi_year, replica, CASE WHEN population_type IN ('estimativa', 'projecao') THEN CAST(greatest(1e0, round_even(population * (1 + e / 100), 0)) AS BIGINT) ELSE population END AS population
 FROM reps JOIN errs ON rank = hit""",
    "srate": f"""SELECT replica, kind, epi_year, {rate('sum(cases) OVER (PARTITION BY replica, place, kind ORDER BY week_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)', 'population')} AS rate_4w
 FROM (SELECT place, kind, epi_year, week_index, cases FROM grid) JOIN pert USING (place, epi_year)""",
}


@query("population_sensitivity", sql(f"""
SELECT kind, epi_year, count(*) AS n_replicas, {r('avg(m)', 5)} AS mean, {r('quantile_cont(m, 0.025)', 5)} AS low, {r('quantile_cont(m, 0.975)', 5)} AS high
FROM (SELECT replica, kind, epi_year, avg(rate_4w) AS m FROM srate GROUP BY ALL) GROUP BY ALL""", _SENS))
def population_sensitivity(spark, sf):
    held = Pop.hold_out(checkpoints(spark, sf), A, B, C, totals(spark, sf))
    p = Pop.perturbed(T.population(spark, sf), Pop.signed_errors(held), replicas=20)
    return rounded(Pop.sensitivity(Pop.replica_rates(T.grid(spark, sf), p)), mean=5, low=5, high=5)


# --- scores of labelled documents --------------------------------------------------------------

def scored(spark, sf):
    """Score 0..1 from the text length, label = quality."""
    d = T.read(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    lab = T.read(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("label"), F.col("toxic").cast("bigint").alias("toxic"))
    return d.join(lab, "doc_id").withColumn("score", (F.col("n_chars") % 1000) / 1000.0)


_SC = {"scd": "SELECT doc_id, n_chars, lang, CAST(quality AS BIGINT) AS label, CAST(toxic AS BIGINT) AS toxic, (n_chars % 1000) / 1000e0 AS score FROM documents JOIN labels USING (doc_id)",
"mrg": "SELECT score, CAST(sum(label) AS BIGINT) AS pos, count(*) AS n FROM scd GROUP BY 1",
"cum": "SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS listed, sum(n - pos) OVER (ORDER BY score) AS negbelow, sum(pos) OVER () AS ap, sum(n) OVER () AS an FROM mrg",
"rkm": "SELECT CASE WHEN max(ap) > 0 THEN sum(pos / ap * (tp / listed)) ELSE 0e0 END AS average_precision, sum(pos * (negbelow - (n - pos) / 2e0)) / nullif(CAST(max(ap) * (max(an) - max(ap)) AS DOUBLE), 0) AS roc_auc, CAST(max(ap) AS BIGINT) AS n_positive, CAST(max(an) AS BIGINT) AS n FROM cum",
"thrt": """SELECT t AS threshold, CAST(sum(CASE WHEN score >= t THEN pos ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN score >= t THEN n - pos ELSE 0 END) AS BIGINT) AS fp,
 CAST(sum(CASE WHEN score < t THEN pos ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN score < t THEN n - pos ELSE 0 END) AS BIGINT) AS tn
 FROM mrg, (SELECT unnest([0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0]) AS t) GROUP BY 1""",
"thrm": "SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM thrt"}
_PRF = ", ".join(f"{r(c)} AS {c}" for c in ("precision", "recall", "f1"))


@query("ranking_metrics", sql(f"SELECT {r('average_precision')} AS average_precision, {r('roc_auc')} AS roc_auc, n_positive, n FROM rkm", _SC))
def ranking_metrics(spark, sf):
    return rounded(V.ranking_metrics(V.merged_scores(scored(spark, sf), "score", "label")), average_precision=6, roc_auc=6)


@query("classification_metrics", sql(f"""
SELECT threshold, tp, fp, fn, tn, {_PRF}, {r('average_precision')} AS average_precision, {r('roc_auc')} AS roc_auc, n_positive, n, {r('n_positive / n')} AS prevalence FROM thrm, rkm WHERE threshold = 0.5e0""", _SC))
def classification_metrics(spark, sf):
    return rounded(V.classification_metrics(scored(spark, sf), "score", "label"), precision=6, recall=6, f1=6, average_precision=6, roc_auc=6, prevalence=6)


@query("threshold_table", sql(f"SELECT threshold, tp, fp, fn, tn, {_PRF} FROM thrm", _SC))
def threshold_table(spark, sf):
    return rounded(V.threshold_table(V.merged_scores(scored(spark, sf), "score", "label")), precision=6, recall=6, f1=6)


@query("best_threshold", sql(f"SELECT threshold, {r('f1')} AS f1 FROM thrm ORDER BY thrm.f1 DESC, threshold LIMIT 1", _SC))
def best_threshold(spark, sf):
    return rounded(V.best_threshold(V.threshold_table(V.merged_scores(scored(spark, sf), "score", "label"))), f1=6)


@query("calibration_bins", sql(f"""
SELECT CAST(b AS BIGINT) AS bin, CAST(sum(n) AS BIGINT) AS n, {r('sum(score * n) / sum(n)')} AS score_mean, {r('sum(pos) / sum(n)')} AS observed FROM
 (SELECT *, least(9, greatest(0, ceil(round_even((score - lo) / ((hi - lo) / 10) * 1e9, 0) / 1e9) - 1)) AS b FROM mrg, (SELECT min(score) AS lo, max(score) AS hi FROM mrg)) GROUP BY 1""", _SC))
def calibration_bins(spark, sf):
    return rounded(V.calibration_bins(scored(spark, sf), "score", "label"), score_mean=6, observed=6)


@query("brier_score", sql(f"SELECT {r('avg(pow(score - label, 2))')} AS brier, count(*) AS n FROM scd", _SC))
def brier_score(spark, sf):
    return rounded(V.brier(scored(spark, sf), "score", "label"), brier=6)


@query("count_prediction_errors", sql(" UNION ALL ".join(
    f"SELECT '{m}' AS method, {r('avg(abs(e))')} AS mae, {r('sqrt(avg(e * e))')} AS rmse, count(e) AS n FROM (SELECT CAST(lead(cases, 1) OVER (PARTITION BY place, kind ORDER BY week_index) - {c} AS DOUBLE) AS e FROM feats)"
    for m, c in (("base_count_persistence", "cases_t"), ("base_count_mean_4w", "mean_4w")))))
def count_prediction_errors(spark, sf):
    f = V.baselines(E.state_target(with_features(spark, sf), 1))
    return rounded(V.count_errors(f, "target_cases", ["base_count_persistence", "base_count_mean_4w"]), mae=6, rmse=6)


@query("baseline_scores", sql(f"""
SELECT place, kind, week_index, state_t AS base_persistence, CAST(coalesce(cases_t > lag_1, false) AND coalesce(lag_1 > lag_2, false) AS DOUBLE) AS base_rising, CAST(coalesce(cases_t > week_mean, false) AS DOUBLE) AS base_seasonal,
 CAST(cases_t AS DOUBLE) AS base_count_persistence, {r('mean_4w')} AS base_count_mean_4w FROM feats"""))
def baseline_scores(spark, sf):
    f = V.baselines(with_features(spark, sf))
    return rounded(f.select("place", "kind", "week_index", "base_persistence", "base_rising", "base_seasonal", "base_count_persistence", "base_count_mean_4w"), base_count_mean_4w=6)


from weekwatch.plans.weekly import _RATE_STATES  # noqa: E402


@query("rate_baseline_scores", sql(f"""
SELECT place, kind, week_index, {r('rate_1w')} AS base_rate, {r('rate_1w - lag(rate_1w) OVER (PARTITION BY place, kind ORDER BY week_index)')} AS base_rate_growth, {r('rate_1w / (threshold + 1)')} AS base_rate_history FROM rstates""", _RATE_STATES))
def rate_baseline_scores(spark, sf):
    f = V.baselines(with_rate_features(spark, sf))
    return rounded(f.select("place", "kind", "week_index", "base_rate", "base_rate_growth", "base_rate_history"), base_rate=6, base_rate_growth=6, base_rate_history=6)


@query("temporal_split_sizes", sql("SELECT CASE WHEN epi_year <= 1998 THEN 'treino' WHEN epi_year <= 1999 THEN 'validacao' ELSE 'teste' END AS role, count(*) AS n FROM grid GROUP BY 1"))
def temporal_split_sizes(spark, sf):
    return T.grid(spark, sf).groupBy(V.temporal_split(F.col("epi_year"), 1998, 1999).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("walk_forward_folds", sql("""
SELECT CAST(y AS BIGINT) AS fold, count(*) FILTER (epi_year < y) AS n_train, count(*) FILTER (epi_year = y) AS n_test FROM grid, (SELECT unnest([1995, 1997, 1998, 1999, 2000, 2001, 2009]) AS y) GROUP BY 1 HAVING count(*) FILTER (epi_year < y) > 0 AND count(*) FILTER (epi_year = y) > 0"""))
def walk_forward_folds(spark, sf):
    return V.fold_sizes(T.grid(spark, sf), [1995, 1997, 1998, 1999, 2000, 2001, 2009])


_LIFT = {"lsc": "SELECT epi_year, recent_ratio AS score, CAST(onset_h3 AS BIGINT) AS label FROM onsets WHERE onset_h3 IS NOT NULL AND recent_ratio IS NOT NULL",
"lm": "SELECT epi_year, score, CAST(sum(label) AS BIGINT) AS pos, count(*) AS n FROM lsc GROUP BY ALL",
"lc": "SELECT *, sum(pos) OVER (PARTITION BY epi_year ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY epi_year ORDER BY score DESC) AS listed, sum(n - pos) OVER (PARTITION BY epi_year ORDER BY score) AS negbelow, sum(pos) OVER (PARTITION BY epi_year) AS ap, sum(n) OVER (PARTITION BY epi_year) AS an FROM lm"}


@query("average_precision_lift", sql(f"""
SELECT epi_year, {r('a')} AS average_precision, n_positive, n, {r('auc')} AS roc_auc, {r('n_positive / n')} AS prevalence, {r('a / nullif(n_positive / n, 0)')} AS lift FROM (
 SELECT epi_year, CASE WHEN max(ap) > 0 THEN sum(pos / nullif(ap, 0) * (tp / listed)) ELSE 0e0 END AS a, CAST(max(ap) AS BIGINT) AS n_positive, CAST(max(an) AS BIGINT) AS n,
  sum(pos * (negbelow - (n - pos) / 2e0)) / nullif(CAST(max(ap) * (max(an) - max(ap)) AS DOUBLE), 0) AS auc FROM lc GROUP BY 1)""", _LIFT))
def average_precision_lift(spark, sf):
    o = E.onset_targets(with_features(spark, sf))
    s = V.merged_scores(o, "recent_ratio", "onset_h3", ["epi_year"])
    return rounded(V.lift(V.ranking_metrics(s, ["epi_year"])), average_precision=6, roc_auc=6, prevalence=6, lift=6)


@query("target_by_year", sql(f"""
SELECT epi_year, count(*) AS n_rows, CAST(sum(cases) AS BIGINT) AS cases, {r('avg(cases)')} AS cases_mean, {r('100e0 * count(*) FILTER (state = 1) / count(*)')} AS pct_positive, {r('100e0 * count(*) FILTER (state IS NULL) / count(*)')} AS pct_undefined,
 {r('avg(threshold)')} AS threshold_mean, count(DISTINCT place) FILTER (cases > 0) AS places_with_case, {r("100e0 * count(*) FILTER (threshold_type = 'geral') / count(*)")} AS pct_general FROM states GROUP BY 1"""))
def target_by_year(spark, sf):
    return rounded(V.target_by_year(with_states(spark, sf)), cases_mean=6, pct_positive=6, pct_undefined=6, threshold_mean=6, pct_general=6)


@query("episodes_by_year", sql(f"""
SELECT start_year, count(*) AS n_episodes, {r('avg(weeks)')} AS weeks_mean, {r('avg(total_cases)')} AS total_cases_mean, {r('avg(peak_cases)')} AS peak_mean, median(peak_cases) AS peak_median, count(DISTINCT place) AS n_places FROM eps GROUP BY 1"""))
def episodes_by_year(spark, sf):
    return rounded(V.episodes_by_year(E.episodes(with_states(spark, sf))), weeks_mean=6, total_cases_mean=6, peak_mean=6)


@query("target_agreement", sql(f"""
SELECT epi_year, count(*) FILTER (state = 1) AS n_a, count(*) FILTER (alt = 1) AS n_b, {r('avg(CAST(state = alt AS INTEGER))')} AS agreement, {r('count(*) FILTER (state = 1 AND alt = 1) / nullif(count(*) FILTER (state = 1 OR alt = 1), 0)')} AS jaccard FROM
 (SELECT *, CASE WHEN week_mean IS NOT NULL AND lag(cases, 2) OVER w IS NOT NULL THEN CASE WHEN cases > week_mean AND cases > lag(cases, 1) OVER w AND lag(cases, 1) OVER w > lag(cases, 2) OVER w THEN 1e0 ELSE 0e0 END END AS alt FROM states WINDOW w AS (PARTITION BY place, kind ORDER BY week_index))
WHERE state IS NOT NULL AND alt IS NOT NULL GROUP BY 1"""))
def target_agreement(spark, sf):
    return rounded(V.target_agreement(threshold.experimental_state(with_states(spark, sf))), agreement=6, jaccard=6)


@query("most_frequent_category", sql("""
SELECT lang, source, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rn FROM (SELECT lang, source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL)) WHERE rn = 1"""))
def most_frequent_category(spark, sf):
    return V.most_frequent(T.read(spark, sf, "documents"), "lang", "source")


_DR = {"dl": " UNION ALL ".join(f"SELECT epi_year, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM feats WHERE {f} IS NOT NULL" for f in ("cases_t", "mean_8w", "threshold_ratio")),
"dg": "SELECT feature, y AS year, v, epi_year <= 1998 AS isref FROM dl, (SELECT unnest([1999, 2000, 2001]) AS y) WHERE epi_year <= 1998 OR epi_year = y",
"dc": "SELECT feature, year, v, sum(n1) OVER w AS c1, sum(n2) OVER w AS c2, sum(n1) OVER p AS t1, sum(n2) OVER p AS t2, n1, n2 FROM (SELECT feature, year, v, count(*) FILTER (isref) AS n1, count(*) FILTER (NOT isref) AS n2 FROM dg GROUP BY ALL) WINDOW w AS (PARTITION BY feature, year ORDER BY v), p AS (PARTITION BY feature, year)",
"dk": "SELECT feature, year, max(abs(c1 / t1 - c2 / t2)) AS ks, CAST(max(t1) AS BIGINT) AS n_reference, CAST(max(t2) AS BIGINT) AS n FROM dc GROUP BY ALL"}


@query("feature_drift", sql(f"""
SELECT feature, CAST(year AS BIGINT) AS year, {r('ks')} AS ks, n_reference, n, {r('mr')} AS mean_reference, {r('m')} AS mean, {r('median')} AS median, {r('p90')} AS p90,
 {r("CASE WHEN ks = 0 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(list_transform(generate_series(1, 100), lambda k: (CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END) * exp(-2e0 * k * k * ks * ks * (n_reference * n / (n_reference + n))))))) END")} AS p_value
FROM dk JOIN (SELECT feature, year, avg(v) FILTER (isref) AS mr, avg(v) FILTER (NOT isref) AS m, quantile_cont(v, 0.5) FILTER (NOT isref) AS median, quantile_cont(v, 0.9) FILTER (NOT isref) AS p90 FROM dg GROUP BY ALL) USING (feature, year)""", _DR))
def feature_drift(spark, sf):
    d = V.drift(with_features(spark, sf), ["cases_t", "mean_8w", "threshold_ratio"], 1998, [1999, 2000, 2001])
    return rounded(d, ks=6, mean_reference=6, mean=6, median=6, p90=6, p_value=6)


# --- profiles ----------------------------------------------------------------------------------------

_PC = ["o_orderkey", "o_orderstatus", "o_orderpriority", "price_text", "date_text"]


def raw_orders(spark, sf):
    """Orders as a text table: prices with comma, dates DD/MM/YYYY, status by file."""
    o = T.read(spark, sf, "orders")
    return o.select(
        F.col("o_orderstatus").alias("file"), F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"),
        F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(",")).alias("price_text"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("date_text"),
    )


_RAW = {"rawo": "SELECT o_orderstatus AS file, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS o_orderpriority, replace(printf('%.2f', o_totalprice), '.', ',') AS price_text, strftime(o_orderdate, '%d/%m/%Y') AS date_text FROM orders"}
_COLS4 = ["o_orderkey", "o_orderpriority", "price_text", "date_text"]


@query("column_profile", sql(" UNION ALL ".join(f"""
SELECT file, '{c}' AS column_name, CASE WHEN count({c}) = 0 THEN 'vazio' WHEN bool_and(regexp_matches({c}, '^\\d{{2}}/\\d{{2}}/\\d{{4}}$')) THEN 'data' WHEN bool_and(regexp_matches({c}, '^-?\\d+$')) THEN 'inteiro'
 WHEN bool_and(regexp_matches({c}, '^-?\\d+[.,]\\d+$')) THEN 'decimal' ELSE 'texto' END AS kind, count(*) AS n_rows, count(*) - count({c}) AS n_null, {r(f'100e0 * (count(*) - count({c})) / count(*)', 2)} AS pct_null, count(DISTINCT {c}) AS n_distinct FROM rawo GROUP BY file""" for c in _COLS4), _RAW))
def column_profile(spark, sf):
    return profile.column_profile(raw_orders(spark, sf), "file")


@query("duplicate_rows", sql("SELECT lang, count(*) AS n_rows, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_duplicates FROM documents GROUP BY 1"))
def duplicate_rows(spark, sf):
    return profile.duplicate_rows(T.read(spark, sf, "documents").select("lang", "text"), "lang")


@query("null_profile", sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, {r(f'100e0 * (count(*) - count({c})) / count(*)', 4)} AS pct_null FROM wx" for c in ("place", "kind", "cases", "population", "rain_week", "rain_28d", "station"))))
def null_profile(spark, sf):
    return profile.null_profile(climate.gold_station(spark, sf).select("place", "kind", "cases", "population", "rain_week", "rain_28d", "station"))


@query("grid_profile", sql(f"""
SELECT count(*) AS n_rows, count(DISTINCT place) AS n_places, count(DISTINCT kind) AS n_kinds, min(epi_year) AS first_year, max(epi_year) AS last_year, count(DISTINCT week_start) AS n_weeks, min(week_start) AS first_day, max(week_end) AS last_day,
 CAST(sum(cases) AS BIGINT) AS cases, {r('avg(cases)', 4)} AS cases_mean, median(cases) AS cases_median, max(cases) AS cases_max, min(cases) AS cases_min, count(*) FILTER (cases > 0) AS rows_with_case, count(*) FILTER (cases < 0) AS rows_negative,
 {r('100e0 * count(*) FILTER (cases > 0) / count(*)', 4)} AS pct_with_case, count(*) FILTER (valid_days_week > 0) AS rows_with_reading, count(*) FILTER (rain_week < 0) AS negative_rain,
 {r('avg(rain_week) FILTER (valid_days_week > 0)', 4)} AS rain_mean, max(rain_week) FILTER (valid_days_week > 0) AS rain_max, min(week_start) FILTER (valid_days_week > 0) AS reading_first, max(week_end) FILTER (valid_days_week > 0) AS reading_last, CAST(0 AS BIGINT) AS duplicate_keys FROM wx"""))
def grid_profile(spark, sf):
    return profile.grid_profile(climate.gold_station(spark, sf))
