import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from weekwatch.operators import episodes as E, features as X, ranking as R, threshold


def weekly(spark, cases, weeks=52, first=2015, place=1):
    data = [(place, "D", first + i // weeks, i % weeks + 1, i, int(c)) for i, c in enumerate(cases)]
    return spark.createDataFrame(data, "place bigint, kind string, epi_year int, epi_week int, week_index int, cases bigint")


def brute(cases, weeks=52, first=2015):
    out = []
    years = [first + i // weeks for i in range(len(cases))]
    wk = [i % weeks + 1 for i in range(len(cases))]
    for i, c in enumerate(cases):
        lo, hi = max(1, wk[i] - 2), min(53, wk[i] + 2)
        s = [cases[j] for j in range(len(cases)) if years[j] < years[i] and lo <= wk[j] <= hi]
        g = [cases[j] for j in range(len(cases)) if years[j] < years[i]]
        if len(s) >= 15:
            t, kind = np.percentile(s, 90), "sazonal"
        elif len(g) >= 20:
            t, kind = np.percentile(g, 90), "geral"
        else:
            t, kind = None, "indefinido"
        out.append((i, kind, None if t is None else float(c > round(t, 9))))
    return out


def test_threshold_against_brute_force(spark):
    rnd = random.Random(3)
    cases = [rnd.randrange(0, 12) for _ in range(52 * 5)]
    got = rows(threshold.alert_state(weekly(spark, cases)).select("week_index", "threshold_type", "state"), "week_index")
    assert got == brute(cases)


def test_threshold_ignores_own_and_later_years(spark):
    cases = [i % 7 for i in range(52 * 5)]
    changed = cases[: 52 * 4] + [9999] * 52
    a = rows(threshold.alert_state(weekly(spark, cases)).where("epi_year < 2019").select("week_index", "threshold", "state"), "week_index")
    b = rows(threshold.alert_state(weekly(spark, changed)).where("epi_year < 2019").select("week_index", "threshold", "state"), "week_index")
    assert a == b
    own = rows(threshold.alert_state(weekly(spark, changed)).where("epi_year = 2019").select("threshold"), "week_index")
    assert max(r[0] for r in own) < 10


def test_features_never_see_the_future(spark):
    rnd = random.Random(5)
    cases = [rnd.randrange(0, 9) for _ in range(52 * 4)]
    changed = cases[:160] + [500 + c for c in cases[160:]]
    cols = ["week_index", *[c for c in X.feature_names(territory=False) if c not in X.SEASON], "week_mean"]
    add = lambda d: d.withColumns({"week_end": F.date_add(F.lit("2015-01-03").cast("date"), F.col("week_index") * 7), "area_km2": F.lit(1.0), "lat": F.lit(0.0), "lon": F.lit(0.0)})
    f = lambda c: rows(X.case_features(threshold.alert_state(add(weekly(spark, c)))).where("week_index < 160").select(*cols), "week_index")
    assert f(cases) == f(changed)


def states(spark, values, place=1, cases=None):
    data = [(place, "D", i, 2020, i + 1, (cases or [1] * len(values))[i], v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "place bigint, kind string, week_index int, epi_year int, epi_week int, cases bigint, state double")


def test_episodes_break_on_undefined_weeks_and_jumps(spark):
    s = states(spark, [0.0, 1.0, 1.0, None, 1.0, 0.0, 1.0, 1.0], cases=[0, 2, 5, 0, 1, 0, 3, 4])
    got = rows(E.episodes(s).select("start_index", "end_index", "weeks", "total_cases", "peak_cases"), "start_index")
    assert got == [(1, 2, 2, 7.0, 5.0), (4, 4, 1, 1.0, 1.0), (6, 7, 2, 7.0, 4.0)]
    gap = s.where("week_index <> 7 and week_index <> 2")
    assert [r[0] for r in rows(E.episodes(gap).select("start_index"), "start_index")] == [1, 4, 6]
    assert E.episodes(states(spark, [None, None])).count() == 0


def test_onset_targets(spark):
    s = states(spark, [0.0, 1.0, 1.0, 0.0, 1.0, None, 0.0, 0.0])
    got = rows(E.onset_targets(s, horizons=(1, 3)).select("onset", "onset_h1", "onset_h3"), "week_index")
    assert [g[0] for g in got] == [0, 1, 0, 0, 1, 0, 0, 0]
    assert [g[1] for g in got] == [1.0, 0.0, 0.0, 1.0, None, 0.0, 0.0, None]
    assert [g[2] for g in got] == [1.0, 1.0, 1.0, 1.0, None, None, None, None]


def test_alert_verdicts_and_false_alerts(spark):
    eps = spark.createDataFrame([(1, "D", 10, 12), (1, "D", 30, 31), (2, "D", 10, 11), (3, "D", 5, 5)], "place bigint, kind string, start_index int, end_index int")
    al = spark.createDataFrame([(1, "D", 7), (1, "D", 11), (1, "D", 31), (1, "D", 20), (1, "D", 21), (2, "D", 10), (2, "D", 12)], "place bigint, kind string, alert_index int")
    j = E.anticipation(al, eps)
    assert {(r["place"], r["start_index"]): (r["verdict"], r["lead_weeks"]) for r in j.collect()} == {
        (1, 10): ("antecipado", 3), (1, 30): ("tardio", -1), (2, 10): ("simultaneo", 0), (3, 5): ("perdido", None)}
    f = E.false_alerts(al, eps)
    assert sorted(rows(f)) == [(1, "D", 20), (1, "D", 21), (2, "D", 12)]
    assert rows(E.false_runs(f)) == [(2, 1.5, 2)]
    s = E.anticipation_summary(j, f).first()
    assert (s["n_episodes"], s["n_detected"], s["n_missed"], s["lead_median"], s["n_false_alerts"]) == (4, 3, 1, 0.0, 3)


def ranked(spark):
    data = [(p, "D", w, float(10 - p if w % 2 else p)) for w in range(10, 16) for p in range(1, 8)]
    return R.weekly_rank(spark.createDataFrame(data, "place bigint, kind string, week_index int, score double"), "score")


def test_ranking_ties_and_look_back(spark):
    tie = spark.createDataFrame([(2, "D", 1, 0.5), (1, "D", 1, 0.5), (3, "D", 1, None)], "place bigint, kind string, week_index int, score double")
    assert rows(R.weekly_rank(tie, "score").select("place", "position"), "position") == [(1, 1), (2, 2), (3, 3)]
    eps = spark.createDataFrame([(1, "D", 14, 2020), (9, "D", 14, 2020)], "place bigint, kind string, start_index int, start_year int")
    got = {r["place"]: r for r in R.best_before_start(ranked(spark), eps).collect()}
    # place 1 leads in odd weeks: weeks 11 and 13, the earlier one counts
    assert (got[1]["best_position"], got[1]["lead_weeks"], got[1]["position_at_start"]) == (1, 3, 7)
    assert got[9]["best_position"] is None and got[9]["position_at_start"] is None
    run = {r["place"]: r["weeks_in_top"] for r in R.unbroken_top_k(ranked(spark), eps, k=3).collect()}
    assert run == {1: 1, 9: 0}
    assert R.unbroken_top_k(ranked(spark), eps, k=7).where("place = 1").first()["weeks_in_top"] == 4


def test_recall_precision_jaccard_and_load(spark):
    r = ranked(spark).withColumn("actual", F.when(F.col("place") == 1, 1).otherwise(0)).withColumn("onset_h3", F.when(F.col("place") == 7, F.lit(None)).otherwise(F.col("actual")))
    rec = R.recall_at_k(r, ks=(3,)).first()
    assert (rec["recall_micro"], rec["n_positive"], rec["n_weeks"]) == (0.5, 6, 6)
    assert abs(R.precision_at_k(r, ks=(3,)).first()["precision_mean"] - 1 / 6) < 1e-12
    jac = rows(R.top_k_jaccard(ranked(spark), 3).select("week_index", "jaccard", "n_kept"), "week_index")
    assert jac == [(w, 0.0, 0) for w in range(10, 15)]
    load = R.operating_load(r, ks=(3,)).first()
    assert (load["n_weeks"], load["n_listed"], load["with_episode"], load["undefined_outcome"]) == (6, 18, 3, 3)
    assert load["pct_without_episode"] == 80.0


def test_backtest_needs_an_observed_zero_before_the_one(spark):
    data = [(1, "D", i, 2020, i + 1, float(i), v, 1.0, 0.0, 1.0, i) for i, v in enumerate([None, 1.0, 0.0, 1.0, 1.0])]
    f = spark.createDataFrame(data, "place bigint, kind string, week_index int, epi_year int, epi_week int, threshold_ratio double, state_t double, growth double, onset_h3 double, recent_ratio double, cases int")
    got = rows(R.backtest_rows(f, "recent_ratio").select("week_index", "weeks_to_onset", "cases_next_3w"), "week_index")
    assert got == [(0, 3.0, 6), (1, 2.0, 9), (2, 1.0, None), (3, None, None), (4, None, None)]


def test_feature_groups(spark):
    with pytest.raises(ValueError):
        X.feature_names(cell_weather=True, present=["cases"])
    with pytest.raises(ValueError):
        X.variant_names("other")
    sizes = {v: len(X.variant_names(v)) for v in X.VARIANTS}
    assert sizes["v1_mais_populacao"] == sizes["v1_features"] + 2 and sizes["v2_casos_incidencia_populacao"] == sizes["v2_casos_incidencia"] + 2
    assert not set(X.BASE) & set(X.variant_names("v2_incidencia"))
    oh, names = X.one_hot(spark.createDataFrame([(1,), (None,)], "region int"), "region", [2, 1])
    assert names == ["region_1", "region_2"] and sorted(rows(oh.select(*names))) == [(0, 0), (1, 0)]
