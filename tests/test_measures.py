import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from weekwatch.functions import ordered
from weekwatch.functions.stats import correlation_p_value, _regularized_beta
from weekwatch.operators import association as A, bootstrap as B, evaluation as V, gates, population as Pop, star


def test_exact_percentiles_and_running_totals(spark):
    rnd = random.Random(1)
    # one value holds a third of the rows
    data = [(rnd.choice("ab"), 5.0 if rnd.random() < 0.33 else rnd.gauss(0, 3)) for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: r for r in ordered.exact_percentiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    for g in "ab":
        v = [x for k, x in data if k == g]
        for name, q in (("p10", 10), ("p50", 50), ("p99", 99)):
            assert abs(got[g][name] - np.percentile(v, q)) < 1e-9
    cum = ordered.cumulative_by_value(df.withColumn("n", F.lit(1)), [], "v", ["n"])
    last = cum.orderBy(F.desc("v")).first()
    assert last["cum_n"] == 3000 and last["all_n"] == 3000


def brute_ap_auc(y, s):
    order = sorted(set(s), reverse=True)
    ap, tp, n, P = 0.0, 0, 0, sum(y)
    for v in order:
        hits = sum(a for a, b in zip(y, s) if b == v)
        tp, n = tp + hits, n + sum(1 for b in s if b == v)
        ap += hits / P * tp / n
    pos = [b for a, b in zip(y, s) if a]
    neg = [b for a, b in zip(y, s) if not a]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    return ap, auc


def test_average_precision_auc_thresholds(spark):
    rnd = random.Random(2)
    y = [rnd.random() < 0.3 for _ in range(400)]
    s = [round(min(1, max(0, rnd.gauss(0.4 + 0.2 * a, 0.2))), 2) for a in y]
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    m = V.classification_metrics(df, "score", "label").first()
    ap, auc = brute_ap_auc(y, s)
    assert abs(m["average_precision"] - ap) < 1e-9 and abs(m["roc_auc"] - auc) < 1e-9
    tp = sum(a and b >= 0.5 for a, b in zip(y, s))
    assert m["tp"] == tp and abs(m["recall"] - tp / sum(y)) < 1e-12
    one = V.classification_metrics(df.where("label = 0"), "score", "label").first()
    assert one["roc_auc"] is None and one["average_precision"] == 0.0 and one["precision"] == 0.0
    b = V.calibration_bins(df, "score", "label")
    assert b.agg(F.sum("n")).first()[0] == 400
    flat = V.calibration_bins(df.withColumn("score", F.lit(0.5)), "score", "label")
    assert flat.count() == 1


def test_folds_never_train_on_the_test_year(spark):
    df = spark.createDataFrame([(y,) for y in (2018, 2018, 2019, 2021)], "epi_year int")
    assert rows(V.fold_sizes(df, [2018, 2019, 2020, 2021]), "fold") == [(2019, 2, 1), (2021, 3, 1)]
    assert [r[0] for r in df.select(V.temporal_split(F.col("epi_year"))).collect()] == ["treino", "treino", "treino", "validacao"]


def test_ks_against_brute_force(spark):
    rnd = random.Random(4)
    a = [rnd.gauss(0, 1) for _ in range(200)]
    b = [rnd.gauss(0.5, 1) for _ in range(150)]
    df = spark.createDataFrame([(2018, v) for v in a] + [(2020, v) for v in b], "epi_year int, x double")
    r = V.drift(df, ["x"], 2019, [2020]).first()
    grid = sorted(a + b)
    d = max(abs(sum(v <= g for v in a) / 200 - sum(v <= g for v in b) / 150) for g in grid)
    assert abs(r["ks"] - d) < 1e-12 and abs(r["median"] - np.median(b)) < 1e-9 and 0 <= r["p_value"] < 0.05


def test_p_values(spark):
    # two-sided t with 10 degrees of freedom at 2.228 is 0.05
    assert abs(_regularized_beta(5.0, 0.5, 10 / (10 + 2.228139**2)) - 0.05) < 1e-6
    df = spark.createDataFrame([(1.0, 20.0), (None, 5.0), (0.0, 30.0)], "r double, n double")
    got = [x[0] for x in df.select(correlation_p_value(F.col("r"), F.col("n"))).collect()]
    assert got[0] == 0.0 and got[1] is None and abs(got[2] - 1.0) < 1e-12


def test_lag_table_finds_a_planted_lag_and_keeps_every_lag(spark):
    rnd = random.Random(9)
    x = [rnd.random() for _ in range(80)]
    y = [0.0] * 3 + x[:-3]
    df = spark.createDataFrame([("D", "casos", "rain", i, i % 52 + 1, y[i], x[i]) for i in range(80)], "kind string, target string, variable string, series_index int, epi_week int, y double, x double")
    t = {r["lag"]: r for r in A.lag_correlations(df).collect()}
    assert len(t) == 13 and t[3]["spearman"] == 1.0 and t[3]["n"] == 77 and t[0]["n"] == 80
    best = A.strongest_lag(A.lag_correlations(df)).first()
    assert best["lag"] == 3 and "3 semanas" in best["sentence"]
    short = df.where("series_index < 8")
    s = A.strongest_lag(A.lag_correlations(short)).first()
    assert s["lag"] is None and s["sentence"].startswith("Nenhuma defasagem")
    assert A.lag_correlations(short).where("lag = 12").first()["n"] == 0


def test_bootstrap_intervals(spark):
    hits = [1] * 30 + [0] * 20
    df = spark.createDataFrame([(i, i % 5, v) for i, v in enumerate(hits)], "id int, place int, hit int")
    a = B.mean_interval(df, F.col("hit"), ["id"], draws=400).first()
    assert a["observed"] == 0.6 and a["low"] < 0.6 < a["high"] and 0.4 < a["low"] and a["high"] < 0.8
    again = B.mean_interval(df.repartition(7), F.col("hit"), ["id"], draws=400).first()
    assert again == a
    same = B.difference_interval(df, F.col("hit"), F.col("hit"), ["place"], draws=100).first()
    assert (same["observed"], same["low"], same["high"]) == (0.0, 0.0, 0.0)
    m = B.median_interval(df.withColumn("v", F.col("id") + 1), F.col("v"), ["id"], draws=200).first()
    assert m["observed"] == 25.5 and m["low"] < 25.5 < m["high"]
    none = B.mean_interval(df.where("id < 0"), F.col("hit"), ["id"], draws=10).first()
    assert none["observed"] is None and none["low"] is None
    idx = [r["index"] for r in B.dense_index(df, [F.col("id")]).collect()]
    assert sorted(idx) == list(range(50))


def test_population_growth_is_scaled_to_official_totals(spark):
    cp = spark.createDataFrame([(1, 1000, 1100, 1300), (2, 500, 450, 400), (3, 2000, 2500, 3100)], "place bigint, a bigint, b bigint, c bigint")
    totals = spark.createDataFrame([(2017, 4100.0), (2018, 4300.0), (2023, 5000.0), (2024, 5100.0), (2025, 5200.0)], "epi_year int, total double")
    anchors = cp.select("place", F.col("b").alias("p0"), F.col("c").alias("p1"))
    g = Pop.scaled_growth(anchors, 2017, 2022, [2018, 2019], totals)
    sums = dict(rows(g.groupBy("epi_year").agg(F.round(F.sum("population"), 6))))
    assert sums[2018] == 4300.0
    r = [1100 * (1300 / 1100) ** 0.4, 450 * (400 / 450) ** 0.4, 2500 * (3100 / 2500) ** 0.4]
    assert abs(sums[2019] - sum(r)) < 1e-6  # no official total: factor 1
    proj = Pop.projections(cp, ("a", 2010), ("b", 2017), ("c", 2022), [2023, 2024, 2025], totals)
    assert {round(v, 6) for _, _, v in rows(proj.groupBy("method", "epi_year").agg(F.sum("population")))} == {5000.0, 5100.0, 5200.0}
    best = Pop.steadiest_method(Pop.growth_dispersion(proj)).first()["method"]
    assert best == "fixed_share"
    held = Pop.hold_out(cp, ("a", 2010), ("b", 2017), ("c", 2022), totals)
    pre = {p: a * (c / a) ** (7 / 12) for p, a, _, c in [(1, 1000, 0, 1300), (2, 500, 0, 400), (3, 2000, 0, 3100)]}
    f = 4100 / sum(pre.values())
    assert abs(held.where("place = 1").first()["predicted"] - pre[1] * f) < 1e-6
    rep = Pop.perturbed(spark.createDataFrame([(1, 2020, 100, "projecao"), (1, 2010, 90, "censo")], "place bigint, epi_year int, population bigint, population_type string"), Pop.signed_errors(held), replicas=3)
    assert rep.where("population_type = 'censo' and population <> 90").count() == 0 and rep.count() == 6


GOOD = "place bigint, place_name string, kind string, epi_year int, epi_week int, week_start date, week_end date, cases bigint, rain_week double, cell_humidity double"


def valid_table(spark):
    import datetime as dt

    data = [(p, f"B{p}", k, 2024, w, dt.date(2024, 1, 7 * w), dt.date(2024, 1, 7 * w + 6), 1, 0.0, 80.0) for p in range(94) for k in ("CHIKUNGUNYA", "DENGUE", "ZIKA") for w in (1, 2)]
    return spark.createDataFrame(data, GOOD)


@pytest.mark.parametrize(
    "gate,change",
    [
        ("gold_casos_nao_negativos", {"cases": "if(place = 3, -1, cases)"}),
        ("gold_casos_sem_nulo", {"cases": "if(place = 3, null, cases)"}),
        ("gold_semana_valida", {"epi_week": "if(place = 3, 54, epi_week)"}),
        ("gold_semana_tem_7_dias", {"week_end": "if(place = 3, date_add(week_end, 1), week_end)"}),
        ("gold_datas_coerentes", {"week_end": "if(place = 3, date_sub(week_start, 1), week_end)"}),
        ("clima_nao_negativo:rain_week", {"rain_week": "if(place = 3, -0.5d, rain_week)"}),
        ("umidade_intervalo:cell_humidity", {"cell_humidity": "if(place = 3, 101d, cell_humidity)"}),
        ("gold_chave_unica", {"epi_week": "if(place = 3, 1, epi_week)"}),
        ("gold_n_bairros", {"place": "if(place = 3, 4, place)"}),
        ("gold_integridade_territorio:sobrando", {"place": "if(place = 3, 999, place)"}),
        ("gold_agravos", {"kind": "if(kind = 'ZIKA', 'MAYARO', kind)"}),
    ],
)
def test_each_gate_finds_its_fault(spark, gate, change):
    good = valid_table(spark)
    land = spark.range(94).toDF("place")
    kinds = ("DENGUE", "ZIKA", "CHIKUNGUNYA")
    if gate == "gold_casos_nao_negativos":
        assert gates.gate_findings(good, land, 94, kinds).count() == 0
        gates.require_approval(gates.gate_findings(good, None, 94, kinds))  # a warning does not stop
    bad = good.withColumns({k: F.expr(v) for k, v in change.items()})
    found = {r["gate"] for r in gates.gate_findings(bad, land, 94, kinds).collect()}
    assert gate in found
    with pytest.raises(gates.QualityGateError):
        gates.require_approval(gates.gate_findings(bad, land, 94, kinds))


def test_freshness_is_never_current_by_default(spark):
    ref = F.lit("2024-02-01").cast("date")
    s = spark.range(1).select(gates.lag_status(F.lit(None).cast("date"), F.lit("clima_grade"), ref).alias("a"), gates.lag_status(F.lit("2024-01-10").cast("date"), F.lit("clima_grade"), ref).alias("b"), gates.lag_status(F.lit("2023-01-01").cast("date"), F.lit("x"), ref).alias("c")).first()
    assert tuple(s["a"]) == (None, 30, "DESCONHECIDO") and tuple(s["b"]) == (22, 30, "ATUAL") and tuple(s["c"]) == (396, 120, "ATRASADO")
    fresh = gates.freshness(valid_table(spark), ref)
    assert gates.current_period(fresh).first()["available"] is True
    assert gates.current_period(gates.freshness(valid_table(spark), F.lit("2024-06-01").cast("date"))).first()["reason"] == "epidemiological_data_stale"


def test_star_checks_find_orphans(spark):
    g = valid_table(spark).withColumns({"region": F.lit(1), "area_km2": F.lit(1.0), "lat": F.lit(0.0), "lon": F.lit(0.0)})
    places, weeks, kinds = star.place_dimension(g), star.week_dimension(g), star.kind_dimension(g)
    ok = star.star_checks(places, weeks, kinds, {"f": (star.weekly_fact(g), ["week_id", "place", "kind"])}, 94)
    star.require_star(ok)
    bad = star.star_checks(places.where("place <> 3"), weeks, kinds, {"f": (star.weekly_fact(g).withColumn("risk_p", F.lit(1)), ["week_id", "place", "kind"])}, 94)
    with pytest.raises(ValueError, match="place known=1"):
        star.require_star(bad)
    doc = spark.createDataFrame([("2024", {"a": (1, "x"), "b": (2, "y")})], "gerado_em string, datasets map<string, struct<lag:int,detalhe:string>>")
    assert sorted(rows(star.freshness_table(doc))) == [("a", 1, "2024"), ("b", 2, "2024")]
