import datetime as dt
import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weekwatch.operators import forecasting as M, learning as L, model_store
from weekwatch.streaming import readings as SR, weekly as SW


def series(spark, fn, years=range(2018, 2023), weeks=10):
    data, i = [], 0
    for y in years:
        for w in range(1, weeks + 1):
            data.append(("D", y, w, dt.date(y, 1, 1) + dt.timedelta(days=7 * w), i, int(fn(i, y, w))))
            i += 1
    return spark.createDataFrame(data, "kind string, epi_year int, epi_week int, week_start date, series_index int, cases bigint")


def test_perfect_naive_gives_no_mase(spark):
    s = series(spark, lambda i, y, w: w * 2)
    b = M.backtest(M.all_forecasts(s, (2020, 2021), with_holt_winters=False))
    assert b.where("method = 'seasonal_naive'").select(F.max("mae")).first()[0] == 0.0
    assert b.where("mase is not null").count() == 0
    assert M.choose_method(M.method_summary(b)).count() == 0


def test_rules_on_a_trended_series(spark):
    s = series(spark, lambda i, y, w: 3 * i + w)
    f = {(r["method"], r["epi_week"]): r["predicted"] for r in M.all_forecasts(s, (2021,), with_holt_winters=False).collect()}
    assert f[("seasonal_naive", 1)] == 3 * 30 + 1
    assert f[("week_mean", 2)] == sum(3 * (10 * k + 1) + 2 for k in range(4)) / 4
    assert M.choose_method(M.method_summary(M.backtest(M.all_forecasts(s, (2020, 2021), with_holt_winters=False)))).first()["method"] == "trend_season"


def test_no_target_year_value_reaches_its_forecast(spark):
    a = series(spark, lambda i, y, w: 3 + w)
    b = series(spark, lambda i, y, w: 3 + w if y < 2022 else 9999)
    get = lambda s: rows(M.all_forecasts(s, (2021,), False).select("method", "epi_week", "predicted"), "method", "epi_week")
    assert get(a) == get(b)


def brute_holt(ys, m, grid):
    best = None
    l0 = sum(ys[:m]) / m
    b0 = (sum(ys[m : 2 * m]) / m - l0) / m
    for a, b, g in itertools.product(grid, repeat=3):
        lv, tr, s, sse = l0, b0, [v - l0 for v in ys[:m]], 0.0
        for y in ys:
            base, s0 = lv + tr, s[0]
            e = y - base - s0
            lv, tr, s, sse = base + a * e, tr + a * b * e, s[1:] + [s0 + g * e], sse + e * e
        key = (sse, (a, b, g))
        if best is None or key < best[0]:
            best = (key, lv, tr, s)
    return best


def test_holt_winters_against_brute_force(spark):
    rnd = random.Random(11)
    s = series(spark, lambda i, y, w: 20 + 5 * (w % 4) + i // 5 + rnd.randrange(0, 4))
    ys = [float(r["cases"]) for r in s.orderBy("series_index").collect()]
    fit = M.holt_winters(M.in_folds(s, (2022,)), season=10).first()
    key, lv, tr, st = brute_holt(ys, 10, M.GRID)
    assert tuple(fit["w"]) == key[1] and abs(fit["f"]["l"] - lv) < 1e-9 and abs(fit["f"]["b"] - tr) < 1e-9
    assert max(abs(p - q) for p, q in zip(fit["f"]["s"], st)) < 1e-9
    short = M.holt_winters(M.in_folds(s.where("epi_year = 2018"), (2022,)), season=10)
    assert short.count() == 0
    bands = M.simulated_bands(M.holt_winters(M.in_folds(s, (2022,)), season=10), 5, paths=50, season=10)
    assert bands.count() == 5 and bands.where("low_95 > low_80 or low_80 > high_80 or high_80 > high_95").count() == 0


def test_projection_bands_and_artefact(spark):
    rnd = random.Random(12)
    s = series(spark, lambda i, y, w: 10 + w + rnd.randrange(0, 5))
    p = M.projection(s, (2020, 2021), with_holt_winters=False)
    assert p.count() == 52 and p.where("low_95 > low_80 or high_80 > high_95 or low_80 < 0").count() == 0
    both = M.observed_and_projected(s, p)
    assert both.where("is_observed").count() == 50 and both.where("is_observed and low_80 is not null").count() == 0
    one = p.limit(1).withColumns({"method": F.lit("x"), "predicted": F.lit(7.0)}).select("kind", "method", "predicted")
    lonely = M.empirical_bands(one, spark.createDataFrame([("D", "x", 3.0)], "kind string, method string, err double")).first()
    assert (lonely["low_80"], lonely["high_95"]) == (7.0, 7.0)


def test_user_model_hook(spark):
    s = series(spark, lambda i, y, w: w)
    f = M.custom_forecasts(M.in_folds(s, (2021,)), M.observed_targets(s, (2021,)), "last_value", lambda train, target: [train["cases"].iloc[-1]] * len(target))
    assert f.count() == 10 and f.select("predicted").distinct().collect()[0][0] == 10.0


def toy(spark, n=400):
    rnd = random.Random(6)
    data = []
    for i in range(n):
        x, z = rnd.gauss(0, 1), rnd.gauss(0, 1)
        data.append((i, 2015 + i % 6, x, z if i % 10 else None, int(x + rnd.gauss(0, 0.3) > 0.5)))
    return spark.createDataFrame(data, "id int, epi_year int, x double, z double, label int")


def test_settings_and_folds_side_by_side(spark):
    df, names, years = toy(spark).dropna(), ["x", "z"], range(2014, 2022)
    grid = [{"maxIter": 1, "maxDepth": 1}, {"maxIter": 3, "maxDepth": 2}]
    models = L.walk_forward_models(df, names, years, grid, L.fit_trees, parallel=3)
    assert [m[:2] for m in models] == [(i, y) for i in (0, 1) for y in range(2016, 2021)]
    scored = L.fold_scores(df, names, models)
    # every model alone gives the same rows, and knows no later year
    one = L.predict(L.fit_trees(df.where("epi_year < 2018"), names, **grid[1]), df.where("epi_year = 2018"), names)
    both = scored.where("setting = 1 and fold = 2018").select("id", "probability").exceptAll(one.select("id", "probability"))
    assert both.isEmpty() and scored.where("epi_year <> fold").isEmpty()
    table = {r.setting: r for r in L.grid_table(scored, grid).collect()}
    ap = L.walk_forward_table(scored.where("setting = 0"))
    want = L.fold_spread(ap).first()
    assert table[0].median == pytest.approx(want.median) and table[0].min == pytest.approx(want.min) and table[0].n_folds == 5
    assert [table[i].best for i in (0, 1)] == [table[0].median >= table[1].median, table[0].median < table[1].median]
    assert "maxDepth" in table[1].params
    with pytest.raises(ZeroDivisionError):
        L.side_by_side(spark, [lambda: 1, lambda: 1 // 0])
    stable = {r.feature: r for r in L.importance_stability(L.importance_by_fold(df, names, ["id"], models[5:], repeats=2)).collect()}
    assert stable["x"].n_folds == 5 and stable["x"].min <= stable["x"].mean <= stable["x"].max and stable["x"].mean > stable["z"].mean


def test_paired_hits_and_decision(spark):
    eps = spark.createDataFrame([(p, "D", 10, 2000 + p % 2) for p in range(8)] + [(99, "D", 3, 2001)], "place int, kind string, start_index int, start_year int")
    rows = [(v, p, "D", w, float((p if v == "b" else -p) + (w == 9))) for v in "ab" for p in range(8) for w in (5, 7, 9, 10)]
    scored = spark.createDataFrame(rows, "variant string, place int, kind string, week_index int, probability double")
    hits = {r.place: r for r in L.paired_hits(scored, eps, ks=(2, 4)).collect()}
    assert len(hits) == 9 and (hits[99].a_hit_4, hits[99].b_hit_4) == (0, 0)
    for p in range(8):
        assert (hits[p].a_hit_2, hits[p].b_hit_2, hits[p].a_hit_4, hits[p].b_hit_4) == (p < 2, p > 5, p < 4, p > 3)
    wins = spark.createDataFrame([(i, 2000 + i % 2, 0, 1) for i in range(30)], "place int, start_year int, a int, b int")
    won = L.paired_decision(wins, "a", "b", ["place"], draws=50).first()
    assert (won.observed, won.low, won.adopt) == (1.0, 1.0, True)
    mixed = wins.withColumn("b", F.when(F.col("start_year") == 2001, 0).otherwise(1))
    assert not L.paired_decision(mixed, "a", "b", ["place"], draws=50).first().adopt


def test_models_weights_calibration_importance_and_store(spark, tmp_path):
    df = toy(spark)
    w = L.balanced(df).groupBy("label").agg(F.sum("weight")).collect()
    assert abs(w[0][1] - w[1][1]) < 1e-6
    full = df.dropna()
    logit = L.fit_logistic(full, ["x", "z"], 50)
    scored = L.predict(logit, full, ["x", "z"])
    assert scored.columns == [*full.columns, "probability"]
    trees = L.fit_trees(df, ["x", "z"], maxIter=3, maxDepth=2)  # nulls are imputed and flagged
    assert L.predict(trees, df, ["x", "z"]).where("probability is null").count() == 0
    for method in ("sigmoid", "isotonic"):
        cal = L.calibrate(scored, method=method)(scored)
        assert cal.where("calibrated < 0 or calibrated > 1").count() == 0
    imp = {r["feature"]: r["importance_mean"] for r in L.permutation_importance(logit, full, ["x", "z"], ["id"], repeats=2).collect()}
    assert imp["x"] > 0.1 > abs(imp["z"])
    mixed = L.permuted(full, ["x", "z"], ["id"], 2, 1).where("feature = 'x'")
    for sums in mixed.groupBy("repeat").agg(F.sum("x").alias("x"), F.sum("z").alias("z"), F.count("*").alias("n")).collect():
        plain = full.agg(F.sum("x").alias("x"), F.sum("z").alias("z"), F.count("*").alias("n")).first()
        assert (sums.x, sums.z, sums.n) == (pytest.approx(plain.x), pytest.approx(plain.z), plain.n)
    assert mixed.where("repeat = 0").join(full.selectExpr("id", "x as own"), "id").where("x <> own").count() > 0
    wf = L.walk_forward_scores(full, ["x", "z"], range(2014, 2022), L.fit_logistic, max_iter=20)
    assert sorted(r[0] for r in wf.select("fold").distinct().collect()) == [2016, 2017, 2018, 2019, 2020]
    with pytest.raises(L.DifferentRows):
        L.require_same_rows(full, full.where("id > 5"), ["id"])

    base, known = str(tmp_path), ("v1",)
    model_store.save(spark, logit, base, "v1", ["x", "z"], "1.2", {"trained_until": 2019}, known)
    model, meta = model_store.load(spark, base, "v1", ["x", "z"], "1.2", known)
    assert meta["trained_until"] == 2019 and L.predict(model, full, ["x", "z"]).count() == full.count()
    for bad in (dict(names=["z", "x"]), dict(table_version="1.1")):
        with pytest.raises(model_store.IncompatibleModel):
            model_store.load(spark, base, "v1", known=known, **bad)
    with pytest.raises(model_store.MissingModel):
        model_store.metadata(spark, base + "/none", "v1", known)
    with pytest.raises(ValueError):
        model_store.model_path(base, "../v1", known)


def put(spark, path, items):
    spark.createDataFrame(items, "station string, ts timestamp, rain double, run string").coalesce(1).write.mode("append").parquet(path)


T0 = dt.datetime(2024, 1, 1)


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    put(spark, src, [("a", T0 + dt.timedelta(hours=h), 1.0 if h % 3 else None, "r") for h in range(60)])
    stream = lambda: SR.daily_readings(spark.readStream.schema("station string, ts timestamp, rain double, run string").parquet(src), "1 day")
    SR.run_available(stream(), out, ck)
    first = rows(spark.read.parquet(out), "day")
    assert first == [("a", dt.date(2024, 1, 1), 16.0, 16)]
    put(spark, src, [("a", T0 + dt.timedelta(days=8), 1.0, "r"), ("a", T0 + dt.timedelta(days=1, hours=23, minutes=30), 5.0, "late")])
    SR.run_available(stream(), out, ck)
    got = {r[1]: r[2] for r in rows(spark.read.parquet(out))}
    assert got[dt.date(2024, 1, 2)] == 16.0 + 5.0 and got[dt.date(2024, 1, 3)] == 8.0


def test_overlapping_snapshots(spark, tmp_path):
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    schema = "station string, ts timestamp, rain double, run string"
    put(spark, src, [("a", T0, 1.0, "r1"), ("a", T0, 1.5, "r1b"), ("b", T0, 2.0, "r1")])
    first = SR.first_of_key(spark.readStream.schema(schema).parquet(src), ["station", "ts"])
    SR.run_available(first, str(tmp_path / "first"), ck + "1")
    assert spark.read.parquet(str(tmp_path / "first")).count() == 2

    table = str(tmp_path / "latest")
    readings = lambda: spark.readStream.schema(schema).parquet(src).withColumn("day", F.to_date("ts").cast("string"))
    SR.merge_latest(readings(), table, ["station", "ts"], ["run"], "day", ck + "2").awaitTermination()
    put(spark, src, [("a", T0, 9.0, "r2"), ("c", T0 + dt.timedelta(days=1), 3.0, "r2")])
    SR.merge_latest(readings(), table, ["station", "ts"], ["run"], "day", ck + "2").awaitTermination()
    assert sorted((r["station"], r["rain"]) for r in spark.read.parquet(table).collect()) == [("a", 9.0), ("b", 2.0), ("c", 3.0)]


def test_weekly_windows_start_on_sundays_and_episodes_stay_open(spark, tmp_path):
    src = str(tmp_path / "weeks")
    sunday = dt.date(2024, 1, 7)
    wk = lambda i, c, h: (1, "D", sunday + dt.timedelta(days=7 * i), c, h)
    schema = "place bigint, kind string, week_start date, cases bigint, high boolean"
    run = lambda: SR.run_available(SW.closed_episodes(spark.readStream.schema(schema).parquet(src)), str(tmp_path / "eps"), str(tmp_path / "ck"))
    spark.createDataFrame([wk(0, 1, False), wk(1, 5, True), wk(2, 8, True)], schema).coalesce(1).write.parquet(src)
    run()
    assert spark.read.schema(SW.EPISODE_SCHEMA).parquet(str(tmp_path / "eps")).count() == 0
    spark.createDataFrame([wk(3, 7, True), wk(4, 0, False), wk(5, 6, True), wk(7, 6, True)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    got = rows(spark.read.schema(SW.EPISODE_SCHEMA).parquet(str(tmp_path / "eps")).select("start_week", "end_week", "weeks", "total_cases", "peak_cases"), "start_week")
    assert got == [(sunday + dt.timedelta(days=7), sunday + dt.timedelta(days=21), 3, 20, 8), (sunday + dt.timedelta(days=35),) * 2 + (1, 6, 6)]

    ev = str(tmp_path / "ev")
    spark.createDataFrame([(1, "D", T0 + dt.timedelta(days=d)) for d in range(40)], "place bigint, kind string, ts timestamp").coalesce(1).write.parquet(ev)
    SR.run_available(SW.weekly_counts(spark.readStream.schema("place bigint, kind string, ts timestamp").parquet(ev)), str(tmp_path / "wc"), str(tmp_path / "ck3"))
    weeks = rows(spark.read.parquet(str(tmp_path / "wc")).select("week_start", "cases"), "week_start")
    assert weeks[0] == (dt.date(2023, 12, 31), 6) and weeks[1] == (sunday, 7) and all(w[0].isoweekday() == 7 for w in weeks)


def test_open_episode_is_closed_by_a_week_a_gap_or_a_timer(spark, tmp_path):
    import datetime

    from pyspark.sql.types import LongType, StructField, StructType

    schema = "place bigint, kind string, week_start timestamp, week_index int, epi_year int, epi_week int, cases bigint, state int"

    def rows(place, states, first=0):
        start = datetime.datetime(2020, 1, 5)
        return [(place, "F", start + datetime.timedelta(days=7 * (first + i)), first + i, 2020, first + i + 2, 3, s) for i, s in enumerate(states) if s != "gap"]

    src, out, ck = (str(tmp_path / x) for x in ("weeks", "table", "checkpoint"))
    batches = [
        rows(1, [0, 1, 1]) + rows(2, [1, 1, 0]) + rows(3, [1, "gap", 1]) + rows(4, [1, None, 1]),
        # place 1 reports no more, so its episode ends by time; the first row of place 2 was counted before
        rows(2, [1, 1, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1]),
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        stream = SW.episodes_so_far(spark.readStream.schema(schema).parquet(src))
        with SW.rocksdb_states(spark):
            SR.upsert_available(stream, out, ck)
    written = spark.read.schema(StructType([*stream.schema.fields, StructField(SR.EPOCH, LongType())])).parquet(out)
    got = {(r.place, r.start_index): (r.end_index, r.weeks, r.total_cases, r.open) for r in SR.newest_rows(written, ["place", "kind", "start_index"]).collect()}
    assert got == {
        (1, 1): (2, 2, 6.0, False), (2, 0): (1, 2, 6.0, False), (2, 3): (14, 12, 36.0, True), (3, 0): (0, 1, 3.0, False), (3, 2): (2, 1, 3.0, False),
        (4, 0): (0, 1, 3.0, False), (4, 2): (2, 1, 3.0, False),
    }
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_fits_read_plain_rows(spark, capsys):
    """Weights are numbers, so the plan that a fit sends to the executors holds no subquery; an empty table and one class as well."""
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "id int, label int")
    for part, want in ((df, [(1, 4 / 6), (2, 4 / 6), (3, 4 / 6), (4, 2.0)]), (df.where("label = 0"), [(i, 0.5) for i in (1, 2, 3)]), (df.where("id > 9"), [])):
        out = L.balanced(part)
        capsys.readouterr()
        out.explain()
        assert "ubquery" not in capsys.readouterr().out
        assert sorted((r.id, pytest.approx(r.weight)) for r in out.collect()) == want


def test_registered_scores_leave_the_models_behind(spark, sf, capsys):
    """The results' plans read scores as rows and hold no model."""
    from weekwatch.plans import learned

    for name in ("calibrated_brier", "walk_forward_onset"):
        out = getattr(learned, name)(spark, sf)
        capsys.readouterr()
        out.explain()
        assert "UDF" not in capsys.readouterr().out
        assert out.collect()
