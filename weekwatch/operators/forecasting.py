"""Yearly forecast of weekly series: three seasonal rules, Holt-Winters, backtest, bands, projection.

A fold is the last training year; its target is the next year. All series, folds and methods are
rows of one job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weekwatch.functions import dates

SEASON = 52
METHODS = ("seasonal_naive", "week_mean", "trend_season", "holt_winters")
# Smoothing weights tried by the grid search.
GRID = (0.05, 0.2, 0.5)
LEVELS = {"80": (0.10, 0.90), "95": (0.025, 0.975)}

Series = ["kind", "fold"]


def in_folds(series: DataFrame, folds: Sequence[int]) -> DataFrame:
    """Training rows of every fold."""
    marks = F.array(*[F.lit(f) for f in folds])
    return series.withColumn("fold", F.explode(F.filter(marks, lambda f: f >= F.col("epi_year"))))


def observed_targets(series: DataFrame, folds: Sequence[int]) -> DataFrame:
    """Rows of the year after each fold, with their step 1, 2, ... in week order."""
    order = W.partitionBy(*Series).orderBy("epi_week")
    rows = series.where((F.col("epi_year") - 1).isin(*folds)).withColumn("fold", F.col("epi_year") - 1)
    return rows.select("kind", "fold", "epi_year", "epi_week", "week_start", F.col("cases").cast("double").alias("actual")).withColumn(
        "step", F.row_number().over(order)
    )


def future_targets(series: DataFrame) -> DataFrame:
    """Every week of the year after each series' last one."""
    last = series.groupBy("kind").agg(F.max("epi_year").cast("int").alias("fold"))
    year = F.col("fold") + 1
    return last.withColumn("epi_week", F.explode(F.sequence(F.lit(1), dates.weeks_in_year(year)))).select(
        "kind", "fold", year.alias("epi_year"), "epi_week", dates.week_start(year, F.col("epi_week")).alias("week_start"),
        F.lit(None).cast("double").alias("actual"), F.col("epi_week").alias("step"),
    )


def rule_forecasts(train: DataFrame, targets: DataFrame) -> DataFrame:
    """Long (kind, fold, method, week, step, actual, predicted) of the three seasonal rules.

    Same week of the last year; mean of the week; linear trend plus the week's mean residual.
    A week without history takes the overall mean (the trend: residual 0); the floor is 0.
    """
    x, y = F.col("series_index").cast("double"), F.col("cases").cast("double")
    whole = train.groupBy(*Series).agg(
        F.avg(y).alias("_mean"), F.max("series_index").alias("_last"), F.max("epi_year").alias("_year"),
        F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_cut"),
    )
    rows = train.join(whole, Series)
    weekly = rows.groupBy(*Series, "epi_week").agg(
        F.max(F.when(F.col("epi_year") == F.col("_year"), y)).alias("_naive"),
        F.avg(y).alias("_week"),
        F.avg(y - (F.col("_slope") * x + F.col("_cut"))).alias("_resid"),
    )
    t = targets.join(whole, Series).join(weekly, [*Series, "epi_week"], "left")
    trend = F.col("_slope") * (F.col("_last") + F.col("step")) + F.col("_cut") + F.coalesce("_resid", F.lit(0.0))
    values = {"seasonal_naive": F.coalesce("_naive", "_mean"), "week_mean": F.coalesce("_week", "_mean"), "trend_season": trend}
    return _long(t, values)


def _long(t: DataFrame, values: dict[str, Column]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(m).alias("method"), F.greatest(v, F.lit(0.0)).alias("predicted")) for m, v in values.items()])
    return t.select(*Series, "epi_year", "epi_week", "week_start", "step", "actual", F.explode(items).alias("_i")).select(
        *Series, "_i.method", "epi_year", "epi_week", "week_start", "step", "actual", "_i.predicted"
    )


def holt_winters(train: DataFrame, grid: Sequence[float] = GRID, season: int = SEASON) -> DataFrame:
    """Additive trend and season per (kind, fold): the weights with the least squared error, and the last states.

    One fold over the sorted series per weight triple. A series is calendar-sized (52 values a
    year), so its array is bounded. Fewer than two seasons give no row.
    """
    ys = F.transform(F.array_sort(F.collect_list(F.struct("series_index", F.col("cases").cast("double").alias("y")))), lambda s: s["y"])
    series = train.groupBy(*Series).agg(ys.alias("y")).where(F.size("y") >= 2 * season)
    weights = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(g).alias("g")) for a in grid for b in grid for g in grid])
    tried = series.withColumn("w", F.explode(weights))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)
    head = F.slice("y", 1, season)
    first, second = total(head) / season, total(F.slice("y", season + 1, season)) / season
    init = F.struct(
        first.alias("l"), ((second - first) / season).alias("b"), F.transform(head, lambda v: v - first).alias("s"), F.lit(0.0).alias("e")
    )

    def step(acc: Column, y: Column) -> Column:
        a, b, g = F.col("w.a"), F.col("w.b"), F.col("w.g")
        s0 = acc["s"][0]
        base = acc["l"] + acc["b"]
        err = y - base - s0
        return F.struct(
            (base + a * err).alias("l"), (acc["b"] + a * b * err).alias("b"),
            F.concat(F.slice(acc["s"], 2, season - 1), F.array(s0 + g * err)).alias("s"), (acc["e"] + err * err).alias("e"),
        )

    fitted = tried.withColumn("f", F.aggregate("y", init, step))
    return (
        fitted.groupBy(*Series)
        .agg(F.min_by(F.struct("w", "f", F.size("y").alias("n")), F.struct("f.e", "w")).alias("m"))
        .select(*Series, "m.w", "m.f", (F.sqrt(F.col("m.f.e") / F.col("m.n"))).alias("sigma"))
    )


def holt_winters_forecasts(train: DataFrame, targets: DataFrame, grid: Sequence[float] = GRID, season: int = SEASON) -> DataFrame:
    fit = holt_winters(train, grid, season)
    t = targets.join(fit.select(*Series, "f"), Series)
    at = ((F.col("step") - 1) % season).cast("int")
    value = F.col("f.l") + F.col("step") * F.col("f.b") + F.get(F.col("f.s"), at)
    return _long(t, {"holt_winters": value})


def custom_forecasts(train: DataFrame, targets: DataFrame, name: str, model: Callable) -> DataFrame:
    """A user's model(train_frame, target_frame) -> values, one series and fold at a time in its own task.

    A model that raises, or that gives another number of values than there are weeks, costs its own fold only: one row of
    nulls with the `reason`.
    """
    import pandas as pd

    columns = ["kind", "fold", "method", "epi_year", "epi_week", "week_start", "step", "actual", "predicted", "reason"]
    schema = "kind string, fold int, method string, epi_year int, epi_week int, week_start date, step int, actual double, predicted double, reason string"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["_train"]], rows[~rows["_train"]]
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        right = right.sort_values("epi_week")
        try:
            values = [max(0.0, float(v)) for v in model(left.sort_values("series_index"), right)]
            if len(values) != len(right):
                raise ValueError(f"{len(values)} values for {len(right)} weeks")
        except Exception as error:  # noqa: BLE001 - whatever the user's code raises is what is reported
            first = right.iloc[0]
            known = {"kind": first["kind"], "fold": int(first["fold"]), "method": name, "reason": f"{type(error).__name__}: {error}"}
            return pd.DataFrame([[known.get(c) for c in columns]], columns=columns, dtype=object)
        return right.assign(method=name, predicted=values, reason=None)[columns]

    both = train.withColumn("_train", F.lit(True)).unionByName(targets.withColumn("_train", F.lit(False)), allowMissingColumns=True)
    return both.groupBy(*Series).applyInPandas(run, schema)


def all_forecasts(series: DataFrame, folds: Sequence[int], with_holt_winters: bool = True) -> DataFrame:
    train, targets = in_folds(series, folds), observed_targets(series, folds)
    out = rule_forecasts(train, targets)
    return out.unionByName(holt_winters_forecasts(train, targets)) if with_holt_winters else out


def failed_folds(forecasts: DataFrame) -> DataFrame:
    """(kind, fold, method, target_year, reason) of the folds that a user's model left without values."""
    return forecasts.where(F.col("reason").isNotNull()).select(*Series, "method", (F.col("fold") + 1).alias("target_year"), "reason")


def backtest(forecasts: DataFrame) -> DataFrame:
    """Per series, fold and method: MAE, RMSE, MASE against the naive rule, peak week and size errors.

    MASE is null when the naive rule is perfect; peaks take the earlier week on ties.
    """
    err = F.col("actual") - F.col("predicted")
    peak = lambda c: F.max_by(F.struct("step", "epi_week", F.col(c).alias("v")), F.struct(F.rint(F.col(c) * 1e9), -F.col("step")))
    m = forecasts.where(F.col("actual").isNotNull()).groupBy(*Series, "method").agg(
        F.count(F.lit(1)).alias("n_weeks"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        peak("actual").alias("_o"), peak("predicted").alias("_p"),
    )
    naive = F.max(F.when(F.col("method") == "seasonal_naive", F.col("mae"))).over(W.partitionBy(*Series))
    return m.withColumn("mase", F.when(naive > 0, F.col("mae") / naive)).select(
        *Series, "method", (F.col("fold") + 1).alias("target_year"), "n_weeks", "mae", "rmse", "mase",
        F.col("_o.epi_week").alias("peak_week"), F.col("_p.epi_week").alias("peak_week_predicted"),
        (F.col("_p.step") - F.col("_o.step")).alias("peak_shift"), (F.col("_p.v") - F.col("_o.v")).alias("peak_size_error"),
    )


def coverage_left_out(forecasts: DataFrame, folds: Sequence[int]) -> DataFrame:
    """Share of a fold's errors inside the band of the other folds' errors.

    Every error is sent to the other folds (a handful), where the quantiles are taken.
    """
    errors = forecasts.where(F.col("actual").isNotNull()).select(*Series, "method", (F.col("actual") - F.col("predicted")).alias("err"))
    marks = F.array(*[F.lit(f) for f in folds])
    others = errors.withColumn("fold", F.explode(F.filter(marks, lambda f: f != F.col("fold"))))
    probs = [p for lohi in LEVELS.values() for p in lohi]
    bands = others.groupBy(*Series, "method").agg(F.percentile("err", probs).alias("q"), F.count(F.lit(1)).alias("n_other"))
    j = errors.join(bands, [*Series, "method"], "left")
    enough = F.max("n_other") >= 2
    aggs = [
        F.when(enough, F.avg(F.col("err").between(F.get("q", F.lit(2 * i)), F.get("q", F.lit(2 * i + 1))).cast("int"))).alias(f"coverage_{name}")
        for i, name in enumerate(LEVELS)
    ]
    return j.groupBy(*Series, "method").agg(*aggs)


def interval_coverage(df: DataFrame, actual: str, low: str, high: str) -> DataFrame:
    return df.agg(F.avg(F.col(actual).between(F.col(low), F.col(high)).cast("int")).alias("coverage"))


def method_summary(table: DataFrame) -> DataFrame:
    ok = F.col("mase").isNotNull()
    return table.groupBy("kind", "method").agg(
        F.count_if(ok).alias("n_folds"), F.percentile("mase", 0.5).alias("mase_median"),
        F.percentile(F.when(ok, F.abs("peak_shift")), 0.5).alias("shift_median"),
    )


def choose_method(summary: DataFrame) -> DataFrame:
    """Lowest median MASE, then lowest median peak shift, then the order of METHODS."""
    order = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    key = F.struct(F.rint(F.col("mase_median") * 1e9), F.coalesce("shift_median", F.lit(1e18)), order)
    return summary.where(F.col("mase_median").isNotNull()).groupBy("kind").agg(F.min_by("method", key).alias("method"))


def empirical_bands(central: DataFrame, errors: DataFrame) -> DataFrame:
    """Central value plus the quantiles of past errors; with fewer than two errors the band is the value."""
    probs = [p for lohi in LEVELS.values() for p in lohi]
    q = errors.groupBy("kind", "method").agg(F.percentile("err", probs).alias("q"), F.count(F.lit(1)).alias("n_err"))
    t = central.join(q, ["kind", "method"], "left")
    enough = F.coalesce("n_err", F.lit(0)) >= 2
    cols = {}
    for i, name in enumerate(LEVELS):
        lo, hi = F.get("q", F.lit(2 * i)), F.get("q", F.lit(2 * i + 1))
        cols[f"low_{name}"] = F.greatest(F.lit(0.0), F.col("predicted") + F.when(enough, lo).otherwise(0.0))
        cols[f"high_{name}"] = F.col("predicted") + F.when(enough, hi).otherwise(0.0)
    return t.withColumns(cols).drop("q", "n_err")


def simulated_bands(fit: DataFrame, steps: int, paths: int = 1000, seed: int = 42, season: int = SEASON) -> DataFrame:
    """Quantiles of simulated Holt-Winters paths, per (kind, fold, step).

    Normal draws come from hashes of (seed, series, path, step) by Box-Muller: the same for any
    partitioning.
    """
    def uniform(tag: int, i: Column) -> Column:
        h = F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), F.col("kind"), F.col("fold"), F.col("path"), i), F.lit(2**31))
        return (h + 1) / F.lit(float(2**31 + 1))

    def step(acc: Column, i: Column) -> Column:
        a, b, g = F.col("w.a"), F.col("w.b"), F.col("w.g")
        e = F.sqrt(-2 * F.ln(uniform(1, i))) * F.cos(2 * F.pi() * uniform(2, i)) * F.col("sigma")
        base, s0 = acc["l"] + acc["b"], acc["s"][0]
        return F.struct(
            (base + a * e).alias("l"), (acc["b"] + a * b * e).alias("b"),
            F.concat(F.slice(acc["s"], 2, season - 1), F.array(s0 + g * e)).alias("s"),
            F.concat(acc["y"], F.array(F.greatest(F.lit(0.0), base + s0 + e))).alias("y"),
        )

    start = F.struct(F.col("f.l").alias("l"), F.col("f.b").alias("b"), F.col("f.s").alias("s"), F.array().cast("array<double>").alias("y"))
    runs = fit.withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(paths))))
    ys = runs.select(*Series, F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["y"]).alias("pos", "v"))
    probs = [p for lohi in LEVELS.values() for p in lohi]
    q = ys.groupBy(*Series, (F.col("pos") + 1).alias("step")).agg(F.percentile("v", probs).alias("q"))
    names = [f"{side}_{name}" for name in LEVELS for side in ("low", "high")]
    return q.select(*Series, "step", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)])


BANDS = tuple(f"{side}_{name}" for name in LEVELS for side in ("low", "high"))


def projection(series: DataFrame, folds: Sequence[int], with_holt_winters: bool = True) -> DataFrame:
    """Next year per kind by the method that won its backtest, with 80 and 95 % bands, in whole cases."""
    past = all_forecasts(series, folds, with_holt_winters)
    winner = choose_method(method_summary(backtest(past)))
    last = series.groupBy("kind").agg(F.max("epi_year").cast("int").alias("fold"))
    train = series.join(last, "kind")
    targets = future_targets(series)
    future = rule_forecasts(train, targets)
    if with_holt_winters:
        future = future.unionByName(holt_winters_forecasts(train, targets))
    chosen = future.join(winner, ["kind", "method"], "left_semi")
    errors = past.join(winner, ["kind", "method"], "left_semi").select("kind", "method", (F.col("actual") - F.col("predicted")).alias("err"))
    out = empirical_bands(chosen, errors)
    if with_holt_winters:
        sim = simulated_bands(holt_winters(train), 53).select(*Series, "step", *[F.col(c).alias(f"_{c}") for c in BANDS])
        out = out.join(sim, [*Series, "step"], "left")
        hw = F.col("method") == "holt_winters"
        out = out.withColumns({c: F.when(hw & F.col(f"_{c}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in BANDS}).drop(*[f"_{c}" for c in BANDS])
    whole = {c: F.rint(c).cast("bigint") for c in BANDS}
    return out.withColumns({"cases": F.rint("predicted").cast("bigint"), **whole}).select(
        "kind", "method", "epi_year", "epi_week", "week_start", "cases", *BANDS
    )


def observed_and_projected(series: DataFrame, projected: DataFrame) -> DataFrame:
    """One artefact: observed weeks without bands, projected weeks with them."""
    cols = ["kind", "epi_year", "epi_week", "week_start", "is_observed", "cases", *BANDS]
    obs = series.withColumn("is_observed", F.lit(True)).withColumns({c: F.lit(None).cast("bigint") for c in BANDS})
    return obs.select(*cols).unionByName(projected.withColumn("is_observed", F.lit(False)).select(*cols))


def expected_peak(projected: DataFrame) -> DataFrame:
    """Per kind: the projected peak week (earliest on ties) and its size."""
    return projected.groupBy("kind").agg(
        F.max_by(F.struct("epi_week", "cases", "week_start"), F.struct("cases", -F.col("epi_week"))).alias("p")
    ).select("kind", "p.*")


def comparable_mean(series: DataFrame, projected: DataFrame) -> DataFrame:
    """Mean over the projected weeks of the historical mean of the same week."""
    weekly = series.groupBy("kind", "epi_week").agg(F.avg("cases").alias("m"))
    return projected.select("kind", "epi_week").join(weekly, ["kind", "epi_week"], "left").groupBy("kind").agg(F.avg("m").alias("comparable_mean"))
