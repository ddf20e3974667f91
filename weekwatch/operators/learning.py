"""Supervised data sets and MLlib models over weekly features; folds never look ahead."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from weekwatch.contracts import ONSET_HORIZONS
from weekwatch.operators import episodes as E, evaluation as V, features as X, ranking as R, threshold
from weekwatch.operators.bootstrap import dense_index, difference_interval
from weekwatch.session import cut_lineage

SEED = 42
TREES = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.1}
# fixed values: the settings that are compared
TREE_GRID = (
    {"maxDepth": 4, "stepSize": 0.1, "maxIter": 150},
    {"maxDepth": 6, "stepSize": 0.1, "maxIter": 200},
    {"maxDepth": 6, "stepSize": 0.05, "maxIter": 300},
    {"maxDepth": 8, "stepSize": 0.1, "maxIter": 200},
)
SIDE_BY_SIDE = 4  # fits that run at a time; each holds its binned rows


def _labelled(df: DataFrame, target: str, names: Sequence[str], allow_nulls: bool) -> DataFrame:
    rows = df.where(F.col(target).isNotNull())
    if not allow_nulls:
        rows = rows.dropna(subset=list(names))
    return rows.withColumn("label", F.col(target).cast("int"))


def state_dataset(states: DataFrame, horizon: int = 1, allow_nulls: bool = False, real_weather: bool = False, **groups) -> tuple[DataFrame, list[str]]:
    """State h weeks ahead with features; rows without target (or, by default, with a null feature) are left out."""
    f = E.state_target(X.case_features(states), horizon)
    if real_weather:
        f = f.where(F.coalesce("valid_days_week", F.lit(0)) > 0)
    names = X.feature_names(present=f.columns, **groups)
    return _labelled(f, "target_state", names, allow_nulls), names


def onset_dataset(states: DataFrame, horizon: int = 3, **groups) -> tuple[DataFrame, list[str]]:
    if horizon not in ONSET_HORIZONS:
        raise ValueError(f"horizon {horizon} not in {ONSET_HORIZONS}")
    f = E.onset_targets(X.case_features(states))
    names = X.feature_names(present=f.columns, **groups)
    return _labelled(f, f"onset_h{horizon}", names, False), names


def rate_onset_dataset(rated: DataFrame, horizon: int = 3, variant: str = "v2_casos_incidencia") -> tuple[DataFrame, list[str]]:
    """Onset of the rate state with one of the five feature compositions."""
    if horizon not in ONSET_HORIZONS:
        raise ValueError(f"horizon {horizon} not in {ONSET_HORIZONS}")
    names = X.variant_names(variant)
    f = X.rate_features(threshold.alert_state(X.case_features(threshold.alert_state(rated)), "rate_1w", suffix="_rate"))
    f = E.onset_targets(f, "state_rate", prefix="rate_onset_h")
    return _labelled(f, f"rate_onset_h{horizon}", names, False), names


def dataset_metrics(before: DataFrame, target: str, names: Sequence[str]) -> DataFrame:
    """Rows before, without target, dropped for a null feature, kept, and positives, in one pass."""
    known = F.col(target).isNotNull()
    full = known
    for n in names:
        full = full & F.col(n).isNotNull()
    return before.agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(~known).alias("target_undefined"), F.count_if(known & ~full).alias("feature_null"),
        F.count_if(full).alias("rows_final"), F.count_if(full & (F.col(target) == 1)).alias("n_positive"), F.count_if(full & (F.col(target) == 0)).alias("n_negative"),
    )


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight = n / (2 * n of the class)."""
    c = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("p")).first()
    # numbers, not a subquery: what is fitted on the rows sends their plan to the executors; a class without rows needs none
    positive, negative = (F.lit(c["n"] / (2.0 * k) if k else 0.0) for k in (c["p"], c["n"] - c["p"]))
    return df.withColumn("weight", F.when(F.col(label) == 1, positive).otherwise(negative))


def _doubles(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def fit_logistic(train: DataFrame, names: Sequence[str], max_iter: int = 200, penalty: float = 0.0) -> PipelineModel:
    """Standardised logistic regression with balanced classes and a ridge penalty."""
    stages = [
        VectorAssembler(inputCols=list(names), outputCol="raw", handleInvalid="error"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(weightCol="weight", maxIter=max_iter, regParam=penalty, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y"),
    ]
    return Pipeline(stages=stages).fit(balanced(_doubles(train, names)))


def fit_trees(train: DataFrame, names: Sequence[str], **params) -> PipelineModel:
    """Boosted trees with balanced classes. MLlib trees take no nulls: median impute plus a missing flag."""
    settings = {**TREES, **params}
    nulls = train.agg(*[F.max(F.col(n).isNull()).alias(n) for n in names]).first()
    gaps = [n for n in names if nulls[n]]
    stages = []
    if gaps:
        stages.append(Imputer(inputCols=gaps, outputCols=[f"{n}__filled" for n in gaps], strategy="median"))
    inputs = [f"{n}__filled" if n in gaps else n for n in names] + [f"{n}__missing" for n in gaps]
    stages += [
        VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"),
        GBTClassifier(weightCol="weight", seed=SEED, predictionCol="_y", **settings).setProbabilityCol("_p").setRawPredictionCol("_r"),
    ]
    return Pipeline(stages=stages).fit(with_flags(balanced(_doubles(train, names)), names))


def with_flags(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{n}__missing": F.col(n).isNull().cast("double") for n in names})


def predict(model: PipelineModel, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds probability of the positive class; the input's columns are kept."""
    out = model.transform(with_flags(_doubles(df, names), names))
    return out.withColumn("probability", vector_to_array("_p")[1]).select(*df.columns, "probability")


def calibrate(validation: DataFrame, score: str = "probability", label: str = "label", *, method: str) -> Callable[[DataFrame], DataFrame]:
    """Calibration curve (sigmoid or isotonic) fitted on validation rows only; returns df -> df with `calibrated`."""
    if method not in ("sigmoid", "isotonic"):
        raise ValueError(f"method {method} is neither sigmoid nor isotonic")
    rows = validation.select(F.col(score).alias("s"), F.col(label).cast("double").alias("label"))
    if method == "sigmoid":
        va = VectorAssembler(inputCols=["s"], outputCol="features")
        m = LogisticRegression(probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y").fit(va.transform(rows))

        def apply(df: DataFrame) -> DataFrame:
            scored = va.transform(df.withColumn("s", F.col(score)))
            return m.transform(scored).withColumn("calibrated", vector_to_array("_p")[1]).select(*df.columns, "calibrated")

        return apply
    curve = IsotonicRegression(featuresCol="s", predictionCol="_c").fit(rows)

    def apply_curve(df: DataFrame) -> DataFrame:
        return curve.transform(df.withColumn("s", F.col(score))).withColumn("calibrated", F.col("_c")).select(*df.columns, "calibrated")

    return apply_curve


def years_of(df: DataFrame) -> list[int]:
    """All years of the rows; the calendar bounds them."""
    return sorted(df.agg(F.collect_set("epi_year")).first()[0])


def folds_of(df: DataFrame, years: Sequence[int]) -> list[int]:
    """Test years that have rows both before and in them; read from the year counts."""
    return sorted(r["fold"] for r in V.fold_sizes(df, years).select("fold").collect())


def side_by_side(spark: SparkSession, jobs: Sequence[Callable], parallel: int = SIDE_BY_SIDE) -> list:
    """Results of fits that do not depend on each other, `parallel` at a time; the first that raises ends all."""
    with ThreadPool(max(1, min(parallel, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs, chunksize=1)


def walk_forward_models(df: DataFrame, names: Sequence[str], years: Sequence[int], settings: Sequence[dict], fit: Callable, parallel: int = SIDE_BY_SIDE) -> list[tuple[int, int, PipelineModel]]:
    """(setting, fold, model) for every setting and test year, each fitted on all earlier years. Cut the rows' lineage before."""
    slots = [(i, year) for i in range(len(settings)) for year in folds_of(df, years)]
    if not slots:
        raise ValueError("no fold has both training and test rows")
    jobs = [lambda i=i, year=year: fit(df.where(F.col("epi_year") < year), names, **settings[i]) for i, year in slots]
    return [(*slot, model) for slot, model in zip(slots, side_by_side(df.sparkSession, jobs, parallel))]


def fold_scores(df: DataFrame, names: Sequence[str], models: Sequence[tuple[int, int, PipelineModel]]) -> DataFrame:
    """Test rows with setting, fold and probability, for any choice of the fitted models."""
    out = None
    for setting, year, model in models:
        part = predict(model, df.where(F.col("epi_year") == year), names).withColumns({"setting": F.lit(setting), "fold": F.lit(year)})
        out = part if out is None else out.unionByName(part)
    return out


def walk_forward_scores(df: DataFrame, names: Sequence[str], years: Sequence[int], fit: Callable, **params) -> DataFrame:
    """One fit per test year on all earlier years; test rows with fold and probability. Cut the rows' lineage before."""
    return fold_scores(df, names, walk_forward_models(df, names, years, [params], fit)).drop("setting")


def walk_forward_table(scored: DataFrame) -> DataFrame:
    """Average precision, AUC, prevalence and lift per fold."""
    return V.lift(V.ranking_metrics(V.merged_scores(scored, "probability", "label", ["fold"]), ["fold"]))


def fold_spread(table: DataFrame, metric: str = "average_precision") -> DataFrame:
    return table.agg(
        F.avg(metric).alias("mean"), F.percentile(metric, 0.5).alias("median"), F.stddev_pop(metric).alias("std"),
        F.min(metric).alias("min"), F.max(metric).alias("max"), F.count(F.lit(1)).alias("n_folds"),
    )


def permuted(df: DataFrame, names: Sequence[str], key: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """One long frame of (feature, repeat, row), the feature's column permuted over the rows.

    Rows are numbered once. A permutation is a second numbering by a hash of the repeat and the key, and only numbers and one copy of
    the values for each repeat are shuffled: a row meets the values of its partner and takes one feature at a
    time from there, in the task that scores it. The features of a repeat share their permutation.
    """
    data = cut_lineage(dense_index(df, [F.col(k) for k in key], "_i"))
    slots = data.select("_i", *key, F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("repeat"))
    slots = slots.withColumn("_h", F.xxhash64(F.lit(seed), "repeat", *key))
    slots = dense_index(slots, [F.col("_h"), *[F.col(k) for k in key]], "_j", ["repeat"]).select("_i", "_j", "repeat")
    values = F.struct(*[F.col(n).cast("double").alias(n) for n in names]).alias("_other")
    mixed = slots.join(data.select(F.col("_i").alias("_j"), values), "_j").drop("_j")
    jobs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_other.{n}").alias("value")) for n in names]))
    long = data.join(mixed, "_i").withColumn("_job", jobs)
    held = {n: F.when(F.col("_job.feature") == n, F.col("_job.value")).otherwise(F.col(n).cast("double")) for n in names}
    return long.withColumns({**held, "feature": F.col("_job.feature")}).drop("_i", "_job", "_other")


def permutation_importance(model: PipelineModel, test: DataFrame, names: Sequence[str], key: Sequence[str], repeats: int = 3, seed: int = SEED) -> DataFrame:
    """Loss of average precision when a feature is permuted: mean and spread over repeats, all scored in one pass."""
    data = cut_lineage(test.select(*key, "label", *names))
    plain = data.withColumn("feature", F.lit("")).withColumn("repeat", F.lit(0))
    cols = ["feature", "repeat", "label", *names]
    every = plain.select(*cols).unionByName(permuted(data, names, key, repeats, seed).select(*cols))
    runs = predict(model, every, names).select("feature", "repeat", "probability", "label")
    ap = V.ranking_metrics(V.merged_scores(runs, "probability", "label", ["feature", "repeat"]), ["feature", "repeat"])
    ap = cut_lineage(ap.select("feature", "repeat", "average_precision"))
    base = ap.where(F.col("feature") == "").select("average_precision").scalar()
    loss = ap.where(F.col("feature") != "").withColumn("loss", base - F.col("average_precision"))
    return loss.groupBy("feature").agg(F.avg("loss").alias("importance_mean"), F.stddev_pop("loss").alias("importance_std"))


def importance_by_fold(df: DataFrame, names: Sequence[str], key: Sequence[str], models: Sequence[tuple[int, int, PipelineModel]], repeats: int = 3, seed: int = SEED) -> DataFrame:
    """Permutation importance of each fold's model on the rows of its test year."""
    out = None
    for _, year, model in models:
        part = permutation_importance(model, df.where(F.col("epi_year") == year), names, key, repeats, seed).withColumn("fold", F.lit(year))
        out = part if out is None else out.unionByName(part)
    return out


def importance_stability(per_fold: DataFrame) -> DataFrame:
    """Mean, spread, ends and sign agreement of a feature's importance over folds."""
    return per_fold.groupBy("feature").agg(
        F.avg("importance_mean").alias("mean"), F.stddev_pop("importance_mean").alias("std"),
        F.min("importance_mean").alias("min"), F.max("importance_mean").alias("max"), F.count_if(F.col("importance_mean") > 0).alias("folds_positive"), F.count(F.lit(1)).alias("n_folds")
    )


def grid_table(scored: DataFrame, settings: Sequence[dict]) -> DataFrame:
    """Median, mean and least walk-forward average precision per setting; temporal folds, never shuffled ones. `best` marks the highest median, the first among equals."""
    by = ["setting", "fold"]
    ap = V.ranking_metrics(V.merged_scores(scored, "probability", "label", by), by)
    table = ap.groupBy("setting").agg(
        F.percentile("average_precision", 0.5).alias("median"), F.avg("average_precision").alias("mean"), F.min("average_precision").alias("min"), F.count("average_precision").alias("n_folds")
    )
    texts = F.array(*[F.lit(str(sorted(p.items()))) for p in settings])
    best = table.agg(F.max_by(F.col("setting"), F.struct(F.coalesce("median", F.lit(-1.0)), -F.col("setting"))).alias("b")).select("b").scalar()
    return table.select("setting", F.get(texts, F.col("setting")).alias("params"), "median", "mean", "min", "n_folds", (F.col("setting") == best).alias("best"))


def small_grid(df: DataFrame, names: Sequence[str], years: Sequence[int], grid: Sequence[dict], fit: Callable = fit_trees, parallel: int = SIDE_BY_SIDE) -> DataFrame:
    """`grid_table` of every setting, all fits of all folds side by side and all their scores judged in one pass."""
    models = walk_forward_models(df, names, years, grid, fit, parallel)
    return grid_table(cut_lineage(fold_scores(df, names, models).select("setting", "fold", "label", "probability")), grid)


def group_ablation(df: DataFrame, years: Sequence[int], groups: dict[str, Sequence[str]], fit: Callable, **params) -> DataFrame:
    """Walk-forward average precision with each feature group left out, and with all."""
    out = None
    for label in ("", *groups):
        names = [n for g, cols in groups.items() if g != label for n in cols]
        t = fold_spread(walk_forward_table(walk_forward_scores(df, names, years, fit, **params)))
        row = t.select(F.lit(label or "(all)").alias("left_out"), "median", "mean", "n_folds")
        out = row if out is None else out.unionByName(row)
    return out


class DifferentRows(ValueError):
    """Two variants were not scored on the same rows."""


def require_same_rows(a: DataFrame, b: DataFrame, key: Sequence[str]) -> None:
    sides = a.select(*key, F.lit(1).alias("_n")).unionByName(b.select(*key, F.lit(-1).alias("_n")))
    if not sides.groupBy(*key).agg(F.sum("_n").alias("_n")).where("_n <> 0").isEmpty():
        raise DifferentRows("the variants cover different rows")


def paired_hits(scored: DataFrame, eps: DataFrame, ks: Sequence[int] = (5, 10), variants: Sequence[str] = ("a", "b"), by: Sequence[str] = ("kind", "week_index")) -> DataFrame:
    """One row per episode with `<variant>_hit_<k>`: listed among the first k in a week of the look-back before its start.

    `scored` holds each variant's rows with `variant` and `probability`; an episode without a ranked week is a miss of both.
    """
    ranked = R.weekly_rank(scored, "probability", ["variant", *by])
    best = R.best_before_start(ranked, eps, keys=["variant"])
    hit = {f"{v}_hit_{k}": F.max(F.when((F.col("variant") == v) & (F.col("best_position") <= k), 1).otherwise(0)) for v in variants for k in ks}
    return best.groupBy(*R.EP, "start_year").agg(*[c.alias(name) for name, c in hit.items()])


def paired_decision(hits: DataFrame, a: str, b: str, unit: Sequence[str], year: str = "start_year", **draws) -> DataFrame:
    """Difference of the recalls b - a with its paired interval, and whether b is adopted: the interval lies above 0 and so does every year."""
    interval = difference_interval(hits, F.col(b), F.col(a), unit, **draws)
    return adopt_variant(interval, hits.groupBy(year).agg(F.avg(F.col(b) - F.col(a)).alias("difference")))


def adopt_variant(interval: DataFrame, per_year: DataFrame) -> DataFrame:
    """Adopt only if the interval of the difference excludes 0 from above and every year agrees in sign."""
    years_ok = per_year.agg(F.bool_and(F.col("difference") > 0).alias("ok")).select("ok").scalar()
    return interval.select("observed", "low", "high", ((F.col("low") > 0) & years_ok).alias("adopt"))
