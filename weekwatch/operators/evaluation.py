"""Scores against outcomes, exact at any number of rows: metrics, thresholds, calibration, drift.

Rows are merged to (score, positives, count) before anything is ordered, and running totals come
from range-split scans (see functions.ordered), so neither a hot score nor the table size meets
one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weekwatch.functions.ordered import cumulative_by_value, exact_percentiles
from weekwatch.functions.stats import kolmogorov_p

THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def merged_scores(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, score, pos, n) with equal scores merged."""
    return (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*groups, F.col(score).cast("double").alias("score"))
        .agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def ranking_metrics(scores: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Average precision and ROC-AUC from merged scores; ties share one step, one class gives null AUC."""
    groups = list(groups)
    cum = cumulative_by_value(scores, groups, "score", ["pos", "n"])
    # counts at or above a score, from the ascending running totals
    tp = F.col("all_pos") - F.col("cum_pos") + F.col("pos")
    listed = F.col("all_n") - F.col("cum_n") + F.col("n")
    neg = F.col("n") - F.col("pos")
    below_neg = (F.col("cum_n") - F.col("cum_pos")) - neg
    agg = [
        F.sum(F.try_divide(F.col("pos"), F.col("all_pos")) * (tp / listed)).alias("average_precision"),
        F.sum(F.col("pos") * (below_neg + neg / 2.0)).alias("_wins"),
        F.max("all_pos").alias("n_positive"), F.max("all_n").alias("n"),
    ]
    out = cum.groupBy(*groups).agg(*agg) if groups else cum.agg(*agg)
    pairs = F.col("n_positive") * (F.col("n") - F.col("n_positive"))
    return out.withColumn("roc_auc", F.when(pairs > 0, F.col("_wins") / pairs)).withColumn(
        "average_precision", F.when(F.col("n_positive") > 0, F.col("average_precision")).otherwise(0.0)
    ).drop("_wins")


def threshold_table(scores: DataFrame, thresholds: Sequence[float] = THRESHOLDS, groups: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall and F1 at each threshold in one pass; 0 when undefined."""
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    hit = F.col("score") >= F.col("threshold")
    t = scores.withColumn("threshold", at).groupBy(*groups, "threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("n") - F.col("pos")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(F.col("n") - F.col("pos"))).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return t.withColumns(
        {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)}
    )


def best_threshold(table: DataFrame) -> DataFrame:
    """Highest F1; the lower threshold on ties."""
    return table.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def classification_metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    s = merged_scores(df, score, label)
    conf = threshold_table(s, [threshold])
    rank = ranking_metrics(s)
    row = rank.select(F.struct("average_precision", "roc_auc", "n_positive", "n").alias("r")).scalar()
    return conf.withColumn("_r", row).select("*", "_r.*").drop("_r").withColumn("prevalence", F.try_divide(F.col("n_positive"), F.col("n")))


def calibration_bins(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over the observed range, right-closed; one value gives one bin by value."""
    s = merged_scores(df, score, label)
    lim = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    b = s.withColumn("_l", lim.select(F.struct("lo", "hi").alias("s")).scalar())
    lo, hi = F.col("_l.lo"), F.col("_l.hi")
    pos = (F.col("score") - lo) / ((hi - lo) / bins)
    bin_no = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.ceil(F.rint(pos * 1e9) / 1e9) - 1)))
    return b.withColumn("bin", bin_no.cast("int")).groupBy("bin").agg(
        F.sum("n").alias("n"), (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("score_mean"), (F.sum("pos") / F.sum("n")).alias("observed")
    )


def brier(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).agg(
        F.avg(F.pow(F.col(score) - F.col(label), 2.0)).alias("brier"), F.count(F.lit(1)).alias("n")
    )


def count_errors(df: DataFrame, actual: str, predicted: Sequence[str]) -> DataFrame:
    """MAE and RMSE of count predictions, one row per method."""
    items = F.array(*[F.struct(F.lit(p).alias("method"), (F.col(actual) - F.col(p)).cast("double").alias("e")) for p in predicted])
    long = df.select(F.explode(items).alias("_i")).select("_i.*").where(F.col("e").isNotNull())
    return long.groupBy("method").agg(
        F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.count(F.lit(1)).alias("n")
    )


def baselines(features: DataFrame, rising: int = 3) -> DataFrame:
    """Rule scores: persistence, strictly rising weeks, above the same-week mean, and the rate rules."""
    if not 2 <= rising <= 5:
        raise ValueError("rising weeks must be 2..5")
    series = ["cases_t", "lag_1", "lag_2", "lag_3", "lag_4"]
    up = F.lit(True)
    for a, b in list(zip(series, series[1:]))[: rising - 1]:
        up = up & F.coalesce(F.col(a) > F.col(b), F.lit(False))
    out = {
        "base_persistence": F.col("state_t"),
        "base_rising": up.cast("double"),
        "base_seasonal": F.coalesce(F.col("cases_t") > F.col("week_mean"), F.lit(False)).cast("double"),
        "base_count_persistence": F.col("cases_t").cast("double"),
        "base_count_mean_4w": F.col("mean_4w"),
    }
    if "rate_t" in features.columns:
        out |= {"base_rate": F.col("rate_t"), "base_rate_growth": F.col("rate_delta"), "base_rate_history": F.col("rate_threshold_ratio")}
    return features.withColumns(out)


def temporal_split(year: Column, train_end: int = 2019, validation_end: int = 2022) -> Column:
    return F.when(year <= train_end, "treino").when(year <= validation_end, "validacao").otherwise("teste")


def walk_forward(df: DataFrame, test_years: Sequence[int]) -> DataFrame:
    """(fold, role) rows: train on every earlier year, test on the year itself; empty folds drop out."""
    folds = F.array(*[F.lit(y) for y in test_years])
    tagged = df.withColumn("fold", F.explode(F.filter(folds, lambda y: y >= F.col("epi_year"))))
    return tagged.withColumn("role", F.when(F.col("epi_year") == F.col("fold"), "test").otherwise("train"))


def fold_sizes(df: DataFrame, test_years: Sequence[int]) -> DataFrame:
    """Train and test rows per fold from yearly counts; folds without either side are skipped."""
    yearly = df.groupBy("epi_year").agg(F.count(F.lit(1)).alias("n"))
    return (
        walk_forward(yearly, test_years)
        .groupBy("fold")
        .agg(
            F.coalesce(F.sum(F.when(F.col("role") == "train", F.col("n"))), F.lit(0)).alias("n_train"),
            F.coalesce(F.sum(F.when(F.col("role") == "test", F.col("n"))), F.lit(0)).alias("n_test"),
        )
        .where((F.col("n_train") > 0) & (F.col("n_test") > 0))
    )


def lift(table: DataFrame) -> DataFrame:
    """Average precision over prevalence; null when nothing is positive."""
    prevalence = F.try_divide(F.col("n_positive"), F.col("n"))
    return table.withColumn("prevalence", prevalence).withColumn(
        "lift", F.col("average_precision") / F.when(F.col("prevalence") > 0, F.col("prevalence"))
    )


def target_by_year(states: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return states.groupBy("epi_year").agg(
        n.alias("n_rows"), F.sum("cases").alias("cases"), F.avg("cases").alias("cases_mean"),
        (100.0 * F.count_if(F.col("state") == 1) / n).alias("pct_positive"),
        (100.0 * F.count_if(F.col("state").isNull()) / n).alias("pct_undefined"),
        F.avg("threshold").alias("threshold_mean"),
        F.countDistinct(F.when(F.col("cases") > 0, F.col("place"))).alias("places_with_case"),
        (100.0 * F.count_if(F.col("threshold_type") == "geral") / n).alias("pct_general"),
    )


def episodes_by_year(eps: DataFrame) -> DataFrame:
    return eps.groupBy("start_year").agg(
        F.count(F.lit(1)).alias("n_episodes"), F.avg("weeks").alias("weeks_mean"), F.avg("total_cases").alias("total_cases_mean"),
        F.avg("peak_cases").alias("peak_mean"), F.percentile("peak_cases", 0.5).alias("peak_median"), F.countDistinct("place").alias("n_places"),
    )


def target_agreement(states: DataFrame, a: str = "state", b: str = "state_alt") -> DataFrame:
    """Per year: agreement and Jaccard of two binary targets where both are defined."""
    both = states.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    one, two = F.col(a) == 1, F.col(b) == 1
    return both.groupBy("epi_year").agg(
        F.count_if(one).alias("n_a"), F.count_if(two).alias("n_b"),
        F.avg((F.col(a) == F.col(b)).cast("int")).alias("agreement"),
        F.try_divide(F.count_if(one & two).cast("double"), F.count_if(one | two).cast("double")).alias("jaccard"),
    )


def most_frequent(df: DataFrame, group: str, column: str) -> DataFrame:
    """Most frequent category per group; the smaller value on ties."""
    counts = df.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(column), F.max("n").alias("n"))


def drift(df: DataFrame, features: Sequence[str], reference_end: int, years: Sequence[int]) -> DataFrame:
    """Two-sample KS of every feature: years up to the reference against each later year."""
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    long = df.select("epi_year", F.explode(items).alias("_i")).select("epi_year", "_i.*").where(F.col("v").isNotNull())
    merged = long.groupBy("feature", "epi_year", "v").agg(F.count(F.lit(1)).alias("c"))
    groups = F.array(*[F.lit(y) for y in years])
    reference = F.col("epi_year") <= reference_end
    # reference rows take part in every comparison, rows of a year only in their own
    tagged = merged.withColumn("year", F.explode(F.when(reference, groups).otherwise(F.filter(groups, lambda y: y == F.col("epi_year")))))
    tagged = tagged.withColumns({"n1": F.when(reference, F.col("c")).otherwise(0), "n2": F.when(reference, 0).otherwise(F.col("c"))})
    keys = ["feature", "year"]
    cum = cumulative_by_value(tagged, keys, "v", ["n1", "n2"])
    gap = F.abs(F.col("cum_n1") / F.col("all_n1") - F.col("cum_n2") / F.col("all_n2"))
    ks = cum.where((F.col("all_n1") > 0) & (F.col("all_n2") > 0)).groupBy(*keys).agg(
        F.max(gap).alias("ks"), F.max("all_n1").alias("n_reference"), F.max("all_n2").alias("n"),
        (F.sum(F.col("v") * F.col("n1")) / F.sum("n1")).alias("mean_reference"), (F.sum(F.col("v") * F.col("n2")) / F.sum("n2")).alias("mean"),
    )
    own = tagged.where(F.col("n2") > 0).select(*keys, "v", "n2")
    q = exact_percentiles(own, keys, "v", {"median": 0.5, "p90": 0.9}, weight="n2").drop("n")
    return ks.join(q, keys).withColumn("p_value", kolmogorov_p(F.col("ks"), F.col("n_reference"), F.col("n")))
