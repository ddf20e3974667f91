"""Runs of weeks above threshold, onset targets, and alerts measured against them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from weekwatch.contracts import ALERT_WINDOW, ONSET_HORIZONS
from weekwatch.functions.ordered import row_numbers

BY = ("place", "kind")


def episodes(states: DataFrame, state: str = "state", by: Sequence[str] = BY) -> DataFrame:
    """One row per run of contiguous weeks in state 1; an undefined week or a jump breaks the run."""
    w = W.partitionBy(*by).orderBy("week_index")
    known = states.where(F.col(state).isNotNull())
    on = F.col(state) == 1
    starts = on & (
        F.coalesce(F.lag(state).over(w) != 1, F.lit(True))
        | (F.lag("week_index").over(w) != F.col("week_index") - 1)
    )
    runs = (
        known.withColumn("_start", starts.cast("int"))
        .withColumn("_run", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .where(on)
    )
    return (
        runs.groupBy(*by, "_run")
        .agg(
            F.min("week_index").alias("start_index"),
            F.max("week_index").alias("end_index"),
            F.min_by("epi_year", "week_index").alias("start_year"),
            F.min_by("epi_week", "week_index").alias("start_week"),
            F.count(F.lit(1)).alias("weeks"),
            F.sum("cases").cast("double").alias("total_cases"),
            F.max("cases").cast("double").alias("peak_cases"),
        )
        .drop("_run")
    )


def onset_targets(
    states: DataFrame, state: str = "state", horizons: Sequence[int] = ONSET_HORIZONS,
    by: Sequence[str] = BY, prefix: str = "onset_h",
) -> DataFrame:
    """Adds onset (first week of an episode) and one target per horizon on the dense week index.

    1 if an episode starts in (t, t+h], null if none does but a week of the window is undefined,
    null for the last h weeks of a place, else 0.
    """
    w = W.partitionBy(*by).orderBy("week_index")
    on = F.coalesce(F.col(state) == 1, F.lit(False))
    onset = F.when(on & (F.coalesce(F.lag(state).over(w), F.lit(0.0)) != 1), 1).otherwise(0)
    out = states.withColumns({"onset": onset, "_undef": F.when(F.col(state).isNull(), 1).otherwise(0)})
    targets = {}
    for h in horizons:
        ahead = w.rowsBetween(1, h)
        targets[f"{prefix}{h}"] = F.when(
            F.lead("week_index", h).over(w).isNotNull(),
            F.when(F.max("onset").over(ahead) == 1, 1.0).when(F.max("_undef").over(ahead) == 0, 0.0),
        )
    return out.withColumns(targets).drop("_undef")


def state_target(states: DataFrame, horizon: int = 1, by: Sequence[str] = BY) -> DataFrame:
    """State and cases h weeks ahead."""
    w = W.partitionBy(*by).orderBy("week_index")
    return states.withColumns(
        {
            "target_state": F.lead("state", horizon).over(w),
            "target_cases": F.lead("cases", horizon).over(w),
            "target_index": F.col("week_index") + horizon,
        }
    )


def _episode_weeks(eps: DataFrame, lead: int, by: Sequence[str]) -> DataFrame:
    """One row per episode and week of [start-lead, end]: range joins become equi-joins."""
    return eps.select(
        *by, "start_index", F.explode(F.sequence(F.col("start_index") - lead, F.col("end_index"))).alias("alert_index")
    )


def anticipation(alerts: DataFrame, eps: DataFrame, lead: int = ALERT_WINDOW, by: Sequence[str] = BY) -> DataFrame:
    """Episodes with the earliest alert in [start-lead, end]: early, simultaneous, late or missed.

    `alerts` has (place, kind, alert_index), one row per raised alert.
    """
    raised = alerts.select(*by, "alert_index").distinct()
    first = (
        _episode_weeks(eps, lead, by)
        .join(raised, [*by, "alert_index"])
        .groupBy(*by, "start_index")
        .agg(F.min("alert_index").alias("detection_index"))
    )
    gap = F.col("start_index") - F.col("detection_index")
    return eps.join(first, [*by, "start_index"], "left").withColumns(
        {
            "detected": F.col("detection_index").isNotNull(),
            "lead_weeks": gap,
            "verdict": F.when(gap >= 1, "antecipado").when(gap == 0, "simultaneo").when(gap < 0, "tardio").otherwise("perdido"),
        }
    )


def false_alerts(alerts: DataFrame, eps: DataFrame, lead: int = ALERT_WINDOW, by: Sequence[str] = BY) -> DataFrame:
    """Alerts outside the window of every episode of the place."""
    covered = _episode_weeks(eps, lead, by).select(*by, "alert_index")
    return alerts.select(*by, "alert_index").join(covered, [*by, "alert_index"], "left_anti")


def anticipation_summary(judged: DataFrame, false: DataFrame) -> DataFrame:
    share = F.avg(F.col("detected").cast("int"))
    verdict = lambda v: F.count_if(F.col("verdict") == v)
    return judged.agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.count_if("detected").alias("n_detected"),
        F.count_if(~F.col("detected")).alias("n_missed"),
        share.alias("detection_rate"),
        verdict("antecipado").alias("n_early"),
        verdict("simultaneo").alias("n_simultaneous"),
        verdict("tardio").alias("n_late"),
        F.avg("lead_weeks").alias("lead_mean"),
        F.percentile("lead_weeks", 0.5).alias("lead_median"),
    ).withColumn("n_false_alerts", false.agg(F.count(F.lit(1)).alias("n")).select("n").scalar())


def anticipation_by_place(judged: DataFrame, false: DataFrame) -> DataFrame:
    per = judged.groupBy("place").agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.count_if("detected").alias("n_detected"),
        F.percentile("lead_weeks", 0.5).alias("lead_median"),
    ).withColumn("n_missed", F.col("n_episodes") - F.col("n_detected"))
    wrong = false.groupBy("place").agg(F.count(F.lit(1)).alias("n_false"))
    return per.join(wrong, "place", "left").withColumn("n_false", F.coalesce("n_false", F.lit(0)))


def anticipation_by_year(judged: DataFrame) -> DataFrame:
    return judged.groupBy("start_year").agg(
        F.count(F.lit(1)).alias("n_episodes"), F.count_if("detected").alias("n_detected")
    ).withColumn("detection_rate", F.col("n_detected") / F.col("n_episodes"))


def weekly_load(alerts: DataFrame, false: DataFrame) -> DataFrame:
    """Alerted places and false alerts per week, over weeks that have one; 0 when there is none."""
    def per_week(df):
        return df.groupBy("alert_index").agg(F.count(F.lit(1)).alias("n"))

    zero = F.lit(0.0)
    wrong = per_week(false).agg(
        F.coalesce(F.avg("n"), zero).alias("mean"),
        F.coalesce(F.percentile("n", 0.5), zero).alias("median"),
        F.count(F.lit(1)).alias("weeks"),
    )
    return per_week(alerts).agg(
        F.coalesce(F.avg("n"), zero).alias("alerted_mean"),
        F.coalesce(F.percentile("n", 0.5), zero).alias("alerted_median"),
        F.coalesce(F.max("n"), F.lit(0)).alias("alerted_max"),
    ).select(
        "*",
        wrong.select("mean").scalar().alias("false_mean"),
        wrong.select("median").scalar().alias("false_median"),
        wrong.select("weeks").scalar().alias("weeks_with_false"),
    )


def false_runs(false: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Runs of consecutive false alerts: how many, mean and longest length."""
    w = W.partitionBy(*by).orderBy("alert_index")
    runs = (
        false.withColumn("_run", F.col("alert_index") - F.row_number().over(w))
        .groupBy(*by, "_run")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return runs.agg(F.count(F.lit(1)).alias("n_runs"), F.avg("n").alias("mean_weeks"), F.max("n").alias("max_weeks"))


def largest_episodes(judged: DataFrame, share: float = 0.10) -> DataFrame:
    """The ceil(share * n) largest episodes, at least one; ties by place, kind and start."""
    order = [F.desc("total_cases"), F.asc("place"), F.asc("kind"), F.asc("start_index")]
    ranked = row_numbers(judged, order, "_at")
    keep = ranked.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * share)).alias("k")).select("k").scalar()
    return ranked.where(F.col("_at") <= keep).drop("_at")


def episode_overlap(a: DataFrame, b: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Common, only-A and only-B episode starts and their Jaccard index."""
    key = [*by, "start_index"]
    left, right = a.select(*key).distinct(), b.select(*key).distinct()
    full = left.withColumn("_a", F.lit(1)).join(right.withColumn("_b", F.lit(1)), key, "full")
    return full.agg(
        F.count("_a").alias("n_a"),
        F.count("_b").alias("n_b"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"),
        F.count_if(F.col("_b").isNull()).alias("n_only_a"),
        F.count_if(F.col("_a").isNull()).alias("n_only_b"),
        (F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("jaccard"),
    )


def overlap_by(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """Episodes per group value in both sets."""
    left = a.groupBy(group).agg(F.count(F.lit(1)).alias("n_a"))
    right = b.groupBy(group).agg(F.count(F.lit(1)).alias("n_b"))
    return left.join(right, group, "full").select(
        group, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")
    )
