"""Weekly ranking and what it is worth: recall, precision, look-back, stability, load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from weekwatch.contracts import ALERT_WINDOW, TOP_K
from weekwatch.functions.numbers import pct

EP = ["place", "kind", "start_index"]


def weekly_rank(df: DataFrame, score: str, by: Sequence[str] = ("kind", "week_index"), name: str = "position") -> DataFrame:
    """1 = highest score of the week; ties go to the lower place code."""
    order = W.partitionBy(*by).orderBy(F.desc_nulls_last(score), "place")
    return df.withColumn(name, F.row_number().over(order))


def relative_score(df: DataFrame, score: str, by: Sequence[str] = ("kind", "week_index")) -> DataFrame:
    """0-100 position inside the week (100 = first); a place in the order, not a probability."""
    up = W.partitionBy(*by).orderBy(F.asc_nulls_first(score), F.desc("place"))
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    return df.withColumn(
        "priority_score", pct((F.row_number().over(up) - 1), F.greatest(n - 1, F.lit(1)), 1)
    )


def backtest_rows(features: DataFrame, score: str, target: str = "onset_h3") -> DataFrame:
    """One row per place and decision week: rank, relative score, two baseline ranks, what followed.

    weeks_to_onset needs an observed 0 before the 1, unlike the onset target.
    """
    series = W.partitionBy("place", "kind").orderBy("week_index")
    entry = F.when((F.col("state_t") == 1) & (F.lag("state_t").over(series) == 0) & (F.lag("week_index").over(series).isNotNull()), 1).otherwise(0)
    nxt = [F.lead("cases", h).over(series) for h in (1, 2, 3)]
    out = features.withColumns({"_entry": entry, "cases_next_3w": nxt[0] + nxt[1] + nxt[2]})
    # the lead of an entry counts only when it is exactly h weeks away
    hits = [
        F.when((F.lead("_entry", h).over(series) == 1) & (F.lead("week_index", h).over(series) == F.col("week_index") + h), F.lit(float(h)))
        for h in (1, 2, 3)
    ]
    out = out.withColumn("weeks_to_onset", F.coalesce(*hits)).drop("_entry")
    out = weekly_rank(out, score, name="rank")
    out = weekly_rank(out, "threshold_ratio", name="rank_history_ratio")
    out = weekly_rank(out, "growth", name="rank_growth")
    return relative_score(out, score).withColumn("onset_in_3w", F.col(target))


def latest_week_slice(backtest: DataFrame, model_version: str, horizon: int = 3) -> DataFrame:
    """The newest decision week in the output contract."""
    newest = backtest.agg(F.max("week_index").alias("i"))
    return backtest.where(F.col("week_index") == newest.select("i").scalar()).select(
        F.col("epi_year").alias("reference_year"),
        F.col("epi_week").alias("reference_week"),
        F.lit(horizon).alias("forecast_horizon"),
        "place_name", "place", "kind", "region", "priority_score", "rank",
        F.lit(model_version).alias("model_version"),
        F.col("week_end").alias("data_cutoff"),
    )


def _with_k(df: DataFrame, ks: Sequence[int]) -> DataFrame:
    return df.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))


def recall_at_k(ranked: DataFrame, state: str = "actual", ks: Sequence[int] = (5, 10, 20), by: Sequence[str] = ("kind", "week_index")) -> DataFrame:
    """Micro: positives in the top K over all positives. Macro: mean over weeks that have one."""
    weekly = (
        _with_k(ranked.where(F.col(state) == 1), ks)
        .groupBy("k", *by)
        .agg(F.count_if(F.col("position") <= F.col("k")).alias("hit"), F.count(F.lit(1)).alias("n"))
    )
    return weekly.groupBy("k").agg(
        (F.sum("hit") / F.sum("n")).alias("recall_micro"),
        F.avg(F.col("hit") / F.col("n")).alias("recall_macro"),
        F.sum("n").alias("n_positive"),
        F.count(F.lit(1)).alias("n_weeks"),
    )


def precision_at_k(ranked: DataFrame, state: str = "actual", ks: Sequence[int] = TOP_K, by: Sequence[str] = ("kind", "week_index")) -> DataFrame:
    """Share of the K listed places with the event, mean and median over weeks."""
    weekly = (
        _with_k(ranked, ks)
        .where(F.col("position") <= F.col("k"))
        .groupBy("k", *by)
        .agg(F.avg(state).alias("precision"))
    )
    return weekly.groupBy("k").agg(
        F.avg("precision").alias("precision_mean"),
        F.percentile("precision", 0.5).alias("precision_median"),
        F.count(F.lit(1)).alias("n_weeks"),
    )


def best_before_start(ranked: DataFrame, eps: DataFrame, window: int = ALERT_WINDOW, keys: Sequence[str] = ()) -> DataFrame:
    """Best rank in the weeks before each episode (earliest week on ties) and the rank at its start.

    The look-back is an equi-join on the exploded weeks. `keys` (such as a method name) of the
    ranking are kept: every method is evaluated in the same pass.
    """
    keys = list(keys)
    probes = eps.select(*EP, F.explode(F.sequence(F.col("start_index") - window, F.col("start_index"))).alias("week_index"))
    seen = probes.join(ranked.select("place", "kind", "week_index", "position", *keys), ["place", "kind", "week_index"])
    before = F.col("week_index") < F.col("start_index")
    best = F.struct("position", "week_index")
    found = seen.groupBy(*EP, *keys).agg(
        F.min(F.when(before, best)).alias("_b"),
        F.min(F.when(~before, F.col("position"))).alias("position_at_start"),
    )
    base = eps.select(*EP, "start_year")
    if keys:
        base = _with_methods(base, ranked, keys)
    return base.join(found, EP + keys, "left").select(
        *EP, *keys, "start_year",
        F.col("_b.position").alias("best_position"),
        (F.col("start_index") - F.col("_b.week_index")).alias("lead_weeks"),
        "position_at_start",
    )


def _with_methods(base: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Every episode for every method; the method list is a scalar array of a few names."""
    names = ranked.agg(F.array_sort(F.collect_set(F.struct(*keys))).alias("m")).select("m").scalar()
    return base.withColumn("_m", F.explode(names)).select(*base.columns, "_m.*")


def unbroken_top_k(ranked: DataFrame, eps: DataFrame, k: int = 10, window: int = ALERT_WINDOW) -> DataFrame:
    """Weeks in the top K without a gap, counted back from the week before the start."""
    probes = eps.select(
        *EP, "start_year", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("back")
    ).withColumn("week_index", F.col("start_index") - F.col("back"))
    seen = probes.join(
        ranked.select("place", "kind", "week_index", "position"), ["place", "kind", "week_index"], "left"
    )
    miss = F.coalesce(F.col("position") > k, F.lit(True))
    return seen.groupBy(*EP, "start_year").agg(
        F.coalesce(F.min(F.when(miss, F.col("back"))) - 1, F.lit(window)).alias("weeks_in_top")
    )


def position_summary(positions: DataFrame, ks: Sequence[int] = (5, 10, 20), by: Sequence[str] = ()) -> DataFrame:
    """How often and how early an episode's place was listed before the start."""
    p = F.col("best_position")
    aggs = [
        F.count(F.lit(1)).alias("n_episodes"),
        F.count("best_position").alias("n_ranked_before"),
        F.avg("best_position").alias("position_mean"),
        F.percentile("best_position", 0.5).alias("position_median"),
        F.avg("lead_weeks").alias("lead_mean"),
    ] + [(F.avg((p <= k).cast("int")) * 100).alias(f"pct_top_{k}") for k in ks]
    return positions.groupBy(*by).agg(*aggs) if by else positions.agg(*aggs)


def active_before(states: DataFrame, eps: DataFrame, weeks: int = ALERT_WINDOW) -> DataFrame:
    """Point-in-time lookup: was the place in state 1 `weeks` before the start (unknown = no)."""
    then = states.select("place", "kind", (F.col("week_index") + weeks).alias("start_index"), F.col("state").alias("_s"))
    return eps.join(then, EP, "left").withColumn("active_before", F.coalesce(F.col("_s") == 1, F.lit(False))).drop("_s")


def top_k_jaccard(ranked: DataFrame, k: int = 10, by: Sequence[str] = ("kind",)) -> DataFrame:
    """Overlap of the top K of each week with the next week's, where both weeks exist."""
    by = list(by)
    top = ranked.where(F.col("position") <= k).select(*by, "week_index", "place")
    sizes = top.groupBy(*by, "week_index").agg(F.count(F.lit(1)).alias("n"))
    kept = (
        top.join(top.withColumn("week_index", F.col("week_index") - 1), [*by, "week_index", "place"])
        .groupBy(*by, "week_index")
        .agg(F.count(F.lit(1)).alias("kept"))
    )
    nxt = sizes.select(*by, (F.col("week_index") - 1).alias("week_index"), F.col("n").alias("n_next"))
    both = sizes.join(nxt, [*by, "week_index"]).join(kept, [*by, "week_index"], "left")
    kept_n = F.coalesce("kept", F.lit(0))
    return both.select(
        *by, "week_index",
        (kept_n / (F.col("n") + F.col("n_next") - kept_n)).alias("jaccard"),
        kept_n.alias("n_kept"),
        F.lit(k).alias("k"),
    )


def stability(series: DataFrame) -> DataFrame:
    return series.groupBy("k").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("jaccard").alias("jaccard_mean"), F.percentile("jaccard", 0.5).alias("jaccard_median")
    )


def operating_load(ranked: DataFrame, onset: str = "onset_h3", ks: Sequence[int] = TOP_K, by: Sequence[str] = ("kind", "week_index")) -> DataFrame:
    """What listing K places a week costs: listed with, without and with undefined outcome."""
    week = (
        _with_k(ranked, ks)
        .where(F.col("position") <= F.col("k"))
        .groupBy("k", *by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col(onset) == 1).alias("w"),
            F.count_if(F.col(onset) == 0).alias("wo"),
            F.count_if(F.col(onset).isNull()).alias("u"),
        )
    )
    return week.groupBy("k").agg(
        F.count(F.lit(1)).alias("n_weeks"),
        F.sum("n").alias("n_listed"),
        (F.sum("n") / F.count(F.lit(1))).alias("listed_per_week"),
        F.sum("w").alias("with_episode"),
        F.sum("wo").alias("without_episode"),
        F.sum("u").alias("undefined_outcome"),
        F.try_divide(F.sum("wo") * F.lit(100.0), F.sum("w") + F.sum("wo")).alias("pct_without_episode"),
    )


def week_outcome(ranked: DataFrame, year: int, week: int, k: int, onset: str = "onset_h3") -> DataFrame:
    """One decision week: hits, false alerts and missed places for the chosen K."""
    r = ranked.where((F.col("epi_year") == year) & (F.col("epi_week") == week))
    inside, hit = F.col("position") <= k, F.col(onset) == 1
    return r.groupBy("kind").agg(
        F.count_if(inside & hit).alias("hits"),
        F.count_if(inside & ~hit).alias("false_alerts"),
        F.count_if(~inside & hit).alias("missed"),
    )


def method_long(features: DataFrame, scores: dict[str, str]) -> DataFrame:
    """One row per method, place and week: every method is ranked by the same window."""
    cases = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).cast("double").alias("score")) for m, c in scores.items()])
    long = features.withColumn("_m", F.explode(cases)).select(*features.columns, "_m.*")
    return weekly_rank(long, "score", by=("method", "kind", "week_index"))


def episode_master(features: DataFrame, eps: DataFrame, states: DataFrame, places: DataFrame, scores: dict[str, str], ks: Sequence[int] = TOP_K) -> DataFrame:
    """One row per episode: best position, lead and detected@K per method, region, active flag."""
    long = best_before_start(method_long(features, scores), eps, keys=["method"])
    wide = long.groupBy(*EP, "start_year").pivot("method", list(scores)).agg(
        F.min("best_position").alias("best_position"),
        F.min("lead_weeks").alias("lead_weeks"),
        *[F.max(F.coalesce((F.col("best_position") <= k).cast("int"), F.lit(0))).alias(f"hit_{k}") for k in ks],
    )
    with_region = wide.join(places.select("place", "region"), "place", "left")
    return active_before(states, with_region)


def recall_by_group(master: DataFrame, group: str, hits: Sequence[str]) -> DataFrame:
    return master.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_episodes"), *[F.avg(h).alias(h) for h in hits]
    )


def leave_one_out(master: DataFrame, group: str, model: str, baseline: str) -> DataFrame:
    """Recall with one group left out, from group sums and their total: no row is paired."""
    per = master.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(model).alias("m"), F.sum(baseline).alias("b")
    )
    total = per.agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("b").alias("b"))
    all_n, all_m, all_b = (total.select(c).scalar() for c in ("n", "m", "b"))
    rest = all_n - F.col("n")
    return per.select(
        F.col(group).alias("left_out"),
        rest.alias("n_episodes"),
        F.try_divide(all_m - F.col("m"), rest).alias("recall_model"),
        F.try_divide(all_b - F.col("b"), rest).alias("recall_baseline"),
    )


def best_baseline(master: DataFrame, baselines: Sequence[str], ks: Sequence[int] = TOP_K) -> DataFrame:
    """Per K the baseline with the highest recall; ties go to the later name."""
    long = master.select(
        F.explode(
            F.array(*[
                F.struct(F.lit(k).alias("k"), F.lit(b).alias("baseline"), F.col(f"{b}_hit_{k}").alias("hit"))
                for k in ks for b in baselines
            ])
        ).alias("_h")
    ).select("_h.*")
    per = long.groupBy("k", "baseline").agg(F.avg("hit").alias("recall"))
    return per.groupBy("k").agg(
        F.max_by("baseline", F.struct("recall", "baseline")).alias("baseline"), F.max("recall").alias("recall")
    )


def episode_slices(master: DataFrame, eps: DataFrame, hit: str, lead: str) -> DataFrame:
    """Recall and lead quartiles for all, large, new and relapse episodes, in one long table."""
    full = master.join(eps.select(*EP, "total_cases"), EP)
    cut = full.agg(F.percentile("total_cases", 0.9).alias("q")).select("q").scalar()
    tagged = full.withColumn(
        "slice",
        F.explode(
            F.array_compact(
                F.array(
                    F.lit("all"),
                    F.when(F.col("total_cases") >= cut, "large"),
                    F.when(F.col("active_before"), "relapse").otherwise("new"),
                )
            )
        ),
    )
    return tagged.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.avg(hit).alias("recall"),
        F.percentile(lead, 0.25).alias("lead_p25"),
        F.percentile(lead, 0.5).alias("lead_median"),
        F.percentile(lead, 0.75).alias("lead_p75"),
    )


def critical_places(master: DataFrame, hit: str, top: int = 10) -> DataFrame:
    """Places with the most missed episodes."""
    return (
        master.groupBy("place")
        .agg(F.count(F.lit(1)).alias("n_episodes"), F.sum(F.lit(1) - F.col(hit)).alias("n_missed"))
        .orderBy(F.desc("n_missed"), "place")
        .limit(top)
    )


def evidence_bundle(sections: dict[str, tuple[DataFrame | None, str, Sequence[str]]], candidate: str) -> DataFrame:
    """Long table (candidate, section, key, metric, value); a section without data stays empty."""
    out = None
    for name, (df, key, metrics) in sections.items():
        if df is None:
            continue
        part = df.select(
            F.lit(candidate).alias("candidate"),
            F.lit(name).alias("section"),
            F.col(key).cast("string").alias("key"),
            *[F.col(m).cast("double").alias(m) for m in metrics],
        ).unpivot(["candidate", "section", "key"], list(metrics), "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out
