"""Correlations of weekly series with weather: windows, true lags, seasonal residuals, agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from weekwatch import contracts as C
from weekwatch.contracts import WET_WEEK_MM
from weekwatch.functions.numbers import round_even
from weekwatch.functions.ordered import cumulative_by_value
from weekwatch.functions.stats import RELIABLE_N, average_rank, correlation_p_value, safe_corr
from weekwatch.session import cut_lineage
from weekwatch.operators.weather import real_cell_rows, real_station_rows

LAGS = tuple(range(13))
MATRIX_COLUMNS = ("cases", "rain_week", "rain_day_mean", "rain_day_max", "rain_days", "rain_7d", "rain_14d", "rain_21d", "rain_28d")


def _long(df: DataFrame, keep: Sequence[str], name: str, pairs: dict) -> DataFrame:
    items = F.array(*[F.struct(F.lit(k).alias(name), F.col(c).cast("double").alias("x")) for k, c in pairs.items()])
    return df.select(*keep, F.explode(items).alias("_i")).select(*keep, "_i.*")


def window_correlations(grid: DataFrame, windows: Sequence[int] = (7, 14, 21, 28)) -> DataFrame:
    """Pearson of cases and rain per trailing window; 7 and 28 also need a valid day."""
    masked = grid.withColumns(
        {f"_w{n}": F.when(F.coalesce(f"valid_days_{n}d", F.lit(0)) > 0, F.col(f"rain_{n}d")) if n in (7, 28) else F.col(f"rain_{n}d") for n in windows}
    )
    long = _long(masked, ["cases"], "window_days", {n: f"_w{n}" for n in windows}).where(F.col("x").isNotNull())
    return long.groupBy("window_days").agg(
        F.count(F.lit(1)).alias("n"),
        round_even(safe_corr(F.col("cases").cast("double"), F.col("x")), 4).alias("pearson"),
    ).withColumn("reliable", F.col("n") >= RELIABLE_N)


def with_ranks(df: DataFrame, groups: list[str], column: str, out: str) -> DataFrame:
    """Average rank of a column inside each group, from running counts of distinct values.

    The rank table has one row per distinct value; it is joined back on the value.
    """
    counted = df.select(*groups, column).withColumn("n", F.lit(1).cast("bigint"))
    cum = cumulative_by_value(counted, groups, column, ["n"])
    ranks = cum.select(*groups, column, (F.col("cum_n") - (F.col("n") - 1) / 2).alias(out))
    return df.join(ranks, [*groups, column], "left")


def grid_correlations(grid: DataFrame, windows: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Pearson and Spearman of cases and gridded rain over 1..4 weeks.

    Pairs are merged to (window, cases, rain) with a count first; ranks come from running
    counts, so neither a hot value nor the row count of the grid meets one task.
    """
    long = _long(real_cell_rows(grid), ["cases"], "window_weeks", {n: f"cell_rain_{n}w" for n in windows}).where(F.col("x").isNotNull())
    # sums of the same readings in another order must tie
    long = long.withColumn("x", round_even(F.col("x"), 9))
    # read several times below, so computed once
    pairs = cut_lineage(long.groupBy("window_weeks", F.col("cases").cast("double").alias("y"), "x").agg(F.count(F.lit(1)).alias("n")))
    ranked = weighted_ranks(weighted_ranks(pairs, ["window_weeks"], "x", "rx"), ["window_weeks"], "y", "ry")
    out = ranked.groupBy("window_weeks").agg(
        F.sum("n").alias("n"), weighted_corr("x", "y", "n").alias("p"), weighted_corr("rx", "ry", "n").alias("s")
    )
    return out.select(
        "window_weeks", (F.col("window_weeks") * 7).alias("window_days"), "n",
        round_even(F.col("p"), 4).alias("pearson"), round_even(F.col("s"), 4).alias("spearman"),
        (F.col("n") >= RELIABLE_N).alias("reliable"),
    )


def weighted_ranks(pairs: DataFrame, groups: list[str], column: str, out: str) -> DataFrame:
    """As with_ranks for rows that carry a multiplicity n."""
    cum = cumulative_by_value(pairs.select(*groups, column, "n"), groups, column, ["n"])
    ranks = cum.select(*groups, column, (F.col("cum_n") - (F.col("n") - 1) / 2).alias(out))
    return pairs.join(ranks, [*groups, column])


def weighted_corr(x: str, y: str, n: str):
    """Pearson of rows with multiplicity; null when a side is constant."""
    a, b, w = F.col(x).cast("double"), F.col(y).cast("double"), F.col(n).cast("double")
    sw = F.sum(w)
    cov = F.sum(w * a * b) - F.sum(w * a) * F.sum(w * b) / sw
    va = F.sum(w * a * a) - F.sum(w * a) * F.sum(w * a) / sw
    vb = F.sum(w * b * b) - F.sum(w * b) * F.sum(w * b) / sw
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(cov, F.sqrt(va * vb)))


def correlation_matrix(grid: DataFrame, columns: Sequence[str] = MATRIX_COLUMNS) -> DataFrame:
    """Pairwise-complete Pearson matrix over rows with a real reading, in long form.

    Every row is sent to its column pairs and combined map-side by pair, which keeps the
    aggregate at three functions however many columns there are.
    """
    rows = real_station_rows(grid).select(*[F.col(c).cast("double").alias(c) for c in columns])
    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
        for i, a in enumerate(columns) for b in columns[i:]
    ])
    long = rows.select(F.explode(cells).alias("c")).select("c.*").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return long.groupBy("a", "b").agg(safe_corr(F.col("x"), F.col("y")).alias("r"), F.count(F.lit(1)).alias("n"))


def scatter(grid: DataFrame, column: str) -> DataFrame:
    """Points (rain of a window, cases) of rows that have both."""
    return grid.where(F.col(column).isNotNull() & F.col("cases").isNotNull()).select(
        "place", "place_name", "epi_year", "epi_week", "kind", F.col(column).alias("rain_mm"), "cases"
    )


def both_sources(grid: DataFrame) -> DataFrame:
    """One row per place and week where station and grid both have a value."""
    both = real_cell_rows(real_station_rows(grid))
    return both.groupBy("place", "epi_year", "epi_week").agg(
        round_even(F.max("rain_week"), 9).alias("station_mm"), round_even(F.max("cell_rain_1w"), 9).alias("grid_mm")
    )


def agreement(pairs: DataFrame, wet: float = WET_WEEK_MM) -> DataFrame:
    """Pearson, Spearman, errors, ratio of totals and wet-week agreement of two rain sources."""
    p = cut_lineage(pairs.where(F.col("station_mm").isNotNull() & F.col("grid_mm").isNotNull()).withColumn("_g", F.lit(1)))
    p = with_ranks(with_ranks(p, ["_g"], "grid_mm", "rg"), ["_g"], "station_mm", "rs")
    g, s = F.col("grid_mm"), F.col("station_mm")
    err = g - s
    wet_g, wet_s = g >= wet, s >= wet
    return p.agg(
        F.count(F.lit(1)).alias("n"),
        round_even(safe_corr(g, s), 4).alias("pearson"),
        round_even(safe_corr(F.col("rg"), F.col("rs")), 4).alias("spearman"),
        round_even(F.avg(F.abs(err)), 3).alias("mae"),
        round_even(F.sqrt(F.avg(err * err)), 3).alias("rmse"),
        round_even(F.avg(err), 3).alias("bias"),
        round_even(F.when(F.sum(s) > 0, F.sum(g) / F.sum(s)), 4).alias("total_ratio"),
        round_even(F.avg((wet_g == wet_s).cast("int")) * 100, 2).alias("wet_agreement_pct"),
        round_even(F.avg(F.when(wet_s, wet_g.cast("int"))) * 100, 2).alias("wet_recall_pct"),
    )


def city_agreement(pairs: DataFrame) -> DataFrame:
    """The same over weekly city means: does the grid get the when right."""
    city = pairs.groupBy("epi_year", "epi_week").agg(F.avg("grid_mm").alias("g"), F.avg("station_mm").alias("s"))
    ranked = city.withColumn("_g", F.lit(1)).withColumns({"rg": average_rank("g", ["_g"]), "rs": average_rank("s", ["_g"])})
    return ranked.agg(
        F.count(F.lit(1)).alias("n_weeks"),
        round_even(safe_corr(F.col("g"), F.col("s")), 4).alias("pearson"),
        round_even(safe_corr(F.col("rg"), F.col("rs")), 4).alias("spearman"),
    )


def place_agreement(pairs: DataFrame, least: int = 10) -> DataFrame:
    return pairs.groupBy("place").agg(
        F.count(F.lit(1)).alias("n_weeks"), round_even(safe_corr(F.col("grid_mm"), F.col("station_mm")), 4).alias("pearson")
    ).where(F.col("n_weeks") >= least)


def city_pairs(series: DataFrame, weather: DataFrame, variables: dict[str, str], targets: dict[str, str]) -> DataFrame:
    """Long table (kind, target, variable, series_index, epi_week, y, x) joined by (year, week).

    Weather is city-wide and one row per week; it is the small side. Values are kept to nine
    digits: means that differ only by the order of their sum must tie in the ranks.
    """
    w = _long(weather, ["epi_year", "epi_week"], "variable", variables).withColumn("x", round_even(F.col("x"), 9))
    y_items = F.array(*[F.struct(F.lit(t).alias("target"), F.col(c).cast("double").alias("y")) for t, c in targets.items()])
    y = series.select("kind", "epi_year", "epi_week", "series_index", F.explode(y_items).alias("_i")).select(
        "kind", "epi_year", "epi_week", "series_index", "_i.*"
    )
    return y.join(w, ["epi_year", "epi_week"])


SERIES = ["kind", "target", "variable"]


def remove_season(pairs: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Residual of both sides: value minus the mean of its week over all years."""
    season = W.partitionBy(*keys, "epi_week")
    return pairs.withColumns({c: round_even(F.col(c) - F.avg(c).over(season), 9) for c in ("y", "x")})


def lag_correlations(pairs: DataFrame, keys: Sequence[str] = SERIES, lags: Sequence[int] = LAGS) -> DataFrame:
    """Spearman of y[t] and x[t-k] for every lag of every series in one job, with p-value and n.

    Each x is sent to the weeks it lags into (13 copies of a calendar-sized series). A lag
    without enough rows still has its row.
    """
    keys = list(keys)
    order = W.partitionBy(*keys).orderBy("series_index")
    pos = pairs.withColumn("_t", F.row_number().over(order))
    shifted = pos.select(*keys, F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), "_t", "x").select(
        *keys, "lag", (F.col("_t") + F.col("lag")).alias("_t"), "x"
    )
    joined = shifted.join(pos.select(*keys, "_t", "y"), [*keys, "_t"]).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    part = [*keys, "lag"]
    ranked = joined.withColumns({"rx": average_rank("x", part), "ry": average_rank("y", part)})
    stats = ranked.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("rx"), F.col("ry")).alias("rho"))
    every = pairs.select(*keys).distinct().withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags])))
    out = every.join(stats, part, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p = correlation_p_value(F.col("rho"), F.col("n").cast("double"))
    return out.select(
        *part, round_even(F.col("rho"), 4).alias("spearman"), round_even(p, 4).alias("p_value"), "n",
        (F.col("n") >= RELIABLE_N).alias("reliable"),
    )


def raw_and_adjusted(pairs: DataFrame, keys: Sequence[str] = SERIES, lags: Sequence[int] = LAGS) -> DataFrame:
    """Lag fact table: raw and season-adjusted series side by side in one long table."""
    both = pairs.withColumn("adjusted", F.lit(False)).unionByName(remove_season(pairs, keys).withColumn("adjusted", F.lit(True)))
    return lag_correlations(both, [*keys, "adjusted"], lags)


def raw_against_adjusted(table: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    adj = F.col("adjusted")
    return table.groupBy(*keys, "lag").agg(
        F.max(F.when(~adj, F.col("spearman"))).alias("raw"),
        F.max(F.when(adj, F.col("spearman"))).alias("adjusted"),
        F.max(F.when(~adj, F.col("n"))).alias("n_raw"),
        F.max(F.when(adj, F.col("n"))).alias("n_adjusted"),
    )


def strongest_lag(table: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Strongest reliable lag as columns and as a sentence; the smaller lag wins a tie."""
    ok = F.col("reliable") & F.col("spearman").isNotNull()
    best = F.max_by(F.struct("lag", "spearman", "n"), F.when(ok, F.struct(F.abs("spearman"), -F.col("lag"))))
    out = table.groupBy(*keys).agg(F.count_if(ok).alias("_ok"), best.alias("b"))
    lag = F.col("b.lag")
    text = F.when(
        F.col("_ok") > 0,
        F.format_string(
            C.LAG_SENTENCE,
            lag, F.when(lag == 1, "semana").otherwise("semanas"), F.col("b.spearman"), F.col("b.n"),
        ),
    ).otherwise(C.NO_LAG_SENTENCE.format(n=RELIABLE_N))
    has = F.col("_ok") > 0
    return out.select(
        *keys, F.when(has, lag).alias("lag"), F.when(has, F.col("b.spearman")).alias("spearman"), F.when(has, F.col("b.n")).alias("n"), text.alias("sentence")
    )
