"""Weekly features that end at the row's own week, and their named groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from weekwatch.contracts import CASE_LAGS
from weekwatch.functions.numbers import RATIO_EPS, week_angle

BY = ("place", "kind")

BASE = ("cases_t", "lag_1", "lag_2", "lag_3", "lag_4", "mean_2w", "mean_4w", "mean_8w", "sum_4w", "max_4w", "trend_1w", "state_t")
SEASON = ("epi_week", "month", "quarter", "week_sin", "week_cos", "week_mean")
TERRITORY = ("area_km2", "lat", "lon")
TERRITORY_CODES = ("region",)
LOCAL_HISTORY = ("threshold_ratio", "z_score", "recent_ratio")
MOMENTUM = ("delta_1w", "delta_2w", "acceleration", "growth", "rising_weeks")
STATION_WEATHER = ("rain_week", "rain_day_mean", "rain_day_max", "rain_days", "completeness", "rain_7d", "rain_14d", "rain_21d", "rain_28d")
CELL_WEATHER = ("cell_rain_1w", "cell_rain_2w", "cell_rain_3w", "cell_rain_4w", "cell_temp_mean", "cell_temp_min", "cell_temp_max", "cell_humidity")
RATE_BASE = ("rate_t", "rate_lag_1", "rate_lag_2", "rate_lag_3", "rate_lag_4", "rate_4w", "rate_8w", "rate_delta", "rate_state_t")
RATE_HISTORY = ("rate_threshold_ratio", "rate_deviation")
RATE_SEASON = ("epi_week", "month", "quarter", "week_sin", "week_cos", "week_mean_rate")
POPULATION = ("log_population", "density")
VARIANTS = ("v1_features", "v1_mais_populacao", "v2_incidencia", "v2_casos_incidencia", "v2_casos_incidencia_populacao")


def week_index(df: DataFrame) -> DataFrame:
    """Position of a week among the distinct weeks, 0 first.

    The distinct calendar has one row per week (a century is 5,200), so ordering it in one
    task is bounded; the facts are only joined to it.
    """
    weeks = df.select("epi_year", "epi_week", "week_start").distinct()
    indexed = weeks.select(
        "epi_year", "epi_week", (F.row_number().over(W.orderBy("week_start")) - 1).alias("week_index")
    )
    return df.drop("week_index").join(F.broadcast(indexed), ["epi_year", "epi_week"], "left")


def calendar_features(df: DataFrame) -> DataFrame:
    angle = week_angle(F.col("epi_week"))
    return df.withColumns(
        {
            "month": F.month("week_end"),
            "quarter": F.quarter("week_end"),
            "week_sin": F.sin(angle),
            "week_cos": F.cos(angle),
        }
    )


def case_features(states: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Lags, rolling figures, momentum and local history from the state table."""
    w = W.partitionBy(*by).orderBy("week_index")
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    c = F.col("cases")
    out = states.withColumns(
        {
            "cases_t": c,
            **{f"lag_{k}": F.lag("cases", k).over(w) for k in CASE_LAGS},
            **{f"mean_{n}w": F.avg("cases").over(last(n)) for n in (2, 4, 8)},
            "sum_4w": F.sum("cases").over(last(4)),
            "max_4w": F.max("cases").over(last(4)),
            "state_t": F.col("state"),
        }
    )
    l1, l2 = F.col("lag_1"), F.col("lag_2")
    series = ["cases_t"] + [f"lag_{k}" for k in CASE_LAGS]
    rises = [F.coalesce(F.col(a) > F.col(b), F.lit(False)) for a, b in zip(series, series[1:])]
    rising = F.lit(0)
    for r in reversed(rises):
        rising = F.when(r, rising + 1).otherwise(0)
    out = out.withColumns(
        {
            "trend_1w": c - l1,
            "threshold_ratio": c / (F.col("threshold") + RATIO_EPS),
            "z_score": (c - F.col("week_mean")) / (F.col("week_std") + RATIO_EPS),
            "recent_ratio": c / (F.col("mean_4w") + RATIO_EPS),
            "delta_1w": c - l1,
            "delta_2w": c - l2,
            "acceleration": c - 2 * l1 + l2,
            "growth": (c - l1) / (l1 + RATIO_EPS),
            "rising_weeks": rising.cast("double"),
        }
    )
    return calendar_features(out)


def rate_features(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Needs rate_1w and the state columns with suffix _rate."""
    w = W.partitionBy(*by).orderBy("week_index")
    r = F.col("rate_1w")
    out = df.withColumns(
        {"rate_t": r, **{f"rate_lag_{k}": F.lag("rate_1w", k).over(w) for k in CASE_LAGS}, "rate_state_t": F.col("state_rate")}
    )
    return out.withColumns(
        {
            "rate_delta": r - F.col("rate_lag_1"),
            "rate_threshold_ratio": r / (F.col("threshold_rate") + RATIO_EPS),
            "rate_deviation": (r - F.col("week_mean_rate")) / (F.col("week_std_rate") + RATIO_EPS),
            "log_population": F.log1p("population"),
        }
    )


def feature_names(
    season: bool = True, territory: bool = True, local_history: bool = True, momentum: bool = True,
    weather: bool = False, cell_weather: bool = False, present: Sequence[str] | None = None,
) -> list[str]:
    """Numeric feature columns by group; asking for an absent gridded group is an error."""
    names = list(BASE)
    for on, group in ((season, SEASON), (territory, TERRITORY), (local_history, LOCAL_HISTORY), (momentum, MOMENTUM), (weather, STATION_WEATHER)):
        names += list(group) if on else []
    if cell_weather:
        missing = [c for c in CELL_WEATHER if present is not None and c not in present]
        if missing:
            raise ValueError(f"gridded weather asked for but absent: {missing}")
        names += list(CELL_WEATHER)
    return names


def one_hot(df: DataFrame, column: str, codes: Sequence) -> tuple[DataFrame, list[str]]:
    """One 0/1 column per code, sorted; a null code is all zero."""
    names = {f"{column}_{code}": F.when(F.col(column) == code, 1).otherwise(0) for code in sorted(codes)}
    return df.withColumns(names), list(names)


def distinct_codes(df: DataFrame, column: str) -> list:
    """The codes of a territory column: a handful of regions, read once to name the columns."""
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def variant_names(variant: str) -> list[str]:
    """The five feature compositions of the rate model."""
    v1 = feature_names()
    pure = list(RATE_BASE) + list(RATE_SEASON) + list(RATE_HISTORY) + list(TERRITORY)
    both = v1 + list(RATE_BASE) + list(RATE_HISTORY)
    table = {
        "v1_features": v1,
        "v1_mais_populacao": v1 + list(POPULATION),
        "v2_incidencia": pure,
        "v2_casos_incidencia": both,
        "v2_casos_incidencia_populacao": both + list(POPULATION),
    }
    if variant not in table:
        raise ValueError(f"unknown variant {variant!r}, expected one of {VARIANTS}")
    return table[variant]
