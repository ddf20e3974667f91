"""Population per place and year from a few checkpoints and official totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from weekwatch.functions.numbers import pct, round_even
from weekwatch.functions.ordered import row_numbers

SMALL_PLACE = 1000
HIGH_GROWTH_PCT = 50.0


def official_totals(totals: DataFrame) -> DataFrame:
    """(epi_year, total): a missing year becomes the geometric mean of its neighbours.

    One row per year, so ordering the years in one task is bounded.
    """
    w = W.orderBy("epi_year")
    mean = F.sqrt(F.lag("total").over(w) * F.lead("total").over(w))
    return totals.select("epi_year", F.coalesce(F.col("total").cast("double"), mean).alias("total"))


def scaled_growth(anchors: DataFrame, first_year: int, last_year: int, years: Sequence[int], totals: DataFrame) -> DataFrame:
    """Geometric growth between two anchors, scaled every year to the official total.

    `anchors` has (place, p0, p1); without a total the factor is 1.
    """
    span = last_year - first_year
    growth = F.pow(F.try_divide(F.col("p1"), F.col("p0")), F.lit(1.0 / span))
    prelim = anchors.withColumn("epi_year", F.explode(F.array(*[F.lit(y) for y in years]))).withColumn(
        "_prelim", F.col("p0") * F.pow(growth, (F.col("epi_year") - first_year).cast("double"))
    )
    sums = prelim.groupBy("epi_year").agg(F.sum("_prelim").alias("_sum"))
    factor = sums.join(totals, "epi_year", "left").select(
        "epi_year", F.col("total").alias("reference_total"), F.coalesce(F.try_divide(F.col("total"), F.col("_sum")), F.lit(1.0)).alias("factor")
    )
    return prelim.join(F.broadcast(factor), "epi_year").select(
        "place", "epi_year", (F.col("_prelim") * F.col("factor")).alias("population"), "reference_total", "factor"
    )


def hold_out(checkpoints: DataFrame, first: tuple[str, int], middle: tuple[str, int], last: tuple[str, int], totals: DataFrame) -> DataFrame:
    """Per place: the middle checkpoint predicted from the outer two against its real value."""
    anchors = checkpoints.select("place", F.col(first[0]).alias("p0"), F.col(last[0]).alias("p1"))
    pred = scaled_growth(anchors, first[1], last[1], [middle[1]], totals).select("place", F.col("population").alias("predicted"))
    out = pred.join(checkpoints.select("place", F.col(middle[0]).cast("double").alias("real")), "place", "left")
    err = F.col("predicted") - F.col("real")
    return out.withColumns({"abs_error": F.abs(err), "pct_error": F.try_divide(100.0 * F.abs(err), F.col("real")), "bias": err})


def hold_out_summary(held: DataFrame) -> DataFrame:
    return held.agg(
        F.avg("abs_error").alias("mae"),
        F.avg("pct_error").alias("mape_pct"),
        F.avg("bias").alias("bias_mean"),
        F.max("pct_error").alias("max_pct_error"),
        F.max_by("place", F.struct("pct_error", -F.col("place"))).alias("worst_place"),
        F.count(F.lit(1)).alias("n_places"),
    )


def atypical_places(checkpoints: DataFrame, start: str, end: str, small: int = SMALL_PLACE) -> DataFrame:
    """Small, fast growing or shrinking places; reported, never smoothed."""
    change = F.try_divide(100.0 * (F.col(end) - F.col(start)), F.col(start))
    return checkpoints.select(
        "place", F.col(start).alias("population_start"), F.col(end).alias("population_end"), change.alias("change_pct"),
        (F.col(end) < small).alias("very_small"), (change > HIGH_GROWTH_PCT).alias("high_growth"), (change < 0).alias("shrinking"),
    ).where(F.col("very_small") | F.col("high_growth") | F.col("shrinking"))


METHODS = ("fixed_share", "long_trend", "recent_trend")


def projections(checkpoints: DataFrame, a: tuple[str, int], b: tuple[str, int], c: tuple[str, int], years: Sequence[int], totals: DataFrame) -> DataFrame:
    """Three ways past the last census, in one long table: its shares, the long and the recent trend."""
    last = F.col(c[0]).cast("double")
    factor = {
        "fixed_share": F.lit(1.0),
        "long_trend": F.pow(F.try_divide(last, F.col(a[0])), F.lit(1.0 / (c[1] - a[1]))),
        "recent_trend": F.pow(F.try_divide(last, F.col(b[0])), F.lit(1.0 / (c[1] - b[1]))),
    }
    items = F.array(*[F.struct(F.lit(m).alias("method"), factor[m].alias("g")) for m in METHODS])
    raw = (
        checkpoints.withColumn("_i", F.explode(items))
        .withColumn("epi_year", F.explode(F.array(*[F.lit(y) for y in years])))
        .select("place", "_i.method", "epi_year", (last * F.pow(F.col("_i.g"), (F.col("epi_year") - c[1]).cast("double"))).alias("_raw"))
    )
    sums = raw.groupBy("method", "epi_year").agg(F.sum("_raw").alias("_sum")).join(totals, "epi_year")
    return raw.join(F.broadcast(sums), ["method", "epi_year"]).select(
        "method", "place", "epi_year", (F.col("_raw") * F.col("total") / F.col("_sum")).alias("population")
    )


def growth_dispersion(projected: DataFrame) -> DataFrame:
    """Per method: mean over years of the spread over places of yearly growth (sample deviation)."""
    w = W.partitionBy("method", "place").orderBy("epi_year")
    grown = projected.withColumn("g", F.try_divide(F.col("population"), F.lag("population").over(w)) - 1).where(F.col("g").isNotNull())
    return grown.groupBy("method", "epi_year").agg(F.stddev_samp("g").alias("s")).groupBy("method").agg(F.avg("s").alias("dispersion"))


def steadiest_method(dispersion: DataFrame) -> DataFrame:
    """Lowest dispersion wins; ties (to twelve digits) go to the order of METHODS."""
    order = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    return dispersion.agg(F.min_by("method", F.struct(round_even(F.col("dispersion"), 12), order)).alias("method"))


def full_series(
    estimates: DataFrame, checkpoints: DataFrame, totals: DataFrame, a: tuple[str, int], b: tuple[str, int],
    c: tuple[str, int], gap_years: Sequence[int], future_years: Sequence[int],
) -> DataFrame:
    """place x year with value type, method and checkpoints: estimates, gap, census, projection.

    Rounded half-even to whole people.
    """
    def part(df, kind, method, before, after):
        return df.select(
            "place", "epi_year", F.col("population").cast("double").alias("population"), kind.alias("population_type"), method.alias("method"),
            before.cast("int").alias("checkpoint_before"), after.cast("int").alias("checkpoint_after"),
        )

    lit, null = F.lit, F.lit(None)
    y = F.col("epi_year")
    direct = part(
        estimates, F.when(y == a[1], "censo_observado").otherwise("estimativa_intercensitaria"),
        F.when(y == a[1], "censo_direto").otherwise("participacao_proporcional"),
        F.when(y == b[1], b[1]).otherwise(a[1]), F.when(y == a[1], a[1]).otherwise(b[1]),
    )
    anchors = checkpoints.select("place", F.col(b[0]).alias("p0"), F.col(c[0]).alias("p1"))
    gap = part(scaled_growth(anchors, b[1], c[1], gap_years, totals), lit("estimativa_intercensitaria"), lit("cagr_reconciliado"), lit(b[1]), lit(c[1]))
    census = part(checkpoints.select("place", lit(c[1]).alias("epi_year"), F.col(c[0]).alias("population")), lit("censo_observado"), lit("censo_direto"), lit(c[1]), lit(c[1]))
    proj = projections(checkpoints, a, b, c, future_years, totals)
    best = steadiest_method(growth_dispersion(proj)).select("method").scalar()
    future = part(proj.where(F.col("method") == best), lit("projecao_pos_censo"), F.col("method"), lit(c[1]), null)
    out = direct.unionByName(gap).unionByName(census).unionByName(future)
    return out.withColumn("population", F.rint("population").cast("bigint"))


def reconciliation(series: DataFrame, totals: DataFrame) -> DataFrame:
    """Per year: sum over places against the official total."""
    sums = series.groupBy("epi_year").agg(F.sum("population").alias("places_total"))
    diff = F.col("places_total") - F.col("total")
    return sums.join(totals, "epi_year", "left").select(
        "epi_year", "places_total", F.col("total").alias("official_total"), diff.alias("difference"),
        pct(diff, F.col("total"), 4).alias("difference_pct"),
    )


def signed_errors(held: DataFrame) -> DataFrame:
    """Signed percentage errors of the hold-out: the sample the perturbation draws from."""
    return held.select(F.try_divide(100.0 * F.col("bias"), F.col("real")).alias("error_pct")).where(F.col("error_pct").isNotNull())


def perturbed(population: DataFrame, errors: DataFrame, replicas: int = 20, seed: int = 42, types: Sequence[str] = ("estimativa", "projecao")) -> DataFrame:
    """Every replica of the population table with drawn errors on the estimated rows.

    The sorted error sample is a table of ranks. A row draws a rank by the md5 sum of (seed, replica, place, year), the same
    for any partitioning, and joins it; ranks are drawn alike, so no rank is hot. Rows without an error to draw stay as they are.
    """
    sample = row_numbers(errors.select("error_pct"), [F.asc("error_pct")], "_rank")
    n = sample.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    copies = population.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("replica", "place", "epi_year")])
    number = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint")
    hit = F.when(F.col("population_type").isin(*types), F.pmod(number, F.nullif(n, F.lit(0))) + 1)
    drawn = copies.withColumn("_hit", hit).join(sample, F.col("_hit") == F.col("_rank"), "left")
    changed = F.when(F.col("error_pct").isNotNull(), F.greatest(F.lit(1.0), F.rint(F.col("population") * (1 + F.col("error_pct") / 100))))
    return drawn.withColumn("population", F.coalesce(changed, F.col("population")).cast("bigint")).drop("_hit", "_rank", "error_pct")


def replica_rates(grid: DataFrame, perturbed_population: DataFrame) -> DataFrame:
    """Rates of every replica in one job; the replica is part of the window key."""
    from weekwatch.functions.numbers import rate_100k

    base = grid.select("place", "kind", "epi_year", "epi_week", "week_index", "cases")
    joined = base.join(perturbed_population, ["place", "epi_year"])
    w = W.partitionBy("replica", "place", "kind").orderBy("week_index").rowsBetween(-3, 0)
    pop = F.col("population")
    return joined.withColumns({"rate_1w": rate_100k(F.col("cases"), pop), "rate_4w": rate_100k(F.sum("cases").over(w), pop)})


def sensitivity(rates: DataFrame) -> DataFrame:
    """Spread of the yearly rate over replicas."""
    per = rates.groupBy("replica", "kind", "epi_year").agg(F.avg("rate_4w").alias("m"))
    return per.groupBy("kind", "epi_year").agg(
        F.count(F.lit(1)).alias("n_replicas"), F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high")
    )
