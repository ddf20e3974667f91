"""Star schema over the analytic table: dimensions, facts, checks and measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from weekwatch.contracts import GRIDDED_BLOCK, RATE_BLOCK, STATION_BLOCK
from weekwatch.functions.dates import week_key
from weekwatch.functions.numbers import rate_100k, round_even
from weekwatch.functions.ordered import dense_ranks
from weekwatch.operators.grid import orphans
from weekwatch.session import cut_lineage


def _key() :
    return week_key(F.col("epi_year"), F.col("epi_week"))


def place_dimension(grid: DataFrame) -> DataFrame:
    cols = ["place_name", "region", "area_km2", "lat", "lon"]
    return grid.groupBy("place").agg(*[F.min(c).alias(c) for c in cols])


def week_dimension(grid: DataFrame, projected: DataFrame | None = None) -> DataFrame:
    """Observed weeks plus projected ones the table does not hold yet."""
    weeks = grid.select("epi_year", "epi_week", "week_start").distinct()
    if projected is not None:
        weeks = weeks.unionByName(projected.select("epi_year", "epi_week", "week_start")).distinct()
    return weeks.select(_key().alias("week_id"), "epi_year", "epi_week", "week_start", F.date_add("week_start", 6).alias("week_end"))


def kind_dimension(grid: DataFrame) -> DataFrame:
    return grid.select("kind").distinct()


def weekly_fact(grid: DataFrame) -> DataFrame:
    present = [c for c in RATE_BLOCK if c in grid.columns]
    return grid.select(_key().alias("week_id"), "place", "kind", "cases", *present)


def climate_fact(grid: DataFrame) -> DataFrame:
    """place x week: the weather of a place is the same for every kind and is stored once."""
    cols = [c for c in (*STATION_BLOCK, *GRIDDED_BLOCK) if c in grid.columns]
    return grid.groupBy(_key().alias("week_id"), "place").agg(*[F.max(c).alias(c) for c in cols])


def backtest_fact(backtest: DataFrame, columns: Sequence[str]) -> DataFrame:
    return backtest.select(_key().alias("week_id"), "place", "kind", *columns)


def projection_fact(artefact: DataFrame) -> DataFrame:
    return artefact.select(_key().alias("week_id"), *[c for c in artefact.columns if c not in ("epi_year", "epi_week", "week_start")])


def freshness_table(document: DataFrame) -> DataFrame:
    """Nested blocks (map name -> struct) to one row per data set; the detail block is left out."""
    value = document.schema["datasets"].dataType.valueType
    keep = [f.name for f in value.fields if f.name != "detalhe"]
    return document.select("gerado_em", F.explode("datasets").alias("name", "v")).select("name", *[F.col(f"v.{c}") for c in keep], "gerado_em")


def star_checks(
    places: DataFrame, weeks: DataFrame, kinds: DataFrame, facts: dict[str, tuple[DataFrame, Sequence[str]]],
    expected_places: int, forbidden: Sequence[str] = ("probab", "risco", "risk"),
) -> DataFrame:
    """(check, n): unique keys, integrity, no negative cases, lag 0..12, no probability or risk column.

    n counts violations; every row must be 0.
    """
    def dup(df, keys):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n"))

    def count(df):
        return df.agg(F.count(F.lit(1)).alias("n"))

    def named(label, one):
        return one.select(F.lit(label).alias("check"), F.col("n").cast("bigint").alias("n"))

    parts = [
        named("dim_place unique", dup(places, ["place"])),
        named("dim_week unique", dup(weeks, ["week_id"])),
        named("dim_kind unique", dup(kinds, ["kind"])),
        named("dim_place size", places.agg(F.abs(F.count(F.lit(1)) - expected_places).alias("n"))),
    ]
    for name, (fact, keys) in facts.items():
        parts.append(named(f"{name} unique", dup(fact, list(keys))))
        for key, dim in (("place", places), ("week_id", weeks), ("kind", kinds)):
            if key in fact.columns:
                parts.append(named(f"{name} {key} known", count(orphans(fact, dim, key))))
        if "cases" in fact.columns:
            parts.append(named(f"{name} cases not negative", fact.agg(F.count_if(F.col("cases") < 0).alias("n"))))
        if "lag" in fact.columns:
            parts.append(named(f"{name} lag in 0..12", fact.agg(F.count_if(~F.col("lag").between(0, 12)).alias("n"))))
        bad = [c for c in fact.columns if any(w in c.lower() for w in forbidden)]
        parts.append(named(f"{name} no probability column", places.agg(F.lit(len(bad)).alias("n"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require_star(checks: DataFrame) -> None:
    bad = checks.where(F.col("n") > 0).collect()
    if bad:
        raise ValueError("star schema checks failed: " + "; ".join(f"{r['check']}={r['n']}" for r in bad))


# --- measures -----------------------------------------------------------------------------


def weekly_measures(fact: DataFrame, weeks: DataFrame) -> DataFrame:
    """Per week: cases, last four weeks, previous week, relative change (blank without a base)."""
    per = fact.groupBy("week_id").agg(F.sum("cases").alias("cases")).join(F.broadcast(weeks.select("week_id", "week_start")), "week_id")
    # one row per week of the calendar
    w = W.orderBy("week_start")
    before = F.lag("cases").over(w)
    return per.select(
        "week_id", "cases", F.sum("cases").over(w.rowsBetween(-3, 0)).alias("cases_4w"), before.alias("cases_before"),
        F.when(before != 0, (F.col("cases") - before) / before).alias("change"),
    )


def place_measures(fact: DataFrame, weeks: DataFrame) -> DataFrame:
    """Per place: cases, population counted once, rates from totals, dense ranks, last week."""
    span = weeks.join(fact.select("week_id").distinct(), "week_id", "left_semi").agg(F.max("week_start").alias("d"), F.max("week_id").alias("w"))
    start, last = span.select("d").scalar(), span.select("w").scalar()
    f = fact.join(F.broadcast(weeks.select("week_id", "week_start")), "week_id")
    recent = F.datediff(start, "week_start") < 28
    out = f.groupBy("place").agg(
        F.sum("cases").alias("cases"),
        F.sum(F.when(recent, F.col("cases"))).alias("cases_4w"),
        F.avg("population").alias("population"),
        F.sum(F.when(F.col("week_id") == last, F.col("cases"))).alias("cases_last_week"),
    ).withColumn("last_week", last)
    out = out.withColumns(
        {"rate": rate_100k(F.col("cases"), F.col("population")), "rate_4w": rate_100k(F.col("cases_4w"), F.col("population"))}
    )
    # rates that differ only in their last bits share a rank
    return dense_ranks(dense_ranks(cut_lineage(out), F.col("cases"), "rank_cases"), round_even(F.col("rate"), 9), "rank_rate")
