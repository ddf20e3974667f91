"""What is in a table: column kinds, nulls, distinct values, duplicates, schema differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from weekwatch.contracts import GRID_KEY
from weekwatch.functions.numbers import pct, round_even

# Patterns of the inferred kinds, tried in this order.
KIND_PATTERNS = (("data", r"^\d{2}/\d{2}/\d{4}$"), ("inteiro", r"^-?\d+$"), ("decimal", r"^-?\d+[.,]\d+$"))


def column_profile(df: DataFrame, file: str | None = None) -> DataFrame:
    """Per file and column: inferred kind, nulls, share of nulls, distinct values.

    The table is unpivoted and merged to distinct values (map-side combine) before counting,
    so a hot value costs one row per task.
    """
    keys = [file] if file else []
    cols = [c for c in df.columns if c not in keys]
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols])
    values = (
        df.select(*keys, F.explode(items).alias("_i"))
        .groupBy(*keys, F.col("_i.column_name").alias("column_name"), F.col("_i.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = F.col("v").isNotNull()
    flags = {k: F.coalesce(F.bool_and(F.when(known, F.col("v").rlike(p))), F.lit(False)).alias(f"_{k}") for k, p in KIND_PATTERNS}
    agg = values.groupBy(*keys, "column_name").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_null"), F.count("v").alias("n_distinct"), *flags.values()
    )
    kind = F.when(F.col("n_distinct") == 0, "vazio")
    for k, _ in KIND_PATTERNS:
        kind = kind.when(F.col(f"_{k}"), k)
    return agg.select(
        *keys, "column_name", kind.otherwise("texto").alias("kind"), "n_rows", "n_null",
        pct(F.col("n_null"), F.col("n_rows"), 2).alias("pct_null"), "n_distinct",
    )


def duplicate_rows(df: DataFrame, file: str | None = None) -> DataFrame:
    """Rows, distinct rows and exact duplicates per file."""
    keys = [file] if file else []
    merged = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    out = merged.groupBy(*keys) if keys else merged
    return out.agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.col("_n") - 1).alias("n_duplicates"))


def schema_summary(profile: DataFrame, file: str) -> DataFrame:
    """Per column over files: where present, where absent, exclusive to one, kinds and whether they change."""
    files = profile.agg(F.array_sort(F.collect_set(file)).alias("f")).select("f").scalar()
    normal = profile.withColumn("column_name", F.upper(F.trim("column_name")))
    out = normal.groupBy("column_name").agg(
        F.array_sort(F.collect_set(file)).alias("present_in"),
        F.array_sort(F.collect_set(F.when(F.col("kind") != "vazio", F.col("kind")))).alias("kinds"),
    ).withColumn("_all", files)
    return out.select(
        "column_name", "present_in", F.array_except("_all", "present_in").alias("absent_in"),
        (F.size("present_in") == F.size("_all")).alias("in_all"), (F.size("present_in") == 1).alias("exclusive"),
        "kinds", (F.size("kinds") > 1).alias("kind_changes"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column of a wide table, one pass."""
    n = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return n.unpivot(["_rows"], list(df.columns), "column_name", "n_null").select(
        "column_name", "n_null", pct(F.col("n_null"), F.col("_rows"), 4).alias("pct_null")
    )


def grid_profile(grid: DataFrame, key: Sequence[str] = GRID_KEY) -> DataFrame:
    """Structure, distribution of cases and climate figures of the analytic table in one row."""
    has = F.coalesce("valid_days_week", F.lit(0)) > 0
    dup = grid.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("d")).select("d").scalar()
    c = F.col("cases")
    n = F.count(F.lit(1))
    return grid.agg(
        n.alias("n_rows"), F.countDistinct("place").alias("n_places"), F.countDistinct("kind").alias("n_kinds"),
        F.min("epi_year").alias("first_year"), F.max("epi_year").alias("last_year"),
        F.countDistinct(F.col("epi_year") * 100 + F.col("epi_week")).alias("n_weeks"),
        F.min("week_start").alias("first_day"), F.max("week_end").alias("last_day"),
        F.sum(c).alias("cases"), round_even(F.avg(c), 4).alias("cases_mean"), F.percentile(c, 0.5).alias("cases_median"),
        F.max(c).alias("cases_max"), F.min(c).alias("cases_min"), F.count_if(c > 0).alias("rows_with_case"), F.count_if(c < 0).alias("rows_negative"),
        pct(F.count_if(c > 0), n, 4).alias("pct_with_case"),
        F.count_if(has).alias("rows_with_reading"), F.count_if(F.col("rain_week") < 0).alias("negative_rain"),
        round_even(F.avg(F.when(has, F.col("rain_week"))), 4).alias("rain_mean"), F.max(F.when(has, F.col("rain_week"))).alias("rain_max"),
        F.min(F.when(has, F.col("week_start"))).alias("reading_first"), F.max(F.when(has, F.col("week_end"))).alias("reading_last"),
    ).withColumn("duplicate_keys", dup)
