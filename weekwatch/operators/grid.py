"""Counts per place, kind and epidemiological week; joins that keep their promises."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, functions as F

from weekwatch.functions import dates
from weekwatch.functions.numbers import round_even
from weekwatch.functions.text import clean_text



def exact_duplicates_removed(df: DataFrame) -> DataFrame:
    """Rows equal in every business column; lineage columns start with an underscore."""
    return df.dropDuplicates([c for c in df.columns if not c.startswith("_")])


def with_period(events: DataFrame, text: str = "semana_notificacao") -> DataFrame:
    """Adds epi_year and epi_week of an AAAASS text; null where it is malformed."""
    period = dates.epi_period(F.col(text))
    return events.withColumns({"epi_year": period["epi_year"], "epi_week": period["epi_week"]})


def match_official_places(events: DataFrame, places: DataFrame, name: str = "place_name") -> DataFrame:
    """Left join by cleaned name; `name_status` says null_name, unknown_name or matched."""
    dim = places.select(
        clean_text(F.col("place_name")).alias("_key"),
        F.col("place").alias("official_place"),
        F.col("place_name").alias("official_name"),
    )
    keyed = events.withColumn("_key", clean_text(F.col(name)))
    return (
        keyed.join(one_row_per_key(dim, ["_key"]), "_key", "left")
        .withColumn(
            "name_status",
            F.when(F.col("_key").isNull(), "null_name")
            .when(F.col("official_place").isNull(), "unknown_name")
            .otherwise("matched"),
        )
        .drop("_key")
    )


def one_row_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Refuses duplicate keys at run time: the join that follows cannot multiply rows."""
    others = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*others) if others else F.lit(1)).alias("_row")
    )
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        F.raise_error(F.concat(F.lit("key is not unique: "), F.to_json(F.struct(*keys))))
    )
    # the error branch types as void, so the row type is kept by the first branch
    return grouped.select(*keys, checked.alias("_row")).select(*keys, *[F.col(f"_row.{c}") for c in others])


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """m:1 refuses duplicate keys on the right, 1:1 also on the left, 1:m only on the left."""
    if validate in ("m:1", "1:1"):
        right = one_row_per_key(right, on)
    if validate in ("1:m", "1:1"):
        left = one_row_per_key(left, on)
    return left.join(right, on, how)


def count_cases(events: DataFrame, keys: Iterable[str] = ("place", "kind", "epi_year", "epi_week")) -> DataFrame:
    """Rows, not distinct ids: the id is not unique across years."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"))


def calendar_row(counts: DataFrame, places: DataFrame, kinds: Iterable[str] | None = None, whole_years: bool = False) -> DataFrame:
    """One row with one struct: first and last week, kinds, and the first count that no place, kind or week start knows.

    `counts` has (place, kind, week_start, cases) and is read once for all of them.
    """
    lo, hi = F.min("week_start"), F.max("week_start")
    if whole_years:
        lo, hi = dates.week_one_start(dates.epi_year(lo)), F.date_sub(dates.week_one_start(dates.epi_year(hi) + 1), 7)
    kind = F.sort_array(F.collect_set("kind")) if kinds is None else F.array(*[F.lit(k) for k in kinds])
    stray = F.col("_known").isNull() | F.col("kind").isNull() | (F.col("week_start") != dates.sunday_of(F.col("week_start"))) | F.col("week_start").isNull()
    if kinds is not None:
        stray = stray | ~F.col("kind").isin(*kinds)
    cell = F.concat_ws(" ", F.lit("a count has no cell in the grid:"), F.col("place").cast("string"), "kind", F.col("week_start").cast("string"))
    known = counts.join(places.select("place", F.lit(True).alias("_known")).distinct(), "place", "left")
    return known.agg(F.struct(lo.alias("first"), hi.alias("last"), kind.alias("kinds"), F.min(F.when(stray, cell)).alias("lost")).alias("c"))


def dense_grid(counts: DataFrame, places: DataFrame, kinds: Iterable[str] | None = None, whole_years: bool = False) -> DataFrame:
    """Every place, kind and week between the first and the last count (or of their whole epidemiological years); absent counts are a real 0.

    `counts` has (place, kind, week_start, cases); without `kinds` those of the counts are taken. The frame is
    generated from the place table by explode, so the grid costs no shuffle of its own. A count that has no
    cell in the frame fails the job before the frame is made: no case is lost in silence.
    """
    row = calendar_row(counts, places, kinds, whole_years).select("c").scalar()
    # a generator keeps the subquery from being copied into every use of its fields
    frame = places.withColumn("_c", F.explode(F.array(row)))
    checked = F.when(F.col("_c.lost").isNull(), F.col("_c.kinds")).otherwise(F.raise_error(F.col("_c.lost")).cast("array<string>"))
    frame = frame.withColumn("kind", F.explode(checked))
    frame = (
        frame.withColumn("week_start", F.explode(F.sequence("_c.first", "_c.last", F.expr("interval 7 days"))))
        .withColumns(
            {
                "week_end": F.date_add("week_start", 6),
                "epi_year": dates.epi_year(F.col("week_start")),
                "epi_week": dates.epi_week(F.col("week_start")),
                "week_index": (F.datediff("week_start", "_c.first") / 7).cast("int"),
            }
        )
        .drop("_c")
    )
    joined = frame.join(counts, ["place", "kind", "week_start"], "left")
    return joined.withColumn("cases", F.coalesce("cases", F.lit(0)).cast("bigint"))


def conservation(before: DataFrame, after: DataFrame, value: str = "cases") -> DataFrame:
    """One row: totals and rows on both sides and whether the total is kept."""
    a = before.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(value), F.lit(0)).alias("t"))
    b = after.agg(F.count(F.lit(1)).alias("rows_after"), F.coalesce(F.sum(value), F.lit(0)).alias("total_after"))
    return b.select(
        a.select("n").scalar().alias("rows_before"),
        "rows_after",
        a.select("t").scalar().alias("total_before"),
        "total_after",
    ).withColumn("conserved", F.col("total_before") == F.col("total_after"))


def require_conserved(before: DataFrame, after: DataFrame, value: str = "cases") -> None:
    row = conservation(before, after, value).first()
    if not row["conserved"]:
        raise ValueError(f"total changed: {row['total_before']} -> {row['total_after']}")


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Counts taken on the same pass as the action that follows."""
    watch = Observation(name)
    return df.observe(watch, *[c.alias(k) for k, c in metrics.items()]), watch


def enrich(grid: DataFrame, key: list[str], block: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Additive block: old columns of the block are dropped first, so a rerun gives the same table."""
    cols = list(columns)
    return grid.drop(*cols).join(block.select(*key, *cols), key, "left")


def reconcile_keys(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Both-sided comparison of two key tables with same-name suggestions for the left-overs.

    One row per key: side is both, only_left or only_right; `same_name_key` is the key under
    which the other side knows the same upper-cased name.
    """
    a = left.select(F.col(key), F.col(name).alias("left_name"), F.lit(True).alias("_l"))
    b = right.select(F.col(key), F.col(name).alias("right_name"), F.lit(True).alias("_r"))
    full = a.join(b, key, "full").withColumn(
        "side", F.when(F.col("_l").isNull(), "only_right").when(F.col("_r").isNull(), "only_left").otherwise("both")
    )
    upper = F.upper(F.trim(F.coalesce("left_name", "right_name")))
    rest = full.where(F.col("side") != "both").withColumn("_u", upper)
    other = rest.select(
        "_u",
        F.when(F.col("side") == "only_left", "only_right").otherwise("only_left").alias("side"),
        F.col(key).alias("_k"),
    ).groupBy("_u", "side").agg(F.min("_k").alias("same_name_key"))
    named = rest.join(other, ["_u", "side"], "left")
    cols = [key, "left_name", "right_name", "side"]
    both = full.where(F.col("side") == "both").select(*cols).withColumn("same_name_key", F.lit(None).cast(other.schema["same_name_key"].dataType))
    return both.unionByName(named.select(*cols, "same_name_key"))


def match_summary(reconciled: DataFrame) -> DataFrame:
    """One row of a reconciliation: keys by side, and the share of the right side's keys that the left one has, 0 without any."""
    side = lambda s: F.count_if(F.col("side") == s)
    known = side("both") + side("only_right")
    return reconciled.agg(
        side("both").alias("n_both"), side("only_left").alias("n_only_left"), side("only_right").alias("n_only_right"),
        F.count_if(F.col("same_name_key").isNotNull()).alias("n_same_name"),
        round_even(F.coalesce(F.try_divide(100.0 * side("both"), known), F.lit(0.0)), 2).alias("match_pct"),
    )


def orphans(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Distinct fact keys without a dimension row."""
    return fact.select(key).distinct().join(dim.select(key), key, "left_anti")
