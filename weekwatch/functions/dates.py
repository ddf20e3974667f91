"""Date spellings of the sources and the epidemiological calendar.

Weeks run Sunday to Saturday; week 1 is the one that holds 4 January.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weekwatch.functions.text import clean_code

# Accepted spellings, tried in this order. Single pattern letters
# because unpadded parts such as 4/3/2025 are valid input.
DATE_PATTERNS = ("d/M/yyyy", "yyyy-M-d", "yyyy/M/d H:m:s")


def parse_date(c: Column) -> Column:
    text = clean_code(c)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in DATE_PATTERNS])


def parse_two_digit_date(c: Column) -> Column:
    """DD/MM/YY with 00-68 in 20xx and 69-99 in 19xx."""
    text = F.trim(c)
    yy = F.regexp_extract(text, r"^\d{1,2}/\d{1,2}/(\d{2})$", 1).try_cast("int")
    century = F.when(yy <= 68, F.lit("20")).otherwise(F.lit("19"))
    full = F.concat(F.regexp_extract(text, r"^(\d{1,2}/\d{1,2}/)\d{2}$", 1), century, F.lpad(yy.cast("string"), 2, "0"))
    return F.when(yy.isNotNull(), F.try_to_timestamp(full, F.lit("d/M/yyyy")).cast("date"))


def parse_dashed_date(c: Column) -> Column:
    return F.try_to_timestamp(F.trim(c), F.lit("d-M-yyyy")).cast("date")


def parse_slashed_date(c: Column) -> Column:
    return F.try_to_timestamp(F.trim(c), F.lit("d/M/yyyy")).cast("date")


def parse_hour_label(c: Column) -> Column:
    hour = F.regexp_extract(c, r"^(\d+)h$", 1).try_cast("int")
    return F.when(hour.between(0, 23), hour)


def plausible_year(c: Column, low: int = 2000, high: int = 2100) -> Column:
    text = clean_code(c)
    year = F.when(text.rlike(r"^\d+$"), text.try_cast("int"))
    return F.when(year.between(low, high), year)


def sunday_of(d: Column) -> Column:
    return F.date_sub(d, F.dayofweek(d) - 1)


def week_one_start(year: Column) -> Column:
    return sunday_of(F.make_date(year, F.lit(1), F.lit(4)))


def week_start(year: Column, week: Column) -> Column:
    return F.date_add(week_one_start(year), ((week - 1) * 7).cast("int"))


def week_end(year: Column, week: Column) -> Column:
    return F.date_add(week_start(year, week), 6)


def weeks_in_year(year: Column) -> Column:
    return (F.datediff(week_one_start(year + 1), week_one_start(year)) / 7).cast("int")


def epi_year(d: Column) -> Column:
    """Year that owns the week of a date: the year of that week's Wednesday."""
    return F.year(F.date_add(sunday_of(d), 3))


def epi_week(d: Column) -> Column:
    return (F.datediff(sunday_of(d), week_one_start(epi_year(d))) / 7 + 1).cast("int")


def epi_period(text: Column) -> Column:
    """struct(year, week) of an AAAASS text, null when malformed or the week is not 1..53."""
    week = F.substring(text, 5, 2).try_cast("int")
    year = F.substring(text, 1, 4).try_cast("int")
    return F.when(
        text.rlike(r"^\d{6}$") & week.between(1, 53),
        F.struct(year.alias("epi_year"), week.alias("epi_week")),
    )


def week_key(year: Column, week: Column) -> Column:
    return (year.cast("bigint") * 100 + week).cast("bigint")


def week_label(year: Column, week: Column) -> Column:
    return F.when(year.isNotNull() & week.isNotNull(), F.format_string("%d-%02d", year, week))
