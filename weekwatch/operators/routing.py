"""Rules that route rows: first failing reason, whole-file refusal, guards on requests."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weekwatch import contracts as C
from weekwatch.contracts import DISEASE_CODES, DISEASES
from weekwatch.functions.text import clean_text, disease_code_key, first_year_in, plain_lower

REASON = "reject_reason"


def first_failing(df: DataFrame, rules: Sequence[tuple[Column, str | Column]]) -> DataFrame:
    """Adds the first matching reason, null for a valid row."""
    def label(r):
        return r if isinstance(r, Column) else F.lit(r)

    return df.withColumn(REASON, F.coalesce(*[F.when(cond, label(text)) for cond, text in rules]))


def valid(df: DataFrame) -> DataFrame:
    return df.where(F.col(REASON).isNull()).drop(REASON)


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col(REASON).isNotNull())


def reason_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, REASON).agg(F.count(F.lit(1)).alias("n_rows"))


def notification_rules(diverges: Column) -> list[tuple[Column, str]]:
    return [
        (F.col("id_notificacao").isNull(), C.NO_ID),
        (~F.col("tipo_arbovirose").isin(*DISEASES), C.BAD_DISEASE),
        (diverges, C.BAD_CODE),
    ]


def code_diverges(disease: Column, code: Column, codes: dict[str, Iterable[str]] = DISEASE_CODES) -> Column:
    """True when a present code is none of the declared disease's codes."""
    key = disease_code_key(code)
    allowed = F.create_map(*[x for d, cs in codes.items() for x in (F.lit(d), F.array(*[F.lit(c) for c in cs]))])
    return F.coalesce(key.isNotNull() & ~F.array_contains(F.try_element_at(allowed, disease), key), F.lit(False))


def refuse_files(df: DataFrame, file: str, present: Column, diverges: Column, limit: float = 0.9) -> DataFrame:
    """(file, n_present, n_diverging, divergence, refused): the file is refused at `limit` of its present codes.

    One row per file, so the join back broadcasts when the file list is small and shuffles when not.
    """
    return df.groupBy(file).agg(
        F.count_if(present).alias("n_present"), F.count_if(diverges).alias("n_diverging")
    ).withColumn(
        "divergence", F.when(F.col("n_present") > 0, F.col("n_diverging") / F.col("n_present")).otherwise(0.0)
    ).withColumn("refused", F.col("divergence") >= limit)


def station_rules(duplicate: Column) -> list[tuple[Column, str]]:
    return [
        (F.col("station").isNull(), C.NO_STATION),
        ((F.abs("lat") > 90) | (F.abs("lon") > 180), C.BAD_COORDINATES),
        (duplicate, C.DUPLICATE_STATION),
    ]


def grid_filter(
    df: DataFrame,
    kind: str | None = None,
    first_year: int | None = None,
    last_year: int | None = None,
    region: int | None = None,
    place: int | None = None,
    kinds: Iterable[str] = DISEASES,
) -> DataFrame:
    """Any combination of filters; an unknown kind is an error, an absent filter keeps all rows."""
    if kind is not None:
        if kind not in kinds:
            raise ValueError(f"unknown kind {kind!r}, expected one of {tuple(kinds)}")
        df = df.where(F.col("kind") == kind)
    if first_year is not None:
        df = df.where(F.col("epi_year") >= first_year)
    if last_year is not None:
        df = df.where(F.col("epi_year") <= last_year)
    if region is not None:
        df = df.where(F.col("region") == region)
    if place is not None:
        df = df.where(F.col("place") == place)
    return df


class InvalidRequest(ValueError):
    """A requested value does not exist in the data."""


def check_requests(requests: DataFrame, domain: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests that name nothing in the data (empty when all are fine)."""
    return requests.join(domain.select(*keys).distinct(), list(keys), "left_anti")


def check_choice(value, allowed: Iterable, label: str, allow_null: bool = True):
    options = list(allowed)
    if value is None:
        if allow_null:
            return None
        raise InvalidRequest(f"{label} is required")
    if value not in options:
        raise InvalidRequest(f"{label}: {value!r} is not one of the values present")
    return value


def check_years(first: int, last: int, available: Iterable[int]) -> tuple[int, int]:
    """Interval inside the available years; a reversed one is swapped."""
    years = sorted(available)
    lo, hi = min(first, last), max(first, last)
    if not years or lo < years[0] or hi > years[-1]:
        raise InvalidRequest(f"years {first}..{last} outside the data")
    return lo, hi


def check_week(year: int, week: int, pairs: Iterable[tuple[int, int]]) -> tuple[int, int]:
    if (year, week) not in set(pairs):
        raise InvalidRequest(f"week {year}-{week:02d} is not in the data")
    return year, week


def check_top_k(value: int, allowed: Iterable[int]) -> int:
    if value not in tuple(allowed):
        raise InvalidRequest(f"K={value} is not offered")
    return value


class UnexpectedFutureData(ValueError):
    """Observed rows beyond the last validated year."""


def future_years(df: DataFrame, last_year: int) -> DataFrame:
    return df.where(F.col("epi_year") > last_year).select("epi_year").distinct()


def require_no_future(df: DataFrame, last_year: int) -> None:
    # one row: the calendar bounds the years
    years = future_years(df, last_year).agg(F.sort_array(F.collect_set("epi_year"))).first()[0]
    if years:
        raise UnexpectedFutureData(f"years {years} lie beyond {last_year}")


def require_publishable(df: DataFrame, forbidden: Iterable[str]) -> None:
    bad = sorted({c.lower() for c in df.columns} & {f.lower() for f in forbidden})
    if bad:
        raise ValueError(f"forbidden columns: {bad}")


def classify_resource(name: Column, fmt: Column, formats: Iterable[str] = ("csv",)) -> Column:
    """struct(role, entity, year) of a catalogue entry, null when out of scope."""
    text = plain_lower(name)
    form = F.lower(F.trim(F.coalesce(fmt, F.lit(""))))
    year = first_year_in(text)
    none = F.lit(None).cast("int")

    def out(role: str, entity: str, y: Column = none) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit(entity).alias("entity"), y.alias("year"))

    scope = (text != "") & ((form == "") | form.isin(*formats)) & ~text.contains("metadado")
    rules = (
        F.when(text.rlike(r"\bdengue\b"), out("fato", "dengue", year))
        .when(text.rlike(r"\bzi[ck]a\b"), out("fato", "zika", year))
        .when(text.contains("chikungunya"), out("fato", "chikungunya", year))
    )
    for entity in ("bairro", "distrito", "agravo", "municipio"):
        rules = rules.when(text.contains(entity), out("dimensao", entity))
    rules = rules.when(text.rlike(r"\buf\b"), out("dimensao", "uf"))
    return F.when(scope, rules)


def classify_territory(name: Column, fmt: Column, formats: Iterable[str] = ("geojson", "json")) -> Column:
    text = plain_lower(name)
    form = F.lower(F.trim(F.coalesce(fmt, F.lit(""))))
    return F.when(
        ((form == "") | form.isin(*formats)) & text.contains("bairro") & ~text.contains("microrregiao"), "bairro"
    )


def metro_rain_stations(status: DataFrame, cities: Iterable[str]) -> DataFrame:
    """Stations of type 1 (rain gauge) whose cleaned city is in the list."""
    return status.where((F.col("station_type") == 1) & clean_text(F.col("city")).isin(*cities))
