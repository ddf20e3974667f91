"""Raw tables to contracts: aliases, positions, lineage, unpivoted maps, unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weekwatch import contracts as C
from weekwatch.contracts import (
    DIMENSION_COLUMNS, LINEAGE, NOTIFICATION_ALIASES, NOTIFICATION_DATES, NOTIFICATION_SCHEMA,
)
from weekwatch.functions.dates import parse_date
from weekwatch.functions.text import clean_code, clean_text, place_key
from weekwatch.operators import routing


def resolve_aliases(columns: Sequence[str], aliases: dict[str, Sequence[str]] = NOTIFICATION_ALIASES) -> dict[str, str]:
    """Canonical field -> real column: the first known spelling present, whatever its case."""
    present = {c.strip().upper(): c for c in columns}
    return {field: present[a] for field, names in aliases.items() for a in [next((n for n in names if n in present), None)] if a}


def map_aliases(df: DataFrame, aliases: dict[str, Sequence[str]] = NOTIFICATION_ALIASES, keep: Sequence[str] = ()) -> DataFrame:
    """Canonical columns only; a field no spelling of which is present becomes null."""
    found = resolve_aliases(df.columns, aliases)
    return df.select(
        *[F.col(f"`{found[f]}`").cast("string").alias(f) if f in found else F.lit(None).cast("string").alias(f) for f in aliases], *keep
    )


def with_lineage(df: DataFrame, resource: Column, year: Column, run: Column, at: Column) -> DataFrame:
    return df.withColumns(dict(zip(LINEAGE, (resource, year.cast("int"), run, at.cast("timestamp")))))


def conform_notifications(raw: DataFrame, disease: Column, resource: Column, year: Column, run: Column, at: Column, refuse_at: float = 0.9) -> DataFrame:
    """Raw notifications in contract order plus reject_reason (null = valid).

    Works on many files at once: the divergence of codes is judged per resource, and a refused
    resource rejects all its rows.
    """
    df = map_aliases(
        raw.withColumns({"_disease": disease, "_resource": resource, "_year": year, "_run": run, "_at": at}),
        keep=["_disease", "_resource", "_year", "_run", "_at"],
    )
    df = df.withColumnRenamed("_disease", "tipo_arbovirose")
    cleaned = {}
    for f in NOTIFICATION_ALIASES:
        c = F.col(f)
        if f in NOTIFICATION_DATES:
            cleaned[f] = parse_date(c)
        elif f == "nome_bairro":
            cleaned[f] = clean_text(c)
        elif f == "ano_notificacao":
            cleaned[f] = clean_code(c).try_cast("bigint")
        else:
            cleaned[f] = clean_code(c)
    df = df.withColumns(cleaned)
    df = df.withColumns(dict(zip(LINEAGE, (F.col("_resource"), F.col("_year").cast("int"), F.col("_run"), F.col("_at").cast("timestamp")))))
    diverges = routing.code_diverges(F.col("tipo_arbovirose"), F.col("codigo_agravo"))
    df = df.withColumn("_div", diverges)
    files = routing.refuse_files(df, "_source_resource_id", F.col("codigo_agravo").isNotNull(), F.col("_div"), refuse_at)
    df = df.join(files.select("_source_resource_id", "refused", "n_present", "n_diverging"), "_source_resource_id", "left")
    whole = (
        F.coalesce("refused", F.lit(False)),
        F.format_string(C.FILE_REFUSED, "n_diverging", "n_present"),
    )
    out = routing.first_failing(df, [whole, *routing.notification_rules(F.col("_div"))])
    return out.select(*[F.col(f.name).cast(f.dataType) for f in NOTIFICATION_SCHEMA], routing.REASON)


def conform_dimension(raw: DataFrame, entity: str, order: str | None = None) -> DataFrame:
    """First N columns renamed by position and cleaned; null keys and later duplicates are dropped."""
    names, key_at = DIMENSION_COLUMNS[entity]
    source = [c for c in raw.columns if c != order]
    if len(source) < len(names):
        raise ValueError(f"dimension {entity!r} needs {len(names)} columns, found {len(source)}")
    text = lambda n: n.startswith("nome_") or n.endswith("_sigla") or n.startswith("sigla_")
    cols = [(clean_text if text(n) else clean_code)(F.col(f"`{c}`")).alias(n) for c, n in zip(source, names)]
    df = raw.select(*cols, (F.col(order) if order else F.monotonically_increasing_id()).alias("_order"))
    key = names[key_at]
    rest = [n for n in names if n != key]
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), "_order").alias("_r"))
    return first.select(*[F.col(key) if n == key else F.col(f"_r.{n}").alias(n) for n in names])


def dimension_metrics(raw: DataFrame, entity: str) -> DataFrame:
    """Rows read, without key and duplicated, from one aggregate over the cleaned key."""
    names, key_at = DIMENSION_COLUMNS[entity]
    key = clean_code(F.col(f"`{raw.columns[key_at]}`")).alias("k")
    per = raw.select(key).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    has = F.col("k").isNotNull()
    return per.agg(
        F.sum("n").alias("rows_read"), F.count_if(has).alias("rows_valid"),
        F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("without_key"),
        F.coalesce(F.sum(F.when(has, F.col("n") - 1)), F.lit(0)).alias("duplicated"),
    )


def yearly_map_to_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    """{year: value} map per place -> one row per place and year."""
    return df.select(key, F.explode(column).alias("_y", "population")).select(
        key, F.col("_y").cast("int").alias("epi_year"), F.col("population").cast("bigint").alias("population")
    )


def match_places_by_key(names: DataFrame, official: DataFrame, name: str = "name") -> DataFrame:
    """Joins a source's place names to the official ones by the accent-free key and its crosswalk."""
    a = names.withColumn("_k", place_key(F.col(name)))
    b = official.select(place_key(F.col("place_name")).alias("_k"), "place")
    return a.join(b, "_k", "left").drop("_k")


def missing_years(resources: DataFrame) -> DataFrame:
    """Years absent between a disease's first and last successful one."""
    ok = resources.where((F.col("role") == "fato") & (F.col("status") == "SUCCESS") & F.col("year").isNotNull())
    per = ok.groupBy("entity").agg(F.min("year").alias("lo"), F.max("year").alias("hi"), F.collect_set("year").alias("seen"))
    gaps = F.array_except(F.sequence("lo", "hi"), "seen")
    return per.select("entity", F.explode(gaps).alias("missing_year"))


def union_sources(*frames: DataFrame) -> DataFrame:
    """Union by name; columns a source lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
