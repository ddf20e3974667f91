"""JSON feeds: station snapshots, hour matrices, parallel daily arrays, polygons, population maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from weekwatch.contracts import RINGS
from weekwatch.functions.dates import parse_dashed_date, parse_hour_label, parse_slashed_date
from weekwatch.functions.geo import cell_id
from weekwatch.functions.numbers import plain_float
from weekwatch.functions.text import clean_code, clean_text

# Titles looked up in a snapshot.
LAST_DAY_TITLE, RAIN_24H_TITLE = "Data último dado", "24 Horas"
# Provider variable -> column, per layer.
LAYER_VARIABLES = {
    "ERA5": {"precipitation_sum": "rain_mm"},
    "ERA5-LAND": {
        "temperature_2m_mean": "temp_mean", "temperature_2m_min": "temp_min", "temperature_2m_max": "temp_max",
        "relative_humidity_2m_mean": "humidity",
    },
}

_POINT_INFO = "struct<id:string,nome:string,latitude:string,longitude:string>"
_PAIRS = "struct<dados:array<struct<titulo:string,valor:string>>>"
SNAPSHOT = f"pontos map<string, struct<ponto:{_POINT_INFO},`3`:struct<valor:string>,dados_monitorados:{_PAIRS}>>"
MATRIX = "datas array<string>, horarios array<string>, acumulados array<array<string>>"


class SchemaDrift(ValueError):
    """A variable the contract names is missing from the feed."""


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): one whole JSON document per row."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def _points(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.explode(F.from_json("value", SNAPSHOT)["pontos"]).alias("_k", "_p")).where(F.col("_k") != "metadados")


def snapshot_daily(docs: DataFrame) -> DataFrame:
    """24-hour rain of every station at its last reported day."""
    titles = F.map_from_entries(F.transform("_p.dados_monitorados.dados", lambda d: F.struct(d["titulo"], d["valor"])))
    return _points(docs).withColumn("_t", titles).select(
        clean_code(F.col("_p.ponto.id")).alias("station"), F.lit("APAC").alias("source"),
        parse_dashed_date(F.try_element_at("_t", F.lit(LAST_DAY_TITLE))).alias("day"),
        plain_float(F.try_element_at("_t", F.lit(RAIN_24H_TITLE))).alias("rain_mm"), "file",
    ).withColumn("valid_hours", F.col("rain_mm").isNotNull().cast("bigint"))


def snapshot_stations(docs: DataFrame) -> DataFrame:
    return _points(docs).select(
        clean_code(F.col("_p.ponto.id")).alias("station"), clean_text(F.col("_p.ponto.nome")).alias("station_name"), F.lit("APAC").alias("source"),
        plain_float(F.col("_p.ponto.latitude")).alias("lat"), plain_float(F.col("_p.ponto.longitude")).alias("lon"),
        clean_text(F.col("_p.`3`.valor")).alias("city"), F.lit("PE").alias("uf"), "file",
    )


def matrix_hours(docs: DataFrame, station: str = "station") -> DataFrame:
    """dates x hours -> values: one row per cell that is due; `placed` is false when its labels are bad.

    A null cell is an hour not yet due and is no row; booleans become null values.
    """
    m = docs.withColumn("_m", F.from_json("value", MATRIX)).select(station, "_m.*")
    cells = m.select(station, "datas", "horarios", F.posexplode("acumulados").alias("_i", "_row")).select(
        station, "datas", "horarios", "_i", F.posexplode("_row").alias("_j", "_v")
    )
    due = cells.where(F.col("_v").isNotNull() & (F.col("_i") < F.size("datas")) & (F.col("_j") < F.size("horarios")))
    day, hour = parse_slashed_date(F.get("datas", F.col("_i"))), parse_hour_label(F.get("horarios", F.col("_j")))
    return due.select(station, day.alias("day"), hour.alias("hour"), plain_float(F.col("_v")).alias("rain")).withColumn(
        "placed", F.col("day").isNotNull() & F.col("hour").isNotNull()
    )


def layer_daily(docs: DataFrame, layer: str, variables: dict[str, dict[str, str]] = LAYER_VARIABLES) -> DataFrame:
    """Parallel arrays of one or many points -> one row per cell and day; a null stays null.

    A missing variable raises at run time: the feed's schema has drifted.
    """
    if layer not in variables:
        raise ValueError(f"unknown layer {layer!r}")
    names = variables[layer]
    daily = ", ".join(["time:array<string>", *[f"{v}:array<double>" for v in names]])
    schema = T._parse_datatype_string(f"array<struct<latitude:double,longitude:double,daily:struct<{daily}>>>")
    as_list = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    p = docs.select("file", F.explode(F.from_json(as_list, schema)).alias("p")).where(F.size("p.daily.time") > 0)
    lost = [F.when(F.col(f"p.daily.{v}").isNull(), F.lit(v)) for v in names]
    drift = F.concat_ws(", ", *lost)
    checked = F.when(drift == "", F.col("p.daily")).otherwise(F.raise_error(F.concat(F.lit(f"schema drift in {layer}: missing "), drift)))
    rows = p.select("file", "p.latitude", "p.longitude", checked.alias("d")).select(
        "file", "latitude", "longitude", F.explode(F.arrays_zip("d.time", *[f"d.{v}" for v in names])).alias("z")
    )
    return rows.select(
        F.lit(layer).alias("layer"), cell_id(F.col("latitude"), F.col("longitude")).alias("cell"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        F.try_to_timestamp("z.time", F.lit("yyyy-M-d")).cast("date").alias("day"), *[F.col(f"z.{v}").alias(c) for v, c in names.items()], "file",
    )


def polygons(spark: SparkSession, path: str, properties: Sequence[str]) -> DataFrame:
    """GeoJSON features: text attributes and rings of struct(x, y). Multi-part features keep all rings."""
    props = ", ".join(f"{c}:string" for c in properties)
    schema = T._parse_datatype_string(
        f"features array<struct<properties:struct<{props}>,geometry:struct<type:string,coordinates:string>>>"
    )
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    single = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    multi = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    raw = F.when(F.col("f.geometry.type") == "Polygon", single).when(F.col("f.geometry.type") == "MultiPolygon", multi)
    rings = F.transform(raw, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).cast(RINGS)
    return f.select(*[F.col(f"f.properties.{c}").alias(c) for c in properties], F.col("f.geometry.type").alias("geometry_type"), rings.alias("rings"))


def population_maps(spark: SparkSession, path: str) -> DataFrame:
    """(name, years): the yearly estimates document, one row per place with its {year: value} map."""
    schema = "bairros array<struct<nome_bairro_normalizado:string,populacao_por_ano:map<string,double>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("bairros").alias("b")).select(
        F.col("b.nome_bairro_normalizado").alias("name"), F.col("b.populacao_por_ano").alias("years")
    )


def official_series(spark: SparkSession, path: str) -> DataFrame:
    """(epi_year, total) of the official totals document; an unpublished year is null."""
    return spark.read.schema("series map<string, struct<valor:bigint>>").option("multiLine", True).json(path).select(
        F.explode("series").alias("y", "v")
    ).select(F.col("y").cast("int").alias("epi_year"), F.col("v.valor").alias("total"))


def census_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(
        F.col("nome_bairro_normalizado").alias("name"), F.col("v0001").cast("bigint").alias("population")
    )
