"""Raw text files of unknown encoding and separator, station files, and checks before they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weekwatch import contracts as C
from weekwatch.functions.dates import parse_two_digit_date
from weekwatch.functions.numbers import comma_decimal
from weekwatch.functions.text import clean_code, clean_text
from weekwatch.sources.tables import list_files

# Metadata keys of a station file, its table header and its column titles.
STATION_KEYS = ("REGIAO", "UF", "ESTACAO", "CODIGO (WMO)", "LATITUDE", "LONGITUDE", "ALTITUDE", "DATA DE FUNDACAO")
HEADER_START = "Data;"
RAIN_TITLE = "PRECIPITAÇÃO TOTAL, HORÁRIO (mm)"
TEMPERATURE_TITLE = "TEMPERATURA DO AR - BULBO SECO, HORARIA (°C)"
HUMIDITY_TITLE = "UMIDADE RELATIVA DO AR, HORARIA (%)"
CORRUPT = "_corrupt"
HEAD_LINES = 20


def _uri_key(c: Column) -> Column:
    """file:///x and file:/x name the same file."""
    return F.regexp_replace(c, r"^([A-Za-z0-9+.\-]+):/+", "$1:/")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with their file, block and running id; the text scan splits large files."""
    return spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", _uri_key(F.col("_metadata.file_path")).alias("key"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    )


def file_checks(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: encoding, separator, header, severity and problems.

    A file is utf-8 when every line is valid utf-8, else latin-1, which never fails; it is a web page when its
    first line that is not blank opens one. One scan: lines are judged where they are read, per file only counts
    and two lines are kept.
    """
    files = list_files(spark, path).select("path", "length", _uri_key(F.col("uri")).alias("key"))
    filled = F.length(F.regexp_replace(F.regexp_replace("value", r"^\x{FEFF}", ""), r"\s", "")) > 0
    place = F.struct("block", "id")
    whole = _lines(spark, path).groupBy("key").agg(
        F.count(F.lit(1)).alias("n_lines"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.min_by("value", place).alias("first_raw"),
        F.min_by(F.when(filled, F.col("value")), F.when(filled, place)).alias("first_filled"),
    )
    seen = files.join(whole, "key", "left")
    first = F.when(F.col("utf8"), F.col("first_raw")).otherwise(F.decode(F.col("first_raw").cast("binary"), "ISO-8859-1"))
    seen = seen.withColumn("first_line", F.coalesce(F.regexp_replace(first, r"^\x{FEFF}", ""), F.lit("")))
    lead = F.lower(F.regexp_replace(F.coalesce("first_filled", F.lit("")), r"^[\x{FEFF}\s]+", ""))
    semis, commas = F.regexp_count("first_line", F.lit(";")), F.regexp_count("first_line", F.lit(","))
    empty = F.col("length") == 0
    html = ~empty & (lead.startswith("<!doctype") | lead.startswith("<html") | lead.startswith("<?xml"))
    rest = ~empty & ~html

    def problem(when: Column, level: str, message: str) -> Column:
        return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(message).alias("message")))

    problems = F.array_compact(
        F.array(
            problem(empty, "erro", C.EMPTY_FILE),
            problem(html, "erro", C.HTML_FILE),
            problem(rest & (F.col("n_lines") < 2), "aviso", C.SHORT_FILE),
            problem(rest & (semis == 0) & (commas == 0), "aviso", C.NO_SEPARATOR),
        )
    )
    separator = F.when(commas > semis, ",").otherwise(";")
    out = seen.select(
        "path", "length", F.when(F.coalesce("utf8", F.lit(True)), "UTF-8").otherwise("ISO-8859-1").alias("encoding"),
        separator.alias("separator"), F.split("first_line", separator).alias("header"), problems.alias("problems"),
    )
    level = lambda name: F.exists("problems", lambda p: p["level"] == name)
    return out.withColumn("status", F.when(level("erro"), "ERRO").when(level("aviso"), "AVISO").otherwise("OK"))


def status_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"))


def read_text_tables(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame]:
    """(table, checks): every readable file under a path as one all-string table plus `_file`."""
    table, _, checks = read_text_tables_with_rejects(spark, path)
    return table, checks


def read_text_tables_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """(table, rejects, checks): the table, the lines it does not hold with file and reason, and the file checks.

    Files are grouped by encoding, separator and header, one distributed CSV scan per group;
    the group list has one entry per layout, not per row. Unreadable files stay in the checks
    with status ERRO and are skipped; the others go on. Lines with too many fields are rejected,
    short ones are filled with nulls, an empty string is null, the texts NA and nan stay.
    """
    checks = file_checks(spark, path)
    layouts = (
        checks.where(F.col("status") != "ERRO")
        .groupBy("encoding", "separator", "header")
        .agg(F.collect_list("path").alias("paths"))
        .collect()
    )
    out = rejects = None
    for g in layouts:
        cols = [c.strip().strip('"') for c in g["header"]]
        schema = ", ".join(f"`{c}` string" for c in cols) + f", {CORRUPT} string"
        part = (
            spark.read.option("header", True).option("sep", g["separator"]).option("encoding", g["encoding"])
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", True)
            .option("nullValue", "").option("nanValue", "__none__").schema(schema).csv(g["paths"])
            .withColumn("_file", F.col("_metadata.file_path"))
        )
        fields = F.regexp_count(F.regexp_replace(CORRUPT, '"[^"]*"', ""), F.lit(g["separator"])) + 1
        # touching every column keeps the parser from pruning some, which would hide bad lines
        whole = F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in cols])) >= 0
        fits = F.col(CORRUPT).isNull() | (fields <= len(cols))
        bad = part.where(whole & ~fits).select("_file", F.col(CORRUPT).alias("line"), F.lit(C.TOO_MANY_FIELDS).alias("reason"))
        part = part.where(whole & fits).drop(CORRUPT)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        rejects = bad if rejects is None else rejects.unionByName(bad)
    return out, rejects, checks


def read_station_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metadata, hourly): key:;value lines of the first 20 lines and the table that starts at Data;.

    Line numbers inside a file are needed only for the few lines that look like metadata;
    body lines start with a date and carry their file path.
    """
    # the text scan keeps raw bytes; these files are latin-1
    lines = spark.read.text(path).select(
        F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"),
    )
    tops = lines.where("block = 0").groupBy("file").agg(F.min("id").alias("top"))
    key = F.upper(F.regexp_replace(F.trim(F.split("line", ";")[0]), ":$", ""))
    meta = (
        lines.withColumn("k", key)
        .where(F.col("k").isin(*STATION_KEYS) & (F.col("block") == 0))
        .join(tops, "file")
        .where(F.col("id") - F.col("top") < HEAD_LINES)
        .select("file", "k", F.trim(F.get(F.split("line", ";"), F.lit(1))).alias("v"))
        .groupBy("file")
        .pivot("k", list(STATION_KEYS))
        .agg(F.first("v"))
    )
    header = lines.where(F.col("line").startswith(HEADER_START)).groupBy("file").agg(F.first(F.split("line", ";")).alias("titles"))
    body = lines.where(F.col("line").rlike(r"^\d{4}/\d{2}/\d{2};"))
    parsed = body.join(header, "file").select("file", F.map_from_arrays("titles", _padded(F.split("line", ";"), F.size("titles"))).alias("m"))
    get = lambda name: F.when(F.try_element_at("m", F.lit(name)) != "", F.try_element_at("m", F.lit(name)))
    hourly = parsed.select(
        "file", get("Data").alias("date_text"), get("Hora UTC").alias("hour_text"),
        get(RAIN_TITLE).alias("rain_text"), get(TEMPERATURE_TITLE).alias("temperature_text"), get(HUMIDITY_TITLE).alias("humidity_text"),
    )
    return meta, hourly


def _padded(parts: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(parts, i.cast("int")))


def station_register(meta: DataFrame) -> DataFrame:
    """Station table of the metadata blocks."""
    return meta.select(
        clean_code(F.col("`CODIGO (WMO)`")).alias("station"), clean_text(F.col("ESTACAO")).alias("station_name"), F.lit("INMET").alias("source"),
        comma_decimal(F.col("LATITUDE")).alias("lat"), comma_decimal(F.col("LONGITUDE")).alias("lon"), comma_decimal(F.col("ALTITUDE")).alias("altitude"),
        clean_code(F.col("UF")).alias("uf"), parse_two_digit_date(F.col("`DATA DE FUNDACAO`")).alias("founded"), "file",
    )


def station_hours(meta: DataFrame, hourly: DataFrame) -> DataFrame:
    """Typed hourly readings with the station code of their file; rows without a date are left out."""
    codes = meta.select("file", clean_code(F.col("`CODIGO (WMO)`")).alias("station"))
    return hourly.join(codes, "file").select(
        "station", F.try_to_timestamp("date_text", F.lit("yyyy/M/d")).cast("date").alias("day"), F.col("hour_text").alias("hour"),
        comma_decimal(F.col("rain_text")).alias("rain"), comma_decimal(F.col("temperature_text")).alias("temperature"), comma_decimal(F.col("humidity_text")).alias("humidity"),
    ).where(F.col("day").isNotNull())


def column_presence(spark: SparkSession, checks: DataFrame) -> DataFrame:
    """Per column name (trimmed, upper) the files that have it."""
    return checks.select(F.explode("header").alias("c"), "path").groupBy(F.upper(F.trim("c")).alias("column_name")).agg(
        F.array_sort(F.collect_set("path")).alias("files")
    )
