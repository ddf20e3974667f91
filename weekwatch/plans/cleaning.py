"""Registered queries: cleaners, parsers, routing, manifests over the driver's text columns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weekwatch.functions import dates, numbers, text
from weekwatch.functions.numbers import round_even
from weekwatch.operators import conform, grid as G, routing
from weekwatch.plans import tables as T
from weekwatch.plans.registry import query
from weekwatch.plans.sqltext import r, sql, week_one
from weekwatch.session import checkpoint_dir, cut_lineage
from weekwatch.sources import manifests, publish

_WS = "'^\\s+|\\s+$'"


def _clean_sql(x: str) -> str:
    t = f"regexp_replace({x}, {_WS}, '', 'g')"
    return f"regexp_replace(CASE WHEN {t} <> '' AND lower({t}) <> 'nan' THEN {t} END, '^(-?\\d+)\\.0$', '\\1')"


# damaged codes: every form the cleaner knows, chosen by the key in both dialects
_DIRTY = "(CASE o_orderkey % 6 WHEN 0 THEN '  ' || o_orderkey || ' ' WHEN 1 THEN o_orderkey || '.0' WHEN 2 THEN '   ' WHEN 3 THEN 'NaN' WHEN 4 THEN '00' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END)"


def dirty_code():
    k = F.col("o_orderkey")
    s = k.cast("string")
    m = k % 6
    return (
        F.when(m == 0, F.concat(F.lit("  "), s, F.lit(" "))).when(m == 1, F.concat(s, F.lit(".0"))).when(m == 2, F.lit("   "))
        .when(m == 3, F.lit("NaN")).when(m == 4, F.concat(F.lit("00"), s)).otherwise(s)
    )


@query("clean_codes", sql(f"SELECT o_orderkey, {_clean_sql(_DIRTY)} AS code FROM orders"))
def clean_codes(spark, sf):
    return T.read(spark, sf, "orders").select("o_orderkey", text.clean_code(dirty_code()).alias("code"))


@query("clean_texts", sql(f"SELECT doc_id, upper(replace(regexp_replace({_clean_sql('text')}, '\\s+', ' ', 'g'), 'ß', 'ss')) AS text FROM documents"))
def clean_texts(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query("disease_code_keys", sql(f"SELECT p_partkey, nullif(upper(regexp_replace({_clean_sql('p_brand')}, '[^A-Za-z0-9]', '', 'g')), '') AS key FROM part"))
def disease_code_keys(spark, sf):
    return T.read(spark, sf, "part").select("p_partkey", text.disease_code_key(F.col("p_brand")).alias("key"))


_DATES = "(CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') ELSE 'sem data' END)"


@query("parse_dates", sql(f"""
SELECT o_orderkey, CAST(coalesce(try_strptime(t, '%d/%m/%Y'), try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%Y/%m/%d %H:%M:%S')) AS DATE) AS day FROM (SELECT o_orderkey, {_DATES} AS t FROM orders)"""))
def parse_dates(spark, sf):
    m, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    t = (
        F.when(m == 0, F.date_format(d, "dd/MM/yyyy")).when(m == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(m == 2, F.date_format(d, "yyyy/MM/dd HH:mm:ss")).otherwise("sem data")
    )
    return T.read(spark, sf, "orders").select("o_orderkey", dates.parse_date(t).cast("date").alias("day"))


@query("parse_source_dates", sql("""
SELECT o_orderkey, CAST(try_strptime(strftime(o_orderdate, '%d/%m/') || CASE WHEN yy <= 68 THEN '20' ELSE '19' END || lpad(CAST(yy AS VARCHAR), 2, '0'), '%d/%m/%Y') AS DATE) AS founded, CAST(o_orderdate AS DATE) AS dashed, CAST(o_orderdate AS DATE) AS slashed,
 CASE WHEN o_orderkey % 30 BETWEEN 0 AND 23 THEN o_orderkey % 30 END AS hour FROM (SELECT *, o_orderkey % 100 AS yy FROM orders)"""))
def parse_source_dates(spark, sf):
    o = T.read(spark, sf, "orders")
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    yy = F.lpad((k % 100).cast("string"), 2, "0")
    return o.select(
        "o_orderkey",
        dates.parse_two_digit_date(F.concat(F.date_format(d, "dd/MM/"), yy)).alias("founded"),
        dates.parse_dashed_date(F.date_format(d, "dd-MM-yyyy")).alias("dashed"),
        dates.parse_slashed_date(F.date_format(d, "dd/MM/yyyy")).alias("slashed"),
        dates.parse_hour_label(F.concat((k % 30).cast("string"), F.lit("h"))).alias("hour"),
    )


_AAAASS = f"(CASE WHEN o_orderkey % 17 = 0 THEN '2025' || (o_orderkey % 99) WHEN o_orderkey % 19 = 0 THEN 'sem semana' ELSE CAST(year(s + 3) * 100 + (s - {week_one('year(s + 3)')}) // 7 + 1 AS VARCHAR) END)"
_PERIOD = {"per": f"SELECT o_orderkey, {_AAAASS} AS t FROM (SELECT *, CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER) AS s FROM orders)"}


def period_text():
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return (
        F.when(k % 17 == 0, F.concat(F.lit("2025"), (k % 99).cast("string"))).when(k % 19 == 0, "sem semana")
        .otherwise(dates.week_key(dates.epi_year(d), dates.epi_week(d)).cast("string"))
    )


@query("epi_period_of_text", sql("""
SELECT o_orderkey, CASE WHEN ok THEN CAST(substr(t, 1, 4) AS BIGINT) END AS epi_year, CASE WHEN ok THEN CAST(substr(t, 5, 2) AS BIGINT) END AS epi_week FROM
 (SELECT *, regexp_full_match(t, '\\d{6}') AND CASE WHEN regexp_full_match(t, '\\d{6}') THEN CAST(substr(t, 5, 2) AS INTEGER) BETWEEN 1 AND 53 ELSE false END AS ok FROM per)""", _PERIOD))
def epi_period_of_text(spark, sf):
    o = T.read(spark, sf, "orders").select("o_orderkey", period_text().alias("t"))
    return G.with_period(o, "t").select("o_orderkey", "epi_year", "epi_week")


@query("epi_calendar", sql(f"""
SELECT y AS epi_year, w AS epi_week, CAST({week_one('y')} + CAST(7 * (w - 1) AS INTEGER) AS DATE) AS week_start, CAST({week_one('y')} + CAST(7 * (w - 1) + 6 AS INTEGER) AS DATE) AS week_end, n AS weeks_in_year, y * 100 + w AS week_id, printf('%d-%02d', y, w) AS label
FROM (SELECT y, ({week_one('y + 1')} - {week_one('y')}) // 7 AS n FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)), LATERAL (SELECT unnest(generate_series(1, n)) AS w)"""))
def epi_calendar(spark, sf):
    y = F.col("epi_year")
    years = T.read(spark, sf, "orders").select(F.year("o_orderdate").alias("epi_year")).distinct()
    c = years.withColumn("weeks_in_year", dates.weeks_in_year(y)).withColumn("epi_week", F.explode(F.sequence(F.lit(1), F.col("weeks_in_year"))))
    w = F.col("epi_week")
    return c.select(
        "epi_year", "epi_week", dates.week_start(y, w).alias("week_start"), dates.week_end(y, w).alias("week_end"), "weeks_in_year",
        dates.week_key(y, w).alias("week_id"), dates.week_label(y, w).alias("label"),
    )


@query("comma_decimals", sql("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(printf('%.2f', o_totalprice) AS DOUBLE) END AS price, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(printf('%.2f', o_totalprice) AS DOUBLE) END AS plain FROM orders"""))
def comma_decimals(spark, sf):
    k = F.col("o_orderkey")
    plain = F.format_string("%.2f", "o_totalprice")
    comma = F.regexp_replace(F.replace(plain, F.lit("."), F.lit(",")), r"(\d)(\d{3}),", "$1.$2,")
    return T.read(spark, sf, "orders").select(
        "o_orderkey",
        numbers.comma_decimal(F.when(k % 5 == 0, "nan").otherwise(comma)).alias("price"),
        numbers.plain_float(F.when(k % 7 == 0, "inf").otherwise(plain)).alias("plain"),
    )


@query("plausible_years", sql("SELECT p_partkey, CASE WHEN 1950 + p_partkey % 200 BETWEEN 2000 AND 2100 THEN 1950 + p_partkey % 200 END AS year FROM part"))
def plausible_years(spark, sf):
    return T.read(spark, sf, "part").select("p_partkey", dates.plausible_year((F.lit(1950) + F.col("p_partkey") % 200).cast("string")).cast("bigint").alias("year"))


@query("plain_lower_texts", sql(f"SELECT doc_id, strip_accents(lower(regexp_replace(text, {_WS}, '', 'g'))) AS text, CAST(nullif(regexp_extract(text, '((?:19|20)\\d{{2}})', 1), '') AS BIGINT) AS year FROM documents"))
def plain_lower_texts(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", text.plain_lower(F.col("text")).alias("text"), text.first_year_in(F.col("text")).alias("year"))


@query("place_name_keys", sql("""
SELECT s_suppkey, CASE k WHEN 'ALTO STA TERESINHA' THEN 'ALTO SANTA TEREZINHA' WHEN 'SITIO DOS PINTOS SAO BRAS' THEN 'SITIO DOS PINTOS' ELSE k END AS key FROM (
 SELECT s_suppkey, trim(regexp_replace(regexp_replace(upper(strip_accents(lower(trim(CASE s_suppkey % 3 WHEN 0 THEN 'Alto Sta. Teresinha' WHEN 1 THEN 'Sítio  dos Pintos - São Brás' ELSE s_name END)))), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS k FROM supplier)"""))
def place_name_keys(spark, sf):
    k = F.col("s_suppkey") % 3
    name = F.when(k == 0, "Alto Sta. Teresinha").when(k == 1, "Sítio  dos Pintos - São Brás").otherwise(F.col("s_name"))
    return T.read(spark, sf, "supplier").select("s_suppkey", text.place_key(name).alias("key"))


def _mask_sql(x: str) -> str:
    for pattern, repl in text.MASK_RULES:
        java = repl.replace("$1", "\\1").replace("$2", "\\2")
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{java}', 'g')"
    return x


@query("mask_sensitive_text", sql(f"SELECT doc_id, {_mask_sql('text')} AS text FROM documents"))
def mask_sensitive_text(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", text.mask_sensitive(F.col("text")).alias("text"))


@query("name_signature", sql("""
SELECT n_regionkey, CAST(count(*) AS VARCHAR) || '-' || substr(sha256(string_agg(n_name, '|' ORDER BY n_name)), 1, 12) AS signature FROM (SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, n_name FROM nation) GROUP BY 1"""))
def name_signature(spark, sf):
    n = T.read(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return n.select("n_regionkey", text.names_signature(F.col("names")).alias("signature"))


@query("trend_labels", sql("""
SELECT o_orderkey, CASE WHEN c IS NULL THEN 'sem base de comparação' WHEN c >= 20 THEN 'em alta' WHEN c <= -20 THEN 'em queda' ELSE 'estável' END AS trend FROM
 (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN CAST('inf' AS DOUBLE) ELSE o_orderkey % 80 - 40 END AS c FROM orders)"""))
def trend_labels(spark, sf):
    k = F.col("o_orderkey")
    c = F.when(k % 11 == 0, F.lit(None).cast("double")).when(k % 13 == 0, F.lit(float("inf"))).otherwise((k % 80 - 40).cast("double"))
    return T.read(spark, sf, "orders").select("o_orderkey", numbers.trend_label(c).alias("trend"))


# --- conform and routing ---------------------------------------------------------------------

def raw_notifications(spark, sf):
    """Orders as raw notifications in the new spelling; file = order priority."""
    o = T.read(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.when(k % 23 == 0, "").otherwise(k.cast("string")).alias("NU_NOTIFIC"),
        F.when((F.col("o_orderpriority") == "5-LOW") | (k % 29 == 0), "A92.8").when(k % 31 == 0, F.lit(None)).otherwise("A90").alias("id_agravo"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("DT_NOTIFIC"),
        F.year("o_orderdate").cast("string").alias("NU_ANO"),
        period_text().alias("SEM_NOT"),
        F.concat(F.lit("  nation_"), (k % 30).cast("string"), F.lit(" ")).alias("NM_BAIRRO"),
        F.col("o_orderpriority").alias("file"),
        "o_orderkey",
    )


_NOT = {**_PERIOD, "raw": "SELECT o.*, t, o_orderpriority AS file, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS id, CASE WHEN o_orderpriority = '5-LOW' OR o_orderkey % 29 = 0 THEN 'A928' WHEN o_orderkey % 31 = 0 THEN NULL ELSE 'A90' END AS code FROM orders o JOIN per USING (o_orderkey)",
"ref": "SELECT file, count(code) AS n_present, count(*) FILTER (code <> 'A90') AS n_diverging FROM raw GROUP BY 1",
"routed": """SELECT raw.*, n_present, n_diverging, CASE WHEN n_diverging / n_present >= 0.9 THEN 'arquivo rejeitado integralmente: ' || n_diverging || '/' || n_present || ' linhas com codigo_agravo divergente' WHEN id IS NULL THEN 'id_notificacao ausente'
 WHEN code <> 'A90' THEN 'codigo_agravo inconsistente com tipo_arbovirose' END AS reject_reason FROM raw JOIN ref USING (file)"""}


def routed(spark, sf):
    return conform.conform_notifications(
        raw_notifications(spark, sf), F.lit("DENGUE"), F.col("file"), F.year(F.lit("2001-01-01").cast("date")), F.lit("run-1"), F.lit("2001-01-01 00:00:00")
    )


@query("notification_routing", sql("""
SELECT id AS id_notificacao, CAST(o_orderdate AS DATE) AS data_notificacao, CAST(year(o_orderdate) AS BIGINT) AS ano_notificacao, t AS semana_notificacao, 'NATION_' || (o_orderkey % 30) AS nome_bairro, file AS _source_resource_id, reject_reason FROM routed""", _NOT))
def notification_routing(spark, sf):
    return routed(spark, sf).select(
        "id_notificacao", F.col("data_notificacao").cast("date").alias("data_notificacao"), "ano_notificacao", "semana_notificacao", "nome_bairro", "_source_resource_id", "reject_reason"
    )


@query("reject_reason_counts", sql("SELECT file AS _source_resource_id, reject_reason, count(*) AS n_rows FROM routed GROUP BY ALL", _NOT))
def reject_reason_counts(spark, sf):
    return routing.reason_counts(routed(spark, sf), ["_source_resource_id"])


@query("file_divergence", sql(f"SELECT file, n_present, n_diverging, {r('n_diverging / n_present')} AS divergence, n_diverging / n_present >= 0.9 AS refused FROM ref", _NOT))
def file_divergence(spark, sf):
    raw = raw_notifications(spark, sf).withColumn("d", routing.code_diverges(F.lit("DENGUE"), F.col("id_agravo")))
    f = routing.refuse_files(raw, "file", F.col("id_agravo").isNotNull(), F.col("d"))
    return f.withColumn("divergence", round_even(F.col("divergence"), 6))


@query("official_place_match", sql("""
SELECT id AS id_notificacao, n_nationkey AS official_place, n_name AS official_name, CASE WHEN n_name IS NULL THEN 'unknown_name' ELSE 'matched' END AS name_status FROM routed
 LEFT JOIN (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation) ON n_name = 'NATION_' || (o_orderkey % 30) WHERE reject_reason IS NULL""", _NOT))
def official_place_match(spark, sf):
    v = routing.valid(routed(spark, sf))
    return G.match_official_places(v, T.places(spark, sf), "nome_bairro").select("id_notificacao", "official_place", "official_name", "name_status")


@query("counts_from_raw_notifications", sql("""
SELECT CAST(n_nationkey AS BIGINT) AS place, CAST(substr(t, 1, 4) AS BIGINT) AS epi_year, CAST(substr(t, 5, 2) AS BIGINT) AS epi_week, count(*) AS cases FROM routed JOIN nation ON n_name = 'NATION_' || (o_orderkey % 30)
WHERE reject_reason IS NULL AND regexp_full_match(t, '\\d{6}') AND CASE WHEN regexp_full_match(t, '\\d{6}') THEN CAST(substr(t, 5, 2) AS INTEGER) BETWEEN 1 AND 53 ELSE false END GROUP BY ALL""", _NOT))
def counts_from_raw_notifications(spark, sf):
    v = G.exact_duplicates_removed(routing.valid(routed(spark, sf)))
    m = G.match_official_places(G.with_period(v), T.places(spark, sf), "nome_bairro")
    ok = m.where((F.col("name_status") == "matched") & F.col("epi_year").isNotNull())
    return G.count_cases(ok.withColumnRenamed("official_place", "place"), ["place", "epi_year", "epi_week"])


@query("exact_duplicates_removed", sql("SELECT DISTINCT l_partkey, l_quantity, l_returnflag FROM lineitem"))
def exact_duplicates_removed(spark, sf):
    return G.exact_duplicates_removed(T.read(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_returnflag"))


_STATIONS = {"strules": """
SELECT station, source, CASE WHEN station IS NULL THEN 'codigo_estacao ausente' WHEN abs(lat) > 90 OR abs(lon) > 180 THEN 'latitude/longitude fora do intervalo valido' WHEN dup THEN 'codigo_estacao duplicado (mesma fonte)' END AS reject_reason FROM (
 SELECT CASE WHEN station % 10 = 0 THEN NULL ELSE station % 50 END AS station, source, CASE WHEN station % 8 = 0 THEN lat * 20 ELSE lat END AS lat, lon, station % 10 <> 0 AND row_number() OVER (PARTITION BY source, CASE WHEN station % 10 = 0 THEN NULL ELSE station % 50 END ORDER BY station) > 1 AS dup FROM stations)"""}


def routed_stations(spark, sf):
    s = T.stations(spark, sf)
    k = F.col("station")
    code = F.when(k % 10 == 0, F.lit(None)).otherwise(k % 50)
    bad = s.select(code.alias("station"), "source", F.when(k % 8 == 0, F.col("lat") * 20).otherwise(F.col("lat")).alias("lat"), "lon", k.alias("row_id"))
    # one row per (source, code): the first registration keeps it
    first = bad.where(F.col("station").isNotNull()).groupBy("source", "station").agg(F.min("row_id").alias("first_id"))
    tagged = bad.join(first, ["source", "station"], "left")
    dup = F.coalesce(F.col("row_id") != F.col("first_id"), F.lit(False))
    return routing.first_failing(tagged, routing.station_rules(dup))


@query("station_rules", sql("SELECT * FROM strules", _STATIONS))
def station_rules(spark, sf):
    return routed_stations(spark, sf).select("station", "source", "reject_reason")


@query("published_stations", sql("""
SELECT 'published' AS part, NULL AS reason, count(*) AS n FROM strules WHERE reject_reason IS NULL
UNION ALL SELECT 'rejected', reject_reason, count(*) FROM strules WHERE reject_reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'manifest', reject_reason, count(*) FROM strules WHERE reject_reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'twin', NULL, count(*) FROM strules WHERE reject_reason IS NULL""", _STATIONS))
def published_stations(spark, sf):
    """Stations written with their rejects, manifest and report twins and read back; a later version that its gate refuses changes nothing."""
    base = f"{checkpoint_dir(spark)}/stations-{uuid.uuid4().hex}"
    rows = cut_lineage(routed_stations(spark, sf).select("station", "source", "reject_reason"))
    publish.write_valid_with_manifest(rows, f"{base}/valid", f"{base}/manifest", "silver", "r1", source_rows=rows.count())
    publish.write_rejected(rows, f"{base}/rejected", "r1")

    def refuse(df):
        raise ValueError("a gate that nothing passes")

    try:
        publish.publish(rows.limit(1), f"{base}/valid", refuse)
    except ValueError:
        pass
    valid = publish.read_published(spark, f"{base}/valid")
    publish.write_twins({"stations": valid}, f"{base}/report")
    n, none = F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("reason")
    parts = [
        valid.agg(n).select(F.lit("published").alias("part"), none, "n"),
        spark.read.parquet(f"{base}/rejected").groupBy(F.col("_motivo_rejeicao").alias("reason")).agg(n).select(F.lit("rejected").alias("part"), "reason", "n"),
        # reasons and counts are fields of one struct in the written document
        spark.read.schema("motivos map<string, bigint>").json(f"{base}/manifest").select(F.lit("manifest").alias("part"), F.explode("motivos").alias("reason", "n")),
        spark.read.option("header", True).csv(f"{base}/report/stations/csv").agg(n).select(F.lit("twin").alias("part"), none, "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out



@query("filtered_grid", sql("SELECT place, kind, week_index, cases FROM grid WHERE kind = 'O' AND epi_year BETWEEN 1997 AND 1999 AND region = 2"))
def filtered_grid(spark, sf):
    return routing.grid_filter(T.grid(spark, sf), "O", 1997, 1999, region=2, kinds=T.KINDS).select("place", "kind", "week_index", "cases")


def catalogue(spark, sf):
    """Part names as catalogue entries."""
    p = T.read(spark, sf, "part")
    k = F.col("p_partkey")
    name = (
        F.when(k % 9 == 0, F.concat(F.lit("Casos de Dengue - "), (k % 40 + 1990).cast("string"))).when(k % 9 == 1, F.lit("Zica 2016")).when(k % 9 == 2, F.lit("CHIKUNGUNYA"))
        .when(k % 9 == 3, F.lit("Metadados dengue")).when(k % 9 == 4, F.lit("Município")).when(k % 9 == 5, F.lit("Tabela UF")).when(k % 9 == 6, F.lit("Bairro")).otherwise(F.col("p_name"))
    )
    return p.select("p_partkey", name.alias("name"), F.when(k % 4 == 0, "PDF").when(k % 4 == 1, " CSV ").otherwise("csv").alias("format"))


@query("resource_classes", sql("""
SELECT p_partkey, CASE WHEN ok THEN CASE m WHEN 4 THEN 'dimensao' WHEN 5 THEN 'dimensao' WHEN 6 THEN 'dimensao' ELSE 'fato' END END AS role, CASE WHEN ok THEN ['dengue', 'zika', 'chikungunya', '', 'municipio', 'uf', 'bairro'][m + 1] END AS entity,
 CASE WHEN ok AND m = 0 THEN p_partkey % 40 + 1990 WHEN ok AND m = 1 THEN 2016 END AS year FROM (SELECT p_partkey, p_partkey % 9 AS m, p_partkey % 4 <> 0 AND p_partkey % 9 IN (0, 1, 2, 4, 5, 6) AS ok FROM part)"""))
def resource_classes(spark, sf):
    c = catalogue(spark, sf).withColumn("c", routing.classify_resource(F.col("name"), F.col("format")))
    return c.select("p_partkey", "c.role", "c.entity", F.col("c.year").cast("bigint").alias("year"))


@query("metro_rain_stations", sql("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 1 AND s_nationkey IN (1, 2, 3)"))
def metro_rain_stations(spark, sf):
    s = T.read(spark, sf, "supplier").select(
        "s_suppkey", (F.col("s_suppkey") % 3).alias("station_type"), F.concat(F.lit(" nation_"), F.col("s_nationkey").cast("string")).alias("city")
    )
    return routing.metro_rain_stations(s, ["NATION_1", "NATION_2", "NATION_3"]).select("s_suppkey")


@query("unknown_requests", sql("SELECT place, epi_year FROM (SELECT CAST(s_suppkey % 40 AS BIGINT) AS place, 1994 + s_suppkey % 10 AS epi_year FROM supplier) EXCEPT ALL SELECT place, epi_year FROM (SELECT CAST(s_suppkey % 40 AS BIGINT) AS place, 1994 + s_suppkey % 10 AS epi_year FROM supplier) WHERE (place, epi_year) IN (SELECT DISTINCT (place, epi_year) FROM grid)"))
def unknown_requests(spark, sf):
    asked = T.read(spark, sf, "supplier").select((F.col("s_suppkey") % 40).alias("place"), (F.lit(1994) + F.col("s_suppkey") % 10).alias("epi_year"))
    return routing.check_requests(asked, T.grid(spark, sf), ["place", "epi_year"])


_REC = {"rec": """
SELECT coalesce(a.k, b.k) AS place, a.n AS left_name, b.n AS right_name, CASE WHEN a.k IS NULL THEN 'only_right' WHEN b.k IS NULL THEN 'only_left' ELSE 'both' END AS side,
 CASE WHEN a.k IS NULL THEN (SELECT min(x.k) FROM rla x WHERE x.n = upper(b.n) AND x.k NOT IN (SELECT k FROM rlb)) WHEN b.k IS NULL THEN (SELECT min(y.k) FROM rlb y WHERE upper(y.n) = a.n AND y.k NOT IN (SELECT k FROM rla)) END AS same_name_key
FROM rla a FULL JOIN rlb b ON a.k = b.k""", "rla": "SELECT place AS k, place_name AS n FROM places", "rlb": "SELECT place + CASE WHEN place >= 15 THEN 100 ELSE 0 END AS k, lower(place_name) AS n FROM places"}


@query("key_reconciliation", sql("SELECT * FROM rec", _REC))
def key_reconciliation(spark, sf):
    p = T.places(spark, sf)
    a = p.select("place", "place_name")
    b = p.select(
        (F.col("place") + F.when(F.col("place") >= 15, 100).otherwise(0)).alias("place"), F.lower("place_name").alias("place_name")
    )
    return G.reconcile_keys(a, b, "place", "place_name")


@query("key_match_percentage", sql(f"""
SELECT count(*) FILTER (side = 'both') AS n_both, count(*) FILTER (side = 'only_left') AS n_only_left, count(*) FILTER (side = 'only_right') AS n_only_right, count(same_name_key) AS n_same_name,
 {r("100e0 * count(*) FILTER (side = 'both') / count(*) FILTER (side <> 'only_left')", 2)} AS match_pct FROM rec""", _REC))
def key_match_percentage(spark, sf):
    return G.match_summary(key_reconciliation(spark, sf))


@query("dimension_by_position", sql("""
SELECT codigo_bairro, nome_bairro, nome_municipio FROM (SELECT CAST(s_nationkey AS VARCHAR) AS codigo_bairro, upper(s_name) AS nome_bairro, 'CITY' AS nome_municipio, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier WHERE s_suppkey % 9 <> 0) WHERE rn = 1"""))
def dimension_by_position(spark, sf):
    raw = T.read(spark, sf, "supplier").select(
        F.when(F.col("s_suppkey") % 9 == 0, " ").otherwise(F.concat(F.col("s_nationkey").cast("string"), F.lit(".0"))).alias("Nº"),
        F.col("s_name").alias("descrição"), F.lit(" city ").alias("município"), F.col("s_suppkey").alias("row_id"),
    )
    return conform.conform_dimension(raw, "bairro", order="row_id")


@query("dimension_metrics", sql("""
SELECT count(*) AS rows_read, count(DISTINCT s_nationkey) FILTER (s_suppkey % 9 <> 0) AS rows_valid, count(*) FILTER (s_suppkey % 9 = 0) AS without_key, count(*) FILTER (s_suppkey % 9 <> 0) - count(DISTINCT s_nationkey) FILTER (s_suppkey % 9 <> 0) AS duplicated FROM supplier"""))
def dimension_metrics(spark, sf):
    raw = T.read(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 9 == 0, " ").otherwise(F.col("s_nationkey").cast("string")).alias("a"), "s_name", F.lit("x").alias("c"))
    return conform.dimension_metrics(raw, "bairro")


@query("union_of_sources", sql("SELECT s_suppkey AS station, 'S' AS origin, s_acctbal AS rain_mm, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, 'C', NULL, c_mktsegment FROM customer"))
def union_of_sources(spark, sf):
    a = T.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("station"), F.lit("S").alias("origin"), F.col("s_acctbal").alias("rain_mm"))
    b = T.read(spark, sf, "customer").select(F.col("c_custkey").alias("station"), F.lit("C").alias("origin"), F.col("c_mktsegment").alias("segment"))
    return conform.union_sources(a, b)


@query("one_hot_regions", sql("SELECT place, " + ", ".join(f"CAST(region = {i} AS BIGINT) AS region_{i}" for i in range(5)) + " FROM places"))
def one_hot_regions(spark, sf):
    from weekwatch.operators import features as X

    p = T.places(spark, sf)
    out, names = X.one_hot(p, "region", X.distinct_codes(p, "region"))
    return out.select("place", *names)


# --- manifests ---------------------------------------------------------------------------------

def entries(spark, sf):
    """Events as manifest entries: run = day, resource = user, part = event type."""
    e = T.read(spark, sf, "events")
    return e.select(
        F.date_format("ts", "yyyyMMdd").alias("run_id"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("resource_id"),
        F.col("event_type").alias("tipo"), F.when(F.col("value") > 5, "SUCCESS").otherwise("FAILED").alias("status"), "event_id",
        F.col("user_id").alias("station"), F.col("value").cast("int").cast("bigint").alias("depth_days"),
    )


_ENT = {"ent": "SELECT strftime(ts, '%Y%m%d') AS run_id, 'r' || user_id AS resource_id, event_type AS tipo, CASE WHEN value > 5 THEN 'SUCCESS' ELSE 'FAILED' END AS status, event_id, user_id AS station, CAST(trunc(value) AS BIGINT) AS depth_days FROM events"}


@query("newest_success_per_resource", sql("SELECT resource_id, max(run_id) AS run_id FROM ent WHERE status = 'SUCCESS' GROUP BY 1", _ENT))
def newest_success_per_resource(spark, sf):
    return manifests.newest_success(entries(spark, sf)).select("resource_id", "run_id")


@query("newest_complete_run", sql("SELECT max(run_id) AS run_id FROM (SELECT run_id FROM ent GROUP BY 1 HAVING bool_or(status = 'SUCCESS' AND tipo = 'click') AND bool_or(status = 'SUCCESS' AND tipo = 'error'))", _ENT))
def newest_complete_run(spark, sf):
    return manifests.newest_complete_run(entries(spark, sf), ["click", "error"])


@query("newest_run_with_any", sql("SELECT max(run_id) AS run_id FROM ent WHERE status = 'SUCCESS' AND tipo IN ('click', 'error')", _ENT))
def newest_run_with_any(spark, sf):
    return manifests.newest_run_with_any(entries(spark, sf), ["click", "error"])


@query("successful_snapshots", sql("SELECT run_id, resource_id, event_id FROM ent WHERE status = 'SUCCESS' AND tipo = 'click'", _ENT))
def successful_snapshots(spark, sf):
    return manifests.all_successes(entries(spark, sf), "click").select("run_id", "resource_id", "event_id")


@query("backfill_plan", sql("SELECT s_suppkey AS station FROM supplier WHERE s_suppkey NOT IN (SELECT station FROM ent WHERE status = 'SUCCESS' GROUP BY 1 HAVING max(depth_days) >= 150)", _ENT))
def backfill_plan(spark, sf):
    asked = T.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("station"))
    return manifests.backfill_plan(entries(spark, sf), asked, 150)


@query("missing_years", sql("""
SELECT entity, CAST(y AS BIGINT) AS missing_year FROM (SELECT event_type AS entity, min(1990 + user_id % 40) AS lo, max(1990 + user_id % 40) AS hi FROM events WHERE value > 150 GROUP BY 1), LATERAL (SELECT unnest(generate_series(lo, hi)) AS y)
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = entity AND e.value > 150 AND 1990 + e.user_id % 40 = y)"""))
def missing_years(spark, sf):
    e = T.read(spark, sf, "events").select(
        F.lit("fato").alias("role"), F.col("event_type").alias("entity"), F.when(F.col("value") > 150, "SUCCESS").otherwise("FAILED").alias("status"),
        (F.lit(1990) + F.col("user_id") % 40).cast("int").alias("year"),
    )
    return conform.missing_years(e)


@query("json_properties", sql("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1"))
def json_properties(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return T.read(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@query("pruned_place_scan", sql("SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS place, c_mktsegment FROM customer"))
def pruned_place_scan(spark, sf):
    from weekwatch.sources.tables import distinct_columns

    return distinct_columns(spark, f"{sf}/customer.parquet", ["c_nationkey", "c_mktsegment"]).select(F.col("c_nationkey").cast("bigint").alias("place"), "c_mktsegment")
