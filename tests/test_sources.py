import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weekwatch import contracts as C
from weekwatch.operators import conform, gates, routing, weather
from weekwatch.sources import json_sources as J, manifests, publish, tables, text_tables as X


def test_text_tables_sniff_encoding_separator_and_isolate_faults(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("ID;NOME;VALOR\n01;São;NA\n02;;nan\n03;x;1;extra\n04;curto\n".encode("latin-1"))
    (tmp_path / "b.csv").write_text('id,nome\n7,"a,b"\n', encoding="utf-8")
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "page.csv").write_text("\n\n<!DOCTYPE html>\n<html><body>erro</body></html>\n")
    (tmp_path / "one.csv").write_text("abc\n")
    table, checks = X.read_text_tables(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: (r["encoding"], r["separator"], r["status"]) for r in checks.collect()}
    assert got["a.csv"] == ("ISO-8859-1", ";", "OK")
    assert got["b.csv"] == ("UTF-8", ",", "OK")
    assert got["empty.csv"][2] == "ERRO" and got["page.csv"][2] == "ERRO" and got["one.csv"][2] == "AVISO"
    a = table.where(F.col("_file").endswith("a.csv"))
    assert rows(a.select("ID", "NOME", "VALOR"), "ID") == [("01", "São", "NA"), ("02", None, "nan"), ("04", "curto", None)]
    assert rows(table.where(F.col("_file").endswith("b.csv")).select("id", "nome")) == [("7", "a,b")]
    assert dict(rows(X.status_counts(checks))) == {"OK": 2, "ERRO": 2, "AVISO": 1}
    rejects = X.read_text_tables_with_rejects(spark, str(tmp_path))[1]
    assert [(r["line"], r["reason"]) for r in rejects.collect()] == [("03;x;1;extra", C.TOO_MANY_FIELDS)]


def test_a_long_blank_start_hides_no_web_page(spark, tmp_path):
    (tmp_path / "page.csv").write_text("\n" * 700 + " " * 600 + "<HTML><body>erro</body></html>\n")
    (tmp_path / "data.csv").write_text("a;b\n1;<html>\n")
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in X.file_checks(spark, str(tmp_path)).collect()}
    assert got == {"page.csv": "ERRO", "data.csv": "OK"}


def test_station_file(spark, tmp_path):
    head = [
        "REGIAO:;NE", "UF:;PE", "ESTACAO:;Olinda", "CODIGO (WMO):;A301", "LATITUDE:;-8,05", "LONGITUDE:;-34,90", "ALTITUDE:;10,5", "DATA DE FUNDACAO:;01/01/20",
        f"Data;Hora UTC;{X.RAIN_TITLE};{X.TEMPERATURE_TITLE};{X.HUMIDITY_TITLE};",
    ]
    body = ["2024/01/01;0000 UTC;,4;25,5;80;", "2024/01/01;0100 UTC;;26,5;;", "2024/01/02;0000 UTC;;;;"]
    body += ["", "note"] * 10 + ["ESTACAO:;Not the head"]
    (tmp_path / "s.csv").write_bytes("\r\n".join(head + body).encode("latin-1"))
    meta, hourly = X.read_station_files(spark, str(tmp_path))
    reg = X.station_register(meta).first()
    assert (reg["station"], reg["station_name"], reg["lat"], reg["lon"], reg["altitude"], str(reg["founded"])) == ("A301", "OLINDA", -8.05, -34.9, 10.5, "2020-01-01")
    daily = weather.hourly_to_daily(X.station_hours(meta, hourly))
    got = {str(r["day"]): (r["rain_mm"], r["valid_hours"], r["temperature_mean"]) for r in daily.collect()}
    assert got == {"2024-01-01": (0.4, 1, 26.0), "2024-01-02": (None, 0, None)}


def test_snapshot_matrix_and_layer_json(spark, tmp_path):
    point = {"ponto": {"id": "12.0", "nome": " pina ", "latitude": "-8.1", "longitude": "-34.9"}, "3": {"valor": "olinda"},
             "dados_monitorados": {"dados": [{"titulo": "24 Horas", "valor": "3.5"}, {"titulo": "Data último dado", "valor": "04-03-2025"}]}}
    (tmp_path / "snap.json").write_text(json.dumps({"pontos": {"metadados": {}, "12": point}}))
    docs = J.documents(spark, str(tmp_path / "snap.json"))
    d = J.snapshot_daily(docs).first()
    assert (d["station"], str(d["day"]), d["rain_mm"], d["valid_hours"]) == ("12", "2025-03-04", 3.5, 1)
    s = J.snapshot_stations(docs).first()
    assert (s["station_name"], s["lat"], s["city"]) == ("PINA", -8.1, "OLINDA")

    m = {"datas": ["01/03/2025", "bad"], "horarios": ["0h", "25h", "2h"], "acumulados": [[1.5, 2.0, None], [0.0, None, True]]}
    docs = spark.createDataFrame([("s1", json.dumps(m))], "station string, value string")
    got = rows(J.matrix_hours(docs).select(F.col("day").cast("string"), "hour", "rain", "placed"), "day", "hour", "rain")
    assert ("2025-03-01", 0, 1.5, True) in got and ("2025-03-01", None, 2.0, False) in got
    assert (None, 0, 0.0, False) in got and (None, 2, None, False) in got and len(got) == 4

    one = {"latitude": -8.0, "longitude": -35.0, "daily": {"time": ["2024-01-01", "2024-01-02"], "precipitation_sum": [1.0, None]}}
    (tmp_path / "layer.json").write_text(json.dumps([one, one | {"latitude": -8.25}]))
    out = J.layer_daily(J.documents(spark, str(tmp_path / "layer.json")), "ERA5")
    assert sorted(rows(out.select("cell", F.col("day").cast("string"), "rain_mm")), key=str) == sorted([
        ("-8.0000_-35.0000", "2024-01-01", 1.0), ("-8.0000_-35.0000", "2024-01-02", None),
        ("-8.2500_-35.0000", "2024-01-01", 1.0), ("-8.2500_-35.0000", "2024-01-02", None)], key=str)
    with pytest.raises(Exception, match="schema drift"):
        J.layer_daily(J.documents(spark, str(tmp_path / "layer.json")), "ERA5-LAND").collect()
    with pytest.raises(ValueError):
        J.layer_daily(docs, "OTHER")


def test_population_documents(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"bairros": [{"nome_bairro_normalizado": "PINA", "populacao_por_ano": {"2010": 10.0, "2011": 11.0}}]}))
    maps = J.population_maps(spark, str(tmp_path / "p.json"))
    assert rows(conform.yearly_map_to_rows(maps, "name", "years"), "epi_year") == [("PINA", 2010, 10), ("PINA", 2011, 11)]
    (tmp_path / "t.json").write_text(json.dumps({"series": {"2022": {"valor": 100}, "2023": {"valor": None}, "2024": {"valor": 144}}}))
    from weekwatch.operators import population

    t = population.official_totals(J.official_series(spark, str(tmp_path / "t.json")))
    assert rows(t, "epi_year") == [(2022, 100.0), (2023, 120.0), (2024, 144.0)]
    (tmp_path / "c.csv").write_text("CD_BAIRRO,nome_bairro_normalizado,v0001\n1,PINA,12\n")
    assert rows(J.census_table(spark, str(tmp_path / "c.csv"))) == [("PINA", 12)]


def test_partition_sink_rewrites_only_its_years(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 2020), (2, 2021)], "v int, ano int").transform(lambda d: tables.write_years(d, path) or d)
    tables.write_years(spark.createDataFrame([(9, 2021)], "v int, ano int"), path)
    schema = spark.createDataFrame([], "v int, ano int").schema
    assert sorted(rows(tables.read_prefix(spark, path, schema).select("v", "ano"))) == [(1, 2020), (9, 2021)]
    assert tables.read_prefix(spark, str(tmp_path / "none"), schema).count() == 0


def test_rejected_rows_manifest_and_newest_entry(spark, tmp_path):
    df = routing.first_failing(spark.createDataFrame([(1,), (None,), (None,)], "v int"), [(F.col("v").isNull(), "v ausente")])
    counts = publish.write_valid_with_manifest(df, str(tmp_path / "ok"), str(tmp_path / "manifest"), "silver", "r1", ["x.csv"])
    assert counts == {"linhas_lidas": 3, "linhas_validas": 1, "linhas_rejeitadas": 2}
    assert publish.read_published(spark, str(tmp_path / "ok")).count() == 1
    with pytest.raises(ValueError, match="4 rows in the source"):
        publish.write_valid_with_manifest(df, str(tmp_path / "ok"), str(tmp_path / "manifest"), "silver", "r0", source_rows=4)
    assert publish.read_published(spark, str(tmp_path / "ok")).count() == 1 and spark.read.json(str(tmp_path / "manifest")).count() == 1
    doc = spark.read.json(str(tmp_path / "manifest")).first()
    assert doc["motivos"]["v ausente"] == 2 and doc["arquivos_recusados"] == ["x.csv"]
    publish.write_rejected(df, str(tmp_path / "bad"), "r1")
    publish.write_rejected(df, str(tmp_path / "bad"), "r1")
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2

    for run, status in (("2024", "SUCCESS"), ("2025", "FAILED"), ("2023", "SUCCESS")):
        (tmp_path / f"m{run}.json").write_text(json.dumps({"run_id": run, "recursos": [{"resource_id": "a", "tipo": "fato", "status": status, "object_key": run}]}))
    e = manifests.read_manifests(spark, str(tmp_path / "m20*.json"))
    assert manifests.newest_success(e).first()["object_key"] == "2024"
    assert manifests.newest_run(e).first()["run_id"] == "2025"


def test_publish_keeps_the_old_table_when_a_gate_fails(spark, tmp_path):
    target = str(tmp_path / "gold")
    publish.publish(spark.range(3).toDF("id"), target, lambda d: None)

    def gate(d):
        findings = d.agg(F.lit("x").alias("gate"), F.lit(gates.CRITICAL).alias("severity"), F.count(F.lit(1)).alias("n"))
        gates.require_approval(findings, "test")

    with pytest.raises(gates.QualityGateError):
        publish.publish(spark.range(9).toDF("id"), target, gate)
    assert publish.read_published(spark, target).count() == 3
    # a run that ends between its two steps leaves the old version
    left = publish.write_version(spark.range(7).toDF("id"), target)
    assert publish.read_published(spark, target).count() == 3
    publish.publish(spark.range(5).toDF("id"), target, lambda d: None)
    assert publish.read_published(spark, target).count() == 5
    publish.drop_other_versions(spark, target, keep=[left])
    assert publish.read_published(spark, target).count() == 5 and publish.read_version(spark, target, left).count() == 7
    assert len(list((tmp_path / "gold").glob("v-*"))) == 2
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, str(tmp_path / "none"))


def test_report_twins(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"])], "k int, tags array<string>")
    publish.write_twins({"t": df}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/t/parquet").count() == 1
    assert spark.read.option("header", True).csv(f"{tmp_path}/t/csv").columns == ["k", "tags"]
