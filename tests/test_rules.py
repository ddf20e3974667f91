import pytest
from conftest import rows
from pyspark.sql import functions as F

from weekwatch import contracts
from weekwatch.functions import dates, numbers, text
from weekwatch.operators import conform, profile, routing, stations


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw,want", [(" 10.0 ", "10"), ("007", "007"), ("-3.0", "-3"), ("nan", None), ("  ", None), (None, None), ("1.05", "1.05")])
def test_clean_code(spark, raw, want):
    assert one(spark, text.clean_code, raw) == want


@pytest.mark.parametrize("raw,want", [("4/3/2025", "2025-03-04"), ("04/03/2025", "2025-03-04"), ("2017-1-9", "2017-01-09"), ("2013/05/06 00:00:00", "2013-05-06"), ("x", None), ("", None)])
def test_parse_date(spark, raw, want):
    got = one(spark, dates.parse_date, raw)
    assert (got.date().isoformat() if got else None) == want


@pytest.mark.parametrize("raw,want", [("01/01/68", "2068-01-01"), ("01/01/69", "1969-01-01"), ("31/02/20", None), ("x", None)])
def test_two_digit_years(spark, raw, want):
    got = one(spark, dates.parse_two_digit_date, raw)
    assert (got.isoformat() if got else None) == want


@pytest.mark.parametrize("raw,want", [("1.234,5", 1234.5), (",4", 0.4), ("inf", None), ("nan", None), ("1e3", 1000.0), ("abc", None), ("-8,05", -8.05)])
def test_comma_decimal(spark, raw, want):
    assert one(spark, numbers.comma_decimal, raw) == want


@pytest.mark.parametrize("raw,want", [("202053", (2020, 53)), ("202599", None), ("20201", None), ("2020a1", None), (None, None)])
def test_epi_period(spark, raw, want):
    got = one(spark, dates.epi_period, raw)
    assert (tuple(got) if got else None) == want


def test_calendar_has_53_weeks_where_it_should(spark):
    df = spark.createDataFrame([(y,) for y in (2014, 2019, 2020, 2025)], "y int")
    got = dict(rows(df.select("y", dates.weeks_in_year(F.col("y")))))
    assert got == {2014: 53, 2019: 52, 2020: 53, 2025: 53}
    start = df.select(dates.week_start(F.col("y"), F.lit(1))).collect()
    assert [str(r[0]) for r in start] == ["2013-12-29", "2018-12-30", "2019-12-29", "2024-12-29"]


def test_masking_and_signature(spark):
    masked = one(spark, text.mask_sensitive, 'senha="abc" s3://user:pw@host 123.456.789-01 123456789012345 ok')
    assert "abc" not in masked and "pw" not in masked and "123.456" not in masked and "123456789012345" not in masked and masked.endswith("ok")
    df = spark.createDataFrame([(["a", "b"],)], "n array<string>")
    from weekwatch.operators.model_store import signature

    assert df.select(text.names_signature(F.col("n"))).first()[0] == signature(["a", "b"])


def test_place_key_crosswalk(spark):
    assert one(spark, text.place_key, "Sítio dos Pintos - São Brás") == "SITIO DOS PINTOS"
    assert one(spark, text.place_key, " Água  Fria ") == "AGUA FRIA"


def notifications(spark):
    new = spark.createDataFrame(
        [("1", "A90", "04/03/2025", "2025", "202510", " pina ", "10.0"), ("", "A90", "", "2025", "202599", "PINA", "10"), ("3", "A92.8", "x", "2025", "202511", None, "011")],
        "NU_NOTIFIC string, ID_AGRAVO string, DT_NOTIFIC string, NU_ANO string, SEM_NOT string, NM_BAIRRO string, ID_BAIRRO string",
    )
    old = spark.createDataFrame([("9", "A92.8", "2013/05/06 00:00:00")] * 10, "nu_notificacao string, co_cid string, dt_notificacao string")
    return new, old


def conformed(df, resource):
    return conform.conform_notifications(df, F.lit("DENGUE"), F.lit(resource), F.lit(2025), F.lit("run"), F.lit("2025-01-01"))


def test_notifications_first_failing_rule_and_contract(spark):
    new, old = notifications(spark)
    out = conformed(new, "n")
    assert out.columns == [f.name for f in contracts.NOTIFICATION_SCHEMA] + ["reject_reason"]
    assert len(contracts.NOTIFICATION_SCHEMA) == 21
    got = {r["id_notificacao"]: r for r in out.collect()}
    assert got["1"]["reject_reason"] is None and got["1"]["nome_bairro"] == "PINA" and got["1"]["codigo_bairro"] == "10"
    assert got[None]["reject_reason"] == "id_notificacao ausente"
    assert got["3"]["reject_reason"].startswith("codigo_agravo inconsistente") and got["3"]["codigo_bairro"] == "011"
    refused = conformed(old, "o")
    assert {r["reject_reason"] for r in refused.collect()} == {"arquivo rejeitado integralmente: 10/10 linhas com codigo_agravo divergente"}
    assert refused.first()["hospitalizado"] is None and refused.first()["data_notificacao"].date().isoformat() == "2013-05-06"


def test_chikungunya_accepts_both_codes(spark):
    df = spark.createDataFrame([("A92",), ("A92.0",), ("A90",), (None,)], "c string")
    assert [r[0] for r in df.select(routing.code_diverges(F.lit("CHIKUNGUNYA"), F.col("c"))).collect()] == [False, False, True, False]


def test_dimension_by_position_keeps_the_first(spark):
    raw = spark.createDataFrame([("1.0", " pina ", "olinda", 0), ("1", "OTHER", "x", 1), (None, "y", "z", 2)], "`N º` string, b string, c string, r int")
    assert rows(conform.conform_dimension(raw, "bairro", order="r")) == [("1", "PINA", "OLINDA")]
    with pytest.raises(ValueError):
        conform.conform_dimension(raw.select("b"), "bairro")


def test_requests_and_guards(spark):
    assert routing.check_years(2020, 2015, range(2013, 2026)) == (2015, 2020)
    for bad in (lambda: routing.check_years(2000, 2014, [2013, 2014]), lambda: routing.check_week(2020, 60, [(2020, 1)]), lambda: routing.check_top_k(7, (5, 10)), lambda: routing.check_choice("X", ["A"], "kind")):
        with pytest.raises(routing.InvalidRequest):
            bad()
    grid = spark.createDataFrame([(2025,), (2026,)], "epi_year int")
    with pytest.raises(routing.UnexpectedFutureData, match="2026"):
        routing.require_no_future(grid, 2025)
    with pytest.raises(ValueError, match="cpf"):
        routing.require_publishable(spark.createDataFrame([("1",)], "CPF string"), contracts.FORBIDDEN_COLUMNS)
    with pytest.raises(ValueError):
        routing.grid_filter(grid, kind="X")


def test_territory_catalogue(spark):
    df = spark.createDataFrame([("Limite dos Bairros", "GeoJSON"), ("Bairro por Microrregião", "json"), ("Bairros", "csv")], "n string, f string")
    assert [r[0] for r in df.select(routing.classify_territory(F.col("n"), F.col("f"))).collect()] == ["bairro", None, None]


def test_register_and_status(spark):
    reg = spark.createDataFrame([(" Pina ",), ("Outra",)], "name string")
    status = spark.createDataFrame([("PINA", 1, "7", 0), ("pina", 1, "8", 1), ("Outra", 2, "9", 2)], "name string, station_type int, station string, row_id int")
    j = stations.join_status(reg, status)
    assert dict(rows(j)) == {" Pina ": "8", "Outra": None}
    assert rows(stations.unmatched_register(j)) == [(1, 2)]


def test_schema_summary(spark):
    a = profile.column_profile(spark.createDataFrame([("f1", "01/02/2020", "1"), ("f1", "03/04/2021", "x")], "file string, d string, only string"), "file")
    b = profile.column_profile(spark.createDataFrame([("f2", "12")], "file string, D string"), "file")
    got = {r["column_name"]: r for r in profile.schema_summary(a.unionByName(b), "file").collect()}
    assert got["D"]["in_all"] and got["D"]["kind_changes"] and got["D"]["kinds"] == ["data", "inteiro"]
    assert got["ONLY"]["exclusive"] and got["ONLY"]["absent_in"] == ["f2"]
