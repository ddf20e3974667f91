"""Quality gates before publishing and freshness of what is published."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weekwatch.contracts import CURRENT_LIMIT_WEEKS, GRID_KEY, LAG_LIMIT_DAYS, LAG_LIMIT_DEFAULT
from weekwatch.functions.dates import week_label
from weekwatch.operators.grid import orphans

CRITICAL, WARNING = "CRITICO", "AVISO"


class QualityGateError(RuntimeError):
    """A critical gate failed; nothing is published."""


def gate_findings(
    grid: DataFrame, territory: DataFrame | None, expected_places: int, expected_kinds: Sequence[str],
    required: Sequence[str] = (), key: Sequence[str] = GRID_KEY,
) -> DataFrame:
    """(gate, severity, n) of every gate that found something. Values are checked in one pass."""
    def positive(df):
        return df.where(F.col("n") > 0)

    def finding(gate, one, severity=CRITICAL):
        return one.select(F.lit(gate).alias("gate"), F.lit(severity).alias("severity"), F.col("n").cast("bigint").alias("n"))

    cols = set(grid.columns)
    checks: dict[str, Column] = {"gold_nao_vazia": F.when(F.count(F.lit(1)) == 0, 1).otherwise(0)}
    missing = [c for c in required if c not in cols]
    if missing:
        checks["gold_colunas_obrigatorias"] = F.lit(len(missing))
    if "place" in cols:
        n = F.countDistinct("place")
        checks["gold_n_bairros"] = F.abs(n - expected_places)
    if "kind" in cols:
        want = F.array(*[F.lit(k) for k in sorted(expected_kinds)])
        checks["gold_agravos"] = F.when(F.array_sort(F.collect_set("kind")) == want, 0).otherwise(1)
    if "cases" in cols:
        checks["gold_casos_nao_negativos"] = F.count_if(F.col("cases") < 0)
        checks["gold_casos_sem_nulo"] = F.count_if(F.col("cases").isNull())
    if "epi_week" in cols:
        checks["gold_semana_valida"] = F.count_if(F.coalesce(~F.col("epi_week").between(1, 53), F.lit(True)))
    if {"week_start", "week_end"} <= cols:
        checks["gold_datas_coerentes"] = F.count_if(F.col("week_end") < F.col("week_start"))
        checks["gold_semana_tem_7_dias"] = F.count_if(F.datediff("week_end", "week_start") != 6)
    for c in sorted(cols):
        if "rain" in c and dict(grid.dtypes)[c] in ("double", "bigint", "int"):
            checks[f"clima_nao_negativo:{c}"] = F.count_if(F.col(c) < 0)
        if "humidity" in c:
            checks[f"umidade_intervalo:{c}"] = F.count_if(~F.col(c).between(0, 100))
    wide = grid.agg(*[v.cast("bigint").alias(k) for k, v in checks.items()])
    out = positive(wide.unpivot([], [F.col(f"`{k}`") for k in checks], "gate", "n")).select("gate", F.lit(CRITICAL).alias("severity"), "n")
    if set(key) <= cols:
        dup = grid.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("n"))
        out = out.unionByName(positive(finding("gold_chave_unica", dup)))
    else:
        out = out.unionByName(finding("gold_chave_unica", grid.agg(F.lit(1).alias("n"))))
    if territory is None:
        out = out.unionByName(finding("gold_integridade_territorio", grid.agg(F.lit(1).alias("n")), WARNING))
    elif "place" in cols:
        for a, b, name in ((grid, territory, "sobrando"), (territory, grid.select("place").distinct(), "faltando")):
            one = orphans(a, b, "place").agg(F.count(F.lit(1)).alias("n"))
            out = out.unionByName(positive(finding(f"gold_integridade_territorio:{name}", one)))
    return out


def by_severity(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    return findings.where(F.col("severity") == CRITICAL), findings.where(F.col("severity") == WARNING)


def require_approval(findings: DataFrame, context: str = "") -> None:
    """Aborts on any critical finding; the findings are a handful of rows."""
    bad = by_severity(findings)[0].collect()
    if bad:
        raise QualityGateError(f"{context}: " + "; ".join(f"{r['gate']} ({r['n']})" for r in bad))


def findings_json(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct("gate", "severity", "n")).alias("finding"))


def lag_status(newest: Column, dataset: Column, reference: Column) -> Column:
    """struct(lag_days, limit_days, status); without a date the status is unknown, never current."""
    pairs = [F.lit(v) for kv in LAG_LIMIT_DAYS.items() for v in kv]
    limit = F.coalesce(F.try_element_at(F.create_map(*pairs), dataset), F.lit(LAG_LIMIT_DEFAULT))
    lag = F.datediff(reference, newest)
    status = F.when(lag.isNull(), "DESCONHECIDO").when(lag <= limit, "ATUAL").otherwise("ATRASADO")
    return F.struct(lag.alias("lag_days"), limit.alias("limit_days"), status.alias("status"))


def freshness(grid: DataFrame, reference: Column, model_cutoff: Column | None = None) -> DataFrame:
    """One row per data set: newest week with data, lag against its limit, status. One pass over the table."""
    week = F.struct("epi_year", "epi_week", "week_end")
    aggs = {"epidemiologia": F.max(week), "territorio": F.max(F.when(F.lit(False), week))}
    if "valid_days_week" in grid.columns:
        aggs["clima_estacao"] = F.max(F.when(F.coalesce("valid_days_week", F.lit(0)) > 0, week))
    if "cell_rain_valid_days" in grid.columns:
        aggs["clima_grade"] = F.max(F.when(F.coalesce("cell_rain_valid_days", F.lit(0)) > 0, week))
    wide = grid.agg(*[c.alias(n) for n, c in aggs.items()])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dataset"), F.col(n).alias("w")) for n in aggs])).alias("x")).select("x.*")
    s = lag_status(F.col("w.week_end"), F.col("dataset"), reference)
    out = long.select("dataset", F.col("w.week_end").alias("newest_event"), week_label(F.col("w.epi_year"), F.col("w.epi_week")).alias("newest_week"), s.alias("s")).select(
        "dataset", "newest_event", "newest_week", "s.*"
    )
    if model_cutoff is not None:
        row = grid.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("modelo").alias("dataset"), model_cutoff.alias("newest_event"), F.lit(None).cast("string").alias("newest_week"),
            F.lit(None).cast("int").alias("lag_days"), F.lit(LAG_LIMIT_DEFAULT).alias("limit_days"),
            F.when(model_cutoff.isNotNull(), "ATUAL").otherwise("DESCONHECIDO").alias("status"),
        )
        out = out.unionByName(row)
    return out


def current_period(fresh: DataFrame, limit_weeks: int = CURRENT_LIMIT_WEEKS) -> DataFrame:
    """Is a ranking of the current week legitimate: at most `limit_weeks` whole weeks behind."""
    weeks = F.floor(F.col("lag_days") / 7)
    ok = F.coalesce(weeks <= limit_weeks, F.lit(False))
    return fresh.where(F.col("dataset") == "epidemiologia").select(
        ok.alias("available"), F.when(~ok, "epidemiological_data_stale").alias("reason"), weeks.cast("bigint").alias("weeks_behind"),
        F.lit(limit_weeks).alias("limit_weeks"), "newest_week",
    )
