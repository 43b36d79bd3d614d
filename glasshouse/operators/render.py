"""Outputs of the result table: long, wide triage, evidence sentences, typed Parquet, nested JSON, reports."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasshouse.functions import lexicon as L
from glasshouse.functions.urls import host
from glasshouse.operators.evaluate import density
from glasshouse.operators.joins import numbered
from glasshouse.operators.store import decoded, query, state

_DOUBLES = ["confidence", "limiar", "cobertura_vocabulario", "densidade_sinalizacao"]
_LONGS = ["n_sentencas_sinalizadas", "n_segmentos_avaliados"]


def audit(name: str) -> Column:
    return F.get_json_object("audit_trail_json", f"$.{name}")


def long_rows(results: DataFrame) -> DataFrame:
    """Base columns, the audit scalars and the signal density, all as text; what is missing is empty."""
    base = [decoded(F.col(c)).alias(c) if c == "value" else F.col(c).cast("string").alias(c) for c in L.RESULT_COLUMNS]
    flagged, evaluated = audit("n_sentencas_sinalizadas").cast("double"), audit("n_segmentos_avaliados").cast("double")
    return results.select(*base, *[F.coalesce(audit(s), F.lit("")).alias(s) for s in L.AUDIT_SCALARS], F.coalesce(density(flagged, evaluated).cast("string"), F.lit("")).alias("densidade_sinalizacao"))


def typed_rows(results: DataFrame) -> DataFrame:
    """The long rows with declared types; empty becomes null."""
    rows = long_rows(results)

    def typed(c: str) -> Column:
        col = F.nullif(F.col(c), F.lit(""))
        return (col.cast("double") if c in _DOUBLES else col.cast("long") if c in _LONGS else col).alias(c)

    return rows.select(*map(typed, rows.columns))


def wide_rows(results: DataFrame, variables: list[str]) -> DataFrame:
    """One row a host: state and confidence of each variable, counts over all variables, reason, and the triage order.

    With several runs the last result of a variable counts.  The reason is the first that is not a mere consequence."""
    rows = results.select(host(F.col("domain_url")).alias("dominio"), "variable_name", state(F.col("value")).alias("state"), F.col("confidence"), audit("motivo").alias("motivo"), "computed_at")
    last = F.struct("computed_at", "state", "confidence")
    cells = rows.groupBy("dominio").pivot("variable_name", variables).agg(F.max(last).alias("x"))
    flat = cells.select("dominio", *[F.col(f"`{v}`.state").alias(v) for v in variables], *[F.round(F.col(f"`{v}`.confidence"), 4).alias(f"{v}_confianca") for v in variables])
    reason = rows.where("motivo IS NOT NULL AND motivo != ''").groupBy("dominio").agg(F.min(F.struct((F.col("motivo") == "dependencia_nao_coletada").alias("later"), "computed_at", "motivo")).alias("m")).select("dominio", F.col("m.motivo").alias("motivo"))

    def count(s: str) -> Column:
        return sum((F.coalesce((F.col(f"`{v}`") == s).cast("int"), F.lit(0)) for v in variables), F.lit(0))

    counted = flat.join(reason, "dominio", "left").select(
        "*", count("false").alias("n_sinais_ausentes"), count("nao_aplicavel").alias("n_nao_aplicavel"), count("nao_coletado").alias("n_nao_coletado"), (count("true") + count("false")).alias("n_medidas")
    )
    # buckets of the order: the counts, then the letters of the host, three a level
    counts = [(F.col("n_nao_coletado") > 0).cast("int"), -F.col("n_nao_aplicavel"), -F.col("n_sinais_ausentes"), *[F.substring("dominio", i, 3) for i in (1, 4, 7)]]
    return numbered(counted, counts, [F.col("dominio")], "ordem").withColumn("ordem", F.col("ordem").cast("int"))


def evidence_rows(results: DataFrame) -> DataFrame:
    """One row for each flagged sentence of the audit trail."""
    parsed = F.from_json(audit("sentencas"), "array<struct<posicao: int, escore: double, texto: string>>")
    return results.select("domain_url", "variable_name", "run_id", F.explode(parsed).alias("s")).select("domain_url", "variable_name", "run_id", "s.posicao", "s.escore", "s.texto")


def nested_rows(results: DataFrame) -> DataFrame:
    """One JSON object a host, with its variables by name."""
    entry = F.struct("variable_name", F.struct(decoded(F.col("value")).alias("valor"), F.col("confidence").alias("confianca"), audit("motivo").alias("motivo")).alias("r"))
    grouped = results.select(host(F.col("domain_url")).alias("dominio"), entry.alias("e")).groupBy("dominio").agg(F.map_from_entries(F.array_sort(F.collect_set("e"))).alias("variaveis"))
    return grouped.select("dominio", F.to_json("variaveis").alias("json"))


RENDERERS: dict[str, Callable[[DataFrame, dict], None]] = {}


def renderer(name: str):
    def add(f):
        RENDERERS[name] = f
        return f

    return add


@renderer("csv")
def write_csv(results: DataFrame, params: dict) -> None:
    long_rows(results).write.mode("overwrite").option("sep", ";").option("header", True).csv(params["path"])


@renderer("csv_largo")
def write_wide(results: DataFrame, params: dict) -> None:
    wide_rows(results, params["variables"]).orderBy("ordem").write.mode("overwrite").option("sep", ";").option("header", True).csv(params["path"])


@renderer("csv_evidencias")
def write_evidence(results: DataFrame, params: dict) -> None:
    evidence_rows(results).write.mode("overwrite").option("sep", ";").option("quoteAll", True).option("header", True).csv(params["path"])


@renderer("parquet")
def write_parquet(results: DataFrame, params: dict) -> None:
    typed_rows(results).write.mode("overwrite").parquet(params["path"])


@renderer("json")
def write_json(results: DataFrame, params: dict) -> None:
    nested_rows(results).select("json").write.mode("overwrite").text(params["path"])


def render(results: DataFrame, outputs: list[dict], run_id: str | None = None) -> dict[str, str | None]:
    """Writes every declared output; one that fails does not stop the others.  Returns the error of each, or None."""
    if not outputs:
        raise ValueError("no outputs declared")
    done: dict[str, str | None] = {}
    for o in outputs:
        params = o.get("params", {})
        wanted = {k: v for k, v in (params.get("filtro") or {}).items() if v} | ({"run_id": run_id} if run_id else {})
        try:
            RENDERERS[o["name"]](query(results, wanted), params)
            done[o["name"]] = None
        except Exception as e:  # the report says which failed
            logging.getLogger(__name__).warning("%s: %s", o["name"], e)
            done[o["name"]] = str(e)
    return done


def comparison_report(metrics: list[dict], only_ours: list[str], only_theirs: list[str]) -> str:
    """Markdown of a comparison with human labels."""
    lines = ["# Comparison with the labels", "", "| variable | tp | fp | fn | tn | precision | recall | f1 | kappa |", "|---|---|---|---|---|---|---|---|---|"]

    def show(v) -> str:
        return "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)

    lines += ["| " + " | ".join(show(m.get(k)) for k in ("variable", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "kappa")) + " |" for m in metrics]
    return "\n".join([*lines, "", f"Only measured: {', '.join(only_ours) or '-'}", "", f"Only labelled: {', '.join(only_theirs) or '-'}", ""])


def label_template(domains: DataFrame, variables: list[str]) -> DataFrame:
    """An empty sheet for human labels."""
    return domains.select("domain_url", *[F.lit("").alias(v) for v in variables], F.lit("").alias("notes"))


def filled_cells(sheet: DataFrame, columns: list[str]) -> DataFrame:
    """Filled cells of a sheet that must be blind: all must be 0."""
    return sheet.agg(*[F.count_if(F.coalesce(F.trim(c), F.lit("")) != "").alias(c) for c in columns])
