"""The long result table: upsert by natural key, filters, runs, cohorts and run comparison.

Results: run_id, protocol_version, domain_url, variable_name, value (JSON), confidence, audit_trail_json, plugin_version, computed_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glasshouse.functions import lexicon as L

KEY = ["protocol_version", "run_id", "variable_name", "domain_url"]
FILTERS = ["domain_url", "variable_name", "run_id", "protocol_version"]


def upsert(old: DataFrame, new: DataFrame, key: list[str] = KEY, version: str = "computed_at") -> DataFrame:
    """Last write wins on the natural key; at equal times the new row does."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version), F.desc("_new")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n", "_new")


def query(results: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Equality on the four allowed columns, other keys ignored, oldest first."""
    for k, v in wanted.items():
        if k in FILTERS and v:
            results = results.where(F.col(k) == v)
    return results.orderBy("computed_at")


def begin_run(run_id: str, protocol_version: str, sample_size: int, started: Column) -> list[Column]:
    return [F.lit(run_id).alias("run_id"), F.lit(protocol_version).alias("protocol_version"), F.lit(sample_size).alias("sample_size"), started.alias("started_at")]


def runs(events: DataFrame) -> DataFrame:
    """Run events (begin and finish rows) to one row a run."""
    return events.groupBy("run_id").agg(*[F.max(c).alias(c) for c in ("protocol_version", "started_at", "completed_at", "sample_size", "errors_count")])


def finished(run_table: DataFrame, n: int = 2) -> DataFrame:
    """The latest finished runs, newest first."""
    return run_table.where("completed_at IS NOT NULL").orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def decoded(value: Column) -> Column:
    """A JSON value as plain text: true, 3, nao_aplicavel."""
    return F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)


def encoded(value: Column) -> Column:
    """Plain text as a JSON value: booleans and numbers bare, other text quoted."""
    return F.when(value.rlike(r"^(true|false|-?\d+(\.\d+)?([eE][+-]?\d+)?)$"), value).otherwise(F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', "$1"))


def state(value: Column) -> Column:
    """The four states; what is none of them counts as false."""
    v = decoded(value)
    return F.when(v.isin(*[s for s in L.STATES if s != "false"]), v).otherwise("false")


def equal_text(value: Column, target: Column) -> Column:
    return F.lower(F.trim(decoded(value))) == F.lower(F.trim(target))


# --- cohorts of a previous run ---

CRITERIA = ("valor", "extrapolacao", "sem_resultado", "mudanca")


def criterion(params: dict) -> str:
    """Exactly one criterion must be given."""
    given = [c for c in CRITERIA if params.get(c)]
    if len(given) != 1:
        raise ValueError(f"exactly one of {CRITERIA} is needed, not {given}")
    return given[0]


def cohort_value(results: DataFrame, variable: str, value: str) -> DataFrame:
    return results.where((F.col("variable_name") == variable) & equal_text(F.col("value"), F.lit(value))).select("domain_url").distinct()


def cohort_flag(results: DataFrame, variable: str | None = None, flag: str = "extrapolacao") -> DataFrame:
    rows = results.where(F.col("variable_name") == variable) if variable else results
    return rows.where(F.lower(F.get_json_object("audit_trail_json", f"$.{flag}")).isin("true", "1")).select("domain_url").distinct()


def cohort_missing(results: DataFrame, variable: str) -> DataFrame:
    """Domains of the run without a result for the variable."""
    return results.select("domain_url").distinct().join(results.where(F.col("variable_name") == variable).select("domain_url"), "domain_url", "left_anti")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Domain and variable measured in both runs with different values."""
    a = before.select("domain_url", "variable_name", F.col("value").alias("value_before"))
    b = after.select("domain_url", "variable_name", F.col("value").alias("value_after"))
    return a.join(b, ["domain_url", "variable_name"]).where(~F.col("value_before").eqNullSafe(F.col("value_after")))


def cohort(results: DataFrame, run_table: DataFrame, params: dict) -> DataFrame:
    """Hosts of previous runs by one criterion; without a run the latest finished ones are taken."""
    kind = criterion(params)
    latest = [r.run_id for r in finished(run_table).collect()]  # two rows at most
    if kind == "mudanca":
        new, old = params.get("runs") or (latest + [None, None])[:2]
        if not new or not old:
            raise ValueError("two finished runs are needed")
        out = changes(results.where(F.col("run_id") == old), results.where(F.col("run_id") == new)).select("domain_url").distinct()
    else:
        run = params.get("run_id") or next(iter(latest), None)
        if run is None:
            raise ValueError("no finished run")
        rows = results.where(F.col("run_id") == run)
        spec = params[kind]
        out = cohort_value(rows, spec["variavel"], spec["igual"]) if kind == "valor" else cohort_flag(rows, spec if isinstance(spec, str) else None) if kind == "extrapolacao" else cohort_missing(rows, spec)
    out = out.orderBy("domain_url")
    return out.limit(params["limite"]) if params.get("limite") else out


# --- dependencies between variables ---


def resolve(results: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Applies one level of dependencies: dependencies(variable_name, depends_on) over results(site, variable_name, state, ...).

    A dependency that was not collected makes the variable nao_coletado, one that is not exactly true nao_aplicavel."""
    needs = results.join(dependencies, "variable_name").select("site", "variable_name", "depends_on")
    found = needs.join(results.select("site", F.col("variable_name").alias("depends_on"), F.col("state").alias("dep_state")), ["site", "depends_on"], "left")
    missing = F.coalesce(F.col("dep_state"), F.lit("nao_coletado"))
    blocked = found.groupBy("site", "variable_name").agg(F.bool_or(missing == "nao_coletado").alias("uncollected"), F.bool_or(missing != "true").alias("unmet"))
    rows = results.join(blocked, ["site", "variable_name"], "left")
    off = F.coalesce("uncollected", F.lit(False))
    unmet = F.coalesce("unmet", F.lit(False))
    return rows.select(
        *[c for c in results.columns if c not in ("state", "reason", "confidence")],
        F.when(off, "nao_coletado").when(unmet, "nao_aplicavel").otherwise(F.col("state")).alias("state"),
        F.when(off, "dependencia_nao_coletada").when(unmet, "precondicao_nao_satisfeita").otherwise(F.col("reason") if "reason" in results.columns else F.lit(None).cast("string")).alias("reason"),
        F.when(off | unmet, F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"),
    )


def levels(depends: dict[str, list[str]]) -> list[list[str]]:
    """Variables by level of their dependencies; fails on a cycle."""
    left, out, done = dict(depends), [], set()
    while left:
        now = sorted(v for v, d in left.items() if all(x in done or x not in depends for x in d))
        if not now:
            raise ValueError(f"dependencies form a cycle: {sorted(left)}")
        out.append(now)
        done.update(now)
        for v in now:
            del left[v]
    return out


def fill_uncollected(sample: DataFrame, variables: list[str], results: DataFrame, reason: str = "coleta_falhou") -> DataFrame:
    """A nao_coletado row, with confidence 0, for each declared variable of a sampled site that has no result."""
    declared = sample.select("site").distinct().withColumn("variable_name", F.explode(F.array(*[F.lit(v) for v in variables])))
    lost = declared.join(results.select("site", "variable_name"), ["site", "variable_name"], "left_anti")
    return lost.select("site", "variable_name", F.lit("nao_coletado").alias("state"), F.lit(reason).alias("reason"), F.lit(0.0).alias("confidence"))


def check_collisions(tests: list[dict]) -> None:
    """Two tests must not write the same variable."""
    names = [t["variable"] + t.get("params", {}).get("variavel_sufixo", "") for t in tests]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"variables declared twice: {twice}; use variavel_sufixo")


def with_suffix(variable: Column, suffix: str | None) -> Column:
    return F.concat(variable, F.lit(suffix)) if suffix else variable
