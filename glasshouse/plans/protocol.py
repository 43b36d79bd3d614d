"""A measurement protocol in YAML: validated, identified by its digest, bound to plugins by name and run as DataFrame stages."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasshouse.operators import render, store

REQUIRED = ["metadata", "repository", "result_store", "fetcher", "tests"]
LAYERS = ("source", "fetcher", "repository", "test", "store", "output")
REGISTRY: dict[str, dict[str, Callable]] = {layer: {} for layer in LAYERS}


def plugin(layer: str, name: str):
    """Registers a DataFrame function under a layer and a name."""

    def add(f: Callable) -> Callable:
        REGISTRY[layer][name] = f
        return f

    return add


def resolve(layer: str, name: str) -> Callable:
    if layer not in REGISTRY:
        raise KeyError(f"no layer {layer!r}; layers: {sorted(REGISTRY)}")
    if name not in REGISTRY[layer]:
        raise KeyError(f"no {layer} plugin {name!r}; plugins: {sorted(REGISTRY[layer])}")
    return REGISTRY[layer][name]


def list_plugins() -> dict[str, list[str]]:
    return {layer: sorted(names) for layer, names in REGISTRY.items()}


class Protocol:
    def __init__(self, raw: bytes, rules: Callable[[str], dict] | None = None):
        import yaml

        self.sha256 = hashlib.sha256(raw).hexdigest()
        self.data = yaml.safe_load(raw) or {}
        if missing := [k for k in REQUIRED if k not in self.data]:
            raise ValueError(f"protocol lacks {missing}")
        self.tests = []
        for t in self.data["tests"]:
            base = dict(rules(t["rules_file"])) if rules and t.get("rules_file") else {}
            self.tests.append({"name": t["name"], "variable": t.get("variable", t["name"]), "params": base | (t.get("params") or {})})  # inline parameters win
        store.check_collisions(self.tests)

    @property
    def outputs(self) -> list[dict]:
        return self.data.get("outputs") or []

    def dependencies(self) -> list[tuple[str, str]]:
        return [(t["variable"] + t["params"].get("variavel_sufixo", ""), d) for t in self.tests for d in t["params"].get("depende_de", [])]

    def declare_list(self, digest: str) -> str:
        """The protocol's text with the list's digest in its source."""
        import yaml

        for s in self.data.get("sources") or [self.data.setdefault("source", {"name": "csv"})]:
            s.setdefault("params", {})["sha256"] = digest
        return yaml.safe_dump(self.data, allow_unicode=True, sort_keys=False)


def analyse(spark: SparkSession, protocol: Protocol, evidence: dict[str, DataFrame], run_id: str, sample: DataFrame | None = None) -> DataFrame:
    """Runs every test over captured evidence (a replay: no network) and resolves dependencies level by level.

    Each test plugin takes (evidence, params) and returns site, state, confidence[, audit_trail_json]."""
    parts = None
    for t in protocol.tests:
        out = resolve("test", t["name"])(evidence, t["params"])
        audit = F.col("audit_trail_json") if "audit_trail_json" in out.columns else F.lit("{}")
        rows = out.select("site", F.lit(t["variable"] + t["params"].get("variavel_sufixo", "")).alias("variable_name"), "state", "confidence", F.lit(None).cast("string").alias("reason"), audit.alias("audit_trail_json"))
        parts = rows if parts is None else parts.unionByName(rows)
    if sample is not None:
        lost = store.fill_uncollected(sample, [t["variable"] + t["params"].get("variavel_sufixo", "") for t in protocol.tests], parts)
        parts = parts.unionByName(lost.withColumn("audit_trail_json", F.lit("{}")))
    pairs = protocol.dependencies()
    depends: dict[str, list[str]] = {}
    for v, d in pairs:
        depends.setdefault(v, []).append(d)
    for level in store.levels(depends) if depends else []:
        now = [(v, d) for v, d in pairs if v in level]
        if now:
            parts = store.resolve(parts, spark.createDataFrame(now, "variable_name string, depends_on string"))
    return parts.select(
        F.lit(run_id).alias("run_id"), F.lit(protocol.data["metadata"].get("protocol_version", "")).alias("protocol_version"), F.col("site").alias("domain_url"), "variable_name",
        store.encoded(F.col("state")).alias("value"), "confidence", F.when(F.col("reason").isNotNull(), F.to_json(F.struct(F.col("reason").alias("motivo")))).otherwise(F.col("audit_trail_json")).alias("audit_trail_json"),
        F.lit(protocol.sha256[:12]).alias("plugin_version"), F.current_timestamp().alias("computed_at"),
    )


for _name in render.RENDERERS:
    REGISTRY["output"][_name] = render.RENDERERS[_name]
