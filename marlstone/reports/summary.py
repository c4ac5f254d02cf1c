"""A run's summary: one nested JSON document for each model and condition, the only input of the reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import Model, slug

#: Nothing is billed for a local engine: these figures are then absent, not 0.
COSTS = (
    "summarization_cost", "hallucination_cost", "classification_cost", "retry_error_cost", "judge_cost", "total_openrouter_cost", "fresh_cost_this_run",
    "stored_benchmark_cost", "estimated_cost_without_cache", "estimated_cache_savings",
)


def local_costs(cost: dict) -> dict:
    """A cost block without what has no meaning for a local engine."""
    return {k: None if k in COSTS else v for k, v in cost.items() if k != "reconciliation"}


def without_private(tree: dict) -> dict:
    """Without keys that begin with an underscore, at any depth."""
    return {k: without_private(v) if isinstance(v, dict) else v for k, v in tree.items() if not k.startswith("_")}


def per_key(table: DataFrame, key: str = "language") -> dict[str, dict]:
    """A small score table as a tree by its key."""
    return {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in table.collect()}


def build(model: Model, run_id: str, status: str, mode: str, tables: dict[str, DataFrame], cost: dict, usage: dict, generated_at: str, **more: object) -> dict:
    """The summary of a run; ``tables`` is what pipeline.aggregate gives."""
    metrics: dict = {}
    for name in ("summarization", "hallucination"):
        if name in tables:
            metrics[name] = {"per_language": per_key(tables[name])}
    if "surface_facts" in tables and "summarization" in metrics:
        for lang, block in per_key(tables["surface_facts"]).items():
            metrics["summarization"]["per_language"].setdefault(lang, {})["surface_fact_diagnostic"] = block
    if "classification" in tables:
        own = per_key(tables["classification"])
        cross = tables["cross_lingual"].first() if "cross_lingual" in tables else None
        metrics["classification"] = {"overall": own.pop("overall", {}), "per_language": own, "cross_lingual": cross.asDict() if cross else {"paired_cases": 0}}
    held = {
        "schema_version": 2, "generated_at": generated_at, "run_id": run_id, "status": status, "api_provider": model.api_provider,
        "model": {"model_id": model.model_id, "display_name": model.display_name, "vendor": model.vendor}, "variant": {"classification_mode": mode},
        "usage": usage, "cost": local_costs(cost) if model.api_provider == "local" else cost, "metrics": metrics, **more,
    }
    return without_private(held)


def file_name(model: Model, mode: str) -> str:
    """The baseline condition's file has the plain name, that of another names the condition."""
    return f"{slug(model.model_id)}/summary{'' if mode == 'text' else f'.classification-{mode}'}.json"


def as_text(summary: dict) -> str:
    return json.dumps(summary, ensure_ascii=False, indent=2, sort_keys=False) + "\n"


def shortened(rows: DataFrame, *columns: str) -> DataFrame:
    """Hashes cut to what is shown."""
    return rows.withColumns({c: F.substring(c, 1, 12) for c in columns})
