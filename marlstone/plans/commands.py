"""What the commands do: prepare, models, pricing, estimate, run. One tree of settings names everything they need.

    settings: {seed: 1, budget_usd: 2.0, ...}         any field of Settings
    defaults: {...}, models: [{model_id: a/b, ...}]   fields of Model
    store: path, results: path, revision: text, split: text
    raw: {xlsum: {en: path, ko: path}, halueval: path, factuality: path, massive: {en: path, ko: path}}
    manifests: {summarization: path, hallucination_en: path, hallucination_ko: path, classification: path}
    wanted: {summarization: 50, ...}                  how many cases of each
    judges: {name: {model_id: a/b, samples: 100, languages: [en]}}   models that grade summaries, when a run asks for one
"""

from __future__ import annotations

import pathlib
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, money
from ..operators.store import Store
from ..reports import summary
from ..sources import manifest, readers
from . import backend as backends
from . import capabilities, config, evaluators, judge as judging, pipeline, provenance, tasks

BENCHMARKS = ("summarization", "hallucination", "classification")
MANIFESTS = ("summarization", "hallucination_en", "hallucination_ko", "classification")


@dataclass(frozen=True)
class Prepared:
    """What became of one manifest: written, kept (it was there) or skipped (no raw data is named)."""

    name: str
    status: str
    path: str | None = None
    count: int = 0
    manifest_hash: str | None = None


def _settings(tree: dict) -> config.Settings:
    return config.known(config.Settings, tree.get("settings", {}))


def models_of(tree: dict, wanted: str | None = None) -> list[config.Model]:
    """The enabled models, or the one asked for."""
    own = [config.known(config.Model, {k: tuple(v) if isinstance(v, list) else v for k, v in m.items()}) for m in tree.get("models", [])]
    return [config.by_id(own, wanted)] if wanted else [m for m in own if m.enabled]


def prepare(spark: SparkSession, tree: dict, force: bool = False, only: str | None = None) -> list[Prepared]:
    """Writes the manifests that are not there yet, or all if forced."""
    settings, raw, wanted = _settings(tree), tree.get("raw", {}), tree.get("wanted", {})
    revision, split = tree.get("revision", "local"), tree.get("split", "test")
    if only and only not in MANIFESTS:
        raise config.ConfigError(f"no manifest {only!r}")

    def records(name: str) -> DataFrame | None:
        n = wanted.get(name, 50)
        if name == "summarization" and raw.get("xlsum"):
            parts = [readers.read_xlsum(spark, path, language, split) for language, path in sorted(raw["xlsum"].items())]
            rows = parts[0]
            for part in parts[1:]:
                rows = rows.unionByName(part)
            return pipeline.prepare_summarization(rows, n, revision, split, settings)
        if name == "hallucination_en" and raw.get("halueval"):
            return pipeline.prepare_hallucination_en(readers.read_halueval(spark, raw["halueval"]), n, revision, split, settings)
        if name == "hallucination_ko" and raw.get("factuality"):
            return pipeline.prepare_hallucination_ko(readers.read_factuality(spark, raw["factuality"]), n, revision, split, settings)[0]
        if name == "classification" and raw.get("massive"):
            en, ko = (readers.read_massive(spark, raw["massive"][x], x) for x in ("en", "ko"))
            return pipeline.prepare_classification(en, ko, n, revision, split, settings)
        return None

    out = []
    for name in MANIFESTS if only is None else [only]:
        path = tree.get("manifests", {}).get(name)
        if path and not force and manifest.exists(spark, path):
            meta = manifest.read_meta(spark, path)
            out.append(Prepared(name, "kept", path, meta["counts"]["total"], meta["manifest_hash"]))
        elif path and (rows := records(name)) is not None:
            meta = manifest.write(rows, path, version=settings.benchmark_version, repo=name, revision=revision, split=split, seed=settings.seed)
            out.append(Prepared(name, "written", path, meta["counts"]["total"], meta["manifest_hash"]))
        else:
            out.append(Prepared(name, "skipped", path))
    return out


def models_table(spark: SparkSession, tree: dict, listing: str | None = None) -> DataFrame:
    """The models' settings; with a listing's JSON, what it says of each and which parameters it lacks."""
    own = models_of(tree)
    rows = [(m.model_id, m.display_name, m.vendor, m.api_provider, m.role, m.input_per_million, m.output_per_million, list(m.supported_parameters)) for m in own]
    made = spark.createDataFrame(rows, "model_id string, display_name string, vendor string, api_provider string, role string, input_per_million double, output_per_million double, needs array<string>")
    if listing is None:
        return made.drop("needs").orderBy("model_id")
    held = readers.model_metadata(spark, listing, [m.model_id for m in own]).select("model_id", "context_length", F.col("supported_parameters").alias("offers"))
    lacks = F.array_except("needs", F.coalesce("offers", F.array().cast("array<string>")))
    return made.join(held, "model_id", "left").select("*", F.col("offers").isNotNull().alias("listed"), lacks.alias("missing_parameters")).drop("needs", "offers").orderBy("model_id")


def pricing(spark: SparkSession, tree: dict, listing: str, save: bool = False, max_input: float = 0.25, max_output: float = 1.5) -> DataFrame:
    """Listed against configured prices; with ``save`` the listed ones go to the store as a snapshot."""
    own = models_of(tree)
    live = readers.model_metadata(spark, listing, [m.model_id for m in own])
    rows = [(m.model_id, m.input_per_million, m.output_per_million, m.cached_input_per_million) for m in own]
    configured = spark.createDataFrame(rows, "model_id string, input_per_million double, output_per_million double, cached_input_per_million double")
    if save:
        stamp = live.withColumns({"retrieved_at": F.current_timestamp(), "source": F.lit(listing), "id": F.xxhash64("model_id", F.current_timestamp())})
        Store(spark, tree["store"]).append("pricing_snapshots", stamp)
    return money.compare_prices(live, configured, max_input, max_output).orderBy("model_id")


def _records(spark: SparkSession, tree: dict, benchmark: str, language: str | None) -> DataFrame | None:
    """Records of a benchmark's manifests that are there."""
    paths = {k: p for k, p in tree.get("manifests", {}).items() if k.split("_")[0] == benchmark}
    held = [x for x in manifest.read_all(spark, paths).values() if x is not None]
    out = None
    for rows in held:
        out = rows if out is None else out.unionByName(rows)
    return None if out is None else manifest.of_language(out, language)


def skipped(spark: SparkSession, model: config.Model) -> dict[str, str]:
    """Benchmarks that don't apply to a model, with the reason."""
    names = spark.createDataFrame([(b,) for b in BENCHMARKS], "benchmark string")
    why = names.withColumn("reason", filters.skip_reason(F.lit(model.api_provider), F.lit(model.decisions), F.col("benchmark")))
    return {r["benchmark"]: r["reason"] for r in why.where("reason is not null").collect()}


def plans(spark: SparkSession, tree: dict, model: config.Model, benchmark: str | None = None, language: str | None = None, retry_failed: bool = False, force: bool = False) -> dict[str, tuple[pipeline.Plan, DataFrame, list[str]]]:
    """By benchmark that applies to the model: the plan, the records, and the labels of classification."""
    settings, store, out = _settings(tree), Store(spark, tree["store"]), {}
    left_out = skipped(spark, model)
    for name in BENCHMARKS if benchmark is None else [benchmark]:
        if name in left_out:
            continue
        records = _records(spark, tree, name, language)
        if records is None:
            continue
        labels = sorted(r[0] for r in records.select("label").distinct().collect()) if name == "classification" else []
        made = tasks.classification(records, labels, model, settings) if name == "classification" else getattr(tasks, name)(records, model, settings)
        out[name] = (pipeline.plan(made, store, model, retry_failed, force), records, labels)
    return out


def estimate(spark: SparkSession, tree: dict, model: str | None = None, benchmark: str | None = None, language: str | None = None) -> DataFrame:
    """What each model's benchmarks would cost, with the cache and without."""
    out = None
    for m in models_of(tree, model):
        for name, (plan, _, _) in plans(spark, tree, m, benchmark, language).items():
            rows = plan.estimate.select(F.lit(m.model_id).alias("model_id"), F.lit(name).alias("plan"), "*")
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise config.ConfigError("no manifest is there yet: prepare them first")
    return out


def _judge_model(tree: dict, model_id: str) -> config.Model:
    """A judge's settings, its own among the models or the defaults."""
    return next((x for x in models_of(tree | {"models": [m | {"enabled": True} for m in tree.get("models", [])]}) if x.model_id == model_id), None) or config.Model(model_id, role="judge")


def _provenance(spark: SparkSession, tree: dict, model: config.Model, settings: config.Settings, at: str) -> dict:
    """The block of what the run depends on; manifests under benchmark:language, as report tables name them."""
    metas: dict[str, dict | None] = {}
    for name, path in tree.get("manifests", {}).items():
        meta = manifest.read_meta(spark, path) if manifest.exists(spark, path) else None
        benchmark, _, language = name.partition("_")
        metas[f"{benchmark}:{language}" if language else benchmark] = meta
    prices = {"input_per_million": model.input_per_million, "output_per_million": model.output_per_million, "cached_input_per_million": model.cached_input_per_million}
    return provenance.block(model, settings, metas, evaluators.standard(), at, prices)


def run(spark: SparkSession, tree: dict, model: str, run_id: str, backend: backends.Backend | None = None, benchmark: str | None = None, language: str | None = None, dry_run: bool = False, retry_failed: bool = False, force: bool = False, listing: str | None = None, judge: str | None = None) -> dict:
    """Asks what is pending, scores what is there, and writes the run's summary; its tree. A dry run plans and asks nothing.

    With a listing, a run that would send what the model does not take is
    refused before anything is asked. With the name of a judge, the first summaries of the manifest are graded by its model, each once.
    Benchmarks that don't apply to the model are left out and named in the summary. Metrics of summaries come through the store's cache of values.
    """
    settings, m, store = _settings(tree), models_of(tree, model)[0], Store(spark, tree["store"])
    verdict = None
    if listing is not None:
        held = readers.model_metadata(spark, listing, [m.model_id])
        verdict = capabilities.check(spark, m, settings, held, m.structured_output and benchmark in (None, "classification"))
    grader = tree.get("judges", {}).get(judge) if judge else None
    if judge and grader is None:
        raise config.ConfigError(f"no judge {judge!r}; there are {sorted(tree.get('judges', {}))}")
    left_out = {k: why for k, why in skipped(spark, m).items() if benchmark in (None, k)}
    own = plans(spark, tree, m, benchmark, language, retry_failed, force)
    if not own:
        raise config.ConfigError("; ".join(f"{k}: {why}" for k, why in left_out.items()) or "no manifest is there yet: prepare them first")
    if dry_run:
        return {"dry_run": True, "capabilities": verdict, "pending": {name: plan.pending.count() for name, (plan, _, _) in own.items()}}
    began, reasons, spent, left = datetime.now(UTC), {}, 0.0, settings.budget_usd
    for name, (plan, _, _) in own.items():
        guards = pipeline.execute(plan, store, backend or backends.Stub(), f"{run_id}-{name}", config.Settings(**{**vars(settings), "budget_usd": left}))
        spent, left = spent + guards.spent, max(0.0, left - guards.spent)
        if guards.reason:
            reasons[name] = guards.reason
    results, scored, graded = store.rows("inference_results").where(F.col("model_id") == m.model_id), {}, {"enabled": False}
    for name, (plan, records, labels) in own.items():
        held = pipeline.of_plan(results, plan.tasks)
        if name == "classification":
            scored["classes"] = pipeline.score_classification(plan.tasks, held, records, labels, tasks.output_mode(m))
        elif name == "hallucination":
            scored["hallucinations"] = pipeline.score_hallucination(records, held)
        else:
            scored["summaries"] = pipeline.score_summarization(records, held, store)
            if grader:
                spoken = records.where(F.col("language").isin(*grader["languages"])) if grader.get("languages") else records
                samples = pipeline.judgeable(spoken, held, grader.get("samples", settings.judge_samples))
                graded = judging.outcome(samples, _judge_model(tree, grader["model_id"]), m, store, backend or backends.Stub(), run_id, judge)
    used = money.usage_totals(results, "model_id").first()
    status = "STOPPED" if reasons else "COMPLETED"
    mode = tasks.output_mode(m)
    made = summary.build(m, run_id, status, mode, pipeline.aggregate(**scored), {"fresh_cost_this_run": spent, "judge_cost": graded.get("judge_cost_usd", 0.0)}, used.asDict() if used else {}, began.isoformat(), stopped=reasons, skipped=left_out, judge=graded, capabilities=verdict, reproducibility=_provenance(spark, tree, m, settings, began.isoformat()))
    runs = [(run_id, m.model_id, list(own), status, False, settings.budget_usd, spent, graded.get("judge_cost_usd", 0.0), began, datetime.now(UTC))]
    store.append("runs", spark.createDataFrame(runs, "run_id string, model_id string, benchmarks array<string>, status string, dry_run boolean, budget_usd double, fresh_cost_usd double, judge_cost_usd double, started_at timestamp, finished_at timestamp"))
    if tree.get("results"):
        path = pathlib.Path(tree["results"]) / summary.file_name(m, mode)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(summary.as_text(made), encoding="utf-8")
    return made
