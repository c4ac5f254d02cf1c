"""Report tables: flat views of the models' summaries, each a list of columns with their path in a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LANGUAGES = ("en", "ko")


def ranked(rows: DataFrame, measure: str, name: str) -> DataFrame:
    """``rows`` (one for each model) with ``rank``: best measure first, null as 0, then by name."""
    order = Window.orderBy(F.coalesce(F.col(measure), F.lit(0.0)).desc(), name)
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint"))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(path, s variant, model, display_name, mode) of every summary*.json below a path; files that are no JSON are skipped."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "summary*.json").text(path)
    own = raw.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("s")).where("s is not null")
    model = at("model.model_id", "string", "")
    return own.withColumns({"model": model, "display_name": F.coalesce(F.nullif(at("model.display_name", "string", ""), F.lit("")), model), "mode": at("variant.classification_mode", "string", "text")})


def baseline(summaries: DataFrame) -> DataFrame:
    """One summary for each model: the first of the text condition by path, else the first."""
    order = Window.partitionBy("model").orderBy((F.col("mode") == "text").desc(), "path")
    return summaries.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def at(path: str, kind: str = "double", default: object = None) -> Column:
    """A value inside a summary, the default where the path leads nowhere. Parts with a colon are quoted."""
    parts = "".join(f"['{p}']" if ":" in p else f".{p}" for p in path.split("."))
    got = F.try_variant_get("s", f"${parts}", kind)
    return got if default is None else F.coalesce(got, F.lit(default))


# Columns of the tables, as name, path and kind.
_SUM = ["cases:bigint", "scored_cases:bigint", "rouge_lsum_f=rougeLsum_f", "rouge1_f", "rouge2_f", "chrf_pp=chrf", "bertscore_f1", "surface_fact_support=surface_fact_support_precision", "compression_ratio", "output_tokens_mean", "empty_output_rate", "refusal_rate", "failed_cases:bigint"]
_HALU = ["status:string", "cases:bigint", "documents:bigint", "accuracy", "macro_f1", "hallucination_precision", "hallucination_recall", "hallucination_f1", "supported_recall", "supported_f1", "invalid_output_rate", "failed_cases:bigint"]
_CLS = ["cases:bigint", "accuracy", "macro_f1", "correct:bigint", "invalid_output_rate", "label_space_size:bigint"]
_CROSS = ["paired_cases:bigint", "consistency", "prediction_agreement", "both_correct:bigint", "both_correct_rate", "en_only_correct:bigint", "en_only_correct_rate", "ko_only_correct:bigint", "ko_only_correct_rate", "both_wrong:bigint", "both_wrong_rate"]
_FACTS = ["facts_total:bigint", "facts_supported:bigint", "support_precision=surface_fact_support_precision", "number_mismatch:bigint", "percentage_mismatch:bigint", "date_mismatch:bigint", "currency_mismatch:bigint", "unsupported_named_entity:bigint", "summaries_with_facts:bigint"]
_COST = [
    "input_per_million=pricing_snapshot.input_per_million", "cached_input_per_million=pricing_snapshot.cached_input_per_million", "output_per_million=pricing_snapshot.output_per_million",
    "pricing_source=pricing_snapshot.source:string", "pricing_retrieved_at=pricing_snapshot.retrieved_at:string", "summarization_cost", "hallucination_cost", "classification_cost", "retry_error_cost",
    "judge_cost", "total_openrouter_cost", "fresh_cost_this_run", "stored_benchmark_cost", "estimated_cost_without_cache", "estimated_cache_savings",
    "recomputed_from_pricing_table=reconciliation.recomputed_from_pricing_table", "reconciliation_ok=reconciliation.matches_within_tolerance:boolean",
]
_USAGE = [*[f"{c}=usage.{c}:bigint" for c in ("successful_cases", "prompt_tokens", "cached_tokens", "cache_write_tokens", "completion_tokens", "reasoning_tokens", "total_tokens")], *[f"{c}=cache.{c}:bigint" for c in ("cache_hits", "cache_misses", "openrouter_api_calls", "openrouter_http_attempts")]]
_JUDGE = ["judge_model:string", "profile:string", "self_judge:boolean", "judged_cases=scores.judged_cases:bigint", "factual_consistency=scores.factual_consistency", "key_information_coverage=scores.key_information_coverage", "conciseness=scores.conciseness", "overall_quality=scores.overall_quality", "invalid_outputs:bigint", "judge_cost_usd"]
_RUNS = [
    "status:string", "run_id:string", "generated_at:string", "executed_at=reproducibility.executed_at:string", "benchmark_version=reproducibility.benchmark_version:string", "git_commit=reproducibility.git_commit:string",
    "git_dirty=reproducibility.git_dirty:boolean", "python_version=reproducibility.python_version:string", "total_cases=scope.total_cases:bigint", "routing_config_hash=reproducibility.routing_config_hash:string",
    "resolved_model=reproducibility.alias_resolution:string",
]
_MANIFESTS = {"xlsum_manifest": "summarization", "halueval_manifest": "hallucination:en", "aihub_manifest": "hallucination:ko", "massive_manifest": "classification"}
_BOARD = [
    "vendor=model.vendor:string", "status:string", "input_per_million=cost.pricing_snapshot.input_per_million", "output_per_million=cost.pricing_snapshot.output_per_million",
    "cached_input_per_million=cost.pricing_snapshot.cached_input_per_million", "pricing_source=cost.pricing_snapshot.source:string", "pricing_retrieved_at=cost.pricing_snapshot.retrieved_at:string",
    *[f"summary_{lang}{end}=metrics.summarization.per_language.{lang}.{m}" for end, m in (("", "rougeLsum_f"), ("_chrf", "chrf"), ("_bertscore", "bertscore_f1"), ("_surface_facts", "surface_fact_support_precision")) for lang in LANGUAGES],
    *[f"halu_{lang}{end}=metrics.hallucination.per_language.{lang}.{m}" for end, m in (("_f1", "hallucination_f1"), ("_accuracy", "accuracy")) for lang in LANGUAGES],
    "halu_ko_status=metrics.hallucination.per_language.ko.status:string",
    *[f"cls_{lang}{end}=metrics.classification.per_language.{lang}.{m}" for end, m in (("", "accuracy"), ("_macro_f1", "macro_f1")) for lang in LANGUAGES],
    "cls_overall_accuracy=metrics.classification.overall.accuracy", "cls_overall_macro_f1=metrics.classification.overall.macro_f1", "en_ko_consistency=metrics.classification.cross_lingual.consistency",
]
TABLES = ["Leaderboard", "Summarization", "Hallucination", "Classification", "CrossLingual", "ClassificationModes", "SurfaceFacts", "Cost", "Usage", "Judge", "Runs"]


def _columns(specs: list[str], under: str = "") -> list[Column]:
    out = []
    for spec in specs:
        head, _, kind = spec.partition(":") if ":" in spec.rpartition("=")[2] else (spec, "", "double")
        name, _, path = head.partition("=")
        out.append(at(f"{under}.{path or name}".strip("."), kind or "double").alias(name))
    return out


def _by_scope(s: DataFrame, under: str, scopes: dict[str, str], name: str, specs: list[str]) -> DataFrame:
    """A row for each scope that a summary has; scopes map to the path below ``under``."""
    made = None
    for scope, path in scopes.items():
        own = s.where(at(f"{under}.{path}", "variant").isNotNull()).select("model", "display_name", F.lit(scope).alias(name), *_columns(specs, f"{under}.{path}"))
        made = own if made is None else made.unionByName(own)
    return made


def _per_language(part: str, end: str = "") -> dict[str, str]:
    return {lang: f"per_language.{lang}{end}" for lang in LANGUAGES}


def leaderboard(s: DataFrame) -> DataFrame:
    tokens = {"input_tokens": "prompt_tokens", "output_tokens": "completion_tokens", "cached_tokens": "cached_tokens", "reasoning_tokens": "reasoning_tokens"}
    money = {"openrouter_cost": "stored_benchmark_cost", "judge_cost": "judge_cost", "fresh_cost_this_run": "fresh_cost_this_run", "estimated_cache_savings": "estimated_cache_savings"}
    own = s.select(
        "model", at("model.display_name", "string", "").alias("display_name"), at("api_provider", "string", "openrouter").alias("api_provider"), *_columns(_BOARD),
        *[at(f"usage.{p}", "bigint", 0).alias(c) for c, p in tokens.items()],
        *[F.when(at(f"cost.{p}", "variant").isNull(), F.lit(0.0)).otherwise(at(f"cost.{p}")).alias(c) for c, p in money.items()],
    )
    return own.orderBy(F.coalesce("cls_overall_accuracy", F.lit(0.0)).desc(), "model")


def modes(summaries: DataFrame) -> DataFrame:
    from ..operators.scores import mode_deltas

    made = None
    for lang in LANGUAGES:
        p = f"metrics.classification.per_language.{lang}"
        own = summaries.where(at(p, "variant").isNotNull()).select("model", F.lit(lang).alias("language"), "mode", *_columns(["accuracy", "macro_f1", "invalid_output_rate"], p))
        made = own if made is None else made.unionByName(own)
    return mode_deltas(made)


def build(summaries: DataFrame) -> dict[str, DataFrame]:
    """All tables, in the order of TABLES."""
    s = baseline(summaries)
    cls = {**_per_language(""), "overall": "overall"}
    joined = lambda path: F.array_join(at(path, "array<string>"), "; ")
    halu = _by_scope(s, "metrics.hallucination", _per_language(""), "language", _HALU).withColumn("status", F.coalesce("status", F.lit("OK")))
    made = {
        "Summarization": _by_scope(s, "metrics.summarization", _per_language(""), "language", _SUM),
        "Hallucination": halu,
        "Classification": _by_scope(s, "metrics.classification", cls, "scope", _CLS),
        "CrossLingual": s.where(at("metrics.classification.cross_lingual.paired_cases", "bigint") > 0).select("model", "display_name", *_columns(_CROSS, "metrics.classification.cross_lingual")),
        "SurfaceFacts": _by_scope(s, "metrics.summarization", _per_language("", ".surface_fact_diagnostic"), "language", _FACTS),
        "Cost": s.select("model", "display_name", *_columns(_COST, "cost")),
        "Usage": s.select("model", "display_name", *_columns(_USAGE)),
        "Judge": s.where(at("judge.enabled", "boolean")).select("model", *_columns(_JUDGE, "judge"), F.coalesce(joined("judge.warnings"), F.lit("")).alias("warnings")),
        "Runs": s.select(
            "model", *_columns(_RUNS), F.coalesce(F.array_join(at("scope.benchmarks", "array<string>"), ", "), F.lit("")).alias("benchmarks"),
            F.coalesce(F.array_join(at("scope.languages", "array<string>"), ", "), F.lit("")).alias("languages"),
            *[at(f"reproducibility.manifests.{p}.hash", "string", "").alias(c) for c, p in _MANIFESTS.items()],
            F.coalesce(F.array_join(F.transform(F.map_entries(at("scope.skipped", "map<string,string>")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; "), F.lit("")).alias("skipped"),
            F.coalesce(joined("notes"), F.lit("")).alias("notes"),
        ),
    }
    made = {k: v.orderBy(*v.columns[:3]) for k, v in made.items()}
    made |= {"Leaderboard": leaderboard(s), "ClassificationModes": modes(summaries)}
    return {name: made[name] for name in TABLES}


def newest(summaries: DataFrame) -> str | None:
    """The latest time of any result: reports carry it and not the clock, so equal results give equal files."""
    return summaries.select(F.max(F.nullif(F.coalesce(at("reproducibility.executed_at", "string"), at("generated_at", "string")), F.lit("")))).first()[0]
