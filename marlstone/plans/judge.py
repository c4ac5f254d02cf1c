"""Judging summaries by another model: its own key, store and budget line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys, parsers
from ..functions.text import token_estimate
from ..operators import money, scores
from ..operators.store import Store
from . import backend as backends
from .config import Model
from .tasks import prompt

OUTPUT_TOKENS = 512
RUBRIC = "rubric-1"


def tasks(samples: DataFrame, judge: Model, target: Model) -> DataFrame:
    """Judge tasks from samples with an output; self_judge tells whether a model grades itself."""
    source = F.get_json_object("payload", "$.source")
    own = samples.withColumns(
        {
            "judge_model_id": F.lit(judge.model_id), "judge_routing_config_hash": F.lit(judge.routing_config_hash), "target_model_id": F.lit(target.model_id), "api_provider": F.lit("openrouter"),
            "summary_hash": keys.text_hash(F.col("output_text")), "judge_prompt_version": F.lit("judge-1"), "rubric_version": F.lit(RUBRIC),
            "system_prompt": prompt("judge", F.lit("en"), 0), "user_prompt": prompt("judge", F.lit("en"), 1, source=source, candidate=F.col("output_text")),
            "temperature": F.lit(0.0), "top_p": F.lit(1.0), "max_output_tokens": F.lit(OUTPUT_TOKENS), "structured_output_schema_version": F.lit("so-judge-1"),
        }
    )
    own = own.withColumns({f"{p}_prompt_hash": keys.text_hash(F.col(f"{p}_prompt")) for p in ("system", "user")})
    keyed = keys.judge_key(own)
    return keyed.withColumns({"benchmark": F.lit("judge"), "model_id": F.col("judge_model_id"), "self_judge": F.lit(judge.model_id == target.model_id), "cases": F.lit(1), "est_input_tokens": token_estimate(F.col("user_prompt"), overhead=8)})


def run(tasks_: DataFrame, store: Store, backend: backends.Backend, run_id: str) -> DataFrame:
    """Grades what is not graded yet, and returns the grades of all these tasks with their dimensions, null where a reply could not be read."""
    done = store.rows("judge_results").where("status = 'SUCCESS'").select("cache_key")
    pending = tasks_.join(done, "cache_key", "left_anti")
    replies = backends.infer(pending, backend, run_id)
    graded = replies.withColumn("g", parsers.judgement(F.col("output_text")))
    status = F.when((F.col("status") == "SUCCESS") & F.col("g").isNull(), "PARSE_ERROR").otherwise(F.col("status"))
    store.append("judge_results", graded.withColumns({"status": status, "scores_json": F.to_json("g"), "judge_model": F.col("judge_model_id"), "target_model": F.col("target_model_id")}))
    held = store.rows("judge_results").join(tasks_.select("cache_key"), "cache_key", "left_semi")
    g = F.from_json("scores_json", ", ".join(f"{d} int" for d in parsers.DIMENSIONS) + ", rationale string")
    return held.select("cache_key", "sample_id", "language", "status", "self_judge", g.alias("g")).select("cache_key", "sample_id", "language", "status", "self_judge", *[f"g.{d}" for d in parsers.DIMENSIONS])


def outcome(samples: DataFrame, judge: Model, target: Model, store: Store, backend: backends.Backend, run_id: str, profile: str) -> dict:
    """Grades samples with an output and tells how it went: the judge's block of a summary.

    Means are over readable grades; a reply that can't be read counts as
    invalid, one that failed as neither. Grades are advice: no metric is made of them.
    """
    own = judge.model_id == target.model_id
    held = {"enabled": True, "profile": profile, "judge_model": judge.model_id, "target_model": target.model_id, "self_judge": own, "warnings": [], "scores": {}, "invalid_outputs": 0, "judge_cost_usd": 0.0}
    if own:
        held["warnings"].append(f"SELF_JUDGE_WARNING: {judge.model_id} grades its own output")
    made = tasks(samples, judge, target).persist()
    wanted = made.count()
    known = made.join(store.rows("judge_results").where("status = 'SUCCESS'"), "cache_key", "left_semi").count()
    held |= {"requested_samples": wanted, "cache_hits": known, "api_calls": wanted - known, "status": "COMPLETED" if wanted else "NO_SUMMARIES"}
    if wanted:
        rows = run(made, store, backend, run_id)
        got = scores.judge(rows.where("status = 'SUCCESS'"), parsers.DIMENSIONS).first().asDict()
        held["scores"] = {"judged_cases": got.pop("judged") - got.pop("invalid"), **got}
        held["invalid_outputs"] = rows.where("status = 'PARSE_ERROR'").count()
        held["judge_cost_usd"] = money.judge_cost(store.rows("judge_results"), target.model_id)
    made.unpersist()
    return held
