"""A run with a judge, benchmarks that don't apply, and one append a run."""

import json

import pytest

from marlstone.operators import money
from marlstone.operators.store import Store
from marlstone.plans import commands, config, judge, pipeline
from marlstone.plans.backend import Stub
from marlstone.sources import manifest

from .test_plans import cases


@pytest.fixture
def tree(spark, tmp_path):
    def frozen(name, benchmark, payload, label):
        rows = [(benchmark, "en", "test", "r", f"{benchmark}:{i}", f"h{i}", f"g{i}", json.dumps(payload(i)), label(i), i) for i in range(5)]
        own = spark.createDataFrame(rows, "benchmark string, language string, split string, dataset_revision string, sample_id string, source_hash string, reference_hash string, payload string, label string, ordinal bigint")
        manifest.write(own, str(tmp_path / name), version="1", repo=name, revision="r", split="test", seed=1)
        return str(tmp_path / name)

    body = "Roads in Springfield will be rebuilt. Work starts on 3 May 2021. "
    return {
        "settings": {"max_attempts": 1}, "store": str(tmp_path / "store"),
        "models": [{"model_id": "v/m"}, {"model_id": "v/d", "decisions": True}, {"model_id": "local/x", "api_provider": "local"}, {"model_id": "v/j", "role": "judge", "enabled": False}],
        "judges": {"other": {"model_id": "v/j", "samples": 3}, "own": {"model_id": "v/m", "languages": ["ko"]}},
        "manifests": {
            "summarization": frozen("s.jsonl", "summarization", lambda i: {"source": body + str(i), "reference": body, "source_tokens_est": 20}, lambda i: None),
            "hallucination_en": frozen("h.jsonl", "hallucination", lambda i: {"source": body, "candidate_summary": f"c{i}"}, lambda i: ("SUPPORTED", "HALLUCINATED")[i % 2]),
        },
    }


def test_a_judged_run(spark, tree):
    with pytest.raises(config.ConfigError, match="no judge"):
        commands.run(spark, tree, "v/m", "r", judge="nobody")
    store = Store(spark, tree["store"])
    assert store.rows("inference_results").count() == 0  # refused before anything was asked
    got = commands.run(spark, tree, "v/m", "r", judge="other")
    block = got["judge"]
    assert block["status"] == "COMPLETED" and (block["requested_samples"], block["api_calls"], block["cache_hits"]) == (3, 3, 0) and not block["self_judge"]
    assert block["scores"]["judged_cases"] == 3 and 1 <= block["scores"]["overall_quality"] <= 5 and block["judge_cost_usd"] > 0
    assert got["cost"]["judge_cost"] == block["judge_cost_usd"] == store.one("runs", run_id="r")["judge_cost_usd"]
    again = commands.run(spark, tree, "v/m", "r2", judge="other")["judge"]
    assert (again["api_calls"], again["cache_hits"]) == (0, 3) and again["scores"] == block["scores"]
    none = commands.run(spark, tree, "v/m", "r3", judge="own")["judge"]
    assert none["status"] == "NO_SUMMARIES" and none["self_judge"] and none["warnings"][0].startswith("SELF_JUDGE_WARNING")
    assert money.judge_cost(store.rows("judge_results"), "nobody") == 0.0


class Unreadable(Stub):
    def respond(self, task):
        return self._message(task, 1, "fine" if task["benchmark"] == "judge" else "A summary.")


def test_grades_that_cannot_be_read(spark, tree):
    block = commands.run(spark, tree, "v/m", "r", Unreadable(), judge="other")["judge"]
    assert block["invalid_outputs"] == 3 and block["scores"]["judged_cases"] == 0 and block["scores"]["overall_quality"] is None
    assert judge.OUTPUT_TOKENS == 512


def test_benchmarks_that_do_not_apply(spark, tree):
    got = commands.run(spark, tree, "v/d", "r")
    assert set(got["metrics"]) == {"hallucination"} and list(got["skipped"]) == ["summarization"]
    assert got["metrics"]["hallucination"]["per_language"]["en"]["invalid_outputs"] == 0
    with pytest.raises(config.ConfigError, match="only classify"):
        commands.run(spark, tree, "local/x", "r", benchmark="summarization")


def test_a_run_of_many_waves_appends_once(spark, tmp_path, monkeypatch):
    store, model, done = Store(spark, str(tmp_path)), config.Model("v/m"), []
    real = store.append
    monkeypatch.setattr(store, "append", lambda name, rows: (done.append(name), real(name, rows))[1])
    got = pipeline.execute(pipeline.plan(cases(spark, 45, model), store, model), store, Stub(), "r", config.Settings(max_attempts=1))
    assert got.asked == 45 and done == ["inference_results", "inference_attempts"]
    assert store.rows("inference_results").count() == store.rows("inference_attempts").count() == 45


def test_last_http_status(spark):
    rows = [("a", 1, 500), ("a", 2, 0), ("a", 3, None), ("b", 1, None), ("b", 2, 0), ("c", 2, 200), ("c", 1, 429)]
    own = spark.createDataFrame(rows, "k string, attempt_no int, http_status int")
    assert {r["k"]: r["http_status"] for r in money.last_http_status(own, "k", ["attempt_no"]).collect()} == {"a": 500, "b": None, "c": 200}
