import bz2
import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from marlstone.operators.store import Store
from marlstone.plans import config, pipeline, tasks
from marlstone.plans.backend import DryRunViolation, Stub, infer
from marlstone.reports import render, tables
from marlstone.sources import manifest, readers
from marlstone.streaming import replay

BODY = "The mayor said on 3 May 2021 that 12% of the roads in Springfield would be rebuilt. " * 8


@pytest.fixture
def raw(tmp_path):
    lines = "\n".join(json.dumps({"id": f"a{i}", "title": "t", "text": BODY + str(i), "summary": "Roads in Springfield will be rebuilt, the mayor said on Monday.", "url": "u"}) for i in range(6))
    with tarfile.open(tmp_path / "x.tar.bz2", "w:bz2") as tar:
        info = tarfile.TarInfo("english_test.jsonl")
        info.size = len(lines.encode())
        tar.addfile(info, io.BytesIO(lines.encode()))
    for lang in ("en", "ko"):
        with gzip.open(tmp_path / f"{lang}.json.gz", "wt") as f:
            for i in range(30):
                f.write(json.dumps({"id": str(i), "text": f"say {lang} {i}" if i else "", "label": f"l{i % 3}", "label_text": f"intent{i % 3}"}) + "\n")
    return tmp_path


def test_readers(spark, raw):
    got = readers.read_xlsum(spark, str(raw / "x.tar.bz2"), "en", "test")
    assert got.count() == 6 and got.where("source like '%Springfield%'").count() == 6
    with pytest.raises(Exception, match="no \\*_dev.jsonl"):
        readers.read_xlsum(spark, str(raw / "x.tar.bz2"), "en", "dev").collect()
    massive = readers.read_massive(spark, str(raw / "en.json.gz"), "en")
    assert massive.count() == 29 and massive.select("intent").distinct().count() == 3
    assert bz2  # the archive is bzip2


def test_halueval_ids_are_positions(spark, tmp_path):
    rows = [("d0", "r", "h"), ("", "r", "h"), ("d2", "r", "h")]
    spark.createDataFrame(rows, "document string, right_summary string, hallucinated_summary string").coalesce(1).write.parquet(str(tmp_path / "h"))
    assert sorted(r["id"] for r in readers.read_halueval(spark, str(tmp_path / "h")).collect()) == ["halueval-00000", "halueval-00002"]
    spark.range(1).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(readers.DatasetError, match="lacks"):
        readers.read_halueval(spark, str(tmp_path / "bad"))


def test_factuality(spark, tmp_path):
    def doc(kind, errors, text="고친 요약"):
        return {"original_text": "summary | 원문 " + "글 " * 30, "annotation": {"target": "machine_x", "type": "news", "original_summary": {"machine_x": {"text": "틀린 요약"}}, "corrected_summary": {f"corrected_{kind}": {"text": text, "correction_type": kind, "errors": errors}}}}

    (tmp_path / "Validation").mkdir()
    with zipfile.ZipFile(tmp_path / "Validation" / "a.zip", "w") as z:
        z.writestr("one.json", json.dumps(doc("type5", [{"sub": "10명", "correction": "20명"}])))
        z.writestr("sub/one.json", json.dumps(doc("type5", [{"sub": "가다", "correction": "가나다"}])))
        z.writestr("two.json", json.dumps(doc("type1", [])))
        z.writestr("bad.json", "{")
    (tmp_path / "Training").mkdir()
    (tmp_path / "Training" / "b.jsonl").write_text('{"ID": "g", "Document": "s", "summary": "w", "수정요약": "r", "error type": "type5; type1"}\nnot json\n{"source": "x"}\n')
    got = {r["id"]: r for r in readers.read_factuality(spark, str(tmp_path)).collect()}
    assert set(got) == {"Validation/one", "Validation/one#2", "Validation/two", "Training/g"}
    assert got["Validation/one"]["is_factual_error"] and not got["Validation/one"]["is_omission_only"] and got["Validation/one#2"]["is_omission_only"]
    assert not got["Validation/two"]["is_factual_error"] and got["Training/g"]["error_types"] == ["type5", "type1"]
    assert got["Validation/one"]["source"].startswith("원문")
    assert readers.read_factuality(spark, str(tmp_path), split="Training").count() == 1
    records, audit = pipeline.prepare_hallucination_ko(readers.read_factuality(spark, str(tmp_path)), 5, "r", "v", config.Settings())
    assert records.count() == 2 and audit.first()["dropped_omission_only"] == 1 and audit.first()["dropped_not_factual"] == 2


def test_json_records():
    assert readers.json_records('[{"a":1},2]') == [{"a": 1}]
    assert readers.json_records('﻿{"data":[{"a":1}]}') == [{"a": 1}]
    assert readers.json_records('{"a":1}\n{bad\n{"a":2}') == [{"a": 1}, {"a": 2}]


def test_manifest_round_trip_and_tampering(spark, raw, tmp_path):
    records = pipeline.prepare_summarization(readers.read_xlsum(spark, str(raw / "x.tar.bz2"), "en", "test"), 4, "r1", "test", config.Settings())
    path = str(tmp_path / "m.jsonl")
    meta = manifest.write(records, path, version="1", repo="x", revision="r1", split="test", seed=1)
    assert meta["counts"] == {"en": 4, "total": 4} and manifest.read(spark, path).count() == 4
    again = manifest.write(records.repartition(3), str(tmp_path / "n.jsonl"), version="1", repo="x", revision="r1", split="test", seed=1)
    assert again["manifest_hash"] == meta["manifest_hash"]
    assert manifest.read_all(spark, {"a": path, "b": str(tmp_path / "none")})["b"] is None
    part = next((tmp_path / "m.jsonl").glob("part-*"))
    part.write_text(part.read_text().replace("Springfield", "Shelbyville", 1))
    for crc in (tmp_path / "m.jsonl").glob(".part-*"):
        crc.unlink()
    with pytest.raises(manifest.ManifestError, match="changed"):
        manifest.read(spark, path)


def test_second_run_has_nothing_to_do(spark, raw, tmp_path):
    settings = config.Settings(batch_size=5)
    model = config.Model("v/m", input_per_million=1.0, output_per_million=1.0)
    en, ko = (readers.read_massive(spark, str(raw / f"{x}.json.gz"), x) for x in ("en", "ko"))
    frozen = pipeline.prepare_classification(en, ko, 12, "r", "test", settings)
    path = str(tmp_path / "c.jsonl")
    manifest.write(frozen, path, version="1", repo="x", revision="r", split="test", seed=1)
    records = manifest.read(spark, path)
    labels = sorted(r[0] for r in records.select("label").distinct().collect())
    made = tasks.classification(records, labels, model, settings)
    assert made.count() == 6 and made.agg(F.sum("cases")).first()[0] == 24
    store = Store(spark, str(tmp_path / "store"))
    first = pipeline.plan(made, store, model)
    assert first.pending.count() == 6
    pipeline.execute(first, store, Stub(labels=3), "run1", settings)
    second = pipeline.plan(made, store, model)
    assert second.pending.count() == 0
    rows = pipeline.score_classification(made, store.rows("inference_results"), records, labels)
    got = pipeline.aggregate(classes=rows)
    assert {r["language"]: r["cases"] for r in got["classification"].collect()} == {"en": 12, "ko": 12, "overall": 24}
    assert got["cross_lingual"].first()["paired_cases"] == 12
    cost = pipeline.cost_report(second, store, model, settings).first()
    assert cost["matches_within_tolerance"] and cost["estimated_cache_savings"] == pytest.approx(cost["total_cost"])
    with pytest.raises(DryRunViolation):
        infer(made, Stub(), "r", dry_run=True)


def test_summaries_are_scored(spark, raw, tmp_path):
    settings, model = config.Settings(), config.Model("v/m")
    records = pipeline.prepare_summarization(readers.read_xlsum(spark, str(raw / "x.tar.bz2"), "en", "test"), 4, "r1", "test", settings).withColumn("payload", F.to_json("payload"))
    store = Store(spark, str(tmp_path / "store"))
    pipeline.execute(pipeline.plan(tasks.summarization(records, model, settings), store, model), store, Stub(), "run", settings)
    rows = pipeline.score_summarization(records, store.rows("inference_results"))
    got = pipeline.aggregate(summaries=rows)
    assert got["summarization"].first()["scored_cases"] == 4 and got["surface_facts"].first()["facts_total"] >= 0
    assert pipeline.judgeable(records, store.rows("inference_results"), 2).count() <= 2


def test_config():
    assert config.with_defaults({"defaults": {"a": {"x": 1, "y": 2}}, "models": [{"a": {"y": 3}}]})["models"] == [{"a": {"x": 1, "y": 3}}]
    with pytest.raises(config.ConfigError):
        config.known(config.Settings, {"nonsense": 1})
    with pytest.raises(config.ConfigError):
        config.Model("noslash")
    assert config.slug("a/b") == "a__b"


def _summary(model, accuracy, mode="text", **more):
    cls = {"per_language": {"en": {"cases": 2, "accuracy": accuracy, "macro_f1": 0.5, "invalid_output_rate": 0.0}}, "overall": {"cases": 2, "accuracy": accuracy}}
    return {"model": {"model_id": model, "display_name": model.upper()}, "variant": {"classification_mode": mode}, "generated_at": "2024-01-01", "metrics": {"classification": cls, "hallucination": {"per_language": {"ko": {"status": "SKIPPED"}}}}, "usage": {"prompt_tokens": 5}, "reproducibility": {"manifests": {"hallucination:en": {"hash": "h1"}}}} | more


def test_reports(spark, tmp_path):
    for k, s in enumerate([_summary("v/a", 0.5), _summary("v/b", 0.9), _summary("v/b", 0.95, "json_schema"), _summary("v/c", None)]):
        (tmp_path / f"m{k}").mkdir()
        (tmp_path / f"m{k}" / f"summary{k}.json").write_text(json.dumps(s))
    (tmp_path / "m0" / "summary_bad.json").write_text("{")
    found = tables.read_summaries(spark, str(tmp_path))
    made = tables.build(found)
    assert list(made) == tables.TABLES
    board = made["Leaderboard"]
    assert [r["model"] for r in board.collect()] == ["v/b", "v/a", "v/c"] and len(board.columns) >= 37
    assert made["ClassificationModes"].first()["accuracy_delta"] == pytest.approx(0.05)
    assert made["Hallucination"].first()["status"] == "SKIPPED" and made["Judge"].count() == 0
    assert made["Runs"].first()["halueval_manifest"] == "h1"
    a, b = render.render(found), render.render(found)
    assert a == b and render.ABSENT in a["RESULT.md"] and "<table>" in a["report.html"]


def test_streaming_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_id"), F.when(F.col("event_type") == "error", "RATE_LIMIT").otherwise("SUCCESS").alias("status"), F.col("value").alias("usage_cost"))
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = replay.attempts(spark, str(tmp_path / "log"), "event_id bigint, ts timestamp, model_id string, status string, usage_cost double")
    got = replay.run_to_end(replay.windowed_costs(stream, "1 day"), "windowed", "complete")
    assert got.agg(F.sum("attempts")).first()[0] == rows.count()
    state = replay.run_to_end(replay.failure_guard(stream.withColumn("ok", F.col("status") == "SUCCESS"), consecutive=3), "guard", "update")
    from marlstone.operators.money import failure_guard

    want = {r["model_id"]: (r["attempts"], r["failures"], r["tripped_at"]) for r in failure_guard(rows.withColumn("ok", F.col("status") == "SUCCESS"), "model_id", ["ts", "event_id"], consecutive=3).collect()}
    assert {r["model_id"]: (r["attempts"], r["failures"], r["tripped_at"]) for r in state.collect()} == want


class Counting:
    """Fails as told by the case's number in order of task; notes each call in a folder that all workers see."""

    def __init__(self, folder, bad, code=400, cost=0.01, heals_after=0):
        self.folder, self.bad, self.code, self.cost, self.heals_after = str(folder), bad, code, cost, heals_after

    def pause(self, seconds):
        assert 0 <= seconds <= 31

    def respond(self, task):
        import os
        import pathlib
        import uuid

        n = int(task["user_prompt"])
        name = pathlib.Path(self.folder) / f"{n:04d}-{uuid.uuid4().hex}"
        tries = len([x for x in os.listdir(self.folder) if x.startswith(f"{n:04d}-")])
        name.write_text("")
        if n in self.bad and not (self.heals_after and tries >= self.heals_after):
            return {"error": {"code": self.code, "message": "told to fail"}}
        return {"choices": [{"message": {"content": "x"}}], "usage": {"prompt_tokens": 1, "completion_tokens": 1, "cost": self.cost}}


def cases(spark, n, model):
    rows = spark.range(n).select(
        F.format_string("t%04d", "id").alias("task_id"), F.format_string("key%04d", "id").alias("cache_key"), F.col("id").cast("string").alias("user_prompt"), F.lit(model.model_id).alias("model_id"),
        F.lit("summarization").alias("benchmark"), F.lit("en").alias("language"), F.lit(1).cast("bigint").alias("cases"), F.lit(1000).cast("bigint").alias("est_input_tokens"), F.lit(0).cast("bigint").alias("est_output_tokens"),
    )
    return rows.withColumn("sample_id", F.col("task_id"))


def called(folder):
    return sorted(int(x.name[:4]) for x in folder.iterdir())


@pytest.mark.parametrize(("bad", "want", "reason"), [(range(12, 99), range(17), "consecutive"), ({k for k in range(99) if k % 4}, range(20), "rate"), (range(0), range(30), None)])
def test_nothing_is_asked_after_a_guard_trips(spark, tmp_path, bad, want, reason):
    settings, model = config.Settings(max_consecutive_failures=5, max_failure_rate=0.5, attempts_before_rate=20, max_attempts=1), config.Model("v/m")
    if reason == "rate":
        settings = config.Settings(max_consecutive_failures=50, max_failure_rate=0.5, attempts_before_rate=20, max_attempts=1)
    (tmp_path / "calls").mkdir()
    store = Store(spark, str(tmp_path / "store"))
    got = pipeline.execute(pipeline.plan(cases(spark, 30, model), store, model), store, Counting(tmp_path / "calls", set(bad)), "r", settings)
    assert called(tmp_path / "calls") == list(want) and (got.reason, got.asked) == (reason, len(want))
    assert store.rows("inference_results").count() == store.rows("inference_attempts").count() == len(want)


def test_the_budget_stops_before_a_request(spark, tmp_path):
    settings, model = config.Settings(budget_usd=0.05, stop_margin=1.0), config.Model("v/m", input_per_million=10.0, output_per_million=0.0)
    (tmp_path / "calls").mkdir()
    store = Store(spark, str(tmp_path / "store"))
    plan = pipeline.plan(cases(spark, 30, model), store, model)
    got = pipeline.execute(plan, store, Counting(tmp_path / "calls", set(), cost=0.01), "r", settings)
    assert called(tmp_path / "calls") == list(range(5)) and got.reason == "budget" and got.spent == pytest.approx(0.05)
    more = pipeline.execute(pipeline.plan(cases(spark, 30, model), store, model), store, Counting(tmp_path / "calls", set(), cost=0.01), "s", settings)
    assert called(tmp_path / "calls") == list(range(10)) and more.asked == 5


def test_failures_are_tried_again_and_every_attempt_is_kept(spark, tmp_path):
    settings, model = config.Settings(max_attempts=4, initial_backoff=0.0, backoff_jitter=0.0), config.Model("v/m")
    (tmp_path / "calls").mkdir()
    store = Store(spark, str(tmp_path / "store"))
    got = pipeline.execute(pipeline.plan(cases(spark, 6, model), store, model), store, Counting(tmp_path / "calls", {2, 3}, code=503, heals_after=2), "r", settings)
    assert got.failures == 0 and called(tmp_path / "calls") == [0, 1, 2, 2, 2, 3, 3, 3, 4, 5]
    attempts = {(r["cache_key"], r["attempt_no"]): r["status"] for r in store.rows("inference_attempts").collect()}
    assert len(attempts) == 10 and attempts["key0002", 1] == "OPENROUTER_ERROR" and attempts["key0002", 3] == "SUCCESS"
    assert {r["cache_key"]: r["attempts"] for r in store.rows("inference_results").where("status = 'SUCCESS'").collect()}["key0003"] == 3


def test_replies_of_a_lost_run_are_settled(spark, tmp_path):
    from marlstone.plans import backend

    settings, model = config.Settings(max_attempts=1), config.Model("v/m")
    (tmp_path / "calls").mkdir()
    store = Store(spark, str(tmp_path / "store"))
    tasks_ = cases(spark, 8, model)
    store.stage("lost-000000000", backend.ask(tasks_.where("task_id < 't0005'"), Counting(tmp_path / "calls", set()), "lost"))
    plan = pipeline.plan(tasks_, store, model)
    assert plan.pending.count() == 3 and store.settle() == 0 and store.rows("inference_attempts").count() == 5
    pipeline.execute(plan, store, Counting(tmp_path / "calls", set()), "r", settings)
    assert called(tmp_path / "calls") == list(range(8))
    assert store.result("key0001")["run_id"] == "lost" and store.result("nothing") is None and store.one("runs", run_id="r") is None
    assert store.listed("inference_results", run_id=["r"], benchmark=None).count() == 3


def test_a_rewrite_cut_short_loses_nothing(spark, tmp_path):
    import shutil

    store = Store(spark, str(tmp_path / "store"))
    store.append("runs", spark.createDataFrame([("r1", "m"), ("r1", "n"), ("r2", "o")], "run_id string, model_id string"))
    shutil.copytree(tmp_path / "store" / "runs", tmp_path / "store" / "runs.old")
    shutil.rmtree(tmp_path / "store" / "runs")
    store.repair("runs")
    assert store.all_rows("runs").count() == 3
    store.compact("runs")
    store.repair("runs")
    assert store.all_rows("runs").count() == 2 and not (tmp_path / "store" / "runs.old").exists() and not (tmp_path / "store" / "runs.new").exists()


def test_aliases_and_labels(spark, tmp_path):
    rows = [
        {"doc_id": "d", "sample_id": "s", "passage": "p", "summary": "w", "gold_summary": "r", "label": ["type5", " type1 "]},
        {"문서번호": 7, "본문": "p", "오류요약": "w", "교정요약": "r"},
        {"Sample ID": "x", "text": "t", "article": "a", "wrong_summary": "w", "수정문": "r", "errorType": "type5"},
        {"id": "y", "source": "", "document": "d", "summary": "w", "fixed_summary": "r"},
    ]
    (tmp_path / "a.json").write_text(json.dumps(rows, ensure_ascii=False))
    made = {"original_text": "원문", "annotation": {"target": "h", "original_summary": {"h": {"text": "w"}}, "corrected_summary": {"corrected_type5": {"text": "a"}, "corrected_type1": {"text": "b"}, "corrected_all": {"text": "both"}}}}
    (tmp_path / "b.json").write_text(json.dumps(made, ensure_ascii=False))
    got = {r["id"]: r for r in readers.read_factuality(spark, str(tmp_path)).collect()}
    assert set(got) == {"s", "7", "x", "b-000000"}
    assert (got["s"]["source"], got["s"]["error_types"]) == ("p", ["type5", "type1"]) and got["x"]["source"] == "t" and got["x"]["is_factual_error"]
    assert got["b-000000"]["corrected_summary"] == "both" and got["b-000000"]["summary_kind"] == "human"
    assert got["b-000000"]["correction_labels"] == [readers.ERROR_TYPES["type1"], readers.ERROR_TYPES["type5"]]
