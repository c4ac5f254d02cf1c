import json

from pyspark.sql import functions as F

from marlstone import cli
from marlstone.operators.store import Store
from marlstone.plans import config, judge
from marlstone.plans.backend import Stub
from marlstone.reports import summary


def samples(spark):
    payload = json.dumps({"source": "A long source."})
    rows = [(f"s{i}", "en", f"h{i}", f"r{i}", payload, f"Summary {i}.") for i in range(4)]
    return spark.createDataFrame(rows, "sample_id string, language string, source_hash string, reference_hash string, payload string, output_text string")


def test_judging_twice_asks_once(spark, tmp_path):
    store, model = Store(spark, str(tmp_path)), config.Model("v/judge")
    tasks = judge.tasks(samples(spark), model, model)
    assert tasks.select("self_judge").distinct().first()[0] and tasks.select("cache_key").distinct().count() == 4
    first = judge.run(tasks, store, Stub(), "r").orderBy("sample_id").collect()
    n = store.all_rows("judge_results").count()
    again = judge.run(tasks, store, Stub(), "r").orderBy("sample_id").collect()
    assert first == again and n == store.all_rows("judge_results").count() == 4
    assert all(1 <= r["overall_quality"] <= 5 for r in first)


def test_summary_file(spark):
    local = config.Model("local/x", api_provider="local")
    cls = spark.createDataFrame([("en", 2, 0.5), ("overall", 2, 0.5)], "language string, cases int, accuracy double")
    got = summary.build(local, "r", "COMPLETED", "text", {"classification": cls}, {"judge_cost": 1.0, "reconciliation": {}, "pricing_snapshot": {}}, {}, "now", _private=1)
    assert got["cost"] == {"judge_cost": None, "pricing_snapshot": {}} and "_private" not in got
    assert got["metrics"]["classification"]["overall"]["accuracy"] == 0.5
    assert summary.file_name(local, "text") == "local__x/summary.json" and summary.file_name(local, "json_schema") == "local__x/summary.classification-json_schema.json"
    assert json.loads(summary.as_text(got)) == got
    assert summary.shortened(spark.range(1).select(F.sha2(F.lit("a"), 256).alias("h")), "h").first()[0] == "ca978112ca1b"


def test_cli(capsys, spark):
    assert cli.main(["version"]) == 0 and cli.main(["queries"]) == 0
    assert "q_cls_scorecard" in capsys.readouterr().out


def test_commands_from_raw_data_to_a_summary(spark, tmp_path, capsys):
    import gzip

    for lang in ("en", "ko"):
        with gzip.open(tmp_path / f"{lang}.json.gz", "wt") as f:
            for i in range(24):
                f.write(json.dumps({"id": str(i), "text": f"say {lang} {i}", "label_text": f"intent{i % 3}"}) + "\n")
    listing = {"data": [{"id": "v/m", "name": "M", "pricing": {"prompt": "0.000001", "completion": "0.000002"}, "context_length": 8000, "supported_parameters": ["temperature"]}]}
    (tmp_path / "listing.json").write_text(json.dumps(listing))
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "a.json").write_text(json.dumps({"settings": {"batch_size": 4, "max_attempts": 1}, "defaults": {"vendor": "v"}, "models": [{"model_id": "v/m", "input_per_million": 1.0, "output_per_million": 2.5, "supported_parameters": ["temperature", "seed"]}, {"model_id": "v/off", "enabled": False}]}))
    (tmp_path / "conf" / "b.json").write_text(json.dumps({"store": str(tmp_path / "store"), "results": str(tmp_path / "out"), "raw": {"massive": {x: str(tmp_path / f"{x}.json.gz") for x in ("en", "ko")}}, "manifests": {"classification": str(tmp_path / "c.jsonl")}, "wanted": {"classification": 12}}))
    conf = str(tmp_path / "conf")

    def said(*argv):
        capsys.readouterr()
        assert cli.main(list(argv)) == 0
        return capsys.readouterr().out

    assert "classification: written, 24 records" in said("prepare", conf, "--only", "classification") and "classification: kept, 24" in said("prepare", conf)
    assert "v/m" in (shown := said("models", conf, "--check", str(tmp_path / "listing.json"))) and "[seed]" in shown and "v/off" not in shown
    assert "v/m" in said("pricing", conf, str(tmp_path / "listing.json"), "--save") and Store(spark, str(tmp_path / "store")).rows("pricing_snapshots").count() == 1
    assert "classification" in said("estimate", conf)
    assert json.loads(said("run", conf, "--model", "v/m", "--dry-run").strip().splitlines()[-1])["pending"] == {"classification": 6}
    assert json.loads(said("run", conf, "--model", "v/m", "--run-id", "one").strip().splitlines()[-1])["status"] == "COMPLETED"
    assert json.loads(said("run", conf, "--model", "v/m", "--dry-run").strip().splitlines()[-1])["pending"] == {"classification": 0}
    made = json.loads(next((tmp_path / "out").glob("*/summary*.json")).read_text())
    assert made["run_id"] == "one" and made["metrics"]["classification"]["overall"]["cases"] == 24 and made["usage"]["requests"] == 6
    assert Store(spark, str(tmp_path / "store")).one("runs", run_id="one")["status"] == "COMPLETED"
    assert "RESULT.md" in said("report", str(tmp_path / "out"), str(tmp_path / "reports"))
