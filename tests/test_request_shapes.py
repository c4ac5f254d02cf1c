"""Requests in the shape of each mode, their replies, and the grammar of a label set."""

import itertools
import json
import re

import pytest
from pyspark.sql import functions as F

from marlstone.functions import keys
from marlstone.operators import responses, scores
from marlstone.operators.store import Store
from marlstone.plans import config, pipeline, tasks
from marlstone.plans.backend import Stub

LABELS = ["alarm_query", "alarm_set", "al", "play_music"]
MODELS = {
    "text": config.Model("v/m"),
    "json_schema": config.Model("v/m", structured_output=True),
    "decisions": config.Model("v/m", decisions=True),
    "local_constrained": config.Model("v/m", api_provider="local"),
}


@pytest.fixture(scope="module")
def records(spark):
    rows = [(n, lang, "r", "test", f"{lang}:{n}", f"h{n}", json.dumps({"text": f'say "{n}" {{x}}', "semantic_id": str(n)}), LABELS[n % 4]) for lang in ("en", "ko") for n in range(7)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    return spark.createDataFrame(rows, "ordinal bigint, language string, dataset_revision string, split string, sample_id string, source_hash string, payload string, label string")


@pytest.mark.parametrize("mode", MODELS)
def test_a_run_in_each_mode(spark, records, tmp_path, mode):
    settings, model = config.Settings(batch_size=3), MODELS[mode]
    made = tasks.classification(records, LABELS, model, settings)
    rows = made.collect()
    assert len(rows) == (14 if mode in tasks.SINGLE_MODES else 6) and len({r["cache_key"] for r in rows}) == len(rows)
    assert all(r["max_output_tokens"] == (16 if mode == "local_constrained" else 320) for r in rows)
    store = Store(spark, str(tmp_path / "s"))
    pipeline.execute(pipeline.plan(made, store, model), store, Stub(labels=4), "run", settings)
    assert pipeline.plan(made, store, model).pending.count() == 0
    scored = pipeline.score_classification(made, store.rows("inference_results"), records, LABELS, mode).collect()
    assert len(scored) == 14 and all(r["predicted"] in LABELS for r in scored)


def test_modes_have_keys_of_their_own(records):
    held = [{r["cache_key"] for r in tasks.classification(records, LABELS, m, config.Settings()).collect()} for m in MODELS.values()]
    assert all(not a & b for a, b in itertools.combinations(held, 2))
    fewer = {r["cache_key"] for r in tasks.classification(records, LABELS[:3], MODELS["decisions"], config.Settings()).collect()}
    assert not fewer & held[2]  # the options stand in no prompt, and still count


def test_typed_choices(spark, records):
    row = tasks.classification(records, LABELS, MODELS["decisions"], config.Settings()).where("sample_id = 'single:en:0'").first()
    asked = json.loads(row["request"])
    assert asked["state"] == {"utterance": 'say "0" {x}'} and row["user_prompt"] == 'say "0" {x}'
    assert asked["questions"]["answer"]["criteria"] == {x: x.replace("_", " ") for x in LABELS} and asked["questions"]["answer"]["type"] == "choice"
    payload = json.dumps({"source": "s", "candidate_summary": "c"})
    halu = spark.createDataFrame([(x, f"{x}1", "a", "b", "r", "t", payload) for x in ("en", "ko", "fr")], "language string, sample_id string, source_hash string, reference_hash string, dataset_revision string, split string, payload string")
    got = {r["language"]: json.loads(r["request"]) for r in tasks.hallucination(halu, MODELS["decisions"], config.Settings()).collect()}
    assert got["en"]["state"] == {"source_document": "s", "candidate_summary": "c"} and got["fr"]["questions"] == got["en"]["questions"]
    assert list(got["ko"]["questions"]["answer"]["criteria"]) == ["SUPPORTED", "HALLUCINATED"] and got["ko"]["questions"] != got["en"]["questions"]
    assert tasks.hallucination(halu, MODELS["text"], config.Settings()).where("request is not null").count() == 0


def test_replies_to_choices(spark):
    raw = ['{"answers": {"other": {"choice": "a"}}}', '{"answers": {"x": {"choice": "a"}, "y": {"choice": "b"}}}', '{"answers": {"x": 3}}', '{"choices": [{"message": {"content": "c"}, "finish_reason": "stop"}]}']
    rows = responses.normalized(spark.createDataFrame(list(enumerate(raw)), "i int, raw_response_json string")).orderBy("i").collect()
    assert [(r["output_text"], r["finish_reason"]) for r in rows] == [("a", "decision"), ("", "decision"), ("", "decision"), ("c", "stop")]


def test_a_short_json_reply_voids_its_batch(spark, records):
    made = tasks.classification(records, LABELS, MODELS["json_schema"], config.Settings(batch_size=3))
    said = F.when(F.col("sample_id") == "batch:en:0000", '{"answers": ["al"]}').otherwise('{"answers": ["al", "al", "nothing"]}')
    results = made.select("cache_key", F.lit("SUCCESS").alias("status"), said.alias("output_text"))
    rows = pipeline.score_classification(made, results, records, LABELS, "json_schema")
    got = {r["language"]: r for r in scores.classification(rows, "language").collect()}
    assert got["en"]["cases"] == 7 and rows.where("language = 'en' and predicted is not null").count() == 2 and rows.where("language = 'ko' and predicted is not null").count() == 4


def _taken(text):
    """All strings that a rule of quoted pieces, alternatives and brackets takes."""
    tokens = re.findall(r'"(?:[^"\\]|\\.)*"|[|()]', text)

    def either(k):
        out, (own, k) = set(), row(k)
        out |= own
        while k < len(tokens) and tokens[k] == "|":
            own, k = row(k + 1)
            out |= own
        return out, k

    def row(k):
        out = {""}
        while k < len(tokens) and tokens[k] not in "|)":
            own, k = either(k + 1) if tokens[k] == "(" else ({json.loads(tokens[k])}, k)
            k += tokens[k] == ")" if k < len(tokens) and tokens[k] == ")" else 1
            out = {a + b for a in out for b in own}
        return out, k

    return either(0)[0]


@pytest.mark.parametrize("labels", [LABELS, ["one"], ['a"b', "a\\c", "a"], ["", "x", "xy"], ["가나", "가다", "b"], [f"src{i}" for i in range(40)]])
def test_grammars_take_the_labels_and_nothing_else(spark, labels):
    merged = tasks.prefix_grammar(labels)
    assert merged.startswith("root ::= ") and _taken(merged[9:]) == set(labels)
    flat = spark.createDataFrame([(labels,)], "l array<string>").select(tasks.label_grammar(F.col("l"))).first()[0]
    assert _taken(flat[9:]) == set(labels)


def test_settings(records):
    with pytest.raises(ValueError, match="a label"):
        tasks.prefix_grammar([])
    with pytest.raises(config.ConfigError, match="prompt_style"):
        config.Model("v/m", prompt_style="other")
    state = tasks.classification(records, LABELS, config.Model("v/m", api_provider="local", prompt_style="state"), config.Settings()).first()
    assert "alarm" not in state["system_prompt"] and state["prompt_template_version"].endswith("state")


def test_batch_numbers_of_five_digits(spark, tmp_path):
    """The SQL writes them in four characters; task ids have all digits, and requests are whole."""
    import duckdb

    from marlstone import queries

    n = 20 * 10_000 + 1
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), (F.col("id") % 3).cast("string").alias("source"), F.concat(F.lit("t "), F.col("id")).alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    keep = "mode = 'text'"
    got = queries.q_request_shapes(spark, str(tmp_path)).where(keep).drop("mode").collect()
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(f"SELECT {', '.join(got[0].asDict())} FROM ({queries.ORACLES['q_request_shapes']}) WHERE {keep}").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 10_001
    made = tasks.classification(queries._plan(spark, str(tmp_path))[0], ["0", "1", "2"], MODELS["text"], config.Settings())
    assert made.select("task_id").distinct().count() == 10_001


def test_plans_read_their_requests_once(spark, records):
    """A plan's batches may be made beforehand; its tasks and keys are the same."""
    held = tasks.batched(records, config.Settings(batch_size=3)).cache()
    for mode in ("text", "json_schema"):
        plain, given = (tasks.classification(records, LABELS, MODELS[mode], config.Settings(batch_size=3), x).select("task_id", "cache_key", "user_prompt").collect() for x in (None, held))
        assert sorted(plain) == sorted(given) and len(plain) == 6


def test_keys_of_odd_values(spark):
    rows = [("a", 1.0, True, 3, None, '{"b": [1.0, 2.5], "a": null}'), ("é\u2028\"", float("nan"), None, None, "{}", None), ("", -0.0, False, 1, '"x"', '{"b":[1,2.5],"a":null}'), ("a", 0.30000000000000004, True, 0, "1", None), ("True", 1e300, True, 2**53, "null", "{}"), ("1", 2.0, False, 1, None, None)]
    df = spark.createDataFrame(rows, "sample_id string, temperature double, tools_enabled boolean, seed bigint, reasoning string, extra string")
    got = {r["sample_id"] + str(r["temperature"]): r["cache_key"] for r in keys.inference_key(df).collect()}
    for sample, temperature, tools, seed, reasoning, extra in rows:
        held = dict.fromkeys(keys.INFERENCE_FACTS) | {"key_schema_version": keys.KEY_SCHEMA, "sample_id": sample, "temperature": None if temperature != temperature else temperature, "tools_enabled": tools, "seed": seed}
        held |= {"reasoning": reasoning and json.loads(reasoning), "extra": json.loads(extra) if extra else {}}
        assert got[sample + str(temperature)] == keys.hash_of(held), sample
