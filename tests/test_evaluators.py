"""Evaluators and their cache: what is stored is never computed again, and a changed setting asks for its own values alone."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import keys
from marlstone.operators.store import Store
from marlstone.plans import evaluators as ev

ROWS = [
    ("k1", "The cat sat on the mat.", "A cat sat on the mat for 3 days.", "The cat sat.", "m", "summarization", "en"),
    ("k2", "It rained 12% more.", "It rained 12% more in May.", "Rain.", "m", "summarization", "en"),
    ("k2", "It rained 12% more.", "It rained 12% more in May.", "Rain.", "m", "summarization", "en"),
    ("k3", None, "Some source.", "Some reference.", "m", "summarization", "ko"),
    ("k4", "", None, None, "m", "summarization", None),
]
SHAPE = "cache_key string, output_text string, source string, reference string, model_id string, benchmark string, language string"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, SHAPE)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def counting(spark, name="counted", version="1", **settings):
    """An evaluator that tells on an accumulator how often it ran."""
    calls = spark.sparkContext.accumulator(0)

    def score(against, output, weight=1):
        @F.udf("struct<n:bigint>")
        def run(a, b):
            calls.add(1)
            return (weight * (len(a) + len(b)),)

        return run(against, output)

    return ev.Evaluator(name, version, score, "struct<n:bigint>", settings=settings), calls


def test_a_second_run_computes_nothing(spark, rows, store):
    e, calls = counting(spark)
    first = ev.score(rows, store, [e])
    got = {(r["cache_key"], r["output_text"]): r["counted"]["n"] for r in first.rows.collect()}
    assert got == {(k, o): len(o or "") + len(r or "") for k, o, _, r, *_ in ROWS}
    assert first.rows.count() == len(ROWS) and (first.hits["counted"], first.computed["counted"], calls.value) == (0, 4, 4)
    second = ev.score(rows, Store(spark, store.path), [e])
    assert sorted(map(tuple, second.rows.collect()), key=str) == sorted(map(tuple, first.rows.collect()), key=str)
    assert (second.hits["counted"], second.computed["counted"], calls.value) == (5, 0, 4)


def test_a_changed_setting_or_version_computes_its_own_column_alone(spark, rows, store):
    e, calls = counting(spark)
    other, more = counting(spark, "other")
    ev.score(rows, store, [e, other])
    assert (calls.value, more.value) == (4, 4)
    heavy = e.changed(weight=2)
    got = ev.score(rows, store, [heavy, other])
    assert (got.computed, got.hits, calls.value, more.value) == ({"counted": 4, "other": 0}, {"counted": 0, "other": 5}, 8, 4)
    assert {r["counted"]["n"] for r in got.rows.where("cache_key = 'k2'").collect()} == {2 * len("It rained 12% more.Rain.")}
    newer = ev.Evaluator(e.name, "2", e.score, e.shape)
    assert ev.score(rows, store, [newer, heavy]).computed == {"counted": 0} and calls.value == 12  # the last of one name is told
    assert ev.score(rows, store, [e]).computed == {"counted": 0}


def test_a_changed_output_or_reference_is_not_read_from_the_cache(spark, rows, store):
    e, calls = counting(spark)
    ev.score(rows, store, [e])
    other = rows.withColumn("output_text", F.when(F.col("cache_key") == "k1", "new").otherwise(F.col("output_text"))).withColumn("reference", F.when(F.col("cache_key") == "k3", "new").otherwise(F.col("reference")))
    assert ev.score(other, store, [e]).computed["counted"] == 2 and calls.value == 6
    assert ev.score(rows.withColumn("model_id", F.lit("another")), store, [e]).computed["counted"] == 0


def test_keys_are_those_of_canonical_json(spark, rows):
    e = ev.Evaluator("rouge", "1", None, "", settings={"b": 1.0, "a": [1, "x"]})
    row = ev.keyed(rows.where("cache_key = 'k1'"), e).first()
    sha = lambda s: __import__("hashlib").sha256(s.encode()).hexdigest()
    identity = sha(json.dumps({"inference_cache_key": "k1", "output_hash": sha(ROWS[0][1])}, separators=(",", ":")))
    assert e.settings_hash() == sha('{"a":[1,"x"],"b":1}') == ev.Evaluator("rouge", "1", None, "", settings={"a": [1.0, "x"], "b": 1}).settings_hash()
    facts = {"key_schema_version": keys.KEY_SCHEMA, "inference_result_hash": identity, "evaluator": "rouge", "evaluator_version": "1", "evaluator_config_hash": e.settings_hash(), "reference_hash": sha(ROWS[0][3]), "scope": "sample"}
    assert row["metric_cache_key"] == sha(json.dumps(facts, sort_keys=True, separators=(",", ":")))


def test_standard_evaluators_and_reasons(spark, rows, store):
    registry = ev.standard()
    got = ev.score(rows, store, registry.chosen())
    assert got.reasons == {"bertscore": "BERTScore needs a model's weights, and none are at hand"} and got.computed["rouge"] == 4
    by = {r["cache_key"]: r for r in got.rows.collect()}
    assert by["k1"]["rouge"]["rouge1_f"] == pytest.approx(2 * 3 / 9) and by["k3"]["chrf"]["chrf"] == 0.0 and by["k1"]["bertscore"] is None
    assert by["k2"]["surface_facts"]["percentage_supported"] == 1 and by["k2"]["length"]["output_chars"] == len("It rained 12% more.")
    again = ev.score(rows, store, registry.chosen(["rouge", "surface_facts"]))
    assert again.computed == {"rouge": 0, "surface_facts": 0} and [r["rouge"] for r in again.rows.orderBy("cache_key").collect()] == [r["rouge"] for r in got.rows.orderBy("cache_key").collect()]


def test_registry(spark):
    registry = ev.standard()
    with pytest.raises(ValueError, match="already"):
        registry.add(ev.Evaluator("rouge", "9", None, ""))
    with pytest.raises(KeyError, match="no evaluator"):
        registry["bleu"]


def test_empty_rows(spark, rows, store):
    e, calls = counting(spark)
    got = ev.score(rows.limit(0), store, [e])
    assert got.rows.count() == 0 and got.computed == {"counted": 0} and calls.value == 0
