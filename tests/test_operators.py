import pytest
from pyspark.sql import functions as F

from marlstone.operators import filters, money, responses, sampling, scores
from marlstone.operators.store import SCHEMAS, Store


def test_samples_do_not_depend_on_order(spark):
    rows = spark.range(500).withColumn("g", F.col("id") % 7)
    a = sampling.take_top(rows, 5, "id", ["g"]).collect()
    b = sampling.take_top(rows.repartition(9).orderBy(F.rand(3)), 5, "id", ["g"]).collect()
    assert sorted(a) == sorted(b) and len(a) == 35
    assert sorted(sampling.take_top(rows, 5, "id", ["g"], seed=1).collect()) != sorted(a)


def test_row_index(spark):
    rows = spark.range(0, 2_000, 3).withColumn("g", F.col("id") % 2)
    got = sampling.row_index(rows, ["g"], "id", width=100).collect()
    for g in (0, 1):
        own = sorted((r["id"], r["index"]) for r in got if r["g"] == g)
        assert [i for _, i in own] == list(range(len(own)))


def test_hallucination_scores(spark):
    rows = [("SUPPORTED", "SUPPORTED", "SUCCESS"), ("HALLUCINATED", "HALLUCINATED", "SUCCESS"), ("HALLUCINATED", None, "SUCCESS"), ("SUPPORTED", "HALLUCINATED", "SUCCESS")]
    got = scores.hallucination(spark.createDataFrame(rows, "gold string, predicted string, status string")).first()
    assert (got["accuracy"], got["invalid_output_rate"], got["hallucination_recall"]) == (0.5, 0.25, 0.5)


def test_cross_lingual(spark):
    schema = "semantic_id string, gold string, predicted string"
    en = spark.createDataFrame([("1", "a", "a"), ("2", "a", "b"), ("3", "a", None)], schema)
    ko = spark.createDataFrame([("1", "a", "a"), ("2", "a", "a"), ("3", "a", None)], schema)
    got = scores.cross_lingual(en, ko).first()
    assert (got["both_correct"], got["ko_only_correct"], got["both_wrong"]) == (1, 1, 1)
    assert got["consistency"] == pytest.approx(2 / 3) and got["prediction_agreement"] == pytest.approx(1 / 3)


def test_macro_f1_is_over_gold_labels(spark):
    rows = [("a", "a", "SUCCESS"), ("a", "z", "SUCCESS"), ("b", None, "RATE_LIMIT")]
    got = scores.classification(spark.createDataFrame(rows, "gold string, predicted string, status string").withColumn("k", F.lit(1)), "k").first()
    assert got["macro_f1"] == pytest.approx((2 / 3 + 0) / 2) and got["failed_cases"] == 1


def test_summaries_without_scores(spark):
    rows = spark.createDataFrame([("RATE_LIMIT", None, False, 0, 0, None)], "status string, output_text string, refusal boolean, output_tokens_est int, source_tokens_est int, bertscore_f1 double")
    got = scores.summarization(rows).first()
    assert got["compression_ratio"] == 0.0 and got["bertscore_f1"] is None and got["cases"] == 1


@pytest.mark.parametrize(("oks", "at", "why"), [([0] * 10, 10, "consecutive"), ([0] * 9 + [1] + [0] * 3, None, None), ([0, 1, 0] * 10, 21, "rate"), ([1] * 30, None, None)])
def test_failure_guard(spark, oks, at, why):
    rows = spark.createDataFrame([("m", i, bool(o)) for i, o in enumerate(oks)], "m string, i int, ok boolean")
    got = money.failure_guard(rows, "m", ["i"]).first()
    assert (got["tripped_at"], got["reason"]) == (at, why)


def test_budget_guard_is_sticky(spark):
    rows = spark.createDataFrame([("m", 1, 0.5, 0.1), ("m", 2, 0.0, 0.9), ("m", 3, 0.0, 0.1)], "m string, i int, billed double, estimate double")
    assert [r["allowed"] for r in money.budget_guard(rows, "m", ["i"], 1.0).orderBy("i").collect()] == [True, False, False]


def test_price_chain(spark):
    models = spark.createDataFrame([("a",), ("b",), ("c",)], "model_id string")
    snap = spark.createDataFrame([("a", 1, "2024", 1.0, 2.0, None), ("b", 1, "2024", 1.0, None, None)], "model_id string, id int, retrieved_at string, input_per_million double, output_per_million double, cached_input_per_million double")
    conf = spark.createDataFrame([("a", 9.0, 9.0, None), ("b", 3.0, 4.0, None), ("c", 5.0, None, None)], "model_id string, input_per_million double, output_per_million double, cached_input_per_million double")
    got = {r["model_id"]: (r["input_per_million"], r["price_source"]) for r in money.resolve_prices(models, snap, conf).collect()}
    assert got == {"a": (1.0, "snapshot"), "b": (3.0, "config"), "c": (5.0, "unknown")}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.rows("inference_results").count() == 0
    rows = lambda *x: spark.createDataFrame(x, "cache_key string, status string, output_text string, updated_at timestamp")
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, n)
    store.append("inference_results", rows(("k", "SUCCESS", "a", day(1)), ("l", "RATE_LIMIT", None, day(1))))
    store.append("inference_results", rows(("k", "RATE_LIMIT", None, day(2)), ("l", "RATE_LIMIT", None, day(2))))
    got = {r["cache_key"]: r["status"] for r in store.rows("inference_results").collect()}
    assert got == {"k": "SUCCESS", "l": "RATE_LIMIT"}
    assert store.clear_failed() == 1 and store.rows("inference_results").count() == 1
    store.compact("inference_results")
    assert store.rows("inference_results").first()["output_text"] == "a"
    models = spark.createDataFrame([("x/y", "Y")], "model_id string, display_name string")
    assert store.add_absent("models", models) == 1 and store.add_absent("models", models) == 0
    assert len(SCHEMAS) == 9


def test_responses(spark):
    raw = ['{"id":"r","choices":[{"message":{"content":"hi"},"finish_reason":"stop"}],"usage":{"prompt_tokens":3,"completion_tokens":"4","cost":0.5}}', '{"error":{"code":429,"message":"slow"}}', "oops", None]
    rows = responses.normalized(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw_response_json string")).orderBy("i").collect()
    assert [r["status"] for r in rows] == ["SUCCESS", "RATE_LIMIT", "PARSE_ERROR", "PARSE_ERROR"]
    assert (rows[0]["total_tokens"], rows[0]["usage_cost"], rows[0]["output_text"], rows[1]["usage_cost"]) == (7, 0.5, "hi", None)


def test_softmax(spark):
    got = spark.range(1).select(responses.softmax(F.array(F.lit(1.0), F.lit(1.0), F.lit(-100.0)))).first()[0]
    assert got[0] == pytest.approx(0.5) and sum(got) == pytest.approx(1)


def test_filters(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(filters.within_price(F.lit(None).cast("double"), F.lit(1.0), 1, 1)) is None
    assert one(filters.is_retryable_http(F.lit(503))) and not one(filters.is_retryable_http(F.lit(404)))
    assert one(filters.skip_reason(F.lit("local"), F.lit(False), F.lit("summarization"))) is not None
    assert one(filters.in_languages(F.lit("en"), "all"))
