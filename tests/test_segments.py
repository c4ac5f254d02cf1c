"""Guards over a log that is cut into segments equal those over one, and those of a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import money


def plain_guard(rows, consecutive, rate, least):
    out = {}
    for key in sorted({r[0] for r in rows}):
        n = bad = run = 0
        tripped = reason = None
        for _, _, ok in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            n, bad, run = n + 1, bad + (not ok), 0 if ok else run + 1
            if not ok and tripped is None and (run >= consecutive or (n >= least and bad / n > rate)):
                tripped, reason = n, "consecutive" if run >= consecutive else "rate"
        out[key] = (n, bad, tripped, reason)
    return out


@pytest.mark.parametrize("share", [0.05, 0.3, 0.7, 0.97])
@pytest.mark.parametrize("per", [7, 40, 10_000])
def test_failure_guard_in_segments(spark, share, per):
    rng = random.Random(int(100 * share) + per)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]), i, rng.random() > share) for i in range(300)] + [("alone", 1000, False)]
    df = spark.createDataFrame(rows, "model string, at bigint, ok boolean")
    got = {r["model"]: (r["attempts"], r["failures"], r["tripped_at"], r["reason"]) for r in money.failure_guard(df, "model", ["at"], 6, 0.6, 20, per).collect()}
    assert got == plain_guard(rows, 6, 0.6, 20)


@pytest.mark.parametrize("per", [9, 10_000])
def test_a_run_of_failures_over_many_segments(spark, per):
    rows = [("m", i, not 5 <= i < 95) for i in range(120)]
    df = spark.createDataFrame(rows, "model string, at bigint, ok boolean")
    row = money.failure_guard(df, "model", ["at"], consecutive=80, rate=2.0, per=per).first()
    assert (row["tripped_at"], row["reason"]) == (85, "consecutive")


@pytest.mark.parametrize("per", [7, 50, 10_000])
def test_budget_guard_in_segments(spark, per):
    rng = random.Random(per)
    rows = [(rng.choice("xxxy"), i, rng.choice([None, 1.0, 2.0, 4.0]), rng.choice([0.5, 8.0])) for i in range(250)]
    df = spark.createDataFrame(rows, "model string, at bigint, billed double, estimate double")
    want, spent, gone = {}, {}, set()
    for model, at, billed, estimate in rows:
        if spent.get(model, 0.0) + estimate > 120.0:
            gone.add(model)
        want[at] = model not in gone
        spent[model] = spent.get(model, 0.0) + (billed or 0.0)
    made = money.budget_guard(df, "model", ["at"], 120.0, 1.0, per)
    assert made.columns == [*df.columns, "allowed"]
    assert {r["at"]: r["allowed"] for r in made.collect()} == want


def test_budgets_met_to_the_cent_do_not_depend_on_segments(spark):
    rng = random.Random(3)
    rows = [(key, i, rng.choice([0.1, 0.2, 0.3, 0.7])) for i in range(12) for key in range(200)]
    want, spent, gone = {}, {}, set()
    for key, at, billed in rows:
        if spent.get(key, 0.0) + 0.1 > 1.5:
            gone.add(key)
        want[key, at] = key not in gone
        spent[key] = spent.get(key, 0.0) + billed
    df = spark.createDataFrame([*rows, *[(-1, i % 12, 0.0) for i in range(600)]], "model bigint, at bigint, billed double").withColumn("estimate", F.lit(0.1))
    for per in (500, 10_000):
        got = money.budget_guard(df, "model", ["at"], 1.5, 1.0, per).where("model >= 0").collect()
        assert {(r["model"], r["at"]): r["allowed"] for r in got} == want


def test_segments_hold_like_numbers_of_rows_and_a_hot_key_is_many_tasks(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("model"), (F.col("id") * F.col("id")).alias("at"))
    cut, n = money.segmented(df, "at", 2_000)
    sizes = [r["count"] for r in cut.where("model = 'hot'").groupBy("_seg").count().collect()]
    assert n == 20 and len(sizes) == 20 and max(sizes) < 4_000
    assert money.segmented(df.withColumn("at", F.col("at").cast("string")), "at", 2_000)[1] == 1


def test_times_and_null_orders(spark):
    own = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("user_id", "ts", "event_id", (~F.col("event_type").isin("error", "click", "view")).alias("ok"))
    one, many = (sorted(map(tuple, money.failure_guard(own, "user_id", ["ts", "event_id"], 6, 0.6, per=per).collect())) for per in (10**9, 500))
    assert one == many and len(one) > 10
