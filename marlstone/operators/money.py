"""Prices, costs, estimates, guards and reconciliation, as column expressions, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scores import ratio

MILLION = 1_000_000
TOKENS = ("prompt_tokens", "cached_tokens", "cache_write_tokens", "completion_tokens", "reasoning_tokens", "total_tokens")


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, cached: Column | None = None, price_cached: Column | None = None) -> tuple[Column, Column, Column]:
    """(input, output, total) in the prices' currency; a missing price counts as 0, cached tokens cost the input price if they have none of their own."""
    price_in, price_out = F.coalesce(price_in, F.lit(0.0)), F.coalesce(price_out, F.lit(0.0))
    cached = F.coalesce(cached, F.lit(0)) if cached is not None else F.lit(0)
    price_cached = F.coalesce(price_cached, price_in) if price_cached is not None else price_in
    fresh = F.greatest(tokens_in - cached, F.lit(0))
    into = fresh / MILLION * price_in + cached / MILLION * price_cached
    out = tokens_out / MILLION * price_out
    return into, out, into + out


def per_million(price: Column) -> Column:
    """From a price for a token, maybe as text."""
    return F.round(price.try_cast("double") * MILLION, 10)


def complete(price_in: Column, price_out: Column) -> Column:
    return price_in.isNotNull() & price_out.isNotNull()


def resolve_prices(models: DataFrame, snapshots: DataFrame, configured: DataFrame) -> DataFrame:
    """A price for each model: a complete latest snapshot, else a complete configured one, else any snapshot, else the configured one.

    The price tables hold a row or a few for each model, the latest snapshot is found by one aggregate.
    """
    value = F.struct("input_per_million", "output_per_million", "cached_input_per_million")
    latest = snapshots.groupBy("model_id").agg(F.max_by(value, F.struct("retrieved_at", "id")).alias("s"))
    own = configured.groupBy("model_id").agg(F.max(value).alias("c"))
    joined = models.select("model_id").distinct().join(latest, "model_id", "left").join(own, "model_id", "left")
    whole = lambda x: F.coalesce(complete(F.col(f"{x}.input_per_million"), F.col(f"{x}.output_per_million")), F.lit(False))
    pick = F.when(whole("s"), F.col("s")).when(whole("c"), F.col("c")).otherwise(F.coalesce("s", "c"))
    source = F.when(whole("s"), "snapshot").when(whole("c"), "config").when(F.col("s").isNotNull(), "snapshot").otherwise("unknown")
    return joined.select("model_id", pick.alias("p"), source.alias("price_source")).select("model_id", "p.input_per_million", "p.output_per_million", "p.cached_input_per_million", "price_source")


def compare_prices(live: DataFrame, configured: DataFrame, max_input: float, max_output: float) -> DataFrame:
    """Live prices beside configured ones; a difference is null where a side is, the ceiling where a live price is."""
    from .filters import within_price

    joined = live.alias("l").join(configured.alias("c"), "model_id", "left")
    out = ["model_id"]
    for k in ("input", "output"):
        a, b = F.col(f"c.{k}_per_million"), F.col(f"l.{k}_per_million")
        out += [a.alias(f"config_{k}"), b.alias(f"live_{k}"), (b - a).alias(f"{k}_delta")]
    limits = within_price(F.col("l.input_per_million"), F.col("l.output_per_million"), max_input, max_output)
    return joined.select(*out, limits.alias("within_constraints")).orderBy("model_id")


def reconcile(rows: DataFrame, absolute: float = 5e-6, relative: float = 0.02) -> DataFrame:
    """Rows (recomputed, billed) with the difference, its share of what was billed, and whether either is within tolerance."""
    difference = F.col("billed") - F.col("recomputed")
    share = F.when(F.col("billed") != 0, F.abs(difference) / F.col("billed")).when(difference == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return rows.withColumns({"difference": difference, "relative_difference": share, "matches_within_tolerance": (F.abs(difference) <= absolute) | (share <= relative)})


def estimate(tasks: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Totals by benchmark, language and overall in one pass, cached tasks apart; costs are of pending ones, and of all."""
    pending = ~F.col("cached")
    over = lambda c, test=None: F.coalesce(F.sum(c if test is None else F.when(test, c)), F.lit(0))
    price = lambda i, o: cost(i, o, F.lit(price_in), F.lit(price_out))[2]
    tin, tout = F.col("est_input_tokens"), F.col("est_output_tokens")
    level = F.grouping_id()
    return tasks.rollup("benchmark", "language").agg(
        level.cast("int").alias("level"),
        F.count("*").alias("total_tasks"),
        F.count_if("cached").alias("cached_tasks"),
        F.count_if(pending).alias("pending_tasks"),
        over(F.col("cases")).alias("total_cases"),
        over(F.col("cases"), pending).alias("pending_cases"),
        over(tin, pending).alias("est_input_tokens"),
        over(tout, pending).alias("est_output_tokens"),
        price(over(tin, pending), over(tout, pending)).alias("est_cost"),
        price(over(tin), over(tout)).alias("est_cost_without_cache"),
    )


def savings(without: Column, with_cache: Column) -> Column:
    return F.greatest(without - with_cache, F.lit(0.0))


def attempt_costs(attempts: DataFrame, *keys: str) -> DataFrame:
    """Count and cost by status, with the shares of successes and errors; a missing cost counts as 0."""
    billed = F.coalesce("usage_cost", F.lit(0.0))
    by = attempts.groupBy(*keys).agg(
        F.count("*").alias("attempts"),
        F.sum(billed).alias("total_cost"),
        F.sum(F.when(F.col("status") == "SUCCESS", billed).otherwise(0.0)).alias("success_cost"),
        F.sum(F.when(F.col("status") != "SUCCESS", billed).otherwise(0.0)).alias("error_cost"),
        F.count_if(F.col("status") != "SUCCESS").alias("failed_attempts"),
    )
    return by


def usage_totals(results: DataFrame, *keys: str) -> DataFrame:
    """Requests, token sums and cost over successes."""
    ok = results.where("status = 'SUCCESS'")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS if c in results.columns]
    return ok.groupBy(*keys).agg(F.count("*").alias("requests"), *sums, F.coalesce(F.sum("usage_cost"), F.lit(0.0)).alias("usage_cost"))


def judge_costs(judged: DataFrame) -> DataFrame:
    """(target_model, judge_cost): what grading each model's outputs cost; a missing cost counts as 0."""
    return judged.groupBy("target_model").agg(F.coalesce(F.sum("usage_cost"), F.lit(0.0)).alias("judge_cost"))


def judge_cost(judged: DataFrame, target: str) -> float:
    """The cost of grading one model's outputs, 0 if nothing was graded."""
    row = judge_costs(judged.where(F.col("target_model") == target)).first()
    return row["judge_cost"] if row else 0.0


def last_http_status(attempts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, http_status): the last status other than null and 0 that a case's attempts had, null if none had one."""
    told = F.when(F.col("http_status") != 0, F.col("http_status"))
    return attempts.groupBy(key).agg(F.max_by(told, F.when(told.isNotNull(), F.struct(*order))).alias("http_status"))


def global_stats(results: DataFrame) -> DataFrame:
    """Counts and costs by (model, benchmark, status) and overall, in one pass."""
    sets = results.groupingSets([("model_id", "benchmark", "status"), ()], "model_id", "benchmark", "status")
    return sets.agg(F.count("*").alias("n"), F.coalesce(F.sum("usage_cost"), F.lit(0.0)).alias("cost"))


#: Rows of a log that a segment of it should hold, and the most segments that it is cut into.
SEGMENT_ROWS, MOST_SEGMENTS = 2_000_000, 256


def segmented(rows: DataFrame, order: str, per: int = SEGMENT_ROWS) -> tuple[DataFrame, int]:
    """``rows`` with ``_seg``: which range of ``order`` a row lies in, and how many ranges there are.

    The cuts are approximate quantiles of the whole log, so that ranges hold
    like numbers of rows; rows of equal order share one. An order that is no number or time gives one range.
    """
    kind = rows.schema[order].dataType.typeName()
    value = F.col(order).cast("timestamp").cast("double") if kind in ("timestamp", "timestamp_ntz", "date") else F.col(order).cast("double")
    numeric = kind in ("timestamp", "timestamp_ntz", "date", "long", "integer", "short", "byte", "double", "float", "decimal")
    n = min(-(-rows.count() // per), MOST_SEGMENTS) if numeric else 1
    if n <= 1:
        return rows.withColumn("_seg", F.lit(0)), 1
    cuts = rows.agg(F.percentile_approx(value, [k / n for k in range(1, n)], 10_000)).first()[0]
    cuts = sorted(set(cuts or []))
    place = F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda a, c: a + (value > c).cast("int"))
    return rows.withColumn("_seg", F.when(value.isNull(), F.lit(-1)).otherwise(place)), len(cuts) + 1


def failure_guard(attempts: DataFrame, key: str, order: list[str], consecutive: int = 10, rate: float = 0.5, least: int = 20, per: int = SEGMENT_ROWS) -> DataFrame:
    """(key, attempts, failures, tripped_at, reason): the first attempt at which the guard of each key trips.

    A guard trips on a failure that makes a run of ``consecutive``, or a
    failure rate over ``rate`` after ``least`` attempts. Attempts of one key
    are a sequence; it is scanned in segments of the order, each by a task of
    its own, so that one key may hold most of the log. What a segment needs of
    those before it - attempts, failures, the failures since the last success - comes from a table with a row for each key and segment.
    """
    cut, segments = segmented(attempts, order[0], per)
    own = Window.partitionBy(key, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = cut.withColumns({"_bad": (~F.col("ok")).cast("int"), "_n": F.count("*").over(own), "_good": F.sum(F.col("ok").cast("int")).over(own)})
    island = Window.partitionBy(key, "_seg", "_good").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumns({"_f": F.col("_n") - F.col("_good"), "_run": F.sum("_bad").over(island)})
    if segments > 1:
        each = cut.groupBy(F.col(key).alias("_key"), F.col("_seg").alias("_s")).agg(F.count("*").alias("_n0"), F.count_if(~F.col("ok")).alias("_f0"), F.max_by(F.col("ok"), F.struct(*order)).alias("_end"))
        # Failures up to and with the segment's last success; what comes after it runs on into the next segment.
        last = cut.where("ok").groupBy(F.col(key).alias("_key"), F.col("_seg").alias("_s")).agg(F.max(F.struct(*order)).alias("_at"))
        since = cut.select(F.col(key).alias("_key"), F.col("_seg").alias("_s"), "ok", F.struct(*order).alias("_o")).join(last, ["_key", "_s"])
        tail = since.groupBy("_key", "_s").agg(F.count_if(~F.col("ok") & (F.col("_o") > F.col("_at"))).alias("_tail"))
        before = Window.partitionBy("_key").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        with_ = Window.partitionBy("_key").orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        table = each.join(tail, ["_key", "_s"], "left").withColumn("_upto", F.sum("_f0").over(with_) - F.col("_tail"))
        zero = F.lit(0)
        carried = table.select("_key", "_s", F.coalesce(F.sum("_n0").over(before), zero).alias("_n1"), F.coalesce(F.sum("_f0").over(before), zero).alias("_f1"), (F.coalesce(F.sum("_f0").over(before), zero) - F.coalesce(F.max("_upto").over(before), zero)).alias("_run1"))
        seen = seen.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_seg") == F.col("_s")))
        seen = seen.withColumns({"_run": F.col("_run") + F.when(F.col("_good") == 0, F.col("_run1")).otherwise(0), "_n": F.col("_n") + F.col("_n1"), "_f": F.col("_f") + F.col("_f1")})
    run, share = F.col("_run") >= consecutive, (F.col("_n") >= least) & (F.col("_f") / F.col("_n") > rate)
    trips = (F.col("_bad") == 1) & (run | share)
    why = F.when(run, F.lit("consecutive")).otherwise(F.lit("rate"))
    return seen.groupBy(key).agg(
        F.count("*").alias("attempts"),
        F.sum("_bad").alias("failures"),
        F.min(F.when(trips, F.col("_n"))).alias("tripped_at"),
        F.min_by(F.when(trips, why), F.when(trips, F.col("_n"))).alias("reason"),
    )


def budget_guard(requests: DataFrame, key: str, order: list[str], budget: float, margin: float = 0.98, per: int = SEGMENT_ROWS) -> DataFrame:
    """``requests`` with ``allowed``: until the first whose estimate would take what was billed before over budget x margin; none after it.

    A key of over ``per`` requests is scanned in segments of the order, as in ``failure_guard``: what was billed before a
    segment, and whether the budget was passed before it, come from a row for each key and segment. Any other key is summed row by row,
    as sums of doubles taken in another order can fall on the other side of the limit.
    """
    hot = requests.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_many")).where(F.col("_many") > per)
    cut, segments = segmented(requests, order[0], per) if hot.head(1) else (requests.withColumn("_seg", F.lit(0)), 1)
    if segments > 1:
        # Each of these has more than ``per`` rows, so they are few.
        cut = cut.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left").withColumn("_seg", F.when(F.col("_many").isNotNull(), F.col("_seg")).otherwise(0)).drop("_hot", "_many")
    own = Window.partitionBy(key, "_seg").orderBy(*order)
    billed = F.coalesce("billed", F.lit(0.0))
    cut = cut.withColumn("_before", F.coalesce(F.sum(billed).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    if segments > 1:
        each = cut.groupBy(F.col(key).alias("_key"), F.col("_seg").alias("_s")).agg(F.sum(billed).alias("_sum"))
        before = Window.partitionBy("_key").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        spent = each.select("_key", "_s", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_spent"))
        same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_seg") == F.col("_s"))
        cut = cut.join(spent, same).drop("_key", "_s").withColumn("_before", F.col("_before") + F.col("_spent")).drop("_spent")
        over = cut.withColumn("_over", (F.col("_before") + F.col("estimate") > budget * margin).cast("int"))
        passed = over.groupBy(F.col(key).alias("_key"), F.col("_seg").alias("_s")).agg(F.max("_over").alias("_any"))
        passed = passed.select("_key", "_s", F.coalesce(F.max("_any").over(before), F.lit(0)).alias("_gone"))
        over = over.join(passed, same).drop("_key", "_s")
        return over.withColumn("allowed", (F.col("_gone") == 0) & (F.max("_over").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 0)).drop("_over", "_gone", "_before", "_seg")
    over = cut.withColumn("_over", (F.col("_before") + F.col("estimate") > budget * margin).cast("int"))
    return over.withColumn("allowed", F.max("_over").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 0).drop("_over", "_before", "_seg")


def top_errors(attempts: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n most frequent messages of each group; of equal counts, the one seen first (least ``ordinal``)."""
    counted = attempts.groupBy(*keys, "message").agg(F.count("*").alias("n"), F.min("ordinal").alias("first_seen"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_seen")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def backoff(attempt: Column, initial: float = 1.0, longest: float = 30.0, retry_after: Column | None = None) -> Column:
    """Seconds before the next try, without the random part."""
    grown = F.least(F.lit(initial) * F.pow(F.lit(2.0), attempt - 1), F.lit(longest))
    return grown if retry_after is None else F.coalesce(F.least(retry_after, F.lit(longest)), grown)


def cost_share(rows: DataFrame, *keys: str) -> DataFrame:
    """SUM(usage_cost) by keys, 0 over none."""
    return rows.groupBy(*keys).agg(F.coalesce(F.sum("usage_cost"), F.lit(0.0)).alias("cost"), ratio(F.count_if(F.col("status") != "SUCCESS"), F.count("*")).alias("failure_rate"))
