"""Scores of classification, hallucination detection and summaries, from rows to aggregates.

Null rules: a prediction that is missing or cannot be read counts as wrong;
a metric that was not computed is left out of a mean; precision, recall and
F1 over nothing are 0; a precision over no facts is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * p * r, p + r)


def confusion(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, support, tp, fp, fn) for each label that is gold or predicted.

    Each row gives one entry for its gold label and one for a differing
    prediction, so one aggregate with partial sums does it, without a join of labels.
    """
    entry = F.struct
    right = F.col("predicted").eqNullSafe(F.col("gold"))
    entries = F.array(
        entry(F.col("gold").alias("label"), F.lit(1).alias("support"), right.cast("int").alias("tp"), F.lit(0).alias("fp"), (~right).cast("int").alias("fn")),
        entry(F.when(~right, F.col("predicted")).alias("label"), F.lit(0).alias("support"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn")),
    )
    flat = rows.select(*keys, F.inline(entries)).where("label is not null")
    return flat.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("support", "tp", "fp", "fn")])


def macro_f1(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean F1 over the labels that are gold somewhere in the group."""
    f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))[2]
    return confusion(rows, *keys).where("support > 0").groupBy(*keys).agg(F.avg(f1).alias("macro_f1"))


def classification(rows: DataFrame, *keys: str, label_space: int | None = None) -> DataFrame:
    """Scorecard of rows (gold, predicted, status) for each group of keys."""
    if not keys:
        return classification(rows.withColumn("_all", F.lit(1)), "_all", label_space=label_space).drop("_all")
    right = F.col("predicted").eqNullSafe(F.col("gold"))
    n = F.count("*")
    basic = rows.groupBy(*keys).agg(
        n.alias("cases"),
        F.count_if(right).alias("correct"),
        ratio(F.count_if(right), n).alias("accuracy"),
        F.count_if(F.col("predicted").isNull()).alias("invalid_outputs"),
        ratio(F.count_if(F.col("predicted").isNull()), n).alias("invalid_output_rate"),
        F.count_if(F.col("status") != "SUCCESS").alias("failed_cases"),
        F.countDistinct("gold").alias("label_space_size") if label_space is None else F.lit(label_space).alias("label_space_size"),
    )
    mean = macro_f1(rows, *keys)
    joined = basic.join(mean, [basic[k].eqNullSafe(mean[k]) for k in keys], "left")
    return joined.select(*[basic[k] for k in keys], *[basic[c] for c in basic.columns if c not in keys], F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1"))


def with_overall(rows: DataFrame, key: str, name: str = "overall") -> DataFrame:
    """Each row once for its own group and once for all together: a union of rows, not a mean of means."""
    return rows.withColumn(key, F.explode(F.array(F.col(key), F.lit(name))))


def hallucination(rows: DataFrame, *keys: str, labels: tuple[str, str] = ("SUPPORTED", "HALLUCINATED")) -> DataFrame:
    """Scorecard of rows (gold, predicted, status).

    Accuracy is over all rows; only successful ones are scored; a false
    positive needs a readable label, a miss does not.
    """
    ok = F.col("status") == "SUCCESS"
    readable = ok & F.col("predicted").isNotNull()
    n = F.count("*")
    out = [
        n.alias("cases"),
        F.count_if(ok).alias("scored_cases"),
        F.count_if(~ok).alias("failed_cases"),
        F.count_if(readable).alias("valid_outputs"),
        F.count_if(ok & F.col("predicted").isNull()).alias("invalid_outputs"),
        ratio(F.count_if(ok & F.col("predicted").isNull()), n).alias("invalid_output_rate"),
        ratio(F.count_if(readable & (F.col("predicted") == F.col("gold"))), n).alias("accuracy"),
    ]
    f1s = []
    for label, name in zip(labels, ("supported", "hallucination")):
        is_gold, is_predicted = F.col("gold") == label, F.coalesce(F.col("predicted") == label, F.lit(False))
        counts = F.count_if(readable & is_gold & is_predicted), F.count_if(readable & ~is_gold & is_predicted), F.count_if(ok & is_gold & ~is_predicted)
        for value, part in zip(prf(*counts), ("precision", "recall", "f1")):
            out.append(value.alias(f"{name}_{part}"))
        f1s.append(prf(*counts)[2])
    return rows.groupBy(*keys).agg(*out, ((f1s[0] + f1s[1]) / 2).alias("macro_f1"))


def cross_lingual(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Agreement of two languages' rows (semantic_id, gold, predicted) on the same id.

    Of rows with one id, the last counts: the one with the greatest ``ordinal`` if there is such a column, or else the greatest values.
    """

    def last(df: DataFrame, name: str) -> DataFrame:
        order = F.struct(*(["ordinal"] if "ordinal" in df.columns else []), "gold", "predicted")
        return df.groupBy("semantic_id", *keys).agg(F.max_by(F.struct("gold", "predicted"), order).alias(name))

    both = last(left, "a").join(last(right, "b"), ["semantic_id", *keys])
    ok = lambda c: F.col(f"{c}.predicted").eqNullSafe(F.col(f"{c}.gold"))
    n = F.count("*")
    kinds = {"both_correct": ok("a") & ok("b"), "en_only_correct": ok("a") & ~ok("b"), "ko_only_correct": ~ok("a") & ok("b"), "both_wrong": ~ok("a") & ~ok("b")}
    counts = [F.count_if(test).alias(k) for k, test in kinds.items()]
    rates = [ratio(F.count_if(test), n).alias(f"{k}_rate") for k, test in kinds.items()]
    agree = F.coalesce(F.col("a.predicted") == F.col("b.predicted"), F.lit(False))
    return both.groupBy(*keys).agg(n.alias("paired_cases"), ratio(F.count_if(agree), n).alias("prediction_agreement"), ratio(F.count_if(ok("a") == ok("b")), n).alias("consistency"), *counts, *rates)


METRICS = ("rouge1_f", "rouge2_f", "rougeLsum_f", "chrf")


def summarization(rows: DataFrame, *keys: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Aggregate of scored summaries (status, output_text, refusal, output_tokens_est, source_tokens_est and metric columns).

    Means are over successful rows that have the metric, 0 over none (null
    for bertscore_f1); the fact precision is over all facts; empty and refusal
    rates are over all rows.
    """
    ok = F.col("status") == "SUCCESS"
    full = ok & ~is_blank(F.col("output_text"))
    n = F.count("*")
    when_ok = lambda c: F.when(ok, c)
    mean = lambda c: F.coalesce(F.avg(when_ok(c)), F.lit(0.0))
    out = [n.alias("cases"), F.count_if(ok).alias("scored_cases"), F.count_if(~ok).alias("failed_cases")]
    out += [mean(F.col(m).cast("double")).alias(m) for m in metrics if m in rows.columns]
    if "bertscore_f1" in rows.columns:
        out += [F.avg(when_ok(F.col("bertscore_f1"))).alias("bertscore_f1"), F.count(when_ok(F.col("bertscore_f1"))).alias("bertscore_scored_cases")]
    if "facts_total" in rows.columns:
        out.append(F.try_divide(F.sum(when_ok(F.col("facts_supported"))), F.sum(when_ok(F.col("facts_total")))).alias("surface_fact_support_precision"))
    part = F.try_divide(F.col("output_tokens_est").cast("double"), F.col("source_tokens_est").cast("double"))
    out += [
        F.coalesce(F.avg(F.when(full, part)), F.lit(0.0)).alias("compression_ratio"),
        mean(F.col("output_tokens_est")).alias("output_tokens_mean"),
        mean(F.length("output_text")).alias("output_chars_mean"),
        ratio(F.count_if(ok & is_blank(F.col("output_text"))), n).alias("empty_output_rate"),
        ratio(F.count_if(ok & F.col("refusal")), n).alias("refusal_rate"),
    ]
    return rows.groupBy(*keys).agg(*out)


def judge(rows: DataFrame, dimensions: tuple[str, ...], *keys: str) -> DataFrame:
    """Means of the judge's scores; null over none."""
    return rows.groupBy(*keys).agg(F.count("*").alias("judged"), F.count_if(F.col(dimensions[0]).isNull()).alias("invalid"), *[F.avg(d).alias(d) for d in dimensions])


def mode_deltas(scores: DataFrame, a: str = "text", b: str = "json_schema") -> DataFrame:
    """Rows (model, language, mode, accuracy, macro_f1, invalid_output_rate) side by side where both modes are there; best gain first."""
    measures = ("accuracy", "macro_f1", "invalid_output_rate")
    wide = scores.groupBy("model", "language").pivot("mode", [a, b]).agg(*[F.max(m).alias(m) for m in measures], F.count(F.lit(1)).alias("n"))
    wide = wide.where(F.col(f"{a}_n").isNotNull() & F.col(f"{b}_n").isNotNull())
    names = dict(zip(measures, ("accuracy", "macro_f1", "invalid_rate")))
    out = [F.col(f"{m}_{x}").alias(f"{m}_{names[x]}") for m in (a, b) for x in measures]
    deltas = [(F.col(f"{b}_{m}") - F.col(f"{a}_{m}")).alias(f"{names[m]}_delta") for m in measures]
    return wide.select("model", "language", *out, *deltas).orderBy(F.coalesce("accuracy_delta", F.lit(0.0)).desc(), "model", "language")
