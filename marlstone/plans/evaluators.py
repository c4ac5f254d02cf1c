"""Evaluators: metrics with a name, a version and settings, and a cache that computes only what is missing.

An evaluator turns two text columns into one struct of figures. Its identity
- name, version, hash of its settings - is part of the key of each value,
beside the scored output and the reference, so that a changed setting or version
asks for its own values again and for no others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts, keys, similarity, text
from ..operators.store import Store, last_wins


@dataclass(frozen=True)
class Evaluator:
    """``score(against, output)`` gives a struct column of the type ``shape``.

    ``against`` names the column that an output is held against: a reference or a source.
    ``needs`` says why the evaluator can't run here, or null where it can.
    """

    name: str
    version: str
    score: Callable[..., Column]
    shape: str
    against: str = "reference"
    settings: dict[str, Any] = field(default_factory=dict)
    needs: Callable[[], str | None] = lambda: None

    def settings_hash(self) -> str:
        return keys.hash_of(self.settings)

    def value(self, against: Column, output: Column) -> Column:
        return self.score(against, output, **self.settings)

    def changed(self, **settings: Any) -> Evaluator:
        """The same evaluator under other settings."""
        return Evaluator(self.name, self.version, self.score, self.shape, self.against, {**self.settings, **settings}, self.needs)


def _rouge(reference: Column, output: Column) -> Column:
    return similarity.rouge(reference, output)


def _chrf(reference: Column, output: Column) -> Column:
    return F.struct(similarity.chrf(reference, output).alias("chrf"))


def _facts(source: Column, output: Column) -> Column:
    return facts.check_support(source, output)


def _length(source: Column, output: Column, refusals: bool = True) -> Column:
    own, of = text.token_estimate(output), text.token_estimate(source)
    ratio = F.when(of > 0, own / of)
    refused = text.is_refusal(output) if refusals else F.lit(None).cast("boolean")
    return F.struct(own.alias("output_tokens_est"), F.length(output).cast("bigint").alias("output_chars"), ratio.cast("double").alias("compression"), refused.alias("refusal"))


def _no_model() -> str | None:
    return "BERTScore needs a model's weights, and none are at hand"


def _missing(reference: Column, output: Column, model: str = "") -> Column:
    return F.struct(F.lit(None).cast("double").alias("bertscore_f1"))


class Registry:
    """Evaluators by name; a name is taken once."""

    def __init__(self, evaluators: Iterable[Evaluator] = ()):
        self.held: dict[str, Evaluator] = {}
        for e in evaluators:
            self.add(e)

    def add(self, evaluator: Evaluator) -> Evaluator:
        if evaluator.name in self.held:
            raise ValueError(f"there is an evaluator {evaluator.name!r} already")
        self.held[evaluator.name] = evaluator
        return evaluator

    def __getitem__(self, name: str) -> Evaluator:
        if name not in self.held:
            raise KeyError(f"no evaluator {name!r}; there are {sorted(self.held)}")
        return self.held[name]

    def chosen(self, names: Iterable[str] | None = None) -> list[Evaluator]:
        return [self[n] for n in names] if names is not None else list(self.held.values())


def standard() -> Registry:
    """The evaluators of summaries."""
    return Registry(
        [
            Evaluator("rouge", "1", _rouge, "struct<rouge1_f:double,rouge2_f:double,rougeLsum_f:double,rougeLsum_p:double,rougeLsum_r:double>"),
            Evaluator("chrf", "1", _chrf, "struct<chrf:double>"),
            Evaluator("surface_facts", "1", _facts, "", against="source"),
            Evaluator("length", "1", _length, "struct<output_tokens_est:bigint,output_chars:bigint,compression:double,refusal:boolean>", against="source"),
            Evaluator("bertscore", "1", _missing, "struct<bertscore_f1:double>", settings={"model": ""}, needs=_no_model),
        ]
    )


def keyed(rows: DataFrame, evaluator: Evaluator, scope: str = "sample") -> DataFrame:
    """``rows`` (cache_key, output_text and the column held against) with the facts and the key of the evaluator's value.

    The prompt's price, the model's name and report settings are no facts of the key.
    """
    own = rows.withColumns(
        {
            "inference_result_hash": keys.result_identity(F.col("cache_key"), F.coalesce("output_text", F.lit(""))),
            "reference_hash": keys.text_hash(F.coalesce(evaluator.against, F.lit(""))),
            "evaluator": F.lit(evaluator.name),
            "evaluator_version": F.lit(evaluator.version),
            "evaluator_config_hash": F.lit(evaluator.settings_hash()),
            "scope": F.lit(scope),
        }
    )
    return keys.metric_key(own)


def probe(rows: DataFrame, stored: DataFrame, evaluator: Evaluator, scope: str = "sample") -> DataFrame:
    """``keyed`` rows with value_json where it is stored: one left join on the key."""
    held = last_wins(stored.select("metric_cache_key", "value_json", "created_at"), ["metric_cache_key"], ["created_at"]).select("metric_cache_key", "value_json")
    return keyed(rows, evaluator, scope).join(held, "metric_cache_key", "left")


def figures(probed: DataFrame, evaluator: Evaluator) -> DataFrame:
    """``probed`` with value_json filled in: each distinct key without a value is computed once, the others not at all.

    The evaluator stands behind the split, so that a row with a stored value never reaches it.
    """
    missing = probed.where("value_json is null").drop("value_json")
    once = missing.dropDuplicates(["metric_cache_key"])
    made = once.withColumn("value_json", F.to_json(evaluator.value(F.coalesce(evaluator.against, F.lit("")), F.coalesce("output_text", F.lit(""))), {"ignoreNullFields": "false"}))
    return made


@dataclass
class Scored:
    """A table of values, one struct column for each evaluator, with how many were stored and computed, and why some could not run."""

    rows: DataFrame
    hits: dict[str, int]
    computed: dict[str, int]
    reasons: dict[str, str]


def score(rows: DataFrame, store: Store, evaluators: Iterable[Evaluator], scope: str = "sample") -> Scored:
    """``rows`` (cache_key, output_text, source, reference; model_id, benchmark and language if at hand) with the value of each evaluator.

    Values that are stored are read; the others are computed, appended to
    metric_results and then read like them, so that the next run computes
    none. Rows with equal outputs of one request share a value. An evaluator that can't run gives a null column and its reason.
    """
    hits: dict[str, int] = {}
    computed: dict[str, int] = {}
    reasons: dict[str, str] = {}
    out = rows
    extra = [c for c in ("model_id", "benchmark", "language") if c in rows.columns]
    for e in evaluators:
        if reason := e.needs():
            reasons[e.name], hits[e.name], computed[e.name] = reason, 0, 0
            out = out.withColumn(e.name, F.lit(None).cast(shape_of(e, rows)))
            continue
        probed = probe(rows, store.all_rows("metric_results"), e, scope)
        counts = probed.agg(F.count_if(F.col("value_json").isNotNull()), F.countDistinct(F.when(F.col("value_json").isNull(), F.col("metric_cache_key")))).first()
        hits[e.name], computed[e.name] = counts[0], counts[1]
        if counts[1]:
            facts_ = ["metric_cache_key", "inference_result_hash", "scope", "evaluator", "evaluator_version", "evaluator_config_hash", "reference_hash", "value_json"]
            made = figures(probed, e).select(*facts_, *extra, F.current_timestamp().alias("created_at"))
            store.append("metric_results", made)
        full = probe(rows.select("cache_key", "output_text", e.against), store.all_rows("metric_results"), e, scope)
        value = full.groupBy(*[F.col(c).alias(f"_{c}") for c in ("cache_key", "output_text", e.against)]).agg(F.first("value_json").alias("_value"))
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("cache_key", "output_text", e.against)]
        columns = out.columns
        out = out.join(value, on[0] & on[1] & on[2], "left").select(*columns, F.from_json("_value", shape_of(e, rows)).alias(e.name))
    return Scored(out, hits, computed, reasons)


def shape_of(evaluator: Evaluator, rows: DataFrame) -> str:
    """The type of an evaluator's value: as stated, else as its column has it."""
    if evaluator.shape:
        return evaluator.shape
    probe_ = rows.limit(0).select(F.lit("").alias("a"), F.lit("").alias("b")).select(evaluator.value(F.col("a"), F.col("b")).alias("v"))
    return probe_.schema["v"].dataType.simpleString()


def hits_by_evaluator(rows: DataFrame, stored: DataFrame, evaluators: Iterable[Evaluator], scope: str = "sample") -> DataFrame:
    """(evaluator, evaluator_version, evaluator_config_hash, rows, hits, misses, least_key, greatest_key): what a run would read and what it would compute, without computing it."""
    made = None
    for e in evaluators:
        own = probe(rows, stored, e, scope).groupBy("evaluator", "evaluator_version", "evaluator_config_hash").agg(
            F.count("*").alias("rows"),
            F.count_if(F.col("value_json").isNotNull()).alias("hits"),
            F.countDistinct(F.when(F.col("value_json").isNull(), F.col("metric_cache_key"))).alias("misses"),
            F.min("metric_cache_key").alias("least_key"),
            F.max("metric_cache_key").alias("greatest_key"),
        )
        made = own if made is None else made.unionByName(own)
    return made
