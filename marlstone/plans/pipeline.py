"""From raw datasets to manifests, and from manifests to scores: prepare, plan, execute, score, judge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts, keys, parsers, text
from ..operators import filters, joins, money, sampling, scores
from ..operators.store import Store
from . import backend as backends
from . import evaluators
from .config import Model, Settings
from .tasks import SINGLE_MODES

# --- prepare: records of manifests, with their ordinal ---


def _frozen(rows: DataFrame, benchmark: str, revision: str, order: list[str]) -> DataFrame:
    """The records' columns and a 1-based ordinal; samples have thousands of rows."""
    n = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return rows.select(F.lit(benchmark).alias("benchmark"), "language", "split", F.lit(revision).alias("dataset_revision"), "sample_id", "source_hash", "reference_hash", "payload", F.col("label").cast("string").alias("label"), n.alias("ordinal"))


def prepare_summarization(rows: DataFrame, wanted: int, revision: str, split: str, settings: Settings) -> DataFrame:
    """Usable articles of each language by rank, sources cut to the limit."""
    usable = rows.where(filters.xlsum_usable(F.col("source"), F.col("reference")))
    own = sampling.take_top(usable, wanted, "id", ["language"], settings.seed).withColumn("t", text.truncate_to_tokens(F.col("source"), settings.summary_source_tokens))
    payload = F.struct(
        F.col("t.text").alias("source"), "reference", "title", "url", F.col("t.truncated").alias("truncated"), keys.text_hash(F.col("source")).alias("raw_source_hash"),
        text.token_estimate(F.col("t.text")).alias("source_tokens_est"), text.token_estimate(F.col("reference")).alias("reference_tokens_est"),
    )
    made = own.select("language", F.lit(split).alias("split"), F.concat_ws(":", F.lit("xlsum"), "language", "id").alias("sample_id"), keys.text_hash(F.col("t.text")).alias("source_hash"), keys.text_hash(F.col("reference")).alias("reference_hash"), payload.alias("payload"), F.lit(None).alias("label"))
    return _frozen(made, "summarization", revision, ["language", "sample_id"])


def prepare_hallucination_en(rows: DataFrame, wanted: int, revision: str, split: str, settings: Settings) -> DataFrame:
    """Two cases of each document, the supported one first."""
    usable = rows.where(filters.halueval_usable(F.col("source"), F.col("right_summary"), F.col("hallucinated_summary"))).withColumn("language", F.lit("en"))
    own = sampling.take_top(usable, wanted, "id", ["language"], settings.seed)
    return _two_cases(own, [("SUPPORTED", "right_summary"), ("HALLUCINATED", "hallucinated_summary")], "halueval", revision, split, settings, [])


def prepare_hallucination_ko(rows: DataFrame, wanted: int, revision: str, split: str, settings: Settings, allow_other: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, audit): documents with a real content error, by tiers; the hallucinated case comes first."""
    rules = [
        ("not_factual", (F.col("erroneous_summary") != F.col("corrected_summary")) & (F.col("source") != "") & (F.col("is_factual_error") | F.lit(allow_other))),
        ("omission_only", ~F.col("is_omission_only")),
        ("broken_prefix", ~(text.has_broken_start(F.col("erroneous_summary"), F.col("source")) | text.has_broken_start(F.col("corrected_summary"), F.col("source")))),
        ("too_long", text.token_estimate(F.col("source")) <= settings.judged_source_tokens),
    ]
    tier = F.when(F.col("only_preferred_type"), 1).when(F.col("has_preferred_type"), 2).otherwise(3)
    marked = filters.audited(rows, rules)
    own = sampling.tiered_fill(marked.where("dropped_by is null").withColumn("language", F.lit("ko")), wanted, "id", tier, settings.seed)
    more = ["error_types", "correction_labels", "error_span_kinds", "only_preferred_type", "summary_kind", "document_type"]
    records = _two_cases(own, [("HALLUCINATED", "erroneous_summary"), ("SUPPORTED", "corrected_summary")], "aihub", revision, split, settings, more)
    return records, filters.audit(rows, rules)


def _two_cases(own: DataFrame, pairs: list[tuple[str, str]], name: str, revision: str, split: str, settings: Settings, more: list[str]) -> DataFrame:
    own = own.drop("split").withColumn("t", text.truncate_to_tokens(F.col("source"), settings.judged_source_tokens))
    both = sampling.cases(own, pairs)
    payload = F.struct(F.col("id").alias("document_id"), F.col("t.text").alias("source"), F.col("candidate").alias("candidate_summary"), "gold_label", F.col("t.truncated").alias("truncated"), keys.text_hash(F.col("candidate")).alias("candidate_hash"), text.token_estimate(F.col("t.text")).alias("source_tokens_est"), *more)
    made = both.select("language", F.lit(split).alias("split"), F.concat_ws(":", F.lit(name), "id", F.lower("gold_label")).alias("sample_id"), keys.text_hash(F.col("t.text")).alias("source_hash"), keys.text_hash(F.col("candidate")).alias("reference_hash"), payload.alias("payload"), F.col("gold_label").alias("label"), "id", "case_no")
    return _frozen(made, "hallucination", revision, ["id", "case_no"])


def prepare_classification(en: DataFrame, ko: DataFrame, wanted: int, revision: str, split: str, settings: Settings) -> DataFrame:
    """The same ids in both languages, of ids whose intents agree, intents taking turns."""
    chosen = sampling.round_robin(joins.paired(en, ko, "id", "intent").select("id", "intent").distinct(), wanted, "id", "intent", settings.seed).select("id", "position")
    both = en.unionByName(ko).join(F.broadcast(chosen), "id")  # at most ``wanted`` ids
    payload = F.struct(F.col("id").alias("semantic_id"), "text", "intent")
    made = both.select("language", F.lit(split).alias("split"), F.concat_ws(":", F.lit("massive"), "language", "id").alias("sample_id"), keys.text_hash(F.col("text")).alias("source_hash"), keys.text_hash(F.col("intent")).alias("reference_hash"), payload.alias("payload"), F.col("intent").alias("label"), "position")
    return _frozen(made, "classification", revision, ["language", "position"])


def judge_subset(summarization: DataFrame, wanted: int, settings: Settings) -> DataFrame:
    """Samples of the summarization manifest to be judged, under the judge's seed."""
    own = sampling.take_top(summarization, wanted, "sample_id", ["language"], settings.seed + 1)
    return own.withColumn("benchmark", F.lit("judge"))


# --- plan and execute ---


@dataclass
class Plan:
    """Tasks with ``cached``, those to run, and what they are estimated to cost."""

    tasks: DataFrame
    pending: DataFrame
    estimate: DataFrame
    model: Model


def plan(tasks: DataFrame, store: Store, model: Model, retry_failed: bool = False, force: bool = False) -> Plan:
    store.settle()
    results = store.rows("inference_results")
    marked = joins.marked_cached(tasks, results) if not force else tasks.withColumn("cached", F.lit(False))
    pending = joins.pending(tasks, results, retry_failed, force)
    return Plan(marked, pending, money.estimate(marked, model.input_per_million or 0.0, model.output_per_million or 0.0), model)


@dataclass
class Guards:
    """What a run has asked, how it went, and why it stops; a run is a sequence of cases."""

    settings: Settings
    asked: int = 0
    failures: int = 0
    run: int = 0
    spent: float = 0.0
    reason: str | None = None

    def room(self) -> int:
        """Cases that may be asked together: the failure guard can trip at the last of them at the soonest."""
        s = self.settings
        by_rate = max((s.max_failure_rate * self.asked - self.failures) / (1 - s.max_failure_rate), 0) if s.max_failure_rate < 1 else float("inf")
        return int(min(s.max_consecutive_failures - self.run, max(by_rate // 1 + 1, s.attempts_before_rate - self.asked)))

    def affordable(self, estimates: list[float]) -> int:
        """How many cases, in order, what was spent and their estimates allow."""
        total, limit = self.spent, self.settings.budget_usd * self.settings.stop_margin
        for k, x in enumerate(estimates):
            total += x
            if total > limit:
                self.reason = "budget"
                return k
        return len(estimates)

    def saw(self, ok: bool, cost: float) -> None:
        s = self.settings
        self.asked, self.spent = self.asked + 1, self.spent + cost
        self.failures, self.run = (self.failures, 0) if ok else (self.failures + 1, self.run + 1)
        if not ok and self.run >= s.max_consecutive_failures:
            self.reason = "consecutive"
        elif not ok and self.asked >= s.attempts_before_rate and self.failures / self.asked > s.max_failure_rate:
            self.reason = "rate"


def execute(p: Plan, store: Store, backend: backends.Backend, run_id: str, settings: Settings, dry_run: bool = False) -> Guards:
    """Asks what is pending, in waves, and stores results and attempts; tells how it went.

    Guards act before a request: a wave is no longer than the failure guard allows to be sure
    that nothing is asked after it trips, and holds no case whose estimate would pass the budget. A wave's replies are
    written once before anything reads them, so a driver lost between waves asks for none again: ``plan`` settles
    what a lost run has left. (A task that is lost within a wave is run again and asks again.) All waves' replies go to the tables together at the end. What was not asked is found by a later run; a second run has nothing to do.
    """
    if dry_run:
        raise backends.DryRunViolation("inference in a dry run")
    price_in, price_out = p.model.input_per_million or 0.0, p.model.output_per_million or 0.0
    order = Window.partitionBy("model_id").orderBy("task_id")
    cost = (F.col("est_input_tokens") * price_in + F.col("est_output_tokens") * price_out) / 1e6
    placed = p.pending.withColumns({"_n": F.row_number().over(order), "_cost": cost}).persist()
    total, guards = placed.count(), Guards(settings)
    delays = (settings.initial_backoff, settings.longest_backoff, settings.backoff_jitter)
    while guards.asked < total and guards.reason is None:
        first = guards.asked
        wave = placed.where((F.col("_n") > first) & (F.col("_n") <= first + guards.room()))
        n = guards.affordable([r[0] for r in wave.orderBy("_n").select("_cost").collect()])
        if n == 0:
            break
        replies = store.stage(f"{run_id}-{first:09d}", backends.ask(wave.where(F.col("_n") <= first + n), backend, run_id, settings.max_attempts, delays))
        by_task = replies.groupBy("_n").agg(F.max(F.col("last") & (F.col("status") == "SUCCESS")).alias("ok"), F.sum(F.coalesce("usage_cost", F.lit(0.0))).alias("cost"))
        for row in by_task.orderBy("_n").collect():  # a wave's cases, bounded by room()
            guards.saw(row["ok"], row["cost"])
    store.settle()
    placed.unpersist()
    return guards


# --- score ---


def score_summarization(records: DataFrame, results: DataFrame, store: Store | None = None) -> DataFrame:
    """A row for each sample with a result, with its metrics; with a store, values that it holds are read and the others are added to it."""
    own = joins.with_results(records, results.select("sample_id", "status", "output_text", "cache_key"))
    own = own.withColumns({"source": F.get_json_object("payload", "$.source"), "reference": F.get_json_object("payload", "$.reference"), "source_tokens_est": F.get_json_object("payload", "$.source_tokens_est").cast("bigint")})
    chosen = evaluators.standard().chosen()
    if store is not None:
        scored = evaluators.score(own, store, chosen).rows
    else:
        against = lambda e: F.coalesce(e.against, F.lit(""))
        scored = own.withColumns({e.name: e.value(against(e), F.coalesce("output_text", F.lit(""))) for e in chosen})
    return scored.select(
        "sample_id", "language", "status", "output_text", F.col("length.refusal").alias("refusal"), "rouge.*", "chrf.chrf", F.col("bertscore.bertscore_f1").alias("bertscore_f1"), "surface_facts.*",
        F.coalesce("length.output_tokens_est", F.lit(0)).alias("output_tokens_est"), "source_tokens_est",
    )


def of_plan(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """All stored results of a plan's requests, by key: those of another prompt, mode or setting for the same sample are not among them."""
    return results.join(tasks.select("cache_key"), "cache_key", "left_semi")


def score_hallucination(records: DataFrame, results: DataFrame) -> DataFrame:
    own = joins.with_results(records, results.select("sample_id", "status", "output_text"))
    return own.select("sample_id", "language", "status", F.col("label").alias("gold"), parsers.hallucination_label(F.col("output_text")).alias("predicted"))


def score_classification(tasks: DataFrame, results: DataFrame, records: DataFrame, label_space: list[str], mode: str = "text") -> DataFrame:
    """A row for each utterance: its request's reply is read as its mode writes it and zipped with the request's items."""
    labels = F.array(*[F.lit(x) for x in label_space])
    own = tasks.select("cache_key", "language", F.col("sample_ids").alias("items")).join(results.select("cache_key", "status", "output_text"), "cache_key")
    said = F.when(F.col("status") == "SUCCESS", F.col("output_text"))
    if mode in SINGLE_MODES:
        answers = F.array(parsers.single_label(said, labels))
    elif mode == "json_schema":
        answers = parsers.batch_json_answers(said, F.size("items"), labels)
    else:
        answers = parsers.batch_answers(said, F.size("items"), F.size(labels))
    flat = joins.unbatched(own, answers).select(F.col("item").alias("sample_id"), "status", F.get(labels, F.col("answer")).alias("predicted"))
    wide = records.select("sample_id", "language", F.col("label").alias("gold"), F.get_json_object("payload", "$.semantic_id").alias("semantic_id"))
    return wide.join(flat, "sample_id")


def aggregate(summaries: DataFrame | None = None, hallucinations: DataFrame | None = None, classes: DataFrame | None = None) -> dict[str, DataFrame]:
    """The score tables of a run."""
    out: dict[str, DataFrame] = {}
    if summaries is not None:
        out |= {"summarization": scores.summarization(summaries, "language"), "surface_facts": facts.aggregate_support(summaries, "language")}
    if hallucinations is not None:
        out["hallucination"] = scores.hallucination(hallucinations, "language")
    if classes is not None:
        out["classification"] = scores.classification(scores.with_overall(classes, "language"), "language")
        own = lambda lang: classes.where(F.col("language") == lang)
        out["cross_lingual"] = scores.cross_lingual(own("en"), own("ko"))
    return out


def judgeable(records: DataFrame, results: DataFrame, wanted: int, language: str | None = None) -> DataFrame:
    """Samples, of one language if asked for, with a readable summary, the first of the manifest."""
    records = records.where(F.col("language") == language) if language else records
    own = joins.with_results(records, results.where("status = 'SUCCESS'").select("sample_id", "output_text"))
    return own.where(~text.is_blank(F.col("output_text"))).orderBy("ordinal").limit(wanted)


def cost_report(plan_: Plan, store: Store, model: Model, settings: Settings) -> DataFrame:
    """One row: what was billed, what a table of prices makes of it, and what the cache saved."""
    attempts = money.attempt_costs(store.rows("inference_attempts").where(F.col("model_id") == model.model_id), "model_id")
    used = money.usage_totals(store.rows("inference_results").where(F.col("model_id") == model.model_id), "model_id")
    own = attempts.join(used, "model_id")
    total = money.cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.lit(model.input_per_million), F.lit(model.output_per_million), F.col("cached_tokens"), F.lit(model.cached_input_per_million))[2]
    saved = joins.cached_cost(plan_.tasks.where("cached"), store.rows("inference_results")).select(F.col("cached_cost").alias("estimated_cache_savings"))
    rows = money.reconcile(own.withColumns({"billed": F.col("total_cost"), "recomputed": total}), settings.reconciliation_usd, settings.reconciliation_relative)
    return rows.withColumn("_one", F.lit(1)).join(saved.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each
