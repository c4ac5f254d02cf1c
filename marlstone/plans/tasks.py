"""Tasks: prompts from templates, keys, token estimates; one row for each request."""

from __future__ import annotations

import itertools
import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import token_estimate
from ..operators.responses import output_budget
from ..operators.sampling import batches
from .config import Model, Settings

VERSION = "prompt-1"
#: System and user prompts by benchmark and language; English stands in for a language that has none.
TEMPLATES = {
    ("summarization", "en"): ("You write short, faithful summaries.", "Summarize the text in one or two sentences, in its own language.\n\n{source}"),
    ("summarization", "ko"): ("당신은 짧고 충실한 요약문을 씁니다.", "다음 글을 한두 문장으로 요약하세요.\n\n{source}"),
    ("hallucination", "en"): ("You check summaries against their source.", "Source:\n{source}\n\nSummary:\n{candidate}\n\nIs every claim of the summary borne out by the source? Answer SUPPORTED or HALLUCINATED."),
    ("hallucination", "ko"): ("당신은 요약문을 원문과 대조합니다.", "원문:\n{source}\n\n요약:\n{candidate}\n\n요약의 모든 주장이 원문으로 뒷받침됩니까? SUPPORTED 또는 HALLUCINATED로 답하세요."),
    ("classification", "en"): ("You assign intents to utterances.", "Intents:\n{labels}\n\nUtterances:\n{items}\n\nFor each utterance write its number, a colon, and the number of its intent."),
    ("classification", "ko"): ("당신은 발화의 의도를 분류합니다.", "의도:\n{labels}\n\n발화:\n{items}\n\n각 발화의 번호, 쌍점, 의도 번호를 쓰세요."),
    ("classification_json", "en"): ("You assign intents to utterances and reply with one JSON object.", "Intents:\n{labels}\n\nUtterances:\n{items}\n\nReply with an object whose list answers holds the names of {count} intents, one for each utterance, in their order."),
    ("classification_json", "ko"): ("당신은 발화의 의도를 분류하고 JSON 객체 하나로 답합니다.", "의도:\n{labels}\n\n발화:\n{items}\n\n발화 순서대로 의도 이름 {count}개를 answers 목록에 담은 객체로 답하세요."),
    ("classification_single", "en"): ("You assign an intent to one utterance. Reply with its name alone.\n\nIntents:\n{labels}", "{text}\n\nThe intent of this utterance:"),
    ("classification_single", "ko"): ("당신은 발화 하나의 의도를 분류합니다. 의도 이름만 쓰세요.\n\n의도:\n{labels}", "{text}\n\n이 발화의 의도:"),
    ("classification_state", "en"): ("Which of the intents does the utterance have?", "{text}"),
    ("classification_state", "ko"): ("이 발화의 의도는 어느 것입니까?", "{text}"),
    ("hallucination_state", "en"): ("Does the source bear out every claim of the summary?", "{source}\n\n{candidate}"),
    ("hallucination_state", "ko"): ("원문이 요약의 모든 주장을 뒷받침합니까?", "{source}\n\n{candidate}"),
    ("judge", "en"): ("You grade summaries from 1 to 5.", "Source:\n{source}\n\nSummary:\n{candidate}\n\nGive JSON with factual_consistency, key_information_coverage, conciseness, overall_quality and rationale."),
}


#: What the two answers about a summary mean, where they are options to choose from.
VERDICTS = {
    "en": {"SUPPORTED": "The source bears out every claim of the summary.", "HALLUCINATED": "The source does not bear out at least one claim of the summary."},
    "ko": {"SUPPORTED": "원문이 요약의 모든 주장을 뒷받침합니다.", "HALLUCINATED": "원문이 뒷받침하지 않는 주장이 요약에 하나 이상 있습니다."},
}
#: Modes that ask about one utterance at a time: an engine that constrains its answer itself, and a choice between typed options.
SINGLE_MODES = ("local_constrained", "decisions")


def numbered(items: Column) -> Column:
    """``1. first`` and so on, a line for each."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def prompt(benchmark: str, language: Column, part: int, **values: Column) -> Column:
    """The system (0) or user (1) prompt with its values put in."""
    out = None
    fallback = TEMPLATES[benchmark, "en"][part]
    for (name, lang), texts in TEMPLATES.items():
        if name == benchmark:
            filled = _filled(texts[part], values)
            out = F.when(language == lang, filled) if out is None else out.when(language == lang, filled)
    return out.otherwise(_filled(fallback, values))


def _filled(template: str, values: dict[str, Column]) -> Column:
    """Pieces between the braces, concatenated: values are never searched for braces."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def response_schema(labels: list[str]) -> dict:
    """JSON schema of a batch's answers; how many there are is left open, and checked when the reply is read."""
    return {"type": "object", "properties": {"answers": {"type": "array", "items": {"type": "string", "enum": labels}}}, "required": ["answers"], "additionalProperties": False}


def decision_request(state: Column, instructions: Column, criteria: dict[str, str]) -> Column:
    """A typed choice between options, each with what it means, as JSON."""
    options = F.create_map(*[F.lit(x) for option in criteria.items() for x in option])
    answer = F.struct(F.lit("choice").alias("type"), instructions.alias("instructions"), options.alias("criteria"))
    return F.to_json(F.struct(state.alias("state"), F.struct(answer.alias("answer")).alias("questions")))


def label_grammar(labels: Column) -> Column:
    """The grammar that takes one of an array of labels and nothing else: a rule of quoted alternatives."""
    quoted = F.transform(labels, lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\\\])', r"\\$1"), F.lit('"')))
    return F.concat(F.lit("root ::= "), F.array_join(quoted, " | "))


def prefix_grammar(labels: list[str]) -> str:
    """``label_grammar`` with common beginnings merged, so that a decoder weighs no two alternatives that begin alike; the label space is small."""

    def rule(rest: list[str]) -> str:
        shared = os.path.commonprefix(rest)
        own = json.dumps(shared, ensure_ascii=False) if shared or len(rest) == 1 else ""
        if len(rest) == 1:
            return own
        after = sorted(x[len(shared) :] for x in rest)
        by_first = [rule(list(g)) for _, g in itertools.groupby(after, key=lambda x: x[:1])]
        return f"{own} ( {' | '.join(by_first)} )".strip()

    if not labels:
        raise ValueError("a grammar needs a label")
    return "root ::= " + rule(sorted(set(labels)))


def output_mode(model: Model) -> str:
    return "local_constrained" if model.api_provider == "local" else "decisions" if model.decisions else "json_schema" if model.structured_output else "text"


def make(rows: DataFrame, model: Model, settings: Settings, benchmark: str, kind: str = "") -> DataFrame:
    """Task rows from (task_id, sample_ids, language, dataset_revision, split, sample_content_hash, system_prompt, user_prompt).

    ``kind`` names the prompt where a benchmark has several. A column ``request`` holds as JSON what a request
    has beside its prompts (a schema, a grammar, typed options); its hash is part of the key, as options stand in no prompt.
    """
    mode = output_mode(model)
    answer = model.max_label_tokens if mode == "local_constrained" and benchmark == "classification" else settings.output_tokens[benchmark]
    if "request" in rows.columns:
        rows = rows.withColumn("extra", F.to_json(F.struct(F.sha2("request", 256).alias("request"))))
    else:
        rows = rows.withColumn("request", F.lit(None).cast("string"))
    limit = output_budget(F.lit(answer), F.lit(model.reasons), settings.reasoning_headroom, settings.output_ceiling)
    own = rows.withColumns(
        {
            "benchmark": F.lit(benchmark), "benchmark_version": F.lit(settings.benchmark_version), "model_id": F.lit(model.model_id), "api_provider": F.lit(model.api_provider),
            "routing_config_hash": F.lit(model.routing_config_hash), "reasoning": F.lit(json.dumps(model.reasoning.material(), sort_keys=True)), "seed": F.lit(settings.request_seed).cast("bigint"), "sample_id": F.col("task_id"), "prompt_template_version": F.lit(f"{VERSION}:{kind}" if kind else VERSION), "output_mode": F.lit(mode), "temperature": F.lit(settings.temperature).cast("double"),
            "top_p": F.lit(settings.top_p).cast("double"), "max_output_tokens": limit.cast("bigint"), "tools_enabled": F.lit(False), "web_search_enabled": F.lit(False),
            "structured_output_schema_version": F.lit(f"so-1:{output_mode(model)}" if benchmark == "classification" else "so-1"), "truncation_policy_version": F.lit("trunc-1"), "generation_config_version": F.lit("gen-1"),
            "est_input_tokens": token_estimate(F.concat("system_prompt", F.lit("\n"), "user_prompt"), overhead=8), "est_output_tokens": limit.cast("bigint"), "cases": F.size("sample_ids").cast("bigint"),
        }
    )
    return keys.inference_key(own)


_BASE = ["language", "dataset_revision", "split"]


def summarization(records: DataFrame, model: Model, settings: Settings) -> DataFrame:
    source = F.get_json_object("payload", "$.source")
    rows = records.select(
        F.col("sample_id").alias("task_id"), F.array("sample_id").alias("sample_ids"), *_BASE, F.col("source_hash").alias("sample_content_hash"),
        prompt("summarization", F.col("language"), 0).alias("system_prompt"), prompt("summarization", F.col("language"), 1, source=source).alias("user_prompt"),
    )
    return make(rows, model, settings, "summarization")


def hallucination(records: DataFrame, model: Model, settings: Settings) -> DataFrame:
    """A task for each candidate; a decision model is asked for a choice between the two labels, with source and candidate as its state."""
    values = {"source": F.get_json_object("payload", "$.source"), "candidate": F.get_json_object("payload", "$.candidate_summary")}
    kind, shape = ("hallucination_state", "state") if model.decisions else ("hallucination", "")
    own = records.withColumns({"system_prompt": prompt(kind, F.col("language"), 0), "user_prompt": prompt(kind, F.col("language"), 1, **values)})
    if model.decisions:
        state = F.struct(values["source"].alias("source_document"), values["candidate"].alias("candidate_summary"))
        other = decision_request(state, F.col("system_prompt"), VERDICTS["en"])
        own = own.withColumn("request", F.when(F.col("language") == "ko", decision_request(state, F.col("system_prompt"), VERDICTS["ko"])).otherwise(other))
    rows = own.select(
        F.col("sample_id").alias("task_id"), F.array("sample_id").alias("sample_ids"), *_BASE, F.sha2(F.concat_ws(":", "source_hash", "reference_hash"), 256).alias("sample_content_hash"),
        "system_prompt", "user_prompt", *[c for c in own.columns if c == "request"],
    )
    return make(rows, model, settings, "hallucination", shape)


def classification(records: DataFrame, label_space: list[str], model: Model, settings: Settings, batched_: DataFrame | None = None) -> DataFrame:
    """Tasks in the shape of the model's mode: batches of utterances of a language in manifest order, answered by numbers (text) or in JSON, or one utterance each.

    ``batched_`` may hold what ``batched`` makes of the records, so that plans for several modes batch them once.
    """
    if output_mode(model) in SINGLE_MODES:
        return _single(records, label_space, model, settings)
    return _batched(batched(records, settings) if batched_ is None else batched_, label_space, model, settings)


def batched(records: DataFrame, settings: Settings) -> DataFrame:
    """A row for each batch, its utterances in ``i``."""
    items = records.select("ordinal", *_BASE, "sample_id", "source_hash", F.get_json_object("payload", "$.text").alias("text"))
    made = batches(items, settings.batch_size, _BASE, "ordinal").select(*_BASE, "batch", F.posexplode("items").alias("place", "ordinal"))
    return made.join(items.select("ordinal", "sample_id", "source_hash", "text"), "ordinal").groupBy(*_BASE, "batch").agg(F.sort_array(F.collect_list(F.struct("place", "sample_id", "source_hash", "text"))).alias("i"))


def _batched(held: DataFrame, label_space: list[str], model: Model, settings: Settings) -> DataFrame:
    structured = output_mode(model) == "json_schema"
    own = F.array(*[F.lit(x) for x in label_space])
    values = {"labels": _listed(label_space) if structured else numbered(own), "items": numbered(F.col("i.text")), "count": F.size("i").cast("string")}
    kind = "classification_json" if structured else "classification"
    schema = json.dumps({"response_format": {"type": "json_schema", "json_schema": {"name": "intents", "strict": True, "schema": response_schema(label_space)}}}, ensure_ascii=False)
    rows = held.select(
        F.concat_ws(":", F.lit("batch"), "language", F.format_string("%04d", "batch")).alias("task_id"), F.col("i.sample_id").alias("sample_ids"), *_BASE,
        F.sha2(F.to_json("i.source_hash"), 256).alias("sample_content_hash"),
        prompt(kind, F.col("language"), 0).alias("system_prompt"), prompt(kind, F.col("language"), 1, **values).alias("user_prompt"), *([F.lit(schema).alias("request")] if structured else []),
    )
    return make(rows, model, settings, "classification", "json" if structured else "")


def _single(records: DataFrame, label_space: list[str], model: Model, settings: Settings) -> DataFrame:
    """A request for each utterance. Labels stand in the system prompt, which all requests share, or beside the utterance as options."""
    said = F.get_json_object("payload", "$.text")
    state = model.decisions or model.prompt_style == "state"
    kind = "classification_state" if state else "classification_single"
    system, user = (prompt(kind, F.col("language"), part, text=said, labels=_listed(label_space)) for part in (0, 1))
    if output_mode(model) == "decisions":
        request = decision_request(F.struct(said.alias("utterance")), system, {x: x.replace("_", " ") for x in label_space})
    else:
        request = F.lit(json.dumps({"candidates": label_space, "grammar": prefix_grammar(label_space)}, ensure_ascii=False))
    rows = records.select(
        F.concat_ws(":", F.lit("single"), "language", F.coalesce(F.get_json_object("payload", "$.semantic_id"), "sample_id")).alias("task_id"), F.array("sample_id").alias("sample_ids"), *_BASE,
        F.col("source_hash").alias("sample_content_hash"), system.alias("system_prompt"), user.alias("user_prompt"), request.alias("request"),
    )
    return make(rows, model, settings, "classification", "state" if state else "single")


def _listed(labels: list[str]) -> Column:
    """A line for each label."""
    return F.lit("\n".join(f"- {x}" for x in labels))
