"""Responses of inference backends to flat rows: usage, text, status, and the request that is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses of a case.
STATUSES = ["SUCCESS", "OPENROUTER_ERROR", "RATE_LIMIT", "PARSE_ERROR", "INVALID_OUTPUT", "BUDGET_STOPPED", "SKIPPED"]


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _tokens(v: Column, *paths: str) -> Column:
    """The first of several fields that is there, as a count; text counts too, anything else is 0."""
    found = [F.coalesce(_get(v, p, "double"), _get(v, p, "string").try_cast("double")) for p in paths]
    return F.coalesce(*found, F.lit(0.0)).cast("bigint")


def usage(raw: Column) -> Column:
    """Struct of six token counts and the billed cost from a response's JSON; the total falls back on prompt plus completion, the cost is null if not given."""
    v = F.try_parse_json(raw)
    prompt = _tokens(v, "$.usage.prompt_tokens", "$.usage.input_tokens")
    completion = _tokens(v, "$.usage.completion_tokens", "$.usage.output_tokens")
    total = F.coalesce(F.nullif(_tokens(v, "$.usage.total_tokens"), F.lit(0).cast("bigint")), prompt + completion)
    cost = F.coalesce(_get(v, "$.usage.cost", "double"), _get(v, "$.usage.cost", "string").try_cast("double"))
    return F.struct(
        prompt.alias("prompt_tokens"),
        _tokens(v, "$.usage.prompt_tokens_details.cached_tokens").alias("cached_tokens"),
        _tokens(v, "$.usage.prompt_tokens_details.cache_write_tokens").alias("cache_write_tokens"),
        completion.alias("completion_tokens"),
        _tokens(v, "$.usage.completion_tokens_details.reasoning_tokens").alias("reasoning_tokens"),
        total.alias("total_tokens"),
        cost.alias("usage_cost"),
    )


def _choice(v: Column) -> Column:
    """What a decision's only answer chooses, empty if it does not; null for other replies."""
    answers = F.map_values(_get(v, "$.answers", "map<string, variant>"))
    return F.when(answers.isNotNull(), F.coalesce(F.when(F.size(answers) == 1, _get(F.get(answers, F.lit(0)), "$.choice", "string")), F.lit("")))


def output_text(raw: Column) -> Column:
    """The choice of a decision's only answer, a message's content, its text parts joined, or a completion's text; empty if there is none."""
    v = F.try_parse_json(raw)
    parts = F.transform(_get(v, "$.choices[0].message.content", "array<variant>"), lambda p: F.coalesce(_get(p, "$.text", "string"), F.lit("")))
    whole = F.when(F.schema_of_variant(F.try_variant_get(v, "$.choices[0].message.content", "variant")) == "STRING", _get(v, "$.choices[0].message.content", "string"))
    return F.coalesce(_choice(v), whole, F.array_join(parts, ""), _get(v, "$.choices[0].text", "string"), F.lit(""))


def status(raw: Column, http_status: Column | None = None) -> Column:
    """SUCCESS, or what an error body or code amounts to; 429 in either place is a rate limit, a body that is no JSON cannot be parsed."""
    v = F.try_parse_json(raw)
    code = F.coalesce(_get(v, "$.error.code", "bigint"), _get(v, "$.error.code", "string").try_cast("bigint"), *([http_status] if http_status is not None else []))
    failed = _get(v, "$.error", "variant").isNotNull() | (F.coalesce(http_status, F.lit(200)) >= 400 if http_status is not None else F.lit(False))
    return F.when(failed & (code == 429), "RATE_LIMIT").when(failed, "OPENROUTER_ERROR").when(v.isNull(), "PARSE_ERROR").otherwise("SUCCESS")


def normalized(df: DataFrame, raw: str = "raw_response_json") -> DataFrame:
    """``df`` with the fields of its responses."""
    v = F.try_parse_json(F.col(raw))
    own = df.withColumns(
        {
            "_u": usage(F.col(raw)),
            "status": status(F.col(raw), F.col("http_status") if "http_status" in df.columns else None),
            "output_text": output_text(F.col(raw)),
            "finish_reason": F.coalesce(F.when(_choice(v).isNotNull(), F.lit("decision")), _get(v, "$.choices[0].finish_reason", "string")),
            "request_id": _get(v, "$.id", "string"),
            "resolved_model": _get(v, "$.model", "string"),
            "upstream_provider": _get(v, "$.provider", "string"),
            "error": F.coalesce(_get(v, "$.error.message", "string"), _get(v, "$.error", "string")),
        }
    )
    return own.select("*", "_u.*").drop("_u")


def add_usage(left: Column, right: Column) -> Column:
    """Two usages field by field; the cost is null only if both are."""
    names = ["prompt_tokens", "cached_tokens", "cache_write_tokens", "completion_tokens", "reasoning_tokens", "total_tokens"]
    cost = F.when(left["usage_cost"].isNotNull() | right["usage_cost"].isNotNull(), F.coalesce(left["usage_cost"], F.lit(0.0)) + F.coalesce(right["usage_cost"], F.lit(0.0)))
    return F.struct(*[(left[n] + right[n]).alias(n) for n in names], cost.alias("usage_cost"))


def output_budget(answer: Column, reasons: Column, headroom: int, ceiling: int) -> Column:
    """Tokens an answer may take: with room to reason where a model does, under a ceiling."""
    return F.least(answer + F.when(reasons, F.lit(headroom)).otherwise(F.lit(0)), F.lit(ceiling))


def request(messages: Column, model: Column, limit: Column, **optional: Column) -> Column:
    """The request's JSON; what is null is not sent."""
    return F.to_json(F.struct(model.alias("model"), messages.alias("messages"), limit.alias("max_tokens"), *[c.alias(k) for k, c in optional.items()]))


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)
