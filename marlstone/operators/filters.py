"""Filters with an audit: which rule first drops a row, and how many each drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_estimate

# Limits on estimated tokens, HTTP codes and statuses worth another try.
XLSUM_SOURCE, XLSUM_REFERENCE, HALUEVAL_SOURCE, AIHUB_SOURCE = 120, 8, 100, 1600
RETRY_HTTP = [408, 409, 425, 429, 500, 502, 503, 504, 520, 522, 524]
RETRY_STATUS = ["OPENROUTER_ERROR", "RATE_LIMIT", "PARSE_ERROR", "INVALID_OUTPUT", "BUDGET_STOPPED"]


def first_failing(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that a row fails (false or null), null if none: rules count in order."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(rules):
        out = F.when(F.coalesce(ok, F.lit(False)), out).otherwise(F.lit(name))
    return out


def audited(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``df`` with ``dropped_by``."""
    return df.withColumn("dropped_by", first_failing(rules))


def audit(df: DataFrame, rules: list[tuple[str, Column]], *keys: str) -> DataFrame:
    """Counts of one pass: rows, kept, and dropped by each rule."""
    own = audited(df, rules)
    counts = [F.count_if(F.col("dropped_by") == name).alias(f"dropped_{name}") for name, _ in rules]
    return own.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(F.col("dropped_by").isNull()).alias("kept"), *counts)


def xlsum_usable(source: Column, reference: Column) -> Column:
    return (source != "") & (reference != "") & (token_estimate(source) >= XLSUM_SOURCE) & (token_estimate(reference) >= XLSUM_REFERENCE)


def halueval_usable(source: Column, right: Column, wrong: Column) -> Column:
    return (token_estimate(source) >= HALUEVAL_SOURCE) & (right != wrong)


def in_languages(column: Column, wanted: str | list[str] | None) -> Column:
    """No filter for None, all or both."""
    if wanted is None or wanted in ("all", "both"):
        return F.lit(True)
    return column.isin([wanted] if isinstance(wanted, str) else wanted)


def is_factual(types: Column, factual: list[str]) -> Column:
    """Types are there and all of them factual."""
    return (F.size(types) > 0) & (F.size(F.array_except(types, F.array(*[F.lit(x) for x in factual]))) == 0)


def is_only(values: Column, one: str) -> Column:
    return F.array_distinct(values) == F.array(F.lit(one))


def within_price(input_price: Column, output_price: Column, max_input: float, max_output: float) -> Column:
    """Null where a price is missing."""
    return F.when(input_price.isNotNull() & output_price.isNotNull(), (input_price <= max_input) & (output_price <= max_output))


def capability_problems(configured: Column, advertised: Column) -> Column:
    """Struct: errors are configured but not advertised, warnings the reverse."""
    return F.struct(F.array_except(configured, advertised).alias("errors"), F.array_except(advertised, configured).alias("warnings"))


def blocking(problems: Column, sent: Column) -> Column:
    """Problems with what is sent; the others only inform."""
    return F.struct(F.array_intersect(problems, sent).alias("blocking"), F.array_except(problems, sent).alias("informational"))


def is_alias(model: Column) -> Column:
    return model.rlike(r"(^|[-/:~])latest$") | model.contains(":latest")


def skip_reason(provider: Column, decisions: Column, benchmark: Column) -> Column:
    """Why a benchmark does not apply to a model; null where it does."""
    return (
        F.when((provider == "local") & (benchmark != "classification"), F.lit("local engines only classify"))
        .when(decisions & (benchmark == "summarization"), F.lit("decision models do not write summaries"))
        .otherwise(F.lit(None).cast("string"))
    )


def is_retryable_http(status: Column) -> Column:
    return F.coalesce(status.isin([0, *RETRY_HTTP]), F.lit(False))


def is_retryable(status: Column) -> Column:
    return F.coalesce(status.isin(RETRY_STATUS), F.lit(False))
