"""Content-addressed keys: canonical JSON, hashes, and the facts that each key holds."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import normal_hash

# The facts of each key.
KEY_SCHEMA = "key-1"
INFERENCE_FACTS = [
    "key_schema_version", "api_provider", "model_id", "routing_config_hash", "alias_resolution", "benchmark", "benchmark_version",
    "dataset_revision", "split", "sample_id", "sample_content_hash", "prompt_template_version", "system_prompt_hash", "user_prompt_hash",
    "temperature", "top_p", "max_output_tokens", "seed", "reasoning", "tools_enabled", "web_search_enabled",
    "structured_output_schema_version", "truncation_policy_version", "generation_config_version", "extra",
]
METRIC_FACTS = ["key_schema_version", "inference_result_hash", "evaluator", "evaluator_version", "evaluator_config_hash", "reference_hash", "scope"]
JUDGE_FACTS = [
    "key_schema_version", "api_provider", "judge_model_id", "judge_routing_config_hash", "target_model_id", "sample_id", "summary_hash",
    "source_hash", "reference_hash", "judge_prompt_version", "rubric_version", "system_prompt_hash", "user_prompt_hash", "temperature",
    "top_p", "max_output_tokens", "reasoning", "structured_output_schema_version",
]


def plain(value: Any) -> Any:
    """Value in JSON's own kinds, the same for equal input: whole floats as integers, others to 12 digits, sets in order of repr."""
    match value:
        case bool() | None | str() | int():
            return value
        case float():
            if not math.isfinite(value):
                raise ValueError(f"{value!r} has no canonical form")
            return int(value) if value.is_integer() and abs(value) < 2**53 else float(format(value, ".12g"))
        case dict():
            return {str(k): plain(v) for k, v in value.items()}
        case list() | tuple():
            return [plain(v) for v in value]
        case set() | frozenset():
            return [plain(v) for v in sorted(value, key=repr)]
    raise TypeError(f"{type(value).__name__} has no canonical form")


def canonical_json(value: Any) -> str:
    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def hash_of(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def text_hash(text: Column) -> Column:
    """sha256 of the normalized text."""
    return normal_hash(text)


def short(h: Column, n: int = 12) -> Column:
    return F.substring(h, 1, n)


def _row_value(v: Any) -> Any:
    if isinstance(v, dict):
        return {k: _row_value(x) for k, x in v.items()}
    if hasattr(v, "tolist"):
        return _row_value(v.tolist())
    if isinstance(v, float) and math.isnan(v):
        return None
    return [_row_value(x) for x in v] if isinstance(v, list) else v


def _written(fact: str, value: Any, written: dict[tuple[type, Any], str], is_json: bool) -> str:
    """A fact as it stands in canonical JSON; ``written`` has what was written before."""
    simple = value is None or isinstance(value, str | int | float)
    out = written.get((type(value), value)) if simple else None
    if out is None:
        held = _row_value(value)
        if is_json and isinstance(held, str):
            held = json.loads(held)
        if fact == "extra" and held is None:
            held = {}
        out = f"{json.dumps(fact, ensure_ascii=False)}:{canonical_json(held)}"
        if simple:
            written[type(value), value] = out
    return out


def with_key(df: DataFrame, facts: list[str], name: str, json_columns: tuple[str, ...] = ("reasoning", "extra")) -> DataFrame:
    """``df`` with ``name``: sha256 of the canonical JSON of the named columns, absent ones null.

    Columns in ``json_columns`` hold JSON texts and enter as what they mean.
    Prices, metric settings and report settings are no facts of any key, so they cannot change one.
    """
    have = [c for c in facts if c in df.columns]

    @F.pandas_udf(T.StringType())
    def key(rows: pd.DataFrame) -> pd.Series:
        # The canonical JSON of a row is that of its facts, in order; a fact's value is written once for all rows of a batch that have it.
        columns = []
        for f in sorted(set(facts)):
            written: dict[tuple[type, Any], str] = {}
            columns.append([_written(f, v, written, f in json_columns) for v in rows[f].tolist()] if f in have else [_written(f, None, written, False)] * len(rows))
        return pd.Series([hashlib.sha256(f"{{{','.join(row)}}}".encode()).hexdigest() for row in zip(*columns)], dtype=str)

    # A null turns its column's integers into floats on the way; canonical JSON writes both alike.
    return df.withColumn(name, key(F.struct(*[F.col(c) for c in have])))


def inference_key(df: DataFrame) -> DataFrame:
    own = df
    for prompt in ("system", "user"):
        if f"{prompt}_prompt_hash" not in own.columns and f"{prompt}_prompt" in own.columns:
            own = own.withColumn(f"{prompt}_prompt_hash", text_hash(F.col(f"{prompt}_prompt")))
    return with_key(own.withColumn("key_schema_version", F.lit(KEY_SCHEMA)), INFERENCE_FACTS, "cache_key")


def result_identity(cache_key: Column, output: Column) -> Column:
    """Which output of which request was scored."""
    return F.sha2(F.concat(F.lit('{"inference_cache_key":"'), cache_key, F.lit('","output_hash":"'), text_hash(output), F.lit('"}')), 256)


def metric_key(df: DataFrame) -> DataFrame:
    return with_key(df.withColumn("key_schema_version", F.lit(KEY_SCHEMA)), METRIC_FACTS, "metric_cache_key")


def judge_key(df: DataFrame) -> DataFrame:
    return with_key(df.withColumn("key_schema_version", F.lit(KEY_SCHEMA)), JUDGE_FACTS, "cache_key")
