"""What models are set to be sent, against what a live listing says that they take; as joins and array tests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ConfigError, Model, Settings

# Names in a listing of which any one stands for a parameter.
ANY_OF = {
    "temperature": ("temperature",),
    "top_p": ("top_p",),
    "seed": ("seed",),
    "stop": ("stop",),
    "reasoning": ("reasoning", "include_reasoning", "reasoning_effort"),
    "response_format": ("response_format",),
    "structured_outputs": ("structured_outputs",),
}
#: What a reply that must follow a schema needs.
SCHEMA_NEEDS = ("response_format", "structured_outputs")


class CapabilityError(ConfigError):
    """A run would send what the model does not take."""


def advertised(listed: Column, groups: dict[str, tuple[str, ...]] = ANY_OF) -> Column:
    """The parameters of which a listing (array of names, whatever their case) has any name."""
    low = F.transform(listed, lambda x: F.lower(x))
    found = [F.when(F.arrays_overlap(low, F.array(*[F.lit(n) for n in names])), F.lit(flag)) for flag, names in groups.items()]
    return F.array_compact(F.array(*found))


def preflight(models: DataFrame, listing: DataFrame, groups: dict[str, tuple[str, ...]] = ANY_OF) -> DataFrame:
    """``models`` (model_id, configured, sending: arrays of parameters; structured: whether a schema is asked for) with the verdict of the listing.

    errors are configured but not advertised, warnings the reverse. Of the
    errors only those with what is sent block; a schema that the model is not
    set for blocks too, even where the listing says nothing. checked is false,
    with a reason, for a model that is not listed or without parameters. ``listing`` has (model_id, supported_parameters).
    """
    held = listing.groupBy("model_id").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("supported_parameters", F.array().cast("array<string>"))))).alias("_listed"), F.lit(True).alias("_there"))
    own = models.join(held, "model_id", "left")
    none = F.array().cast("array<string>")
    checked = F.coalesce(F.size("_listed") > 0, F.lit(False))
    live = F.when(checked, advertised(F.col("_listed"), groups)).otherwise(none)
    flags = F.array(*[F.lit(f) for f in groups])
    configured = F.array_intersect(flags, "configured")
    errors = F.when(checked, F.array_except(configured, live)).otherwise(none)
    warnings = F.when(checked, F.array_except(live, configured)).otherwise(none)
    needs = F.array(*[F.lit(x) for x in SCHEMA_NEEDS if x in groups])
    schema = F.when(F.col("structured"), F.array_except(needs, "configured")).otherwise(none)
    blocking = F.array_distinct(F.concat(schema, F.array_intersect(errors, "sending")))
    reason = F.when(F.col("_there").isNull(), F.concat("model_id", F.lit(" is not listed"))).when(~checked, F.lit("the listing has no parameters"))
    return own.select(
        *models.columns, checked.alias("checked"), reason.alias("reason"), blocking.alias("blocking"),
        F.array_except(F.concat(errors, warnings), blocking).alias("informational"), errors.alias("errors"), warnings.alias("warnings"),
    )


def sending(model: Model, settings: Settings, structured: bool) -> list[str]:
    """The parameters that a run would send, of those that the model is set for."""
    wanted = {
        "temperature": settings.temperature is not None, "top_p": settings.top_p is not None, "reasoning": True, "seed": settings.request_seed is not None,
        "response_format": structured, "structured_outputs": structured,
    }
    return [k for k, asked in wanted.items() if asked and k in model.supported_parameters]


def check(spark: SparkSession, model: Model, settings: Settings, listing: DataFrame, structured: bool) -> dict:
    """The verdict on one model; raises CapabilityError where something that is sent blocks."""
    rows = [(model.model_id, list(model.supported_parameters), sending(model, settings, structured), structured)]
    own = spark.createDataFrame(rows, "model_id string, configured array<string>, sending array<string>, structured boolean")
    row = preflight(own, listing.select("model_id", "supported_parameters")).first().asDict()
    if row["blocking"]:
        raise CapabilityError(f"{model.model_id} does not take {json.dumps(row['blocking'])}: leave them out of supported_parameters, or choose another mode")
    return row
