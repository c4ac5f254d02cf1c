"""Frozen manifests: canonical JSON lines with a sidecar that holds their hash, checked at every read."""

from __future__ import annotations

import datetime
import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import canonical_json

FIELDS = ["benchmark", "language", "split", "dataset_revision", "sample_id", "source_hash", "reference_hash", "payload", "label"]
SCHEMA = "benchmark string, language string, split string, dataset_revision string, sample_id string, source_hash string, reference_hash string, payload string, label string, ordinal bigint"


class ManifestError(ValueError):
    """A manifest is missing, malformed or was changed."""


def _path(spark: SparkSession, path: str):
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _sidecar(path: str) -> str:
    return f"{path}.meta.json"


def exists(spark: SparkSession, path: str) -> bool:
    return all(fs.exists(p) for p, fs in (_path(spark, path), _path(spark, _sidecar(path))))


def canonical_lines(records: DataFrame) -> DataFrame:
    """(ordinal, line): each record in canonical JSON; payload is a struct or JSON text."""
    own = records if dict(records.dtypes)["payload"] == "string" else records.withColumn("payload", F.to_json("payload", {"ignoreNullFields": "false"}))

    @F.pandas_udf("string")
    def line(rows: pd.DataFrame) -> pd.Series:
        held = [{k: (None if pd.isna(v) else v) for k, v in r.items()} for r in rows.to_dict("records")]
        return pd.Series([canonical_json(h | {"payload": json.loads(h["payload"] or "{}")}) for h in held], dtype=str)

    return own.select("ordinal", line(F.struct(*FIELDS)).alias("line"))


def manifest_hash(lines: DataFrame) -> str:
    """sha256 of the canonical JSON array of the records in order, fed line by line: manifests are samples of thousands of rows."""
    digest = hashlib.sha256(b"[")
    for k, row in enumerate(lines.orderBy("ordinal").select("line").toLocalIterator()):
        digest.update((b"," if k else b"") + row[0].encode())
    digest.update(b"]")
    return digest.hexdigest()


def counts(records: DataFrame) -> dict[str, int]:
    held = {r[0]: r[1] for r in records.groupBy("language").count().collect()}
    return dict(sorted(held.items())) | {"total": sum(held.values())}


def write(records: DataFrame, path: str, *, version: str, repo: str, revision: str, split: str, seed: int, preprocessing: dict | None = None, extra: dict | None = None) -> dict:
    """Writes the manifest (columns FIELDS and ordinal), then its sidecar, so that one without the other is no manifest; returns the sidecar."""
    spark = records.sparkSession
    lines = canonical_lines(records)
    lines.orderBy("ordinal").select("line").coalesce(1).write.mode("overwrite").text(path)
    first = records.select("benchmark").first()
    meta = {
        "benchmark": first[0] if first else path.rsplit("/", 1)[-1], "benchmark_version": version, "dataset_revision": revision, "dataset_repo": repo, "split": split, "seed": seed,
        "counts": counts(records), "manifest_hash": manifest_hash(lines), "created_at": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"),
        "preprocessing": preprocessing or {}, "extra": extra or {},
    }
    p, fs = _path(spark, _sidecar(path))
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(meta, ensure_ascii=False, indent=2).encode()))
    out.close()
    return meta


def read_meta(spark: SparkSession, path: str) -> dict:
    if not exists(spark, path):
        raise ManifestError(f"no manifest at {path}")
    return json.loads("\n".join(r[0] for r in spark.read.text(_sidecar(path)).collect()))


def read(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The records (payload as JSON text) with their ordinal; fails if a line is no record or the hash is not the sidecar's."""
    meta = read_meta(spark, path)
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("i")).where("trim(line) <> ''")
    order = Window.orderBy("f", "i")  # a manifest is a sample of thousands of rows
    lines = lines.select("line", F.row_number().over(order).cast("bigint").alias("ordinal"))
    v = F.try_parse_json("line")
    rows = lines.select("ordinal", "line", *[F.try_variant_get(v, f"$.{c}", "string").alias(c) for c in FIELDS])
    bad = rows.where("sample_id is null or benchmark is null or language is null").select(F.min("ordinal")).first()[0]
    if bad is not None:
        raise ManifestError(f"line {bad} of {path} is no record")
    if verify and (found := manifest_hash(lines)) != meta["manifest_hash"]:
        raise ManifestError(f"{path} was changed: its hash is {found[:12]}, not {meta['manifest_hash'][:12]}")
    return rows.drop("line")


def read_all(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame | None]:
    """Every manifest by name, None for one that is missing."""
    return {name: read(spark, p) if exists(spark, p) else None for name, p in paths.items()}


def of_language(records: DataFrame, language: str | None) -> DataFrame:
    return records if language in (None, "all", "both") else records.where(F.col("language") == language)
