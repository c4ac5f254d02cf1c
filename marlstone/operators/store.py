"""The store: append-only Parquet tables, their schemas, and last-wins reads.

A write appends, and a read takes one row for each key, so runs on many
machines never rewrite each other's files and a run that was lost can be
repeated.

A table's rows lie in the folder of a version. ``compact`` and ``delete`` write
a new version whole and then add a pointer to it: a small file, numbered, that is created once
and never changed. The pointer with the greatest number says which version is
read. A rewrite that is cut short at any step leaves the old version current
and whole, and readers that began on it go on reading it, until ``vacuum`` removes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables' columns.
SCHEMAS = {
    "models": "model_id string, display_name string, vendor string, api_provider string, role string, config_json string, routing_config_hash string, created_at timestamp",
    "benchmarks": "name string, version string, manifest_hash string, language string, dataset_revision string, manifest_path string, sample_count bigint, created_at timestamp",
    "samples": "benchmark_id string, sample_id string, language string, split string, dataset_revision string, source_hash string, reference_hash string, label string, payload_json string",
    "runs": (
        "run_id string, model_id string, benchmarks array<string>, languages array<string>, status string, dry_run boolean, budget_usd double, fresh_cost_usd double, "
        "judge_cost_usd double, api_calls bigint, cache_hits bigint, cache_misses bigint, config_json string, environment_json string, git_commit string, "
        "benchmark_version string, started_at timestamp, finished_at timestamp, notes string"
    ),
    "inference_attempts": (
        "run_id string, cache_key string, model_id string, benchmark string, sample_id string, attempt_no bigint, status string, request_id string, resolved_model string, "
        "upstream_provider string, http_status bigint, prompt_tokens bigint, cached_tokens bigint, cache_write_tokens bigint, completion_tokens bigint, reasoning_tokens bigint, "
        "total_tokens bigint, usage_cost double, latency_ms double, error string, created_at timestamp"
    ),
    "inference_results": (
        "cache_key string, run_id string, api_provider string, model_id string, requested_model string, resolved_model string, upstream_provider string, routing_config_hash string, "
        "benchmark string, benchmark_version string, dataset_revision string, split string, sample_id string, language string, sample_content_hash string, status string, "
        "output_text string, finish_reason string, request_id string, prompt_tokens bigint, cached_tokens bigint, cache_write_tokens bigint, completion_tokens bigint, "
        "reasoning_tokens bigint, total_tokens bigint, usage_cost double, usage_json string, raw_response_json string, key_material_json string, attempts bigint, "
        "latency_ms double, error string, created_at timestamp, updated_at timestamp"
    ),
    "metric_results": (
        "metric_cache_key string, inference_result_hash string, model_id string, benchmark string, language string, scope string, evaluator string, evaluator_version string, "
        "evaluator_config_hash string, reference_hash string, value_json string, created_at timestamp"
    ),
    "pricing_snapshots": "id bigint, model_id string, input_per_million double, output_per_million double, cached_input_per_million double, retrieved_at timestamp, source string, raw_json string",
    "judge_results": (
        "cache_key string, run_id string, judge_model string, judge_profile string, target_model string, benchmark string, sample_id string, language string, status string, "
        "self_judge boolean, scores_json string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, usage_cost double, raw_response_json string, "
        "key_material_json string, latency_ms double, error string, created_at timestamp"
    ),
}
KEYS = {
    "models": ["model_id"],
    "benchmarks": ["name", "version", "manifest_hash"],
    "samples": ["benchmark_id", "sample_id"],
    "runs": ["run_id"],
    "inference_results": ["cache_key"],
    "metric_results": ["metric_cache_key"],
    "judge_results": ["cache_key"],
}


def last_wins(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row for each key, that with the greatest order; a max_by aggregate, so a key's rows are reduced before the shuffle."""
    columns = rows.columns
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select("_r.*")


def sticky_success(rows: DataFrame, key: str = "cache_key", order: list[str | Column] | None = None) -> DataFrame:
    """One row for each key: the last success if there is one, else the last row. A failure never replaces a success."""
    return last_wins(rows, [key], [(F.col("status") == "SUCCESS").alias("ok"), *(order or ["updated_at"])])


def absent(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet, each key once."""
    return rows.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


#: The folder of a table's first version, and that of the pointers.
FIRST, POINTERS = "v0000000000", "_versions"


@dataclass(frozen=True)
class Version:
    """A table's version: its pointer's number, its folder, the folder that it was made from, and the files of that one which went into it."""

    number: int
    folder: str
    previous: str = ""
    taken: tuple[str, ...] = ()


class ConcurrentRewrite(RuntimeError):
    """Another rewrite of the table came first."""


class Store:
    """Tables under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        path, fs = self._hadoop(name)
        return fs.exists(path)

    def _children(self, name: str) -> list[str]:
        path, fs = self._hadoop(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def version(self, name: str) -> Version:
        """What is read now: the version of the last pointer that was written whole."""
        if name in SCHEMAS:
            self.repair(name)
        numbers = sorted((int(x) for x in self._children(f"{name}/{POINTERS}") if x.isdigit()), reverse=True)
        for n in numbers:
            path, fs = self._hadoop(f"{name}/{POINTERS}/{n:010d}")
            stream = fs.open(path)
            said = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if said.endswith("\n"):
                folder, previous, *taken = said.split()
                return Version(numbers[0], folder, previous, tuple(taken))
        return Version(numbers[0] if numbers else 0, FIRST)

    def _files(self, name: str, version: Version) -> list[str]:
        """The version's files, with those that were appended to the one before when its rewrite had already looked."""
        here = [f"{version.folder}/{x}" for x in self._children(f"{name}/{version.folder}") if x.startswith("part-")]
        late = [f"{version.previous}/{x}" for x in self._children(f"{name}/{version.previous}") if x.startswith("part-")] if version.previous else []
        return here + [x for x in late if x.rpartition("/")[2] not in version.taken]

    def _read(self, name: str, files: list[str]) -> DataFrame:
        schema = f"{SCHEMAS[name]}, written_at timestamp"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{x}" for x in files]) if files else self.spark.createDataFrame([], schema)

    def all_rows(self, name: str) -> DataFrame:
        """Every row of the current version, with written_at."""
        return self._read(name, self._files(name, self.version(name)))

    def rows(self, name: str) -> DataFrame:
        """The current rows."""
        return self._current(name, self.all_rows(name))

    def _current(self, name: str, own: DataFrame) -> DataFrame:
        if name == "inference_results":
            return sticky_success(own, order=["updated_at", "written_at"]).drop("written_at")
        return last_wins(own, KEYS[name], ["written_at"]).drop("written_at") if name in KEYS else own.drop("written_at")

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows in the table's columns; those that are missing are null."""
        fields = [f.split()[0] for f in _fields(SCHEMAS[name])]
        kinds = dict(f.split(None, 1) for f in _fields(SCHEMAS[name]))
        own = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in fields])
        own.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/{name}/{self.version(name).folder}")

    def add_absent(self, name: str, rows: DataFrame) -> int:
        """Rows with new keys; how many there were."""
        new = absent(rows, self.rows(name), KEYS[name])
        n = new.count()
        if n:
            self.append(name, new)
        return n

    def delete(self, name: str, keys: DataFrame) -> None:
        """Rewrites the table without these keys."""
        self._rewrite(name, lambda rows: rows.join(keys, KEYS[name], "left_anti"))

    def compact(self, name: str) -> None:
        self._rewrite(name, lambda rows: self._current(name, rows).withColumn("written_at", F.current_timestamp()))

    def _hadoop(self, name: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _rewrite(self, name: str, make: Callable[[DataFrame], DataFrame]) -> None:
        """Writes ``make`` of the current rows as the next version and points to it.

        The pointer names the files that were read, so that rows which others
        append meanwhile still count: readers take the files of the version
        before that the rewrite had not seen. Of two rewrites at once the first to
        set its pointer wins and the other raises ConcurrentRewrite, having changed nothing.
        """
        old = self.version(name)
        files = self._files(name, old)
        folder = f"v{old.number + 1:010d}_{uuid.uuid4().hex}"
        make(self._read(name, files)).write.parquet(f"{self.path}/{name}/{folder}")
        self._point(name, old.number + 1, [folder, old.folder, *[x.rpartition("/")[2] for x in files if x.startswith(f"{old.folder}/")]])

    def _point(self, name: str, number: int, said: list[str]) -> None:
        """Makes a folder the current version. The file system lets one writer create a number; one cut short before its last line end doesn't count."""
        path, fs = self._hadoop(f"{name}/{POINTERS}/{number:010d}")
        try:
            stream = fs.create(path, False)
        except Exception as e:
            raise ConcurrentRewrite(f"another rewrite of {name} came first") from e
        stream.write(bytearray(("\n".join(said) + "\n").encode()))
        stream.close()

    def vacuum(self, name: str) -> list[str]:
        """Removes the folders of other versions, those of rewrites that were cut short too; what was removed. Call it when nobody reads, appends to or rewrites the table."""
        now = self.version(name)
        if any(not x.startswith(f"{now.folder}/") for x in self._files(name, now)):
            self._rewrite(name, lambda rows: rows)
            now = self.version(name)
        gone = [x for x in self._children(name) if x not in (now.folder, POINTERS)]
        for x in gone:
            path, fs = self._hadoop(f"{name}/{x}")
            fs.delete(path, True)
        return gone

    def repair(self, name: str) -> None:
        """Puts back a table that an earlier layout had moved aside when its rewrite was cut short; done whenever a table is opened."""
        now, fs = self._hadoop(name)
        for end in (".new", ".old"):
            left, _ = self._hadoop(name + end)
            if not fs.exists(now) and fs.exists(left) and (end == ".old" or self._exists(f"{name}.new/_SUCCESS")):
                fs.rename(left, now)
        own, _ = self._hadoop(f"{name}/{FIRST}")
        flat = [x for x in self._children(name) if x.startswith("part-")]
        if flat:  # files of the earlier layout lie beside the versions' folders
            fs.mkdirs(own)
            for x in flat:
                fs.rename(self._hadoop(f"{name}/{x}")[0], self._hadoop(f"{name}/{FIRST}/{x}")[0])

    # --- replies that are not in the tables yet ---

    def stage(self, label: str, rows: DataFrame) -> DataFrame:
        """Writes replies once, as they were paid for, and reads them back."""
        rows.write.mode("overwrite").parquet(f"{self.path}/staged/{label}")
        return self.spark.read.parquet(f"{self.path}/staged/{label}")

    def settle(self) -> int:
        """Moves staged replies into results and attempts, those of an earlier run that was lost too; how many folders there were.

        All folders are read at once, so a run of many waves appends once. They are deleted when their rows are in both tables; rows that are there already are not added again.
        """
        top, fs = self._hadoop("staged")
        labels = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        if whole := [f"{self.path}/staged/{x}" for x in labels if self._exists(f"staged/{x}/_SUCCESS")]:
            rows = self.spark.read.option("mergeSchema", True).parquet(*whole)
            for name, own, key in (("inference_results", rows.where("last"), ["run_id", "cache_key"]), ("inference_attempts", rows, ["run_id", "cache_key", "attempt_no"])):
                self.append(name, own.join(self.all_rows(name).select(*key).distinct(), key, "left_anti"))
        for label in labels:
            fs.delete(self._hadoop(f"staged/{label}")[0], True)
        return len(labels)

    # --- reads by key and lists ---

    def result(self, cache_key: str, successful: bool = False) -> dict | None:
        """The current result of a key, or null; of successes alone if asked for."""
        own = self.rows("inference_results").where(F.col("cache_key") == cache_key)
        row = (own.where("status = 'SUCCESS'") if successful else own).first()
        return row.asDict() if row else None

    def one(self, name: str, **key: object) -> dict | None:
        """The current row of a table under its key, or null."""
        own = self.rows(name)
        for k, v in key.items():
            own = own.where(F.col(k) == v)
        row = own.first()
        return row.asDict() if row else None

    def listed(self, name: str, **wanted: object) -> DataFrame:
        """Current rows with these values; a value that is None is not asked for, a list stands for any of its values."""
        own = self.rows(name)
        for k, v in wanted.items():
            if v is not None:
                own = own.where(F.col(k).isin(*v) if isinstance(v, (list, tuple)) else F.col(k) == v)
        return own

    def finish_run(self, run_id: str, **changes: object) -> None:
        """A new version of the run's row; finished_at is now if it was null."""
        own = self.rows("runs").where(F.col("run_id") == run_id).withColumns({k: F.lit(v) for k, v in changes.items()})
        self.append("runs", own.withColumn("finished_at", F.coalesce("finished_at", F.current_timestamp())))

    def clear_failed(self, model: str | None = None, benchmark: str | None = None) -> int:
        own = self.rows("inference_results").where("status <> 'SUCCESS'")
        own = own.where(F.col("model_id") == model) if model else own
        own = own.where(F.col("benchmark") == benchmark) if benchmark else own
        keys = own.select("cache_key").persist()
        n = keys.count()
        if n:
            self.delete("inference_results", keys)
        keys.unpersist()
        return n


def _fields(schema: str) -> list[str]:
    return [x.strip() for x in schema.split(", ")]
