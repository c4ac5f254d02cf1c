"""Inference as a source of rows: a backend turns tasks into responses. The stub needs no network and answers the same each time."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.responses import normalized


class DryRunViolation(RuntimeError):
    """A dry run asked for inference."""


class Backend(Protocol):
    def respond(self, task: dict) -> dict: ...


class Stub:
    """Replies by the hash of the key: a label, numbered answers, JSON scores, or the prompt's last sentence; every ``fails``-th case fails."""

    def __init__(self, labels: int = 4, fails: int = 0, price: float = 1e-6):
        self.labels, self.fails, self.price = labels, fails, price

    def pause(self, seconds: float) -> None:
        """Nothing is gained by waiting for a stub."""

    def respond(self, task: dict) -> dict:
        n = int(hashlib.sha256(task["cache_key"].encode()).hexdigest()[:8], 16)
        if self.fails and n % self.fails == 0:
            return {"error": {"code": 500, "message": "stub failure"}}
        match task["benchmark"]:
            case "hallucination" | "classification" if task.get("request"):
                return self._typed(task, n)
            case "hallucination":
                said = ("SUPPORTED", "HALLUCINATED")[n % 2]
            case "classification":
                said = "\n".join(f"{i + 1}: {(n >> i) % self.labels + 1}" for i in range(int(task["cases"])))
            case "judge":
                said = json.dumps({d: n % 5 + 1 for d in ("factual_consistency", "key_information_coverage", "conciseness", "overall_quality")} | {"rationale": "stub"})
            case _:
                said = task["user_prompt"].rstrip().rsplit(". ", 1)[-1][:400]
        return self._message(task, n, said)

    def _message(self, task: dict, n: int, said: str) -> dict:
        used = {"prompt_tokens": int(task["est_input_tokens"]), "completion_tokens": len(said) // 4 + 1}
        cost = self.price * sum(used.values())
        return {"id": f"stub-{n}", "model": task["model_id"], "provider": "stub", "choices": [{"index": 0, "finish_reason": "stop", "message": {"role": "assistant", "content": said}}], "usage": used | {"cost": cost}}

    def _typed(self, task: dict, n: int) -> dict:
        """A reply in the shape that the request asks for: a choice, a JSON object, or a bare label."""
        asked = json.loads(task["request"])
        if "questions" in asked:
            options = list(asked["questions"]["answer"]["criteria"])
            used = {"input_tokens": int(task["est_input_tokens"]), "output_tokens": 1, "cost": self.price * (int(task["est_input_tokens"]) + 1)}
            return {"id": f"stub-{n}", "model": task["model_id"], "provider": "stub", "answers": {"answer": {"choice": options[n % len(options)]}}, "usage": used}
        if "candidates" in asked:
            return self._message(task, n, asked["candidates"][n % len(asked["candidates"])])
        labels = asked["response_format"]["json_schema"]["schema"]["properties"]["answers"]["items"]["enum"]
        return self._message(task, n, json.dumps({"answers": [labels[(n >> i) % len(labels)] for i in range(int(task["cases"]))]}))


BACKENDS = {"stub": Stub}


# Statuses of a reply that are worth another try.
RETRYABLE = {408, 409, 425, 429, 500, 502, 503, 504, 520, 522, 524}


def wait(attempt: int, initial: float, longest: float, jitter: float, retry_after: float | None = None) -> float:
    """Seconds before the next try: what the server asks for, else doubled each time and spread at random; never more than ``longest`` and the spread."""
    return min(retry_after, longest) if retry_after is not None else min(initial * 2 ** (attempt - 1), longest) + random.uniform(0, jitter)


def ask(tasks: DataFrame, backend: Backend, run_id: str, most: int = 1, delays: tuple[float, float, float] = (1.0, 30.0, 0.5), parallel: int = 8) -> DataFrame:
    """A row for each attempt, in the columns of inference_results, with attempt_no and ``last``.

    A reply with a retryable status is asked for again, ``most`` times in all. At most ``parallel`` tasks call the backend at once.
    Every evaluation of the result asks again, so write it before it is used twice.
    """
    names = [f.name for f in tasks.schema.fields]

    def tried(task: dict) -> Iterator[tuple[int, str, float, bool]]:
        for n in range(1, most + 1):
            began = time.perf_counter()
            reply = backend.respond(task)
            error = reply.get("error")
            code = error.get("code") if isinstance(error, dict) else None
            last = n == most or not str(code).isdigit() or int(code) not in RETRYABLE
            yield n, json.dumps(reply), 1e3 * (time.perf_counter() - began), last
            if last:
                return
            getattr(backend, "pause", time.sleep)(wait(n, *delays, retry_after=error.get("retry_after")))

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for task in frame.to_dict("records"):
                rows = [(task["cache_key"], *x) for x in tried(task)]
                yield pd.DataFrame(rows, columns=["cache_key", "attempt_no", "raw_response_json", "latency_ms", "last"])

    asked = tasks.select("cache_key", "benchmark", "model_id", "cases", "user_prompt", "est_input_tokens", *[c for c in names if c == "request"]).repartition(parallel)
    replies = asked.mapInPandas(call, "cache_key string, attempt_no bigint, raw_response_json string, latency_ms double, last boolean")
    own = normalized(replies.join(tasks.select(*[n for n in names if n != "error"]), "cache_key"))
    return own.withColumns({"run_id": F.lit(run_id), "requested_model": F.col("model_id"), "attempts": F.col("attempt_no"), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})


def infer(tasks: DataFrame, backend: Backend, run_id: str, dry_run: bool = False, parallel: int = 8) -> DataFrame:
    """Responses of the tasks as rows of inference_results, each asked for once."""
    if dry_run:
        raise DryRunViolation("inference in a dry run")
    return ask(tasks, backend, run_id, parallel=parallel).where("last").drop("last", "attempt_no")
