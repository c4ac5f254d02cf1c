"""What a run's results depend on, gathered into its summary: settings, manifests, versions, code; and what differs between runs."""

from __future__ import annotations

import platform
import subprocess
import sys
from importlib import metadata
from pathlib import Path

from ..functions import keys
from . import tasks
from .config import Model, Settings
from .evaluators import Registry

PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")


def code_commit(root: str | Path | None = None) -> tuple[str | None, bool | None]:
    """The commit of the code and whether it was changed since; nulls where git says nothing."""
    where = str(root or Path(__file__).resolve().parents[2])

    def said(*args: str) -> str | None:
        try:
            out = subprocess.run(["git", "-C", where, *args], capture_output=True, text=True, timeout=5, check=False)
        except (OSError, subprocess.SubprocessError):
            return None
        return out.stdout.strip() if out.returncode == 0 else None

    changed = said("status", "--porcelain")
    return said("rev-parse", "HEAD") or None, None if changed is None else bool(changed)


def packages() -> dict[str, str]:
    out = {}
    for name in PACKAGES:
        try:
            out[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            out[name] = "not-installed"
    return out


def block(model: Model, settings: Settings, manifests: dict[str, dict | None], evaluators: Registry, executed_at: str, prices: dict | None = None) -> dict:
    """The block ``reproducibility`` of a summary; ``manifests`` has the sidecar of each manifest, or null.

    fingerprint is a hash of all that results depend on, and of nothing else: not of the machine, the time, prices or the code's commit.
    """
    commit, changed = code_commit()
    held = {
        "model_id": model.model_id, "api_provider": model.api_provider, "routing_config": model.routing.material(), "routing_config_hash": model.routing_config_hash,
        "reasoning_config": model.reasoning.material(), "generation": {"temperature": settings.temperature, "top_p": settings.top_p, "seed": settings.request_seed, "output_tokens": settings.output_tokens},
        "truncation_policy": {"summary_source_tokens": settings.summary_source_tokens, "judged_source_tokens": settings.judged_source_tokens}, "benchmark_version": settings.benchmark_version, "prompt_versions": {b: tasks.VERSION for b in sorted({b for b, _ in tasks.TEMPLATES})},
        "metric_versions": {e.name: {"version": e.version, "config_hash": e.settings_hash()} for e in evaluators.chosen()},
        "manifests": {k: None if m is None else {"hash": m["manifest_hash"], "dataset_revision": m.get("dataset_revision"), "counts": m["counts"]} for k, m in sorted(manifests.items())},
    }
    return {
        **held, "fingerprint": keys.hash_of(held), "executed_at": executed_at, "git_commit": commit, "git_dirty": changed, "python_version": sys.version.split()[0],
        "platform": platform.platform(), "packages": packages(), "pricing_snapshot": prices,
    }


#: What may differ between runs whose results can be compared.
FREE = ("fingerprint", "executed_at", "git_commit", "git_dirty", "python_version", "platform", "packages", "pricing_snapshot", "model_id", "api_provider", "routing_config", "routing_config_hash", "reasoning_config")


def differences(one: dict, other: dict, free: tuple[str, ...] = FREE) -> dict[str, tuple]:
    """Paths at which two blocks differ, with both values; what may differ is left out."""

    def walk(a: object, b: object, path: str) -> dict[str, tuple]:
        if isinstance(a, dict) and isinstance(b, dict):
            out: dict[str, tuple] = {}
            for k in sorted({*a, *b}, key=str):
                out |= walk(a.get(k), b.get(k), f"{path}.{k}" if path else str(k))
            return out
        return {} if a == b else {path: (a, b)}

    return walk({k: v for k, v in one.items() if k not in free}, {k: v for k, v in other.items() if k not in free}, "")
