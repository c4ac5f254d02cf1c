"""Settings: plain trees, merged from defaults and checked for what they need."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

from ..functions.keys import hash_of


class ConfigError(ValueError):
    """Settings that cannot hold."""


def merged(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``: trees merge, anything else replaces."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def with_defaults(tree: dict) -> dict:
    """Every entry of ``models`` laid on ``defaults``."""
    base = tree.get("defaults", {})
    return {k: v for k, v in tree.items() if k != "defaults"} | {"models": [merged(base, m) for m in tree.get("models", [])]}


def known(kind: type, tree: dict) -> Any:
    """A dataclass from a tree; a key it does not have is an error."""
    if unknown := set(tree) - {f.name for f in fields(kind)}:
        raise ConfigError(f"{kind.__name__} has no {sorted(unknown)}")
    return kind(**tree)


@dataclass(frozen=True)
class Routing:
    """How a provider is chosen; the same model may be served by different ones, so all of it is part of a key."""

    mode: str = "default"
    provider_order: tuple[str, ...] | None = None
    allow_fallbacks: bool = True
    only: tuple[str, ...] | None = None
    ignore: tuple[str, ...] | None = None
    require_parameters: bool = True
    data_collection: str = "allow"
    sort: str | None = None
    quantizations: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        for name, allowed in (("mode", ("default", "pinned", "restricted")), ("data_collection", ("allow", "deny")), ("sort", (None, "price", "throughput", "latency"))):
            if getattr(self, name) not in allowed:
                raise ConfigError(f"routing.{name} is none of {allowed}")
        if self.mode == "pinned" and not self.provider_order:
            raise ConfigError("pinned routing needs a provider_order")
        if self.mode == "restricted" and not (self.only or self.ignore):
            raise ConfigError("restricted routing needs only or ignore")

    def material(self) -> dict[str, Any]:
        """Every setting with its default filled in, an empty list as none, so that one meaning has one hash."""
        return {f.name: (list(v) or None) if isinstance(v := getattr(self, f.name), (list, tuple)) else v for f in fields(self)}

    def payload(self) -> dict[str, Any]:
        """The request's ``provider`` field."""
        lists = {"order": self.provider_order, "only": self.only, "ignore": self.ignore, "quantizations": self.quantizations}
        held: dict[str, Any] = {k: list(v) for k, v in lists.items() if v}
        if self.sort:
            held["sort"] = self.sort
        return held | {k: getattr(self, k) for k in ("allow_fallbacks", "require_parameters", "data_collection")}


@dataclass(frozen=True)
class Reasoning:
    """Thinking, off unless it is asked for. Headroom and the estimate are in no key: the first shows in the output limit, the other is never sent."""

    enabled: bool = False
    effort: str | None = None
    max_tokens: int | None = None
    exclude: bool = True
    output_token_headroom: int = 0
    estimated_output_tokens: int = 0

    def __post_init__(self) -> None:
        if self.effort not in (None, "low", "medium", "high"):
            raise ConfigError("reasoning.effort is low, medium or high")

    def material(self) -> dict[str, Any]:
        return {k: getattr(self, k) for k in ("enabled", "effort", "max_tokens", "exclude")}

    def payload(self) -> dict[str, Any]:
        """The request's ``reasoning`` field; a model that may think is told not to."""
        if not self.enabled:
            return {"enabled": False, "exclude": True}
        return {"enabled": True, "exclude": self.exclude} | {k: v for k in ("effort", "max_tokens") if (v := getattr(self, k))}


@dataclass(frozen=True)
class Model:
    model_id: str
    display_name: str = ""
    vendor: str = ""
    api_provider: str = "openrouter"
    role: str = "benchmark"
    enabled: bool = True
    decisions: bool = False
    reasons: bool = False
    structured_output: bool = False
    prompt_style: str = "chat"
    max_label_tokens: int = 16
    routing: Routing = field(default_factory=Routing)
    reasoning: Reasoning = field(default_factory=Reasoning)
    routing_config_hash: str = ""
    supported_parameters: tuple[str, ...] = ()
    input_per_million: float | None = None
    output_per_million: float | None = None
    cached_input_per_million: float | None = None

    def __post_init__(self) -> None:
        if "/" not in self.model_id:
            raise ConfigError(f"{self.model_id!r} has no vendor before a slash")
        if self.prompt_style not in ("chat", "state"):
            raise ConfigError("prompt_style is chat or state")
        for name, kind in (("routing", Routing), ("reasoning", Reasoning)):
            if isinstance(tree := getattr(self, name), dict):
                object.__setattr__(self, name, known(kind, {k: tuple(v) if isinstance(v, list) else v for k, v in tree.items()}))
        if self.reasons and not self.reasoning.enabled:
            object.__setattr__(self, "reasoning", replace(self.reasoning, enabled=True))
        if not self.routing_config_hash:
            object.__setattr__(self, "routing_config_hash", hash_of(self.routing.material()))


@dataclass(frozen=True)
class Settings:
    """What results depend on; the fixed values are the published runs'."""

    seed: int = 20240917
    benchmark_version: str = "1.0.0"
    batch_size: int = 20
    summary_source_tokens: int = 1800
    judged_source_tokens: int = 1600
    output_tokens: dict[str, int] = field(default_factory=lambda: {"summarization": 200, "hallucination": 8, "classification": 320})
    reasoning_headroom: int = 2048
    output_ceiling: int = 4096
    temperature: float | None = 0.0
    top_p: float | None = 1.0
    request_seed: int | None = None
    budget_usd: float = 1.0
    stop_margin: float = 0.98
    max_consecutive_failures: int = 10
    max_failure_rate: float = 0.5
    attempts_before_rate: int = 20
    max_attempts: int = 4
    initial_backoff: float = 1.0
    longest_backoff: float = 30.0
    backoff_jitter: float = 0.5
    reconciliation_usd: float = 5e-6
    reconciliation_relative: float = 0.02
    judge_samples: int = 100

    def __post_init__(self) -> None:
        if self.batch_size < 1 or self.budget_usd < 0:
            raise ConfigError("a batch holds one item or more and a budget is not negative")


def parsed(text: str) -> dict:
    """A tree from YAML, or from JSON where PyYAML is absent."""
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text)
    return yaml.safe_load(text)


def load(text: str) -> dict:
    """A settings tree with its defaults laid under every model."""
    return with_defaults(parsed(text))


def by_id(models: list[Model], model_id: str) -> Model:
    for m in models:
        if m.model_id == model_id:
            return m
    raise ConfigError(f"no model {model_id!r}")


def slug(model_id: str) -> str:
    """A model's name as a file name."""
    return model_id.replace("/", "__")


def load_folder(path: str) -> dict:
    """The settings trees of a folder's .yaml, .yml and .json files, merged in order of their names, with defaults laid under every model."""
    import pathlib

    tree: dict = {}
    for f in sorted(x for x in pathlib.Path(path).iterdir() if x.suffix in (".yaml", ".yml", ".json")):
        tree = merged(tree, parsed(f.read_text(encoding="utf-8")))
    return with_defaults(tree)
