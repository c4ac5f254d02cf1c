"""Capability groups, expanded key material, and what a run's results depend on."""

import json

import pytest

from marlstone.functions import keys
from marlstone.plans import capabilities, config, evaluators, provenance
from marlstone.plans.config import ConfigError, Model, Reasoning, Routing

SHAPE = "model_id string, configured array<string>, sending array<string>, structured boolean"


def verdicts(spark, rows, listed):
    listing = spark.createDataFrame(listed, "model_id string, supported_parameters array<string>")
    return {r["model_id"]: r for r in capabilities.preflight(spark.createDataFrame(rows, SHAPE), listing).collect()}


def test_any_name_of_a_group_stands_for_the_parameter(spark):
    rows = [("v/a", ["reasoning", "seed", "stop"], ["reasoning", "seed"], False), ("v/b", ["reasoning"], ["reasoning"], False), ("v/c", [], [], False)]
    got = verdicts(spark, rows, [("v/a", ["Reasoning_Effort", "top_p"]), ("v/b", ["tools"]), ("v/b", ["include_reasoning"]), ("v/c", ["reasoning", "include_reasoning"])])
    assert got["v/a"]["blocking"] == ["seed"] and sorted(got["v/a"]["informational"]) == ["stop", "top_p"] and got["v/a"]["checked"]
    assert got["v/b"]["blocking"] == [] and got["v/c"]["warnings"] == ["reasoning"] and got["v/c"]["blocking"] == []


def test_what_is_not_listed_is_not_checked_but_a_schema_still_blocks(spark):
    rows = [("v/a", ["seed"], ["seed"], False), ("v/b", ["seed"], ["seed"], False), ("v/c", ["response_format"], [], True), ("v/d", ["response_format", "structured_outputs"], ["structured_outputs"], True)]
    got = verdicts(spark, rows, [("v/b", []), ("v/e", ["seed"]), ("v/d", ["response_format"])])
    assert (got["v/a"]["checked"], got["v/a"]["reason"], got["v/a"]["blocking"]) == (False, "v/a is not listed", [])
    assert got["v/b"]["reason"] == "the listing has no parameters" and got["v/c"]["blocking"] == ["structured_outputs"]
    assert got["v/d"]["blocking"] == ["structured_outputs"] and got["v/d"]["reason"] is None


def test_a_run_is_refused_before_anything_is_asked(spark, tmp_path):
    listing = spark.createDataFrame([("v/m", ["top_p"])], "model_id string, supported_parameters array<string>")
    own = Model("v/m", supported_parameters=("temperature", "top_p"))
    with pytest.raises(capabilities.CapabilityError, match="temperature"):
        capabilities.check(spark, own, config.Settings(), listing, False)
    assert capabilities.check(spark, own, config.Settings(temperature=None), listing, False)["informational"] == ["temperature"]
    assert capabilities.sending(own, config.Settings(request_seed=1), False) == ["temperature", "top_p"]


def test_one_meaning_has_one_hash():
    golden = '{"allow_fallbacks":true,"data_collection":"allow","ignore":null,"mode":"default","only":null,"provider_order":null,"quantizations":null,"require_parameters":true,"sort":null}'
    assert keys.canonical_json(Routing().material()) == golden
    plain = Model("v/m")
    assert plain.routing_config_hash == keys.hash_of(json.loads(golden)) != ""
    for tree in ({}, {"mode": "default"}, {"only": []}, {"sort": None, "allow_fallbacks": True}):
        assert Model("v/m", routing=tree).routing_config_hash == plain.routing_config_hash
    for tree in ({"allow_fallbacks": False}, {"mode": "pinned", "provider_order": ["x"]}, {"only": ["x"]}, {"sort": "price"}):
        assert Model("v/m", routing=tree).routing_config_hash != plain.routing_config_hash
    for bad in ({"mode": "pinned"}, {"mode": "restricted"}, {"mode": "other"}, {"nonsense": 1}, {"sort": "name"}):
        with pytest.raises(ConfigError):
            Model("v/m", routing=bad)


def test_payloads_and_reasoning():
    assert Routing(provider_order=("a",), sort="price").payload() == {"order": ["a"], "sort": "price", "allow_fallbacks": True, "require_parameters": True, "data_collection": "allow"}
    assert Reasoning().payload() == {"enabled": False, "exclude": True}
    assert Reasoning(enabled=True, effort="low", output_token_headroom=9).payload() == {"enabled": True, "exclude": True, "effort": "low"}
    assert Reasoning(output_token_headroom=5).material() == Reasoning().material()
    assert Model("v/m", reasons=True).reasoning.enabled and not Model("v/m").reasoning.enabled
    with pytest.raises(ConfigError):
        Reasoning(effort="huge")


def test_a_changed_default_changes_the_key(spark):
    from marlstone.plans import tasks

    rows = spark.createDataFrame([("t", ["s"], "en", "r", "test", "h", "sys", "user")], "task_id string, sample_ids array<string>, language string, dataset_revision string, split string, sample_content_hash string, system_prompt string, user_prompt string")
    key = lambda model, **s: tasks.make(rows, model, config.Settings(**s), "summarization").first()["cache_key"]
    base = key(Model("v/m"))
    assert base == key(Model("v/m", routing={"only": []}, display_name="x", input_per_million=3.0))
    assert len({base, key(Model("v/m", routing={"only": ["p"]})), key(Model("v/m", reasoning={"effort": "low"})), key(Model("v/m"), request_seed=4), key(Model("v/m", api_provider="local"))}) == 5


def test_provenance(spark):
    own = lambda model="v/m", settings=None, manifest="h1", at="t1": provenance.block(Model(model), settings or config.Settings(), {"hallucination:en": {"manifest_hash": manifest, "dataset_revision": "r", "counts": {"total": 3}}, "x": None}, evaluators.standard(), at)
    a = own()
    assert a["fingerprint"] == own(at="t2")["fingerprint"] and a["manifests"]["x"] is None and a["packages"]["pyspark"] and len(a["git_commit"] or "0" * 40) == 40
    assert provenance.differences(a, own(model="v/n", at="t2")) == {}
    assert provenance.differences(a, own(manifest="h2")) == {"manifests.hallucination:en.hash": ("h1", "h2")}
    other = own(settings=config.Settings(temperature=0.5))
    assert other["fingerprint"] != a["fingerprint"] and provenance.differences(a, other) == {"generation.temperature": (0.0, 0.5)}
