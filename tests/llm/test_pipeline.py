import corpus_pipeline as p
from marlstone.llm import decontamination, pii, quality_rules, simhash


def test_stages_follow_each_other(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(p.STAGES) <= 5
    first = p.quality_stage(spark, docs, sf).cache()
    kept = {r["doc_id"] for r in quality_rules.op6_quality_rules(spark, sf).where("kept").collect()}
    assert {r["doc_id"] for r in first.collect()} == kept and first.columns == docs.columns
    second = p.dedup_stage(spark, first, sf).cache()
    groups = simhash.near_duplicates(first).groupBy("component_id").count().count()
    assert second.count() == groups and second.columns == docs.columns
    third = p.decontamination_stage(spark, second, sf).cache()
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not [r for r in third.collect() if any(x in r["text"] for x in items)] and third.columns == docs.columns
    leaks = decontamination.leaks(second, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert second.count() - third.count() == leaks.select("_k1").distinct().count()
    fourth = p.pii_stage(spark, third, sf).cache()
    assert fourth.columns == docs.columns and fourth.count() == third.count()
    assert pii.with_spans(fourth).where("size(_pii) > 0").count() == 0
    assert fourth.where("n_chars <> length(text)").count() == 0
    last = p.tokens_stage(spark, fourth, sf)
    assert last.count() == fourth.count() and last.where("not round_trip").count() == 0


def test_run_ends_in_tokens(spark):
    assert p.run(spark, "/root/testdata/sf0.001").where("n_tokens > 0").count() > 0


def test_entry_lists_all(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names


ODD = "doc_id bigint, text string, source string, lang string, url string, n_chars bigint, _q string, _pii string, row string"


def odd_rows(spark):
    whole = " ".join(f"word{k} of a plain text" for k in range(40))
    other = " ".join(f"unlike{k * k} and quite another" for k in range(40))
    texts = [(1, None), (2, ""), (3, whole), (3, whole), (4, whole), (None, other), (None, None), (5, "short"), (6, whole + " mail ann@example.org"), (7, "é\U0001f600 " * 20_000)]
    return spark.createDataFrame([(i, t, "s", "en", None, len(t or ""), "q", "p", "r") for i, t in texts], ODD), whole, other


def test_stages_on_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs, whole, other = odd_rows(spark)
    # What each stage keeps of nulls, empty and very long texts, repeated rows and columns of clashing names.
    first = p.quality_stage(spark, docs, sf)
    assert first.columns == docs.columns and not [r for r in first.collect() if not r["text"] or r["text"] == "short"]
    second = p.dedup_stage(spark, docs, sf)
    got = [(r["doc_id"], r["text"]) for r in second.collect()]
    assert second.columns == docs.columns and len([t for _, t in got if t and t.startswith(whole)]) == 1 and (3, whole) in got and len([t for _, t in got if t == other]) == 1
    third = p.decontamination_stage(spark, docs, sf)
    assert third.columns == docs.columns and third.count() == docs.count()
    fourth = p.pii_stage(spark, docs, sf).collect()
    assert len(fourth) == docs.count() and not [r for r in fourth if "ann@example.org" in (r["text"] or "")]
    assert all(r["n_chars"] == len(r["text"]) for r in fourth if r["text"] is not None)
    last = p.tokens_stage(spark, docs, sf).collect()
    assert len(last) == docs.count() and all(r["round_trip"] for r in last)


def test_stages_on_an_empty_table(spark):
    docs = odd_rows(spark)[0].limit(0)
    for name, stage in p.STAGES:
        got = stage(spark, docs, "/root/testdata/sf0.001")
        assert got.count() == 0 and (name == p.STAGES[-1][0] or got.columns == docs.columns)
