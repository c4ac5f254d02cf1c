import math

import pytest
from pyspark.sql import functions as F

from marlstone.functions import facts, keys, parsers, similarity, text


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first()[0]


@pytest.mark.parametrize("said", ["", None, "hello world", "한국어 문장입니다.", "漢字かな", "a\nb\n", "é ü ñ", "   x"])
def test_token_estimate_equals_its_python_form(spark, said):
    assert one(spark, said, text.token_estimate) == text.estimate_of(said or "")


@pytest.mark.parametrize(("said", "want"), [("plain words", "latin"), ("한국어 텍스트", "ko"), ("漢字と仮名", "cjk"), ("", "latin"), (None, "latin")])
def test_script_profile(spark, said, want):
    assert one(spark, said, text.script_profile) == want


def test_sentences(spark):
    assert one(spark, "One. Two!  Three?\nFour。 다섯. ", text.sentences) == ["One.", "Two!", "Three?", "Four。", "다섯."]
    assert one(spark, "  ", text.sentences) == []


def test_tokens():
    assert text.tokens_of("GDP rose 3.5% in 2024, 한국 ok") == ["gdp", "rose", "3.5", "in", "2024", "한", "국", "ok"]


def test_truncation():
    said = "word " * 400
    cut, was = text.truncated(said, 50)
    assert was and text.estimate_of(cut) <= 50 and not cut.endswith(" ") and said.startswith(cut)
    assert text.truncated("short", 50) == ("short", False)
    assert text.truncated(None, 0) == ("", False)


@pytest.mark.parametrize(("said", "want"), [("I'm sorry, I can't do that.", True), ("죄송합니다", True), ("", False), ("A fine summary.", False), ("I'm sorry. " + "word " * 400, False), (None, False)])
def test_refusal(spark, said, want):
    assert one(spark, said, text.is_refusal) is want


def test_particles(spark):
    assert one(spark, "서울에서는", text.strip_particle) == "서울"
    assert one(spark, "나는", text.strip_particle) == "나는"


def test_broken_start_and_edits():
    assert text.broken_start("럼프 대통령과", "트럼프 대통령과 만났다")
    assert not text.broken_start("트럼프 대통령", "트럼프 대통령과 만났다")
    assert text.kind_of_edit("따라 사들이", "따라 보험 사들이") == "omission"
    assert text.kind_of_edit("ab cd", "ab") == "extraneous"
    assert text.kind_of_edit("10명", "20명") == "alteration"
    assert text.kind_of_edit("", "x") == "unknown"


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("SUPPORTED", "SUPPORTED"), ("Label: hallucinated.", "HALLUCINATED"), ("SUPPORTED or HALLUCINATED", "HALLUCINATED"), ("HALLUCINATED vs SUPPORTED, hm", None),
        ("yes", "SUPPORTED"), ("No", "HALLUCINATED"), ("뒷받침되지 않습니다", "HALLUCINATED"), ("뒷받침됩니다", "SUPPORTED"), ("", None), (None, None), ("maybe", None),
    ],
)
def test_hallucination_label(spark, said, want):
    assert one(spark, said, parsers.hallucination_label) == want


@pytest.mark.parametrize(
    ("said", "size", "labels", "want"),
    [
        ("1: 3\n2: 7\n3: 1", 3, 10, [2, 6, 0]), ("- 1. 4\n2) 2", 3, 10, [3, 1, None]), ("1: 99\n2: 2", 2, 4, [None, 1]),
        ("answers 1: 2, 2: 3", 2, 4, [1, 2]), ("", 2, 4, [None, None]), (None, 2, 4, [None, None]), ("1: 2\n1: 3", 1, 4, [1]),
    ],
)
def test_batch_answers(spark, said, size, labels, want):
    assert one(spark, said, lambda c: parsers.batch_answers(c, size, labels)) == want


def test_json_answers(spark):
    space = F.array(F.lit("a"), F.lit("b"))
    read = lambda c: parsers.batch_json_answers(c, 2, space)
    assert one(spark, '```json\n{"answers": ["b", "x"]}\n```', read) == [1, None]
    assert one(spark, '{"answers": ["b"]}', read) == [None, None]
    assert one(spark, '{"answers": ["a", 3]}', read) == [0, None]
    assert one(spark, "no", read) == [None, None]


def test_judgement(spark):
    good = '{"factual_consistency": 5, "key_information_coverage": 4.9, "conciseness": 1, "overall_quality": 3, "rationale": "r"}'
    assert one(spark, good, parsers.judgement).asDict() == {"factual_consistency": 5, "key_information_coverage": 4, "conciseness": 1, "overall_quality": 3, "rationale": "r"}
    assert one(spark, good.replace("5,", "6,", 1), parsers.judgement) is None


def test_canonical_json():
    assert keys.canonical_json({"b": 1.0, "a": [None, True, 0.1 + 0.2], "ü": {"y", "x"}}) == '{"a":[null,true,0.3],"b":1,"ü":["x","y"]}'
    for bad in (math.nan, math.inf):
        with pytest.raises(ValueError, match="canonical"):
            keys.canonical_json(bad)


def test_what_changes_a_key(spark):
    row = {"model_id": "a/b", "sample_id": "s", "temperature": 0.0, "user_prompt": "u", "system_prompt": "s", "max_output_tokens": 5}
    key = lambda **x: keys.inference_key(spark.createDataFrame([row | x])).first()["cache_key"]
    assert key() == key() == key(price=3.0) == key(user_prompt=" u ")
    assert len({key(), key(sample_id="t"), key(temperature=0.5), key(user_prompt="v"), key(max_output_tokens=6)}) == 5


def test_facts():
    found = facts.facts_of("Sales rose 12% to $3.5 million on 3 May 2024 and 2024-05-03, said Acme Corp. 1,234 units; 서울대학교는 5억원을 썼다.")
    by = {c: [f.normalized for f in found if f.category == c] for c in facts.CATEGORIES}
    assert by["percentage"] == ["12"] and "USD:3.5e+06" in by["currency"] and "KRW:5e+08" in by["currency"]
    assert by["date"][0] == "2024-05-03" and "1234" in by["number"] and {"acme corp", "서울대학교"} <= set(by["entity"])


def test_support(spark):
    pairs = [
        ("up 12 % in 2021.", "up 21 %."),
        ("x", "nothing here"),
        ("In 2021-03-04 it fell.", "It fell in 2021."),
        (None, None),
        ("Acme Corp sold 1,000 units for $5 on May 3, 2024.", "ACME CORP sold 1000 units for 5 dollars on 2024-05-04; 7 were lost, Beta Inc said."),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r["f"] for r in df.select("i", facts.check_support(F.col("a"), F.col("b")).alias("f")).orderBy("i").collect()]
    assert got[0]["percentage_mismatch"] == 1 and got[0]["precision"] == 0.0
    assert got[1]["precision"] is None
    assert got[2]["precision"] == 1.0
    assert got[3]["facts_total"] == 0
    # 1000 and $5 are borne out, and the date by its year; 7 and Beta Inc are not.
    assert (got[4]["currency_total"], got[4]["currency_supported"], got[4]["number_total"], got[4]["number_supported"]) == (1, 1, 2, 1)
    assert [f["normalized"] for f in got[4]["unsupported_examples"]] == ["7", "beta inc"] and got[4]["date_supported"] == got[4]["date_total"] == 2
    near = df.where("i = 0").select(facts.check_support(F.lit("about 100 people"), F.lit("102 people"), tolerance=0.05).alias("f")).first()["f"]
    assert near["number_supported"] == 1


def test_aggregate_support_equals_sums(spark):
    rows = spark.createDataFrame([(1, "12% of 5", "12% of 6"), (1, "x", "y"), (2, "in 1999", "in 1999 and 2001")], "k int, a string, b string")
    made = rows.select("k", facts.check_support(F.col("a"), F.col("b")).alias("f")).select("k", "f.*")
    got = {r["k"]: r.asDict() for r in facts.aggregate_support(made, "k").collect()}
    assert (got[1]["facts_total"], got[1]["facts_supported"], got[1]["summaries_with_facts"], got[1]["number_mismatch"], got[1]["percentage_support_rate"]) == (2, 1, 1, 1, 1.0)
    assert (got[2]["facts_total"], got[2]["date_support_rate"], got[2]["entity_support_rate"]) == (2, 0.5, None)


def test_rouge_and_chrf():
    same = similarity.rouge_of("One cat. Two dogs.", "One cat. Two dogs.")
    assert same["rougeLsum_f"] == same["rouge1_f"] == 1.0
    assert similarity.rouge_of("a", "  ")["rouge1_f"] == 0.0
    got = similarity.rouge_of("the cat sat on the mat", "the cat on mat")
    assert got["rouge1_f"] == pytest.approx(0.8) and got["rougeLsum_r"] == pytest.approx(4 / 6)
    assert similarity.chrf_of("same text", "same text") == pytest.approx(100) and similarity.chrf_of("a", "") == 0
    assert 0 < similarity.chrf_of("the cat sat", "the cat sits") < 100


def test_the_profile_query_makes_its_texts_once(spark):
    from marlstone import queries

    plan = queries.q_script_profile(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("replace(text") <= 2


def test_profiles_at_their_shares(spark):
    rows = [("한" * 3 + "a" * 17,), ("한" * 4 + "a" * 16,), ("漢" * 4 + "a" * 16,), ("漢" * 4 + " \t\n　" * 50 + "a" * 16,), ("é" * 20,), ("\U0001f600" * 20,), (None,), ("",), ("한漢",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.script_profile(F.col("t"))).collect()]
    assert got == ["latin", "ko", "cjk", "cjk", "latin", "latin", "latin", "latin", "ko"]
