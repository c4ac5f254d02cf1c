import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string"


def through(spark, rows):
    back = chat.read_back(chat.format_turns(chat.canonical(spark.createDataFrame(rows, TURNS))))
    return {r["conv_id"]: r for r in back.collect()}


def test_round_trip_of_control_strings(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\nhi", "\\", "<\\|", "\\\\<|", "<|", "<", "|", "", None, "a\n\nb", "\\e", "<|im_end|>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, "we\nird\\e<|\\", "x"), (None, None, None, None)]
    got = through(spark, rows)
    assert [t["text"] for t in got[1]["turns"]] == [t or "" for t in texts]
    assert got[1]["loss_texts"] == [t or "" for t in texts[1::2]]
    assert got[2]["turns"][0]["role"] == "we\nird\\e<|\\" and got[None]["turns"][0]["text"] == ""


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("<|\\\nime_ndstar>a", max_size=12), st.text("<|\\\nime_ndstar> é😀", max_size=30)), min_size=1, max_size=6))
def test_any_text_comes_back(spark, turns):
    rows = [(0, i, r, t) for i, (r, t) in enumerate(turns)]
    assert [(t["role"], t["text"]) for t in through(spark, rows)[0]["turns"]] == turns


def test_mask_covers_the_assistant_texts(spark):
    rows = [(0, i, ("user", "assistant")[i % 2], f"t<|{i}é") for i in range(600)]
    made = chat.format_turns(chat.canonical(spark.createDataFrame(rows, TURNS))).first()
    spans = [made["formatted"][s["start"] : s["start"] + s["length"]] for s in made["loss"]]
    assert spans == [f"t<\\|{i}é" for i in range(1, 600, 2)]


def test_repeated_and_extra_columns(spark):
    rows = spark.createDataFrame([(0, 0, "user", "b", 1), (0, 0, "user", "a", 2), (0, 0, "user", "a", 3)], TURNS + ", formatted int")
    assert [t["text"] for t in chat.canonical(rows).first()["turns"]] == ["a", "a", "b"]
    assert chat.canonical(rows.limit(0)).count() == 0


def test_layouts_by_fingerprint(spark):
    nested = spark.createDataFrame([(7, [("human", "q"), ("gpt", "a")])], "conv_id bigint, conversations array<struct<from:string,value:string>>")
    assert [tuple(t) for t in chat.canonical(nested).first()["turns"]] == [("user", "q"), ("assistant", "a")]
    flat = spark.createDataFrame([(7, "do", None, "done")], "conv_id bigint, instruction string, input string, output string")
    assert [tuple(t) for t in chat.canonical(flat).first()["turns"]] == [("user", "do"), ("assistant", "done")]
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical(spark.createDataFrame([(1, 2)], "conv_id bigint, nonsense int"))
    assert len(chat.BY_FINGERPRINT) == len(chat.LAYOUTS)


def test_mixed_json_rows(spark):
    rows = [(1, {"prompt": "p", "response": "r"}), (2, {"messages": [{"role": "user", "content": "u"}]}), (3, {"instruction": "i", "output": "o"}), (4, {"odd": 1})]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows] + [(5, "no json"), (6, None)], "conv_id bigint, raw string")
    got = {r["conv_id"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in chat.from_json_rows(df, "raw", "conv_id").collect()}
    assert got == {1: [("user", "p"), ("assistant", "r")], 2: [("user", "u")], 3: [("user", "i"), ("assistant", "o")], 4: None, 5: None, 6: None}


def test_json_rows_with_further_keys_and_foreign_fields(spark):
    rows = [
        {"id": 7, "meta": {"prompt": "no", "deep": [{"a": 1}]}, "prompt": "p", "response": "r"},
        {"messages": [{"role": "user", "content": "u", "n": 1}, {"content": "alone"}, None], "meta": [1, 2]},
        {"messages": [{"speaker": "user", "body": "u"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "score": 0.5, "tags": []},
        {"instruction": "i", "input": "x", "output": "o", "k": {}},
        {"meta": {"prompt": "p", "response": "r"}},
        {"messages": []},
        [{"role": "user", "content": "u"}],
        {"messages": [{"role": "user", "content": "u", "tool": {"name": "t", "calls": [{"x": [1]}]}}, "odd"]},
        {"Prompt": "p", "Response": "r"},
        {"messages": "text", "prompt": "p", "response": "r"},
    ]
    df = spark.createDataFrame([(k, json.dumps(v), 1) for k, v in enumerate(rows)], "conv_id bigint, raw string, turns int")
    got = {r["conv_id"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in chat.from_json_rows(df, "raw", "conv_id").collect()}
    assert got == {0: [("user", "p"), ("assistant", "r")], 1: [("user", "u"), ("", "alone")], 2: None, 3: [("user", "q"), ("assistant", "a")], 4: [("user", "i"), ("user", "x"), ("assistant", "o")], 5: None, 6: None, 7: None, 8: [("user", "u")], 9: None, 10: [("user", "p"), ("assistant", "r")]}


def test_layouts_that_neither_holds_the_other_are_refused(spark):
    rows = [
        {"prompt": "p", "response": "r", "completion": "c"},
        {"messages": [{"role": "user", "content": "u"}], "prompt": "p", "response": "r"},
        {"messages": [{"role": "user", "content": "u"}], "conversations": [{"from": "human", "value": "q"}]},
        {"system": "s", "prompt": "p", "response": "r"},
        {"system": "s", "prompt": "p", "completion": "c"},
        {"instruction": "i", "input": "x", "output": "o", "prompt": "p"},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "u"}]}]},
    ]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(rows)], "conv_id bigint, raw string")
    got = {r["conv_id"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in chat.from_json_rows(df, "raw", "conv_id").collect()}
    assert got[0] is None and got[1] is None and got[2] is None
    assert got[3] == [("system", "s"), ("user", "p"), ("assistant", "r")] and got[4] == [("user", "p"), ("assistant", "c")]
    assert got[5] == [("user", "i"), ("user", "x"), ("assistant", "o")] and got[6] == [("user", '[{"type":"text","text":"u"}]')]
    for k in (0, 1, 2):
        table = spark.read.json(spark.sparkContext.parallelize([json.dumps(rows[k] | {"conv_id": 1})]))
        with pytest.raises(ValueError, match="several layouts"):
            chat.canonical(table)
    table = spark.createDataFrame([(1, "s", "p", "r", 3)], "conv_id bigint, system string, prompt string, response string, n int")
    assert [tuple(t) for t in chat.canonical(table).first()["turns"]] == [("system", "s"), ("user", "p"), ("assistant", "r")]
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical(spark.createDataFrame([(1, [{"a": 1}])], "conv_id bigint, messages array<map<string,int>>"))


def test_loss_is_read_under_the_mask(spark):
    rows = [(0, 0, "user", "question <|x|>"), (0, 1, "assistant", "first\\answer"), (0, 2, "user", ""), (0, 3, "assistant", "second"), (0, 4, "assistant", "")]
    made = chat.format_turns(chat.canonical(spark.createDataFrame(rows, TURNS)))
    assert chat.read_back(made).first()["loss_texts"] == ["first\\answer", "second", ""]
    shifted = made.withColumn("loss", F.transform("loss", lambda s: F.struct((s["start"] - 2).alias("start"), s["length"].alias("length"))))
    assert chat.read_back(shifted).first()["loss_texts"] != ["first\\answer", "second", ""]
    others = made.withColumn("loss", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(16).cast("bigint").alias("length")), F.get("loss", F.lit(1))))
    assert chat.read_back(others).first()["loss_texts"] == ["<|im_start|>user", "second"]
    users = made.withColumn("loss", F.array(F.struct(F.lit(len("<|im_start|>user\n")).cast("bigint").alias("start"), F.lit(len("question <\\|x|>")).cast("bigint").alias("length"))))
    assert chat.read_back(users).first()["loss_texts"] == ["question <|x|>"]
    none = made.withColumn("loss", F.slice("loss", 1, 0))
    assert chat.read_back(none).first()["loss_texts"] == []


def test_long_texts_and_null_turns(spark):
    long = "word <|é " * 200_000
    rows = [(0, 0, "user", long), (0, None, None, None), (0, 1, "assistant", long), (1, 0, "assistant", None)]
    got = through(spark, rows)
    assert [t["text"] for t in got[0]["turns"]] == ["", long, long] and got[0]["loss_texts"] == [long] and got[1]["loss_texts"] == [""]


def test_query(spark):
    got = {r["conv_id"]: r for r in chat.op10_chat_format(spark, "/root/testdata/sf0.001").collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    want = hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (got[-1]["n_turns"], got[-1]["turns_sha256"], got[-1]["loss_chars"]) == (2, want, len(said))
