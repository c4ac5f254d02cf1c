from pyspark.sql import functions as F

from marlstone.llm import decontamination as d

ITEM = "A train leaves the old station in Lyon at 8 and travels 120 km to reach the coast before the evening ferry departs."
CHANGED = "A train leaves the old station in Metz at 9 and travels 300 km to reach the coast before the evening ferry departs."
FILL = " ".join(f"filler{i}" for i in range(40))


def found(spark, docs, items):
    documents = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    kept = {r["doc_id"] for r in d.decontaminate(documents, bench).collect()}
    return [i not in kept for i in range(len(docs))]


def test_verbatim_changed_and_clean(spark):
    docs = [f"{FILL} {ITEM} {FILL}", f"{FILL} {CHANGED}", FILL, None, "", ITEM.upper(), "A train leaves the old station " + FILL, ITEM, ITEM]
    assert found(spark, docs, [ITEM]) == [True, True, False, False, False, True, False, True, True]


def test_slots_must_be_consistent(spark):
    item = "If Tom has 5 red apples then with 5 more green apples and 5 ripe pears how many has he in the basket"
    same = item.replace("5", "8")
    mixed = item.replace("5", "8", 1).replace("5", "9", 1)
    assert found(spark, [same, mixed], [item]) == [True, False]


def test_items_of_numbers(spark):
    items = ["What is 12 + 34 * 5 - 7 / 2?", "Compute 17 * 23 - 45 + 8 / 2 and 3 * 9 - 14."]
    docs = [f"{FILL}. {x} {FILL}" for x in items] + [f"{FILL}. What is 13 + 35 * 6 - 8 / 3? {FILL}", f"{FILL} is 12 34 {FILL}", "1 2 3 4 5 6 7 8 9 10 11 12"]
    assert found(spark, docs, items) == [True, True, True, False, False]


def test_names_at_the_start_of_sentences(spark):
    items = [
        "Tom has 5 apples. Jane gives him 3 more. Tom eats 2 of them. How many apples does he have?",
        "Natalia sold 48 clips in April. Maria sold half as many. Natalia then bought 12 clips. How many clips does she have now?",
    ]
    changed = [items[0].replace("Tom", "Ben").replace("Jane", "Sue").replace("5", "7"), items[1].replace("Natalia", "Ines").replace("Maria", "Olga").replace("48", "60")]
    mixed = items[0].replace("Tom", "Ben", 1)
    docs = [f"{FILL}. {x}" for x in changed] + [f"{FILL} {items[0].lower()} {FILL}", items[1].upper(), f"({items[0]})", f"{FILL}. Ben has a dog. Sue gives him food."]
    assert found(spark, docs, items) == [True, True, True, True, True, False]
    assert found(spark, [mixed.replace("5", "7").replace("2", "4").replace("Jane", "Sue")], items) == [False]


def test_short_and_empty_items(spark):
    assert found(spark, ["so unique phrase here it is", "nothing", None], ["unique phrase here", None, "", "..."]) == [True, False, False]
    assert found(spark, ["any text"], []) == [False] and found(spark, [], [ITEM]) == []


def test_changed_is_told(spark):
    documents = spark.createDataFrame([(1, CHANGED), (2, ITEM)], "doc_id bigint, text string")
    rows = d.leaks(documents, spark.createDataFrame([(7, ITEM)], "item_id bigint, text string")).collect()
    assert sorted(r["changed"] for r in rows) == [False, True] and {r["item_id"] for r in rows} == {7}


def test_windows_that_count_agree_on_the_values(spark):
    words = "If someone has 5 red apples then with two more green apples and a few ripe pears plus 5 plums how many fruits are there now".split()
    halves = lambda x, y: f"{FILL} {' '.join(words[:15]).replace('5', x)} {FILL} {' '.join(words[11:]).replace('5', y)}"
    alone = [f"{FILL} {' '.join(words[:15]).replace('5', '8')}", f"{FILL} {' '.join(words[11:]).replace('5', '3')}"]
    assert found(spark, [halves("8", "3"), halves("8", "8"), *alone], [" ".join(words)]) == [False, True, False, False]


def test_items_of_many_lengths_at_once(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    items = [" ".join(words[:k]) for k in range(1, 10)]
    got = d.leaks(
        spark.createDataFrame([(0, f"so {' '.join(words[:5])} end"), (1, " ".join(words))], "doc_id bigint, text string"),
        spark.createDataFrame([(k, t) for k, t in enumerate(items)] * 2, "item_id bigint, text string"),
    )
    rows = sorted((r["_k1"], r["item_id"]) for r in got.collect())
    by = {}
    for k1, item in rows:
        by.setdefault(k1, []).append(item)
    assert sorted(by.values(), key=len) == [[0, 1, 2, 3, 4], list(range(9))]


def test_clashing_columns_and_very_long_texts(spark):
    long = "filler words here " * 100_000 + ITEM
    df = spark.createDataFrame([(1, "clean text of no item", 4, 5, "w"), (2, long, 6, 7, "x"), (2, long, 6, 7, "x"), (None, None, None, None, None)], "doc_id bigint, text string, _k1 int, _k2 int, hash string")
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, ITEM)], "item_id bigint, text string")
    got = d.decontaminate(df, bench)
    assert got.columns == df.columns and sorted((tuple(r) for r in got.collect()), key=str) == [(1, "clean text of no item", 4, 5, "w"), (None,) * 5]


SUBJECTS = ["bakery", "museum", "garden", "factory", "library", "harbour", "theatre", "village"]


def made_item(rng, k):
    """A question of three sentences over a frame of its own words, with its names and numbers as parameters."""
    place, thing, other = rng.choice(SUBJECTS), f"item{k}", f"part{k % 37}"
    verbs = rng.sample(["packs", "sells", "paints", "counts", "moves", "stores", "repairs", "collects"], 3)

    def text(name, friend, a, b, c):
        return f"{name} works in a {place} and {verbs[0]} {a} {thing} every morning. {friend} {verbs[1]} {b} more {other} than {name} during the week. After {c} days they {verbs[2]} everything, so how many {thing} are left over for {friend} in the end?"

    return text


def test_recall_of_items_with_other_parameters(spark):
    import random

    rng = random.Random(4)
    names = ["Natalia", "Weng", "Betty", "Julie", "Ken", "Alexis", "Tobias", "Mina", "Carlos", "Ines", "Olga", "Pavel"]
    makers = [made_item(rng, k) for k in range(60)]
    draw = lambda: (*rng.sample(names, 2), *rng.sample(range(2, 900), 3))
    items = [m(*draw()) for m in makers]
    again = [f"{FILL}. {m(*draw())} {FILL}" for m in makers]
    clean = [f"{FILL}. {made_item(rng, k)(*draw())}" for k in range(1000, 1060)]
    got = found(spark, again + clean, items)
    assert sum(got[:60]) >= 0.9 * 60 and sum(got[60:]) == 0


FRAMES = [
    lambda n, m, a, b, c, o: f"{n} works in a {o[0]} and {o[1]} {a} {o[2]} every morning. {m} {o[3]} {b} more of them than {n} during the week. After {c} days they clean everything, so how many are left over for {m} in the end?",
    lambda n, m, a, b, c, o: f"A {o[0]} owned by {n} {o[1]} boxes of {o[2]} at {a} dollars each. When {m} asks for {b} boxes, the price falls by {c} percent. What does {m} pay to {n} for all of the {o[2]} together?",
    lambda n, m, a, b, c, o: f"Every week {n} {o[3]} {a} km along the old road while {m} takes the train for {b} km. If both begin at the {o[0]} and stop for {c} minutes to look at the {o[2]}, how much longer is the trip of {m}?",
]
OTHER_FRAMES = [
    lambda n, m, a, b, c, o: f"The {o[0]} opened by {n} has room for {a} visitors. On the first day {b} people came to see the {o[2]}, and {m} sold tickets to {c} of them. How many places stayed empty until {n} closed the doors?",
    lambda n, m, a, b, c, o: f"{n} reads {a} pages about the {o[2]} before lunch. If {m} reads {b} pages an hour and {o[3]} for {c} hours, by how many pages is {n} ahead when the {o[0]} shuts?",
]
FIRST, MIDDLE, LAST = ["Natalia", "Weng", "Betty", "Ken", "Tobias", "Ines", "Olga", "Pavel"], ["Ann", "Lee", "Maria", "van", "de"], ["Smith", "Dyke", "Bell", "Pan", "Okafor", "Silva"]


def any_name(rng):
    parts = rng.choice([1, 2, 3])
    if parts == 1:
        return rng.choice(FIRST)
    return " ".join([rng.choice(FIRST), *([rng.choice(MIDDLE)] if parts == 3 else []), rng.choice(LAST)])


def any_number(rng):
    return rng.choice([str(rng.randrange(2, 990)), f"{rng.randrange(1, 99)} {rng.randrange(100, 999)}", f"{rng.randrange(1, 99)},{rng.randrange(100, 999)}", rng.choice(["twelve", "sixty", "twenty five", "three hundred"])])


def test_recall_of_names_and_numbers_of_several_words(spark):
    """One- to three-word names, grouped numbers and numbers in words, three frames; each changed copy draws all of them again."""
    import random

    rng = random.Random(11)
    things = lambda k: (rng.choice(SUBJECTS), rng.choice(["packs", "sells", "paints", "counts"]), f"item{k} and part{k % 37}", rng.choice(["moves", "stores", "repairs", "collects"]))
    made = [(FRAMES[k % 3], things(k)) for k in range(90)]

    def drawn(frame, own):
        n, m = any_name(rng), any_name(rng)
        while n == m:
            m = any_name(rng)
        a, b, c = any_number(rng), any_number(rng), any_number(rng)
        return frame(n, m, a, b, c, own)

    items = [drawn(*x) for x in made]
    again = [f"{FILL}. {drawn(*x)} {FILL}" for x in made]
    clean = [f"{FILL}. {drawn(OTHER_FRAMES[k % 2], things(k))}" for k in range(90)]
    got = found(spark, again + clean, items)
    assert sum(got[:90]) >= 0.9 * 90 and sum(got[90:]) == 0


def test_values_of_several_words_are_one_token(spark):
    texts = {
        "Mary Ann Smith sold 12 000 clips to Vincent van Gogh.": ["\1", "sold", "\2", "clips", "to", "\1"],
        "it took twenty five km and 12,500 km": ["it", "took", "\2", "\3", "and", "\2", "\3"],
        "He paid 5 700 or 99 1000, x12 34": ["\1", "paid", "\2", "or", "\2", "\2", "x12", "\2"],
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", d._tokens(d.template(d.marked(F.col("t")))).alias("k"), F.size(d._tokens(d.marked(F.col("t")))).alias("n"))
    for r in rows.collect():
        assert r["k"] == texts[r["t"]] and r["n"] == len(r["k"])


def test_repeated_ids_and_items(spark):
    bench = spark.createDataFrame([(1, ITEM), (1, "other words " * 6), (1, None), (None, ITEM)], "item_id bigint, text string")
    df = spark.createDataFrame([(7, ITEM), (7, "clean"), (7, ITEM)], "doc_id bigint, text string")
    assert [r["text"] for r in d.decontaminate(df, bench).collect()] == ["clean"]


def test_query_catches_every_planted_passage(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {i for i, t in docs.items() if any(x in t for x in items)}
    got = {r["doc_id"] for r in d.op7_decontamination(spark, sf).collect() if r["contaminated"]}
    assert want and got == want


def test_marks_of_numbers_and_texts_without_control_characters(spark):
    texts = ["Two cats, 12 dogs and x.5", "twos often ten", "one hundred thousand 1 000 000 km", "a\u0001b 3,000.5 five5 5five", "é3 .7 seven/eight"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(d.marked(F.col("t"))).collect()]
    assert got == ["\u0001two cats, \u000212 dogs and x.\u00025", "twos often \u0002ten", "one \u0002hundred\u0004thousand \u00021\u0004000\u0004000 \u0003km", "a b \u00023,000.5 five5 \u00025five", "é3 .\u00027\u0004seven/\u0002eight"]
    plan = spark.createDataFrame([("a",)], "t string").select(d.marked(F.col("t")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 7
