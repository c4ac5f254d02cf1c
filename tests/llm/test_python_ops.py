"""The operators that score in Python: importance, toxicity, language model, byte strings, sentence pieces."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import importance, sentencepiece, substring_dedup, suffix_tree, toxicity

SF = "/root/testdata/sf0.01"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, score string")


# --- importance ---


def test_kth_greatest(spark):
    rng = random.Random(2)
    keys = [rng.randrange(1 << 47) for _ in range(500)] + [5] * 20
    df = spark.createDataFrame([(k,) for k in keys], "key bigint")
    for k in (1, 2, 77, 500, 510, 520):
        assert importance.kth_greatest(df, k) == sorted(keys, reverse=True)[k - 1]
    assert importance.kth_greatest(df, 0) is None and importance.kth_greatest(df, 521) is None


def test_resampling_prefers_the_target(spark):
    got = importance.op2_quality_classifier(spark, SF)
    n = {(r["quality"], r["kept"]): r["count"] for r in got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] and n[0, False] > n[0, True]
    share = spark.read.parquet(f"{SF}/labels.parquet").agg(F.avg("quality")).first()[0]
    assert got.where("kept").count() == round(share * got.count())


def test_weights_and_selection_equal_brute_force(spark):
    from marlstone.llm.hashing import joined_hashes, word_hashes

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}

    def grams(text):
        h = word_hashes((text or "").encode())
        pairs = [joined_hashes(h[i : i + 1], h[i + 1 : i + 2])[0] for i in range(len(h) - 1)]
        return [int(x >> np.uint64(40)) % importance.BUCKETS for x in [*h, *pairs]]

    texts = {r["doc_id"]: grams(r["text"]) for r in rows}
    counts = [Counter(), Counter()]
    for i, g in texts.items():
        counts[1].update(g)
        if i in good:
            counts[0].update(g)
    total = [sum(c.values()) + importance.ALPHA * importance.BUCKETS for c in counts]
    weight = lambda g: sum(math.log((counts[0][x] + importance.ALPHA) / total[0]) - math.log((counts[1][x] + importance.ALPHA) / total[1]) for x in g)
    got = importance.op2_quality_classifier(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["log_weight"] == pytest.approx(weight(texts[r["doc_id"]]), abs=1e-6) and 2 * r["n_words"] - 1 == max(len(texts[r["doc_id"]]), 2 * r["n_words"] - 1)
    keys = sorted((r["gumbel_key"] for r in got), reverse=True)
    kept = [r["gumbel_key"] for r in got if r["kept"]]
    assert sorted(kept, reverse=True) == pytest.approx(keys[: len(kept)])
    noise = [r["gumbel_key"] - r["log_weight"] for r in got]
    assert abs(np.mean(noise) - 0.5772) < 0.15 and abs(np.std(noise) - 1.2825) < 0.15


def test_resampling_repeated_rows_and_clashing_columns(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, quality int")
    rows = spark.createDataFrame([(0, "good words", 1.0, True), (0, "good words", 2.0, False), (1, "bad", 3.0, True)], "doc_id bigint, text string, gumbel_key double, kept boolean")
    got = importance.resampled(rows, labels, share=0.5).collect()
    assert len(got) == 3 and len({(r["doc_id"], r["log_weight"], r["gumbel_key"], r["kept"]) for r in got}) == 2


def test_resampling_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, None)], "doc_id bigint, quality int")
    got = importance.resampled(docs(spark, "good words here", "bad", None, "", "x " * 9999), labels, share=1.0).collect()
    assert len(got) == 5 and all(r["kept"] for r in got) and [r["log_weight"] for r in got if r["doc_id"] in (2, 3)] == [0.0, 0.0]
    assert importance.resampled(docs(spark, "a"), labels.limit(0)).first()["kept"]
    assert importance.resampled(docs(spark, "a").limit(0), labels).count() == 0


# --- toxicity ---


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(documents, labels.where("doc_id % 3 <> 0"))
    test = documents.join(F.broadcast(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "label")), "doc_id")
    n = {(r["label"], r["toxic"]): r["count"] for r in toxicity.scored(test, model).join(test.select("doc_id", "label"), "doc_id").groupBy("label", "toxic").count().collect()}
    # Some documents labelled toxic hold no telling word, and some words stand in no training document.
    assert n[1, True] >= 0.9 * (n[1, True] + n.get((1, False), 0)) and n.get((0, True), 0) <= 0.02 * n[0, False]
    assert np.all(np.diff(model.thresholds) >= 0)


@pytest.mark.parametrize("third", [0, 1, 2])
def test_toxicity_of_each_third_held_out(spark, third):
    sf = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(documents, labels.where(f"doc_id % 3 <> {third}"))
    test = documents.join(F.broadcast(labels.where(f"doc_id % 3 = {third}").withColumnRenamed("toxic", "label")), "doc_id")
    n = {(r["label"], r["toxic"]): r["count"] for r in toxicity.scored(test, model).join(test.select("doc_id", "label"), "doc_id").groupBy("label", "toxic").count().collect()}
    assert n[1, True] >= 0.9 * (n[1, True] + n.get((1, False), 0)) and n.get((0, True), 0) <= 0.02 * n[0, False]
    assert model.cut in toxicity.CUTS


def test_cut_is_chosen_on_training_rows(spark):
    rng = random.Random(8)
    clean = [" ".join(f"c{rng.randrange(200)}" for _ in range(30)) for _ in range(240)]
    rows = [(toxicity.features_of(t.encode()), 0) for t in clean[:160]]
    rows += [(toxicity.features_of(f"{t} {rng.choice(['vile', 'nasty'])}".encode()), 1) for t in clean[160:]]
    cut, model = toxicity.chosen_cut(rows), toxicity.fit_rows(rows)
    p = lambda x: model.above(model.weights[x].sum())[0]
    assert cut in toxicity.CUTS and all((p(x) >= cut) == bool(t) for x, t in rows)
    assert toxicity.chosen_cut(rows[:40] + rows[-40:]) == toxicity.CUT == toxicity.chosen_cut(rows[:160])
    # Words that tell nothing: no cut flags few clean rows, or one that flags none is taken.
    mixed = [(x, k % 2) for k, (x, _) in enumerate(rows[:160])]
    assert toxicity.chosen_cut(mixed) in toxicity.CUTS


def test_toxicity_labels_and_documents_listed_twice(spark):
    texts = [f"w{k % 7} fine {'vile' if k % 3 == 0 else 'good'}" for k in range(60)]
    documents = docs(spark, *texts).withColumnRenamed("score", "toxic")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(60)], "doc_id bigint, quality int, toxic int")
    once = toxicity.fit(documents, labels)
    twice = toxicity.fit(documents.union(documents), labels.union(labels).union(spark.createDataFrame([(5, 1, None), (None, 1, 1), (999, 1, 1)], labels.schema)))
    assert np.array_equal(once.weights, twice.weights) and np.array_equal(once.thresholds, twice.thresholds) and once.cut == twice.cut
    more = documents.union(spark.createDataFrame([(0, "zz other", "x")] * 50, documents.schema))
    assert np.array_equal(toxicity.fit(more, labels).weights, once.weights)
    # Each row is scored, repeated ones alike, and a column named as the label does not clash.
    got = toxicity.scored(documents.union(documents), once)
    assert got.count() == 120 and got.distinct().count() == 60


def test_toxicity_gradient_equals_differences():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 4, 40)
    present = [rng.choice(12, rng.integers(1, 6), replace=False) for _ in y]
    rows, slots = np.repeat(np.arange(len(y)), [len(x) for x in present]), np.concatenate(present)
    w, theta = rng.normal(size=12), np.array([-0.5, 0.4, 1.3])

    def plain(w, theta):
        total = 0.0
        for grade, x in zip(y, present):
            cdf = [0.0, *(1 / (1 + math.exp(-(t - w[x].sum()))) for t in theta), 1.0]
            total -= math.log(cdf[grade + 1] - cdf[grade])
        return total / len(y)

    loss, by_weight, by_threshold = toxicity.loss_and_gradient(rows, slots, y, w, theta)
    assert loss == pytest.approx(plain(w, theta))
    for k in range(12):
        e = np.eye(12)[k] * 1e-5
        assert by_weight[k] == pytest.approx((plain(w + e, theta) - plain(w - e, theta)) / 2e-5, abs=1e-6)
    for k in range(3):
        e = np.eye(3)[k] * 1e-5
        assert by_threshold[k] == pytest.approx((plain(w, theta + e) - plain(w, theta - e)) / 2e-5, abs=1e-6)


def test_severity_is_the_expected_grade(spark):
    rng = random.Random(2)
    clean = [" ".join(f"c{rng.randrange(300)}" for _ in range(40)) for _ in range(200)]
    toxic = [f"{c} {' '.join(rng.sample(['vile', 'nasty', 'awful', 'gross'], 1 + k % 4))}" for k, c in enumerate(clean[:100])]
    rows = [(toxicity.features_of(t.encode()), 0) for t in clean] + [(toxicity.features_of(t.encode()), 1) for t in toxic]
    model = toxicity.fit_rows(rows)
    assert np.all(np.diff(model.thresholds) > 0)
    texts = ["c1 c2", "c1 vile", "c1 vile nasty", "c1 vile nasty awful gross", "c1 vile nasty awful gross"]
    got = toxicity.scored(docs(spark, *texts).withColumnRenamed("score", "severity"), model).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        weight = sum(model.weights[k] for k in toxicity.features_of(t.encode()))
        above = [1 / (1 + math.exp(x - weight)) for x in model.thresholds]
        assert r["severity"] == pytest.approx(sum(above)) and r["grade"] == sum(p >= toxicity.CUT for p in above) and r["toxic"] == (above[0] >= toxicity.CUT)
    assert got[0]["severity"] < got[1]["severity"] < got[2]["severity"] < got[3]["severity"] == got[4]["severity"]
    assert not got[0]["toxic"] and got[3]["grade"] == 3 and toxicity.scored(docs(spark, "a").limit(0), model).count() == 0


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs(spark, "a b"), labels)
    got = toxicity.scored(docs(spark, None, "", "word " * 5000), model).collect()
    assert len(got) == 3 and not any(r["toxic"] for r in got) and all(r["severity"] < 1 for r in got)


# --- language model ---


def brute_tree(texts):
    """States and listed symbols by plain dictionaries: {context: (weight left to the suffix, {symbol: log10 p})}, and the root's log10 p."""
    c = Counter(w for t in texts for w in t)
    total, distinct = sum(c.values()), len(c)
    base = lambda w: math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1)))
    level = {(w,): (n, base(w), True) for w, n in c.items() if n >= suffix_tree.LEAST_COUNT}
    states, depth = {}, 0
    while True:
        depth += 1
        grams = Counter(tuple(t[i - depth : i + 1]) for t in texts for i in range(depth, len(t)))
        rows = {}
        for g, n in grams.items():
            ctx, suffix = level.get(g[:-1]), level.get(g[1:])
            if n >= suffix_tree.LEAST_COUNT and ctx and ctx[0] >= suffix_tree.LEAST_CONTEXT and suffix and suffix[2]:
                rows[g] = (n, math.log10((n - 0.5) / (ctx[0] + 1)), suffix[1])
        by = {}
        for g, (n, p, q) in rows.items():
            if abs(p - q) >= math.log10(suffix_tree.RATIO):
                by.setdefault(g[:-1], {})[g[-1]] = (p, q)
        own = {}
        for ctx, listed in by.items():
            left = [max(1 - sum(10 ** x[k] for x in listed.values()), 1e-6) for k in (0, 1)]
            back = math.log10(left[0] / left[1])
            if math.log(10) * (sum(10**p * (p - q) for p, q in listed.values()) + left[0] * back) >= suffix_tree.DIVERGENCE:
                own[ctx] = (back, {w: p for w, (p, _) in listed.items()})
        if not own:
            return states, base
        states |= own
        level = {g: (n, own[g[:-1]][1].get(g[-1], q + own[g[:-1]][0]) if g[:-1] in own else q, g[:-1] in own) for g, (n, p, q) in rows.items()}


def brute_score(text, states, base):
    out = 0.0
    for i, w in enumerate(text):
        log = base(w)
        for d in range(1, i + 1):
            if (state := states.get(tuple(text[i - d : i]))) is None:
                break
            log = state[1].get(w, log + state[0])
        out += log
    return out


def lm_tokens(text):
    return [*(text or "").encode().lower().split(), b" "]


@pytest.mark.parametrize("sent", [None, (50, 50)])
def test_scores_equal_brute_force(spark, monkeypatch, sent):
    if sent:
        monkeypatch.setattr(suffix_tree, "SENT", sent)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    tokens = {r["doc_id"]: lm_tokens(r["text"]) for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    training = [t for i, t in tokens.items() if not held[i]]
    states, base = brute_tree(training)
    known = {w for t in training for w in t}
    assert max(map(len, states)) >= 3 and len(states) > 500
    got = suffix_tree.op4_lm_scoring(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(w in known for w in t), sum(map(len, training)))
        assert r["base_score"] == pytest.approx(sum(map(base, t)), abs=1e-6)
        assert r["score"] == pytest.approx(brute_score(t, states, base), abs=1e-6)
    unseen = [r for r in got if r["held_out"]]
    assert sum(r["score"] - r["base_score"] for r in unseen) > 0.05 * sum(r["n_tokens"] for r in unseen)


def thue_morse(size):
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_made_to_collide_keep_their_own_hashes(spark):
    from marlstone.llm.hashing import word_hashes

    for size in (32, 64, 128, 512, 1024, 2048, 4096, 8192):
        a, b = (word_hashes(w.encode())[0] for w in thue_morse(size))
        assert a != b and a == word_hashes(b"x " + thue_morse(size)[0].upper().encode() + b" y")[1]
    a, b = thue_morse(2048)
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    free = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = [(i, a) for i in free[:6]] + [(free[6], "c"), (held, b), (held, a)]
    got = {r["base_score"]: r["n_known"] for r in suffix_tree.scored(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").collect()}
    assert len(got) == 2 and sorted(got.values()) == [1, 2]


def test_tree_gives_a_distribution(spark):
    text = " ".join(random.Random(1).choices(["a", "b", "c d", "c e"], [5, 3, 2, 1], k=4000))
    rows = docs(spark, text, text, *(f"c {w}" for w in "abcde"), "c", "c zz").withColumn("doc_id", F.col("doc_id") * 0)
    got = [r["score"] for r in suffix_tree.scored(rows.withColumn("doc_id", F.lit(0))).orderBy("n_tokens").collect()]
    assert len(got) == 9
    states, base = brute_tree([lm_tokens(t) for t in (text, text, *(f"c {w}" for w in "abcde"), "c", "c zz")])
    ctx = (b"c",)
    words = [b"a", b"b", b"c", b"d", b"e", b" ", b"zz", b"never seen"]
    logs = [states[ctx][1].get(w, base(w) + states[ctx][0]) for w in words]
    assert sum(10**x for x in logs) == pytest.approx(1, abs=1e-3)


def test_lm_odd_rows(spark):
    got = suffix_tree.scored(docs(spark, None, "", "a b c", "a b c").withColumn("doc_id", F.when(F.col("doc_id") < 3, F.col("doc_id")))).collect()
    assert len(got) == 4 and sorted(r["n_tokens"] for r in got) == [1, 1, 4, 4]
    assert suffix_tree.scored(docs(spark, "a").limit(0)).count() == 0
    # With the only row held out, nothing trains.
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = spark.createDataFrame([(held, "a b " * 40_000, 7, "x")], "doc_id bigint, text string, n_tokens int, score string")
    row = suffix_tree.scored(alone).first()
    assert (row["train_tokens"], row["n_tokens"], row["n_known"], row["base_score"], row["score"]) == (0, 80_001, 0, 0.0, 0.0)
    long = suffix_tree.scored(docs(spark, "a b " * 400_000, "x" * 200_000, "a b")).collect()
    assert [r["n_tokens"] for r in sorted(long, key=lambda r: r["doc_id"])] == [800_001, 2, 3]


def test_the_tree_grows_with_the_corpus(spark):
    """Twice the corpus, of other words, has twice the states; their depth is not bounded beforehand."""

    def states_of(*texts):
        scratch = suffix_tree.Scratch(spark)
        return suffix_tree.fit(docs(spark, *texts).select("text"), scratch)[2]

    def corpus(seed):
        rng, own, out = random.Random(seed), {}, []
        for _ in range(40_000):
            factors = [own.setdefault(tuple(out[-d:]), [0.1 + rng.random() ** 2 for _ in "abcd"]) for d in range(1, 5)]
            out += rng.choices("abcd", [math.prod(x) for x in zip(*factors)])
        return [" ".join(f"{w}{seed}" for w in out)]

    one, two = states_of(*corpus(1)), states_of(*corpus(1), *corpus(2))
    assert one.agg(F.max("depth")).first()[0] >= 4
    assert two.count() >= 1.9 * one.count()


def test_batches_of_words():
    import pyarrow as pa

    from marlstone.llm import hashing

    rng = random.Random(1)
    texts = [None, "", "  ", "A b\tc\x0bd", "x" * 5000 + " y " + "X" * 5000, "é漢 É", "a\x1cb \x85 z q", " lead trail ", "w " * 200_000, "q" * 4096 + " " + "q" * 4097 + " " + "Q" * 4097]
    texts += ["".join(rng.choice("ab C\n é") for _ in range(rng.randrange(50))) for _ in range(500)]
    found, n = hashing.batch_words(pa.array(texts))
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert n.tolist() == [len((t or "").encode().lower().split()) for t in texts] and len(found) == len(words)
    of = {}
    assert all(of.setdefault(w, h) == h for w, h in zip(words, found.tolist())) and len(set(of.values())) == len(of)
    assert hashing.batch_words(pa.array(texts)[3:10])[0].tolist() == found[n[:3].sum() : n[:10].sum()].tolist()


def test_blobs_keep_their_rows():
    from marlstone.llm import blobs

    rng = np.random.default_rng(1)
    key, small, value = rng.integers(0, 2**64 - 1, 1000, dtype=np.uint64), rng.integers(-5, 5, 1000).astype(np.int32), rng.random(1000).astype(np.float32)
    for rows in (slice(0, 0), slice(0, 1), slice(0, 1000)):
        columns = [c[rows] for c in (key, small, value)]
        got = blobs.gathered([blobs.batch(x) for x in [list(blobs.dealt(blobs.part_of(columns[0], 7), 3, *columns))] if x])
        back = got[3] if rows.stop else [np.empty(0)] * 3
        assert sorted(zip(*(c.tolist() for c in back))) == sorted(zip(*(c.tolist() for c in columns)))


# --- byte strings ---


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(b[s : s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if n[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("many", [0, 2_000])
def test_removed_strings_equal_brute_force(spark, many, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MANY", many)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefé ", k=rng.randrange(3, 9)))
    passages = ["".join(word() for _ in range(60)) for _ in range(4)]
    texts = [None, "", "short", "a" * 700, "ab" * 300, "x" * 199, "y" * 200, "y" * 200, "z" * 201]
    for k in range(40):
        own = "".join(word() for _ in range(rng.randrange(10, 120)))
        p = rng.choice(passages)
        cut = rng.randrange(len(p))
        texts.append(own[: len(own) // 2] + p[cut // 4 : len(p) - cut // 5] + own[len(own) // 2 :] if k % 2 else own)
    texts += [texts[20], texts[20], texts[21][:-1] + "Q", "Q" + texts[22]]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.deduplicated(docs(spark, *texts).repartition(5)).collect()}
    for i, want in enumerate(brute(texts, 200)):
        assert got[i] == want, (i, texts[i] and texts[i][:50])


def test_pieces_do_not_change_the_result(spark, monkeypatch):
    rng = random.Random(9)
    p = "".join(rng.choices("abcdefgh", k=900))
    texts = [p, "12345" + p[100:800] + "6", "".join(rng.choices("abcdefgh", k=1200))]
    want = brute(texts, 200)
    whole = substring_dedup.runs_of(texts[0].encode())
    monkeypatch.setattr(substring_dedup, "PIECE", 300)
    cut = substring_dedup.runs_of(texts[0].encode())
    assert len(cut[0]) > len(whole[0]) and want[0][1] == 700
    # Every start of a 200-byte string is in one run, whatever the pieces.
    for names, _, first, last in (whole, cut):
        assert sorted(x for a, b in zip(first, last) for x in range(int(a), int(b) + 1)) == list(range(701))
    # A text of several pieces of the production size.
    long = "".join(rng.choices("abcdefgh", k=(1 << 20) + 700))
    texts = [long, long[(1 << 20) - 300 : (1 << 20) + 400], "q" + long[5000:5900]]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in substring_dedup.deduplicated(docs(spark, *texts)).collect()}
    assert got == {0: (1600, 2), 1: (700, 1), 2: (900, 1)}


def test_no_rows(spark):
    assert substring_dedup.deduplicated(docs(spark, "a").limit(0)).count() == 0


# --- sentence pieces ---


def test_ids_equal_the_library(spark):
    import sentencepiece as lib

    processor = lib.SentencePieceProcessor(model_file=sentencepiece.DEFAULT_MODEL)
    encoder = sentencepiece.Encoder(sentencepiece.load_model(sentencepiece.DEFAULT_MODEL))
    rng = random.Random(1)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["".join(rng.choice("ab c 1.é漢😀\n\t▁<s>the ing") for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += [None, "", " ", "   ", "x" * 700 + " y", "a" * 3000, " lead", "trail ", "a  b", "\x00"]
    ids = [np.frombuffer(x, "<i4").tolist() for x in encoder.encode_batch(texts)]
    assert ids == [processor.encode(t or "") for t in texts]
    assert all(encoder.decode(i) == (t or "") for i, t in zip(ids, texts) if "▁" not in (t or ""))


def test_merges_are_run_once_a_piece_and_parts_walked_once(monkeypatch):
    merged, walked = [], []
    merge, walk = sentencepiece._merge, sentencepiece.Encoder._walk_bpe
    monkeypatch.setattr(sentencepiece, "_merge", lambda word, *args: (merged.append(word), merge(word, *args))[1])
    monkeypatch.setattr(sentencepiece.Encoder, "_walk_bpe", lambda self, words: (walked.extend(words), walk(self, words))[1])
    model = sentencepiece.load_model(sentencepiece.DEFAULT_MODEL)
    encoder = sentencepiece.Encoder(model)
    for text in ("the rest.", "the rest,\nrest", "rest; the (other) others"):
        encoder.encode_batch([text])
    assert len(walked) == len(set(walked)) and "▁rest" in walked and not any("." in w or "," in w or "\n" in w for w in walked if len(w) > 1)
    assert merged and len(merged) == len(set(merged)) and all(w in model.ids for w in merged)


@pytest.mark.parametrize("octets", [False, True])
def test_any_model_gives_what_its_merges_give(octets):
    """Scores that tie, rise with later merges, pieces that nothing makes, unknown characters with and without bytes."""
    rng = random.Random(5)
    for _ in range(150):
        held = {"▁", "a", "b", "c", "d", "."} | {rng.choice(["", "▁"]) + "".join(rng.choice("abcd" if rng.random() < 0.9 else "ab.") for _ in range(rng.randrange(2, 6))) for _ in range(25)}
        byte_names = [f"<0x{b:02X}>" for b in range(256)] if octets else []
        names = ["<unk>", *byte_names, *sorted(held)]
        low = len(byte_names) + 1
        scores = [0.0] * low + [float(-rng.randrange(12)) for _ in names[low:]]
        m = sentencepiece.Model(sentencepiece.BPE, names, scores, {p: i for i, p in enumerate(names) if i >= low}, 0, {b: 1 + b for b in range(256)} if octets else {})
        encoder = sentencepiece.Encoder(m)
        texts = [" ".join("".join(rng.choice("aabbcd.é?") for _ in range(rng.randrange(1, 12))) for _ in range(4)) for _ in range(40)] + ["a b", "a  b", " a b", "▁a b", "a▁ b ", "?", "??é"]
        got = [np.frombuffer(x, "<i4").tolist() for x in encoder.encode_batch(texts)]
        for text, ids in zip(texts, got):
            want = b"".join(encoder._bytes(sentencepiece._merge(w, m)) for w in encoder.words(text))
            assert ids == np.frombuffer(want, "<i4").tolist(), (text, held)
            if octets:
                assert encoder.decode(ids) == text.replace("▁", " ")


def test_unigram_is_viterbi():
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.0, "▁a": -2.5, "ab": -2.2, "▁ab": -6.0, "bb": -1.0}
    names = ["<unk>", *pieces]
    m = sentencepiece.Model(sentencepiece.UNIGRAM, names, [0.0, *pieces.values()], {p: i for i, p in enumerate(names) if i}, 0, {})
    encoder = sentencepiece.Encoder(m)

    def best(word):
        found = [(0.0, [])] + [None] * len(word)
        for e in range(1, len(word) + 1):
            found[e] = max(((found[s][0] + pieces[word[s:e]], found[s][1] + [word[s:e]]) for s in range(e) if word[s:e] in pieces), key=lambda x: x[0])
        return [names.index(p) for p in found[-1][1]]

    for text in ("ab", "abb", "abbab", "a b", "bbbb ab"):
        got = np.frombuffer(encoder.encode_batch([text])[0], "<i4").tolist()
        assert got == [i for w in encoder.words(text) for i in best(w)], text
    assert np.frombuffer(encoder.encode_batch(["zz"])[0], "<i4").tolist()[-1] == 0


def test_encoded_rows(spark):
    got = {r["doc_id"]: r for r in sentencepiece.encoded(docs(spark, None, "", "hello world", "a▁b")).collect()}
    assert [got[i]["n_tokens"] for i in (0, 1)] == [0, 0] and got[2]["round_trip"] and not got[3]["round_trip"]
    assert sentencepiece.encoded(docs(spark, "a").limit(0)).count() == 0


def test_encoded_odd_rows(spark, tmp_path):
    import shutil

    long = "the quick brown fox é " * 100_000
    rows = spark.createDataFrame([("7", long, 1, "x"), ("7", long, 2, "y"), (None, "a b", 3, "z"), ("no number", "a b", 4, None)], "doc_id string, text string, n_tokens int, ids string")
    got = sentencepiece.encoded(rows.where("doc_id is null or doc_id = '7'")).collect()
    assert len(got) == 3 and all(r["round_trip"] for r in got) and [r["doc_id"] for r in got].count(7) == 2
    path = str(tmp_path / "copy.model")
    shutil.copy(sentencepiece.DEFAULT_MODEL, path)
    want = sentencepiece.load_model(path).digest()
    model = sentencepiece.load_model(path)
    model.scores[300] -= 1
    assert model.digest() != want == sentencepiece.load_model(sentencepiece.DEFAULT_MODEL).digest()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from marlstone.llm import common

    fake = lambda master, held: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: held), sparkContext=SimpleNamespace(master=master, applicationId="app"))
    assert common.shared_dir(fake("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    assert common.shared_dir(fake("local[4]", None)).startswith("file:///")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(fake(master, None))
