import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import simhash
from marlstone.llm.common import Scratch
from marlstone.llm.components import components

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, distance):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(fps))]


CASES = [None, "", "  \n", "a", "A", "a b", "one two three", "one two three four", "One  TWO\tthree four", "ÉA é b c d", "x " * 3000]


def test_fingerprints():
    for text in CASES:
        assert simhash.fingerprint_of((text or "").encode()) == brute_fingerprint(text), text


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in docs]
    want = dict(zip([r["doc_id"] for r in docs], brute_components([r["doc_id"] for r in docs], fps, 2)))
    got = simhash.op3_simhash_dedup(spark, sf).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {r["doc_id"]: f"{f:016x}" for r, f in zip(docs, fps)}


def test_spanning_forest_links_what_brute_force_links():
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = list({s ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.5) * (1 << rng.randrange(64)) for s in seeds for _ in range(20)})
    for limit in (8, 4096):
        old, simhash.SPLIT_ROWS = simhash.SPLIT_ROWS, limit
        edges = simhash.spanning(np.array(fps, dtype=np.uint64), 2)
        simhash.SPLIT_ROWS = old
        assert all((a ^ b).bit_count() <= 2 for a, b in edges)
        parent = {f: f for f in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[root(a)] = root(b)
        want = brute_components(list(range(len(fps))), fps, 2)
        groups = {}
        for f, w in zip(fps, want):
            groups.setdefault(w, set()).add(root(f))
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({root(f) for f in fps})


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_through_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "SPLIT_ROWS", limit)
    rng = random.Random(3)
    fps = list({rng.getrandbits(63) for _ in range(300)})
    fps += [f ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for f in fps[:100]]
    fps = list(dict.fromkeys(fps))
    near = [fps[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    fps = list(dict.fromkeys([*fps, *near]))
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), Scratch(spark), 2)
    got = {r["node"]: r["component"] for r in components(edges, Scratch(spark)).collect()}
    want = brute_components(fps, fps, 2)
    assert all(got.get(f, f) == w for f, w in zip(fps, want))


def test_components_of_a_path(spark):
    rows = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "a bigint, b bigint"), Scratch(spark)).collect()}
    assert {got[i] for i in range(201)} == {0} and got[501] == 500 and len(got) == 203
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark)).count() == 0


def test_stage_goes_through_fingerprints(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"u{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base)] + [" ".join(f"x{k}" if i == 13 * k else w for i, w in enumerate(base)) for k in range(1, 25)] + [" ".join(f"o{k}-{i}" for i in range(50)) for k in range(20)]
    prints = [simhash.fingerprint_of(t.encode(), simhash.WORDS) for t in texts]
    want = brute_components(list(range(len(texts))), prints, simhash.NEAR_BITS)
    # All copies are similar to each other; most of them have near fingerprints.
    assert len(set(want[:25])) < 15 and all(w == k for k, w in enumerate(want) if k > 24)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    least = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert [least[k] for k in range(len(texts))] == [0] * 25 + list(range(25, 45))
    # By fingerprints alone.
    none = spark.createDataFrame([], "key bigint, fp bigint, size bigint, place bigint")
    monkeypatch.setattr(simhash, "_members", lambda documents, counts: none)
    least = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert [least[k] for k in range(len(texts))] == want


def test_near_fingerprints_pair_sets_of_one_fingerprint(spark):
    rows = [(1, 8), (2, 8), (3, 8), (4, 8 ^ 7), (5, 8 ^ 15 << 20), (6, 1 << 40 | 3 << 50 | 7 << 8)]
    got = simhash.near_fingerprints(spark.createDataFrame(rows, "fp bigint, sim bigint"), Scratch(spark)).collect()
    assert {(min(r), max(r)) for r in got} == {(1, 2), (1, 3), (1, 4)}


def test_one_of_each_group(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(3, long, "x"), (1, long.upper(), "y"), (2, "other " + " ".join(f"v{i}" for i in range(60)), "z"), (2, "other " + " ".join(f"v{i}" for i in range(60)), "z"), (9, None, "n"), (8, "", "n"), (None, "solo text here now", "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component string")
    got = simhash.one_of_each_group(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got.collect()) == [(False, 1), (False, 2), (False, 8), (True, None)]
    assert simhash.one_of_each_group(df.limit(0)).count() == 0
    clash = df.withColumns({"_k1": F.lit(4), "_k2": F.lit("k"), "fp": F.lit(2.5)})
    got = simhash.one_of_each_group(clash)
    assert got.columns == clash.columns and {(r["_k1"], r["_k2"], r["fp"]) for r in got.collect()} == {(4, "k", 2.5)} and got.count() == 4


def test_cells_reach_the_driver_as_ranges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = simhash.sets_of(pa.chunked_array(docs.select("text").toArrow().column(0)).combine_chunks())
    want = np.bincount(simhash._cells(np.concatenate(sets)), minlength=1 << simhash.CELL_BITS)
    assert (simhash._counted(docs) == want).all()
    assert 0 < simhash._ranges(docs).count() <= simhash.blobs.parts_for(spark) and simhash._counted(docs.limit(0)).sum() == 0


def test_hot_shingles_are_dealt_by_text(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"u{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(f"x{k}" if rng.random() < 0.022 else w for w in base) for k in range(60)] + [" ".join(f"o{k}-{i}" for i in range(50)) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    # Copies at this rate of changes are similar to some others and not to all.
    assert 25 < len(set(want.values())) < 70
    for sizes in ({"HOT_CELL": 5}, {"HOT_KEY": 3}, {"HOT_KEY": 1, "BLOCK_SETS": 7, "CHUNK_SETS": 11}):
        with monkeypatch.context() as m:
            for name, value in sizes.items():
                m.setattr(simhash, name, value)
            assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == want


def test_stage_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rng = random.Random(8)
    base = [f"u{rng.randrange(10**6)}" for _ in range(200)]
    texts = {r["doc_id"]: r["text"] for r in rows}
    for k in range(40):
        texts[10**7 + k] = " ".join(f"x{k}" if rng.random() < 0.02 else w for w in base)

    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
        return frozenset(" ".join(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([" ".join(words)] if words else [])

    ids, sets = list(texts), [grams(t) for t in texts.values()]
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    want = {d: least[root(i)] for i, d in enumerate(ids)}
    got = simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
