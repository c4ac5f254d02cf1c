"""op12 and op13 against brute force."""

import math

import numpy as np
import pytest

from marlstone.llm import embedding_dedup as ed
from marlstone.llm import whitening as wh


def brute_links(rows, cosine=ed.COSINE):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector) rows, every pair compared."""
    def use(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def near(v, w):
        if len(v) != len(w):
            return False
        v, w = ([x / max(map(abs, u)) for x in u] for u in (v, w))
        dot, a, b = (math.fsum(x * y for x, y in zip(*p)) for p in ((v, w), (v, v), (w, w)))
        return dot / math.sqrt(a * b) >= cosine

    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, v) in enumerate(rows):
        for j, (_, w) in enumerate(rows[:i]):
            if use(v) and use(w) and near(v, w):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (vec, _) in enumerate(rows):
        if vec is not None:
            least[find(i)] = min(least.get(find(i), vec), vec)
    return sorted(((vec, links[i], least.get(find(i)), vec is not None and vec == least.get(find(i))) for i, (vec, _) in enumerate(rows)), key=repr)


def groups(spark, rows, kind="array<double>", **more):
    return sorted((tuple(r) for r in ed.embedding_groups(spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}"), **more).collect()), key=repr)


def clustered(rng, n, dims, group, noise):
    centres = rng.standard_normal((n // group + 1, dims))
    return centres[np.arange(n) % len(centres)] + noise * rng.standard_normal((n, dims))


@pytest.mark.parametrize("dims,noise", [(4, 0.3), (16, 0.2), (64, 0.16)])
def test_links_and_groups_equal_brute_force(spark, dims, noise):
    rng = np.random.default_rng(dims)
    n = 400 if dims < 64 else 160
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(n), clustered(rng, n, dims, 12, noise))]
    got, want = groups(spark, rows), brute_links(rows)
    assert got == want and sum(r[1] for r in got) > 100


@pytest.mark.parametrize("broadcast", [ed.BROADCAST_ROWS, 0])
def test_large_buckets_are_cut_and_lose_nothing(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ed, "BLOCK", 40)
    monkeypatch.setattr(ed, "BROADCAST_ROWS", broadcast)
    rng = np.random.default_rng(7)
    hot = rng.standard_normal(8)
    rows = [(i, (hot + (0.05 if i % 3 == 0 else 1.5) * rng.standard_normal(8)).tolist()) for i in range(450)]
    assert groups(spark, rows) == brute_links(rows)


def test_odd_vectors(spark):
    one = [3.0, 4.0, 0.0]
    rows = [
        (1, one), (2, [6.0, 8.0, 0.0]), (2, [6.0, 8.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [3.0, None, 0.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, []), (9, [3.0, 4.0]),
        (None, one), (None, [0.0, 0.0, 1.0]), (10, [-3.0, -4.0, 0.0]), (11, [3e-310, 4e-310, 0.0]), (12, [3e300, 4e300, -0.0]), (0, [3.0, 4.0, 0.01]),
    ]
    got = groups(spark, rows)
    assert got == brute_links(rows)
    assert (3, 0, 3, True) in got and (None, 0, None, False) in got


def test_cosine_at_the_bound_is_a_link_and_just_below_is_none(spark):
    at = [0.95, math.sqrt(1 - 0.95**2)]
    for other in (at, [np.nextafter(0.95, 0), at[1]], [0.9499999, math.sqrt(1 - 0.9499999**2)], [0.9500001, math.sqrt(1 - 0.9500001**2)]):
        rows = [(1, [1.0, 0.0]), (2, list(map(float, other)))]
        assert groups(spark, rows) == brute_links(rows)


def test_floats_other_columns_and_empty_table(spark):
    rows = [(1, [1.0, 2.0], 5, "x"), (2, [1.0, 2.0], 6, "y"), (3, [2.0, -1.0], 7, "z")]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, node int, vector string")
    assert sorted(tuple(r) for r in ed.embedding_groups(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert ed.embedding_groups(df.limit(0)).count() == 0


def test_tables_keep_the_chance_of_a_miss():
    for rows in (1, 500, 10**5, 10**9):
        tables, planes = ed.tables_for(rows)
        p = 1 - math.acos(ed.COSINE) / math.pi
        assert (1 - p**planes) ** tables <= ed.MISS and rows / 2**planes <= max(ed.BUCKET, rows / 16)


def test_all_rows_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    x = np.stack(rows.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = ed.embedding_groups(df).toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == ((x @ x.T >= ed.COSINE).sum(axis=1) - 1).tolist()


# -- whitening


def brute_whitening(rows, most=4):
    """Exact figures of (vec_id, vector) rows by big integers, without digits or Spark."""
    kept = [(i, [min(max(math.floor(256 * c), -(2**63)), 2**63 - 1) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    centred = [[n * v - s for v, s in zip(x, sums)] for x in fit]
    gram = [[sum(y[i] * y[j] for y in centred) for j in range(d)] for i in range(d)]
    cov = np.array([[g / n**3 for g in row] for row in gram])
    values, vectors = np.linalg.eigh(cov)
    z = [((np.array([(n * v - s) / n for v, s in zip(x, sums)]) @ vectors[:, ::-1][:, :most]) / np.sqrt(values[::-1][:most])) for _, x in kept]
    return {"n": n, "dev": [sum((n * v - s) ** 2 for v, s in zip(x, sums)) for _, x in kept], "z": np.array(z), "explained": values[::-1][:most] / np.trace(cov), "ids": [i for i, _ in kept]}


def whiten(spark, rows, kind="array<double>", **more):
    return wh.whitened(spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}"), **more).toPandas()


def compare(got, want, tolerance=1e-9):
    k = len(want["explained"])
    assert len(got) == k * len(want["ids"])
    ids, order = np.unique(want["ids"], return_index=True)
    got = got.drop_duplicates().sort_values(["vec_id", "component"])
    assert got.component.tolist() == list(range(1, k + 1)) * len(ids) and (got.n == want["n"]).all()
    for deviation, i in zip(got.deviation.tolist()[::k], order):
        assert deviation == want["dev"][i] if want["dev"][i] < 2**53 else np.isnan(deviation) or abs(deviation / want["dev"][i] - 1) < 1e-9  # pandas holds them as doubles
    z = got.whitened.to_numpy().reshape(-1, k)
    assert np.allclose(z * np.sign((z * want["z"][order]).sum(axis=0)), want["z"][order], atol=tolerance, rtol=tolerance)
    assert np.allclose(got.explained.to_numpy().reshape(-1, k), want["explained"], rtol=1e-9)
    assert got.identity_error.max() < 1e-8


@pytest.mark.parametrize("scale,offset", [(1, 0), (1, 1e6), (1e5, -3e7)])
def test_whitening_equals_big_integers(spark, scale, offset):
    rng = np.random.default_rng(3)
    x = scale * rng.standard_normal((120, 5)) @ np.diag([5, 4, 3, 2, 1]) + offset
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, x[0].tolist()), (201, x[1].tolist())]
    compare(whiten(spark, rows), brute_whitening(rows), 1e-6)


def test_odd_rows_are_left_out_and_copies_count_once_in_the_fit(spark):
    rng = np.random.default_rng(4)
    good = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((40, 3)))]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0, 1.0]), (103, [float("-inf"), 1.0, 1.0])]
    rows = good + odd + [good[0]] * 5
    got = whiten(spark, rows)
    compare(got, brute_whitening(rows))
    assert got.vec_id.max() < 100 and len(got) == 3 * 45


def test_rows_without_variance(spark):
    got = whiten(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert got.n.tolist() == [1] * 4 and got.deviation.tolist() == [0] * 4 and got.whitened.isna().all() and got.explained.isna().all() and got.identity_error.isna().all()
    flat = whiten(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])]).sort_values(["vec_id", "component"])
    assert flat.whitened.isna().tolist() == [False, True] * 2 and flat.explained.tolist() == [1.0, 0.0] * 2


def test_other_lengths_empty_tables_and_clashing_names(spark):
    got = whiten(spark, [(1, [1.0, 2.0]), (2, [2.0, 5.0]), (3, [1.0])])
    assert got[got.vec_id == 3][["deviation", "whitened"]].isna().all().all() and got[got.vec_id != 3].deviation.notna().all()
    for rows in ([], [(1, None)], [(1, [])]):
        assert len(whiten(spark, rows)) == 0
    df = spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 1)], "vec_id int, embedding array<float>, x int")
    assert wh.whitened(df).count() == 2


def test_numbers_beyond_64_bits(spark):
    big = whiten(spark, [(1, [1e18, 0.0]), (2, [-1e18, 1.0]), (3, [1e300, 2.0])])
    assert big.deviation.isna().all() and big[big.component == 1].whitened.notna().all()


def test_digits_give_exact_products():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-(2**63), 2**63 - 1, (30, 3)), rng.integers(-200, 200, (30, 3)), np.array([[2**63 - 1, -(2**63), 0]])])
    back = sum(d.astype(np.int64).astype(object) * (1 << wh.DIGIT_BITS * k) for k, d in enumerate(wh.digits_of(x)))
    assert (back == x.astype(object)).all()
    middle = np.array([2**62, -(2**63), 7])
    total = np.zeros((3, 3), object)
    for sums in wh.digit_products(iter([x]), middle):
        for (a, b), product in sums.items():
            total = total + product.astype(object) * (1 << wh.DIGIT_BITS * (a + b))
    y = x.astype(object) - middle.astype(object)
    assert (total == y.T @ y).all()


def test_blocks_are_sent_before_they_overflow(monkeypatch):
    monkeypatch.setattr(wh, "BLOCK", 4)
    monkeypatch.setattr(wh, "FLUSH", 2)
    x = np.arange(60).reshape(20, 3)
    parts = list(wh.digit_products(iter([x[:11], x[11:]]), np.zeros(3, np.int64)))
    assert len(parts) == 3 and (sum(p[0, 0] for p in parts) == x.T @ x).all()
