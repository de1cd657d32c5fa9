"""op3 against all pairs in double precision."""

import numpy as np
import pytest

from tidefold.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, cid string, copies int, vector int"


def vectors(seed=0, d=16):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(d) for _ in range(150)]
    for _ in range(10):
        base = rng.standard_normal(d)
        out += [base, base, 2 * base, *[base + 0.05 * rng.standard_normal(d) for _ in range(rng.integers(1, 9))]]
    base = rng.standard_normal(d)
    out += [base + rng.uniform(0.05, 0.25) * rng.standard_normal(d) for _ in range(80)]
    rows = [v.astype(np.float32).tolist() for v in out]
    return rows + [None, [], [0.0] * d, [float("nan")] + [1.0] * (d - 1), [float("inf")] * d, [None] + [1.0] * (d - 1), [1.0] * (d // 2), [1.0] * (d // 2), [1e-30] * d, [1e30] * d]


def plain(rows, limit=0.95):
    usable = [bool(v) and None not in v and bool(np.isfinite(v).all()) and any(v) for v in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and len(rows[i]) == len(rows[j]):
                a, b = np.array(rows[i]), np.array(rows[j])
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= limit:
                    links[i] += 1
                    links[j] += 1
                    x, y = root(i), root(j)
                    up[max(x, y)] = min(x, y)
    return [(i, links[i], root(i), root(i) == i) for i in range(len(rows))]


@pytest.mark.parametrize("block", [500, 7])
def test_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors()
    frame = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in enumerate(rows)], SCHEMA)
    assert sorted(map(tuple, embeddings.components(frame, missed=1e-9).collect())) == plain(rows)


def test_doubles_and_no_rows(spark):
    rows = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0000000001], [3.0, -1.0, 0.5]]
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embeddings.components(frame).collect())) == plain(rows)
    assert embeddings.components(frame.where("false")).count() == 0
    assert embeddings.components(spark.createDataFrame([(1, None)], SCHEMA.split(", cid")[0])).collect()[0][:] == (1, 0, 1, True)


def test_the_estimate_is_unbiased_and_within_its_bound():
    rng = np.random.default_rng(4)
    d = 64
    o, q = rng.standard_normal((2, 4000, d))
    q = 0.7 * o + 0.7 * q
    o, q = o / np.linalg.norm(o, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
    turn = embeddings.rotations(d, 1)
    assert np.allclose(turn @ turn.T, np.eye(d))
    x = np.where(o @ turn.T > 0, 1, -1) / np.sqrt(d)
    factor = (x * (o @ turn.T)).sum(axis=1)
    error = (x * (q @ turn.T)).sum(axis=1) / factor - (o * q).sum(axis=1)
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) < embeddings.ERROR * np.sqrt((1 - factor**2) / (factor**2 * (d - 1)))).all()


@pytest.mark.parametrize("d", [2, 3, 64, 200])
def test_band_plan_keeps_its_promise(d):
    for n in (2, 1000, 10**6, 10**9):
        k, signs, bands = embeddings.bands_for(n, d)
        both = embeddings.agreement(d, 0.95) ** k * (1 - np.arccos(0.95) / np.pi) ** signs
        assert (1 - both) ** bands <= embeddings.MISSED * 1.001
        assert k * np.log2(2 * embeddings.wide(d)) + signs >= np.log2(n) + 3
    rng = np.random.default_rng(8)
    o, q = rng.standard_normal((2, 300, d))
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    q -= (o * q).sum(axis=1, keepdims=True) * o
    q = 0.95 * o + np.sqrt(1 - 0.95**2) * q / np.linalg.norm(q, axis=1, keepdims=True)
    plan = embeddings.bands_for(1000, d)
    assert ((embeddings.band_names(o, plan) == embeddings.band_names(q, plan)).any(axis=1)).all()


def test_recall_right_at_the_limit(spark):
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(400):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [a.tolist(), (0.9501 * a + np.sqrt(1 - 0.9501**2) * b).tolist()]
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    assert embeddings.components(frame).where("n_links = 1").count() == 800
