"""Fuzzy histories of states, and vectors by an inverted file against an exact search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ivf as V
from tessera.operators import states as Z


def test_likeness_and_entries():
    assert Z.likeness("At Home", "at-home today") == 0.95 and Z.likeness("", "x") == 0.0 and Z.likeness("cooking meals", "cooked meal plans") == pytest.approx(0.4 * 2 / 3)
    e = lambda s: (0, s, None)
    assert Z.taken_in([e("a cat"), e("dog")], e("CAT a cat")) == [e("CAT a cat"), e("dog")]
    assert Z.taken_in([e("a"), e("b"), e("c")], e("d")) == [e("b"), e("c"), e("d")] and Z.taken_in([e("x")], e("")) == [e("x"), e("")]


def test_histories(spark):
    rng = random.Random(7)
    words = ["at home", "at home today", "working", "working late", "ill", "", None, "on a trip"]
    rows = [(rng.choice("abc"), rng.randrange(50), i, rng.choice(words), "low") for i in range(400)] + [(None, 1, 1, "x", "low")]
    got = {r.key: ([(e.at, e.summary) for e in r.entries], r.summary, r.n) for r in Z.state_histories(spark.createDataFrame(rows, "key string, at long, seq long, summary string, confidence string").repartition(4)).collect()}
    for key in "abc":
        entries, own = [], sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for r in own:
            entries = Z.taken_in(entries, (r[1], r[3] or "", r[4]))
        assert got[key] == ([(a, s) for a, s, _ in entries], " / ".join(s for _, s, _ in entries), len(own))
    assert len(got) == 3


def exact(vectors, queries, most):
    u = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, v in vectors.items()}
    out = {}
    for q in queries:
        scores = sorted((-round(float(u[q] @ u[i]), 6) + 0.0, i) for i in vectors if i != q)[:most]
        out[q] = [(i, -s) for s, i in scores]
    return out


@pytest.mark.parametrize("rows", [4096, 40])
def test_inverted_file(spark, monkeypatch, rows):
    monkeypatch.setattr(V, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vectors = {i: (centres[i % 12] + 0.25 * rng.normal(size=16)).tolist() for i in range(900)}
    for i in range(300, 600):
        vectors[i] = vectors[0]  # a third of all rows are one vector
    frame = spark.createDataFrame([(i, v) for i, v in vectors.items()] + [(2000, None), (2001, [1.0]), (2002, [float("nan")] * 16)], "vec_id long, embedding array<double>").repartition(3)
    own, asked = V.usable(frame, 16), V.usable(frame.where("vec_id % 50 = 0"), 16)
    fitted = V.fit_centroids(own, 24)
    index = V.build(own, fitted)
    expected = exact(vectors, [i for i in vectors if i % 50 == 0], 10)

    def found(df):
        out = {}
        for r in df.orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        return out

    same = lambda a, b: a.keys() == b.keys() and all([i for i, _ in a[q]] == [i for i, _ in b[q]] and np.allclose([s for _, s in a[q]], [s for _, s in b[q]], atol=2e-6) for q in a)
    assert same(found(V.search(index, asked, fitted, 10)), expected) and same(found(V.nearest(frame, frame.where("vec_id % 50 = 0"), 10)), expected)
    probes = V.probes_for(index, own, fitted, 10)
    assert probes < len(fitted)
    got = found(V.search(index, asked, fitted, 10, probes))
    recall = np.mean([np.mean([s >= expected[q][-1][1] - 2e-6 for _, s in got[q]]) * len(got[q]) / 10 for q in expected])
    assert recall >= 0.9
    assert V.search(V.build(own.limit(0), fitted), asked, fitted, 10).count() == 0 and V.nearest(frame, frame.limit(0), 5).count() == 0


def test_recall_on_embeddings(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    rows = V.usable(spark.read.parquet(path), 64)
    fitted = V.fit_centroids(rows, 45)
    index, asked = V.build(rows, fitted), rows.where("vec_id % 50 = 0")
    probes = V.probes_for(index, rows, fitted, 10, 0.93)
    pairs = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    true, got = pairs(V.search(index, asked, fitted, 10)), pairs(V.search(index, asked, fitted, 10, probes))
    assert len(true) == 400 and len(true & got) >= 0.9 * len(true) and F is not None


def test_scores_are_held_in_bounded_blocks(spark, monkeypatch):
    """However many searches meet a batch, a task holds a bounded number of scores; ties go to the least id."""
    import numpy as np

    from tessera.operators import vectors as V

    assert V.CELLS <= 10_000_000
    rng = np.random.default_rng(3)
    m = rng.integers(-2, 3, (300, 4)).astype(float) + 0.5
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(1)
    units = m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(units @ units.T, 6)
    np.fill_diagonal(scores, -np.inf)
    true = {(i, int(j)) for i in range(300) for j in np.argsort(-scores[i], kind="stable")[:7]}
    monkeypatch.setattr(V, "CELLS", 1000)
    assert {(r.query_id, r.vec_id) for r in V.nearest(rows, rows, 7).collect()} == true


def test_correction_grows_with_the_length_of_vectors(spark):
    """What a whole vector shares is worked out once, not for each of its elements (for 384, minutes)."""
    import time

    from tessera.operators.vectors import corrected

    rng = np.random.default_rng(5)
    mean, direction = rng.normal(size=384), rng.normal(size=384)
    direction /= np.linalg.norm(direction)
    vectors = {i: rng.normal(size=384) for i in range(64)}
    odd = {100: None, 101: [1.0], 102: [None] + [1.0] * 383, 103: mean.tolist(), 104: []}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()] + list(odd.items()), "vec_id long, embedding array<double>").repartition(4)
    began = time.perf_counter()
    got = {r.vec_id: r.v for r in rows.select("vec_id", corrected(F.col("embedding"), mean, direction).alias("v")).collect()}
    assert time.perf_counter() - began < 30
    assert len(got) == 69 and {i: got[i] for i in odd} == odd
    for i, v in vectors.items():
        left = v - mean - ((v - mean) @ direction) * direction
        assert np.allclose(got[i], left / np.linalg.norm(left), atol=1e-12)
