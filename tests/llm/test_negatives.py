"""Hard negatives against brute force; the bounds of scores lose none."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, block string, score string"


def by_hand(rows):
    """rows: {vec_id: (label, integer vector)}."""
    out = []
    for a, (label, v) in rows.items():
        if a % 50:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, (_, w) in rows.items() if i != a and len(w) == len(v))
        near = [(i, -s) for s, i in scores if rows[i][0] == label][:5]
        for i, p in near:
            far = [(j, -s) for s, j in scores if rows[j][0] != label and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(a, i, k + 1, j, p, n) for k, (j, n) in enumerate(far)]
    return sorted(out)


def made(rng, n, dim=6):
    centres = [rng.normal(size=dim) for _ in range(4)]
    rows = []
    for i in range(n):
        v = centres[i % 4] + rng.normal(size=dim) * (0.05 if i % 2 else 0.7)
        v /= np.linalg.norm(v)
        rows.append([i, v.astype(np.float32).tolist(), int(rng.integers(0, 3)) if i % 3 else 1])
    for i in range(n // 3, 2 * n // 3):
        rows[i][1] = rows[0][1]  # one very common vector
    rows[20][1] = [0.0] * dim
    return rows


def whole(v):
    return tuple(int(np.floor(256 * float(x))) for x in v)


@pytest.mark.parametrize("sizes", [None, (7, 3, 2, 40)])
def test_against_brute_force(spark, monkeypatch, sizes):
    if sizes:
        for name, n in zip(("BLOCK_ROWS", "ANCHOR_ROWS", "SHARE", "SORTED_ROWS"), sizes):
            monkeypatch.setattr(negatives, name, n)
    rows = made(np.random.default_rng(3), 400)
    rows += [[450, [1.0, 0.5], 1], [451, [1.0, 0.25], 1], [452, [0.5, 0.25], 2], [500, [], 1], [501, [], 1], [502, [], 0]]  # other lengths
    good = {i: (label, whole(v)) for i, v, label in rows}
    odd = [[600, None, 1], [601, [0.0] * 6, None], [602, [0.5, None] + [0.0] * 4, 1], [650, [float("nan")] + [0.1] * 5, 1], [700, [float("inf")] * 6, 2], [None, [0.1] * 6, 1], [703, [1e30] * 6, 1]]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows + odd + rows[:50]], SCHEMA).repartition(3)
    got = negatives.hard_negatives(negatives.prepared(frame), F.col("vec_id") % 50 == 0).collect()
    expected = by_hand(good)
    assert len(expected) > 50 and any(r[0] == 450 for r in expected) and any(r[0] == 500 for r in expected)
    assert sorted(tuple(r) for r in got) == expected


def test_large_components_and_empty_tables(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-2e5, 2e5) for _ in range(5)], rng.randrange(2)) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = negatives.hard_negatives(negatives.prepared(frame), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in got.collect()) == by_hand({i: (label, whole(v)) for i, v, label in rows})
    assert negatives.hard_negatives(negatives.prepared(frame), F.lit(False)).count() == 0
    assert negatives.hard_negatives(negatives.prepared(frame.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(5)
    for dim, spread in ((2, 0.1), (5, 1.0), (64, 0.02)):
        centres = rng.normal(size=(6, dim))
        v = np.floor(256 * (centres[rng.integers(0, 6, 300)] + spread * rng.normal(size=(300, dim))) * 10.0 ** rng.integers(0, 4, (300, 1)))
        references = {dim: negatives._units(centres)}
        own = negatives.angles(v, references)
        norms = np.sqrt((v**2).sum(1)).astype(np.float32)
        low, high = negatives.bounds(own, norms, own, own, norms, norms)
        scores = v @ v.T
        assert (low <= scores).all() and (scores <= high).all()
        low, high = negatives.bounds(own, norms, own[:20].min(0, keepdims=True), own[:20].max(0, keepdims=True), norms[:20].min(), norms[:20].max())
        assert (low <= scores[:, :20]).all() and (scores[:, :20] <= high).all()
    assert (high[:, 0] < norms * norms[:20].max()).any()
