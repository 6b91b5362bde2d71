"""Links against brute force over all pairs."""

import random

import numpy as np

from tessera.llm import jaccard_join
from tessera.llm.signature_tree import linked_pairs, spanning


def shingles(text, n):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows, n, percent):
    sets, label = [shingles(t, n) for _, t in rows], list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def test_components(docs, corpus, empty):
    key = lambda x: tuple((v is not None, v) for v in x)
    got = jaccard_join.link_rows(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == sorted(components(corpus, 4, 85), key=key)
    assert jaccard_join.link_rows(empty).count() == 0


def test_keep_one(docs, corpus):
    kept = jaccard_join.keep_one(docs, words=5, percent=80)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    of = components(corpus, 5, 80)
    with_words = {c for _, n, c in of if n}
    assert sorted(c for c in with_words if c is not None) == sorted({d for d, t in rows if t and t.strip() and d is not None})
    assert sum(1 for d, _ in rows if d == 61) == 2 and sum(1 for d, _ in rows if d == 60) == 1
    assert sum(1 for _, t in rows if not (t or "").strip()) == sum(1 for _, t in corpus if not (t or "").strip())
    assert all(r.row_key == "clash" for r in kept.collect())


def test_blocks_lose_no_link(spark, docs, monkeypatch):
    expected = {tuple(r) for r in jaccard_join.link_rows(docs).select("doc_id", "n_shingles", "component_id").collect()}
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "CLUSTER_BLOCK", 2)
    assert {tuple(r) for r in jaccard_join.link_rows(docs).select("doc_id", "n_shingles", "component_id").collect()} == expected


def test_tree_finds_all_pairs():
    rng = random.Random(3)
    sets = []
    for _ in range(60):
        base = rng.choice(sets) if sets and rng.random() < 0.7 else set(rng.sample(range(10**6), rng.randint(5, 80)))
        sets.append({x for x in base if rng.random() > 0.05} | set(rng.sample(range(10**6), 2)))
    rows = [np.array(sorted(s), np.uint64) for s in sets]
    sizes = np.array([len(s) for s in sets])
    i, j = linked_pairs(jaccard_join.exact_bits(rows), sizes, 85, exact=True)
    expected = {(a, b) for a in range(60) for b in range(a + 1, 60) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert expected and set(zip(i.tolist(), j.tolist())) == expected
    hashed = np.stack([jaccard_join.folded(jaccard_join.sketch(np.sort(r * np.uint64(0x9E3779B97F4A7C15)), 85)[2], 6) for r in rows])
    a, b = linked_pairs(hashed, sizes, 85, exact=False)
    assert expected <= set(zip(a.tolist(), b.tolist()))
    assert spanning(5, np.array([0, 3]), np.array([4, 4])).tolist() == [0, 1, 2, 0, 0]
