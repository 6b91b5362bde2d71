"""Both deduplications against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import phrase_automata, repeats, suffix_dedup
from tessera.llm.repeats import gram_hashes, governed


def brute(units, size, join):
    """(n, removed, digest) of each sequence of units."""
    cut = lambda u, i: bytes(u[i : i + size]) if isinstance(u, bytes) else tuple(u[i : i + size])
    seen = Counter(cut(u, i) for u in units for i in range(len(u) - size + 1))
    out = []
    for u in units:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - size + 1):
            if seen[cut(u, i)] > 1:
                gone[i : i + size] = True
        out.append((len(u), int(gone.sum()), hashlib.sha256(join([u[i : i + 1] if isinstance(u, bytes) else u[i] for i in np.flatnonzero(~gone)])).hexdigest()))
    return out


@pytest.mark.parametrize("module, size, cut, join, n", [(phrase_automata, 35, bytes.split, b" ".join, "n_words"), (suffix_dedup, 400, bytes, b"".join, "n_bytes")])
@pytest.mark.parametrize("hot", [None, 3000, 1])
def test_whole(docs, corpus, empty, monkeypatch, module, size, cut, join, n, hot):
    """hot: bytes beyond which an anchor is divided; with 1, blocks and then single windows do all the work."""
    if hot:
        monkeypatch.setattr(repeats, "HOT_BYTES", hot)
    expected = brute([cut((t or "").encode()) for _, t in corpus], size, join)
    got = module.remove_repeats(docs).select("doc_id", n, "n_removed", "kept_sha256", "kept").collect()
    key = lambda x: (x[0] is not None, *map(str, x))
    assert sorted(((i, *e) for (i, _), e in zip(corpus, expected)), key=key) == sorted(((r[0], r[1], r[2], r[3]) for r in got), key=key)
    for r in got:
        assert hashlib.sha256(r.kept.encode() if isinstance(r.kept, str) else bytes(r.kept)).hexdigest() == r.kept_sha256
    assert sum(r.n_removed for r in got) > 0
    assert module.remove_repeats(empty).count() == 0


def test_repeated_starts_on_small_strings():
    rng = random.Random(1)
    for _ in range(80):
        base = bytes(rng.choice(b"ab") for _ in range(300))
        texts = []
        for _ in range(rng.randint(1, 8)):
            parts = [base[(a := rng.randint(0, 290)) : a + rng.randint(1, 60)] + bytes(rng.choice(b"abcd\0") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 4))]
            texts.append(b"".join(parts))
        size = rng.choice([3, 9, 14, 20, 33, 40])
        seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
        assert [x.tolist() for x in suffix_dedup.repeated_starts(texts, size)[0]] == [[i for i in range(len(t) - size + 1) if seen[t[i : i + size]] > 1] for t in texts]


def test_anchors_govern_every_window_alike():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abc") for _ in range(400))
    texts = [text, b"xyz" + text[100:300], b"", b"short"]
    units, counts = suffix_dedup.byte_hashes(texts)
    anchors, first, last = governed(units, counts, 50, 8)
    starts = [s for a, b in zip(first, last) for s in range(a, b + 1)]
    assert starts == [*range(351), *range(400, 400 + 154)]
    of = {s: a for a, f, b in zip(anchors, first, last) for s in range(f, b + 1)}
    assert all(of[100 + i] == of[403 + i] for i in range(151))
    grams = gram_hashes(units, 13)
    assert len(grams) == len(units) - 12 and len({grams[100 + i] == grams[403 + i] for i in range(180)}) == 1


def test_shorter_repeats_are_reported_and_stay(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages, rows = [text(53)[:330] for _ in range(60)], []
    for p in passages:
        rows += [f"{text(200)} {p} {text(200)}", f"{text(150)} {p} {text(90)}"]
    rows += [text(400) for _ in range(60)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(r.n_removed == 0 and r.n_repeated <= 340 and bytes(r.kept).decode() == rows[i] for i, r in got.items())
    assert sum(got[i].n_repeated >= suffix_dedup.PASSAGE for i in range(120)) >= 0.85 * 120
    assert all(got[i].n_repeated == 0 for i in range(120, 180))
