"""Spelling variants against a brute force over deletion neighbourhoods."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import spelling


def lowered(run):
    return "".join(c.lower() if c.isascii() else c for c in run)


def counted(rows):
    found = Counter()
    for i, text in rows:
        for run in map(lowered, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
            found[word] += len(word) >= 6
    return {w: n for w, n in found.items() if n >= 5}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a != b and (a[i:] == b[i + 1 :] if len(a) < len(b) else len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def by_hand(counts):
    by_hole = defaultdict(set)
    for w in counts:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_hole[key].add(w)
    near = defaultdict(set)
    for group in by_hole.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    forms = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= 5 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n, len(near[w]), counts[forms[w]] if forms[w] else None))
    return out


def rows(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_the_scan_finds_all_pairs():
    rng = random.Random(1)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abé😀") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 60))})
        assert sorted(spelling.scan(words)) == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])]


def test_the_query_on_documents(spark):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    expected = by_hand(counted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist())))
    assert len(expected) > 100 and any(r[1] for r in expected)
    assert rows(spelling.query(spark, "/root/testdata/sf0.01")) == expected


@pytest.mark.parametrize("most", [2, 40, 20_000])
def test_groups_of_any_size(spark, most):
    """Words with one prefix, dense in edits, chains of forms; hot groups are halved again."""
    rng = random.Random(2)
    words = {"aaaaaa"[:3] + "".join(rng.choice("ab") for _ in range(rng.randint(3, 6))) for _ in range(300)} | {"".join(rng.choice("xyz") for _ in range(rng.randint(6, 13))) for _ in range(300)}
    words |= {"chainé", "chainée", "chainées", "chainéesx"}
    counts = {w: 5 ** rng.randint(1, 6) for w in words} | {"chainé": 5**8, "chainée": 5**6, "chainées": 5**4, "chainéesx": 5}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    expected = by_hand(counts)
    assert any(r[2] == "chainé" and r[0] == "chainéesx" for r in expected)
    assert rows(spelling.variants(frame, most=most)) == expected


def test_odd_rows(spark, docs, corpus, empty):
    got = spelling.word_counts(docs)
    assert {r.word: r.n for r in got.collect()} == counted(corpus)
    assert spelling.variants(spelling.word_counts(empty)).count() == 0
    odd = [(1, "×÷×÷×÷ " * 6), (2, "ÀÉÎÕÜÿ " * 5 + "Straße1STRASSE " * 5), (None, "letter " * 9), (None, None), (3, "")] * 2
    frame = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"word": F.lit("w"), "run": F.lit("r"), "id": F.lit("i")})
    assert {r.word: r.n for r in spelling.word_counts(frame).collect()} == counted(odd)
