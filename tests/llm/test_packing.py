"""Packing: every id in one piece, sequences without gaps, next to no padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")


def check(rows, expected, most_open):
    """rows against the documents' ids ({key: ids} by doc_id, ids unique), and sequences that may be padded."""
    pieces, sequences, steps = defaultdict(list), defaultdict(list), defaultdict(set)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        steps[r.step_id].add(r.sequence_id)
    assert pieces.keys() == expected.keys()
    for i, own in pieces.items():
        at, ids = 0, expected[i]
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    lengths = []
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.tier == own[0].tier and r.step_id == own[0].step_id
            at += r.length
        assert at <= own[0].tier <= 4096
        lengths.append(at)
    assert sum(n & (n - 1) > 0 for n in lengths) <= most_open
    return lengths


def test_documents_are_packed_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    model = tokenizers.Tokenizer.from_file(bpe.default_path())
    expected = {r.doc_id: [*model.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.select("doc_id", "text").collect()}
    rows = packing.pack(docs).collect()
    lengths = check(rows, expected, 1)
    padding = sum(4096 - n for n in lengths if n & (n - 1))
    assert padding < 0.01 * sum(lengths) and lengths.count(4096) > 50 and len(rows) < 2 * len(expected) + len(lengths)
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.step_id] += r.length
    assert sorted(tokens.values())[len(tokens) // 2] > packing.STEP_TOKENS / 2 and max(tokens.values()) <= 2 * packing.STEP_TOKENS


def test_packer_cuts_and_fills(monkeypatch):
    rng = random.Random(4)
    for _ in range(60):
        packer, sizes = packing.Packer(64, 4), [rng.choice([1, 2, 3, 20, 63, 64, 65, 300]) for _ in range(rng.randint(0, 40))]
        docs = {i: np.arange(n, dtype=np.int32) + i for i, n in enumerate(sizes)}
        for i, ids in docs.items():
            packer.add(i, ids)
            if rng.random() < 0.3:
                packer.pack()
        packer.pack()
        assert packer.tokens < 64
        packer.close_rest()
        seen = defaultdict(list)
        for k, (tier, parts) in enumerate(packer.sequences):
            used = sum(p[2] for p in parts)
            assert used == tier or k == len(packer.sequences) - 1 and used < 64
            for i, start, n, crc, total in parts:
                assert total == len(docs[i]) and crc == zlib.crc32(docs[i][start : start + n].astype("<u4").tobytes())
                seen[i] += range(start, start + n)
        assert {i: sorted(x) for i, x in seen.items()} == {i: list(range(n)) for i, n in enumerate(sizes)}


def test_step_groups_are_even():
    rng = random.Random(5)
    sizes = [rng.choice([256, 512, 1024, 2048, 4096]) for _ in range(500)]
    tokens = defaultdict(int)
    for n, k in zip(sizes, packing.step_groups(sizes)):
        tokens[k] += n
    assert len(tokens) == round(sum(sizes) / packing.STEP_TOKENS) and max(tokens.values()) - min(tokens.values()) <= 256
    assert packing.step_groups([]) == [] and packing.step_groups([7]) == [0]


def test_odd_rows(spark, docs, corpus, empty, monkeypatch):
    clashing = docs.withColumns({c: F.lit("mine") for c in ("ids", "start", "tier", "sequence_id")})
    assert packing.pack(clashing.where(F.col("doc_id").isNull())).count() == 2
    model = tokenizers.Tokenizer.from_file(bpe.default_path())
    texts = defaultdict(list)
    for i, t in corpus:
        texts[i].append(t or "")
    single = clashing.where(F.col("doc_id").isNotNull() & ~F.col("doc_id").isin(60, 61))
    expected = {i: [*model.encode(t[0], add_special_tokens=False).ids, 2] for i, t in texts.items() if i not in (None, 60, 61)}
    check(packing.pack(single).collect(), expected, 1)
    monkeypatch.setattr(packing, "POOL_TOKENS", 300)  # many rounds, and many tasks for what is left
    check(packing.pack(single).collect(), expected, 40)
    assert packing.pack(docs).agg(F.sum("length")).first()[0] == sum(len(model.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in corpus)
    assert packing.pack(empty).count() == 0
