"""URL rules, licenses, decontamination, fingerprints and BPE."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, fingerprint, license_scan, url_filter
from tessera.llm.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    df = QUERIES[name](spark, path)
    found = con.sql(SQL[name])
    at = [found.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())


URLS = [None, "", "no scheme", "http://", "https://NET/", "http://a.net", "http://a.net/x?y#z", "http://w.Example.NET/en/1", "http://example.net/en", "http://example.com/de/?q", "http://xexample.com/de/", "http://b.example.org/fr/", "ftp://org/fr/x", "http://net.org/fr", "http://é.net/", "http://a.net:80/", "x://y://z.net/"]


def by_hand(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h), len(p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def test_url_rules(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    expected = [(i, *by_hand(u)) for i, u in enumerate(URLS)]
    pick = lambda df: sorted(tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect())
    assert pick(url_filter.judge_urls(pages)) == expected
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", 2)
    assert pick(url_filter.judge_urls(pages)) == expected
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    twice = [*url_filter.RULES, ("net", "/", "allow"), ("org", "/fr/", "block")]
    clashing = pages.withColumns({"_row": F.lit("mine"), "best": F.lit("own"), "of": F.lit("x"), "judged": F.lit("j"), "row": F.lit("r"), "verdict": F.lit("v")})
    for most in (2, 100):
        monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", most)
        assert pick(url_filter.judge_urls(pages, twice)) == expected  # the first of equal rules holds
        got = url_filter.judge_urls(clashing.unionByName(clashing), twice).collect()
        assert len(got) == 2 * len(expected) and {(r["_row"], r["best"], r["of"]) for r in got} == {("mine", "own", "x")}
        of_table = pick(url_filter.judge_urls(pages, spark.createDataFrame(twice[:4], "a string, b string, c string")))
        assert of_table == expected


def test_licenses(spark, docs, empty):
    rows = [(1, "Copyright 2020 me\nReleased under the  mit LICENCE!"), (2, "text\nLicensed under CC BY-NC 4.0.\nmore"), (3, None), (None, "Released under the MIT License."), (5, "released under the MIT license yesterday")]
    got = {r[0]: tuple(r)[1:] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", "MIT", 1), 2: (None, "CC-BY-NC-4.0", 1), 3: (None, "", 0), None: ("MIT", "MIT", 1), 5: (None, "", 0)}
    assert license_scan.scan_licenses(docs).count() == docs.select("doc_id").distinct().count()
    assert license_scan.scan_licenses(empty).count() == 0


def test_decontamination(spark, docs, empty):
    item = "If Anna buys 12 apples and 3 pears for 5 dollars each, how many euros does Anna have left today?"
    bench = spark.createDataFrame([(1, item, "x"), (2, "too short", "x"), (3, None, "x"), (None, item, "x")], "item_id long, text string, lang string")
    changed = item.replace("Anna", "Maria").replace("12", "40")
    uneven = item.replace("Anna buys", "Maria buys")
    rows = [(1, f"words before {item} and after"), (2, changed), (3, uneven), (4, "nothing of it"), (5, None), (5, item), (None, item), (6, item.upper().replace("12", "x"))]
    found = {(r.doc_id, r.item_id): r.kind for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert found == {(1, 1): "verbatim", (2, 1): "reparameterised", (5, 1): "verbatim"}
    assert {r.doc_id for r in decontaminate.drop_leaking(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()} == {3, 4, 6, None}
    assert decontaminate.drop_leaking(docs, bench).columns == docs.columns
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_by_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    clean = lambda t: " ".join((t or "").split())
    items = [(r.item_id, clean(r.text)) for r in bench.collect()]
    expected = {(d.doc_id, i) for d in docs.collect() for i, t in items if t in clean(d.text) and len(t.split()) >= decontaminate.WINDOW}
    assert expected <= {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}


def test_fingerprints(spark, docs, corpus, empty):
    got = fingerprint.compare_with_edits(docs).collect()
    ordered = sorted(((i, t or "") for i, t in corpus), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    expected = []
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        n = len(t) // 4
        expected.append((i, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    assert sorted(map(str, expected)) == sorted(str(tuple(r)[:3]) for r in got)
    same = {}
    for r in fingerprint.fingerprints(docs).collect():
        assert same.setdefault(r.text or "", r.fingerprint) == r.fingerprint
    assert fingerprint.compare_with_edits(empty).count() == 0


def test_likeness_estimates_weighted_jaccard():
    rng, sampler, off = random.Random(4), fingerprint.Sampler(256), []
    for _ in range(60):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(5, 300))]
        b = a[: rng.randint(0, len(a))] + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 100))]
        x, y = (Counter(tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))) for t in (a, b))
        true = sum((x & y).values()) / max(1, sum((x | y).values()))
        off.append(fingerprint.likeness(*sampler.of_texts([" ".join(t).encode() for t in (a, b)])) - true if b else 0.0)
    assert abs(sum(off) / len(off)) < 0.02 and max(map(abs, off)) < 0.2


def test_bpe_is_the_library(spark, docs, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(bpe.default_path())
    got = bpe.decode(bpe.encode(docs.select("doc_id", "text"))).collect()
    for r in got:
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == reference.decode(ids, skip_special_tokens=False)
    odd = ["<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "\x1c\x1fx\x85y\xa0z", "ΑΣ Σ", "İI ẞ ſ ﬁ", "e\u0301 \u200b \ufeff", "don't we'LL I'd", "x" * 3000, "日本語 тест 😀", "1234 ½ ²", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|", "\0<|endoftext|>"]
    frame = spark.createDataFrame([(t, "clash") for t in odd], "text string, ids string")
    for r in bpe.decode(bpe.encode(frame)).collect():
        ids = reference.encode(r.text, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == reference.decode(ids, skip_special_tokens=False), r.text


def test_compatible_pairs_are_those_that_merging_keeps():
    model = bpe.model_of(bpe.default_path())
    rng = random.Random(6)
    inner = [t for t in range(model.n) if model.tokens[t].isascii() and model.tokens[t].isalpha() and len(model.tokens[t]) < 8]
    last = [t for t in range(model.n) if model.tokens[t].endswith(bpe.END) and model.tokens[t][:-4].isascii() and model.tokens[t][:-4].isalpha()]
    import numpy as np

    a, b = (np.array([rng.choice(x) for _ in range(4000)]) for x in (inner, last))
    for x, y, good in zip(a, b, model.compatible(a, b)):
        letters = [*model.tokens[x], *model.tokens[y][:-4]]
        ids = [*(int(model.single[0, ord(c)]) for c in letters[:-1]), int(model.single[1, ord(letters[-1])])]
        assert good == (model.merged(ids) == [x, y])


def test_bpe_steps_are_bounded():
    texts = pa.array([None, "one two " * 60_000, "", *["three four " * 500] * 400])
    steps = list(bpe._slices(texts))
    assert max(x.nbytes for x in steps) < 1_100_000 and pa.concat_arrays(steps) == texts and bpe.CACHE_PIECES <= 100_000
