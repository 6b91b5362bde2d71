"""Every query that has SQL gives the rows that DuckDB gives for it."""

import math
import os

import duckdb
import numpy as np
import pytest

from tessera.operators.vectors import calibrate
from tessera.plans import catalogue

DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return repr(round(float(x), 9) + 0.0) if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    found = duck.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    at = [found.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_every_other_query_has_sql():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"anisotropy_corrected_topk", "budgeted_expansion", "full_retrieval", "ivf_topk"}


def test_the_index_finds_what_the_exact_search_does(spark):
    pairs = lambda name: {(r.query_id, r.vec_id) for r in catalogue.QUERIES[name](spark, DATA).collect()}
    true = pairs("cosine_topk")
    assert len(true & pairs("ivf_topk")) >= 0.9 * len(true)


def test_budgets_hold(spark):
    rows = catalogue.QUERIES["budgeted_expansion"](spark, DATA).collect()
    kept = [r.search for r in rows if r.kept]
    assert len(kept) > 20 and max(map(kept.count, set(kept))) <= 5 and {r.reason for r in rows} > {"quarantined", "cross_domain_bridging_not_justified"}


def test_anisotropy_by_numpy(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas().sort_values("vec_id")
    m = np.stack(rows["embedding"]).astype(float)
    centred = m - m.mean(0)
    top = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    mean, direction = calibrate(spark.read.parquet(f"{DATA}/embeddings.parquet"))
    assert np.allclose(mean, m.mean(0))
    spread = centred.T @ centred / len(m)
    assert direction @ spread @ direction > 0.9 * (top @ spread @ top)
    left = centred - np.outer(centred @ direction, direction)
    left /= np.linalg.norm(left, axis=1, keepdims=True)
    found = catalogue.QUERIES["anisotropy_corrected_topk"](spark, DATA).where("query_id = 0").orderBy("rank").collect()
    scores = np.round(left @ left[0], 6)
    order = [i for i in np.lexsort((np.arange(len(m)), -scores)) if i][:10]
    assert [r.vec_id for r in found] == order and np.allclose([r.score for r in found], scores[order], atol=2e-6)
    assert calibrate(spark.read.parquet(f"{DATA}/embeddings.parquet").limit(10)) is None


def test_all_lanes_are_fused(spark):
    rows = catalogue.QUERIES["full_retrieval"](spark, DATA).collect()
    seen = {lane for r in rows for lane in r.lanes.split("+")}
    assert {"sql", "fts", "fts_reply", "vector"} <= seen and all(r.rank <= 20 for r in rows)
    assert len({(r.search, r.id) for r in rows}) == len(rows)
