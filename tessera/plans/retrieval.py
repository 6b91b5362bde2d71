"""Queries of the retrieval, usage-mining and vector planes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.functions import text as T
from tessera.operators import retrieval as R
from tessera.operators.vectors import calibrate, corrected, nearest
from tessera.session import spread, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, for work on their texts."""
    return spread(table(spark, sf_dir, "documents"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth benchmark item, as a search."""
    return table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select("item_id", T.query_terms(F.col("text")).alias("q"))


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", T.query_terms(F.coalesce("text", F.lit(""))).alias("terms"))
    scored = R.bm25(docs, "doc_id", F.col("terms"), _queries(spark, sf_dir), "item_id", F.col("q"))
    return scored.withColumn("score", F.round("score", 6))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(_bm25(spark, sf_dir), [F.desc("score"), F.desc("doc_id")], ["item_id"], R.LANE_LIMIT).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


BM25_CTE = r"""
d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9][A-Za-z0-9_-]+'), lambda x: length(x) > 2) AS terms FROM documents),
q AS (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9][A-Za-z0-9_-]+'), lambda x: length(x) > 2)) AS term FROM benchmark WHERE item_id % 50 = 0),
qt AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY 1, 2),
st AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avg_dl FROM d),
p AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
n AS (SELECT term, count(*) AS n FROM p GROUP BY 1),
b AS (SELECT item_id, doc_id, round(sum(qtf * CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score
      FROM p JOIN qt USING (term) JOIN n USING (term), st GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS rank FROM b QUALIFY rank <= 30)"""
BM25_SQL = f"WITH {BM25_CTE} SELECT item_id, doc_id, score, rank FROM bm"


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and length of documents, toxic ones behind: the lane that needs no query."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    score = F.coalesce("quality", F.lit(0)) * 0.7 - F.coalesce("toxic", F.lit(0)) * 1.5 + F.least(F.col("n_chars"), F.lit(2000)) / 2000
    return docs.select("doc_id", F.round(score, 6).alias("score"))


def metadata_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(_metadata(spark, sf_dir), [F.desc("score"), F.desc("doc_id")], [], R.LANE_LIMIT).select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


META_CTE = """
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
m AS (SELECT doc_id, round(coalesce(quality, 0) * 0.7 - coalesce(toxic, 0) * 1.5 + least(n_chars, 2000) / 2000, 6) AS score FROM documents LEFT JOIN l USING (doc_id)),
meta AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id DESC) AS rank FROM m QUALIFY rank <= 30)"""
META_SQL = f"WITH {META_CTE} SELECT doc_id, score, rank FROM meta"


def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword lane and the metadata lane of every search, fused by reciprocal rank."""
    words = bm25_topk(spark, sf_dir).select("item_id", "doc_id", F.lit("bm25").alias("lane"), "rank")
    meta = _queries(spark, sf_dir).select("item_id").join(F.broadcast(metadata_lane(spark, sf_dir).select("doc_id", F.lit("metadata").alias("lane"), "rank")))
    return R.fuse(words.unionByName(meta), "doc_id", ["item_id"]).select("item_id", "doc_id", "rrf", F.col("n_lanes").cast("long").alias("n_lanes"), "lanes", F.col("rank").cast("long").alias("rank"))


HYBRID_SQL = f"""WITH {BM25_CTE}, {META_CTE},
lanes AS (SELECT item_id, doc_id, 'bm25' AS lane, rank FROM bm UNION ALL SELECT item_id, doc_id, 'metadata', rank FROM benchmark, meta WHERE item_id % 50 = 0),
f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf, count(DISTINCT lane) AS n_lanes, string_agg(DISTINCT lane, ',' ORDER BY lane) AS lanes FROM lanes GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, n_lanes DESC, doc_id) AS rank FROM f QUALIFY rank <= 20"""


def _topk(rows: DataFrame) -> DataFrame:
    """The ten nearest vectors of every fiftieth one."""
    found = nearest(rows, rows.where("vec_id % 50 = 0"), 10)
    return R.ranked(found, [F.desc("score"), F.asc("vec_id")], ["query_id"], 10).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def anisotropy_corrected_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As cosine_topk, on vectors without the corpus mean and strongest direction. No SQL: the power iteration."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = calibrate(rows)
    return _topk(rows if found is None else written(spread(rows).select("vec_id", corrected(F.col("embedding"), *found).alias("embedding"))))


COSINE_SQL = """
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.npmi_edges(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def npmi_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


NPMI_CTE = """
s0 AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS i FROM lineitem WHERE l_partkey IS NOT NULL),
s AS (SELECT * FROM s0 WHERE e IN (SELECT e FROM s0 GROUP BY 1 HAVING count(*) >= 2)),
tot AS (SELECT count(DISTINCT e) AS n FROM s), c AS (SELECT i, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.i AS x, b.i AS y, count(*) AS co FROM s a JOIN s b ON a.e = b.e AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 3),
m AS (SELECT x, y, co, round(ln((co / n) / (ca.c / n * cb.c / n)) / -ln(co / n), 4) AS npmi FROM p JOIN c ca ON ca.i = x JOIN c cb ON cb.i = y, tot WHERE co < n),
edges AS (SELECT * FROM (SELECT x AS source, y AS target, co AS co_count, npmi FROM m WHERE npmi >= 0.3 UNION ALL SELECT y, x, co, npmi FROM m WHERE npmi >= 0.3)
          QUALIFY row_number() OVER (PARTITION BY source ORDER BY npmi DESC, target) <= 8)"""
NPMI_SQL = f"WITH {NPMI_CTE} SELECT * FROM edges"


def learned_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "part").where("p_size < 10").select("p_partkey")
    found = R.learned_partners(_edges(spark, sf_dir), seeds, "p_partkey")
    return found.select(F.col("target").alias("p_partkey"), "npmi", F.col("rank").cast("long").alias("rank"))


PARTNERS_SQL = f"""WITH {NPMI_CTE}, seeds AS (SELECT p_partkey FROM part WHERE p_size < 10),
f AS (SELECT target AS p_partkey, max(npmi) AS npmi FROM edges WHERE source IN (FROM seeds) AND target NOT IN (FROM seeds) GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY npmi DESC, p_partkey) AS rank FROM f QUALIFY rank <= 5"""


def two_hop_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every fiftieth customer, each a search of its own, over their orders to parts, within two hops."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    seeds = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("search"), key("c", "c_custkey").alias("id"), F.lit(0.8).alias("score"))
    to_order = table(spark, sf_dir, "orders").select(key("c", "o_custkey").alias("source_id"), key("o", "o_orderkey").alias("target_id"), F.when(F.col("o_orderstatus") == "F", "linked_claims").otherwise("links").alias("relation"))
    to_part = table(spark, sf_dir, "lineitem").select(key("o", "l_orderkey").alias("source_id"), key("p", "l_partkey").alias("target_id"), F.when(F.col("l_returnflag") == "R", "supporting_evidence").otherwise("other").alias("relation"))
    found = R.expand(seeds, to_order.unionByName(to_part), 40, ["search"])
    return found.select("search", "id", F.round("score", 4).alias("score"), "hop", F.col("rank").cast("long").alias("rank"))


EXPAND_SQL = """
WITH seeds AS (SELECT c_custkey AS search, 'c' || c_custkey AS id, 0.8::DOUBLE AS score FROM customer WHERE c_custkey % 50 = 0),
e AS (SELECT 'c' || o_custkey AS s, 'o' || o_orderkey AS t, CASE WHEN o_orderstatus = 'F' THEN 0.45::DOUBLE ELSE 0.2 END AS bonus FROM orders
      UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, CASE WHEN l_returnflag = 'R' THEN 0.5::DOUBLE ELSE 0.15 END FROM lineitem),
h1 AS (SELECT search, t AS id, max(greatest(0.1, 0.85 * score + bonus - 0.08)) AS score, 1::BIGINT AS hop FROM seeds JOIN e ON s = id GROUP BY 1, 2),
h2 AS (SELECT h1.search, t AS id, max(greatest(0.1, bonus - 0.16)) AS score, 2::BIGINT AS hop FROM h1 JOIN e ON s = id GROUP BY 1, 2)
SELECT search, id, round(score, 4) AS score, hop, row_number() OVER (PARTITION BY search ORDER BY hop, score DESC, id) AS rank FROM (FROM h1 UNION ALL FROM h2) QUALIFY rank <= 40"""


def edge_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges made from line items, counted after the whitelist."""
    kinds = lambda c, *pairs: F.element_at(F.create_map(*(F.lit(x) for p in pairs for x in p)), F.col(c))
    edges = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        "l_linenumber",
        kinds("l_returnflag", ("A", "claim"), ("R", "evidence"), ("N", "artifact")).alias("source_type"),
        kinds("l_linestatus", ("O", "claim"), ("F", "evidence")).alias("target_type"),
        F.element_at(F.array(*(F.lit(x) for x in ("links", "linked_claims", "supporting_evidence", "artifact_provenance"))), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("relation"),
    )
    return R.allowed_edges(edges).groupBy("source_type", "target_type", "relation").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(R.relation_bonus(F.col("relation"))), 4).alias("bonus"))


_RULES = ", ".join(f"('{s}', '{t or '*'}', '{r}')" for s, targets, relations in L.EDGE_WHITELIST for t in (targets or [None]) for r in relations)
_BONUS = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in L.RELATION_BONUS.items())
WHITELIST_SQL = f"""
WITH rules(source_type, t, relation) AS (VALUES {_RULES}),
e AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'claim' WHEN 'R' THEN 'evidence' WHEN 'N' THEN 'artifact' END AS source_type, CASE l_linestatus WHEN 'O' THEN 'claim' WHEN 'F' THEN 'evidence' END AS target_type,
      (['links', 'linked_claims', 'supporting_evidence', 'artifact_provenance'])[l_linenumber % 4 + 1] AS relation FROM lineitem),
k AS (SELECT DISTINCT e.* FROM e JOIN rules r ON r.source_type = e.source_type AND r.relation = e.relation AND r.t IN ('*', e.target_type))
SELECT source_type, target_type, relation, count(*) AS n, CASE relation {_BONUS} ELSE {L.DEFAULT_RELATION_BONUS} END AS bonus FROM k GROUP BY 1, 2, 3"""


def domain_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain with the most keyword hits in each text, the first listed of equals."""
    docs = texts(spark, sf_dir).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    hits = docs.select("doc_id", *(T.count_present(F.col("low"), terms).alias(d) for d, terms in L.DOMAIN_KEYWORDS.items()))
    best = F.greatest(*L.DOMAIN_KEYWORDS)
    name = F.coalesce(*(F.when((F.col(d) == best) & (best > 0), d) for d in L.DOMAIN_KEYWORDS), F.lit("cross_arena"))
    return hits.select("doc_id", name.alias("domain"), F.round(F.when(best > 0, F.least(F.lit(1.0), 0.35 + 0.15 * best)).otherwise(0.25), 2).alias("confidence"))


_count = lambda terms: " + ".join(f"contains(low, '{t}')::INT" for t in terms)
DOMAIN_SQL = f"""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
h AS (SELECT doc_id, {", ".join(f"{_count(terms)} AS {d}" for d, terms in L.DOMAIN_KEYWORDS.items())} FROM d),
b AS (SELECT *, greatest({", ".join(L.DOMAIN_KEYWORDS)}) AS best FROM h)
SELECT doc_id, CASE WHEN best = 0 THEN 'cross_arena' {" ".join(f"WHEN {d} = best THEN '{d}'" for d in L.DOMAIN_KEYWORDS)} END AS domain, round(CASE WHEN best > 0 THEN least(1.0, 0.35 + 0.15 * best) ELSE 0.25 END, 2)::DOUBLE AS confidence FROM b"""


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of 32 digest bytes; what is shown: their largest entry, where it is, and the sum."""
    hexed = texts(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    raw = hexed.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr("h", i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = raw.withColumn("n", norm).select("doc_id", F.transform("v", lambda x: F.round(x / F.col("n"), 6)).alias("v"))
    return unit.select("doc_id", F.array_max("v").alias("largest"), F.array_position("v", F.array_max("v")).cast("long").alias("at"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


HASH_SQL = """
WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
r AS (SELECT doc_id, list_transform(range(32), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::INT / 255) AS v FROM h),
u AS (SELECT doc_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) AS v FROM r)
SELECT doc_id, list_max(v) AS largest, list_position(v, list_max(v))::BIGINT AS at, round(list_sum(v), 6) AS total FROM u"""


def nearest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label (to four digits) and its norm: the centroid of a part of the corpus."""
    at = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = at.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 4).alias("norm"), F.count(F.lit(1)).alias("dims"))


CENTROID_SQL = """
WITH e AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2)
SELECT label, round(sqrt(sum(m * m)), 4) AS norm, count(*) AS dims FROM m GROUP BY 1"""

QUERIES = {
    "hybrid_retrieval": hybrid_retrieval,
    "bm25_topk": bm25_topk,
    "metadata_lane": metadata_lane,
    "cosine_topk": cosine_topk,
    "anisotropy_corrected_topk": anisotropy_corrected_topk,
    "npmi_edges": npmi_edges,
    "learned_partners": learned_partners,
    "two_hop_expand": two_hop_expand,
    "edge_whitelist": edge_whitelist,
    "domain_inference": domain_inference,
    "hash_embedding": hash_embedding,
    "label_centroids": nearest_labels,
}
SQL = {
    "hybrid_retrieval": HYBRID_SQL,
    "bm25_topk": BM25_SQL,
    "metadata_lane": META_SQL,
    "cosine_topk": COSINE_SQL,
    "npmi_edges": NPMI_SQL,
    "learned_partners": PARTNERS_SQL,
    "two_hop_expand": EXPAND_SQL,
    "edge_whitelist": WHITELIST_SQL,
    "domain_inference": DOMAIN_SQL,
    "hash_embedding": HASH_SQL,
    "label_centroids": CENTROID_SQL,
}
