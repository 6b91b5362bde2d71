"""Queries of reviews, blockers, what is due, and the report on the whole collection, over records made of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import reviews as W
from tessera.plans.retrieval import table

AS_OF = "1998-09-02"
_pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.expr(n) % len(values) + 1).cast("int"))
_name = lambda letter, n: F.concat(F.lit(letter), F.expr(f"cast({n} AS string)"))


def claim_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as claims, some of them hostile; their order lines are the evidence."""
    claims = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.when(F.expr("p_partkey % 5 = 0"), " was targeted, obviously").otherwise(" came")).alias("text"))
    said = _pick(["he asked for it", "she never had it", "it lay there", "they noted it", "no word", "nothing"], "l_linenumber + l_suppkey")
    evidence = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("claim_id"), F.col("l_orderkey").alias("id"), said.alias("summary"))
    return W.review_claims(claims, evidence).withColumn("errors", F.array_join("errors", ","))


CLAIMS_SQL = """WITH e AS (SELECT l_partkey AS id, count(*) AS n, count(*) FILTER ((l_linenumber + l_suppkey) % 6 IN (0, 3)) AS s, count(*) FILTER ((l_linenumber + l_suppkey) % 6 = 1) AS c FROM lineitem WHERE l_quantity > 40 GROUP BY 1),
p AS (SELECT p_partkey AS id, coalesce(n, 0) AS n, coalesce(s, 0) AS supporting, coalesce(c, 0) AS contradicting, p_partkey % 5 = 0 AS h FROM part LEFT JOIN e ON id = p_partkey),
q AS (SELECT id, supporting, contradicting, array_to_string(list_filter([CASE WHEN h THEN 'confirmation_bias' END, CASE WHEN h THEN 'mind_reading' END, CASE WHEN n = 0 THEN 'insufficient_alternative_hypotheses' END], lambda x: x IS NOT NULL), ',') AS errors, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + 0.15::DOUBLE * supporting - 0.15::DOUBLE * contradicting - CASE WHEN h THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN n = 0 THEN 0.2::DOUBLE ELSE 0 END)), 6) AS confidence FROM p)
SELECT *, CASE WHEN contradicting > 0 OR confidence < 0.45 THEN 'disputed' WHEN confidence >= 0.75 AND supporting > 0 THEN 'confirmed' ELSE 'active' END AS status, CASE WHEN confidence < 0.35 THEN 'hold' WHEN contradicting > 0 OR supporting = 0 THEN 'revise' ELSE 'approve' END AS action FROM q"""


def pattern_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as patterns, every code of what blocks them; orders are their records, some of which contradict."""
    k = F.col("p_partkey")
    first = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("o"), F.max("l_orderkey").alias("p"), F.count_distinct("l_suppkey").alias("n"))
    override = F.when(k % 6 == 0, F.struct(F.lit(True).alias("enabled"), F.when(k % 12 == 0, "why").otherwise("").alias("reason"), F.when(k % 18 == 0, "agent").otherwise("user").alias("approved_by")))
    patterns = table(spark, sf_dir, "part").join(first, k == F.col("l_partkey"), "left").select(
        k.cast("string").alias("id"), _pick(["confirmed", "skeptic_reviewed", "candidate", "stale", "integrated", "odd"], "p_partkey").alias("status"), _pick(["habit", "identity_claim"], "p_size").alias("pattern_type"), F.when(k % 9 != 0, F.date_format(F.date_sub(F.lit(AS_OF).cast("date"), F.col("p_size")), "yyyy-MM-dd")).alias("created"), (F.col("p_size") / 50).alias("confidence"),
        F.array(_name("o", "o")).alias("links"), F.array_repeat(_name("o", "p"), F.expr("cast(coalesce(n, 0) % 5 AS int)")).alias("supporting_records"), F.array().cast("array<string>").alias("counterexamples"), F.when(k % 7 != 0, F.array(F.lit("x"))).alias("alternative_explanations"), (k % 8 != 0).alias("searched"), (k % 10 == 0).alias("strength_override"), override.alias("override"),
    )
    reviews = table(spark, sf_dir, "part").where("p_partkey % 4 <> 3").select(_name("v", "p_partkey").alias("id"), k.cast("string").alias("reviewed_record_id"), (k % 4 != 2).alias("approved_for_use"))
    records = table(spark, sf_dir, "orders").select(_name("o", "o_orderkey").alias("id"), _pick(["claim", "episode", "skeptical_review", "episode", "episode", "contradiction_log", "episode", "episode"], "o_orderkey").alias("type"), F.when(F.col("o_orderstatus") == "F", "disputed").otherwise("active").alias("status"), F.when(F.col("o_orderstatus") == "F", 0.25).otherwise(0.9).alias("confidence"), F.lit("high").alias("risk"), (F.col("o_orderstatus") != "P").alias("approved"))
    found = W.pattern_blockers(patterns, reviews, records, AS_OF)
    return found.select("id", F.array_join("blockers", ",").alias("blockers"), "eligible")


BLOCKERS_SQL = f"""WITH l AS (SELECT l_partkey, min(l_orderkey) AS o, max(l_orderkey) AS p, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1), g AS (SELECT o_orderkey FROM orders WHERE (o_orderkey % 8 = 0 AND o_orderstatus = 'F') OR (o_orderkey % 8 = 2 AND o_orderstatus = 'P') OR o_orderkey % 8 = 5),
b AS (SELECT p_partkey AS k, ['supported', 'skeptic_reviewed', 'candidate', 'stale', 'integrated', 'candidate'][p_partkey % 6 + 1] AS st, CASE WHEN p_size % 2 = 1 THEN 30 ELSE 7 END AS least, p_size, p_partkey % 9 <> 0 AS dated, coalesce(n, 0) % 5 AS sup, p_partkey % 6 = 0 AS en, p_partkey % 12 = 0 AS re, p_partkey % 6 = 0 AND p_partkey % 18 <> 0 AS us, o IN (FROM g) OR (coalesce(n, 0) % 5 > 0 AND p IN (FROM g)) AS grave FROM part LEFT JOIN l ON l_partkey = p_partkey),
c AS (SELECT k::VARCHAR AS id, array_to_string(list_filter([CASE WHEN st NOT IN ('skeptic_reviewed', 'supported') THEN 'status=' || st END, CASE WHEN st IN ('stale', 'integrated') THEN 'status_blocked=' || st END, CASE WHEN k % 4 IN (2, 3) THEN 'review.approved=false' END, CASE WHEN sup < 3 AND k % 10 <> 0 THEN 'supporting_records<3' END, CASE WHEN k % 8 = 0 THEN 'counterexample_search.performed=false' END, CASE WHEN k % 7 = 0 THEN 'missing_alternative_explanations' END, CASE WHEN p_size / 50 < 0.65 THEN 'confidence<0.65' END,
 CASE WHEN NOT dated THEN 'missing_created_date' WHEN p_size < least AND NOT (en AND re AND us) THEN 'age<' || least || 'd' END, CASE WHEN st = 'stale' THEN 'blocked_status=stale' END, CASE WHEN grave THEN 'unresolved_high_severity_contradiction' END, CASE WHEN en AND NOT re THEN 'integration_override.reason_missing' END, CASE WHEN en AND NOT us THEN 'integration_override.approved_by!=user' END], lambda x: x IS NOT NULL), ',') AS blockers FROM b)
SELECT *, blockers = '' AS eligible FROM c"""


def _collection(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as files, lines as claims, events as calls and confirmations, conversations as they are."""
    written = F.date_format("o_orderdate", "yyyy-MM-dd")
    files = table(spark, sf_dir, "orders").select(
        _name("o", "o_orderkey").alias("id"), _pick(["state", "open_loop", "entity", "contradiction_log", "claim"], "o_orderkey").alias("type"), F.concat(F.when(F.expr("o_orderkey % 40 = 4"), "drafts/").otherwise("records/"), _name("o", "o_orderkey"), F.when(F.expr("o_orderkey % 80 = 4"), "-needs_revision").otherwise(""), F.lit(".md")).alias("path"), F.when(F.expr("o_orderkey % 40 = 4"), "needs_revision").when(F.col("o_orderstatus") == "O", "active").otherwise("done").alias("status"), F.col("o_orderpriority").alias("summary"),
        written.alias("updated"), F.when(F.expr("o_orderkey % 3 = 0"), written).otherwise("").alias("review_after"), F.when(F.expr("o_orderkey % 2 = 0"), 30).alias("ttl_days"), F.when(F.expr("o_orderkey % 50 = 7"), "blocked").alias("task_status"), written.alias("created"), F.when(F.expr("o_orderkey % 3 = 1"), written).alias("last_confirmed"),
    )
    shipped = F.date_format("l_shipdate", "yyyy-MM-dd")
    claims = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.lit("reported").alias("claim_type"), F.col("l_returnflag").alias("claim_text"), _pick(["unresolved", "disputed", "hypothesis", "active"], "l_linenumber").alias("status"), F.when(F.col("l_linestatus") == "O", shipped).otherwise("").alias("review_after"), shipped.alias("created"))
    confirmations = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(_name("e", "event_id").alias("id"), _name("o", "event_id % 1000").alias("task_id"), F.when(F.expr("event_id % 2 = 0"), "pending").otherwise("closed").alias("status"), F.when(F.expr("event_id % 2 = 1"), "expired").alias("resolution"), F.lit("1998-09-03").alias("expires"))
    conversations = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count(F.lit(1)).alias("turns")).select("id", F.lit(None).cast("string").alias("thread"), "turns", F.when(F.expr("id % 2 = 0"), "closed").alias("mode_status"), F.lit("1998-09-01").alias("updated"))
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("at"), (F.col("event_type") != "error").alias("success"))
    vectors = table(spark, sf_dir, "embeddings").select(_name("o", "vec_id").alias("id"))
    backups = table(spark, sf_dir, "orders").select(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("at"))
    return {"files": files, "claims": claims, "confirmations": confirmations, "conversations": conversations, "calls": calls, "vectors": vectors, "backups": backups}


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that waits for somebody, from eight sources."""
    c = _collection(spark, sf_dir)
    return W.review_items(c["files"], c["claims"], c["confirmations"], c["conversations"], c["backups"], AS_OF)


def health_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on the whole collection."""
    c = _collection(spark, sf_dir)
    return W.health_sections(c["files"], c["claims"], c["calls"], {"files": c["files"], "claims": c["claims"]}, c["vectors"], c["backups"], AS_OF)


_D = f"DATE '{AS_OF}'"
_COLLECTION = """f AS (SELECT o_orderkey AS k, 'o' || o_orderkey AS id, ['state', 'open_loop', 'entity', 'contradiction_log', 'claim'][o_orderkey % 5 + 1] AS type, o_orderkey % 40 = 4 AS draft, CASE WHEN o_orderkey % 40 = 4 THEN 'needs_revision' WHEN o_orderstatus = 'O' THEN 'active' ELSE 'done' END AS status, o_orderpriority AS summary, strftime(o_orderdate, '%Y-%m-%d') AS updated, o_orderdate::DATE AS d, o_orderkey % 3 = 0 AS rev, o_orderkey % 2 = 0 AS ttl FROM orders),
c AS (SELECT concat_ws('.', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id, l_returnflag AS claim_text, ['unresolved', 'disputed', 'hypothesis', 'active'][l_linenumber % 4 + 1] AS status, l_shipdate::DATE AS d, l_linestatus = 'O' AS rev FROM lineitem WHERE l_quantity = 50)"""
ITEMS_SQL = f"""WITH {_COLLECTION}, x AS (SELECT 'o' || (event_id % 1000) AS id, count(*) AS n FROM events WHERE event_type = 'purchase' AND event_id % 2 = 1 GROUP BY 1), v AS (SELECT conv_id AS id, count(*) AS turns FROM conversations GROUP BY 1)
SELECT 'state' AS category, id, summary, updated AS due FROM f WHERE type = 'state' AND ttl AND {_D} - d > 30
UNION ALL SELECT 'open_loop', id, summary, CASE WHEN rev THEN updated ELSE 'now' END FROM f WHERE type = 'open_loop' AND status = 'active' AND (NOT rev OR d <= {_D})
UNION ALL SELECT 'claim', id, 'reported | ' || claim_text, CASE WHEN rev THEN strftime(d, '%Y-%m-%d') ELSE 'now' END FROM c WHERE status IN ('unresolved', 'disputed') AND (NOT rev OR d <= {_D})
UNION ALL SELECT 'draft', id, summary, CASE WHEN rev THEN updated ELSE 'now' END FROM f WHERE draft AND (NOT rev OR d <= {_D})
UNION ALL SELECT 'conversation', id::VARCHAR, 'Active conversation (' || turns || ' turns)', '1998-09-01' FROM v WHERE id % 2 = 1
UNION ALL SELECT 'backup', 'backup', 'old backup', max(updated) FROM f HAVING {_D} - max(d) > 30
UNION ALL SELECT 'pending confirmation', 'e' || event_id, 'awaits approval for o' || (event_id % 1000), '1998-09-03' FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0
UNION ALL SELECT 'blocked task', f.id, CASE WHEN n >= 2 THEN 'expired ' || n || ' times; ' ELSE '' END || 'task_status=blocked: ' || summary, '' FROM f LEFT JOIN x USING (id) WHERE k % 50 = 7"""
HEALTH_SQL = f"""WITH {_COLLECTION}, e AS (SELECT 'o' || vec_id AS id FROM embeddings), r AS (SELECT event_id FROM events WHERE event_type = 'error' ORDER BY 1 DESC LIMIT 5)
SELECT 'stale domains' AS section, id AS item, ({_D} - d)::VARCHAR AS value FROM f WHERE type = 'state' AND ttl AND {_D} - d > 30
UNION ALL SELECT 'open loops', id, (rev AND d < {_D})::VARCHAR FROM f WHERE type = 'open_loop' AND status = 'active'
UNION ALL SELECT 'contradictions', id, ({_D} - d > 90)::VARCHAR FROM f WHERE type = 'contradiction_log'
UNION ALL SELECT 'claims', id, status FROM c WHERE (status = 'unresolved' AND d < {_D} - 90) OR status = 'disputed' OR (status = 'hypothesis' AND d < {_D} - 180)
UNION ALL SELECT 'entity decay', id, CASE WHEN k % 3 = 1 THEN updated ELSE '' END FROM f WHERE type = 'entity' AND status = 'active' AND (k % 3 <> 1 OR d < {_D} - 365)
UNION ALL SELECT 'manifest', 'total', least(count(*), 200)::VARCHAR FROM f WHERE status = 'active' UNION ALL SELECT 'backup', 'days', ({_D} - max(d))::VARCHAR FROM f
UNION ALL SELECT 'calls', 'total', count(*)::VARCHAR FROM events UNION ALL SELECT 'calls', event_id::VARCHAR, lpad(event_id::VARCHAR, 12, '0') FROM r
UNION ALL SELECT 'index', 'files', count(*)::VARCHAR FROM f UNION ALL SELECT 'index', 'claims', count(*)::VARCHAR FROM c
UNION ALL SELECT 'embeddings', 'vectors', count(*)::VARCHAR FROM e UNION ALL SELECT 'embeddings', 'pending', count(*)::VARCHAR FROM f WHERE id NOT IN (FROM e)
UNION ALL SELECT 'drafts', 'total', count(*)::VARCHAR FROM f WHERE draft UNION ALL SELECT 'drafts', 'blocked', count(*)::VARCHAR FROM f WHERE draft AND k % 80 = 4"""

QUERIES = {"claim_reviews": claim_reviews, "pattern_blockers": pattern_blockers, "review_items": review_items, "health_sections": health_sections}
SQL = {"claim_reviews": CLAIMS_SQL, "pattern_blockers": BLOCKERS_SQL, "review_items": ITEMS_SQL, "health_sections": HEALTH_SQL}
