"""Queries of the audit, queue, conversation and join planes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import audits as A
from tessera.operators import queue as Q
from tessera.operators.retrieval import ranked
from tessera.plans.retrieval import table

AS_OF = "2001-08-02"
_n = lambda: F.count(F.lit(1)).alias("n")


def decay_rule_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medium and high confidence, active, last confirmed 180 days ago or never."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.substring("o_orderpriority", 1, 1).cast("int").alias("p"), A.age_days(F.col("o_orderdate"), AS_OF).alias("age"))
    return orders.where((F.col("p") <= 3) & (F.col("o_orderstatus") == "O") & (F.coalesce("age", F.lit(9999)) > 180)).select("o_orderkey", "age")


DECAY1_SQL = f"SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') AS age FROM orders WHERE substr(o_orderpriority, 1, 1)::INT <= 3 AND o_orderstatus = 'O' AND coalesce(date_diff('day', o_orderdate::DATE, DATE '{AS_OF}'), 9999) > 180"


def decay_rule_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims (lines) that are disputed, or open for more than 90 days by the date of their record (order)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), A.age_days(F.col("o_orderdate"), AS_OF).alias("age"))
    stale = (F.col("l_returnflag") == "R") | ((F.col("l_linestatus") == "O") & (F.col("age") > 90))
    return lines.join(orders, "l_orderkey").where(stale).groupBy("l_orderkey").agg(_n(), F.max("age").alias("age"))


DECAY2_SQL = f"SELECT l_orderkey, count(*) AS n, max(date_diff('day', o_orderdate::DATE, DATE '{AS_OF}')) AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' OR (l_linestatus = 'O' AND date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') > 90) GROUP BY 1"


def stale_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States older than their own time to live."""
    ttl = F.when(F.col("o_orderpriority") == "1-URGENT", 30).when(F.col("o_orderpriority") == "2-HIGH", 90).otherwise(365)
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_custkey", A.age_days(F.col("o_orderdate"), AS_OF).alias("age"), ttl.alias("ttl"))
    return orders.where("age > ttl").groupBy("o_custkey").agg(_n(), F.max(F.col("age") - F.col("ttl")).alias("most_over"))


STALE_SQL = f"""WITH o AS (SELECT o_custkey, date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') AS age, CASE o_orderpriority WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 90 ELSE 365 END AS ttl FROM orders WHERE o_orderstatus <> 'F')
SELECT o_custkey, count(*) AS n, max(age - ttl) AS most_over FROM o WHERE age > ttl GROUP BY 1"""


def decay_rule_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significant, confident records of more than 730 days, by year."""
    orders = table(spark, sf_dir, "orders").where((F.col("o_totalprice") > 300_000) & (F.col("o_orderpriority") == "1-URGENT") & (A.age_days(F.col("o_orderdate"), AS_OF) > 730))
    return orders.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(_n(), F.round(F.sum("o_totalprice"), 2).alias("total"))


DECAY4_SQL = f"SELECT year(o_orderdate) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 300000 AND o_orderpriority = '1-URGENT' AND date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') > 730 GROUP BY 1"


def drive_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty open loops (open orders) of most tension, by (score desc, id)."""
    age = A.age_days(F.col("o_orderdate"), AS_OF)
    significance = F.when(F.col("o_totalprice") > 400_000, "high").when(F.col("o_totalprice") > 200_000, "medium").otherwise("low")
    scored = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", A.drive_score(significance, F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey") % 7 == 0, age, F.greatest(age - 10, F.lit(0))).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), F.asc("o_orderkey")).limit(50)


DRIVE_SQL = f"""WITH o AS (SELECT *, date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') AS age FROM orders WHERE o_orderstatus = 'O'),
s AS (SELECT o_orderkey, round((CASE WHEN o_totalprice > 400000 THEN 3.0::DOUBLE WHEN o_totalprice > 200000 THEN 2.0 ELSE 1.0 END + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END + CASE WHEN o_custkey % 7 = 0 THEN 2 ELSE 0 END + least(2.0::DOUBLE, greatest(age, 0) / 7)) * greatest(0::DOUBLE, 1 - greatest(age - 10, 0) / 45), 3) AS score FROM o)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, o_orderkey LIMIT 50"""


def calibration_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the documents of a source are of good quality, and what that makes of it."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    counted = joined.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("hits"), F.count_if(F.col("quality") == 0).alias("misses"), F.count_if(F.col("quality").isNull()).alias("pending"))
    return counted.select("*", A.rate(F.col("hits"), F.col("hits") + F.col("misses")).alias("rate"), A.standing(F.col("hits"), F.col("hits") + F.col("misses")).alias("standing"))


CALIBRATION_SQL = """WITH c AS (SELECT source, count(*) FILTER (quality = 1) AS hits, count(*) FILTER (quality = 0) AS misses, count(*) FILTER (quality IS NULL) AS pending FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT *, CASE WHEN hits + misses = 0 THEN 0 ELSE round(hits / (hits + misses), 3) END::DOUBLE AS rate, CASE WHEN hits + misses = 0 THEN 'unproven' WHEN hits + misses < 3 THEN 'early' WHEN hits / (hits + misses) >= 0.7 THEN 'reliable' WHEN hits / (hits + misses) <= 0.3 THEN 'unreliable' ELSE 'mixed' END AS standing FROM c"""


def failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.count(F.lit(1)).alias("total"))
    return events.withColumn("rate", A.rate(F.col("failed"), F.col("total")))


FAILURE_SQL = "SELECT user_id, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total, round(count(*) FILTER (event_type = 'error') / count(*), 3) AS rate FROM events GROUP BY 1"


def iso_week_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(A.iso_week(F.col("ts")).alias("week"), "event_type").agg(_n(), F.round(F.sum("value"), 2).alias("total"))


WEEK_SQL = "SELECT strftime(ts, '%G-W%V') AS week, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


def jobs_status_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return counted.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(f"n_{c.lower()}") for c in ("F", "O", "P")))


MATRIX_SQL = "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1"


def last_success_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest purchase of each user."""
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return bought.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.event_id", "e.value")


LAST_SQL = "SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs: users are queues, their kinds job types."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "retry_wait").otherwise("queued")
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("queue"), F.col("event_type").alias("job_type"), status.alias("status"), (k % 5).alias("priority"), F.when(k % 3 > 0, F.col("value")).alias("scheduled_for"), F.col("ts").alias("created_at"), (k % 4 + 1).alias("max_attempts"), F.col("props").alias("payload"))


_JOBS = """j AS (SELECT event_id AS id, user_id % 20 AS queue, event_type AS job_type, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' WHEN 'click' THEN 'retry_wait' ELSE 'queued' END AS status, (props->>'$.k')::BIGINT AS k, value, ts AS created_at, props FROM events),
jobs AS (SELECT id, queue, job_type, status, k % 5 AS priority, CASE WHEN k % 3 > 0 THEN value END AS scheduled_for, created_at, k % 4 + 1 AS max_attempts, props AS payload FROM j)"""


def job_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.claim_order(_jobs(spark, sf_dir)).where("position <= 5").select("queue", "position", "id", "priority")


CLAIM_SQL = f"WITH {_JOBS} SELECT queue, row_number() OVER (PARTITION BY queue ORDER BY priority, scheduled_for NULLS FIRST, created_at, id) AS position, id, priority FROM jobs WHERE status = 'queued' QUALIFY position <= 5"


def job_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.coalesce_jobs(_jobs(spark, sf_dir), ["queue", "job_type"])


COALESCE_SQL = f"WITH {_JOBS} SELECT queue, job_type, min(priority) AS priority, max(max_attempts) AS max_attempts, min(scheduled_for) AS scheduled_for, arg_max(payload, created_at) AS payload, count(*) AS coalesced FROM jobs GROUP BY 1, 2"


def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What time and failures make of the jobs, counted: retries, promotions, and runs taken back after 45 minutes."""
    now = F.to_timestamp_ntz(F.lit("2024-01-30 12:00:00"))
    moved = Q.next_state(F.col("status"), now, F.col("created_at"), F.col("created_at"))
    moved = F.when(F.col("status") == "failed", Q.after_failure(F.col("priority"), F.col("max_attempts"))).otherwise(moved)
    return _jobs(spark, sf_dir).groupBy("status", moved.alias("next")).agg(_n())


TRANSITIONS_SQL = f"""WITH {_JOBS} SELECT status, CASE WHEN status = 'failed' THEN CASE WHEN priority < max_attempts THEN 'retry_wait' ELSE 'failed' END WHEN status = 'retry_wait' AND created_at <= TIMESTAMP '2024-01-30 12:00:00' THEN 'queued'
WHEN status = 'running' AND epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(created_at) > 2700000000 THEN 'queued' ELSE status END AS next, count(*) AS n FROM jobs GROUP BY 1, 2"""


def recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next occurrence of each event under a rule made from its number."""
    unit = F.element_at(F.array(*(F.lit(x) for x in "smhdw")), (F.col("event_id") % 5 + 1).cast("int"))
    rule = F.concat(F.lit("every:"), (F.col("event_id") % 9 + 1).cast("string"), unit)
    last = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    events = table(spark, sf_dir, "events").select("event_id", rule.alias("rule"), last.alias("last"))
    return events.select("event_id", Q.next_occurrence(F.col("last"), F.col("rule"), F.lit(1706745600)).cast("long").alias("next"))


RECURRENCE_SQL = """WITH e AS (SELECT event_id, epoch_us(ts) // 1000000 AS last, (event_id % 9 + 1) * ([1, 60, 3600, 86400, 604800])[event_id % 5 + 1] AS period FROM events)
SELECT event_id, CASE WHEN 1706745600 < last THEN last ELSE last + ((1706745600 - last) // period + 1) * period END AS next FROM e"""


def exchange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns that the assistant answers next."""
    over = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    turns = turns.withColumns({"next_role": F.lead("role").over(over), "reply": F.lead("n").over(over)})
    return turns.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("n").alias("asked"), "reply")


PAIRS_SQL = "WITH t AS (SELECT conv_id, turn, role, length(text) AS asked, lead(role) OVER w AS next_role, lead(length(text)) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, asked, reply FROM t WHERE role = 'user' AND next_role = 'assistant'"


def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns of each conversation, the latest first."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ranked(turns, [F.desc("turn"), F.asc("role")], ["conv_id"], 3).select("conv_id", "turn", "role", F.col("rank").cast("long").alias("rank"))


RECENT_SQL = "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS rank FROM conversations QUALIFY rank <= 3"


def dup_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that repeat the one before them, of the same user and kind, within an hour."""
    over = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type").withColumns({"before": F.lag("event_type").over(over), "at": F.lag("ts").over(over)})
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    return events.where((F.col("before") == F.col("event_type")) & (gap <= 3_600_000_000)).select("user_id", "event_id", "event_type")


WINDOW_SQL = "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, lag(ts) OVER w AS earlier FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE before = event_type AND epoch_us(ts) - epoch_us(earlier) <= 3600000000"


def missed_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order in part (never captured), by segment."""
    missed = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return missed.groupBy("c_mktsegment").agg(_n(), F.min("c_custkey").alias("first"))


MISSED_SQL = "SELECT c_mktsegment, count(*) AS n, min(c_custkey) AS first FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY 1"


def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines whose supplier is not among those in credit (links without a target), by supplier."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_suppkey")
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return lines.join(rich, "l_suppkey", "left_anti").groupBy("l_suppkey").agg(_n())


DANGLING_SQL = "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1"


def belief_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and kinds with enough support on enough days, few errors against them; the first seven by support."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    against = events.where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("errors"))
    held = events.where("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("support"), F.count_distinct("day").alias("days")).join(against, "user_id", "left")
    errors = F.coalesce("errors", F.lit(0))
    return held.where((F.col("support") >= 3) & (F.col("days") >= 2) & (errors * 3 <= F.col("support"))).select("user_id", "event_type", "support", "days").orderBy(F.desc("support"), F.asc("user_id"), F.asc("event_type")).limit(7)


BELIEF_SQL = """WITH a AS (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1), h AS (SELECT user_id, event_type, count(*) AS support, count(DISTINCT ts::DATE) AS days FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
SELECT user_id, event_type, support, days FROM h LEFT JOIN a USING (user_id) WHERE support >= 3 AND days >= 2 AND coalesce(errors, 0) * 3 <= support ORDER BY support DESC, user_id, event_type LIMIT 7"""


def pattern_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts (patterns) and what blocks each: support, confidence, missing review, age, contradiction."""
    use = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("support"), F.round(F.avg("l_discount"), 6).alias("confidence"), F.count_if(F.col("l_returnflag") == "R").alias("against"), F.max("l_shipdate").alias("last"))
    parts = table(spark, sf_dir, "part").join(use, F.col("p_partkey") == F.col("l_partkey"), "left")
    codes = A.gate(
        {
            "no_support": F.col("support").isNull(),
            "low_support": F.col("support") < 25,
            "low_confidence": F.col("confidence") < 0.05,
            "not_reviewed": F.col("p_size") % 10 == 0,
            "too_young": A.age_days(F.col("last"), AS_OF) < 7,
            "contradicted": F.col("against") * 2 > F.col("support"),
        }
    )
    return parts.select("p_partkey", F.array_join(codes, ",").alias("blockers"), (F.size(codes) == 0).alias("eligible"))


GATE_SQL = f"""WITH u AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS support, round(avg(l_discount), 6) AS confidence, count(*) FILTER (l_returnflag = 'R') AS against, max(l_shipdate) AS last FROM lineitem GROUP BY 1),
b AS (SELECT p_partkey, concat_ws(',', CASE WHEN support IS NULL THEN 'no_support' END, CASE WHEN support < 25 THEN 'low_support' END, CASE WHEN confidence < 0.05 THEN 'low_confidence' END, CASE WHEN p_size % 10 = 0 THEN 'not_reviewed' END, CASE WHEN date_diff('day', last::DATE, DATE '{AS_OF}') < 7 THEN 'too_young' END, CASE WHEN against * 2 > support THEN 'contradicted' END) AS blockers FROM part LEFT JOIN u ON p_partkey = l_partkey)
SELECT *, blockers = '' AS eligible FROM b"""


def manifest_priority_top200(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_totalprice") > 400_000, 3).when(F.col("o_totalprice") > 200_000, 2).otherwise(1) + F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", rank.cast("long").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated"))
    return orders.orderBy(F.desc("priority"), F.desc("updated"), F.desc("o_orderkey")).limit(200)


MANIFEST_SQL = "SELECT o_orderkey, (CASE WHEN o_totalprice > 400000 THEN 3 WHEN o_totalprice > 200000 THEN 2 ELSE 1 END + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS priority, strftime(o_orderdate, '%Y-%m-%d') AS updated FROM orders ORDER BY priority DESC, updated DESC, o_orderkey DESC LIMIT 200"


def verdict_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most restrictive verdict over a customer's orders (capabilities), and how many of each."""
    level = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    names = F.array(*(F.lit(x) for x in ("allow", "notify", "confirm", "deny")))
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(level).alias("level"), _n())
    return held.select("o_custkey", F.element_at(names, F.col("level") + 1).alias("verdict"), "n")


VERDICT_SQL = "SELECT o_custkey, (['allow', 'notify', 'confirm', 'deny'])[max(CASE WHEN o_orderpriority = '1-URGENT' THEN 3 WHEN o_orderpriority = '2-HIGH' THEN 2 WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) + 1] AS verdict, count(*) AS n FROM orders GROUP BY 1"


def quarantine_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders left after those of quarantined customers (deep in debt) and those that hold a quarantined part."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal < -500").select(F.col("c_custkey").alias("o_custkey"))
    parts = table(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_partkey").alias("l_partkey"))
    orders = table(spark, sf_dir, "lineitem").join(parts, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    left = table(spark, sf_dir, "orders").join(customers, "o_custkey", "left_anti").join(orders, "o_orderkey", "left_anti")
    return left.groupBy("o_orderpriority").agg(_n(), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUARANTINE_SQL = "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < -500) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 50)) GROUP BY 1"


def lineage_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent support of each language: distinct lineages of its documents, by source or else by text."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", A.lineage([F.when(F.col("doc_id") % 3 > 0, F.col("source")), F.md5(F.coalesce("text", F.lit("")))], F.col("doc_id")).alias("k"))
    return docs.groupBy("lang").agg(F.count_distinct("k").alias("independent"), _n())


LINEAGE_SQL = "SELECT lang, count(DISTINCT CASE WHEN doc_id % 3 > 0 THEN source ELSE md5(coalesce(text, '')) END) AS independent, count(*) AS n FROM documents GROUP BY 1"


def cross_kind_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that stand under more than one type."""
    return table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name")).agg(_n(), F.count_distinct("p_type").alias("kinds")).where("n > 1 AND kinds > 1")


CROSS_SQL = "SELECT lower(p_name) AS name, count(*) AS n, count(DISTINCT p_type) AS kinds FROM part GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT p_type) > 1"


def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a kind of event fell by a twentieth of the day before, or more."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(_n())
    return days.withColumn("before", F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))).where("n * 100 <= before * 95")


REGRESSIONS_SQL = "SELECT event_type, day, n, before FROM (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS before FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2)) WHERE n * 100 <= before * 95"


def state_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three states of each customer, repeats in a row taken once, in one line."""
    over = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.lower("o_orderstatus").alias("s")).withColumn("b", F.lag("s").over(over)).where("b IS NULL OR b <> s")
    last = ranked(orders, [F.desc("o_orderdate"), F.desc("o_orderkey")], ["o_custkey"], 3)
    return last.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.negative("rank").alias("r"), "s"))), lambda x: x["s"]), " / ").alias("summary"))


HISTORY_SQL = """WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey, lower(o_orderstatus) AS s, lag(lower(o_orderstatus)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM o WHERE b IS NULL OR b <> s QUALIFY r <= 3)
SELECT o_custkey, string_agg(s, ' / ' ORDER BY r DESC) AS summary FROM r GROUP BY 1"""


def trust_meet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least trusted origin among the lines of each order: owner over agent over tool over external."""
    trust = F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "N", 2).when(F.col("l_linestatus") == "O", 1).otherwise(0)
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(trust).cast("long").alias("trust"))
    return held.groupBy("trust").agg(_n(), F.max("l_orderkey").alias("last"))


TRUST_SQL = "SELECT trust, count(*) AS n, max(l_orderkey) AS last FROM (SELECT l_orderkey, min(CASE WHEN l_returnflag = 'A' THEN 3 WHEN l_returnflag = 'N' THEN 2 WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS trust FROM lineitem GROUP BY 1) GROUP BY 1"


def entity_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals in which a customer's orders keep one status: from, to (open for the last), and how many orders."""
    over = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumn("new", (F.coalesce(F.lag("o_orderstatus").over(over), F.lit("")) != F.col("o_orderstatus")).cast("int"))
    orders = orders.withColumn("epoch", F.sum("new").over(over))
    held = orders.groupBy("o_custkey", "epoch", "o_orderstatus").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("from_day"), _n())
    return held.withColumn("to_day", F.lead("from_day").over(Window.partitionBy("o_custkey").orderBy("epoch")))


EPOCHS_SQL = """WITH a AS (SELECT *, coalesce(lag(o_orderstatus) OVER w, '') <> o_orderstatus AS new FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
b AS (SELECT *, sum(new::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::BIGINT AS epoch FROM a), c AS (SELECT o_custkey, epoch, o_orderstatus, strftime(min(o_orderdate), '%Y-%m-%d') AS from_day, count(*) AS n FROM b GROUP BY 1, 2, 3)
SELECT *, lead(from_day) OVER (PARTITION BY o_custkey ORDER BY epoch) AS to_day FROM c"""


def percentile_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers between the 30th and the 70th hundredth of their segment's ranking by balance, counted and summed."""
    rows = A.placed_in(table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal", "c_custkey"), "c_mktsegment", "c_acctbal", "c_custkey")
    band = rows.where((F.col("place") >= F.floor(F.col("of") * 0.3)) & (F.col("place") < F.floor(F.col("of") * 0.7)))
    return band.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("held"), F.round(F.sum("c_acctbal"), 2).alias("total"))


BAND_SQL = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) - 1 AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_mktsegment, count(*) AS held, round(sum(c_acctbal), 2) AS total FROM r WHERE r >= floor(n * 0.3) AND r < floor(n * 0.7) GROUP BY 1"


def haversine_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers nearest to a point, on coordinates made from their keys; the first twenty in km."""
    lat, lon = F.radians(F.col("s_suppkey") * 37 % 180 - 90), F.radians(F.col("s_suppkey") * 91 % 360 - 180)
    lat0, lon0 = F.radians(F.lit(48.0)), F.radians(F.lit(11.0))
    h = F.pow(F.sin((lat - lat0) / 2), 2) + F.cos(lat) * F.cos(lat0) * F.pow(F.sin((lon - lon0) / 2), 2)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(2 * 6371.0 * F.asin(F.sqrt(h)), 3).alias("km")).orderBy("km", "s_suppkey").limit(20)


HAVERSINE_SQL = "SELECT s_suppkey, round(2 * 6371.0 * asin(sqrt(pow(sin((radians(s_suppkey * 37 % 180 - 90) - radians(48.0)) / 2), 2) + cos(radians(s_suppkey * 37 % 180 - 90)) * cos(radians(48.0)) * pow(sin((radians(s_suppkey * 91 % 360 - 180) - radians(11.0)) / 2), 2))), 3) AS km FROM supplier ORDER BY km, s_suppkey LIMIT 20"


def support_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines for and against each supplier, and the nation that the supplier's support belongs to."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("supporting"), F.count_if(F.col("l_returnflag") == "R").alias("counter"))
    named = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    return named.join(lines, "l_suppkey", "left").groupBy("n_name").agg(F.sum(F.coalesce("supporting", F.lit(0))).alias("supporting"), F.sum(F.coalesce("counter", F.lit(0))).alias("counter"))


SUPPORT_SQL = "SELECT n_name, count(*) FILTER (l_returnflag <> 'R') AS supporting, count(*) FILTER (l_returnflag = 'R') AS counter FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1"


def callback_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the open loops (orders) of each queue the one to come back to: by score, then key; its score is 2 or more,
    it was called back less than twice, and not within the last seven days."""
    key = F.col("o_orderkey")
    loops = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(key, (F.col("o_custkey") % 10).alias("queue"), F.round(F.col("o_totalprice") / 100000, 3).alias("score"), (key % 4).alias("callbacks"), (key % 15).alias("days_since"))
    return A.latest(loops.where("score >= 2 AND callbacks < 2 AND days_since > 7"), ["queue"], [F.desc("score"), F.asc("o_orderkey")])


CALLBACK_SQL = "WITH l AS (SELECT o_orderkey, o_custkey % 10 AS queue, round(o_totalprice / 100000, 3) AS score, o_orderkey % 4 AS callbacks, o_orderkey % 15 AS days_since FROM orders WHERE o_orderstatus = 'O') SELECT * FROM l WHERE score >= 2 AND callbacks < 2 AND days_since > 7 QUALIFY row_number() OVER (PARTITION BY queue ORDER BY score DESC, o_orderkey) = 1"


def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own windows, beyond the rest: events by six hours and kind."""
    held = table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(_n(), F.round(F.sum("value"), 2).alias("total"))
    return held.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


TUMBLING_SQL = "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, with gaps under two hours."""
    held = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(_n())
    return held.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


SESSION_SQL = """WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 7200000000, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1"""


def cube_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(_n(), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return held.select(F.coalesce("l_returnflag", F.lit("*")).alias("l_returnflag"), F.coalesce("l_linestatus", F.lit("*")).alias("l_linestatus"), "n", "quantity")


CUBE_SQL = "SELECT coalesce(l_returnflag, '*') AS l_returnflag, coalesce(l_linestatus, '*') AS l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"

_ALL = [
    (decay_rule_1, DECAY1_SQL), (decay_rule_2, DECAY2_SQL), (stale_ttl, STALE_SQL), (decay_rule_4, DECAY4_SQL), (drive_score, DRIVE_SQL), (calibration_standing, CALIBRATION_SQL),
    (failure_rate, FAILURE_SQL), (iso_week_rollup, WEEK_SQL), (jobs_status_matrix, MATRIX_SQL), (last_success_per_type, LAST_SQL), (job_claim_order, CLAIM_SQL), (job_coalesce, COALESCE_SQL),
    (job_transitions, TRANSITIONS_SQL), (recurrence, RECURRENCE_SQL), (exchange_pairs, PAIRS_SQL), (recent_turns, RECENT_SQL), (dup_event_window, WINDOW_SQL), (missed_capture, MISSED_SQL),
    (dangling_links, DANGLING_SQL), (belief_candidates, BELIEF_SQL), (pattern_gate, GATE_SQL), (manifest_priority_top200, MANIFEST_SQL), (verdict_lattice, VERDICT_SQL), (quarantine_filter, QUARANTINE_SQL),
    (lineage_support, LINEAGE_SQL), (cross_kind_duplicates, CROSS_SQL), (regressions, REGRESSIONS_SQL), (state_history, HISTORY_SQL), (trust_meet, TRUST_SQL), (entity_epochs, EPOCHS_SQL),
    (percentile_band, BAND_SQL), (haversine_nearby, HAVERSINE_SQL), (support_rollup, SUPPORT_SQL), (callback_selection, CALLBACK_SQL), (tumbling_events, TUMBLING_SQL), (session_events, SESSION_SQL), (cube_sales, CUBE_SQL),
]
QUERIES = {f.__name__: f for f, _ in _ALL}
SQL = {f.__name__: sql for f, sql in _ALL}
