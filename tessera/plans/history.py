"""Queries of links, decisions, logs, task gates and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.operators import history as H
from tessera.operators.retrieval import ranked
from tessera.plans.retrieval import table
from tessera.plans.rules import _BATCHES_SQL, _REC, _batches, _pick, _records

_n = lambda: F.count(F.lit(1)).alias("n")
_sql = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


def wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes (made of parts) as prose, and what they link to."""
    note = F.concat(F.lit("See [["), F.col("p_name"), F.lit("#top|the "), F.col("p_brand"), F.lit("]], [["), F.col("p_type"), F.lit("]] and [["), F.upper("p_type"), F.lit("]]![[pic.png]]."))
    notes = table(spark, sf_dir, "part").select("p_partkey", note.alias("note"))
    return notes.select("p_partkey", H.without_wikilinks(F.col("note")).alias("prose"), F.array_join(H.wikilink_targets(F.col("note")), ",").alias("targets"))


WIKI_SQL = "SELECT p_partkey, 'See the ' || p_brand || ', ' || p_type || ' and ' || upper(p_type) || '.' AS prose, p_name || ',' || p_type AS targets FROM part"


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of Atom feeds; a feed holds the parts of one size."""
    entry = F.concat(F.lit("<entry><id>"), F.col("p_partkey").cast("string"), F.lit("</id><title>"), F.col("p_name"), F.lit("</title></entry>"))
    feeds = table(spark, sf_dir, "part").groupBy("p_size", F.floor(F.col("p_partkey") / 1000)).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("xml"))
    return H.feed_entries(feeds, "xml").select("id", "title")


FEED_SQL = "SELECT p_partkey::VARCHAR AS id, p_name AS title FROM part"


def link_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of two sources in one list."""
    links = H.merged_links(F.array(F.col("p_brand"), F.lit(" "), F.concat(F.lit(" "), F.col("p_type"))), F.array(F.col("p_type"), F.lit(None), F.col("p_name"), F.col("p_brand")))
    return table(spark, sf_dir, "part").groupBy(F.array_join(links, ",").alias("links")).agg(_n())


LINKS_SQL = "SELECT p_brand || ',' || p_type || ',' || p_name AS links, count(*) AS n FROM part GROUP BY 1"


def related_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fiftieth part, as a new decision, the three former ones on its subject."""
    text = F.concat_ws(" ", F.lit("we decided on"), F.concat("p_name", F.lit("s")), "p_type")
    decisions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), H.subject_tokens(text).alias("tokens"))
    return H.related_decisions(decisions.where("id % 50 = 0").withColumnRenamed("id", "asked"), decisions, least=3)


RELATED_SQL = f"""WITH w AS (SELECT p_partkey AS id, regexp_extract_all(lower('we decided on ' || p_name || 's ' || p_type), '[a-z0-9][a-z0-9_-]+') AS w FROM part),
s AS (SELECT id, list_distinct(list_filter(list_transform(w, lambda x: CASE WHEN ends_with(x, 'ing') AND length(x) > 5 THEN x[:-4] WHEN ends_with(x, 'ed') AND length(x) > 4 THEN x[:-3] WHEN ends_with(x, 'es') AND length(x) > 4 THEN x[:-3] WHEN ends_with(x, 's') AND length(x) > 3 THEN x[:-2] ELSE x END), lambda x: length(x) > 2 AND NOT list_contains({_sql(L.DECISION_STOPWORDS)}, x))) AS t FROM w),
p AS (SELECT a.id AS asked, b.id, len(list_intersect(a.t, b.t))::BIGINT AS shared FROM s a, s b WHERE a.id % 50 = 0 AND a.id <> b.id)
SELECT * FROM p WHERE shared >= 3 QUALIFY row_number() OVER (PARTITION BY asked ORDER BY shared DESC, id) <= 3"""


def log_spill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as customers' logs that keep three entries; filled orders are folded."""
    log = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", (F.col("o_orderstatus") == "F").alias("folded"))
    return H.spilled(log, ["o_custkey"], ["o_orderdate", "o_orderkey"], "folded", 3).groupBy("o_custkey").agg(F.count_if("spilled").alias("spilled"), F.count_if(~F.col("spilled")).alias("kept"))


SPILL_SQL = """WITH l AS (SELECT o_custkey, row_number() OVER w AS place, count(*) OVER (PARTITION BY o_custkey) AS n, sum((o_orderstatus <> 'F')::INT) OVER w AS open FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, count(*) FILTER (place <= n - 3 AND open = 0) AS spilled, count(*) FILTER (NOT (place <= n - 3 AND open = 0)) AS kept FROM l GROUP BY 1"""

_KINDS = ["run_script", "research", "notify", "dance", "", "draft"]
_SCOPES = ["home", "work", "", "money"]


def task_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks, by the rule that decides them and its verdict."""
    key = F.col("o_orderkey")
    tasks = table(spark, sf_dir, "orders").select(key.alias("task"), _pick(_KINDS, key).alias("kind"), _pick(_SCOPES, F.col("o_custkey")).alias("scope"), F.array(_pick(_SCOPES, F.floor(key / 7))).alias("blocked"))
    delegations = spark.createDataFrame([("home", "read_files", "allow"), ("home", "write_files", "allow"), ("home", "run_local_scripts", "notify"), ("work", "web_research", "allow"), ("work", "write_files", "deny"), ("money", "send_outbound_message", "deny")], "scope string, capability string, verdict string")
    return H.task_verdicts(tasks, delegations).groupBy("rule", "verdict").agg(_n())


GATE_SQL = f"""WITH t AS (SELECT o_orderkey AS task, ({_sql(_KINDS)})[o_orderkey % 6 + 1] AS kind, ({_sql(_SCOPES)})[o_custkey % 4 + 1] AS scope, ({_sql(_SCOPES)})[o_orderkey // 7 % 4 + 1] AS blocked FROM orders),
k(kind, capability) AS (VALUES {", ".join(f"('{k}', '{c}')" for k, cs in H.CAPABILITIES.items() for c in cs)}),
d(scope, capability, level) AS (VALUES ('home', 'read_files', 1), ('home', 'write_files', 1), ('home', 'run_local_scripts', 2), ('work', 'web_research', 1), ('work', 'write_files', 4), ('money', 'send_outbound_message', 4)),
w AS (SELECT task, max(coalesce(level, 3)) AS level FROM t JOIN k USING (kind) LEFT JOIN d USING (scope, capability) GROUP BY 1),
r AS (SELECT task, CASE WHEN kind = '' THEN 'no_task_kind' WHEN kind NOT IN ('run_script', 'research', 'collect', 'draft', 'notify') THEN 'unknown_task_kind' WHEN scope = '' THEN 'no_scope' WHEN scope = blocked THEN 'misfiled_task' ELSE 'delegation' END AS rule FROM t)
SELECT rule, CASE rule WHEN 'delegation' THEN ({_sql(H.VERDICTS)})[level] WHEN 'no_scope' THEN 'report_only' ELSE 'deny' END AS verdict, count(*) AS n FROM r LEFT JOIN w USING (task) GROUP BY 1, 2"""

_PRIORITIES = ["1. more small widgets", "steel bolts", "red things"]


def priority_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_name").agg(_n()).select("p_name", "n", H.priority_place(F.concat("p_name", F.lit(" widgets, perhaps")), _PRIORITIES[1:]).cast("long").alias("place"))


PRIORITY_SQL = "SELECT p_name, count(*) AS n, (CASE WHEN list_has_any(regexp_extract_all(lower(p_name || ' widgets, perhaps'), '[a-z0-9][a-z0-9-]{3,}'), ['steel', 'bolts']) THEN 0 WHEN list_has_any(regexp_extract_all(lower(p_name || ' widgets, perhaps'), '[a-z0-9][a-z0-9-]{3,}'), ['things']) THEN 1 ELSE 1000000 END)::BIGINT AS place FROM part GROUP BY 1"


def factual_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, whole and their first 40 characters beside them, every second one as a question, by speaker."""
    whole = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").select("role", "turn", F.explode(F.array(whole, F.substring(whole, 1, 40))).alias("text"))
    text = F.concat("text", F.when(F.col("turn") % 4 < 2, "?").otherwise(""))
    return rows.groupBy("role", H.factual_question(text).alias("factual")).agg(_n())


FACTUAL_SQL = r"""WITH w AS (SELECT role, turn, unnest([coalesce(text, ''), coalesce(text, '')[1:40]]) AS t FROM conversations), t AS (SELECT role, t || CASE WHEN turn % 4 < 2 THEN '?' ELSE '' END AS t FROM w)
SELECT role, len(list_filter(regexp_split_to_array(t, '[.!?\n]'), lambda s: trim(s, ' ') <> '')) <= 2 AND contains(t, '?') AND NOT (contains(lower(t), 'i ') OR contains(lower(t), 'i''m') OR contains(lower(t), 'my ') OR contains(lower(t), 'me ') OR contains(lower(t), 'i''ve')) AS factual, count(*) AS n FROM t GROUP BY 1, 2"""


def discovered_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = {"small_loop": ["small", "tiny"], "metal_loop": ["steel", "brass"], "absent": ["zeppelin"], "shape_loop": ["ring", "bolt", "gear"], "colour_loop": ["red", "blue"], "deal_loop": ["economy", "promo"]}
    records = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return H.discovered(records, templates)


DISCOVERED_SQL = """WITH r AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS t FROM part),
h AS (SELECT id, unnest([CASE WHEN contains(t, 'small') OR contains(t, 'tiny') THEN '0 small_loop' END, CASE WHEN contains(t, 'steel') OR contains(t, 'brass') THEN '1 metal_loop' END, CASE WHEN contains(t, 'zeppelin') THEN '2 absent' END, CASE WHEN contains(t, 'ring') OR contains(t, 'bolt') OR contains(t, 'gear') THEN '3 shape_loop' END, CASE WHEN contains(t, 'red') OR contains(t, 'blue') THEN '4 colour_loop' END, CASE WHEN contains(t, 'economy') OR contains(t, 'promo') THEN '5 deal_loop' END]) AS p FROM r),
g AS (SELECT p, count(DISTINCT id) AS support, min(id) AS first FROM h WHERE p IS NOT NULL GROUP BY 1 HAVING support >= 2 ORDER BY p LIMIT 5) SELECT p[3:] AS pattern_type, support, first FROM g"""


def expired_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks (users, by day) whose confirmations (errors) have expired twice, neither less nor more."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(_n(), F.max("event_id").alias("last")).where("n = 2").drop("n")


EXPIRED_SQL = "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, max(event_id) AS last FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) = 2"


def batch_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is due for review, of four sources, by the day it is due: the first hundred."""
    day = lambda c, n: F.date_format(F.date_add(F.col(c).cast("date"), n), "yyyy-MM-dd")
    row = lambda df, kind, ref, due: df.select(F.lit(kind).alias("kind"), F.col(ref).cast("string").alias("ref"), due.alias("due"))
    orders, lines, events = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "events"))
    parts = [
        row(orders.where("o_orderstatus = 'P'"), "confirmation", "o_orderkey", day("o_orderdate", 7)),
        row(orders.where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'"), "open_loop", "o_orderkey", day("o_orderdate", 14)),
        row(lines.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("d")), "dispute", "l_orderkey", day("d", 30)),
        row(events.where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("d")), "failure", "user_id", day("d", 1)),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return ranked(every, [F.asc("due"), F.asc("kind"), F.asc("ref")], [], 100).withColumn("rank", F.col("rank").cast("long"))


REVIEW_SQL = """WITH r AS (SELECT 'confirmation' AS kind, o_orderkey::VARCHAR AS ref, strftime(o_orderdate::DATE + 7, '%Y-%m-%d') AS due FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'open_loop', o_orderkey::VARCHAR, strftime(o_orderdate::DATE + 14, '%Y-%m-%d') FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'
UNION ALL SELECT 'dispute', l_orderkey::VARCHAR, strftime(max(l_shipdate)::DATE + 30, '%Y-%m-%d') FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey
UNION ALL SELECT 'failure', user_id::VARCHAR, strftime(max(ts)::DATE + 1, '%Y-%m-%d') FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT *, row_number() OVER (ORDER BY due, kind, ref) AS rank FROM r QUALIFY rank <= 100"""


def quarantine_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What quarantining batches makes of their records: artifacts are quarantined, what waits is canceled."""
    held = _batches(spark, sf_dir).withColumn("held", F.lit(True))
    met = _records(spark, sf_dir).join(held, "batch_id", "left")
    after = F.when(F.col("held") & (F.col("type") == "artifact"), "quarantined").when(F.col("held") & F.col("status").isin("draft", "disputed"), "canceled").otherwise(F.col("status"))
    return met.groupBy("type", after.alias("status")).agg(_n())


CASCADE_SQL = f"WITH {_REC}, {_BATCHES_SQL} SELECT type, CASE WHEN batch_id IN (FROM bat) AND type = 'artifact' THEN 'quarantined' WHEN batch_id IN (FROM bat) AND status IN ('draft', 'disputed') THEN 'canceled' ELSE status END AS status, count(*) AS n FROM rec GROUP BY 1, 2"


def self_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished jobs (orders) as episodes, counted by month: kind, outcome, significance."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'P')")
    outcome = F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed")
    rows = done.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.when(F.col("o_orderpriority") == "1-URGENT", "plan").otherwise("task").alias("kind"), outcome.alias("outcome"))
    return rows.withColumn("significance", F.when(F.col("outcome") == "failed", "medium").otherwise("low")).groupBy("month", "kind", "outcome", "significance").agg(_n())


EPISODES_SQL = "SELECT strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN o_orderpriority = '1-URGENT' THEN 'plan' ELSE 'task' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'succeeded' ELSE 'failed' END AS outcome, CASE o_orderstatus WHEN 'F' THEN 'low' ELSE 'medium' END AS significance, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY ALL"


def job_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty jobs (orders) as a board shows them: running ones, queued ones, then the rest, by number;
    those of the evaluation's own namespace are left out."""
    title = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Eval: "), F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    place = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    shown = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", title.alias("title"), place.alias("place")).where(~F.col("title").rlike("(?i)^eval:"))
    return ranked(shown, [F.asc("place"), F.asc("o_orderkey")], [], 20).select("o_orderkey", "o_orderstatus", "title", F.col("rank").cast("long").alias("rank"))


BOARD_SQL = "WITH b AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 'Eval: ' || o_orderpriority ELSE o_orderpriority END AS title, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS place FROM orders) SELECT o_orderkey, o_orderstatus, title, row_number() OVER (ORDER BY place, o_orderkey) AS rank FROM b WHERE NOT starts_with(lower(title), 'eval:') QUALIFY rank <= 20"


def agent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that are not blank, by conversation; those without one belong to their day (made from the number)."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant' AND trim(text) <> ''")
    name = F.when(F.col("conv_id") % 10 > 0, F.concat(F.lit("c"), F.col("conv_id").cast("string"))).otherwise(F.concat(F.lit("day:"), F.floor(F.col("conv_id") / 30).cast("string")))
    return turns.groupBy(name.alias("conversation")).agg(_n(), F.sum(F.length("text")).alias("characters"))


AGENT_SQL = "SELECT CASE WHEN conv_id % 10 > 0 THEN 'c' || conv_id ELSE 'day:' || conv_id // 30 END AS conversation, count(*) AS n, sum(length(text))::BIGINT AS characters FROM conversations WHERE role = 'assistant' AND trim(text) <> '' GROUP BY 1"

_ALL = [
    (wikilinks, WIKI_SQL), (feed_entries, FEED_SQL), (link_merge, LINKS_SQL), (related_decisions, RELATED_SQL), (log_spill, SPILL_SQL), (task_gate, GATE_SQL), (priority_places, PRIORITY_SQL), (factual_questions, FACTUAL_SQL),
    (discovered_patterns, DISCOVERED_SQL), (expired_twice, EXPIRED_SQL), (batch_review, REVIEW_SQL), (quarantine_cascade, CASCADE_SQL), (self_episodes, EPISODES_SQL), (job_board, BOARD_SQL), (agent_turns, AGENT_SQL),
]
QUERIES = {f.__name__: f for f, _ in _ALL}
SQL = {f.__name__: sql for f, sql in _ALL}
