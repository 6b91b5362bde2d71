"""Queries of validation, resolution, deviations and assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import audits as A
from tessera.operators.retrieval import FEW_TERMS, ranked
from tessera.plans.retrieval import HYBRID_SQL, hybrid_retrieval, table

_n = lambda: F.count(F.lit(1)).alias("n")
CREDENTIAL = r"(password=[0-9a-f]{8}|token = .[0-9a-f]{8})"


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of documents, by language: empty text, wrong length, unknown language, credentials."""
    text = F.coalesce("text", F.lit(""))
    issues = A.gate({"empty": text == "", "wrong_length": F.length(text) != F.col("n_chars"), "language": ~F.col("lang").isin("en", "de", "fr"), "credential": text.rlike(CREDENTIAL)})
    return table(spark, sf_dir, "documents").select("lang", F.explode(issues).alias("issue")).groupBy("lang", "issue").agg(_n())


VALIDATION_SQL = f"""WITH d AS (SELECT lang, coalesce(text, '') AS t, n_chars FROM documents), i AS (SELECT lang, unnest([CASE WHEN t = '' THEN 'empty' END, CASE WHEN length(t) <> n_chars THEN 'wrong_length' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' END, CASE WHEN regexp_matches(t, '{CREDENTIAL}') THEN 'credential' END]) AS issue FROM d)
SELECT lang, issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY 1, 2"""


def reference_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of lines to parts, by id, by unique name, or by neither: how many each stage resolves."""
    parts = table(spark, sf_dir, "part")
    label = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    names = parts.groupBy(label.alias("ref")).agg(F.min("p_partkey").alias("by_name"), _n()).where("n = 1").drop("n")
    refs = table(spark, sf_dir, "lineitem").join(parts.select(F.col("p_partkey").alias("l_partkey"), label.alias("label")), "l_partkey")
    refs = refs.select(F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey").cast("string")).when(F.col("l_linenumber") % 3 == 1, F.col("label")).otherwise(F.concat(F.lit("?"), F.col("label"))).alias("ref"))
    found = refs.join(parts.select(F.col("p_partkey").cast("string").alias("ref"), F.col("p_partkey").alias("by_id")), "ref", "left").join(names, "ref", "left")
    stage = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").otherwise("unresolved")
    return found.groupBy(stage.alias("stage")).agg(_n(), F.count_distinct(F.coalesce("by_id", "by_name")).alias("targets"))


REFERENCE_SQL = """WITH p AS (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS label FROM part), u AS (SELECT label AS ref, min(p_partkey) AS by_name FROM p GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN l_partkey::VARCHAR WHEN 1 THEN label ELSE '?' || label END AS ref FROM lineitem JOIN p ON l_partkey = p_partkey),
f AS (SELECT r.ref, p.p_partkey AS by_id, by_name FROM r LEFT JOIN p ON r.ref = p.p_partkey::VARCHAR LEFT JOIN u ON u.ref = r.ref)
SELECT CASE WHEN by_id IS NOT NULL THEN 'id' WHEN by_name IS NOT NULL THEN 'name' ELSE 'unresolved' END AS stage, count(*) AS n, count(DISTINCT coalesce(by_id, by_name)) AS targets FROM f GROUP BY 1"""


def resolve_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For names asked for (every fiftieth part's, a word changed) the best candidate of its brand, its score, and
    what to do: bind from 0.8, provisional from 0.6, else clarify."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("t"))
    # Parts of one brand with equal words are one candidate, and one search: no more pairs than words allow.
    sets = parts.select("p_partkey", "p_brand", F.array_sort(F.array_distinct("t")).alias("t"))
    candidates = sets.groupBy("p_brand", "t").agg(F.min("p_partkey").alias("p_partkey"))
    asked = sets.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("asked"), "p_brand", F.col("t").alias("q"))
    met = asked.select("p_brand", "q").distinct().join(candidates, "p_brand").select("p_brand", "q", "p_partkey", F.round(T.jaccard(F.array_union("q", F.array(F.lit("spare"))), F.col("t")), 4).alias("score"))
    met = ranked(met, [F.desc("score"), F.asc("p_partkey")], ["p_brand", "q"], 1).drop("rank")
    scored = asked.join(met, ["p_brand", "q"]).select("asked", "p_partkey", "score")
    best = ranked(scored, [F.desc("score"), F.asc("p_partkey")], ["asked"], 1).drop("rank")
    return best.withColumn("action", F.when(F.col("score") >= 0.8, "bind").when(F.col("score") >= 0.6, "provisional").otherwise("clarify"))


RESOLVE_SQL = """WITH p AS (SELECT p_partkey, p_brand, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part),
s AS (SELECT a.p_partkey AS asked, b.p_partkey, round(len(list_intersect(a.t, b.t)) / (len(list_distinct(list_concat(a.t, b.t))) + 1), 4) AS score FROM p a JOIN p b USING (p_brand) WHERE a.p_partkey % 50 = 0)
SELECT *, CASE WHEN score >= 0.8 THEN 'bind' WHEN score >= 0.6 THEN 'provisional' ELSE 'clarify' END AS action FROM s QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score DESC, p_partkey) = 1"""


def _deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of detectors over parts and suppliers: class, subject, weight, fingerprint."""
    use = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("uses"), F.max("l_shipdate").alias("last"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"), "p_type", "p_size").join(use, F.col("p_partkey") == F.col("l_partkey"), "left")
    thin = parts.where("p_size <= 2 AND uses >= 3").select(F.lit("thin").alias("class"), F.col("p_partkey").cast("string").alias("subject"), F.col("uses").alias("weight"))
    stale = parts.where(A.age_days(F.col("last"), "2001-08-02") >= 200).select(F.lit("stale").alias("class"), F.col("p_partkey").cast("string").alias("subject"), A.age_days(F.col("last"), "2001-08-02").alias("weight"))
    crossed = parts.groupBy("name").agg(F.count(F.lit(1)).alias("weight"), F.count_distinct("p_type").alias("kinds")).where("kinds > 1").select(F.lit("cross_kind").alias("class"), F.col("name").alias("subject"), "weight")
    found = thin.unionByName(stale).unionByName(crossed)
    return found.withColumn("fingerprint", F.substring(F.sha1(F.concat_ws(":", "class", "subject")), 1, 12))


_DEVIATIONS = """u AS (SELECT l_partkey, count(*) AS uses, date_diff('day', max(l_shipdate)::DATE, DATE '2001-08-02') AS age FROM lineitem GROUP BY 1), p AS (SELECT *, lower(p_name) AS name FROM part LEFT JOIN u ON p_partkey = l_partkey),
f AS (SELECT 'thin' AS class, p_partkey::VARCHAR AS subject, uses AS weight FROM p WHERE p_size <= 2 AND uses >= 3 UNION ALL SELECT 'stale', p_partkey::VARCHAR, age FROM p WHERE age >= 200 UNION ALL SELECT 'cross_kind', name, count(*) FROM p GROUP BY name HAVING count(DISTINCT p_type) > 1),
dev AS (SELECT *, substr(sha1(class || ':' || subject), 1, 12) AS fingerprint FROM f)"""


def deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two heaviest findings of each class, ties by fingerprint."""
    return ranked(_deviations(spark, sf_dir), [F.desc("weight"), F.asc("fingerprint")], ["class"], 2).drop("rank")


DEVIATIONS_SQL = f"WITH {_DEVIATIONS} SELECT * FROM dev QUALIFY row_number() OVER (PARTITION BY class ORDER BY weight DESC, fingerprint) <= 2"


def satiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops that were opened for parts and whose finding is gone by now, by class."""
    emitted = table(spark, sf_dir, "part").select(F.explode(F.array(F.lit("thin"), F.lit("stale"))).alias("class"), F.col("p_partkey").cast("string").alias("subject")).withColumn("fingerprint", F.substring(F.sha1(F.concat_ws(":", "class", "subject")), 1, 12))
    return A.fingerprints_gone(emitted, _deviations(spark, sf_dir)).groupBy("class").agg(_n())


SATIATION_SQL = f"WITH {_DEVIATIONS}, e AS (SELECT unnest(['thin', 'stale']) AS class, p_partkey::VARCHAR AS subject FROM part) SELECT class, count(*) AS n FROM e WHERE substr(sha1(class || ':' || subject), 1, 12) NOT IN (SELECT fingerprint FROM dev) GROUP BY 1"


def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each section of the report."""
    count = lambda name, df: df.agg(_n()).select(F.lit(name).alias("section"), "n")
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    parts = [
        count("open", orders.where("o_orderstatus = 'O'")),
        count("stuck_90", orders.where((F.col("o_orderstatus") == "P") & (A.age_days(F.col("o_orderdate"), "2001-08-02") > 90))),
        count("stuck_180", orders.where((F.col("o_orderstatus") == "P") & (A.age_days(F.col("o_orderdate"), "2001-08-02") > 180))),
        count("old_entities", table(spark, sf_dir, "customer").join(orders.where(A.age_days(F.col("o_orderdate"), "2001-08-02") <= 365).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")),
        count("failed", events.where("event_type = 'error'")),
        count("documents", table(spark, sf_dir, "documents")),
        count("vectors", table(spark, sf_dir, "embeddings")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


HEALTH_SQL = """WITH o AS (SELECT *, date_diff('day', o_orderdate::DATE, DATE '2001-08-02') AS age FROM orders)
SELECT 'open' AS section, count(*) AS n FROM o WHERE o_orderstatus = 'O' UNION ALL SELECT 'stuck_90', count(*) FROM o WHERE o_orderstatus = 'P' AND age > 90 UNION ALL SELECT 'stuck_180', count(*) FROM o WHERE o_orderstatus = 'P' AND age > 180
UNION ALL SELECT 'old_entities', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM o WHERE age <= 365) UNION ALL SELECT 'failed', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'vectors', count(*) FROM embeddings"""


def evidence_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer's first open order (a prediction) how many orders came strictly later, twenty at most."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    first = orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("p")).select("o_custkey", F.col("p.o_orderkey").alias("prediction"), F.col("p.o_orderdate").alias("made"))
    later = first.join(orders, "o_custkey", "left").groupBy("o_custkey", "prediction").agg(F.count_if(F.col("o_orderdate") > F.col("made")).alias("later"))
    return later.withColumn("pool", F.least("later", F.lit(20)).cast("long")).drop("later")


EVIDENCE_SQL = """WITH f AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS prediction, min(o_orderdate) AS made FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT f.o_custkey, prediction, least(count(*) FILTER (o_orderdate > made), 20) AS pool FROM f JOIN orders USING (o_custkey) GROUP BY 1, 2"""


def contradiction_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each search the first five toxic documents whose first 800 characters have one of its longer terms."""
    asked = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select("item_id", F.explode(F.array_distinct(F.filter(T.query_terms(F.col("text")), lambda t: F.length(t) > 3))).alias("term"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    heads = table(spark, sf_dir, "documents").join(toxic, "doc_id", "left_semi").select("doc_id", F.lower(F.substring("text", 1, 800)).alias("head"))
    few = [r["term"] for r in asked.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    if len(few) <= FEW_TERMS:  # each text is looked through once for all terms; searches join on them
        found = heads.select("doc_id", F.explode(F.filter(F.array(*map(F.lit, few)).cast("array<string>"), lambda t: F.contains(F.col("head"), t))).alias("term"))
        met = found.join(asked, "term").select("item_id", "doc_id").distinct()
    else:
        met = heads.join(asked, F.contains("head", "term")).select("item_id", "doc_id").distinct()
    return ranked(met, [F.asc("doc_id")], ["item_id"], 5).select("item_id", "doc_id")


CONTRADICTION_SQL = """WITH q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9][A-Za-z0-9_-]+'), lambda x: length(x) > 3)) AS term FROM benchmark WHERE item_id % 50 = 0),
h AS (SELECT doc_id, lower(substr(text, 1, 800)) AS head FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)), m AS (SELECT DISTINCT item_id, doc_id FROM h JOIN q ON contains(head, term))
SELECT item_id, doc_id FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY doc_id) <= 5"""


def context_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused results of each search, grouped by source in the order of rank."""
    found = hybrid_retrieval(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string"))
    return found.groupBy("item_id", "source").agg(F.array_join(listed, ",").alias("docs"), _n())


CONTEXT_SQL = f"WITH h AS ({HYBRID_SQL}) SELECT item_id, source, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS docs, count(*) AS n FROM h JOIN documents USING (doc_id) GROUP BY 1, 2"


def retrieval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each search: results, those in both lanes, the best score."""
    return hybrid_retrieval(spark, sf_dir).groupBy("item_id").agg(_n(), F.count_if(F.col("n_lanes") > 1).alias("both"), F.max("rrf").alias("best"))


LOG_SQL = f"WITH h AS ({HYBRID_SQL}) SELECT item_id, count(*) AS n, count(*) FILTER (n_lanes > 1) AS both, max(rrf) AS best FROM h GROUP BY 1"


def props_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads: those that parse, and their values by ten."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy(F.floor(k / 10).alias("bucket")).agg(_n(), F.count_if(F.try_parse_json("props").isNull()).alias("bad"), F.sum(k).alias("total"))


PROPS_SQL = "SELECT (props->>'$.k')::BIGINT // 10 AS bucket, count(*) AS n, count(*) FILTER (NOT json_valid(props)) AS bad, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1"


def head_tail_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events the first five and the last fifteen, without repeats."""
    up, down = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumns({"first": F.row_number().over(up), "last": F.row_number().over(down)})
    return rows.where("first <= 5 OR last <= 15").select("user_id", "event_id", F.when(F.col("first") <= 5, "head").otherwise("tail").alias("part"))


SAMPLE_SQL = "SELECT user_id, event_id, CASE WHEN f <= 5 THEN 'head' ELSE 'tail' END AS part FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS l FROM events) WHERE f <= 5 OR l <= 15"


def turn_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by a cascade of rules: empty, question, short, list, statement."""
    text = F.coalesce("text", F.lit(""))
    kind = F.when(F.trim(text) == "", "empty").when(F.contains(text, F.lit("?")), "question").when(F.length(text) < 40, "short").when(F.contains(text, F.lit("|")), "list").otherwise("statement")
    return table(spark, sf_dir, "conversations").groupBy("role", kind.alias("kind")).agg(_n())


TURNS_SQL = "WITH t AS (SELECT role, coalesce(text, '') AS t FROM conversations) SELECT role, CASE WHEN trim(t) = '' THEN 'empty' WHEN contains(t, '?') THEN 'question' WHEN length(t) < 40 THEN 'short' WHEN contains(t, '|') THEN 'list' ELSE 'statement' END AS kind, count(*) AS n FROM t GROUP BY 1, 2"


def shifted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last day of each status, a hundred days later."""
    day = lambda c: F.date_format(F.date_add(c, 100), "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(day(F.min("o_orderdate").cast("date")).alias("first"), day(F.max("o_orderdate").cast("date")).alias("last"))


SHIFT_SQL = "SELECT o_orderstatus, strftime(min(o_orderdate)::DATE + 100, '%Y-%m-%d') AS first, strftime(max(o_orderdate)::DATE + 100, '%Y-%m-%d') AS last FROM orders GROUP BY 1"

_ALL = [
    (validation_report, VALIDATION_SQL), (reference_cascade, REFERENCE_SQL), (resolve_candidates, RESOLVE_SQL), (deviations, DEVIATIONS_SQL), (satiation, SATIATION_SQL), (health_report, HEALTH_SQL), (evidence_pool, EVIDENCE_SQL),
    (contradiction_lookup, CONTRADICTION_SQL), (context_sections, CONTEXT_SQL), (retrieval_log, LOG_SQL), (props_parse, PROPS_SQL), (head_tail_sample, SAMPLE_SQL), (turn_classes, TURNS_SQL), (shifted_dates, SHIFT_SQL),
]
QUERIES = {f.__name__: f for f, _ in _ALL}
SQL = {f.__name__: sql for f, sql in _ALL}
