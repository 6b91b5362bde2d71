"""Queries of sequences and budgets: the queue over a table of events, histories of states, expansion of searches, and
searches of vectors by an index."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.functions import text as T
from tessera.operators import expansion as X
from tessera.operators import ivf as V
from tessera.operators import retrieval as R
from tessera.operators import rules as U
from tessera.operators import search as S
from tessera.operators import states as Z
from tessera.plans.retrieval import table
from tessera.plans.rules import _REC, _batches, _case, _records, _searches
from tessera.session import spread
from tessera.streaming import queue as Q


def queue_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a queue of work for each user: views and signups ask for it, clicks claim, purchases and errors end it."""
    kind = F.when(F.col("event_type").isin("view", "signup"), "enqueue").when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "purchase", "succeed").otherwise("fail")
    events = table(spark, sf_dir, "events").select(F.lit("sync").alias("job_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("work"), F.expr("unix_micros(cast(ts AS timestamp))").alias("at"), F.col("event_id").alias("seq"), kind.alias("event"), F.when(kind == "enqueue", F.concat(F.lit("j"), F.lpad(F.col("event_id").cast("string"), 12, "0"))).alias("job_id"), F.lit(False).alias("retry"))
    found = Q.latest(Q.replay(events, stuck_ms=2**62))
    return found.select("work", "job_id", F.when(F.col("status") == "archived", "failed").otherwise(F.col("status")).alias("status"), F.col("coalesced").cast("long").alias("coalesced"), "replaces")


# q: the queued job; r: the running ones, oldest first; d: the job that has just ended. Each is (id, coalesced, replaces).
QUEUE_SQL = """WITH RECURSIVE e AS (SELECT 'u' || user_id AS w, 'j' || lpad(event_id::VARCHAR, 12, '0') AS id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n, CASE WHEN event_type IN ('view', 'signup') THEN 'enqueue' WHEN event_type = 'click' THEN 'claim' WHEN event_type = 'purchase' THEN 'succeeded' ELSE 'failed' END AS k FROM events WHERE user_id IS NOT NULL),
s AS (SELECT DISTINCT w, 0::BIGINT AS n, NULL::STRUCT(id VARCHAR, c BIGINT, rep VARCHAR) AS q, []::STRUCT(id VARCHAR, c BIGINT, rep VARCHAR)[] AS r, NULL::STRUCT(id VARCHAR, c BIGINT, rep VARCHAR) AS d, NULL::VARCHAR AS status FROM e
UNION ALL SELECT s.w, e.n,
CASE WHEN k = 'claim' THEN NULL WHEN k = 'enqueue' AND q IS NULL THEN {'id': e.id, 'c': 0::BIGINT, 'rep': r[1].id} WHEN k = 'enqueue' THEN {'id': q.id, 'c': q.c + 1, 'rep': q.rep} ELSE q END,
CASE WHEN k = 'claim' AND q IS NOT NULL THEN list_append(r, q) WHEN k IN ('succeeded', 'failed') THEN r[2:] ELSE r END,
CASE WHEN k IN ('succeeded', 'failed') AND len(r) > 0 THEN r[1] END, CASE WHEN k IN ('succeeded', 'failed') AND len(r) > 0 THEN k END
FROM s JOIN e ON e.w = s.w AND e.n = s.n + 1),
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY w ORDER BY n DESC) = 1),
j AS (SELECT w, d AS j, status FROM s WHERE d IS NOT NULL UNION ALL SELECT w, q, 'queued' FROM l WHERE q IS NOT NULL UNION ALL SELECT w, unnest(r), 'running' FROM l)
SELECT w AS work, j.id AS job_id, status, j.c AS coalesced, j.rep AS replaces FROM j"""


def state_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users last did, as states whose new summaries replace what they repeat."""
    summary = F.concat_ws(" ", "event_type", (F.col("event_id") % 13).cast("string"))
    updates = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.expr("unix_micros(cast(ts AS timestamp))").alias("at"), F.col("event_id").alias("seq"), summary.alias("summary"), F.lit("low").alias("confidence"))
    return Z.state_histories(updates).select("key", "summary", "n")


STATES_SQL = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, event_type || ' ' || (event_id % 13) AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events WHERE user_id IS NOT NULL),
h AS (SELECT DISTINCT key, 0::BIGINT AS n, []::VARCHAR[] AS l FROM e
UNION ALL SELECT h.key, e.n, CASE WHEN len(list_filter(l, lambda x: contains(x, s) OR contains(s, x))) = 0 THEN list_append(l, s)[-3:]
ELSE list_transform(l, lambda x, i: CASE WHEN i = list_position(list_transform(l, lambda y: contains(y, s) OR contains(s, y)), true) THEN s ELSE x END) END FROM h JOIN e ON e.key = h.key AND e.n = h.n + 1)
SELECT key, array_to_string(l, ' / ') AS summary, n FROM h QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1"""


def budgeted_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every fiftieth order, as a search from its parts, finds around them: parts and suppliers are records, lines
    their edges. No SQL: a budget that is spent in order; tests hold it against a walk."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    key = lambda letter, c: F.concat(F.lit(letter), F.lpad(F.col(c).cast("string"), 10, "0"))
    none, domains = F.array().cast("array<string>"), ["work", "money", "health", "cross_arena"]
    parts = table(spark, sf_dir, "part").select(key("p", "p_partkey").alias("id"), pick(["claim", "evidence", "pattern", "artifact"], F.col("p_partkey")).alias("type"), pick(domains, F.floor(F.col("p_partkey") / 4)).alias("domain"), F.array(pick(domains[:3], F.col("p_partkey"))).alias("areas"), F.when(F.col("p_partkey") % 11 == 0, "quarantined").alias("blocked"))
    suppliers = table(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("id"), pick(["evidence", "claim"], F.col("s_suppkey")).alias("type"), pick(domains, F.col("s_suppkey")).alias("domain"), none.alias("areas"), F.when(F.col("s_suppkey") % 7 == 3, "quarantined").alias("blocked"))
    lines = table(spark, sf_dir, "lineitem")
    relation = pick(["links", "supporting_evidence", "linked_claims", "counterexamples"], F.col("l_linenumber"))
    ahead = lines.select(key("p", "l_partkey").alias("source_id"), key("s", "l_suppkey").alias("target_id"), relation.alias("relation"))
    back = lines.select(key("s", "l_suppkey").alias("source_id"), key("p", "l_partkey").alias("target_id"), relation.alias("relation"))
    seeds = lines.where("l_orderkey % 50 = 0").groupBy(F.col("l_orderkey").cast("string").alias("search"), key("p", "l_partkey").alias("id")).agg(F.min("l_linenumber").alias("line"))
    seeds = seeds.select("search", "id", F.row_number().over(Window.partitionBy("search").orderBy("line", "id")).alias("rank"), F.lit(0.6).alias("score"))
    searches = seeds.select("search").distinct().select("search", F.array(F.lit("work")).alias("domains"), F.lit("work").alias("fallback"))
    coupled = spark.createDataFrame([("health", "money"), ("money", "health")], "a string, b string")
    found = X.expand(seeds, parts.unionByName(suppliers), ahead.unionByName(back), searches, coupled)
    return found.select("search", "id", "hop", "place", "source", "relation", "score", "kept", "reason")


def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every fiftieth one, by an index whose probes are measured to find 93 of 100 on a
    sample. No SQL: which lists are left out depends on fitted centroids; a test measures recall against cosine_topk."""
    raw = table(spark, sf_dir, "embeddings")
    size = raw.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = V.usable(raw, size)
    centres = V.fit_centroids(rows, isqrt(max(1, rows.count())))
    index = V.build(rows, centres)
    found = V.search(index, rows.where("vec_id % 50 = 0"), centres, 10, V.probes_for(index, rows, centres, 10, 0.93))
    return found.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


QUERIES = {"queue_replay": queue_replay, "state_folds": state_folds, "budgeted_expansion": budgeted_expansion, "ivf_topk": ivf_topk}
SQL = {"queue_replay": QUEUE_SQL, "state_folds": STATES_SQL}


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records with fields of their types, whole."""
    own = spread(_records(spark, sf_dir))
    word = lambda k: F.get(F.split("summary", " "), F.lit(k))
    return S.whole_records(own.select("no", "id", "type", "domain", "status", "significance", "age", "summary", F.col("confidence").alias("confidence_score"), F.array(F.upper(word(0))).alias("actors"), word(2).alias("source_type"), word(0).alias("claim_class"), word(1).alias("pattern_type"), F.when(F.col("no") % 5 == 0, word(1)).alias("file_name"), F.concat(F.lit("X/"), F.initcap(word(0)), F.lit(".md")).alias("source_path")))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches: the first and last words of every fiftieth record, in its domain; equal ones are one."""
    return _searches(spark, sf_dir).select("search", "asked", F.array_distinct(F.array(F.get("terms", F.lit(0)), F.element_at("terms", -1))).alias("terms"))


def search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lane of fields in full, 30 records a search."""
    return S.metadata_lane(_fields(spark, sf_dir), _asked(spark, sf_dir)).select("search", "id", "score", F.col("rank").cast("long").alias("rank"))


def search_former(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The former score and its reasons, 15 records a search, with the keyword lane of every search."""
    asked = _asked(spark, sf_dir)
    # Both lanes below depend on the haystack and the id's last digit alone.
    own = S.former_foremost(_fields(spark, sf_dir), asked, {"near": F.col("id").endswith("7")})
    hits = S.matched_terms(own, asked).where("size(matched) = 2").select("search", "id")
    near = hits.where("id LIKE '%7'").select("search", "id", F.lit(0.5).alias("score"))
    found = S.former_scores(own, asked, hits, near)
    return found.select("search", "id", "score", F.array_join("reasons", ",").alias("reasons"), F.col("rank").cast("long").alias("rank"))


_SEARCHED = f"""{_REC}, q0 AS (SELECT min(no) AS search, domain AS asked, summary FROM rec WHERE no % 50 = 0 GROUP BY domain, summary),
q1 AS (SELECT search, asked, list_filter(regexp_extract_all(lower(summary), '[A-Za-z0-9][A-Za-z0-9_-]+'), lambda x: length(x) > 2) AS t FROM q0), q AS (SELECT search, asked, list_distinct([t[1], t[-1]]) AS terms FROM q1),
f AS (SELECT *, string_split(summary, ' ') AS w FROM rec), g AS (SELECT *, w[1] AS claim_class, w[2] AS pattern_type, w[3] AS source_type, CASE WHEN no % 5 = 0 THEN w[2] END AS file_name, 'x/' || w[1] || '.md' AS source_path, concat_ws(chr(10), summary, id, w[3], 'x/' || w[1] || '.md', CASE WHEN no % 5 = 0 THEN w[2] END, w[2], w[1], status) AS hay FROM f),
m AS (SELECT g.*, search, asked, terms, list_filter(terms, lambda t: contains(lower(hay), t)) AS hit FROM g, q),
p AS (SELECT *, {_case("status", U.STATUS_POINTS, 0)} + CASE WHEN significance = 'high' THEN 0.7::DOUBLE ELSE 0 END + confidence * 0.3::DOUBLE AS standing, {_case("type", L.TYPE_BOOST, 0)} AS boost, domain = asked OR domain = 'cross_arena' AS own, len(hit) > 0 AS tm, type = 'evidence' AND list_contains(hit, claim_class) AS am, type = 'evidence' AND list_contains(hit, source_type) AS st, type = 'claim' AND list_contains(hit, claim_class) AS cc, type = 'claim' AND list_contains(hit, status) AS cs, type = 'pattern' AND list_contains(hit, pattern_type) AS pt,
 type = 'artifact' AND file_name IS NOT NULL AND list_contains(hit, file_name) AS fn, type = 'artifact' AND len(list_filter(hit, lambda t: contains(source_path, t))) > 0 AS sp, len(hit) = 2 AS fts FROM m)"""
_points = lambda **points: " + ".join(f"{v}::DOUBLE * {k}::INT" for k, v in points.items())
FIELDS_SQL = f"""WITH {_SEARCHED} SELECT search, id, score, row_number() OVER (PARTITION BY search ORDER BY score DESC, id DESC) AS rank FROM (SELECT search, id, round(boost + standing + CASE WHEN age >= 0 THEN greatest(0.0::DOUBLE, 1 - age / 365) ELSE 0 END + {_points(own=2.0, tm=1.2, am=1.0, st=0.7, cc=0.8, cs=0.6, pt=0.8, fn=0.8, sp=0.8)}, 6) AS score FROM p) QUALIFY rank <= 30"""
FORMER_SQL = f"""WITH {_SEARCHED}, s AS (SELECT *, round(boost + {_case("type", L.FORMER_BOOST, 0)} + standing + {_points(own=2.0, tm=2.5, am=1.5, st=1.0, cc=1.0, cs=0.8, pt=1.1, fn=1.5, sp=1.5, fts=2.0)} + CASE WHEN fts AND ends_with(id, '7') THEN 1.0::DOUBLE ELSE 0 END, 6) AS score,
 array_to_string(list_filter([CASE WHEN own THEN 'domain_match' END, CASE WHEN tm THEN 'text_match' END, CASE WHEN am THEN 'actor_match' END, CASE WHEN st THEN 'source_type' END, CASE WHEN cc THEN 'claim_class' END, CASE WHEN cs THEN 'claim_status' END, CASE WHEN pt THEN 'pattern_type' END, CASE WHEN fn THEN 'file_name' END, CASE WHEN sp THEN 'source_path' END, CASE WHEN fts THEN 'fts' END, CASE WHEN fts AND ends_with(id, '7') THEN 'vector' END], lambda x: x IS NOT NULL), ',') AS reasons FROM p)
SELECT search, id, score, reasons, row_number() OVER (PARTITION BY search ORDER BY boost DESC, score DESC, summary DESC, id DESC) AS rank FROM s WHERE reasons <> '' QUALIFY rank <= 15"""


def full_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lanes of every search fused: fields, words, vectors, the reply before, learned partners; quarantined records
    are hidden, and what a kept record links to goes. No SQL: neighbours go one after another; tests hold the parts."""
    own = _records(spark, sf_dir)
    searches = _searches(spark, sf_dir).select("search", "asked", "terms", F.when(F.col("search") % 2 == 0, F.reverse("terms")).alias("reply_terms"))
    whole = _fields(spark, sf_dir).join(own.select("id", T.query_terms(F.col("summary")).alias("terms")), "id")
    raw = table(spark, sf_dir, "embeddings")
    size = raw.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = V.usable(raw.join(own.select(F.col("no").alias("vec_id")), "vec_id", "left_semi"), size)
    near = V.nearest(rows, rows.join(searches.select(F.col("search").alias("vec_id")), "vec_id", "left_semi"), R.LANE_LIMIT).where("score > 0")
    vectors = near.select(F.col("query_id").alias("search"), F.concat(F.lit("r"), F.col("vec_id").cast("string")).alias("id"), F.lit("vector").alias("lane"), "rank")
    name = lambda c: F.concat(F.lit("r"), F.col(c).cast("string"))
    edges = R.npmi_edges(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", authored=own.select(F.col("no").alias("source"), F.expr("no + 1").alias("target"))).select(name("source").alias("source"), name("target").alias("target"), "npmi")
    links = own.select(F.col("id").alias("source"), F.col("artifact_ref").alias("target"))
    hidden = U.visibility(own, _batches(spark, sf_dir)).where("blocked IS NOT NULL").select("id")
    found = S.retrieve(searches, whole, vectors, edges, links, hidden)
    return found.select("search", "id", "rrf", "n_lanes", "lanes", F.col("rank").cast("long").alias("rank"))


def unauthored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned edges between parts of the last 2,000 orders; neighbours by key are linked by hand and learn nothing."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.expr("p_partkey + 1").alias("target"))
    item = lines.select("l_orderkey", (F.col("l_partkey") % 60).alias("l_partkey"))
    return R.npmi_edges(item, "l_orderkey", "l_partkey", floor=0.02, last=2000, authored=parts)


UNAUTHORED_SQL = """WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1 DESC LIMIT 2000), s AS (SELECT DISTINCT l_orderkey AS e, l_partkey % 60 AS i FROM lineitem JOIN o USING (l_orderkey)),
b AS (SELECT e FROM s GROUP BY 1 HAVING count(*) >= 2), t AS (SELECT s.* FROM s JOIN b USING (e)), n AS (SELECT count(*) AS n FROM b), c AS (SELECT i, count(*) AS c FROM t GROUP BY 1),
p AS (SELECT x.i AS a, y.i AS z, count(*) AS co FROM t x JOIN t y ON x.e = y.e AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 3),
w AS (SELECT a, z, co, round(ln((co / n.n) / ((ca.c / n.n) * (cz.c / n.n))) / -ln(co / n.n), 4) AS npmi FROM p JOIN c ca ON ca.i = a JOIN c cz ON cz.i = z, n WHERE co < n.n AND NOT (z = a + 1 AND EXISTS (SELECT 1 FROM part WHERE p_partkey = a))),
d AS (SELECT a AS source, z AS target, co AS co_count, npmi FROM w WHERE npmi >= 0.02 UNION ALL SELECT z, a, co, npmi FROM w WHERE npmi >= 0.02)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY source ORDER BY npmi DESC, target) <= 8"""

QUERIES |= {"search_fields": search_fields, "search_former": search_former, "full_retrieval": full_retrieval, "unauthored_edges": unauthored_edges}
SQL |= {"search_fields": FIELDS_SQL, "search_former": FORMER_SQL, "unauthored_edges": UNAUTHORED_SQL}
