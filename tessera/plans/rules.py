"""Queries of record visibility, ranking, entities, queue rules and text rules. Records are made from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.functions import text as T
from tessera.operators import audits as A
from tessera.operators import entities as E
from tessera.operators import retrieval as R
from tessera.operators import rules as U
from tessera.operators import search as S
from tessera.operators.vectors import nearest
from tessera.plans.retrieval import table, texts
from tessera.session import pieces, spread

TYPES = ["evidence", "claim", "pattern", "artifact", "episode", "entity", "decision", "open_loop"]
DOMAINS = ["work", "health", "money", "relationships", "cross_arena"]
STATUSES = ["active", "confirmed", "disputed", "superseded", "draft", "quarantined", "stale"]
RELATIONS = ["linked_evidence", "linked_claims", "artifact_provenance", "links", "supporting_evidence", "contradicting_evidence", "linked_patterns", "supporting_records", "entities"]
_n = lambda name="n": F.count(F.lit(1)).alias(name)
_sql = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_case = lambda column, table_, default: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table_.items()) + f" ELSE {default} END"


def _pick(values: list[str], n) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("no"), F.concat(F.lit("r"), key.cast("string")).alias("id"), _pick(TYPES, key).alias("type"), _pick(DOMAINS, F.col("p_size")).alias("domain"), _pick(STATUSES, key).alias("status"),
        F.when(F.col("p_size") % 3 == 0, "high").otherwise("low").alias("significance"), (F.col("p_size") * 11).alias("age"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("summary"), (F.col("p_size") / 50).alias("confidence"),
        F.concat(F.lit("b"), (key % 40).cast("string")).alias("batch_id"), F.concat(F.lit("r"), (F.floor(key / 8) * 8 + 3).cast("string")).alias("artifact_ref"),
    )


_REC = f"""rec AS (SELECT p_partkey AS no, 'r' || p_partkey AS id, ({_sql(TYPES)})[p_partkey % 8 + 1] AS type, ({_sql(DOMAINS)})[p_size % 5 + 1] AS domain, ({_sql(STATUSES)})[p_partkey % 7 + 1] AS status,
  CASE WHEN p_size % 3 = 0 THEN 'high' ELSE 'low' END AS significance, p_size * 11 AS age, p_name || ' ' || lower(p_type) AS summary, p_size / 50 AS confidence, 'b' || p_partkey % 40 AS batch_id, 'r' || (p_partkey // 8 * 8 + 3) AS artifact_ref FROM part)"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose number leaves 3 by 11 are quarantined."""
    number = F.col("p_partkey") % 40
    return table(spark, sf_dir, "part").where(number % 11 == 3).select(F.concat(F.lit("b"), number.cast("string")).alias("batch_id")).distinct()


_BATCHES_SQL = "bat AS (SELECT DISTINCT 'b' || p_partkey % 40 AS batch_id FROM part WHERE p_partkey % 40 % 11 = 3)"
_QUA = f"""{_BATCHES_SQL},
qa AS (SELECT id FROM rec WHERE type = 'artifact' AND (status = 'quarantined' OR batch_id IN (FROM bat)))"""


def quarantine_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.quarantined_artifacts(_records(spark, sf_dir), _batches(spark, sf_dir))


QUARANTINE_SETS_SQL = f"WITH {_REC}, {_QUA} SELECT id FROM qa"


def blocked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each type and batch are visible, and how many are blocked, with the reason."""
    seen = U.visibility(_records(spark, sf_dir), _batches(spark, sf_dir))
    return seen.groupBy("type", F.coalesce("blocked", F.lit("visible")).alias("reason")).agg(_n(), F.min("no").alias("first"))


_DEPENDENT = ", ".join(f"'{x}'" for x in U.DEPENDENT)
BLOCKED_SQL = f"""WITH {_REC}, {_QUA}
SELECT type, CASE WHEN (type = 'artifact' AND id IN (FROM qa)) OR (type IN ({_DEPENDENT}) AND (batch_id IN (FROM bat) OR artifact_ref IN (FROM qa))) THEN 'quarantined' ELSE 'visible' END AS reason, count(*) AS n, min(no) AS first FROM rec GROUP BY 1, 2"""


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth record, as a search in its own domain; equal searches are one, named by the least. There are
    no more of them than domains times summaries."""
    asked = _records(spark, sf_dir).where("no % 50 = 0").groupBy(F.col("domain").alias("asked"), "summary").agg(F.min("no").alias("search"))
    return asked.select("search", "asked", T.query_terms(F.col("summary")).alias("terms"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as searches look at them; their haystack has type and domain too."""
    return S.whole_records(spread(_records(spark, sf_dir)).withColumn("confidence_score", F.col("confidence"))).withColumn("haystack", F.lower(F.concat_ws("\n", "id", "type", "summary", "status", "domain")))


_SCORED = f"""q AS (SELECT no AS search, domain AS asked, list_filter(regexp_extract_all(lower(summary), '[A-Za-z0-9][A-Za-z0-9_-]+'), lambda x: length(x) > 2) AS terms FROM (SELECT min(no) AS no, domain, summary FROM rec WHERE no % 50 = 0 GROUP BY domain, summary)),
sc AS (SELECT rec.*, search, round(CASE WHEN domain = asked OR domain = 'cross_arena' THEN 2.0::DOUBLE ELSE 0 END + {_case("type", L.TYPE_BOOST, 0)} + CASE WHEN age >= 0 THEN greatest(0.0::DOUBLE, 1 - age / 365) ELSE 0 END
  + CASE WHEN len(list_filter(terms, lambda t: contains(lower(concat_ws(chr(10), id, type, summary, status, domain)), t))) > 0 THEN 1.2::DOUBLE ELSE 0 END + {_case("status", U.STATUS_POINTS, 0)} + CASE WHEN significance = 'high' THEN 0.7::DOUBLE ELSE 0 END + confidence * 0.3::DOUBLE, 6) AS score FROM rec, q)"""


def metadata_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata lane of every search: 30 records by score, then id."""
    found = S.metadata_lane(_fields(spark, sf_dir), _searches(spark, sf_dir), points={"text_match": 1.2})
    return found.select("search", "id", "score", F.col("rank").cast("long").alias("rank"))


_LANE = "SELECT search, id, score, row_number() OVER (PARTITION BY search ORDER BY score DESC, id DESC) AS rank FROM sc QUALIFY rank <= 30"
METADATA_SQL = f"WITH {_REC}, {_SCORED} {_LANE}"


def legacy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The former order: by type, then score, then summary; 15 records a search."""
    order = [F.desc(U.type_boost(F.col("type"))), F.desc("score"), F.desc("summary"), F.desc("id")]
    found = S.metadata_lane(_fields(spark, sf_dir), _searches(spark, sf_dir), 15, {"text_match": 1.2}, order)
    return found.select("search", "id", "type", "score", F.col("rank").cast("long").alias("rank"))


LEGACY_SQL = f"WITH {_REC}, {_SCORED} SELECT search, id, type, score, row_number() OVER (PARTITION BY search ORDER BY {_case('type', L.TYPE_BOOST, 0)} DESC, score DESC, summary DESC, id DESC) AS rank FROM sc QUALIFY rank <= 15"


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata, keyword and vector lanes of every search; a record's vector is that of its number."""
    records = spread(_records(spark, sf_dir)).withColumn("terms", T.query_terms(F.col("summary")))
    words = R.bm25(records, "id", F.col("terms"), _searches(spark, sf_dir), "search", F.col("terms"), R.LANE_LIMIT).withColumn("score", F.round("score", 6))
    words = R.ranked(words, [F.desc("score"), F.desc("id")], ["search"], R.LANE_LIMIT)
    numbers = _records(spark, sf_dir).select(F.col("no").alias("vec_id"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(numbers, "vec_id", "left_semi")
    asked = vectors.join(_searches(spark, sf_dir).select(F.col("search").alias("vec_id")), "vec_id", "left_semi")
    near = R.ranked(nearest(vectors, asked, R.LANE_LIMIT).where("score > 0"), [F.desc("score"), F.asc("vec_id")], ["query_id"], R.LANE_LIMIT)
    near = near.select(F.col("query_id").alias("search"), F.concat(F.lit("r"), F.col("vec_id").cast("string")).alias("id"), "rank")
    lane = lambda df, name: df.select("search", "id", F.lit(name).alias("lane"), "rank")
    return lane(metadata_ranks(spark, sf_dir), "sql").unionByName(lane(words, "fts")).unionByName(lane(near, "vector"))


def record_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes fused by reciprocal rank: 20 records a search by score, number of lanes, the keyword lane, type, summary."""
    fused = _lanes(spark, sf_dir).groupBy("search", "id").agg(F.round(F.sum(1.0 / (R.RRF_K + F.col("rank"))), 6).alias("rrf"), F.count_distinct("lane").alias("n_lanes"), F.max((F.col("lane") == "fts").cast("int")).alias("fts"), F.array_join(F.sort_array(F.collect_set("lane")), "+").alias("lanes"))
    met = fused.join(_records(spark, sf_dir).select("id", "type", "summary"), "id")
    order = [F.desc("rrf"), F.desc("n_lanes"), F.desc("fts"), F.desc(U.type_boost(F.col("type"))), F.desc("summary"), F.asc("id")]
    return R.ranked(met, order, ["search"], R.FUSED_LIMIT).select("search", "id", "rrf", F.col("n_lanes").cast("long").alias("n_lanes"), "lanes", F.col("rank").cast("long").alias("rank"))


RETRIEVAL_SQL = f"""WITH {_REC}, {_SCORED}, meta AS ({_LANE}),
t AS (SELECT id, list_filter(regexp_extract_all(lower(summary), '[A-Za-z0-9][A-Za-z0-9_-]+'), lambda x: length(x) > 2) AS terms FROM rec),
qt AS (SELECT search, term, count(*) AS qtf FROM (SELECT search, unnest(terms) AS term FROM q) GROUP BY 1, 2), st AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avg_dl FROM t),
p AS (SELECT id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM t) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2), n AS (SELECT term, count(*) AS n FROM p GROUP BY 1),
b AS (SELECT search, id, round(sum(qtf * CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score FROM p JOIN qt USING (term) JOIN n USING (term), st GROUP BY 1, 2),
v AS (SELECT a.vec_id AS search, 'r' || e.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN part pa ON pa.p_partkey = a.vec_id, embeddings e JOIN part pe ON pe.p_partkey = e.vec_id WHERE a.vec_id IN (SELECT search FROM q) AND a.vec_id <> e.vec_id),
lanes AS (SELECT search, id, 'sql' AS lane, rank FROM meta UNION ALL (SELECT search, id, 'fts', row_number() OVER (PARTITION BY search ORDER BY score DESC, id DESC) AS r FROM b QUALIFY r <= 30) UNION ALL (SELECT search, id, 'vector', row_number() OVER (PARTITION BY search ORDER BY score DESC, substr(id, 2)::BIGINT) AS r FROM v WHERE score > 0 QUALIFY r <= 30)),
f AS (SELECT search, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf, count(DISTINCT lane) AS n_lanes, max((lane = 'fts')::INT) AS fts, string_agg(DISTINCT lane, '+' ORDER BY lane) AS lanes FROM lanes GROUP BY 1, 2)
SELECT search, f.id, rrf, n_lanes, lanes, row_number() OVER (PARTITION BY search ORDER BY rrf DESC, n_lanes DESC, fts DESC, {_case("type", L.TYPE_BOOST, 0)} DESC, summary DESC, f.id) AS rank FROM f JOIN rec USING (id) QUALIFY rank <= 20"""


def neighbour_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused records without those that a kept one before them links to (each record links to its artifact)."""
    links = _records(spark, sf_dir).where("id <> artifact_ref").select(F.col("id").alias("source"), F.col("artifact_ref").alias("target"))
    found = record_retrieval(spark, sf_dir).select("search", "id", "rank", "n_lanes")
    return U.demote_neighbours(found, links, ["search"])


# An artifact links to nothing, so whether a record before it links to it decides alone.
DEMOTION_SQL = f"""WITH fused AS ({RETRIEVAL_SQL}), w AS (SELECT search, id, rank, n_lanes, substr(id, 2)::BIGINT AS no FROM fused)
SELECT search, id, rank, n_lanes FROM w x WHERE n_lanes >= 3 OR no % 8 <> 3 OR NOT EXISTS (SELECT 1 FROM w y WHERE y.search = x.search AND y.rank < x.rank AND y.id <> x.id AND y.no // 8 * 8 + 3 = x.no)"""


def domain_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of records to their artifacts by domains and the reason that lets an expansion through. Health and money
    are coupled; a pattern that refers to the artifact and stands in the target's domain is a bridge."""
    records = _records(spark, sf_dir)
    artifacts = records.where("type = 'artifact'").select(F.col("id").alias("artifact_ref"), F.col("domain").alias("target"))
    bridges = records.where("type = 'pattern'").select("artifact_ref", F.col("domain").alias("bridge")).distinct()
    met = records.where("type <> 'artifact'").join(artifacts, "artifact_ref").join(bridges, "artifact_ref", "left")
    pair = F.array_sort(F.array("domain", "target"))
    reason = U.domain_gate(F.col("domain"), F.col("target"), F.lit(1), F.coalesce(F.col("bridge") == F.col("target"), F.lit(False)), pair == F.array(F.lit("health"), F.lit("money")))
    return met.groupBy(F.col("domain").alias("source"), "target", F.coalesce(reason, F.lit("refused")).alias("reason")).agg(_n())


GATES_SQL = f"""WITH {_REC}, a AS (SELECT id AS artifact_ref, domain AS target FROM rec WHERE type = 'artifact'), b AS (SELECT DISTINCT artifact_ref, domain AS bridge FROM rec WHERE type = 'pattern')
SELECT domain AS source, target, CASE WHEN domain = target OR domain = 'cross_arena' OR target = 'cross_arena' THEN 'same_domain' WHEN bridge = target THEN 'bridging_pattern' WHEN list_sort([domain, target]) = ['health', 'money'] THEN 'coupled_domains' ELSE 'refused' END AS reason, count(*) AS n
FROM rec JOIN a USING (artifact_ref) LEFT JOIN b USING (artifact_ref) WHERE type <> 'artifact' GROUP BY 1, 2, 3"""


def relation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three edges of each record (its order lines) by relation, as its type ranks them, then target."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("no"), F.col("l_suppkey").alias("target"), _pick(RELATIONS, F.col("l_orderkey") + F.col("l_linenumber")).alias("relation"))
    edges = edges.repartition(pieces(table(spark, sf_dir, "lineitem")), "no").distinct()
    met = edges.join(_records(spark, sf_dir).select("no", "type"), "no").withColumn("place", U.relation_place(F.col("type"), F.col("relation")).cast("long"))
    return R.ranked(met, [F.asc("place"), F.asc("target"), F.asc("relation")], ["no"], 3).select("no", "relation", "target", "place", F.col("rank").cast("long").alias("rank"))


_PLACES = " ".join(f"WHEN '{k} {r}' THEN {i}" for k, rs in U.RELATION_ORDER.items() for i, r in enumerate(rs)) + " " + " ".join(f"WHEN '{k} links' THEN 0" for k in ("entity", "decision", "open_loop"))
ORDER_SQL = f"""WITH {_REC}, e AS (SELECT DISTINCT l_partkey AS no, l_suppkey AS target, ({_sql(RELATIONS)})[(l_orderkey + l_linenumber) % {len(RELATIONS)} + 1] AS relation FROM lineitem),
m AS (SELECT no, relation, target, (CASE type || ' ' || relation {_PLACES} ELSE 99 END)::BIGINT AS place FROM e JOIN rec USING (no)) SELECT *, row_number() OVER (PARTITION BY no ORDER BY place, target, relation) AS rank FROM m QUALIFY rank <= 3"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities: a name with a number that some share, and an alias."""
    number = (F.col("p_partkey") * 7 % 701).cast("string")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.concat_ws(" ", "p_name", F.concat(F.lit("no"), number)), F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("Alias"), (F.col("p_partkey") % 450).cast("string")))).alias("names"))


_ENT = """ent AS (SELECT p_partkey AS id, unnest([{'p': 0, 'name': lower(p_name || ' no' || (p_partkey * 7 % 701))}, {'p': 1, 'name': CASE WHEN p_partkey % 9 = 0 THEN 'alias' || p_partkey % 450 END}]) AS x FROM part),
cl AS (SELECT id, x.p AS p, x.name AS key, 0 AS tok FROM ent WHERE x.name IS NOT NULL UNION ALL SELECT id, x.p, unnest(string_split(x.name, ' ')), 1 FROM ent WHERE x.name IS NOT NULL),
fi AS (SELECT key, id AS fid, tok AS ftok FROM cl QUALIFY row_number() OVER (PARTITION BY key ORDER BY id, p, tok) = 1),
ix AS (SELECT key, any_value(fid) AS id, CASE WHEN bool_or(id <> fid AND (tok = 0 OR ftok = 1)) THEN 'ambiguous' WHEN any_value(ftok) = 1 THEN 'token' ELSE 'full' END AS kind FROM cl JOIN fi USING (key) GROUP BY key)"""


def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.name_index(_entities(spark, sf_dir))


INDEX_SQL = f"WITH {_ENT} SELECT key, id, kind FROM ix"


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth part proposes its name, as it is or changed."""
    key, name = F.col("p_partkey"), F.concat_ws(" ", "p_name", F.concat(F.lit("no"), (F.col("p_partkey") * 7 % 701).cast("string")))
    changed = _pick_column([name, F.concat(name, F.lit(" trip (summer)")), F.concat(name, F.lit(" on 2001-02-03")), F.concat(F.lit("no"), (key * 7 % 701).cast("string")), F.concat(name, F.lit(" spare")), F.col("p_name")], F.floor(key / 50))
    return table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(key.alias("proposal"), changed.alias("name"))


def _pick_column(columns: list[F.Column], n) -> F.Column:
    return F.element_at(F.array(*columns), (n % len(columns) + 1).cast("int"))


def entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity each proposed name folds into, and by which rule."""
    return E.match_names(_proposals(spark, sf_dir), E.name_index(_entities(spark, sf_dir)))


_TAIL = "|".join(E.QUALIFIERS)
MATCH_SQL = rf"""WITH {_ENT},
pr AS (SELECT p_partkey AS proposal, p_name || ' no' || (p_partkey * 7 % 701) AS nm, p_name, 'no' || (p_partkey * 7 % 701) AS num FROM part WHERE p_partkey % 50 = 0),
pn AS (SELECT proposal, ([nm, nm || ' trip (summer)', nm || ' on 2001-02-03', num, nm || ' spare', p_name])[proposal // 50 % 6 + 1] AS name FROM pr),
lo AS (SELECT *, lower(trim(name)) AS fullname, trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '\([^)]*\)', ' ', 'g'), '\b(on\s+)?\d{{4}}-\d{{2}}-\d{{2}}\b|\b(spring|summer|fall|autumn|winter)\s+\d{{4}}\b', ' ', 'g'), '\s+', ' ', 'g')), '( ({_TAIL}))+$', '')) AS base FROM pn),
wo AS (SELECT proposal, unnest(list_distinct(string_split(fullname, ' '))) AS key, len(list_distinct(string_split(fullname, ' '))) AS n FROM lo),
hi AS (SELECT proposal, n, id, count(*) AS shared FROM wo JOIN ix USING (key) WHERE kind <> 'ambiguous' GROUP BY 1, 2, 3 HAVING n = 1 OR count(*) >= 2),
be AS (SELECT * FROM hi QUALIFY row_number() OVER (PARTITION BY proposal ORDER BY shared DESC, id) = 1)
SELECT lo.proposal, name, coalesce(f.id, b.id, be.id) AS id, CASE WHEN f.id IS NOT NULL THEN 'full' WHEN b.id IS NOT NULL THEN 'base' WHEN be.n = 1 THEN 'token' WHEN be.n > 1 THEN 'words' END AS stage
FROM lo LEFT JOIN ix f ON f.key = fullname AND f.kind = 'full' LEFT JOIN ix b ON b.key = base AND b.kind = 'full' LEFT JOIN be ON be.proposal = lo.proposal"""


def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one name merge into the one with the least key; how many brands each then has for names."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand").alias("names"), F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")).alias("same"))
    first = parts.groupBy("same").agg(F.min("id").alias("survivor"))
    merges = parts.join(first, "same").where("id <> survivor").select(F.col("id").alias("absorbed"), "survivor")
    return E.merge_into(parts.select("id", "names"), merges).select("id", "status", F.array_join("names", ",").alias("names"))


MERGED_SQL = """WITH p AS (SELECT *, min(p_partkey) OVER (PARTITION BY p_name, p_type, p_size) AS survivor FROM part), x AS (SELECT survivor, p_brand, min(p_partkey) AS first FROM p GROUP BY 1, 2), s AS (SELECT survivor, string_agg(p_brand, ',' ORDER BY first) AS names FROM x GROUP BY 1)
SELECT p_partkey AS id, CASE WHEN p_partkey = p.survivor THEN 'active' ELSE 'archived' END AS status, CASE WHEN p_partkey = p.survivor THEN names ELSE p_brand END AS names FROM p JOIN s ON s.survivor = p.survivor"""


def stated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between entities that statements (neighbouring parts) name and that are not known yet (every third is)."""
    named = _entities(spark, sf_dir).select("id", F.get("names", F.lit(0)).alias("name"))
    stated = named.join(named.select((F.col("id") - 1).alias("id"), F.col("name").alias("target")), "id").select("id", F.upper("name").alias("source"), F.lit("near").alias("relation"), "target")
    known = stated.where("id % 3 = 0").select(F.col("id").alias("source_id"), "relation", (F.col("id") + 1).alias("target_id"))
    return E.new_edges(stated.drop("id"), E.name_index(_entities(spark, sf_dir)), known)


STATED_SQL = f"""WITH {_ENT}, nm AS (SELECT id, x.name AS name FROM ent WHERE x.p = 0), st AS (SELECT a.id, a.name AS s, b.name AS t FROM nm a JOIN nm b ON b.id = a.id + 1)
SELECT DISTINCT a.id AS source_id, 'near' AS relation, b.id AS target_id FROM st JOIN ix a ON a.key = s AND a.kind <> 'ambiguous' JOIN ix b ON b.key = t AND b.kind <> 'ambiguous' WHERE a.id <> b.id AND NOT (a.id % 3 = 0 AND b.id = a.id + 1 AND a.id IN (SELECT id FROM st))"""


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the first two words of each benchmark item stand in each text."""
    names = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.regexp_extract("text", r"^\S+\s+\S+", 0).alias("name"))
    found = E.mentions(texts(spark, sf_dir).select("doc_id", "text"), names, "doc_id")
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n"))


MENTIONS_SQL = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents), d AS (SELECT doc_id, unnest(w) AS a, unnest(list_concat(w[2:], [NULL])) AS b FROM w),
n AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(regexp_extract(text, '^\S+\s+\S+')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark)
SELECT id, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM n JOIN d ON d.a = n.w[1] AND (len(n.w) = 1 OR d.b = n.w[2]) WHERE len(n.w) BETWEEN 1 AND 2 GROUP BY 1"""


def failure_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by fingerprint; their texts carry job ids and numbers."""
    events = table(spark, sf_dir, "events").where("event_type = 'error'")
    error = F.concat(F.lit("Timeout "), _pick(["reading", "writing", "in step"], F.col("user_id")), F.lit(" of job.20240101t"), F.col("event_id").cast("string"), F.lit(".af0"), (F.col("event_id") % 10).cast("string"), F.lit(": line "), F.col("user_id").cast("string"))
    return events.groupBy(U.failure_fingerprint(F.concat(F.lit("index."), _pick(["scan", "rebuild"], F.col("event_id"))), error).alias("fingerprint")).agg(_n(), F.min("event_id").alias("first"))


FINGERPRINT_SQL = r"""WITH e AS (SELECT event_id, 'index.' || (['scan', 'rebuild'])[event_id % 2 + 1] AS job, 'Timeout ' || (['reading', 'writing', 'in step'])[user_id % 3 + 1] || ' of job.20240101t' || event_id || '.af0' || event_id % 10 || ': line ' || user_id AS error FROM events WHERE event_type = 'error'),
t AS (SELECT event_id, replace(job, '.', '-') || '-' || trim(regexp_replace(regexp_replace(regexp_replace(lower(error), 'job\.[0-9t]+\.[0-9a-f]+', '', 'g'), '[0-9]+', '', 'g'), '[^a-z]+', '-', 'g'), '-') AS f FROM e) SELECT trim(f[1:80], '-') AS fingerprint, count(*) AS n, min(event_id) AS first FROM t GROUP BY 1"""


def _keyed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = _pick(["ingest.scan_path", "ingest.parse_file", "index.rebuild_all", "task.reminder"], F.col("event_id"))
    of = lambda n, prefix: F.concat(F.lit(prefix), (F.col("user_id") % n).cast("string"))
    payload = F.map_from_arrays(F.array(of(3, "k"), F.lit("last")), F.array(F.col("event_id").cast("string"), F.col("event_type")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), (F.col("user_id") % 5).alias("priority"), kind.alias("job_type"), U.coalesce_key(kind, F.when(F.col("user_id") % 7 > 0, of(7, "/p")), of(11, "rec"), F.lit("")).alias("key"), payload.alias("payload"))


_KEYED = """j AS (SELECT event_id AS id, ts AS created_at, user_id % 5 AS priority, event_type, user_id, (['ingest.scan_path', 'ingest.parse_file', 'index.rebuild_all', 'task.reminder'])[event_id % 4 + 1] AS job_type FROM events),
k AS (SELECT *, CASE job_type WHEN 'ingest.scan_path' THEN CASE WHEN user_id % 7 > 0 THEN 'ingest.scan_path|path=/p' || user_id % 7 ELSE 'ingest.scan_path|global' END WHEN 'ingest.parse_file' THEN 'ingest.parse_file|record=rec' || user_id % 11 WHEN 'index.rebuild_all' THEN 'index.rebuild_all|global' END AS key FROM j)"""


def coalesce_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _keyed_jobs(spark, sf_dir)
    return jobs.groupBy("job_type", "key").agg(_n())


KEYS_SQL = f"WITH {_KEYED} SELECT job_type, key, count(*) AS n FROM k GROUP BY 1, 2"


def payload_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job a key, with the fields of all payloads, later ones over earlier ones."""
    merged = U.merged_payload(_keyed_jobs(spark, sf_dir).where("key IS NOT NULL"), "key")
    return merged.select("key", "n", "priority", F.array_join(F.transform(F.map_entries("payload"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("payload"))


PAYLOAD_SQL = f"""WITH {_KEYED}, f AS (SELECT key, created_at, id, unnest([{{'f': 'k' || user_id % 3, 'v': id::VARCHAR}}, {{'f': 'last', 'v': event_type}}]) AS x FROM k WHERE key IS NOT NULL),
l AS (SELECT key, x.f AS f, x.v AS v FROM f QUALIFY row_number() OVER (PARTITION BY key, x.f ORDER BY created_at DESC, id DESC) = 1), m AS (SELECT key, string_agg(f || '=' || v, ',' ORDER BY f) AS payload FROM l GROUP BY 1)
SELECT key, count(*) AS n, min(priority) AS priority, any_value(payload) AS payload FROM k JOIN m USING (key) GROUP BY 1"""


def archived_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: what becomes of their states when failures of over 14 days are archived."""
    age = A.age_days(F.col("o_orderdate"), "2001-08-02")
    jobs = table(spark, sf_dir, "orders").select(_pick(["failed", "canceled", "queued", "running"], F.col("o_orderkey")).alias("was"), age.alias("age"))
    return jobs.groupBy("was", U.archived(F.col("was"), F.col("age")).alias("status")).agg(_n())


ARCHIVED_SQL = "WITH j AS (SELECT (['failed', 'canceled', 'queued', 'running'])[o_orderkey % 4 + 1] AS was, date_diff('day', o_orderdate::DATE, DATE '2001-08-02') AS age FROM orders) SELECT was, CASE WHEN was IN ('failed', 'canceled') AND age > 14 THEN 'archived' ELSE was END AS status, count(*) AS n FROM j GROUP BY 1, 2"


def code_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether over four fifths of their lines stand in code blocks; some lines are made fences."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.when(F.length(x) % 9 == 4, F.concat(F.lit(" ```"), x)).otherwise(x))
    held = texts(spark, sf_dir).select("doc_id", F.explode(F.array(lines)).alias("lines"))
    counted = held.select("doc_id", F.size("lines").alias("n"), U.fence_lines(F.col("lines")).alias("code"))
    return counted.select("doc_id", F.col("code").cast("long").alias("code"), (F.col("code") / F.col("n") > 0.8).alias("mostly_code"))


CODE_SQL = """WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
f AS (SELECT doc_id, i, (length(line) % 9 = 4 OR starts_with(trim(line), '```'))::INT AS fence FROM l), s AS (SELECT doc_id, sum(fence) OVER (PARTITION BY doc_id ORDER BY i) % 2 AS inside FROM f)
SELECT doc_id, sum(inside)::BIGINT AS code, sum(inside) / count(*) > 0.8 AS mostly_code FROM s GROUP BY 1"""


def section_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sections: short ones join the next that has 20 words; sections and words of each group."""
    lines = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line")).select("doc_id", "i", F.size(F.filter(F.split("line", " "), lambda w: w != "")).alias("words"))
    return U.merged_sections(lines, ["doc_id"], "i", "words", 20).groupBy("doc_id", "group").agg(F.count(F.lit(1)).alias("sections"), F.sum("words").alias("words"))


SECTION_SQL = """WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), w AS (SELECT doc_id, i, len(list_filter(string_split(line, ' '), lambda x: x <> '')) AS words FROM l),
g AS (SELECT doc_id, words, coalesce(sum((words >= 20)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "group" FROM w) SELECT doc_id, "group", count(*) AS sections, sum(words)::BIGINT AS words FROM g GROUP BY 1, 2"""


def text_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary line of each text, its sentences, and a short digest."""
    text = F.coalesce("text", F.lit(""))
    return texts(spark, sf_dir).select("doc_id", F.coalesce(U.first_short_line(text), F.lit("")).alias("summary"), U.sentence_count(text).alias("sentences"), F.substring(F.md5(text), 1, 12).alias("digest"))


OUTLINE_SQL = r"""WITH l AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, coalesce(list_filter(l, lambda x: length(x) <= 180)[1], l[1][1:180], '') AS summary, greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+(\s|$)'), lambda x: trim(x, ' ') <> '')))::BIGINT AS sentences, md5(text)[1:12] AS digest FROM l"""


def searches_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user turn searches for: itself, with the turns before it, and the reply before it."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 0, F.substring_index("text", " ", 3)).otherwise(F.col("text")))
    found = U.blended(turns, "conv_id", "turn", "role", "text")
    return found.select("conv_id", "turn", *(F.md5(F.coalesce(c, F.lit(""))).alias(c) for c in ("asked", "for_domain", "reply")))


TURNS_SQL = r"""WITH t AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN array_to_string(string_split(text, ' ')[1:3], ' ') ELSE text END AS text FROM conversations), n AS (SELECT *, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM t),
b AS (SELECT *, list({'role': role, 'text': text, 'n': n}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b FROM n),
u AS (SELECT *, CASE WHEN len(b) > 0 THEN concat_ws(' ', text, array_to_string(list_transform(b, lambda x: x.text), ' ')) ELSE text END AS joined, list_filter(b, lambda x: x.role = 'assistant' AND x.n >= 6) AS r FROM b WHERE role = 'user')
SELECT conv_id, turn, md5(coalesce(CASE WHEN n < 5 THEN joined ELSE text END, '')) AS asked, md5(coalesce(joined, '')) AS for_domain, md5(coalesce(CASE WHEN len(r) > 0 THEN trim(r[-1].text, ' ')[1:600] END, '')) AS reply FROM u"""


def quote_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes (the end of a turn's first eight words) by speaker that a turn of another conversation says first."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    quotes = turns.select(F.concat_ws("-", "conv_id", "turn").alias("quote"), "role", F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 4, 5), " ").alias("q"))
    first = U.first_holder(quotes, turns, "quote", "q", ["conv_id", "turn"], "text")
    met = quotes.join(first, "quote").groupBy("role").agg(F.count(F.lit(1)).alias("quotes"), F.count_distinct("conv_id").alias("conversations"), F.count_if(F.col("quote") != F.concat_ws("-", "conv_id", "turn")).alias("said_before"))
    return met.withColumn("holds", (F.col("quotes") >= 3) & (F.col("conversations") >= 2))


QUOTE_SQL = r"""WITH t AS (SELECT conv_id, turn, role, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) || ' ' AS t, concat_ws('-', conv_id, turn) AS quote, list_filter(regexp_split_to_array(trim(lower(coalesce(text, ''))), '\s+'), lambda x: x <> '')[4:8] AS w FROM conversations),
q AS (SELECT quote, role, ' ' || array_to_string(w, ' ') || ' ' AS q FROM t WHERE len(w) >= 1), m AS (SELECT q.quote, q.role, t.conv_id, t.quote AS holder FROM q JOIN t ON contains(t.t, q.q) QUALIFY row_number() OVER (PARTITION BY q.quote ORDER BY t.conv_id, t.turn) = 1)
SELECT role, count(*) AS quotes, count(DISTINCT conv_id) AS conversations, count(*) FILTER (quote <> holder) AS said_before, count(*) >= 3 AND count(DISTINCT conv_id) >= 2 AS holds FROM m GROUP BY 1"""


def dimension_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score and number of each dimension (null scores do not count), with the mean of the means, and whether
    the dimension is so low that it is reported."""
    scored = table(spark, sf_dir, "events").select("event_type", F.nullif(F.floor("value") % 6, F.lit(0)).alias("score"))
    means = scored.groupBy("event_type").agg(F.round(F.avg("score"), 2).alias("mean"), F.count("score").alias("n"))
    return means.crossJoin(F.broadcast(means.agg(F.round(F.avg("mean"), 2).alias("overall")))).withColumn("reported", (F.col("n") >= 3) & (F.col("mean") < 3.0))


MEANS_SQL = "WITH m AS (SELECT event_type, round(avg(nullif(floor(value)::BIGINT % 6, 0)), 2) AS mean, count(nullif(floor(value)::BIGINT % 6, 0)) AS n FROM events GROUP BY 1) SELECT *, (SELECT round(avg(mean), 2) FROM m) AS overall, n >= 3 AND mean < 3.0 AS reported FROM m"


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each batch by state, and whether the batch is quarantined."""
    held = _batches(spark, sf_dir).withColumn("quarantined", F.lit(True))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("active", "disputed", "superseded")]
    return _records(spark, sf_dir).groupBy("batch_id").agg(_n(), *counts).join(held, "batch_id", "left").withColumn("quarantined", F.coalesce("quarantined", F.lit(False)))


BATCH_SQL = f"WITH {_REC}, {_QUA} SELECT batch_id, count(*) AS n, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'disputed') AS disputed, count(*) FILTER (status = 'superseded') AS superseded, batch_id IN (FROM bat) AS quarantined FROM rec GROUP BY 1"


def superseded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's orders of one priority the last stays, the others are superseded; what they come to."""
    last = Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    orders = table(spark, sf_dir, "orders").withColumn("status", F.when(F.row_number().over(last) == 1, "current").otherwise("superseded"))
    return orders.groupBy("o_orderpriority", "status").agg(_n(), F.round(F.sum("o_totalprice"), 2).alias("total"))


SUPERSEDED_SQL = "SELECT o_orderpriority, status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'current' ELSE 'superseded' END AS status FROM orders) GROUP BY 1, 2"


def due_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose work is due: five events or more since their last purchase, or a day without one at the end."""
    events = table(spark, sf_dir, "events")
    last = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("done"))
    met = events.join(last, "user_id", "left").groupBy("user_id").agg(F.count_if(F.col("done").isNull() | (F.struct("ts", "event_id") > F.col("done"))).alias("since"), F.max("ts").alias("now"), F.max("done.ts").alias("done"))
    idle = F.coalesce(F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("done").cast("timestamp")) >= 86_400_000_000, F.lit(True))
    return met.select("user_id", "since", (F.col("since") >= 5).alias("by_count"), idle.alias("by_time")).where("by_count OR by_time")


TRIGGERS_SQL = """WITH d AS (SELECT user_id, max({'ts': ts, 'id': event_id}) AS done FROM events WHERE event_type = 'purchase' GROUP BY 1),
m AS (SELECT e.user_id, count(*) FILTER (done IS NULL OR {'ts': e.ts, 'id': e.event_id} > done) AS since, max(ts) AS now, max(done.ts) AS done FROM events e LEFT JOIN d USING (user_id) GROUP BY 1)
SELECT user_id, since, since >= 5 AS by_count, coalesce(epoch_us(now) - epoch_us(done) >= 86400000000, true) AS by_time FROM m WHERE since >= 5 OR coalesce(epoch_us(now) - epoch_us(done) >= 86400000000, true)"""


def polled_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of two sources, without those of disabled scopes: approved ones first, then by the place of their scope
    among the priorities, due day and creation; 50 at most, as an agent takes them."""
    scope = _pick(["work", "home", "money", "health"], F.col("o_custkey"))
    tasks = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("task"), F.lit("loop").alias("source"), scope.alias("scope"), F.col("o_orderdate").alias("due"))
    approved = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("task"), F.lit("confirmation").alias("source"), scope.alias("scope"), F.col("o_orderdate").alias("due"))
    place = F.when(F.col("source") == "confirmation", -1).when(F.array_position(F.array(F.lit("money"), F.lit("work")), F.col("scope")) > 0, F.array_position(F.array(F.lit("money"), F.lit("work")), F.col("scope")) - 1).otherwise(2)
    open_ = tasks.unionByName(approved).where(~F.col("scope").isin("home")).withColumn("place", place.cast("long"))
    return R.ranked(open_, [F.asc("place"), F.asc("due"), F.asc("task")], [], 50).select("task", "source", "scope", "place", F.col("rank").cast("long").alias("rank"))


POLLED_SQL = """WITH t AS (SELECT o_orderkey AS task, CASE o_orderstatus WHEN 'O' THEN 'loop' ELSE 'confirmation' END AS source, (['work', 'home', 'money', 'health'])[o_custkey % 4 + 1] AS scope, o_orderdate AS due FROM orders WHERE o_orderstatus IN ('O', 'P')),
p AS (SELECT *, (CASE WHEN source = 'confirmation' THEN -1 WHEN scope = 'money' THEN 0 WHEN scope = 'work' THEN 1 ELSE 2 END)::BIGINT AS place FROM t WHERE scope <> 'home') SELECT task, source, scope, place, row_number() OVER (ORDER BY place, due, task) AS rank FROM p QUALIFY rank <= 50"""


def rendered_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with role tokens, rendered for a reader, in normal form and with a time stamp; by digest."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("{{ user }} asked {{self}}: Well-known_word, "), F.coalesce("text", F.lit(""))).alias("line"))
    return turns.select("conv_id", "turn", U.normalized(U.deixis(F.col("line"), "Ada", "Tessera")).alias("line"), U.clock(F.col("conv_id") * 61 + F.col("turn") * 7).alias("at"))


RENDERED_SQL = r"""WITH t AS (SELECT conv_id, turn, 'Ada asked Tessera: Well-known_word, ' || coalesce(text, '') AS line, conv_id * 61 + turn * 7 AS s FROM conversations)
SELECT conv_id, turn, trim(regexp_replace(translate(lower(line), '-_', '  '), '\s+', ' ', 'g')) AS line, CASE WHEN s >= 3600 THEN s // 3600 || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS at FROM t"""


def young_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns by type and whether they are old enough to be acted on."""
    kind = _pick(["identity_claim", "psychological_hypothesis", "work_loop", "value_gap"], F.floor(F.col("no") / 8))
    patterns = _records(spark, sf_dir).where("type = 'pattern'").select(kind.alias("pattern_type"), (F.col("age") % 60).alias("age"))
    return patterns.groupBy("pattern_type", (F.col("age") >= U.minimum_age(F.col("pattern_type"))).alias("old_enough")).agg(_n())


YOUNG_SQL = f"""WITH {_REC}, p AS (SELECT (['identity_claim', 'psychological_hypothesis', 'work_loop', 'value_gap'])[no // 8 % 4 + 1] AS pattern_type, age % 60 AS age FROM rec WHERE type = 'pattern')
SELECT pattern_type, age >= CASE WHEN pattern_type IN ('identity_claim', 'psychological_hypothesis') THEN 30 ELSE 7 END AS old_enough, count(*) AS n FROM p GROUP BY 1, 2"""

_ALL = [
    (quarantine_sets, QUARANTINE_SETS_SQL), (blocked_records, BLOCKED_SQL), (metadata_ranks, METADATA_SQL), (legacy_order, LEGACY_SQL), (record_retrieval, RETRIEVAL_SQL), (neighbour_demotion, DEMOTION_SQL), (domain_gates, GATES_SQL), (relation_order, ORDER_SQL),
    (name_index, INDEX_SQL), (entity_match, MATCH_SQL), (merged_entities, MERGED_SQL), (stated_edges, STATED_SQL), (entity_mentions, MENTIONS_SQL), (failure_fingerprints, FINGERPRINT_SQL), (coalesce_keys, KEYS_SQL), (payload_merge, PAYLOAD_SQL),
    (archived_failures, ARCHIVED_SQL), (code_share, CODE_SQL), (section_merge, SECTION_SQL), (text_outline, OUTLINE_SQL), (searches_of_turns, TURNS_SQL), (quote_evidence, QUOTE_SQL), (dimension_means, MEANS_SQL), (batch_summary, BATCH_SQL),
    (superseded_records, SUPERSEDED_SQL), (due_triggers, TRIGGERS_SQL), (polled_tasks, POLLED_SQL), (rendered_roles, RENDERED_SQL), (young_patterns, YOUNG_SQL),
]
QUERIES = {f.__name__: f for f, _ in _ALL}
SQL = {f.__name__: sql for f, sql in _ALL}
