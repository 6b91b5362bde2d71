"""Queries of references, merge chains, causes, near events and the matching of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import matching as M
from tessera.operators import priors as P
from tessera.operators import references as R
from tessera.plans.retrieval import table

_name = lambda prefix, n: F.concat(F.lit(prefix), F.expr(f"cast({n} AS string)"))
_choice = lambda options, n: F.element_at(F.array(*options), (F.expr(n) % len(options) + 1).cast("int"))


def merge_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts merged into the part of a third of their key, again and again; some run into circles."""
    into = F.when(F.expr("p_partkey % 1000 = 501"), F.expr("p_partkey + 1")).when(F.expr("p_partkey % 1000 = 502"), F.expr("p_partkey - 1")).when(F.expr("p_partkey % 3 = 0 AND p_partkey > 0"), F.expr("p_partkey div 3"))
    merges = table(spark, sf_dir, "part").select(_name("p", "p_partkey").alias("id"), F.concat(F.lit("p"), into.cast("string")).alias("into"))
    return R.survivors(merges)


SURVIVORS_SQL = """WITH RECURSIVE m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 1000 = 501 THEN p_partkey + 1 WHEN p_partkey % 1000 = 502 THEN p_partkey - 1 WHEN p_partkey % 3 = 0 AND p_partkey > 0 THEN p_partkey // 3 END AS into_ FROM part),
c(id, pos, d) AS (SELECT id, into_, 1 FROM m WHERE into_ IS NOT NULL UNION ALL SELECT c.id, m.into_, d + 1 FROM c JOIN m ON m.id = c.pos WHERE m.into_ IS NOT NULL AND d < 40)
SELECT 'p' || id AS id, 'p' || max(CASE WHEN pos NOT IN (SELECT id FROM m WHERE into_ IS NOT NULL) THEN pos END) AS survivor FROM c GROUP BY id"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records: entities, claims, episodes, archived ones that were merged, and drafts."""
    k = F.col("p_partkey")
    folder = _choice([F.lit(x) for x in ("entities", "claims", "archive", "drafts", "episodes")], "p_partkey")
    return table(spark, sf_dir, "part").select(
        _name("r", "p_partkey").alias("id"), F.concat_ws("/", folder, k.cast("string"), F.concat(_name("f", "p_partkey % 700"), F.lit(".md"))).alias("path"), F.when(k % 5 == 0, "entity").otherwise("claim").alias("type"),
        F.array(_name("Name ", "p_partkey div 5 % 900")).alias("names"), F.concat(_name("it holds that part ", "p_partkey % 900"), F.lit(" fits")).alias("claim_text"), F.when(k % 20 == 2, _name("r", "p_partkey - 2")).alias("merged_into"),
    )


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = [F.col("id"), F.col("path"), F.concat(F.lit("x/"), F.regexp_extract("path", r"[^/]*$", 0)), F.col("claim_text"), F.concat(F.lit("people/"), F.lower(F.regexp_replace(F.get("names", F.lit(0)), " ", "-")), F.lit(".md")), F.concat(F.col("id"), F.lit("?"))]
    return _records(spark, sf_dir).select("id", F.array(*forms).alias("refs"))


def reference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What six forms of a reference to each part resolve to."""
    refs = _refs(spark, sf_dir).select(F.explode("refs").alias("ref")).distinct()
    return R.resolve(refs, _records(spark, sf_dir))


def canonical_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's six references as a list of records, and those that name none."""
    found = R.canonical_lists(_refs(spark, sf_dir), _records(spark, sf_dir))
    return found.select("id", F.array_join("kept", ",").alias("kept"), F.array_join("dropped", ",").alias("dropped"))


_REFS = """WITH r AS (SELECT p_partkey AS k, 'r' || p_partkey AS id, ['entities', 'claims', 'archive', 'drafts', 'episodes'][p_partkey % 5 + 1] AS folder, 'f' || (p_partkey % 700) || '.md' AS file, 'name ' || (p_partkey // 5 % 900) AS nm, 'it holds that part ' || (p_partkey % 900) || ' fits' AS ct FROM part),
x AS (SELECT id, unnest([{'n': 1, 'ref': id}, {'n': 2, 'ref': folder || '/' || k || '/' || file}, {'n': 3, 'ref': 'x/' || file}, {'n': 4, 'ref': ct}, {'n': 5, 'ref': 'people/' || replace(nm, ' ', '-') || '.md'}, {'n': 6, 'ref': id || '?'}], recursive := true) FROM r),
lv AS (SELECT * FROM r WHERE folder IN ('entities', 'claims', 'episodes')),
fi AS (SELECT 'x/' || file AS ref, min(id) AS target, count(*) AS c FROM lv GROUP BY 1), cl AS (SELECT ct AS ref, min(id) AS target, count(*) AS c FROM lv GROUP BY 1), al AS (SELECT 'people/' || replace(nm, ' ', '-') || '.md' AS ref, min(id) AS target, count(*) AS c FROM lv WHERE folder = 'entities' GROUP BY 1),
f AS (SELECT x.id, x.n, x.ref, CASE x.n WHEN 1 THEN CASE WHEN r.k % 20 = 2 THEN 'merged' WHEN r.folder = 'drafts' THEN 'unknown' ELSE 'id' END WHEN 2 THEN CASE WHEN r.folder = 'drafts' THEN 'unindexed' ELSE 'path' END WHEN 3 THEN CASE WHEN fi.c = 1 THEN 'basename' ELSE 'unknown' END WHEN 4 THEN CASE WHEN cl.c = 1 THEN 'claim_text' ELSE 'prose' END WHEN 5 THEN CASE WHEN al.c = 1 THEN 'alias' ELSE 'unknown' END ELSE 'unknown' END AS kind,
CASE x.n WHEN 1 THEN CASE WHEN r.k % 20 = 2 THEN 'r' || (r.k - 2) WHEN r.folder <> 'drafts' THEN r.id END WHEN 2 THEN CASE WHEN r.folder <> 'drafts' THEN r.id END WHEN 3 THEN CASE WHEN fi.c = 1 THEN fi.target END WHEN 4 THEN CASE WHEN cl.c = 1 THEN cl.target END WHEN 5 THEN CASE WHEN al.c = 1 THEN al.target END END AS target
FROM x JOIN r USING (id) LEFT JOIN fi ON fi.ref = x.ref LEFT JOIN cl ON cl.ref = x.ref LEFT JOIN al ON al.ref = x.ref)"""
KINDS_SQL = f"{_REFS} SELECT DISTINCT ref, kind, target FROM f"
CANONICAL_SQL = f"{_REFS}, o AS (SELECT id, target, min(n) AS n FROM f WHERE target IS NOT NULL GROUP BY 1, 2), k AS (SELECT id, string_agg(target, ',' ORDER BY n) AS kept FROM o GROUP BY 1), d AS (SELECT id, string_agg(ref, ',' ORDER BY n) AS dropped FROM f WHERE target IS NULL GROUP BY 1) SELECT r.id, coalesce(kept, '') AS kept, coalesce(dropped, '') AS dropped FROM r LEFT JOIN k USING (id) LEFT JOIN d USING (id)"


def causal_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records that say which supplier is behind another's delay, or that one had no choice."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"))
    marker = _choice([F.lit(x) for x in ("because of", "due to", "blamed on", "under pressure from")], "l_orderkey")
    far = F.when(F.expr("l_orderkey % 5 = 0"), F.repeat(F.lit("x"), 80)).otherwise("")
    text = F.concat(_name("Supplier#", "lpad(a, 9, '0')"), F.lit(" was late "), far, F.lit(" "), marker, F.lit(" "), _name("SUPPLIER#", "lpad(b, 9, '0')"), F.when(F.expr("l_orderkey % 3 = 0"), F.lit(" who had no choice")).otherwise("."))
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd")
    records = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("id"), text.alias("text"), stamp.alias("stamp"))
    people = table(spark, sf_dir, "supplier").select(_name("s", "s_suppkey").alias("id"), F.lit("organization").alias("subtype"), F.array("s_name").alias("names"))
    return P.causes(records, people)


CAUSES_SQL = """WITH l AS (SELECT l_orderkey AS k, min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY 1), r AS (SELECT k, a, b, strftime(o_orderdate, '%Y-%m-%d') AS stamp FROM l JOIN orders ON o_orderkey = k),
e AS (SELECT 'pairwise' AS kind, 's' || a AS subject, 's' || b AS agent, k, stamp FROM r WHERE k % 5 <> 0 AND a <> b UNION ALL SELECT 'non_originating', CASE WHEN k % 5 <> 0 THEN 's' || a ELSE 's' || b END, NULL, k, stamp FROM r WHERE k % 3 = 0)
SELECT kind, subject, agent, count(DISTINCT k) AS support, min(stamp) AS first, max(stamp) AS last FROM e GROUP BY 1, 2, 3 HAVING count(DISTINCT k) >= 3"""


def near_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within 90 seconds of an error of the same user."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("unix_millis(cast(ts AS timestamp))").alias("at"))
    pairs = P.near_pairs(events.where("event_type = 'error'"), events.where("event_type = 'purchase'"), "user_id", "at", 90_000)
    return pairs.select(F.col("a.event_id").alias("error_id"), F.col("b.event_id").alias("purchase_id"), (F.col("b.at") - F.col("a.at")).alias("apart"))


NEAR_SQL = """WITH e AS (SELECT event_id, user_id, event_type, epoch_ms(ts) AS at FROM events)
SELECT a.event_id AS error_id, b.event_id AS purchase_id, b.at - a.at AS apart FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND abs(a.at - b.at) <= 90000"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    names = F.concat_ws(" ", "p_name", _name("no", "p_partkey * 7 % 701"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.expr("p_partkey % 4 = 0"), "person").when(F.expr("p_partkey % 4 = 1"), "place").otherwise("project").alias("subtype"), F.array(F.when(F.expr("p_partkey % 4 = 1"), F.concat_ws(" ", "p_name", F.lit("hall"))).otherwise(names)).alias("names"),
        F.when(F.expr("p_partkey % 9 = 0"), _name("nick", "p_partkey % 450")).alias("nickname"), none.alias("disambiguation"), none.alias("summary"),
    )


def entity_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity that a name, as it is or changed, folds into, over all stages; places all have one surname."""
    own = _entities(spark, sf_dir).select("id", "subtype", F.get("names", F.lit(0)).alias("name"), "nickname")
    changed = _choice([F.col("name"), F.concat("name", F.lit(" trip")), F.element_at(F.split("name", " "), -1), F.concat_ws(" ", F.lit("new"), "name"), F.coalesce("nickname", F.col("name")), F.concat_ws(" ", F.get(F.split("name", " "), F.lit(0)), F.lit("hall"))], "id div 50")
    asked = own.where("id % 50 < 2").select(F.col("id").alias("proposal"), changed.alias("name"), _choice([F.col("subtype"), F.lit("place")], "id div 300").alias("subtype"))
    return M.match_entities(asked, _entities(spark, sf_dir))


_CASCADE = r"""WITH ent AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'person' WHEN p_partkey % 4 = 1 THEN 'place' ELSE 'project' END AS subtype, CASE WHEN p_partkey % 4 = 1 THEN p_name || ' hall' ELSE p_name || ' no' || (p_partkey * 7 % 701) END AS name, CASE WHEN p_partkey % 9 = 0 THEN 'nick' || (p_partkey % 450) END AS nickname FROM part),
cl AS (SELECT id, lower(name) AS key, 0 AS tok FROM ent UNION ALL SELECT id, unnest(string_split(lower(name), ' ')), 1 FROM ent),
fi AS (SELECT key, id AS fid, tok AS ftok FROM cl QUALIFY row_number() OVER (PARTITION BY key ORDER BY id, tok) = 1),
ix AS (SELECT key, any_value(fid) AS id, CASE WHEN bool_or(id <> fid AND (tok = 0 OR ftok = 1)) THEN 'ambiguous' WHEN any_value(ftok) = 1 THEN 'token' ELSE 'full' END AS kind FROM cl JOIN fi USING (key) GROUP BY key),
it AS (SELECT ix.*, subtype AS ft FROM ix JOIN ent USING (id)),
pr AS (SELECT id AS proposal, ([name, name || ' trip', split_part(name, ' ', -1), 'new ' || name, coalesce(nickname, name), split_part(name, ' ', 1) || ' hall'])[id // 50 % 6 + 1] AS name, CASE id // 300 % 2 WHEN 0 THEN subtype ELSE 'place' END AS subtype FROM ent WHERE id % 50 < 2),
lo AS (SELECT *, lower(name) AS low, regexp_replace(lower(name), '( (project|plan|event|meeting|dinner|lunch|coffee|trip|visit|session|work|day|party|workday))+$', '') AS base, string_split(lower(name), ' ') AS w FROM pr),
sn AS (SELECT *, CASE WHEN len(w) > 1 THEN w[-1] END AS surname FROM lo),
es AS (SELECT subtype, split_part(lower(name), ' ', -1) AS surname FROM ent), tot AS (SELECT subtype, count(*) AS n FROM es GROUP BY 1), sm AS (SELECT subtype, surname, count(*) AS n FROM es GROUP BY 1, 2),
wo AS (SELECT proposal, subtype, len(w) AS n, unnest(list_distinct(w)) AS key FROM lo),
tk AS (SELECT proposal, min(id) AS id FROM wo JOIN it USING (key) WHERE n = 1 AND kind <> 'ambiguous' AND (ft = subtype OR ft = 'person') GROUP BY 1),
ws AS (SELECT proposal, it.id, count(*) AS k FROM wo JOIN it USING (key) WHERE n > 1 AND kind <> 'ambiguous' AND ft = subtype GROUP BY 1, 2 HAVING count(*) >= 2), wb AS (SELECT * FROM ws QUALIFY row_number() OVER (PARTITION BY proposal ORDER BY k DESC, id) = 1),
ky AS (SELECT id, subtype, id::VARCHAR AS key FROM ent UNION SELECT id, subtype, nickname FROM ent WHERE nickname IS NOT NULL UNION SELECT id, subtype, lower(name) FROM ent),
re AS (SELECT proposal, min(id) AS id FROM (SELECT proposal, ky.id FROM wo JOIN ky USING (subtype, key) UNION SELECT proposal, ent.id FROM lo JOIN ent ON ent.subtype = lo.subtype AND lower(ent.name) = low) GROUP BY 1),
pe AS (SELECT lower(name) AS low, min(id) AS id FROM ent WHERE subtype = 'person' GROUP BY 1),
st AS (SELECT sn.*, f.id AS fid, b.id AS bid, tk.id AS tid, wb.id AS wid, re.id AS rid, pe.id AS pid, coalesce(tot.n, 0) > coalesce(sm.n, 0) AND sn.surname IS NOT NULL AS veto, f.ft, b.id IS NOT NULL AND base <> sn.low AS isbase
FROM sn LEFT JOIN it f ON f.key = sn.low AND f.kind = 'full' LEFT JOIN it b ON b.key = base AND b.kind = 'full' LEFT JOIN tk USING (proposal) LEFT JOIN wb USING (proposal) LEFT JOIN re USING (proposal) LEFT JOIN pe ON pe.low = sn.low LEFT JOIN tot ON tot.subtype = sn.subtype LEFT JOIN sm ON sm.subtype = sn.subtype AND sm.surname = sn.surname),
sg AS (SELECT *, CASE WHEN fid IS NOT NULL AND (ft = subtype OR ft = 'person') THEN 'full' WHEN isbase THEN 'base' WHEN tid IS NOT NULL THEN 'token' WHEN veto THEN NULL WHEN wid IS NOT NULL THEN 'words' WHEN rid IS NOT NULL THEN 'residue' WHEN len(w) > 1 AND subtype <> 'person' AND pid IS NOT NULL THEN 'person' END AS stage FROM st)
SELECT proposal, name, CASE stage WHEN 'full' THEN fid WHEN 'base' THEN bid WHEN 'token' THEN tid WHEN 'words' THEN wid WHEN 'residue' THEN rid WHEN 'person' THEN pid END AS id, stage FROM sg"""


def near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with brands that are one edit apart."""
    return M.near_names(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name")))


NAMES_SQL = "WITH n AS (SELECT DISTINCT lower(p_name || ' ' || p_brand) AS name FROM part) SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON x.name < y.name AND abs(length(x.name) - length(y.name)) <= 1 AND levenshtein(x.name, y.name) = 1"

QUERIES = {"merge_survivors": merge_survivors, "reference_kinds": reference_kinds, "canonical_references": canonical_references, "causal_priors": causal_priors, "near_events": near_events, "entity_cascade": entity_cascade, "near_names": near_names}
SQL = {"merge_survivors": SURVIVORS_SQL, "reference_kinds": KINDS_SQL, "canonical_references": CANONICAL_SQL, "causal_priors": CAUSES_SQL, "near_events": NEAR_SQL, "entity_cascade": _CASCADE, "near_names": NAMES_SQL}
