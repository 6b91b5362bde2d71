"""Queries of the index of records, over records made of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import chunks as C
from tessera.functions import heads as H
from tessera.operators.ingest import note_routes
from tessera.plans.retrieval import table
from tessera.session import work_dir
from tessera.sources.index import RecordIndex, built
from tessera.sources.notes import register

_n = lambda: F.count(F.lit(1)).alias("n")


def _record(step: Column) -> Column:
    """A document as a record: English ones are claims, French ones entities, others episodes with a table of claims."""
    name = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    kind = F.when(F.col("lang") == "en", "claim").when(F.col("lang") == "fr", "entity").otherwise("episode")
    head = F.to_json(F.struct(
        name("d", F.col("doc_id")).alias("id"), kind.alias("type"), F.col("source").alias("domain_primary"), F.array(name("d", F.col("doc_id") + step)).alias("links"), name("ev", F.col("doc_id") % 10).alias("supporting_evidence"),
        name("Name ", F.floor(F.col("doc_id") / 2)).alias("canonical_name"), F.array(name("n", F.col("doc_id") % 7), F.lit("")).alias("aliases"), F.lit("nick").alias("nickname"), F.when(F.col("doc_id") % 2 == 0, F.lit(" a.1 ")).alias("artifact_ref"), F.col("doc_id").alias("epoch"),
    ))
    claims = F.concat(F.lit("\n## Claims\n|ID|Claim|Status|\n|-|-|-|\n|q"), F.col("doc_id").cast("string"), F.lit("|his tax|open|\n|ragged|\n|r"), F.col("doc_id").cast("string"), F.lit("|it holds| |\n"))
    return F.concat(F.lit("---\n"), head, F.lit("\n---\n"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[|#]", " "), claims)


def _path() -> Column:
    folder = F.when(F.col("doc_id") % 13 == 0, "drafts").when(F.col("doc_id") % 17 == 0, "manifests").otherwise(F.lit("records"))
    return F.concat_ws("/", folder, F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.when(F.col("doc_id") % 26 == 0, "-needs_revision").otherwise(""), F.lit(".md")))


def index_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of an index of all documents after a batch in which every seventh record changes and every eleventh goes."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").withColumn("path", _path())
    index = RecordIndex(spark, work_dir(spark))
    index.build(docs.select("path", _record(F.lit(1)).alias("raw")))
    gone = F.col("doc_id") % 11 == 0
    changed = docs.where((F.col("doc_id") % 7 == 0) | gone).select("path", F.when(~gone, _record(F.lit(2))).alias("raw"), gone.alias("removed"))
    index.apply(changed, "changes", 1)
    return index.table("links")


def index_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and aliases of a full build."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    tables = built(docs.select(_path().alias("path"), _record(F.lit(1)).alias("raw")))
    claims = tables["claims"].select(F.lit("claim").alias("kind"), "id", F.col("episode_id").alias("of"), F.concat_ws("|", "claim_text", "claim_type", "confidence", F.coalesce("sensitivity", F.lit("-")), "status").alias("what"))
    aliases = tables["entity_aliases"].select(F.lit("alias").alias("kind"), F.col("entity_id").alias("id"), F.coalesce("context", F.lit("-")).alias("of"), F.col("alias").alias("what"))
    return claims.unionByName(aliases)


_KEPT_SQL = "SELECT *, 'd' || doc_id AS id, CASE lang WHEN 'en' THEN 'claim' WHEN 'fr' THEN 'entity' ELSE 'episode' END AS type FROM documents WHERE (doc_id % 13 <> 0 OR doc_id % 26 = 0) AND (doc_id % 13 = 0 OR doc_id % 17 <> 0)"
CHANGED_SQL = f"""WITH d AS ({_KEPT_SQL} AND doc_id % 11 <> 0)
SELECT id AS source_id, 'd' || (doc_id + CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END) AS target_id, 'related' AS relationship_type FROM d
UNION ALL SELECT id, 'ev' || (doc_id % 10), 'supports' FROM d UNION ALL SELECT 'a.1', id, 'artifact_provenance' FROM d WHERE doc_id % 2 = 0 AND type = 'claim'"""
TABLES_SQL = f"""WITH d AS ({_KEPT_SQL})
SELECT 'claim' AS kind, id, 'd' || (doc_id + 1) AS of, '|interpretation|0.5|low|active' AS what FROM d WHERE type = 'claim'
UNION ALL SELECT 'claim', 'q' || doc_id, id, 'his tax|reported|low|requires_professional_review|open' FROM d WHERE type = 'episode'
UNION ALL SELECT 'claim', 'r' || doc_id, id, 'it holds|reported|low|-|unresolved' FROM d WHERE type = 'episode'
UNION ALL SELECT 'alias', id, '-', 'Name ' || (doc_id // 2) FROM d WHERE type = 'entity' UNION ALL SELECT 'alias', id, '-', 'n' || (doc_id % 7) FROM d WHERE type = 'entity'
UNION ALL (SELECT 'alias', arg_min(id, CASE WHEN doc_id % 13 = 0 THEN 'a' ELSE 'r' END || lpad(doc_id::VARCHAR, 12, '0')), 'nickname', 'nick' FROM d WHERE type = 'entity' HAVING count(*) > 0)"""


def usual_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of event fields in their usual spelling, as claims' classes, owners and sensitivities would be."""
    events = table(spark, sf_dir, "events").select(F.element_at(F.array(*map(F.lit, ["Opinion", "self-report", "MOTIVATION", "Secret", "me", "low"])), (F.col("event_id") % 6 + 1).cast("int")).alias("v"))
    return events.groupBy(H.usual(F.col("v"), "claim_class").alias("class"), H.usual(F.col("v"), "claim_owner").alias("owner"), H.usual(F.col("v"), "sensitivity").alias("sensitivity")).agg(_n())


USUAL_SQL = """WITH e AS (SELECT event_id % 6 AS k FROM events)
SELECT CASE k WHEN 0 THEN 'value_statement' WHEN 1 THEN 'self_report' WHEN 2 THEN 'motive_hypothesis' ELSE 'interpretation' END AS class, CASE k WHEN 4 THEN 'user' ELSE 'external_actor' END AS owner,
CASE k WHEN 3 THEN 'sealed' ELSE 'low' END AS sensitivity, count(*) AS n FROM e GROUP BY 1, 2, 3"""

QUERIES = {"index_after_changes": index_after_changes, "index_tables": index_tables, "usual_values": usual_values}
SQL = {"index_after_changes": CHANGED_SQL, "index_tables": TABLES_SQL, "usual_values": USUAL_SQL}


def _clean() -> Column:
    """A document's words, without marks that a heading could have."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^a-zà-ÿ]+", " "))


def header_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents that have their words under one heading, their first 30 letters under others, and pages."""
    text = F.concat(_clean(), F.lit("\n# Alpha\n"), F.substring(_clean(), 1, 30), F.lit("\n--- Page 2 ---\n## Beta\n--- Page 4 ---\n"), _clean(), F.lit("\n1.2 Gamma\n"), F.substring(_clean(), 1, 30))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"))
    cut = C.chunked(docs, F.col("text"), F.col("name"))
    return cut.select("doc_id", "title", "breadcrumb", "source_ref", "chunk_index", "total_chunks", F.size(F.filter(F.split("body", r"\s+"), lambda w: w != "")).cast("long").alias("words"))


# Sections: intro, Alpha, Beta, Gamma; one below 200 words goes in front of the next; the last takes what is left.
HEADER_SQL = """WITH d AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-zà-ÿ]+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, 'd' || doc_id AS name, len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS n, len(list_filter(string_split(substr(t, 1, 30), ' '), lambda x: x <> '')) AS s FROM d WHERE t <> ''),
x AS (SELECT *, n >= 200 AS big FROM w),
c AS (SELECT doc_id, name AS title, name AS breadcrumb, name || ', ' || name AS source_ref, 0 AS k, n AS words, n > 1500 AS over FROM x WHERE big
UNION ALL SELECT doc_id, 'Beta', name || ' > Alpha > Beta', name || ', ' || name || ' > Alpha > Beta, pages 2-4', 1, n + s + 2, n + s + 2 > 1500 FROM x WHERE big
UNION ALL SELECT doc_id, '1.2 Gamma', name || ' > Alpha > 1.2 Gamma', name || ', ' || name || ' > Alpha > 1.2 Gamma', 2, s, false FROM x WHERE big
UNION ALL SELECT doc_id, '1.2 Gamma', name || ' > Alpha > 1.2 Gamma', name || ', ' || name || ' > Alpha > 1.2 Gamma, pages 2-4', 0, 2 * n + 2 * s + 6, false FROM x WHERE NOT big),
p AS (SELECT *, unnest(CASE WHEN NOT over THEN [0] WHEN k = 0 THEN [1] WHEN words - s0 > 0 THEN [1, 2] END) AS part FROM (SELECT c.*, s + 2 AS s0, s FROM c JOIN x USING (doc_id)))
SELECT doc_id, title || CASE WHEN part = 0 THEN '' ELSE ' (part ' || part || ' of ' || tot || ')' END AS title, breadcrumb || CASE WHEN part = 0 THEN '' ELSE ' > part ' || part || ' of ' || tot END AS breadcrumb, source_ref || CASE WHEN part = 0 THEN '' ELSE ', part ' || part || ' of ' || tot END AS source_ref,
(row_number() OVER (PARTITION BY doc_id ORDER BY k, part) - 1)::BIGINT AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, (CASE WHEN part = 1 AND k = 1 THEN s0 WHEN part = 2 THEN words - s0 ELSE words END)::BIGINT AS words
FROM (SELECT *, CASE WHEN k = 0 THEN 1 ELSE 2 END AS tot FROM p)"""


def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items written as notes, one file each, and read again by the source, with their routes."""
    folder = work_dir(spark)
    kinds = F.element_at(F.array(*map(F.lit, ["people", "pets", "days", "secrets"])), (F.col("item_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "benchmark").select(kinds.alias("kind"), F.concat(F.lit("Note "), F.col("item_id").cast("string")).alias("note"), F.regexp_replace("text", r"\s+", " ").alias("value"))
    rows.repartition("note").write.partitionBy("kind", "note").text(folder)
    register(spark)
    notes = spark.read.format("notes").option("endings", ".txt").load(folder).where(~F.contains("path", F.lit("kind=days/")))
    named = notes.select(F.regexp_replace("path", r"^kind=([^/]*)/note=([^/]*)/.*$", "$1/$2.md").alias("path"), F.trim(F.regexp_replace("raw", r"\n$", "")).alias("raw"))
    routed = note_routes(named.select(F.regexp_replace("path", "%20", " ").alias("path"), "raw"))
    return routed.select("path", "route", "kind", "name", F.md5("raw").alias("digest"))


NOTES_SQL = r"""WITH b AS (SELECT item_id, ['people', 'pets', 'days', 'secrets'][item_id % 4 + 1] AS k, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM benchmark WHERE item_id % 4 <> 2)
SELECT k || '/Note ' || item_id || '.md' AS path, CASE WHEN t = '' THEN 'empty' ELSE 'knowledge' END AS route, NULL::VARCHAR AS kind, NULL::VARCHAR AS name, md5(t) AS digest FROM b"""

QUERIES |= {"header_chunks": header_chunks, "note_files": note_files}
SQL |= {"header_chunks": HEADER_SQL, "note_files": NOTES_SQL}
