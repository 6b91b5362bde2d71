"""Hybrid retrieval: metadata, BM25 and vector lanes, rank fusion, learned partners and bounded graph expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.session import pieces, written

K1, B = 1.2, 0.75
RRF_K, LANE_LIMIT, FUSED_LIMIT = 60, 30, 20
#: Up to so many distinct terms of all queries are told to the tasks; more are joined.
FEW_TERMS = 2000


def ranked(df: DataFrame, by: list[Column], keys: list[str], limit: int) -> DataFrame:
    """Rows within the first `limit` of their keys, with their rank from 1."""
    window = Window.partitionBy(*keys).orderBy(*by) if keys else Window.orderBy(*by)
    if not keys:  # a global top: each task keeps its own first rows before they meet
        df = df.orderBy(*by).limit(limit)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def postings(docs: DataFrame, doc: str, terms: Column) -> DataFrame:
    """(term, doc, tf, dl): how often each term stands in a document of dl terms."""
    exploded = docs.select(doc, F.size(terms).alias("dl"), F.explode(terms).alias("term"))
    return exploded.groupBy("term", doc).agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))


def bm25(docs: DataFrame, doc: str, terms: Column, queries: DataFrame, query: str, query_terms: Column, alike: int | None = None) -> DataFrame:
    """(query, doc, score) of all documents that share a term with a query. alike: of documents that all queries score
    the same (equal lengths, equal numbers of asked terms) only so many, those with the highest doc; for the first so
    many of each query by score, then doc, no others are needed.

    idf is ln((N - n + 0.5) / (n + 0.5)), or 1e-6 where that is not positive; a term that a query repeats counts
    as often. Only the postings of query terms leave the first stage, which is stored. docs must have each doc once."""
    wanted = queries.select(query, F.explode(query_terms).alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("qtf"))
    few = [r["term"] for r in wanted.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    docs = docs.select(doc, F.explode(F.array(terms)).alias("_terms"))  # the terms are worked out once a row
    every = docs.select(doc, F.size("_terms").alias("dl"), F.explode(F.concat("_terms", F.array(F.lit("")))).alias("term"))
    asked = wanted.select("term").distinct()
    if len(few) <= FEW_TERMS:  # other terms go before anything is moved
        asked = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in {*few, ""}], "term string"))
    else:
        asked = asked.unionByName(docs.sparkSession.createDataFrame([("",)], "term string"))
    # One pass over the texts. The empty term stands for the document itself, so that its length counts without a hit.
    hits = written(every.join(asked, "term", "left_semi").groupBy("term", doc).agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl")))
    stats = hits.where("term = ''").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
    held = hits.where("term <> ''")
    n = held.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    idf = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weighted = n.crossJoin(F.broadcast(stats)).select("term", "avg_dl", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"))
    if alike is not None:
        bags = held.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("_bag"), F.max("dl").alias("dl"))
        held = written(ranked(bags, [F.desc(doc)], ["_bag", "dl"], alike).select(doc, "dl", F.inline("_bag")))
    met = held.join(wanted, "term").join(weighted, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    return met.groupBy(query, doc).agg(F.sum(part).alias("score"))


def fuse(lanes: DataFrame, item: str, keys: list[str], k: int = RRF_K, limit: int = FUSED_LIMIT) -> DataFrame:
    """Reciprocal rank fusion of lanes (keys, item, lane, rank): score, number of lanes and their names."""
    fused = lanes.groupBy(*keys, item).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.count_distinct("lane").alias("n_lanes"), F.array_join(F.sort_array(F.collect_set("lane")), ",").alias("lanes"))
    fused = fused.withColumn("rrf", F.round("rrf", 6))
    return ranked(fused, [F.desc("rrf"), F.desc("n_lanes"), F.asc(item)], keys, limit)


def recency(days: Column, horizon: int = 365) -> Column:
    """1 for today, falling to 0 at the horizon; 0 for the future and for no date."""
    return F.when(days >= 0, F.greatest(F.lit(0.0), 1 - days / horizon)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors, different lengths or no norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def npmi_edges(events: DataFrame, event: str, item: str, least: int = 3, floor: float = 0.3, partners: int = 8, last: int | None = None, authored: DataFrame | None = None) -> DataFrame:
    """Learned edges between items that events select together: (source, target, co_count, npmi), both ways.

    An event counts if it has two items at least. Pairs need `least` common events and an npmi of `floor`; a pair
    in every event has none. Each item keeps its best partners by (npmi desc, target). Only the `last` events by id
    count, if that is given; pairs that are authored (source, target, either way) learn nothing."""
    if last is not None:  # the bound comes first: events of one item use it up too
        events = events.join(events.select(event).distinct().orderBy(F.desc(event)).limit(last), event, "left_semi")
    n = pieces(events)
    sets = events.select(event, item).where(F.col(item).isNotNull()).repartition(n, event).distinct()
    big = sets.groupBy(event).count().where("count >= 2").select(event)
    sets = sets.join(big, event)
    total = big.agg(F.count(F.lit(1)).alias("n"))
    by_item = sets.repartition(n, item)
    single = by_item.groupBy(item).agg(F.count(F.lit(1)).alias("c"))
    # An item in few events has no pair in `least` of them, so the self-join leaves it out.
    often = by_item.join(single.where(F.col("c") >= least).select(item), item, "left_semi").repartition(n, event)
    pairs = often.alias("a").join(often.alias("b"), event).where(F.col(f"a.{item}") < F.col(f"b.{item}"))
    # There are several times as many pairs as rows, and hardly any twice in one piece: they are dealt out before they are counted.
    pairs = pairs.select(F.col(f"a.{item}").alias("source"), F.col(f"b.{item}").alias("target")).repartition(2 * n, "source", "target")
    pairs = pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("co_count")).where(F.col("co_count") >= least)
    if authored is not None:
        known = authored.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
        pairs = pairs.join(known, ["source", "target"], "left_anti")
    met = pairs.join(single.select(F.col(item).alias("source"), F.col("c").alias("ca")), "source").join(single.select(F.col(item).alias("target"), F.col("c").alias("cb")), "target").crossJoin(F.broadcast(total))
    p = F.col("co_count") / F.col("n")
    met = met.where(F.col("co_count") < F.col("n")).withColumn("npmi", F.round(F.log(p / (F.col("ca") / F.col("n") * F.col("cb") / F.col("n"))) / -F.log(p), 4)).where(F.col("npmi") >= floor)
    both = met.select("source", "target", "co_count", "npmi").unionByName(met.select(F.col("target").alias("source"), F.col("source").alias("target"), "co_count", "npmi"))
    return ranked(both, [F.desc("npmi"), F.asc("target")], ["source"], partners).drop("rank")


def learned_partners(edges: DataFrame, seeds: DataFrame, seed: str, limit: int = 5) -> DataFrame:
    """Items that edges join to the seeds, by their best npmi; seeds themselves are left out."""
    met = edges.join(seeds.select(F.col(seed).alias("source")), "source", "left_semi").groupBy("target").agg(F.max("npmi").alias("npmi"))
    met = met.join(seeds.select(F.col(seed).alias("target")), "target", "left_anti")
    return ranked(met, [F.desc("npmi"), F.asc("target")], [], limit)


def relation_bonus(relation: Column) -> Column:
    found = F.element_at(F.create_map(*(F.lit(x) for kv in L.RELATION_BONUS.items() for x in kv)), relation)
    return F.coalesce(found, F.lit(L.DEFAULT_RELATION_BONUS))


def allowed_edges(edges: DataFrame) -> DataFrame:
    """Edges (source_type, target_type, relation, ...) that the whitelist lets through."""
    rules = [(s, t, r) for s, targets, relations in L.EDGE_WHITELIST for t in (targets or [None]) for r in relations]
    held = edges.sparkSession.createDataFrame(rules, "source_type string, t string, relation string").withColumn("t", F.coalesce("t", F.lit("*")))
    return edges.join(F.broadcast(held), ["source_type", "relation"], "inner").where((F.col("t") == "*") | (F.col("t") == F.col("target_type"))).drop("t").distinct()


def hop(frontier: DataFrame, edges: DataFrame, number: int, keys: list[str]) -> DataFrame:
    """One step of expansion: frontier (keys, id, score) over edges (source_id, target_id, relation). A target's score is
    max(0.1, 0.85 * score + bonus - 0.08 * hop), its best where it is reached twice."""
    score = F.greatest(F.lit(0.1), 0.85 * F.col("score") + relation_bonus(F.col("relation")) - 0.08 * number)
    met = frontier.join(edges, frontier["id"] == edges["source_id"])
    return met.groupBy(*keys, F.col("target_id").alias("id")).agg(F.max(score).alias("score")).withColumn("hop", F.lit(number).cast("long"))


def expand(seeds: DataFrame, edges: DataFrame, limit: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Items within two hops of the seeds (keys, id, score) that are not seeds; the first `limit` of each search (its
    keys; without keys all seeds are one search) by (hop, score desc, id). On the second hop sources count with a score
    of 0."""
    keys = keys or []
    own = seeds.select(*keys, "id")
    first = hop(seeds.select(*keys, "id", "score"), edges, 1, keys).join(own, [*keys, "id"], "left_anti")
    second = hop(first.select(*keys, "id", F.lit(0.0).alias("score")), edges, 2, keys).join(own, [*keys, "id"], "left_anti").join(first.select(*keys, "id"), [*keys, "id"], "left_anti")
    return ranked(first.unionByName(second), [F.asc("hop"), F.desc("score"), F.asc("id")], keys, limit)
