"""Expansion of searches over the graph of records, each with its own budget and reasons for what is kept out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.operators.retrieval import allowed_edges, relation_bonus
from tessera.operators.rules import domain_gate, relation_place
from tessera.session import written

BUDGET, ACROSS, HOPS = 5, 2, 2
RESULT = "search string, id string, hop int, place int, source string, relation string, score double, kept boolean, reason string, path array<string>"
NAMES = [x.split()[0] for x in RESULT.split(", ")]
KINDS = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.list_(pa.string())]


class _Search:
    """What one search has let in so far. Its candidates come in order; each call says what becomes of one."""

    def __init__(self, budget: int, across: int, taken: list[str], used: int):
        self.budget, self.across, self.taken, self.used = budget, across, set(taken), used

    def full(self) -> bool:
        return len(self.taken) >= self.budget

    def judge(self, c: dict) -> tuple[bool, str] | None:
        """(kept, reason), or none for a candidate that is there already."""
        if c["blocked"]:
            return False, c["blocked"]
        if c["crosses"]:
            if c["gate"] is None:
                return False, "cross_domain_bridging_not_justified"
            if self.used >= self.across:
                return False, "max_cross_domain_records"
            self.used += 1
        if c["target_id"] in self.taken:
            return None
        self.taken.add(c["target_id"])
        return True, f"{c['source_type']}.{c['relation']}->{c['target_type']}"


def _walk(candidates: DataFrame, hop: int, budget: int, across: int) -> DataFrame:
    """The outcome of each search's candidates, until its budget is spent. A search's rows pass in order through one
    task, which holds only what the search has taken."""
    order = ["search", "frontier", "place", "target_id", "relation"]
    dealt = candidates.repartition("search").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, now, n = None, None, 0
        for batch in batches:
            rows = []
            for c in batch.to_pylist():
                if c["search"] != name:
                    name, now, n = c["search"], _Search(budget, across, c["taken"], c["used"]), 0
                if now.full() or (said := now.judge(c)) is None:
                    continue
                n += 1
                rows.append((name, c["target_id"], hop, n, c["source_id"], c["relation"], c["score"] if said[0] else 0.0, *said, [*c["path"], c["target_id"]], c["crosses"] and not c["blocked"] and said[1] != "max_cross_domain_records" and c["gate"] is not None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate([*KINDS, pa.bool_()])], names=[*NAMES, "crossed"])

    return dealt.mapInArrow(run, f"{RESULT}, crossed boolean")


def _open_edges(edges: DataFrame, records: DataFrame, budget: int) -> DataFrame:
    """Edges that the whitelist lets through, with what is known of both ends, as far as any search can come.

    An edge whose target is visible and in its source's domain (or one of them is in all domains) is taken by every
    search, or its target has been. So after the edges to `budget` such targets, in the order in which a source's edges
    are walked, every search is full, and no later edge of that source is ever looked at."""
    of = records.select(F.col("id").alias("source_id"), F.col("type").alias("source_type"), F.col("domain").alias("source_domain"))
    to = records.select(F.col("id").alias("target_id"), F.col("type").alias("target_type"), F.col("domain").alias("target_domain"), "blocked")
    relations = {s: sorted({r for kind, _, rs in L.EDGE_WHITELIST if kind == s for r in rs}) for s, _, _ in L.EDGE_WHITELIST}
    asked = F.lit(False)
    for kind, own in relations.items():
        asked = asked | ((F.col("source_type") == kind) & F.col("relation").isin(own))
    typed = edges.join(of, "source_id").where(asked).join(to, "target_id").withColumn("place", relation_place(F.col("source_type"), F.col("relation")))
    sure = (F.coalesce("blocked", F.lit("")) == "") & ((F.col("source_domain") == F.col("target_domain")) | (F.col("source_domain") == "cross_arena") | (F.col("target_domain") == "cross_arena"))
    met = allowed_edges(typed.repartition("source_id"))
    # A target counts where it first comes, however many relations lead to it.
    first = F.row_number().over(Window.partitionBy("source_id", "target_id").orderBy("place", "relation")) == 1
    met = met.withColumn("_new", (sure & first).cast("int"))
    before = Window.partitionBy("source_id").orderBy("place", "target_id", "relation").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_sure", F.coalesce(F.sum("_new").over(before), F.lit(0)))
    return met.where(F.col("_sure") < budget).drop("_new", "_sure")


def _candidates(frontier: DataFrame, edges: DataFrame, coupled: DataFrame, hop: int) -> DataFrame:
    """Open edges from each search's frontier (search, id, frontier, score, path, areas, domains, fallback, taken, used),
    with the gate between their domains. `areas`: the areas of each pattern on the path."""
    met = frontier.withColumnRenamed("id", "source_id").join(edges, "source_id")
    met = met.join(coupled.select(F.col("a").alias("source_domain"), F.col("b").alias("target_domain"), F.lit(True).alias("coupled")), ["source_domain", "target_domain"], "left")
    bridged = F.exists("areas", lambda a: F.array_contains(a, F.col("source_domain")) & F.array_contains(a, F.col("target_domain")) & (F.size(a) > 1))
    gate = domain_gate(F.col("source_domain"), F.col("target_domain"), F.size("domains"), bridged, F.coalesce("coupled", F.lit(False)))
    domain = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("fallback"))
    crosses = (domain("source_domain") != domain("target_domain")) & (domain("source_domain") != "cross_arena") & (domain("target_domain") != "cross_arena")
    score = F.bround(F.greatest(F.lit(0.1), F.col("score") * 0.85 + relation_bonus(F.col("relation")) - 0.08 * hop), 3)
    return met.select("search", "frontier", "path", "areas", "taken", "used", "source_id", "source_type", "relation", "target_id", "target_type", "place", "blocked", gate.alias("gate"), F.coalesce(crosses, F.lit(False)).alias("crosses"), score.alias("score"))


def expand(seeds: DataFrame, records: DataFrame, edges: DataFrame, searches: DataFrame, coupled: DataFrame, budget: int = BUDGET, across: int = ACROSS, hops: int = HOPS) -> DataFrame:
    """What each search finds around its seeds (search, id, rank, score): RESULT, kept records and those kept out, in the
    order in which they were met (hop, place).

    records: id, type, domain, areas (a pattern's domains), blocked (why it is hidden, or null). edges: source_id,
    target_id, relation. searches: search, domains (those it names), fallback (its own domain). coupled: a, b, both
    ways. Frontiers are walked by rank, and edges by the relation's place in the source's type, then target. A search
    stops at `budget` records, lets at most `across` into another domain, and that only for a reason; a record that it
    has met as hidden or refused is not expanded from later. From the second hop on sources count with a score of 0.
    Repeated edges are one; a seed may be found too."""
    records = records.select("id", "type", F.coalesce("domain", F.lit("")).alias("domain"), F.when(F.col("type") == "pattern", F.array_distinct(F.filter(F.concat(F.coalesce("areas", F.array().cast("array<string>")), F.array("domain")), lambda a: F.coalesce(a, F.lit("")) != ""))).alias("areas"), "blocked")
    edges = edges.select("source_id", "target_id", F.coalesce("relation", F.lit("links")).alias("relation")).where("source_id <> '' AND target_id <> ''")
    edges = written(_open_edges(edges, records, budget))
    none = F.array().cast("array<string>")
    pattern = F.when(F.col("areas").isNotNull(), F.array("areas")).otherwise(F.array().cast("array<array<string>>"))
    frontier = seeds.join(records.select("id", pattern.alias("areas")), "id").join(searches, "search")
    frontier = frontier.select("search", "id", F.col("rank").alias("frontier"), "score", F.array("id").alias("path"), "areas", "domains", "fallback", none.alias("taken"), F.lit(0).alias("used"))
    found = None
    for hop in range(1, hops + 1):
        candidates = written(_candidates(frontier, edges, coupled, hop))
        met = written(_walk(candidates, hop, budget, across))
        found = met if found is None else found.unionByName(met)
        if hop == hops:
            break
        # What a search has taken, and the records it may go on from: not its seeds, nor what it met as kept out before.
        spent = found.groupBy("search").agg(F.array_distinct(F.collect_list(F.when(F.col("kept"), F.col("id")))).alias("taken"), F.count_if("crossed").cast("int").alias("used"))
        first = met.groupBy("search", "id").agg(F.min(F.when(F.col("kept"), F.col("place"))).alias("frontier"), F.min("place").alias("first_place"), F.min_by("path", F.when(F.col("kept"), F.col("place"))).alias("path"))
        onward = first.where("frontier = first_place").join(seeds.select("search", "id"), ["search", "id"], "left_anti").join(spent, "search").where(F.size("taken") < budget)
        own = records.select("id", pattern.alias("own_areas"))
        before = candidates.select("search", F.col("target_id").alias("id"), F.col("path").alias("before"), F.col("areas").alias("areas_before")).distinct()
        onward = onward.join(own, "id").join(before, (onward["search"] == before["search"]) & (onward["id"] == before["id"]) & (F.slice("path", 1, F.size("path") - 1) == F.col("before"))).select(onward["search"], onward["id"], "frontier", "path", F.concat("areas_before", "own_areas").alias("areas"), "taken", "used")
        frontier = onward.join(searches, "search").withColumn("score", F.lit(0.0)).select("search", "id", "frontier", "score", "path", "areas", "domains", "fallback", "taken", "used")
    return found.drop("crossed")


def path_text(path: Column) -> Column:
    """A path of records as text."""
    return F.array_join(path, " -> ")
