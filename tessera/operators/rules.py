"""Rules over records, jobs and texts as Column expressions and small joins; every one takes its inputs as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.functions import text as T
from tessera.session import pieces, written

# Types that a quarantined batch or artifact hides; standing of a status; order of relations by type.
DEPENDENT = ["evidence", "claim", "pattern", "skeptical_review", "episode", "decision", "open_loop", "state", "report"]
STATUS_POINTS = {"active": 0.5, "confirmed": 0.2, "disputed": 0.2, "superseded": -1.5, "rejected": -1.5, "stale": -1.5, "retired": -1.5}
RELATION_ORDER = {
    "artifact": ["linked_evidence", "linked_claims", "artifact_provenance", "links"],
    "evidence": ["linked_claims", "linked_episodes", "links"],
    "claim": ["supporting_evidence", "contradicting_evidence", "linked_patterns", "links"],
    "pattern": ["supporting_records", "counterexamples", "links"],
    "episode": ["entities", "evidence", "claims", "links"],
}


def looked_up(table: dict[str, float | int], key: Column, default: float | int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))


def type_boost(kind: Column) -> Column:
    return looked_up(L.TYPE_BOOST, kind, 0.0)


def quarantined_artifacts(records: DataFrame, batches: DataFrame) -> DataFrame:
    """Ids of artifacts that are quarantined themselves or by their batch (batches: batch_id)."""
    by_batch = batches.select("batch_id").distinct().withColumn("_held", F.lit(True))
    found = records.where("type = 'artifact'").join(by_batch, "batch_id", "left")
    return found.where(F.col("_held") | (F.coalesce("status", F.lit("")) == "quarantined")).select("id").distinct()


def visibility(records: DataFrame, batches: DataFrame) -> DataFrame:
    """records with blocked: "quarantined" for artifacts in quarantine, and for dependent records of a batch or of
    an artifact in it; null for what is visible. No record is lost or doubled."""
    held = batches.select("batch_id").distinct().withColumn("_batch", F.lit(True))
    artifacts = quarantined_artifacts(records, batches)
    met = records.join(held, "batch_id", "left").join(artifacts.withColumn("_own", F.lit(True)), "id", "left")
    met = met.join(artifacts.select(F.col("id").alias("artifact_ref"), F.lit(True).alias("_ref")), "artifact_ref", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    blocked = ((F.col("type") == "artifact") & yes("_own")) | (F.col("type").isin(DEPENDENT) & (yes("_batch") | yes("_ref")))
    return met.withColumn("blocked", F.when(blocked, "quarantined")).drop("_batch", "_own", "_ref")


def metadata_score(kind: Column, domain: Column, asked_domain: Column, age: Column, haystack: Column, terms: Column, status: Column, significance: Column, confidence: Column, horizon: int = 365) -> Column:
    """The metadata lane's score: 2 for the search's domain or none, the type's boost, up to 1 for recency, 1.2 if a
    term stands in the haystack, and points for status, high significance and confidence. Nulls give no points."""
    none = lambda c: F.coalesce(c, F.lit(0.0))
    recent = F.when(age >= 0, F.greatest(F.lit(0.0), 1 - age / horizon))
    hit = F.exists(terms, lambda t: F.contains(haystack, t))
    return F.when((domain == asked_domain) | (domain == "cross_arena"), 2.0).otherwise(0.0) + type_boost(kind) + none(recent) + F.when(hit, 1.2).otherwise(0.0) + looked_up(STATUS_POINTS, status, 0.0) + F.when(significance == "high", 0.7).otherwise(0.0) + none(confidence * 0.3)


def relation_place(kind: Column, relation: Column) -> Column:
    """The place of a relation among those of its source's type; 99 for others."""
    places = {f"{k} {r}": i for k, relations in RELATION_ORDER.items() for i, r in enumerate(relations)} | {f"{k} links": 0 for k in ("entity", "decision", "open_loop")}
    return looked_up(places, F.concat_ws(" ", kind, relation), 99)


def domain_gate(source: Column, target: Column, n_asked: Column, bridged: Column, coupled: Column) -> Column:
    """Why an expansion from one domain into another is allowed; null if it is not."""
    same = (F.coalesce(source, F.lit("")) == "") | (F.coalesce(target, F.lit("")) == "") | (source == target) | (source == "cross_arena") | (target == "cross_arena")
    return F.when(same, "same_domain").when(n_asked > 1, "several_domains_asked").when(bridged, "bridging_pattern").when(coupled, "coupled_domains")


def demote_neighbours(items: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """items (keys, id, rank, n_lanes) without those that a kept item before them links to, unless three lanes or
    more have them. Runs over the few items of a search one after another, so links are first cut to them."""
    inner = items.alias("a").join(links.alias("l"), F.col("a.id") == F.col("l.source")).join(items.alias("b"), [F.col("l.target") == F.col("b.id"), *(F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys)])
    inner = inner.where(F.col("a.rank") < F.col("b.rank")).groupBy(*(F.col(f"b.{k}").alias(k) for k in keys), F.col("b.id").alias("id")).agg(F.collect_set("a.id").alias("linkers"))
    rows = items.join(inner, [*keys, "id"], "left").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "n_lanes", F.coalesce("linkers", F.array().cast("array<string>")).alias("linkers")))).alias("rows"))
    keep = lambda kept, x: F.when((x["n_lanes"] >= 3) | ~F.arrays_overlap(x["linkers"], kept), F.concat(kept, F.array(x["id"]))).otherwise(kept)
    kept = rows.select(*keys, F.explode(F.aggregate("rows", F.array().cast("array<string>"), keep)).alias("id"))
    return items.join(kept, [*keys, "id"], "left_semi")


def failure_fingerprint(job_type: Column, error: Column, most: int = 80) -> Column:
    """One name for all instances of a failure: the job's type and its error without ids and numbers."""
    text = F.regexp_replace(F.lower(F.coalesce(error, F.lit(""))), r"job\.[0-9t]+\.[0-9a-f]+", "")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]+", ""), "[^a-z]+", "-"), "^-+|-+$", "")
    name = F.replace(job_type, F.lit("."), F.lit("-"))
    return F.regexp_replace(F.substring(F.concat(name, F.lit("-"), text), 1, most), "^-+|-+$", "")


def coalesce_key(job_type: Column, path: Column, record: Column, vault: Column) -> Column:
    """Jobs with one key are one job: a scan by path, work on a record by it, maintenance by vault; others never."""
    named = lambda label, value: F.concat(job_type, F.lit(f"|{label}="), value)
    or_all = lambda label, value: F.coalesce(named(label, F.when(F.trim(value) != "", F.trim(value))), F.concat(job_type, F.lit("|global")))
    return F.when(job_type == "ingest.scan_path", or_all("path", path)).when(F.startswith(job_type, F.lit("ingest.")), or_all("record", record)).when(F.startswith(job_type, F.lit("index.")), or_all("vault", vault))


def merged_payload(jobs: DataFrame, key: str) -> DataFrame:
    """One job a key: fields of all payloads (map<string,string>), later ones over earlier ones by created_at, id."""
    fields = jobs.select(key, "created_at", "id", F.explode("payload").alias("field", "value"))
    last = fields.groupBy(key, "field").agg(F.max_by("value", F.struct("created_at", "id")).alias("value"))
    merged = last.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("payload"))
    return jobs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("priority").alias("priority")).join(merged, key, "left")


def archived(status: Column, age: Column, days: int = 14) -> Column:
    """Failed and canceled jobs of more than so many days are archived; what runs or waits never is."""
    return F.when(status.isin("failed", "canceled") & (age > days), "archived").otherwise(status)


def fence_lines(lines: Column) -> Column:
    """How many lines stand in a block between fences; an opening fence counts, a closing one does not."""
    state = F.aggregate(lines, F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n")), lambda s, line: _stepped(s, F.startswith(F.trim(line), F.lit("```"))))
    return state["n"]


def _stepped(state: Column, fence: Column) -> Column:
    inside = F.when(fence, ~state["inside"]).otherwise(state["inside"])
    return F.struct(inside.alias("inside"), (state["n"] + inside.cast("int")).alias("n"))


def merged_sections(sections: DataFrame, keys: list[str], order: str, words: str, least: int) -> DataFrame:
    """sections with group: short ones go to the next that has `least` words, those at the end to the last section."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn("group", F.coalesce(F.sum((F.col(words) >= least).cast("long")).over(before), F.lit(0)))


def first_short_line(text: Column, most: int = 180) -> Column:
    """The first line of at most so many characters that is not blank; where all are longer, the first one's start."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.get(F.filter(lines, lambda x: F.length(x) <= most), F.lit(0)), F.substring(F.get(lines, F.lit(0)), 1, most))


def sentence_count(text: Column) -> Column:
    """Sentences between marks that white space or the end follows; one at least."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"[.!?]+(\s|$)"), lambda x: F.trim(x) != ""))).cast("long")


def normalized(text: Column) -> Column:
    """Lower case, hyphens and underscores as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "-_", "  "), r"\s+", " "))


def deixis(text: Column, person: str, assistant: str) -> Column:
    """Role tokens in double braces as the names of whom they stand for."""
    return F.regexp_replace(F.regexp_replace(text, r"\{\{\s*(?:principal|user)\s*\}\}", person), r"\{\{\s*self\s*\}\}", assistant)


def clock(seconds: Column) -> Column:
    """Seconds as h:mm:ss, or m:ss under an hour."""
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes, rest = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    return F.when(hours > 0, F.concat_ws(":", hours.cast("string"), part(minutes), part(rest))).otherwise(F.concat_ws(":", minutes.cast("string"), part(rest)))


def minimum_age(pattern_type: Column) -> Column:
    return F.when(pattern_type.isin("identity_claim", "psychological_hypothesis"), 30).otherwise(7)


def blended(turns: DataFrame, conversation: str, turn: str, role: str, text: str, short: int = 5, least_reply: int = 6, most_reply: int = 600) -> DataFrame:
    """Searches of user turns: asked (a short one with the up to three turns before it), for_domain (always with
    them), and reply: the start of the last of these that the assistant spoke at length, or null."""
    over = Window.partitionBy(conversation).orderBy(turn).rowsBetween(-3, -1)
    before = turns.withColumns({"_before": F.collect_list(F.struct(turn, role, text)).over(over), "_n": F.size(T.split_words(F.coalesce(text, F.lit(""))))}).where(F.col(role) == "user")
    texts = F.array_join(F.transform("_before", lambda x: x[text]), " ")
    both = F.when(F.size("_before") > 0, F.concat_ws(" ", F.col(text), texts)).otherwise(F.col(text))
    long = F.filter("_before", lambda x: (x[role] == "assistant") & (F.size(T.split_words(F.coalesce(x[text], F.lit("")))) >= least_reply))
    reply = F.when(F.size(long) > 0, F.substring(F.trim(F.get(long, F.size(long) - 1)[text]), 1, most_reply))
    return before.select(conversation, turn, F.when(F.col("_n") < short, both).otherwise(F.col(text)).alias("asked"), both.alias("for_domain"), reply.alias("reply"))


def first_holder(quotes: DataFrame, turns: DataFrame, quote_id: str, quote: str, turn_key: list[str], text: str, shingle: int = 3) -> DataFrame:
    """(quote_id, turn_key): the first turn that holds each quote as whole words, in lower case with single spaces.

    Turns are stored once, numbered by their key. A quote is a run of words, so it meets the first turn of that run only,
    however many have it. Runs of fewer words than `shingle` are all dealt out, longer ones only where a hash of their first
    words is that of a quote: of every place in a turn a number goes out, not its words. Blank quotes are held by none."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    start = lambda i: F.xxhash64(F.slice("_w", i, shingle))
    run = lambda i, n: F.array_join(F.slice("_w", i, n), " ")
    starts = lambda n: F.sequence(F.lit(1), F.size("_w") - n + 1)
    wanted = quotes.select(quote_id, plain(F.col(quote)).alias("_q")).where("_q <> ''")
    sized = wanted.select("_q").distinct().withColumn("_w", F.split("_q", " ")).withColumn("_n", F.size("_w"))
    ordered = turns.select(*turn_key, text).repartitionByRange(pieces(turns), *turn_key).sortWithinPartitions(*turn_key)
    stored = written(ordered.select(*turn_key, plain(F.col(text)).alias("_t"), F.monotonically_increasing_id().alias("_at")))
    said = stored.select("_at", "_t")
    held = said.select("_at", F.split("_t", " ").alias("_w"))
    few = F.broadcast(sized.where(F.col("_n") < shingle).select("_n").distinct())
    short = held.crossJoin(few).where(F.size("_w") >= F.col("_n")).select("_at", F.explode(F.array_distinct(F.transform(starts(F.col("_n")), lambda i: run(i, F.col("_n"))))).alias("_q"))
    heads = sized.where(F.col("_n") >= shingle).groupBy(start(1).alias("_k")).agg(F.collect_set("_n").alias("_ns"))
    places = held.where(F.size("_w") >= shingle).select("_at", F.posexplode(F.transform(starts(shingle), start)).alias("_i", "_k"))
    # Places of equal hashes may have other words, and a text may end before the quote does: equal runs decide.
    fit = F.filter("_ns", lambda n: F.col("_i") + n <= F.size("_w"))
    long = places.join(heads, "_k").drop("_k").join(said, "_at").withColumn("_w", F.split("_t", " ")).select("_at", F.explode(F.transform(fit, lambda n: run(F.col("_i") + 1, n))).alias("_q"))
    first = [x.groupBy("_q").agg(F.min("_at").alias("_at")).join(sized.select("_q"), "_q") for x in (short, long)]
    found = first[0].unionByName(first[1]).join(stored.select("_at", F.struct(*turn_key).alias("_key")), "_at")
    return wanted.join(found, "_q").groupBy(quote_id).agg(F.min_by("_key", "_at").alias("first")).select(quote_id, "first.*")
