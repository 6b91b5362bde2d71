"""Links in texts, decisions and loops, logs that spill, gates for tasks, and reviews of many sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lexicons as L

# What each kind of task needs; verdicts, the most
# restrictive last.
CAPABILITIES = {
    "run_script": ["run_local_scripts", "read_files", "write_files"],
    "research": ["web_research", "write_files"],
    "collect": ["read_files", "write_files"],
    "draft": ["read_files", "write_files"],
    "notify": ["send_outbound_message"],
}
VERDICTS = ["allow", "notify", "confirm", "deny"]


def first_of_each(values: Column, by=lambda x: x) -> Column:
    """The values of an array, each once, by what `by` makes of it, in the order of their first places."""
    keys = F.transform(values, by)
    return F.filter(values, lambda x, i: F.array_position(keys, by(x)) == i + 1)


def merged_links(*sources: Column) -> Column:
    """One list of links: trimmed, without blanks and nulls, each once, in order."""
    every = F.transform(F.flatten(F.array(*(F.coalesce(s, F.array().cast("array<string>")) for s in sources))), lambda x: F.trim(x))
    return first_of_each(F.filter(every, lambda x: x != ""))


def without_wikilinks(text: Column) -> Column:
    """Prose for [[links]]: their alias or their target; embedded ones go."""
    out = F.regexp_replace(text, r"!\[\[[^\]]*\]\]", "")
    out = F.regexp_replace(out, r"\[\[[^\]|#]+(?:#[^\]|]*)?\|([^\]]+)\]\]", "$1")
    return F.regexp_replace(out, r"\[\[([^\]|#]+)(?:#[^\]|]*)?\]\]", "$1")


def wikilink_targets(text: Column) -> Column:
    """Targets of [[links]], embedded ones left out, each once in any case of letters."""
    found = F.regexp_extract_all(F.regexp_replace(text, r"!\[\[[^\]]*\]\]", ""), F.lit(r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]+)?\]\]"), F.lit(1))
    return first_of_each(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""), F.lower)


def feed_entries(feeds: DataFrame, xml: str) -> DataFrame:
    """(id, title, summary, published, authors) of the entries of Atom feeds, whatever prefix their names have; missing
    fields are null, so one entry's lack touches no other. A feed that is no XML gives what entries it has; a null feed
    has none."""

    def plain(c: Column) -> Column:
        for name, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            c = F.replace(c, F.lit(name), F.lit(letter))
        return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))

    tag = lambda name: rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}>"
    entries = feeds.select(F.explode(F.regexp_extract_all(xml, F.lit(tag("entry")), F.lit(1))).alias("entry"))
    field = lambda name: plain(F.regexp_extract("entry", tag(name), 1)).alias(name)
    authors = F.filter(F.transform(F.regexp_extract_all("entry", F.lit(tag("name")), F.lit(1)), plain), lambda x: x.isNotNull())
    return entries.select(field("id"), field("title"), field("summary"), field("published"), authors.alias("authors"))


def subject_tokens(text: Column) -> Column:
    """Distinct lightly stemmed words of three letters or more that may name a decision's subject."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9_-]+"), F.lit(0))
    stems = F.transform(words, lambda w: F.coalesce(*(F.when(F.endswith(w, F.lit(s)) & (F.length(w) > len(s) + 2), F.substr(w, F.lit(1), F.length(w) - len(s))) for s in ("ing", "ed", "es", "s")), w))
    return F.array_sort(F.array_distinct(F.filter(stems, lambda w: (F.length(w) > 2) & ~w.isin(L.DECISION_STOPWORDS))))


def related_decisions(asked: DataFrame, decisions: DataFrame, least: int = 2, most: int = 3) -> DataFrame:
    """(asked, id, shared): for each asked decision (asked, tokens) the `most` others (id, tokens) that share at
    least so many tokens with it, by how many, then id. Equal token sets are one, with their `most` + 1 least ids,
    so that no more pairs meet than there are different subjects."""
    first = Window.partitionBy("tokens").orderBy("id")
    kept = decisions.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most + 1).groupBy("tokens").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    sets = asked.select(F.col("tokens").alias("q")).distinct()
    met = sets.select("q", F.explode("q").alias("token")).join(kept.select("ids", F.explode("tokens").alias("token")), "token")
    met = met.groupBy("q", "ids").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    rows = asked.join(met.select(F.col("q").alias("tokens"), "ids", "shared"), "tokens").select("asked", "shared", F.explode("ids").alias("id")).where("asked <> id")
    order = Window.partitionBy("asked").orderBy(F.desc("shared"), F.asc("id"))
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("asked", "id", "shared")


def spilled(log: DataFrame, keys: list[str], order: list[str], folded: str, keep: int) -> DataFrame:
    """log with spilled: whether an entry leaves a log that keeps its last `keep` ones. Only entries that are folded,
    up to the first one that is not, may leave."""
    own = Window.partitionBy(*keys).orderBy(*order)
    rows = log.withColumns({"_at": F.row_number().over(own), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys)), "_open": F.sum((~F.coalesce(F.col(folded), F.lit(False))).cast("int")).over(own)})
    return rows.withColumn("spilled", (F.col("_at") <= F.col("_n") - keep) & (F.col("_open") == 0)).drop("_at", "_n", "_open")


def task_verdicts(tasks: DataFrame, delegations: DataFrame) -> DataFrame:
    """tasks (task, kind, scope, blocked scopes) with verdict and rule. Unknown or no kind, and a scope that the task
    itself blocks, are denied; no scope is only reported. Else each capability that the kind needs has the verdict
    of delegations (scope, capability, verdict), "confirm" where there is none, and the most restrictive holds."""
    needs = [(k, c) for k, cs in CAPABILITIES.items() for c in cs]
    kinds = tasks.sparkSession.createDataFrame(needs, "kind string, capability string")
    level = F.array_position(F.array(*map(F.lit, VERDICTS)), F.coalesce("verdict", F.lit("confirm")))
    met = tasks.select("task", "kind", "scope").join(F.broadcast(kinds), "kind").join(delegations, ["scope", "capability"], "left")
    worst = met.groupBy("task").agg(F.max(level).alias("level"))
    rule = F.when(F.coalesce("kind", F.lit("")) == "", "no_task_kind").when(~F.col("kind").isin(list(CAPABILITIES)), "unknown_task_kind").when(F.coalesce("scope", F.lit("")) == "", "no_scope").when(F.array_contains(F.coalesce("blocked", F.array().cast("array<string>")), F.col("scope")), "misfiled_task").otherwise("delegation")
    judged = tasks.withColumn("rule", rule).join(worst, "task", "left")
    verdict = F.when(F.col("rule") == "delegation", F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("level").cast("int"))).when(F.col("rule") == "no_scope", "report_only").otherwise("deny")
    return judged.select("task", "rule", verdict.alias("verdict"))


def priority_place(text: Column, priorities: list[str]) -> Column:
    """The place of the first priority that shares a word of four letters or more with the text; 1,000,000 if none."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9-]{3,}"), F.lit(0))
    own = [F.regexp_extract_all(F.lower(F.lit(p)), F.lit("[a-z0-9][a-z0-9-]{3,}"), F.lit(0)) for p in priorities]
    return F.coalesce(*(F.when(F.arrays_overlap(words, p), F.lit(i)) for i, p in enumerate(own)), F.lit(1_000_000))


def factual_question(text: Column) -> Column:
    """A question of at most two sentences without the asker in it."""
    low = F.lower(text)
    few = F.size(F.filter(F.split(text, r"[.!?\n]"), lambda s: F.trim(s) != "")) <= 2
    personal = F.contains(low, F.lit("i ")) | F.contains(low, F.lit("i'm")) | F.contains(low, F.lit("my ")) | F.contains(low, F.lit("me ")) | F.contains(low, F.lit("i've"))
    return few & F.contains(low, F.lit("?")) & ~personal


def discovered(records: DataFrame, templates: dict[str, list[str]], least: int = 2, most: int = 5) -> DataFrame:
    """(pattern_type, support, first ids): templates of which a term stands in the text of at least so many records
    (id, text), the first `most` in the order of the templates."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hit = F.array_compact(F.array(*(F.when(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)), F.struct(F.lit(i).alias("place"), F.lit(name).alias("name"))) for i, (name, terms) in enumerate(templates.items()))))
    found = records.select("id", F.explode(hit).alias("t")).groupBy("t.place", "t.name").agg(F.count_distinct("id").alias("support"), F.min("id").alias("first")).where(F.col("support") >= least)
    return found.orderBy("place").limit(most).select(F.col("name").alias("pattern_type"), "support", "first")
