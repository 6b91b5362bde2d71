"""Reviews of claims and patterns, what keeps a pattern from being used, what is due for review, and the state of the
whole collection. Every operator takes records (and their side tables) as columns and a day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.functions import text as T

LEAST_SUPPORT, LEAST_CONFIDENCE, YOUNG_DAYS, YOUNG_DAYS_OF_PERSONS, BACKUP_DAYS = 3, 0.65, 7, 30, 30
NONE = "array<string>"


def day(value: Column) -> Column:
    """A date written as yyyy-mm-dd, null for anything else."""
    return F.try_to_date(F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value), "yyyy-MM-dd")


def age(created: Column, as_of: str) -> Column:
    """Whole days since, at least 0; null for no date."""
    days = F.datediff(F.lit(as_of).cast("date"), day(created))
    return F.when(days.isNotNull(), F.greatest(F.lit(0), days))


def pattern_status(status: Column) -> Column:
    """A pattern's status by its present name; unknown ones are candidates."""
    names = F.create_map(*(F.lit(x) for kv in L.FORMER_PATTERN_STATUSES.items() for x in kv))
    own = F.trim(F.coalesce(F.nullif(status, F.lit("")), F.lit("candidate")))
    return F.coalesce(F.try_element_at(names, own), F.when(own.isin(*L.PATTERN_STATUSES), own), F.lit("candidate"))


def hypothesis_tokens(text: Column) -> Column:
    """Distinct words of three letters or more that say something, in order of letters."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9_-]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*L.HYPOTHESIS_STOPWORDS))))


def too_broad(text: Column) -> Column:
    return T.contains_any(F.lower(F.coalesce(text, F.lit(""))), L.BROAD_MARKERS) | (F.size(hypothesis_tokens(text)) < 4)


def diagnostic(text: Column) -> Column:
    return T.contains_any(F.lower(F.coalesce(text, F.lit(""))), L.DIAGNOSTIC_TERMS)


def contradicted(patterns: DataFrame, records: DataFrame) -> DataFrame:
    """(id): patterns that a grave, open contradiction stands behind: a link, supporting record or counterexample is a
    contradiction, an unapproved review of high risk, or a disputed or rejected claim of confidence below one half."""
    grave = (F.col("type") == "contradiction_log") | ((F.col("type") == "skeptical_review") & (F.col("risk") == "high") & ~F.coalesce("approved", F.lit(False))) | ((F.col("type") == "claim") & F.col("status").isin("disputed", "rejected") & (F.coalesce("confidence", F.lit(0.0)) < 0.5))
    bad = records.where(grave).select(F.col("id").alias("linked")).distinct()
    every = F.concat(*(F.coalesce(c, F.array().cast(NONE)) for c in ("links", "supporting_records", "counterexamples")))
    return patterns.select("id", F.explode(F.array_distinct(every)).alias("linked")).join(bad, "linked").select("id").distinct()


def pattern_blockers(patterns: DataFrame, reviews: DataFrame, records: DataFrame, as_of: str) -> DataFrame:
    """patterns with blockers (codes, each once, in order) and eligible.

    patterns: id, status, pattern_type, created, confidence, links, supporting_records, counterexamples,
    alternative_explanations, searched, strength_override, override (struct of enabled, reason, approved_by; null for
    none). reviews: id, reviewed_record_id, approved_for_use; the last by id counts. records: id, type, status,
    confidence, risk, approved. Nulls count as missing or false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    listed = lambda c: F.size(F.coalesce(c, F.array().cast(NONE)))
    said = reviews.groupBy(F.col("reviewed_record_id").alias("id")).agg(F.max_by("approved_for_use", "id").alias("approved_for_use"))
    met = patterns.join(said, "id", "left").join(contradicted(patterns, records).withColumn("grave", F.lit(True)), "id", "left")
    status = pattern_status(F.col("status"))
    least = F.when(F.col("pattern_type").isin("identity_claim", "psychological_hypothesis"), YOUNG_DAYS_OF_PERSONS).otherwise(YOUNG_DAYS)
    days = age(F.col("created"), as_of)
    enabled, reason, by = yes(F.col("override.enabled")), F.trim(F.coalesce("override.reason", F.lit(""))), F.trim(F.coalesce("override.approved_by", F.lit("")))
    waived = enabled & (reason != "") & (by == "user")
    confidence = F.coalesce("confidence", F.lit(0.0))
    found = F.array_compact(F.array(
        F.when(~status.isin("skeptic_reviewed", "supported"), F.concat(F.lit("status="), status)),
        F.when(status.isin("disputed", "stale", "rejected", "retired", "integrated"), F.concat(F.lit("status_blocked="), status)),
        F.when(~yes(F.col("approved_for_use")), "review.approved=false"),
        F.when((listed("supporting_records") < LEAST_SUPPORT) & ~yes(F.col("strength_override")), f"supporting_records<{LEAST_SUPPORT}"),
        F.when(~yes(F.col("searched")), "counterexample_search.performed=false"),
        F.when(listed("alternative_explanations") < 1, "missing_alternative_explanations"),
        F.when(confidence < LEAST_CONFIDENCE, f"confidence<{LEAST_CONFIDENCE}"),
        F.when(days.isNull(), "missing_created_date").when((days < least) & ~waived, F.concat(F.lit("age<"), least.cast("string"), F.lit("d"))),
        F.when(status.isin("stale", "rejected", "retired", "disputed"), F.concat(F.lit("blocked_status="), status)),
        F.when(yes(F.col("grave")), "unresolved_high_severity_contradiction"),
        F.when(enabled & (reason == ""), "integration_override.reason_missing"),
        F.when(enabled & (by != "user"), "integration_override.approved_by!=user"),
    ))
    return met.withColumn("blockers", found).select(*patterns.columns, "blockers").withColumn("eligible", F.size("blockers") == 0)


def judged_evidence(evidence: DataFrame) -> DataFrame:
    """evidence (claim_id, id, summary) with stated, whether its summary says that something was said, and denied."""
    low = F.lower(F.coalesce("summary", F.lit("")))
    return evidence.select("claim_id", "id", T.contains_any(low, L.STATED_WORDS).alias("stated"), T.contains_any(low, L.DENIED_WORDS).alias("denied"))


def review_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims (id, text) with supporting and contradicting (how many pieces of evidence; judged_evidence names them),
    errors, confidence, status and action, by the evidence (claim_id, id, summary) that was brought for each.

    From one half: evidence whose summary says that something was said adds 0.15, evidence that denies takes 0.15, a
    hostile reading takes 0.2, and so does having no evidence. A claim without text is one without words."""
    got = judged_evidence(evidence).groupBy(F.col("claim_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if("stated").alias("supporting"), F.count_if("denied").alias("contradicting"))
    own = claims.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("low")).join(got, "id", "left").na.fill(0, ["n", "supporting", "contradicting"])
    none = F.array().cast(NONE)
    hostile = T.contains_any(F.col("low"), L.HOSTILE_WORDS)
    errors = F.array_distinct(F.concat(T.reasoning_errors(F.col("low")), F.when(hostile, F.array(F.lit("mind_reading"))).otherwise(none), F.when(F.col("n") == 0, F.array(F.lit("insufficient_alternative_hypotheses"))).otherwise(none)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 0.15 * F.col("supporting") - 0.15 * F.col("contradicting") - F.when(hostile, 0.2).otherwise(0.0) - F.when(F.col("n") == 0, 0.2).otherwise(0.0)))
    held = own.select("id", "supporting", "contradicting", errors.alias("errors"), F.round(score, 6).alias("confidence"))
    against, for_ = F.col("contradicting") > 0, F.col("supporting") > 0
    status = F.when(against | (F.col("confidence") < 0.45), "disputed").when((F.col("confidence") >= 0.75) & for_, "confirmed").otherwise("active")
    action = F.when(F.col("confidence") < 0.35, "hold").when(against | ~for_, "revise").otherwise("approve")
    return held.withColumns({"status": status, "action": action})


def review_patterns(patterns: DataFrame) -> DataFrame:
    """patterns (id, hypothesis, supporting_records, counterexamples) with errors, confidence, status, approved and
    approved_for_use. Counterexamples that only say that there are none do not count."""
    none = F.array().cast(NONE)
    n = F.size(F.coalesce("supporting_records", none))
    real = F.size(F.filter(F.coalesce("counterexamples", none), lambda x: ~F.contains(F.lower(x), F.lit("none")) & ~F.contains(F.lower(x), F.lit("no explicit counterexamples"))))
    text = F.col("hypothesis")
    low, broad, sick = F.lower(F.coalesce(text, F.lit(""))), too_broad(text), diagnostic(text)
    errors = F.array_distinct(F.concat(T.reasoning_errors(low), F.when(T.contains_any(low, L.AVOIDING_WORDS), F.array(F.lit("insufficient_alternative_hypotheses"))).otherwise(none), F.when(sick, F.array(F.lit("pathologizing_language"))).otherwise(none)))
    score = 0.25 + F.least(F.lit(0.45), 0.13 * n) - F.when(n < 2, 0.12).otherwise(0.0) + F.when(real > 0, -0.12).when(n >= 3, 0.08).otherwise(0.0) - F.when(broad, 0.1).otherwise(0.0) - F.when(sick, 0.35).otherwise(0.0)
    held = patterns.select("id", errors.alias("errors"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("confidence"), n.alias("_n"), real.alias("_real"), (broad | sick).alias("_held"))
    approved = (F.col("confidence") >= 0.55) & (F.col("_n") >= 2) & ~F.col("_held")
    status = F.when((F.col("_n") >= 3) & (F.col("confidence") >= 0.75) & (F.col("_real") == 0), "supported").when(approved, "skeptic_reviewed").when((F.col("_real") > 0) | (F.col("confidence") < 0.45), "disputed").when(F.col("_n") == 0, "candidate").otherwise("active_hypothesis")
    return held.withColumns({"status": status, "approved": approved, "approved_for_use": approved & (F.col("_n") >= 3) & (F.col("confidence") >= 0.65)}).drop("_n", "_real", "_held")


def _due(as_of: str) -> Column:
    """Whether a review is due: no day is named, or it has come. A day that is none is never due."""
    given = F.coalesce("review_after", F.lit(""))
    return (given == "") | F.coalesce(day(F.col("review_after")) <= F.lit(as_of).cast("date"), F.lit(False))


def stale(files: DataFrame, as_of: str) -> DataFrame:
    """States older than the days that they hold."""
    return files.where((F.col("type") == "state") & (F.coalesce("ttl_days", F.lit(0)) > 0) & (F.datediff(F.lit(as_of).cast("date"), day(F.col("updated"))) > F.col("ttl_days")))


def review_items(files: DataFrame, claims: DataFrame, confirmations: DataFrame, conversations: DataFrame, backups: DataFrame, as_of: str) -> DataFrame:
    """(category, id, summary, due) of all that waits for somebody, from eight sources.

    files: id, type, path, status, summary, updated, review_after, ttl_days, task_status. claims: id, claim_type,
    claim_text, status, review_after. confirmations: id, task_id, status, resolution, expires. conversations: id,
    thread, turns, mode_status, updated. backups: at (days; no row is a missing backup)."""
    row = lambda category, summary, due: (F.lit(category).alias("category"), F.col("id").cast("string").alias("id"), summary.alias("summary"), due.alias("due"))
    or_now = F.coalesce(F.nullif("review_after", F.lit("")), F.lit("now"))
    text = F.coalesce("summary", F.lit(""))
    expired = confirmations.where("resolution = 'expired'").groupBy(F.col("task_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    blocked = files.where(F.col("task_status").isin("blocked", "expired")).join(expired, "id", "left")
    often = F.when(F.coalesce("n", F.lit(0)) >= 2, F.concat(F.lit("expired "), F.col("n").cast("string"), F.lit(" times; "))).otherwise("")
    draft = F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-2)), F.lit("")) == "drafts"
    last = backups.agg(F.max(day(F.col("at"))).alias("at")).withColumn("id", F.lit("backup"))
    old = F.col("at").isNull() | (F.datediff(F.lit(as_of).cast("date"), F.col("at")) > BACKUP_DAYS)
    parts = [
        stale(files, as_of).select(*row("state", text, F.coalesce(F.nullif("review_after", F.lit("")), F.col("updated")))),
        files.where((F.col("type") == "open_loop") & (F.col("status") == "active") & _due(as_of)).select(*row("open_loop", text, or_now)),
        claims.where(F.col("status").isin("unresolved", "disputed") & _due(as_of)).select(*row("claim", F.concat_ws(" | ", "claim_type", "claim_text"), or_now)),
        files.where(draft & F.col("status").isin("pending", "needs_revision") & _due(as_of)).select(*row("draft", text, or_now)),
        conversations.where((F.col("turns") > 0) & (F.coalesce("mode_status", F.lit("")) != "closed")).select(*row("conversation", F.concat(F.coalesce("thread", F.lit("Active conversation")), F.lit(" ("), F.col("turns").cast("string"), F.lit(" turns)")), F.coalesce("updated", F.lit("")))),
        last.where(old).select(*row("backup", F.when(F.col("at").isNull(), "no backup").otherwise("old backup"), F.coalesce(F.col("at").cast("string"), F.lit("now")))),
        confirmations.where("status = 'pending' AND resolution IS NULL").select(*row("pending confirmation", F.concat(F.lit("awaits approval for "), F.coalesce("task_id", F.lit(""))), F.coalesce("expires", F.lit("")))),
        blocked.select(*row("blocked task", F.concat(often, F.lit("task_status="), F.col("task_status"), F.lit(": "), text), F.lit(""))),
    ]
    return reduce(DataFrame.unionByName, parts)


def health_sections(files: DataFrame, claims: DataFrame, calls: DataFrame, tables: dict[str, DataFrame], vectors: DataFrame, backups: DataFrame, as_of: str) -> DataFrame:
    """(section, item, value) of the report on the whole collection, eleven sections; only the last may be missing.

    files: as in review_items, with created and last_confirmed. claims: with created. calls: id, at, success. tables are
    counted under their names. vectors: id. Items are ids; sums have the item "total"."""
    today = F.lit(as_of).cast("date")
    before = lambda c, days: F.coalesce(c, F.lit("")) < F.date_format(F.date_sub(today, days), "yyyy-MM-dd")
    row = lambda df, section, value: df.select(F.lit(section).alias("section"), F.col("id").cast("string").alias("item"), value.cast("string").alias("value"))
    total = lambda df, section, item="total", condition=None: df.agg((F.count(F.lit(1)) if condition is None else F.count_if(condition)).alias("n")).select(F.lit(section).alias("section"), F.lit(item).alias("item"), F.col("n").cast("string").alias("value"))
    loops = files.where("type = 'open_loop' AND status = 'active'")
    stuck = ((F.col("status") == "unresolved") & before(F.col("created"), 90)) | (F.col("status") == "disputed") | ((F.col("status") == "hypothesis") & before(F.col("created"), 180))
    faded = (F.col("type") == "entity") & (F.col("status") == "active") & before(F.col("last_confirmed"), 365)
    drafts = files.where(F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-2)), F.lit("")) == "drafts")
    failed = calls.where("NOT success").orderBy(F.desc("at"), "id").limit(5)
    parts = [
        row(stale(files, as_of), "stale domains", F.datediff(today, day(F.col("updated")))),
        row(loops, "open loops", F.coalesce(day(F.col("review_after")) < today, F.lit(False))),
        row(files.where("type = 'contradiction_log'"), "contradictions", F.coalesce(F.datediff(today, day(F.col("created"))) > 90, F.lit(False))),
        row(claims.where(stuck), "claims", F.col("status")),
        row(files.where(faded), "entity decay", F.coalesce("last_confirmed", F.lit(""))),
        total(files.where("status = 'active'").limit(200), "manifest"),
        backups.agg(F.max(day(F.col("at"))).alias("at")).select(F.lit("backup").alias("section"), F.lit("days").alias("item"), F.coalesce(F.datediff(today, F.col("at")).cast("string"), F.lit("missing")).alias("value")),
        total(calls, "calls"), row(failed, "calls", F.col("at")),
        *(total(df, "index", name) for name, df in tables.items()),
        total(vectors, "embeddings", "vectors"), total(files.join(vectors.select("id").distinct(), "id", "left_anti"), "embeddings", "pending"),
        total(drafts, "drafts"), total(drafts, "drafts", "blocked", F.contains("path", F.lit("skeptic_blocked")) | F.contains("path", F.lit("needs_revision"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def due_now(items: DataFrame, as_of: str) -> DataFrame:
    """Review items that are due, in order."""
    return items.where((F.col("due") == "now") | (F.coalesce(day(F.col("due")), F.lit("9999-12-31").cast("date")) <= F.lit(as_of).cast("date"))).orderBy("category", "due", "id")
