"""An index of records: a table of files and the side tables that follow from them, kept up by snapshots.

Every change of a record adds, under a new version, the rows that the record has in each table; a commit of the version
makes all of them visible at once. A path's newest committed version is the live one, so a record and its side rows
are replaced together, and a batch that is run again writes the same version again."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import heads as H
from tessera.functions import text as T
from tessera.functions.lexicons import REVIEWED_BY_PROFESSIONALS
from tessera.session import written
from tessera.sources.records import FENCE, refuse_shrinking

#: Fields of the head that become columns as they are (missing: empty), and those whose missing values stay null.
TEXTS = ["created", "updated", "status", "significance", "privacy", "confidence", "confidence_basis", "last_confirmed", "review_after", "summary", "source_type", "sensitivity", "reliability", "claim_class", "owner", "pattern_type", "hypothesis"]
NULLABLE = ["artifact_ref", "artifact_hash", "batch_id", "source_path", "file_name", "task_kind", "task_status", "next_run", "expires", "due"]
LISTS = ["links", "aliases", "compartments", "domain_secondary", "actors", "linked_evidence", "linked_claims", "linked_episodes", "linked_patterns", "supporting_evidence", "contradicting_evidence", "supporting_records", "counterexamples"]
OTHERS = ["id", "type", "domain_primary", "arena_primary", "arena_secondary", "arena", "scope", "disclosure", "claim_text", "canonical_name", "nickname", "reviewed_record_id", "corrects", "previous_epochs", "epoch", "epoch_started", "first_seen", "last_reviewed", "review_notes", "task_id", "resolution", "resolved_at", "resolved_by", "execution_steps"]
FIELDS = [*TEXTS, *NULLABLE, *LISTS, *OTHERS]
#: Lists that become edges of their own relation, and single targets that do.
LIST_EDGES = {"supporting_evidence": "supports", "contradicting_evidence": "contradicts", "linked_claims": "links_claim", "linked_episodes": "links_episode"}
SINGLE_EDGES = {"reviewed_record_id": "reviews", "corrects": "corrects"}
LINK = "source_id string, target_id string, relationship_type string"
TABLES = ["files", "links", "claims", "entity_aliases", "entity_epochs", "confirmations"]


def indexable(path: Column) -> Column:
    """Whether a file may be a record of the index: not in manifests or transcripts, and a draft only if it asks to be
    revised. path is relative to the folder of records."""
    parts = F.split(path, "/")
    parent, name = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")), F.element_at(parts, -1)
    return ~parent.isin("manifests", "transcripts") & ((parent != "drafts") | F.contains(name, F.lit("needs_revision")))


def _heads(files: DataFrame) -> DataFrame:
    """(path, raw, body, and every field of FIELDS as text) of files (path, raw) whose head is a JSON object with an
    id and a type."""
    head = F.when(F.col("raw").rlike(FENCE), F.regexp_extract("raw", FENCE, 1))
    parted = files.where(indexable(F.col("path"))).select("path", "raw", head.alias("head"), F.regexp_extract("raw", FENCE, 2).alias("body"))
    parted = parted.where(F.ltrim("head").startswith("{") & F.try_parse_json("head").isNotNull())
    fields = parted.select("path", "raw", "body", F.json_tuple("head", *FIELDS).alias(*FIELDS))
    return fields.where("coalesce(id, '') <> '' AND coalesce(type, '') <> ''")


def file_rows(files: DataFrame) -> DataFrame:
    """The row of each indexable file (path, raw); others have none. Null raw text is no record.

    Old names of domains are folded into the new ones, a claim's and a piece of evidence's missing fields get their
    defaults, a decision with a pending step is pending; `scope` is never taken from the domain."""
    own = _heads(files)
    kind = F.col("type")
    domain = F.coalesce("domain_primary", "arena_primary")
    default = {"evidence": {"source_type": "manual_note", "sensitivity": "low", "reliability": "medium"}, "claim": {"claim_class": "interpretation", "owner": "user", "status": "active", "confidence": "0.5"}}
    with_default = {c: F.coalesce(F.col(c), *(F.when(kind == k, F.lit(d[c])) for k, d in default.items() if c in d)) for c in TEXTS}
    with_default["confidence"] = F.coalesce(with_default["confidence"], F.when(kind == "evidence", F.coalesce("reliability", F.lit("medium"))))
    with_default["updated"] = F.coalesce("updated", F.when(kind.isin("evidence", "claim"), F.col("created")))
    first_domain = F.when(kind.isin("evidence", "claim"), F.coalesce(F.col("domain_primary"), F.col("arena"), F.col("arena_primary"), F.lit("cross_arena"))).otherwise(domain)
    pending = F.exists(F.coalesce(F.from_json("execution_steps", "array<struct<status: string>>"), F.array().cast("array<struct<status: string>>")), lambda s: F.coalesce(s["status"] == "pending", F.lit(False)))
    status = F.coalesce("task_status", F.when((kind == "decision") & pending, F.lit("pending")))
    words = T.word_count(F.col("raw"))
    return own.select(
        "id", "type", "path", *(H.text_of(e).alias(c) for c, e in with_default.items()), *(F.col(c) for c in NULLABLE if c != "task_status"), status.alias("task_status"),
        H.text_of(first_domain).alias("domain_primary"), H.listed(F.coalesce("domain_secondary", "arena_secondary")).alias("domain_secondary"), H.text_of(F.coalesce(F.col("arena"), first_domain)).alias("arena"),
        F.when(F.trim("scope") != "", F.lower(F.trim("scope"))).alias("scope"), F.coalesce("disclosure", F.lit("private")).alias("disclosure"),
        F.when(kind == "claim", F.expr("try_cast(coalesce(confidence, '0.5') AS double)")).alias("confidence_score"),
        *(H.listed(F.col(c)).alias(c) for c in LISTS if c != "domain_secondary"), *(F.col(c) for c in OTHERS if c not in ("id", "type", "domain_primary", "arena_primary", "arena_secondary", "arena", "scope", "disclosure", "execution_steps")),
        F.sha2("raw", 256).alias("content_hash"), words.alias("word_count"), T.token_estimate(F.col("raw")).alias("token_count_approx"), F.regexp_replace(F.concat(H.text_of(F.col("summary")), F.lit("\n\n"), "body"), r"^\s+|\s+$", "").alias("content"), "body",
    )


def link_rows(files: DataFrame) -> DataFrame:
    """(path, source_id, target_id, relationship_type) of file rows: `related` for links, an artifact's evidence and
    claims, the artifact of a piece of evidence or claim, and the relations of LIST_EDGES and SINGLE_EDGES."""
    edge = lambda source, target, relation: F.struct(source.alias("source_id"), target.alias("target_id"), F.lit(relation).alias("relationship_type"))
    of = lambda c, relation: F.transform(F.col(c), lambda x: edge(F.col("id"), x, relation))
    none = F.array().cast(f"array<struct<{LINK.replace(' string', ': string')}>>")
    lists = [of("links", "related"), *(F.when(F.col("type") == "artifact", of(c, c)).otherwise(none) for c in ("linked_evidence", "linked_claims"))]
    lists += [of(c, relation) for c, relation in LIST_EDGES.items()]
    given = lambda c: F.trim(H.text_of(F.col(c)))
    lists.append(F.when(F.col("type").isin("evidence", "claim") & (given("artifact_ref") != ""), F.array(edge(given("artifact_ref"), F.col("id"), "artifact_provenance"))).otherwise(none))
    lists += [F.when(given(c) != "", F.array(edge(F.col("id"), given(c), relation))).otherwise(none) for c, relation in SINGLE_EDGES.items()]
    return files.select("path", F.inline(F.concat(*lists)))


def claim_rows(files: DataFrame) -> DataFrame:
    """(path, place, id, episode_id, claim_text, claim_type, confidence, sensitivity, status, created): claim records,
    and the rows of the table under "## Claims" in episodes. Ragged rows and those without an id are no claims, nor
    are tables of fewer than three lines."""
    section = F.regexp_extract(F.concat(F.lit("\n"), "body"), r"(?s)\n[ \t]*## Claims[ \t]*\r?\n(.*?)(?=\n## |\z)", 1)
    lines = files.where("type = 'episode'").select("path", "id", F.filter(F.split(section, "\n"), lambda x: F.startswith(F.trim(x), F.lit("|"))).alias("lines")).where("size(lines) >= 3")
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.select("path", "id", cells(F.get("lines", F.lit(0))).alias("names"), F.posexplode(F.slice("lines", 3, F.size("lines"))).alias("place", "line"))
    rows = rows.select("path", "id", "place", F.transform("names", lambda n: F.lower(n)).alias("names"), cells(F.col("line")).alias("cells")).where("size(names) = size(cells) AND size(array_distinct(names)) = size(names)")
    rows = rows.select("path", "id", "place", F.map_from_arrays("names", "cells").alias("cell"))
    cell = lambda name, default=None: F.coalesce(F.when(F.col("cell")[name] != "", F.col("cell")[name]), F.lit(default))
    text = F.coalesce(F.col("cell")["claim"], F.lit(""))
    reviewed = F.when(T.contains_any(F.lower(text), REVIEWED_BY_PROFESSIONALS), "requires_professional_review")
    tabled = rows.where(cell("id").isNotNull()).select("path", F.col("place").cast("long").alias("place"), cell("id").alias("id"), F.col("id").alias("episode_id"), text.alias("claim_text"), cell("type", "reported").alias("claim_type"), cell("confidence", "low").alias("confidence"), reviewed.alias("sensitivity"), cell("status", "unresolved").alias("status"), cell("created", "").alias("created"))
    episode = F.coalesce(F.get(F.filter(F.concat("linked_episodes", F.when(F.size("linked_episodes") > 0, F.array().cast("array<string>")).otherwise(F.col("links"))), lambda x: F.trim(x) != ""), F.lit(0)), F.lit(""))
    either = lambda *c: F.coalesce(*(F.when(F.col(x) != "", F.col(x)) for x in c))
    own = files.where("type = 'claim'").select("path", F.lit(-1).cast("long").alias("place"), "id", F.trim(episode).alias("episode_id"), H.text_of(either("claim_text", "summary")).alias("claim_text"), F.coalesce(either("claim_class"), F.lit("interpretation")).alias("claim_type"), F.coalesce(either("confidence"), F.lit("0.5")).alias("confidence"), F.coalesce(either("sensitivity"), F.lit("low")).alias("sensitivity"), F.coalesce(either("status"), F.lit("active")).alias("status"), H.text_of(either("created", "first_seen")).alias("created"))
    return tabled.unionByName(own)


def alias_rows(files: DataFrame) -> DataFrame:
    """(path, entity_id, alias, context) of entities that are not in an archive: canonical name or id, nickname, aliases."""
    live = files.where("type = 'entity' AND NOT array_contains(slice(split(path, '/'), 1, greatest(size(split(path, '/')) - 1, 0)), 'archive')")
    entry = lambda alias, context: F.struct(F.trim(alias).alias("alias"), F.lit(context).cast("string").alias("context"))
    names = F.concat(F.array(entry(F.coalesce(F.when(F.trim("canonical_name") != "", F.col("canonical_name")), F.col("id")), None), entry(H.text_of(F.col("nickname")), "nickname")), F.transform("aliases", lambda a: entry(a, None)))
    return live.select("path", F.col("id").alias("entity_id"), F.inline(names)).where("alias <> ''")


def epoch_rows(files: DataFrame) -> DataFrame:
    """(path, entity_id, epoch, started, archived_path, summary): past epochs of an entity, and the one it is in."""
    live = files.where("type = 'entity' AND NOT array_contains(slice(split(path, '/'), 1, greatest(size(split(path, '/')) - 1, 0)), 'archive')")
    past = F.coalesce(F.from_json("previous_epochs", "array<struct<epoch: long, period: string, archived: string, summary: string>>"), F.array().cast("array<struct<epoch: long, period: string, archived: string, summary: string>>"))
    row = lambda epoch, started, path, summary: F.struct(F.coalesce(epoch, F.lit(0)).cast("long").alias("epoch"), H.text_of(started).alias("started"), path.cast("string").alias("archived_path"), H.text_of(summary).alias("summary"))
    begun = lambda p: F.regexp_replace(F.get(F.split(H.text_of(p["period"]), " to "), F.lit(0)), "YYYY-MM", "")
    former = F.transform(F.filter(past, lambda p: p.isNotNull()), lambda p: row(p["epoch"], F.coalesce(F.when(begun(p) != "", begun(p)), F.col("epoch_started")), H.text_of(p["archived"]), p["summary"]))
    now = F.array(row(F.expr("try_cast(epoch AS long)"), F.col("epoch_started"), F.lit(None), F.col("summary")))
    return live.select("path", F.col("id").alias("entity_id"), F.inline(F.concat(former, now)))


def confirmation_rows(files: DataFrame) -> DataFrame:
    """(path, id, task_id, status, created_at, expires, resolution, resolved_at, resolved_by) of confirmations."""
    return files.where("type = 'confirmation'").select("path", "id", H.text_of(F.col("task_id")).alias("task_id"), "status", F.col("created").alias("created_at"), H.text_of(F.col("expires")).alias("expires"), "resolution", "resolved_at", "resolved_by")


SIDES: dict[str, Callable[[DataFrame], DataFrame]] = {"links": link_rows, "claims": claim_rows, "entity_aliases": alias_rows, "entity_epochs": epoch_rows, "confirmations": confirmation_rows}


def winners(files: DataFrame) -> DataFrame:
    """The file rows that count: of files with one id the one with the last path."""
    return files.join(files.groupBy("id").agg(F.max("path").alias("path")), ["id", "path"], "left_semi")


def settled(table: str, rows: DataFrame) -> DataFrame:
    """Rows of winners as the table holds them: of claims with one id the last, of nicknames the first by path."""
    if table == "claims":
        return rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), F.struct("path", "place")).alias("row")).select("row.*").drop("place", "path")
    if table == "entity_aliases":
        named = rows.where("context IS NOT NULL").groupBy("alias", "context").agg(F.min_by("entity_id", F.struct("path", "entity_id")).alias("entity_id"))
        return rows.where("context IS NULL").select("alias", "context", "entity_id").unionByName(named)
    return rows if table == "files" else rows.drop("path")


def built(files: DataFrame) -> dict[str, DataFrame]:
    """All tables of the index of files (path, raw)."""
    rows = file_rows(files)
    # The side tables ask for heads, and for the bodies of episodes only: these are worked out once and stored.
    heads = rows.drop("content", "content_hash", "word_count", "token_count_approx").withColumn("body", F.when(F.col("type") == "episode", F.col("body")))
    own = winners(written(heads))
    return {"files": winners(rows)} | {name: settled(name, side(own)) for name, side in SIDES.items()}


class RecordIndex:
    """The index in a folder that all executors share. One writer at a time; readers see committed versions only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def commits(self) -> list[dict]:
        """Committed versions since the last full one, oldest first."""
        try:
            rows = self.spark.read.parquet(f"{self.root}/commits").select("version", "full", "source", "batch").orderBy("version").collect()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return []
        since = max((r.version for r in rows if r.full), default=0)
        return [r.asDict() for r in rows if r.version >= since]

    def _read(self, table: str, versions: list[int], schema: str | None = None) -> DataFrame:
        paths = [f"{self.root}/{table}/version={v}" for v in versions]
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*paths)

    def _live(self, versions: list[int]) -> DataFrame:
        """(path, version) of the paths that have a record in their newest version."""
        newest = self._read("paths", versions).groupBy("path").agg(F.max(F.struct("version", "live")).alias("last"))
        return newest.where("last.live").select("path", F.col("last.version").alias("version"))

    def _write(self, changes: DataFrame, version: int) -> None:
        """All tables' rows of changed paths (path, raw, removed), under a version that is not committed yet."""
        put = lambda name, df: df.write.mode("overwrite").parquet(f"{self.root}/{name}/version={version}")
        put("changed", changes)
        changed = self.spark.read.parquet(f"{self.root}/changed/version={version}")
        put("files", file_rows(changed.where("NOT removed").select("path", "raw")))
        files = self.spark.read.parquet(f"{self.root}/files/version={version}")
        for name, rows in SIDES.items():
            put(name, rows(files))
        put("paths", changed.select("path").join(files.select("path", F.lit(True).alias("live")), "path", "left").select("path", F.coalesce("live", F.lit(False)).alias("live")))

    def _commit(self, version: int, full: bool, source: str, batch: int) -> None:
        row = self.spark.createDataFrame([(full, source, batch)], "full boolean, source string, batch long")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/version={version}")

    def _guard(self, before: list[int], after: list[int], force: bool) -> None:
        if before and not force:
            refuse_shrinking(self._live(before).count(), self._live(after).count())

    def build(self, files: DataFrame, force: bool = False) -> int:
        """Index files (path, raw) anew; returns the version. Refused, unless forced, where it would leave nothing, or
        less than half, of an index of more than ten records."""
        before = [c["version"] for c in self.commits()]
        version = max(before, default=0) + 1
        self._write(files.select("path", "raw", F.lit(False).alias("removed")), version)
        self._guard(before, [version], force)
        self._commit(version, True, "build", version)
        return version

    def apply(self, changes: DataFrame, source: str = "changes", batch: int | None = None, force: bool = False) -> int | None:
        """Bring changes (path, raw, removed; optionally seq) in; returns the version, or none for a batch that this
        source has committed before. Of several changes of a path the one with the highest seq counts (without seq,
        a removal only if there is nothing else). A changed file that is no record any more counts as removed."""
        commits = self.commits()
        if batch is not None and any(c["source"] == source and c["batch"] == batch for c in commits):
            return None
        before = [c["version"] for c in commits]
        version = max(before, default=0) + 1
        order = F.struct(F.col("seq") if "seq" in changes.columns else F.lit(0), ~F.col("removed"), F.coalesce("raw", F.lit("")))
        own = changes.where("path IS NOT NULL").withColumn("removed", F.coalesce("removed", F.lit(False)))
        last = own.groupBy("path").agg(F.max_by(F.struct("raw", "removed"), order).alias("row")).select("path", "row.*")
        self._write(last, version)
        self._guard(before, [*before, version], force)
        self._commit(version, not before, source, version if batch is None else batch)
        return version

    def sink(self, source: str, force: bool = False) -> Callable[[DataFrame, int], None]:
        """For foreachBatch of a stream of changes: each batch is one version; a batch that a restart runs again is
        written once."""
        return lambda batch, number: self.apply(batch, source, number, force) and None

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table of the index as it is, or was at a version since the last full one."""
        versions = [c["version"] for c in self.commits() if version is None or c["version"] <= version]
        live = self._live(versions)
        own = winners(self._read("files", versions).join(live, ["path", "version"], "left_semi"))
        if name == "files":
            return own.drop("version")
        return settled(name, self._read(name, versions).join(own.select("path", "version"), ["path", "version"], "left_semi").drop("version"))

    def compact(self) -> int:
        """One full version of all that is live, so that readers need no others; returns it."""
        versions = [c["version"] for c in self.commits()]
        live = self._live(versions)
        raw = self._read("changed", versions).join(live, ["path", "version"], "left_semi").select("path", "raw")
        version = max(versions) + 1
        self._write(raw.withColumn("removed", F.lit(False)), version)
        self._commit(version, True, "compact", version)
        return version

    def _vectors(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/vectors")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def pending(self) -> DataFrame:
        """(id, content_hash, content) of live records whose content has no vector yet."""
        files, held = self.table("files").select("id", "content_hash", "content"), self._vectors()
        return files if held is None else files.join(held.select("id", "content_hash"), ["id", "content_hash"], "left_anti")

    def embed_pending(self, embed: Callable[[Column], Column]) -> int:
        """Give pending records vectors (embed: content to an array of doubles, null if it cannot); returns how many
        got one. Refused where fewer than half of the vectors of former runs are still there."""
        held = self._vectors()
        runs = self.spark.read.parquet(f"{self.root}/vector_runs") if held is not None else None
        promised = int(runs.agg(F.sum("n")).first()[0] or 0) if runs is not None else 0
        if held is not None:
            refuse_shrinking(promised, held.count())
        run = (0 if runs is None else runs.count()) + 1
        made = self.pending().select("id", "content_hash", embed(F.col("content")).alias("vector")).where("vector IS NOT NULL")
        made.write.mode("overwrite").parquet(f"{self.root}/vectors/run={run}")
        n = self.spark.read.parquet(f"{self.root}/vectors/run={run}").count()
        self.spark.createDataFrame([(n,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/vector_runs/run={run}")
        return n

    def vectors(self) -> DataFrame:
        """(id, vector) of live records."""
        return self._vectors().join(self.table("files").select("id", "content_hash"), ["id", "content_hash"]).select("id", "vector")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of tables."""
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()))


def folder_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, removed) between two listings (path, modified, length) of a folder: new, changed and vanished files."""
    both = now.select("path", F.struct("modified", "length").alias("now")).join(before.select("path", F.struct("modified", "length").alias("before")), "path", "full_outer")
    return both.where(~F.col("now").eqNullSafe(F.col("before"))).select("path", F.col("now").isNull().alias("removed"))

