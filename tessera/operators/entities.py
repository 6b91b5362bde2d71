"""Entities: which names lead to which of them, matching of proposed names, merging, edges and mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that only qualify a name, and what looks like a date in it.
QUALIFIERS = ["project", "plan", "event", "meeting", "dinner", "lunch", "coffee", "trip", "visit", "session", "work", "day", "party", "workday"]
DATES = r"\b(on\s+)?\d{4}-\d{2}-\d{2}\b|\b(spring|summer|fall|autumn|winter)\s+\d{4}\b"


def name_index(entities: DataFrame, id_column: str = "id", names: str = "names") -> DataFrame:
    """(key, id, kind): what each whole name, and each word of a name, leads to, in lower case.

    The first claim, by id, then by place in names, decides the entity and whether the key is a "full" name or a
    "token". It is "ambiguous" if another entity has it for a whole name, or, for a token, among its words. Null
    and blank names are left out."""
    named = entities.select(F.col(id_column).alias("id"), F.posexplode(names).alias("place", "name")).withColumn("name", F.lower(F.trim("name"))).where("name <> ''")
    words = named.select("id", "place", F.explode(F.split("name", r"\s+")).alias("key"), F.lit(1).alias("token"))
    claims = named.select("id", "place", F.col("name").alias("key"), F.lit(0).alias("token")).unionByName(words)
    # Per key and entity one row: the claims of a hot word are reduced before they meet.
    own = claims.groupBy("key", "id").agg(F.min(F.struct("place", "token")).alias("first"), F.min("token").alias("least"))
    found = own.groupBy("key").agg(F.min(F.struct("id", F.col("first.token").alias("token"))).alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("least") == 0).alias("whole"), F.min_by("least", "id").alias("mine"))
    others = F.col("whole") - (F.col("mine") == 0).cast("int")
    ambiguous = (others > 0) | ((F.col("first.token") == 1) & (F.col("n") > 1))
    return found.select("key", F.col("first.id").alias("id"), F.when(ambiguous, "ambiguous").when(F.col("first.token") == 1, "token").otherwise("full").alias("kind"))


def without_qualifiers(name: Column) -> Column:
    """A name in lower case without parentheses, dates, and qualifying words at its end."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), r"\([^)]*\)", " "), DATES, " ")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.trim(F.regexp_replace(bare, rf"(?:(?<= )(?:{'|'.join(QUALIFIERS)})\s*)+$", ""))


def match_names(proposals: DataFrame, index: DataFrame) -> DataFrame:
    """proposals (proposal, name) with id and stage of the entity that each folds into: a whole name ("full"), the
    name without qualifiers ("base"), its only word ("token", unless ambiguous), or two or more of its words that
    lead to one entity ("words", the one with most, then the least id). Others have null."""
    low = proposals.withColumns({"full": F.lower(F.trim("name")), "base": without_qualifiers(F.col("name"))})
    whole = index.where("kind = 'full'")
    by = lambda of, stage: whole.select(F.col("key").alias(of), F.col("id").alias(f"id_{stage}"))
    staged = low.join(by("full", "full"), "full", "left").join(by("base", "base"), "base", "left")
    words = low.select("proposal", F.explode(F.array_distinct(F.split("full", r"\s+"))).alias("key"), F.size(F.array_distinct(F.split("full", r"\s+"))).alias("n"))
    hits = words.join(index.where("kind <> 'ambiguous'"), "key").groupBy("proposal", "n", "id").agg(F.count(F.lit(1)).alias("shared"))
    hits = hits.where((F.col("n") == 1) | (F.col("shared") >= 2)).groupBy("proposal").agg(F.min(F.struct(F.negative("shared"), "id", "n")).alias("b"))
    staged = staged.join(hits, "proposal", "left")
    stage = F.when(F.col("id_full").isNotNull(), "full").when(F.col("id_base").isNotNull(), "base").when(F.col("b.n") == 1, "token").when(F.col("b.n") > 1, "words")
    return staged.select("proposal", "name", F.coalesce("id_full", "id_base", "b.id").alias("id"), stage.alias("stage"))


def merge_into(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """entities (id, names) after merges (absorbed, survivor): a survivor takes on the names of all that it absorbs,
    own ones first, then by absorbed id, each once; absorbed ones are archived and keep their names. Merges must
    not form chains."""
    taken = merges.join(entities.select(F.col("id").alias("absorbed"), F.col("names").alias("more")), "absorbed")
    taken = taken.groupBy(F.col("survivor").alias("id")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("absorbed", "more"))), lambda x: x["more"])).alias("more"))
    gone = merges.select(F.col("absorbed").alias("id"), F.lit(True).alias("gone")).distinct()
    met = entities.join(taken, "id", "left").join(gone, "id", "left")
    return met.select("id", F.array_distinct(F.concat("names", F.coalesce("more", F.array().cast("array<string>")))).alias("names"), F.when(F.col("gone"), "archived").otherwise("active").alias("status"))


def new_edges(stated: DataFrame, index: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (source_id, relation, target_id) of statements (source, relation, target) whose ends both lead to one
    entity each, that are not among edges yet."""
    usable = index.where("kind <> 'ambiguous'")
    end = lambda of: usable.select(F.col("key").alias(f"{of}_key"), F.col("id").alias(f"{of}_id"))
    met = stated.withColumns({"source_key": F.lower(F.trim("source")), "target_key": F.lower(F.trim("target"))}).join(end("source"), "source_key").join(end("target"), "target_key")
    return met.where("source_id <> target_id").select("source_id", "relation", "target_id").distinct().join(edges, ["source_id", "relation", "target_id"], "left_anti")


def mentions(texts: DataFrame, names: DataFrame, text_id: str, text: str = "text") -> DataFrame:
    """(text_id, id, n): how often names (id, name) stand in texts as whole words, in any case of letters. Words are
    runs of letters and digits; the words of a name stand in a row. Texts meet names by a name's first word."""
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    wanted = names.select("id", split(F.col("name")).alias("w")).where(F.size("w") > 0).distinct().select("id", "w", F.get("w", F.lit(0)).alias("word"))
    held = texts.select(text_id, split(F.coalesce(F.col(text), F.lit(""))).alias("_words")).select(text_id, "_words", F.posexplode("_words").alias("at", "word"))
    # Only the words from a hit on are needed: as many as the longest name has.
    longest = names.agg(F.coalesce(F.max(F.size(split(F.col("name")))), F.lit(1)).alias("n")).first()["n"]
    held = held.select(text_id, "word", F.slice("_words", F.col("at") + 1, F.lit(max(1, longest))).alias("ahead"))
    met = held.join(wanted, "word").where(F.slice("ahead", F.lit(1), F.size("w")) == F.col("w"))
    return met.groupBy(text_id, "id").agg(F.count(F.lit(1)).alias("n"))
