"""What references to records mean, and where merged records live on."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import written

#: Longer references are prose.
LONGEST = 200
# Folders whose records can be referred to.
INDEXED = ["entities", "episodes", "knowledge", "evidence", "state", "decisions", "open_loops", "claims", "patterns", "reviews", "reports", "contradictions", "archive", "self", "schedules", "confirmations"]
#: Kinds of resolution that name a record.
RESOLVED = ["id", "merged", "path", "claim_text", "basename", "alias"]


def survivors(merges: DataFrame) -> DataFrame:
    """(id, survivor) of merges (id, into): the end of each chain, null where it runs into a circle.

    Pointers double: every round each looks twice as far, so chains of n merges take log2(n) rounds, and what then
    still points at a merged id is in a circle. Of several merges of one id the one with the least target counts;
    nulls, blanks and merges into oneself are none."""
    own = merges.where("id IS NOT NULL AND trim(into) <> '' AND trim(into) <> id").groupBy("id").agg(F.min(F.trim("into")).alias("survivor"))
    own = written(own)
    n = own.count()
    for _ in range(ceil(log2(n)) + 1 if n else 0):
        ahead = own.select(F.col("id").alias("survivor"), F.col("survivor").alias("next"))
        moved = written(own.join(ahead.hint("merge"), "survivor", "left").select("id", F.coalesce("next", "survivor").alias("survivor"), F.col("next").isNotNull().alias("moved")))
        own = moved.select("id", "survivor")
        if moved.where("moved").isEmpty():
            return own
    circles = own.join(own.select(F.col("id").alias("survivor"), F.lit(True).alias("circle")).hint("merge"), "survivor", "left")
    return circles.select("id", F.when(F.col("circle").isNull(), F.col("survivor")).alias("survivor"))


def alias_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", ""))


def is_prose(ref: Column) -> Column:
    """A sentence where a reference should be: long, of four words or more, a line of a list, or with a full stop."""
    spaces = F.length(ref) - F.length(F.replace(ref, F.lit(" "), F.lit("")))
    return (F.length(ref) > LONGEST) | (spaces >= 3) | (F.endswith(ref, F.lit(".")) & (spaces > 0)) | F.startswith(ref, F.lit("- "))


def _only(pairs: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, n_name): the id that a key leads to, and to how many it does."""
    return pairs.groupBy(F.col("key").alias(key)).agg(F.min("id").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))


def _met(asked: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """asked with the columns of table by a key, both sorted, whatever Spark takes their sizes for. Rows without the key,
    which meet nothing, are dealt out to all tasks."""
    dealt = asked.withColumn("_deal", F.when(F.col(key).isNull(), F.pmod(F.xxhash64("text"), F.lit(1 << 16)) + 1).otherwise(F.lit(0)))
    return dealt.join(table.withColumn("_deal", F.lit(0).cast("long")).hint("merge"), [key, "_deal"], "left").drop("_deal")


def resolve(refs: DataFrame, records: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """refs (ref, distinct) with kind and target, by records (id, path, type, names, claim_text, merged_into) and the
    paths of other files (path).

    In this order: an "id" (or "merged", with the survivor), a draft or a file that is no record ("unindexed"), a
    "path", prose that is word for word the text of one claim ("claim_text", else "prose"), the name of one file
    ("basename"), a name of one entity ("alias"). What names two is "unknown" and stays unresolved. Archived records
    have ids and paths, but no names. Nulls and blanks are unknown."""
    path = F.split("path", "/")
    own = records.where("trim(id) <> '' AND path IS NOT NULL").select(F.trim("id").alias("id"), "path", "type", "names", "claim_text", "merged_into", path[0].isin(*INDEXED).alias("indexed"), F.array_contains(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), "archive").alias("archived"), F.element_at(path, -1).alias("file"))
    nodes = own.where("indexed")
    ids = nodes.select("id").distinct()
    chains = survivors(nodes.select("id", F.col("merged_into").alias("into"))).join(ids.select(F.col("id").alias("survivor")).hint("merge"), "survivor", "left_semi")
    live = nodes.where("NOT archived")
    by_id = ids.join(chains.hint("merge"), "id", "left").select(F.col("id").alias("text"), F.col("id").alias("own_id"), "survivor")
    paths = own.select(F.col("path").alias("text"), F.when(F.col("indexed"), F.col("id")).alias("path_id"), F.lit(True).alias("is_file"))
    if files is not None:
        paths = paths.unionByName(files.select(F.col("path").alias("text"), F.lit(None).cast("string").alias("path_id"), F.lit(True).alias("is_file")))
    paths = paths.groupBy("text").agg(F.min("path_id").alias("path_id"), F.first("is_file").alias("is_file"))
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    claims = _only(live.where("trim(claim_text) <> ''").select(squeezed("claim_text").alias("key"), "id"), "claim_key", "claim_id")
    files_of = _only(live.select(F.col("file").alias("key"), "id"), "file_key", "file_id")
    names = live.where("type = 'entity'").select("id", F.explode("names").alias("name")).select("id", alias_key(F.col("name")).alias("key")).where("key <> ''").distinct()
    aliases = _only(names, "alias_key", "alias_id")
    text = F.trim(F.coalesce("ref", F.lit("")))
    base = F.element_at(F.split(text, "/"), -1)
    asked = refs.select("ref", text.alias("text"), is_prose(text).alias("prose"), F.when(is_prose(text), squeezed(text)).alias("claim_key"), F.when(F.endswith(base, F.lit(".md")), base).alias("file_key"), alias_key(F.regexp_replace(base, r"\.md$", "")).alias("alias_key"))
    met = asked
    for table, key in ((by_id, "text"), (paths, "text"), (claims, "claim_key"), (files_of, "file_key"), (aliases, "alias_key")):
        met = _met(met, table, key)
    one = lambda kind, n: F.when(F.col(f"n_{n}") == 1, F.struct(F.lit(kind).alias("kind"), F.col(n).alias("target"))).when(F.col(f"n_{n}") > 1, F.struct(F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("target")))
    fixed = lambda kind, target=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if target is None else F.col(target)).alias("target"))
    found = (
        F.when(F.col("text") == "", fixed("unknown"))
        .when(F.col("survivor").isNotNull(), fixed("merged", "survivor"))
        .when(F.col("own_id").isNotNull(), fixed("id", "own_id"))
        .when(F.col("path_id").isNotNull(), fixed("path", "path_id"))
        .when(F.col("is_file"), fixed("unindexed"))
        .when(F.col("prose"), F.when(F.col("n_claim_id") == 1, fixed("claim_text", "claim_id")).otherwise(fixed("prose")))
        .otherwise(F.coalesce(one("basename", "file_id"), one("alias", "alias_id"), fixed("unknown")))
    )
    return met.select("ref", found.alias("found")).select("ref", "found.kind", "found.target")


def canonical_lists(lists: DataFrame, records: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """lists (id, refs) with kept, the records that the references name, each once and in order, and dropped, the
    references that name none. Each reference is resolved once, however many lists have it."""
    places = lists.select("id", F.posexplode("refs").alias("at", "ref"))
    found = resolve(places.select("ref").distinct(), records, files).withColumnRenamed("ref", "asked")
    met = places.join(found.hint("merge"), F.col("ref").eqNullSafe(F.col("asked"))).select("id", "at", "ref", F.when(F.col("kind").isin(*RESOLVED), F.col("target")).alias("target"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "ref", "target")))
    got = met.groupBy("id").agg(ordered.alias("all"))
    got = got.select("id", F.array_distinct(F.transform(F.filter("all", lambda x: x["target"].isNotNull()), lambda x: x["target"])).alias("kept"), F.transform(F.filter("all", lambda x: x["target"].isNull()), lambda x: x["ref"]).alias("dropped"))
    none = F.array().cast("array<string>")
    return lists.join(got.hint("merge"), "id", "left").select("id", F.coalesce("kept", none).alias("kept"), F.coalesce("dropped", none).alias("dropped"))
