"""Whether a proposed name is an entity that is there already: exact names, words, vetoes, residue, and misspellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.entities import name_index, without_qualifiers

ENTITY = "id, subtype, names (the first is the main one), nickname, disambiguation, summary"


def _words(name: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: w != "")


def _identities(entities: DataFrame) -> DataFrame:
    """(id, subtype, surnames, haystack): the last words of an entity's names of two words or more, and the text in
    which a surname may stand if it has no such name."""
    every = F.filter(F.concat("names", F.array("nickname", "disambiguation")), lambda n: F.trim(F.coalesce(n, F.lit(""))) != "")
    surnames = F.array_distinct(F.transform(F.filter(F.transform(every, _words), lambda w: F.size(w) >= 2), lambda w: F.element_at(w, -1)))
    text = F.lower(F.concat_ws(" ", F.get("names", F.lit(0)), "nickname", "disambiguation", "summary"))
    return entities.select("id", "subtype", surnames.alias("surnames"), text.alias("haystack"))


def surname_vetoes(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """The (subtype, surname) of asked for which some entity of the subtype speaks against a merge: it has surnames, none
    of them this one, or it has none and its texts do not have the word.

    Surnamed entities are counted, not compared. Of those without surnames the one with the shortest text is tried
    first, so that only words inside that one text can meet the others."""
    own = _identities(entities)
    asked = asked.select("subtype", "surname").distinct()
    named = own.where("size(surnames) > 0")
    total = named.groupBy("subtype").agg(F.count(F.lit(1)).alias("n"))
    having = named.select("subtype", F.explode("surnames").alias("surname")).groupBy("subtype", "surname").agg(F.count(F.lit(1)).alias("n_same"))
    met = asked.join(total, "subtype", "left").join(having, ["subtype", "surname"], "left")
    met = met.select("subtype", "surname", (F.coalesce("n", F.lit(0)) > F.coalesce("n_same", F.lit(0))).alias("veto"))
    bare = own.where("size(surnames) = 0")
    shortest = bare.groupBy("subtype").agg(F.min_by("haystack", F.struct(F.length("haystack"), "id")).alias("shortest"))
    open_ = met.where("NOT veto").join(shortest, "subtype", "left")
    first = open_.withColumn("veto", F.coalesce(~F.contains("shortest", F.col("surname")), F.lit(False)))
    left = first.where("NOT veto AND shortest IS NOT NULL").select("subtype", "surname")
    against = left.join(bare.select("subtype", "haystack"), "subtype").where(~F.contains("haystack", F.col("surname"))).select("subtype", "surname").distinct()
    return met.where("veto").select("subtype", "surname").unionByName(first.where("veto").select("subtype", "surname")).unionByName(against).distinct()


def keys_of(entities: DataFrame) -> DataFrame:
    """(id, subtype, key): whole texts by which an entity is known, with hyphens and underscores as spaces."""
    plain = lambda c: F.trim(F.regexp_replace(F.translate(F.lower(c), "-_", "  "), r"\s+", " "))
    every = F.concat(F.array(F.col("id").cast("string"), "nickname", "summary"), "names")
    return entities.select("id", "subtype", F.explode(F.array_distinct(F.transform(F.filter(every, lambda n: n.isNotNull()), plain))).alias("key")).where("key <> ''")


def match_entities(proposals: DataFrame, entities: DataFrame) -> DataFrame:
    """proposals (proposal, name, subtype) with the id of the entity that each folds into, and the stage that found it.

    "full": the whole name, of the subtype or of a person; "base": the name without qualifiers, of any subtype;
    "token": a single word that leads to one entity of the subtype or to a person. For names of two words or more, if
    no entity of the subtype speaks against the surname: "words", two or more words that lead to one entity of the
    subtype (the most, then the least id). Where the word stages find nothing, "residue": an entity of the subtype
    whose key is one of the words, or whose main name is the name (least id); a vetoed name has no later stage. Last
    "person": a person of that name for a proposal of another subtype. Others have null; blank names too."""
    index = name_index(entities).join(entities.select("id", F.col("subtype").alias("found_type")), "id")
    usable = index.where("kind <> 'ambiguous'").select(F.col("key").alias("word"), F.col("id").alias("word_id"), F.col("found_type").alias("word_type"))
    whole = index.where("kind = 'full'")
    by = lambda key, stage: whole.select(F.col("key").alias(key), F.col("id").alias(f"{stage}_id"), F.col("found_type").alias(f"{stage}_type"))
    own = proposals.select("proposal", "name", "subtype", F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("low"), without_qualifiers(F.coalesce("name", F.lit(""))).alias("base"), _words(F.coalesce("name", F.lit(""))).alias("words"))
    own = own.withColumn("surname", F.when(F.size("words") >= 2, F.element_at("words", -1)))
    fits = lambda stage: (F.col(f"{stage}_type") == F.col("subtype")) | (F.col(f"{stage}_type") == "person")
    met = own.join(by("low", "full"), "low", "left").join(by("base", "base"), "base", "left")
    exploded = own.select("proposal", "subtype", F.size("words").alias("n"), F.explode(F.array_distinct("words")).alias("word")).join(usable, "word")
    single = exploded.where((F.col("n") == 1) & fits("word")).groupBy("proposal").agg(F.min("word_id").alias("token_id"))
    shared = exploded.where((F.col("n") > 1) & (F.col("word_type") == F.col("subtype"))).groupBy("proposal", "word_id").agg(F.count(F.lit(1)).alias("k")).where("k >= 2")
    words = shared.groupBy("proposal").agg(F.min(F.struct(F.negative("k"), "word_id")).alias("w")).select("proposal", F.col("w.word_id").alias("words_id"))
    vetoes = surname_vetoes(own.where("surname IS NOT NULL"), entities).withColumn("veto", F.lit(True))
    keys = keys_of(entities)
    mains = entities.select("id", "subtype", F.trim(F.regexp_replace(F.translate(F.lower(F.get("names", F.lit(0))), "-_", "  "), r"\s+", " ")).alias("key"))
    asked = own.select("proposal", "subtype", F.explode(F.array_distinct("words")).alias("key")).join(keys, ["subtype", "key"]).select("proposal", "id")
    plain = own.select("proposal", "subtype", F.trim(F.regexp_replace(F.translate("low", "-_", "  "), r"\s+", " ")).alias("key")).where("key <> ''").join(mains, ["subtype", "key"]).select("proposal", "id")
    residue = asked.unionByName(plain).groupBy("proposal").agg(F.min("id").alias("residue_id"))
    people = mains.where("subtype = 'person'").groupBy(_slug(F.col("key")).alias("slug")).agg(F.min("id").alias("person_id"))
    met = met.withColumn("slug", _slug(F.col("low"))).join(single, "proposal", "left").join(words, "proposal", "left").join(vetoes, ["subtype", "surname"], "left").join(residue, "proposal", "left").join(people, "slug", "left")
    stage = (
        F.when(F.col("low") == "", F.lit(None))
        .when(F.col("full_id").isNotNull() & fits("full"), "full")
        .when(F.col("base_id").isNotNull() & (F.col("base") != F.col("low")), "base")
        .when(F.col("token_id").isNotNull(), "token")
        .when(F.col("veto"), F.lit(None))
        .when(F.col("words_id").isNotNull(), "words")
        .when(F.col("residue_id").isNotNull(), "residue")
        .when((F.size("words") >= 2) & (F.col("subtype") != "person") & F.col("person_id").isNotNull(), "person")
    )
    by_stage = F.when(F.col("stage") == "full", F.col("full_id"))
    for s in ("base", "token", "words", "residue", "person"):
        by_stage = by_stage.when(F.col("stage") == s, F.col(f"{s}_id"))
    return met.withColumn("stage", stage).select("proposal", "name", by_stage.alias("id"), "stage")


def _slug(text: Column) -> Column:
    return F.coalesce(F.nullif(T.slug(text), F.lit("")), F.lit("item"))


def near_names(names: DataFrame, name: str = "name") -> DataFrame:
    """(a, b), a < b: distinct names of which one becomes the other by one inserted, deleted or replaced letter.

    Names meet by what is left of them without one letter (and whole): two names one edit apart always share such a
    rest, and distinct names share one only if they agree in all other letters, so no key gathers many. Nulls and
    blanks are left out; words of other surnames are for the caller to veto."""
    own = names.select(F.lower(F.trim(name)).alias("name")).where("name <> ''").distinct()
    rests = F.concat(F.array("name"), F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.overlay("name", F.lit(""), i, F.lit(1))))
    keys = own.select("name", F.explode(F.array_distinct(rests)).alias("rest"))
    met = keys.select(F.col("name").alias("a"), "rest").join(keys.select(F.col("name").alias("b"), "rest"), "rest").where("a < b").select("a", "b").distinct()
    return met.where(F.levenshtein("a", "b") == 1)


def misspelt(proposals: DataFrame, names: DataFrame) -> DataFrame:
    """(proposal, name, id): for proposals (proposal, name) the entity (id, name) whose name is one edit away and has the
    same surname (or is one word too), if there is just one."""
    asked = proposals.select("proposal", F.lower(F.trim("name")).alias("a")).where("a <> ''").distinct()
    held = names.select("id", F.lower(F.trim("name")).alias("b")).where("b <> ''").distinct()
    pairs = near_names(asked.select(F.col("a").alias("name")).unionByName(held.select(F.col("b").alias("name"))))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    last = lambda c: F.element_at(_words(F.col(c)), -1)
    kept = both.where(((F.size(_words(F.col("a"))) == 1) & (F.size(_words(F.col("b"))) == 1)) | (last("a") == last("b")))
    found = asked.join(kept, "a").join(held, "b").groupBy("proposal").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")).where("n = 1")
    return proposals.join(found, "proposal").select("proposal", "name", "id")
