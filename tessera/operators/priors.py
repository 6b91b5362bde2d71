"""Who is said to be behind what: names near causal words, counted over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

WINDOW, LEAST_SUPPORT = 90, 3
# Words of a cause, words that say that somebody did not choose, kinds that can act, words that are no names.
CAUSAL = r"\b(?:because of|due to|caused by|driven by|blamed on|attributed to|the result of|at the (?:direction|insistence|behest) of|under (?:pressure|the influence) (?:of|from)|controlled by|orchestrated by|decided by|relayed by)\b"
NOT_CHOSEN = r"\b(?:never (?:chose|chooses|decided|decides|initiated|initiates)|didn.?t (?:choose|decide|initiate)|had no (?:choice|say)|went along with|was (?:made|told|forced|pressured) to|only (?:does|did) what|is never the one who)\b"
ACTING = ["person", "agent", "organization", "pet"]
NO_NAMES = ["the", "and", "for", "one", "two", "new", "old", "day", "her", "his", "our", "their", "that", "this", "with", "from"]
GRAM = 3
#: Lengths of the runs of letters by which names and texts meet.
RUNS = [GRAM, 4, 6, 8, 12, 16, 24, 32, 48, 64]


def roster(entities: DataFrame) -> DataFrame:
    """(id, name) of acting entities (id, subtype, names; the first name is the main one): names in lower case, and
    the first word of the main one, of three letters at least."""
    main = F.trim(F.get("names", F.lit(0)))
    own = entities.where(F.lower(F.trim("subtype")).isin(*ACTING) & (main != ""))
    every = F.concat(F.filter("names", lambda n: n.isNotNull()), F.array(F.get(F.split(main, r"\s+"), F.lit(0))))
    return own.select("id", F.explode(F.transform(every, lambda n: F.lower(F.trim(n)))).alias("name")).where((F.length("name") >= GRAM) & ~F.col("name").isin(*NO_NAMES)).distinct()


def marker_windows(records: DataFrame, pattern: str, id_column: str = "id", text: str = "text", more: list[str] | None = None) -> DataFrame:
    """(id, the columns `more`, marker, before, after): the WINDOW characters on each side of each match of the pattern in the lower-cased
    text. Null texts have none."""
    more = more or []
    parts = records.select(F.col(id_column).alias("id"), *more, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t")).where(F.col("t").rlike(pattern))
    cut = parts.select("id", *more, "t", F.split("t", pattern).alias("between"), F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("found"))
    # Ends of the parts so far: the k-th match stands behind k parts and the k - 1 matches between them.
    sizes = lambda k: F.aggregate(F.slice("between", F.lit(1), k + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice("found", F.lit(1), k), F.lit(0), lambda s, x: s + F.length(x))
    at = cut.select("id", *more, "t", F.posexplode(F.transform("found", lambda x, k: F.struct(sizes(k).alias("from"), F.length(x).alias("n")))).alias("marker", "m"))
    start = F.greatest(F.col("m.from") - WINDOW, F.lit(0))
    return at.select("id", *more, "marker", F.substr("t", start + 1, F.col("m.from") - start).alias("before"), F.substr("t", F.col("m.from") + F.col("m.n") + 1, F.lit(WINDOW)).alias("after"))


def _named(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text, found) of distinct texts (text) in which names stand: found are (place, entity) in order.

    A text and a name meet by a run of letters of the name, as long as the greatest of RUNS that is not longer than the
    name; of these runs the one that the fewest names have. So the longer the names, the fewer a run has, and their
    number does not multiply with that of the texts. Of entities with one name the first two count: no caller asks for
    more than the first that is not a given one."""
    few = names.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where("n <= 2").drop("n")
    fit = F.greatest(*(F.when(F.length("name") >= r, r) for r in RUNS))
    runs = lambda text, r: F.transform(F.sequence(F.lit(1), F.length(text) - r + 1), lambda i: F.substr(F.col(text), i, r))
    own = few.select("name").distinct().withColumn("run", fit)
    held = own.select("name", "run", F.posexplode(runs("name", F.col("run"))).alias("offset", "gram"))
    common = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = written(held.join(common, "gram").groupBy("name", "run").agg(F.min(F.struct("n", "offset", "gram")).alias("r")).select("name", "run", "r.offset", "r.gram"))
    sizes = F.broadcast(rarest.select("run").distinct())
    met = texts.crossJoin(sizes).where(F.length("text") >= F.col("run")).select("text", F.posexplode(runs("text", F.col("run"))).alias("at", "gram")).join(rarest.drop("run"), "gram").withColumn("place", F.col("at") - F.col("offset"))
    met = met.where((F.col("place") >= 0) & (F.substr("text", F.greatest(F.col("place") + 1, F.lit(1)), F.length("name")) == F.col("name")))
    return met.join(few.withColumnRenamed("id", "entity"), "name").groupBy("text").agg(F.sort_array(F.collect_set(F.struct("place", "entity"))).alias("found"))


def causes(records: DataFrame, entities: DataFrame, least: int = LEAST_SUPPORT) -> DataFrame:
    """(kind, subject, agent, support, first, last): how many records (id, text, stamp) say that something about the
    subject is the agent's doing ("pairwise"), or that the subject did not choose ("non_originating"), where at least
    `least` do. The agent is the entity named first behind the words, the subject the first other one in front. Windows
    are stored, and equal ones are searched for names once."""
    names = roster(entities)
    stamped = records.select("id", "text", F.coalesce("stamp", F.lit("")).alias("stamp"))
    of = lambda pattern, kind: marker_windows(stamped, pattern, more=["stamp"]).withColumn("kind", F.lit(kind))
    windows = written(of(CAUSAL, "pairwise").unionByName(of(NOT_CHOSEN, "non_originating").withColumn("after", F.lit(None).cast("string"))))
    texts = windows.select(F.explode(F.array("before", "after")).alias("text")).where("text IS NOT NULL").distinct()
    found = written(_named(texts, names))
    other = lambda agent: F.get(F.filter("before_found", lambda x: ~x["entity"].eqNullSafe(agent)), F.lit(0))["entity"]
    met = windows.join(found.select(F.col("text").alias("before"), F.col("found").alias("before_found")), "before").join(found.select(F.col("text").alias("after"), F.get("found", F.lit(0))["entity"].alias("agent")), "after", "left")
    every = met.select("kind", "id", "stamp", other(F.col("agent")).alias("subject"), "agent").where("subject IS NOT NULL AND (kind = 'non_originating' OR agent IS NOT NULL)").distinct()
    first = F.min(F.when(F.col("stamp") != "", F.col("stamp")))
    got = every.groupBy("kind", "subject", "agent").agg(F.count_distinct("id").alias("support"), F.coalesce(first, F.lit("")).alias("first"), F.max("stamp").alias("last"))
    return got.where(F.col("support") >= least)


def near_pairs(a: DataFrame, b: DataFrame, group: str, position: str, within: int) -> DataFrame:
    """Pairs of rows of a and b in one group whose positions (columns of one name in both, as a struct `a` and `b`)
    are at most `within` apart: a band join. Positions are dealt into buckets of that width; a row of b goes to its
    bucket and both beside it, so that a group with many rows is not one key."""
    bucket = lambda c: F.floor(F.col(c) / max(1, within)).cast("long")
    left = a.select(F.col(group).alias("_g"), bucket(position).alias("_k"), F.struct(*a.columns).alias("a"))
    right = b.select(F.col(group).alias("_g"), F.explode(F.array(bucket(position) - 1, bucket(position), bucket(position) + 1)).alias("_k"), F.struct(*b.columns).alias("b"))
    return left.join(right, ["_g", "_k"]).where(F.abs(F.col(f"a.{position}") - F.col(f"b.{position}")) <= within).select("a", "b")


def positions_of(text: Column, pattern: str) -> Column:
    """Places (from 0) at which a pattern matches."""
    between, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = lambda values, k: F.aggregate(F.slice(values, F.lit(1), k), F.lit(0), lambda s, x: s + F.length(x))
    return F.transform(found, lambda _, k: lengths(between, k + 1) + lengths(found, k))
