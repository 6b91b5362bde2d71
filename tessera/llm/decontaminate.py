"""Benchmark decontamination by template windows: numbers, names and units become typed placeholders, windows
of the templates are hash-joined, and the values in the slots must agree.

DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import computed

#: Words in a window at most; _sized() makes windows as short as an item's thresholds need.
WINDOW = 8
#: An item leaks if so large a part of its words stands in the document, in line, or so many words in a row.
COVERAGE, RUN = 0.8, 13
SLOTS = ("<num>", "<name>", "<unit>")
# Unit words.
UNITS = "mm cm m km mg g kg t ml l s sec min h hr ms hz khz mhz ghz w kw kwh v a j kj cal kcal pa kpa bar mph kmh inch inches feet foot ft yard yards mile miles ounce ounces oz pound pounds lb lbs gallon gallons second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres dollar dollars euro euros cent cents usd eur gbp percent degree degrees celsius fahrenheit".split()


def words(text: Column) -> Column:
    """The words of a text, without punctuation; their case is kept."""
    return F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}\s]+", ""), r"\s+"), lambda x: x != "")


def marked(text: Column) -> Column:
    """A text without punctuation, with a word as <num> if it begins with a digit, <unit> if it is a unit of
    measure."""
    out = F.regexp_replace(text, r"[^\p{L}\p{N}\s]+", "")
    out = F.regexp_replace(out, r"(?<!\S)(?=\p{N})\S+", "<num>")
    return F.regexp_replace(out, rf"(?<!\S)(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?!\S)", "<unit>")


def template(marked_text: Column, folded: bool = False) -> Column:
    """The words of a marked text, one for one with words(): a word that begins with a capital is <name>, or,
    in the folded template, a word like others; the others are in lower case."""
    out = marked_text if folded else F.regexp_replace(marked_text, r"(?<!\S)(?=\p{Lu})\S+", "<name>")
    return F.filter(F.split(F.lower(out), r"\s+"), lambda x: x != "")


def _sized(items: DataFrame, window: int, coverage: float, run: int) -> DataFrame:
    """items (it: template words) with size, the words of their windows, and least, how many windows a leak has in
    common with the item at one offset.

    An item of n words may miss m = n - ceil(coverage * n) of them. The others lie in m + 1 runs at most, so one
    run has ceil((n - m) / (m + 1)) words at least, and a window of no more words stands in it. Of the item's
    n - size + 1 windows each word missed spoils size; `run` words in a row have run - size + 1 windows."""
    n = F.size("it")
    need = F.ceil(n * coverage - 1e-9)
    items = computed(items.where(n > 0), size=F.greatest(F.lit(1), F.least(F.lit(window), F.lit(run), F.ceil(need / (n - need + 1)))).cast("int"), missed=(n - need).cast("int"))
    of_coverage, of_run = n - F.col("size") + 1 - F.col("size") * F.col("missed"), F.when(n >= run, run - F.col("size") + 1)
    return items.withColumn("least", F.greatest(F.lit(1), F.least(of_coverage, of_run))).drop("missed")


def _hash(folded: Column, t: Column, pos: Column, size: int) -> Column:
    """The hash of the window of so many words at pos of a template; null where the template ends before."""
    return F.when(pos + size <= F.size(t), F.xxhash64(folded, *(F.get(t, pos + k) for k in range(size))))


def _consistent(slots: Column) -> Column:
    """Whether each of the item's values always became the same one, and no two of its names became one. Numbers may:
    three and five of a thing can both be four in another wording of a question."""
    pairs = F.array_distinct(F.transform(slots, lambda s: F.struct(s["item"].alias("item"), s["doc"].alias("doc"))))
    names = F.filter(pairs, lambda s: F.startswith(s["item"], F.lit("<name>")))
    one = lambda of, end: F.size(of) == F.size(F.array_distinct(F.transform(of, lambda s: s[end])))
    return one(pairs, "item") & one(names, "doc")


def _within(span: Column) -> Column:
    return F.filter("slots", lambda s: s["pos"].between(span["from"], span["to"]))


def _ends(word: Column) -> Column:
    """(from, to) of the runs of words in line."""
    hit = lambda i: F.coalesce(F.get("hits", i), F.lit(False))
    first, last = F.filter(word, lambda i: hit(i) & ~((i > 0) & hit(i - 1))), F.filter(word, lambda i: hit(i) & ~hit(i + 1))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("from"), b.alias("to")))


def _spans(run: int, trim: bool) -> Column:
    """The spans of the item whose slots can make a run a leak. In the folded template, any `run` words in line. In
    the other, the runs in line, whole or, to trim, without the slots at either end, as a slot beside a copied
    passage can be in line by chance."""
    fixed = F.flatten(F.transform(F.filter("ends", lambda e: e["to"] - e["from"] >= run - 1), lambda e: F.transform(F.sequence(e["from"], e["to"] - run + 1), lambda i: F.struct(i.alias("from"), (i + run - 1).alias("to")))))

    def trimmed(e: Column) -> Column:
        inner = F.filter("firm", lambda i: i.between(e["from"], e["to"]))
        a, b = (e["from"], F.array_min(inner)), (e["to"], F.array_max(inner))
        return F.filter(F.array(*(F.struct(x.alias("from"), y.alias("to")) for x in a for y in b)), lambda s: s["from"].isNotNull() & s["to"].isNotNull())

    return F.when(F.col("folded"), fixed).otherwise(F.flatten(F.transform("ends", trimmed)) if trim else F.col("ends"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, run: int = RUN, folded: bool = False) -> DataFrame:
    """One row per pair of a document and a benchmark item that leaks into it: doc_id, item_id, n_item words,
    n_match words of the item in line with the document, run (the most in a row), coverage, kind: "verbatim" if
    the slots hold the same values, "reparameterised" if each of the item's values always became the same one and
    names stayed apart.

    A document leaks an item if at an offset coverage reaches its threshold and all slots in line are consistent,
    or run does and the slots inside the run are; what else is in line by chance does not count against a run
    (with folded, also slots at its ends).
    With folded, a pair is also judged by the folded templates, in which names are words and case does not
    count, and leaks by either; the best offset is shown. docs has doc_id and text, benchmark item_id and text;
    other columns are ignored. Null texts are empty and match nothing, null ids never join and are left out.
    Items of few words leak into all documents that have these words in line, but an item of slots only must
    stand there verbatim. Rows that repeat an id are judged as one, by their best offset.

    Pairs and offsets are found by windows at every word, so short that none that reaches a threshold is lost
    (the sizes that the benchmark needs are collected first). Windows are joined without a hint, on their hash; a
    window that many documents share meets the few items that have it, and only offsets with as many windows in
    common as a leak must have go on to the next step."""
    views = [False, True] if folded else [False]
    either = lambda c, f: F.when(F.col("folded"), f(F.col(c), True)).otherwise(f(F.col(c), False))
    values = lambda c, fold: words(F.lower(c) if fold else c)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("doc_id").isNotNull())
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("item_id").isNotNull()).distinct()
    items = computed(items, m=marked(F.col("text"))).select("*", F.explode(F.array(*map(F.lit, views))).alias("folded"))
    items = computed(items, it=either("m", template), iw=either("text", values)).drop("text", "m")
    items = _sized(items, window, coverage, run)
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect()) or [window]
    pos = F.col("pos")
    wanted = items.select("item_id", "folded", "size", "least", "it", F.posexplode("it").alias("pos", "word"))
    of_size = F.coalesce(*(F.when(F.col("size") == n, _hash(F.col("folded"), F.col("it"), pos, n)) for n in sizes))
    wanted = wanted.select("item_id", "folded", "least", pos.alias("ipos"), of_size.alias("hash")).where(F.col("hash").isNotNull())
    held = computed(own, m=marked(F.col("text"))).select("doc_id", "m")
    held = computed(held, **{f"t{i}": template(F.col("m"), v) for i, v in enumerate(views)}).drop("m")
    held = held.select("*", F.posexplode("t0").alias("pos", "word"))
    held = held.select("doc_id", pos.alias("dpos"), F.explode(F.array(*(_hash(F.lit(v), F.col(f"t{i}"), pos, n) for i, v in enumerate(views) for n in sizes))).alias("hash")).where(F.col("hash").isNotNull())
    offsets = held.join(wanted, "hash").groupBy("doc_id", "item_id", "folded", "least", (F.col("dpos") - F.col("ipos")).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.where(F.col("n") >= F.col("least")).select("doc_id", "item_id", "folded", "at").distinct()

    # Documents that no pair reaches are dropped by the join; of the others only the words in line are kept.
    met = computed(offsets.join(items.drop("size", "least"), ["item_id", "folded"]).join(own, "doc_id"), m=marked(F.col("text")))
    met = computed(met, dt=either("m", template), dw=either("text", values)).drop("text", "m")
    at = lambda a, i: F.when((i + F.col("at") >= 0) & (i + F.col("at") < F.size(a)), F.get(a, i + F.col("at")))
    met = computed(met, hits=F.transform(F.sequence(F.lit(0), F.size("it") - 1), lambda i: F.coalesce(at(F.col("dt"), i) == F.get("it", i), F.lit(False))))
    slots = F.filter(F.sequence(F.lit(0), F.size("it") - 1), lambda i: F.get("hits", i) & F.get("it", i).isin(*SLOTS))
    word = F.sequence(F.lit(0), F.size("it") - 1)
    met = computed(met, slots=F.transform(slots, lambda i: F.struct(i.alias("pos"), F.concat(F.get("it", i), F.get("iw", i)).alias("item"), F.concat(F.get("it", i), at(F.col("dw"), i)).alias("doc"))), ends=_ends(word), firm=F.filter(word, lambda i: ~F.get("it", i).isin(*SLOTS)))
    met = computed(met, spans=F.filter(_spans(run, folded), lambda s: (s["to"] - s["from"] >= run - 1) & _consistent(_within(s))))
    longest = F.coalesce(F.array_max(F.transform("ends", lambda e: e["to"] - e["from"] + 1)), F.lit(0))
    changed = lambda slots: F.exists(slots, lambda s: s["item"] != s["doc"])
    met = met.select("doc_id", "item_id", "at", F.size("it").alias("n_item"), F.size(F.filter("hits", lambda x: x)).alias("n_match"), longest.alias("run"), changed(F.col("slots")).alias("slots_changed"), _consistent(F.col("slots")).alias("consistent"), (F.size("spans") > 0).alias("runs"), (~F.exists("spans", lambda s: ~changed(_within(s)))).alias("spans_changed"), (F.size("firm") > 0).alias("wordy"))
    met = met.withColumn("coverage", F.col("n_match") / F.col("n_item")).withColumn("covers", (F.col("coverage") >= coverage) & F.col("consistent"))
    met = met.where(F.col("covers") | F.col("runs")).withColumn("changed", F.when(F.col("covers"), F.col("slots_changed")).otherwise(F.col("spans_changed"))).where(F.col("wordy") | ~F.col("changed"))
    best = met.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_item", "n_match", "run", "coverage", "changed"), F.struct("n_match", "run", F.negative("at"), ~F.col("changed"))).alias("b"))
    return best.select("doc_id", "item_id", *(F.col(f"b.{c}").alias(c) for c in ("n_item", "n_match", "run", "coverage")), F.when(F.col("b.changed"), "reparameterised").otherwise("verbatim").alias("kind"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs whose doc_id leaks no item of the benchmark; rows with a null id stay."""
    return docs.join(find_leaks(docs, benchmark, **how).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of benchmark that leak into documents, in any case of letters."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), folded=True)
