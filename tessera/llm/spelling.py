"""Spelling variants: words of a corpus that are one inserted, deleted or replaced code point apart.

A sorted list of words is scanned once. The rows of the edit matrices of all later words against the list's word are
kept by depth, three cells wide, as more than one edit is never asked for; the next word of the list takes up the rows
at the depth of its common prefix with the word before, and a word whose row exceeds one edit is left out of all that
shares the prefix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import partitions, stored, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, RATIO, SLIPS = 6, 5, 5, 199
#: Words with one head and tail that a task compares; larger groups get longer heads and tails.
MAX_GROUP = 20_000
GROUP = ["size", "head_len", "tail_len", "head", "tail"]


def slipped(run: Column, doc_id: Column, one_in: int = SLIPS) -> Column:
    """The run, or, if the crc32 of `<doc_id>:<run>` is a multiple of one_in, the run less one code point. A null
    doc_id counts as an empty one."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    return F.when(h % one_in == 0, F.overlay(run, F.lit(""), (h % F.length(run) + 1).cast("int"), F.lit(1))).otherwise(run)


def word_counts(docs: DataFrame, column: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slips: int = SLIPS) -> DataFrame:
    """(word, n): the words of at least least_length letters with at least least_count occurrences in all texts.

    Runs of letters count in lower case (A-Z only); one in `slips`, chosen by hash, has lost a letter. Null and empty
    texts have no words; repeated rows count as often as they are there."""
    found = docs.select(F.col(doc_id).alias("id"), F.explode(F.regexp_extract_all(whole_text(column), F.lit(LETTERS + f"{{{least_length},}}"), F.lit(0))).alias("run"))
    lowered = found.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    words = lowered.select(slipped(F.col("run"), F.col("id"), slips).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _framed(rows: DataFrame, head_len: Column, tail_len: Column, low: Column, high: Column) -> DataFrame:
    """Rows with the head and tail that all words of their group share; the first difference lies in [low, high)."""
    out = rows.select("word", "n", "size", head_len.cast("int").alias("head_len"), tail_len.cast("int").alias("tail_len"), low.cast("int").alias("low"), high.cast("int").alias("high"))
    return out.withColumns({"head": F.expr("left(word, head_len)"), "tail": F.expr("right(word, tail_len)")})


def _halved(rows: DataFrame) -> DataFrame:
    """Each group twice: if two words first differ in the second half of what is between head and tail, they share a
    head that is longer by the first half; else they share a tail that is longer by the second half."""
    half = F.floor((F.col("size") - F.col("head_len") - F.col("tail_len")) / 2)
    rest = F.col("size") - F.col("head_len") - F.col("tail_len") - half
    later = _framed(rows, F.col("head_len") + half, F.col("tail_len"), F.col("head_len") + half, F.col("high"))
    return later.unionByName(_framed(rows, F.col("head_len"), F.col("tail_len") + rest, F.col("low"), F.col("head_len") + half))


def grouped(words: DataFrame, most: int = MAX_GROUP) -> DataFrame:
    """Every word (word, n) in the groups in which it can meet a word one edit away, each pair in one group only.

    Pairs are dealt by the length of the shorter word, rounded down to an even `size`: a word has one size if its
    length is odd, else two. Groups of more than `most` words are halved again; this ends when two places are free."""
    size = F.length("word") - F.length("word") % 2
    sizes = F.when(F.length("word") % 2 == 0, F.array(size, size - 2)).otherwise(F.array(size))
    start = words.select("word", "n", F.explode(sizes).alias("size")).withColumns({"head_len": F.lit(0), "tail_len": F.lit(0), "low": F.lit(0), "high": F.lit(2**31 - 1)})
    rows, done = stored(_halved(start), "frames"), None
    while True:
        large = rows.groupBy(*GROUP).count().where((F.col("count") > most) & (F.col("size") - F.col("head_len") - F.col("tail_len") > 2)).select(*GROUP)
        large = stored(large, "large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        kept = rows.join(large, GROUP, "left_anti").select(*rows.columns)
        done = kept if done is None else done.unionByName(kept)
        rows = stored(_halved(rows.join(large, GROUP, "left_semi").select(*rows.columns)), "frames")


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def scan(words: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), i < j, of the sorted distinct words that are one edit apart."""
    lens = np.array([len(w) for w in words])
    letters = np.full((len(words), lens.max(initial=0) + 3), -1, np.int32)  # one place before the word, two behind it
    for i, w in enumerate(words):
        letters[i, 1 : len(w) + 1] = np.frombuffer(w.encode("utf-32-le"), np.int32)
    cells = np.tile(np.array([2, 0, 1], np.int8), (len(words), 1))
    cells[lens == 0, 2] = 2
    rows = [(np.arange(len(words)), cells)]  # by depth: the words within one edit, and their cells left, on and right of the diagonal
    before = ""
    for i, word in enumerate(words):
        del rows[1 + common_prefix(before, word) :]
        before = word
        for depth in range(len(rows) - 1, len(word)):
            at, cells = rows[-1]
            later = np.searchsorted(at, i, "right")
            at, cells = at[later:], cells[later:]
            same = letters[at, depth : depth + 3] != letters[i, depth + 1]
            moved = cells + same
            left = np.minimum(moved[:, 0], cells[:, 1] + 1)
            on = np.minimum(np.minimum(moved[:, 1], cells[:, 2] + 1), left + 1)
            right = np.minimum(moved[:, 2], on + 1)
            cells = np.stack([left, on, right], 1)
            over = depth + np.arange(3) - lens[at, None]  # no cell lies behind the end of a word
            cells[over > 0] = 2
            near = cells.min(1) <= 1
            rows.append((at[near], cells[near].astype(np.int8)))
            if not near.any():
                break
        if len(rows) == len(word) + 1:
            at, cells = rows[-1]
            side = lens[at] - len(word) + 1
            ends = (side >= 0) & (side <= 2) & (at > i)
            at, cells, side = at[ends], cells[ends], side[ends]
            for j in at[cells[np.arange(len(at)), side] <= 1]:
                yield i, int(j)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways, of rows that are sorted by group and by what stands between head and tail."""

    def found(rows: list[tuple]) -> Iterator[tuple[str, str, int]]:
        size, head_len, tail_len, low, high = rows[0][2:7]
        for i, j in scan([r[0][head_len : len(r[0]) - tail_len] for r in rows]):
            (a, n), (b, m) = rows[i][:2], rows[j][:2]
            if min(len(a), len(b)) <= size + 1 and low <= common_prefix(a, b) < high:
                yield a, b, m
                yield b, a, n

    held: list[tuple] = []
    group = None
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "size", "head_len", "tail_len", "low", "high", "head", "tail"))):
            if (row[2:5], row[7:]) != group:
                if len(held) > 1:
                    out += found(held)
                group, held = (row[2:5], row[7:]), []
            held.append(row)
        yield _pairs(out)
    if len(held) > 1:
        yield _pairs(list(found(held)))


def _pairs(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(3)], names=["word", "near", "near_n"])


def near_words(words: DataFrame, most: int = MAX_GROUP) -> DataFrame:
    """(word, near, near_n): all ordered pairs of the distinct words (word, n) that are one edit apart; words have at
    least four code points. An empty table has no pairs."""
    rows = grouped(words, most).withColumn("middle", F.expr("substring(word, head_len + 1, length(word) - head_len - tail_len)"))
    dealt = rows.repartition(partitions(words.sparkSession), *GROUP).sortWithinPartitions(*GROUP, "middle").drop("middle")
    return dealt.mapInArrow(_compared, "word string, near string, near_n long")


def variants(words: DataFrame, ratio: int = RATIO, most: int = MAX_GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n for the distinct words (word, n).

    form: the near word of largest n (ties: the first in code-point order), if it has at least ratio (2 or more) times
    the word's n; root: the last of the chain of forms, the word itself without one. As n grows along a chain, chains
    have no cycles and double in length in each round. An empty table gives an empty result."""
    near = near_words(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    best = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best"))
    own = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), best["word"].alias("form"), (-best["n"]).alias("form_n")), "forms")
    chains = own.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(chains.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        chains = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return own.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of documents and their forms."""
    return variants(stored(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "words"))
