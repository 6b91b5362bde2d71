"""Substring deduplication by repeated-phrase automata: passages that recur are confirmed, compiled into sharded
Aho-Corasick automata, and every text that may hold one is streamed through them to find each occurrence.

Texts meet the automaton of a shard by way of their anchors (see repeats): a place that holds a recurring passage
holds its anchor, so that no other shard can find anything there."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.repeats import RANGES, Units, covered, repeated_ranges, unpacked
from tessera.llm.shingles import small_batches, word_hashes

#: Words in a window, and in an anchor.
WINDOW, GRAM = 35, 12
#: Bytes of distinct segments that one automaton is made from; a recurring anchor with more has one for itself.
SHARD_BYTES = 1_500_000


def _cut(text: bytes, places: list[tuple[int, int]]) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[a:b]) for a, b in places]


def letters(texts: list[list[bytes]]) -> list[str]:
    """Texts with each distinct word as one character, so that an automaton over characters steps by words."""
    number: dict[bytes, str] = {}
    free = iter([*range(1, 0xD800), *range(0xE000, 0x110000)])
    out = []
    for words in texts:
        for w in words:
            if w not in number:
                number[w] = chr(next(free))
        out.append("".join([number[w] for w in words]))
    return out


def recurring_passages(texts: list[str], anchors: list[int], copies: list[int], window: int) -> set[str]:
    """The longest runs of windows in each text of which each occurs again, in it, in another, or in a copy."""
    at, passages = 0, set()
    while at < len(texts):
        end = at
        while end < len(texts) and anchors[end] == anchors[at]:
            end += 1
        seen: dict[str, int] = {}
        for text, n in zip(texts[at:end], copies[at:end]):
            if n == 1 and end - at > 1:
                for i in range(len(text) - window + 1):
                    seen[text[i : i + window]] = seen.get(text[i : i + window], 0) + 1
            elif end - at > 1:
                for i in range(len(text) - window + 1):
                    seen[text[i : i + window]] = 2
        for text, n in zip(texts[at:end], copies[at:end]):
            if n > 1:
                passages.add(text)
                continue
            start = None
            for i in range(len(text) - window + 2):
                again = i <= len(text) - window and seen.get(text[i : i + window], 1) > 1
                if again and start is None:
                    start = i
                elif not again and start is not None:
                    passages.add(text[start : i - 1 + window])
                    start = None
        at = end
    return passages


def occurrences(passages: set[str], texts: list[str]) -> list[list[tuple[int, int]]]:
    """Where passages stand in each text: merged ranges, end exclusive."""
    if not passages:
        return [[] for _ in texts]
    automaton = ahocorasick.Automaton()
    for p in passages:
        automaton.add_word(p, len(p))
    automaton.make_automaton()
    out = []
    for text in texts:
        found: list[tuple[int, int]] = []
        for last, n in automaton.iter(text):
            a, b = last + 1 - n, last + 1
            while found and found[-1][1] >= a:  # ends only grow, so what touches the new range lies at the top
                a = min(a, found.pop()[0])
            found.append((a, b))
        out.append(found)
    return out


def solver(contents: list[bytes], anchors: list[int], copies: list[int], rows: list[int]) -> list[list[tuple[int, int, bool]]]:
    texts = letters([c.split() for c in contents])
    return [[(a, b, True) for a, b in found] for found in occurrences(recurring_passages(texts, anchors, copies, WINDOW), texts)]


UNITS = Units(WINDOW, GRAM, word_hashes, _cut, 8)
RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked for, kept: the words
    of each text that no repeated window of WINDOW words covers, joined by one space.

    Windows are judged on the input; one repeats if its words stand in a row anywhere else, in the same text too.
    A null text has no words; texts of fewer words than a window are left alone. Each row of docs gives one row,
    repeated ones too, null ids included; other columns are ignored."""
    spark = docs.sparkSession
    small_batches(spark)
    ranges, texts = repeated_ranges(docs, UNITS, solver, SHARD_BYTES)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, r, text in zip(batch.column("doc_id").to_pylist(), batch.column("ranges").to_pylist(), unpacked(batch.column("packed"))):
                words = text.split()
                gone, spans = covered(r, len(words))
                kept = b" ".join(words if not spans else [words[k] for k in np.flatnonzero(~gone)])
                rows.append((i, len(words), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in RESULT.split(", ")])

    return texts.join(ranges, "row_key", "left").select("doc_id", "packed", F.col("ranges").cast(RANGES).alias("ranges")).mapInArrow(over, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents outside repeated windows."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False).drop("kept")
