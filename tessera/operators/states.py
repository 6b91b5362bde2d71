"""Histories of states: what a new summary says again replaces what it repeats."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 0.65, 3
# Words that say nothing about what a text is about.
DULL = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "has", "have", "had", "not", "but", "you", "your"]
ENTRY = "array<struct<at: long, summary: string, confidence: string>>"


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().replace("-", " ").replace("_", " ").split())


def stems(text: str) -> set[str]:
    words = {re.sub(r"(?<=...)(ing|ed|es|s)$", "", w) for w in re.findall(r"[a-z0-9][a-z0-9_-]+", plain(text)) if len(w) > 2}
    return {w for w in words if len(w) > 2 and w not in DULL}


def likeness(a: str, b: str) -> float:
    """0.95 if one text holds the other, else 0.4 of the stems that they share."""
    x, y = plain(a), plain(b)
    if x and y and (x in y or y in x):
        return 0.95
    s, t = stems(a), stems(b)
    return 0.4 * len(s & t) / len(s | t) if s and t else 0.0


def taken_in(entries: list[tuple], new: tuple, least: float = LEAST, most: int = MOST) -> list[tuple]:
    """Entries (at, summary, confidence) with a new one: in place of the most alike (the first of equals), if that is
    alike enough, else behind them; the last `most` stay."""
    scores = [likeness(new[1], e[1]) for e in entries]
    if scores and max(scores) >= least and plain(new[1]):
        at = scores.index(max(scores))
        return [*entries[:at], new, *entries[at + 1 :]]
    return [*entries, new][-most:]


def state_histories(updates: DataFrame, least: float = LEAST, most: int = MOST) -> DataFrame:
    """(key, entries, summary, n): the history that the updates (key, at, seq, summary, confidence) of each key leave.

    An update depends on all before it, so each key's updates pass through one task in order, which holds the few
    entries only, never the updates. Equal times go by seq; null keys have no state; null summaries are empty ones."""
    dealt = updates.where("key IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq"), F.coalesce("summary", F.lit("")).alias("summary"), "confidence")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "at", "seq", "summary")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entries, n = None, [], 0
        kind = pa.list_(pa.struct([("at", pa.int64()), ("summary", pa.string()), ("confidence", pa.string())]))
        row = lambda: (key, [dict(zip(("at", "summary", "confidence"), e)) for e in entries], " / ".join(e[1] for e in entries), n)
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), kind, pa.string(), pa.int64()))], names=["key", "entries", "summary", "n"])
        for batch in batches:
            rows = []
            for k, at, summary, confidence in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "summary", "confidence"))):
                if k != key:
                    if key is not None:
                        rows.append(row())
                    key, entries, n = k, [], 0
                entries, n = taken_in(entries, (at, summary, confidence), least, most), n + 1
            yield table(rows)
        if key is not None:
            yield table([row()])

    return dealt.mapInArrow(fold, f"key string, entries {ENTRY}, summary string, n long")
