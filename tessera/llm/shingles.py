"""Hashed word shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession

P = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Rows in an Arrow batch that carries whole texts; some texts are long, so a batch should hold few.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of this session have more than BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def byte_rows(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def runs(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of rows whose sizes come to about `most`."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(at, i)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without \\x20 and \\x09-\\x0D) of all texts, and how many each text has."""
    split = [t.lower().split() if lower else t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for words in split for w in words), np.uint64, int(counts.sum())), counts


def shingle_hashes(texts: list[bytes], n: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of all texts, in order and with repeats, and the text each comes from.
    A text of fewer words, but some, has its whole sequence as one shingle."""
    words, counts = word_hashes(texts, lower)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    m = max(0, len(words) - n + 1)
    found = np.zeros(m, np.uint64)
    for i in range(n):
        found = found * P + words[i : i + m]
    whole = owner[:m] == owner[n - 1 : n - 1 + m]
    found, owner = found[whole], owner[:m][whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            there = counts[short] > i
            extra[there] = extra[there] * P + words[(ends - counts)[short[there]] + i]
        extra += counts[short].astype(np.uint64)
        found, owner = np.r_[found, extra], np.r_[owner, short]
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return mixed(found), owner
