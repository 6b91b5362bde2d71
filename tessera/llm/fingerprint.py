"""Document fingerprints by consistent weighted sampling: the share of equal samples of two fingerprints
estimates the generalised Jaccard similarity of their weighted terms.

Terms are five-word shingles, weighted by how often they occur."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import partitions
from tessera.llm.shingles import byte_rows, mixed, runs, shingle_hashes, small_batches

WORDS, SAMPLES, SEED = 5, 64, 20
#: Draws of (r, c, beta) in the pool from which the hash of a term and a sample's number picks.
POOL_BITS = 16
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ordered(x: np.ndarray) -> np.ndarray:
    """float32 as integers of the same order, in the high half of 64 bits."""
    bits = x.astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)


class Sampler:
    """For a term of weight w and each sample, r and c come from Gamma(2, 1) and beta from U(0, 1), by hash:
    t = floor(ln w / r + beta), y = exp(r (t - beta)), a = c / (y exp(r)). The term with the least a, with its
    t, is the sample. The draws stand in a pool that all samples share under hashes of their own; terms with
    the same draw differ by hash, so that a sample always names one term."""

    def __init__(self, samples: int = SAMPLES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        n = 1 << POOL_BITS
        self.r, self.log_c, self.beta = rng.gamma(2.0, 1.0, n), np.log(rng.gamma(2.0, 1.0, n)), rng.random(n)
        self.unit = _ordered(self.log_c + self.r * self.beta - self.r)  # ln a at w = 1, where t = 0
        self.factors = rng.integers(0, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, terms: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Samples (16 bits each) of the sets of terms that begin at starts; none may be empty."""
        out = np.empty((len(starts), len(self.factors)), np.uint16)
        low = terms & np.uint64(0xFFFFFFFF)
        heavy = np.flatnonzero(weights > 1)
        log_w = np.log(weights[heavy])
        for k, factor in enumerate(self.factors):
            at = ((terms * factor) >> np.uint64(64 - POOL_BITS)).astype(np.int64)
            key = self.unit[at]
            key |= low
            if len(heavy):
                r, beta = self.r[at[heavy]], self.beta[at[heavy]]
                t = np.floor(log_w / r + beta)
                named = mixed(low[heavy] + (t.astype(np.int64).astype(np.uint64) << np.uint64(32))) >> np.uint64(32)
                key[heavy] = _ordered(self.log_c[at[heavy]] - r * (t - beta) - r) | np.where(t == 0, low[heavy], named)
            out[:, k] = np.minimum.reduceat(key, starts) & np.uint64(0xFFFF)
        return out

    def of_texts(self, texts: list[bytes], words: int = WORDS) -> list[str]:
        """Fingerprints in hex; that of a text without words is empty."""
        found = [""] * len(texts)
        for part in runs([len(t) for t in texts], 300_000):
            terms, owner = shingle_hashes(texts[part], words)
            if not len(terms):
                continue
            order = np.lexsort((terms, owner))
            terms, owner = terms[order], owner[order]
            new = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])])
            weights = np.diff(np.r_[new, len(terms)])
            terms, owner = terms[new], owner[new]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            for i, row in zip(owner[starts], self(terms, weights, starts).astype(">u2")):
                found[part.start + i] = row.tobytes().hex()
        return found


def likeness(a: str, b: str) -> float:
    """The share of equal samples; 1 for two empty fingerprints, 0 for one."""
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(bytes.fromhex(a), np.uint16), np.frombuffer(bytes.fromhex(b), np.uint16)
    return float((x == y).mean())


_SAMPLER: list[Sampler] = []


def _sampler() -> Sampler:
    if not _SAMPLER:
        _SAMPLER.append(Sampler())
    return _SAMPLER[0]


def fingerprints(df: DataFrame, column: str = "text", to: str = "fingerprint") -> DataFrame:
    """Add `to`: the fingerprint of the text. Null and empty texts have an empty one; equal texts equal ones."""
    small_batches(df.sparkSession)

    @F.arrow_udf("string")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array(_sampler().of_texts(byte_rows(texts)), pa.string())

    return df.withColumn(to, made(F.col(column)))


def edited(text: str, following: str) -> str:
    """text, its last quarter of code points (rounded down) replaced by as many of following, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _rows(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Results for (doc_id, text, next text)."""
    texts = [t for _, t, _ in pairs]
    changed = [edited(t, f).encode() for _, t, f in pairs]
    made = _sampler().of_texts([t.encode() for t in texts] + changed + [pairs[-1][2].encode()])
    own, other, after = made[: len(pairs)], made[len(pairs) : -1], [*made[1 : len(pairs)], made[-1]]
    columns = [[i for i, *_ in pairs], list(map(len, texts)), [hashlib.sha256(x).hexdigest() for x in changed], own, other, list(map(likeness, own, other)), list(map(likeness, own, after))]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in RESULT.split(", ")])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row of a sorted partition but the last, with the row after it."""
    held: list[tuple[int | None, str]] = []
    for batch in batches:
        held += zip(batch.column(0).to_pylist(), (t or "" for t in batch.column(1).to_pylist()))
        sizes = [len(t) for _, t in held]
        for part in runs(sizes[:-1], 1_000_000):
            rows = held[part.start : part.stop + 1]
            yield _rows([(i, t, rows[k + 1][1]) for k, (i, t) in enumerate(rows[:-1])])
        held = held[-1:]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last row of a sorted partition: first_id, first_text, doc_id, text."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = first or batch.slice(0, 1).to_pylist()[0]
            last = batch.slice(batch.num_rows - 1).to_pylist()[0]
    if first is not None:
        columns = [pa.array([x], k) for x, k in ((first["doc_id"], pa.int64()), (first["text"], pa.string()), (last["doc_id"], pa.int64()), (last["text"], pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["first_id", "first_text", "doc_id", "text"])


def _closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _rows([(row["doc_id"], row["text"] or "", row["following"] or "")])


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """One row per document: n_chars, the SHA-256 of its edited text, both fingerprints, and the likeness of its
    fingerprint to the edited text's and to the next document's.

    The next document is the next by (doc_id, text), nulls first; the first follows the last. A null text is
    empty. A single row follows itself; an empty table gives an empty result. Texts are dealt out once, by ranges
    of doc_id, and sorted in their partitions; only the first and last row of each partition meet in one place,
    two for each partition, to join the ranges."""
    spark = docs.sparkSession
    small_batches(spark)
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    inner = dealt.mapInArrow(_neighbours, RESULT)
    ends = dealt.mapInArrow(_ends, "first_id long, first_text string, doc_id long, text string")
    over = Window.orderBy(F.col("first_id").asc_nulls_first())  # no two partitions share an id
    every = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    closing = ends.select("doc_id", "text", F.coalesce(F.lead("first_text").over(over), F.first("first_text").over(every)).alias("following"))
    return inner.unionByName(closing.mapInArrow(_closing, RESULT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents beside its edited text."""
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
