"""Hierarchical packing of documents into training sequences of several lengths.

A document's whole windows are cut off first. What is left of it goes to the tier of the least context size that holds
it; tiers are packed from the longest to the shortest, the gap behind a document is filled with the largest that fit
from shorter tiers, and what then stays open with the head of one that does not. Sequences are dealt to step groups of
nearly equal numbers of tokens."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import stored
from tessera.llm.shingles import small_batches

WINDOW, LEAST_WINDOW, END_ID = 4096, 256, 2
#: Tokens that a task packs at a time, and tokens of a step group.
POOL_TOKENS, STEP_TOKENS = 2_000_000, 65_536
#: Bytes of text that are encoded at a time.
TEXT_BYTES = 4_000_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"
KINDS = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
NAMES = [*(x.split()[0] for x in PIECE.split(", ")), "ids"]
#: Sequence ids of tasks that pack what others left over begin here.
SECOND = 1 << 30

Part = tuple[int | None, int, int, np.ndarray]  # doc_id, start, doc_tokens, ids


class Packer:
    """Packs parts of documents; what it has packed waits in `sequences` as (tier, parts without ids)."""

    def __init__(self, window: int = WINDOW, least: int = LEAST_WINDOW):
        self.window, self.least = window, least
        self.by_size: list[list[Part]] = [[] for _ in range(window)]
        self.there = 0  # bit s: some part has s tokens
        self.tokens = 0
        self.sequences: list[tuple[int, list[tuple]]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """A document with all its ids."""
        whole = len(ids) - len(ids) % self.window
        for at in range(0, whole, self.window):
            self._close(self.window, [(doc_id, at, len(ids), ids[at : at + self.window])])
        if whole < len(ids):
            self.put((doc_id, whole, len(ids), ids[whole:].copy()))

    def put(self, part: Part) -> None:
        n = len(part[3])
        self.by_size[n].append(part)
        self.there |= 1 << n
        self.tokens += n

    def _take(self, n: int) -> Part:
        part = self.by_size[n].pop()
        if not self.by_size[n]:
            self.there ^= 1 << n
        self.tokens -= n
        return part

    def _close(self, tier: int, parts: list[Part]) -> None:
        self.sequences.append((tier, [(i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total) for i, start, total, ids in parts]))

    def pack(self) -> None:
        """Fill windows until what is left cannot fill that of its largest part."""
        while self.there:
            largest = self.there.bit_length() - 1
            tier = max(self.least, 1 << (largest - 1).bit_length())
            if self.tokens < tier:
                return
            parts, gap = [self._take(largest)], tier - largest
            while gap:
                fits = self.there & ((2 << gap) - 1)
                if fits:
                    parts.append(self._take(fits.bit_length() - 1))
                else:
                    over = self.there >> gap
                    i, start, total, ids = self._take(gap + (over & -over).bit_length() - 1)
                    parts.append((i, start, total, ids[:gap]))
                    self.put((i, start + gap, total, ids[gap:]))
                gap = tier - sum(len(p[3]) for p in parts)
            self._close(tier, parts)

    def left(self) -> list[Part]:
        """Take out all that waits to be packed."""
        parts = [p for own in self.by_size for p in own]
        self.by_size, self.there, self.tokens = [[] for _ in range(self.window)], 0, 0
        return parts

    def close_rest(self) -> None:
        """One sequence of what is left, which is less than a window."""
        if parts := self.left():
            self._close(self.window, parts[::-1])


def step_groups(sizes: list[int], step: int = STEP_TOKENS) -> list[int]:
    """The group of each sequence: the longest first, always to the group with the fewest tokens."""
    groups = [(0, k) for k in range(max(1, round(sum(sizes) / step)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        tokens, k = groups[0]
        heapq.heapreplace(groups, (tokens + sizes[i], k))
        out[i] = k
    return out


class _Rows:
    """Result rows with sequence and step ids that no other task gives."""

    def __init__(self, task: int):
        self.base, self.next_sequence, self.next_step = task << 32, 0, 0

    def of(self, packer: Packer, parts: list[Part] = ()) -> pa.RecordBatch:
        """The packer's sequences, which it forgets, and parts that another task is to pack."""
        rows = []
        sizes = [sum(p[2] for p in parts) for _, parts in packer.sequences]
        groups = step_groups(sizes)
        for (tier, own), group in zip(packer.sequences, groups):
            offset = 0
            for i, start, length, crc, total in own:
                rows.append((i, start, length, crc, total, self.base + self.next_sequence, offset, tier, self.base + self.next_step + group, None))
                offset += length
            self.next_sequence += 1
        self.next_step += max(groups, default=-1) + 1
        packer.sequences = []
        rows += [(i, start, len(ids), None, total, None, None, None, None, ids.astype("<u4").tobytes()) for i, start, total, ids in parts]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(KINDS)], names=NAMES)


def pack(docs: DataFrame, path: str | None = None, column: str = "text", doc_id: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id.

    Every task packs the documents that it reads, a bounded number of tokens at a time, and leaves less than one
    window; these rests are packed in a second round, by as many tasks as they have millions of tokens, each of which
    ends in at most one sequence that is not full. All other sequences have exactly `tier` tokens.

    A null or empty text is a document of the end id alone. Null ids stay null; rows that repeat are documents of
    their own; an empty table has no pieces. Other columns of docs are not read."""
    spark, path = docs.sparkSession, path or bpe.default_path()
    small_batches(spark)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, packer, rows = bpe.model_of(path), Packer(), _Rows(TaskContext.get().partitionId())
        for batch in _gathered(batches, TEXT_BYTES):
            ids, offsets = model.encode(batch.column(1))
            for i, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                packer.add(i, np.append(ids[a:b], end_id).astype(np.int32))
            if packer.tokens >= POOL_TOKENS:
                packer.pack()
            if packer.sequences:
                yield rows.of(packer)
        packer.pack()
        yield rows.of(packer, packer.left())
        bpe.tidy()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, rows = Packer(), _Rows(SECOND + TaskContext.get().partitionId())
        for batch in batches:
            for i, start, total, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
                packer.put((i, start, total, np.frombuffer(ids, "<u4")))
        packer.pack()
        packer.close_rest()
        yield rows.of(packer)

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
    done = stored(texts.mapInArrow(first, f"{PIECE}, ids binary"), "pieces")
    rests = done.where("ids IS NOT NULL")
    tokens = rests.agg(F.sum("length")).first()[0] or 0
    again = rests.repartition(1 + tokens // POOL_TOKENS, "doc_id", "start").sortWithinPartitions("doc_id", "start").mapInArrow(second, f"{PIECE}, ids binary")
    return done.where("ids IS NULL").unionByName(again).drop("ids")


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of about so many bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
