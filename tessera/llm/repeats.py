"""Repeats of a fixed length across all documents: anchors bring equal windows together.

A window of `size` units (bytes or words) is governed by its anchor: among its runs of `gram` units the one with
the least hash, the leftmost of equals. Equal windows have equal anchors at equal distances, so that a window can
repeat only where its anchor does. Windows in a row with one anchor form a run, and the units they cover a
segment. Segments whose anchor recurs meet, each distinct one once, in the shard of their anchor, where a solver
says which of their windows repeat. The answers go back to every place where the segment stands.

An anchor may recur in very many surroundings, as in a passage that a third of all texts share. Its segments are cut
into blocks of windows by the distance of the anchor from the window's start. All windows of a block have a core in
common, and equal windows have equal cores, so that blocks are dealt out by anchor, distance and core. Where even
these groups are large, their windows are counted one by one, by hash, which no group of texts can crowd."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import partitions, row_key, stored
from tessera.llm.shingles import P, byte_rows, mixed, runs, small_batches

POSITION_BITS = 21
#: Ranges of units, end exclusive; full: of at least a window.
RANGES = "array<struct<a:int,b:int,full:boolean>>"
ARROW_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("full", pa.bool_())]))
#: An anchor, or a core, whose distinct segments have more bytes is divided.
HOT_BYTES = 4_000_000
#: Windows are dealt to blocks of size // BLOCKS distances.
BLOCKS = 6
Solver = Callable[[list[bytes], list[int], list[int], list[int]], list[list[tuple[int, int, bool]]]]


@dataclass(frozen=True)
class Units:
    """How texts are cut. hashes(texts) gives a hash for each unit of all texts and the counts of the texts;
    cut(text, [(first, end)]) gives the bytes of segments."""

    size: int
    gram: int
    hashes: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    cut: Callable[[bytes, list[tuple[int, int]]], list[bytes]]
    bytes_each: int


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k units, by doubling."""
    done, length, found, factor = None, 0, units, np.array([P])  # an array wraps around silently
    n = k
    while True:
        if n & 1:
            if done is None:
                done, length = found, 1 << (k.bit_length() - n.bit_length())
            else:
                step = 1 << (k.bit_length() - n.bit_length())
                m = len(units) - length - step + 1
                done = done[:m] * factor + found[length : length + m]
                length += step
        n >>= 1
        if not n:
            return mixed(done[: len(units) - k + 1])
        step = 1 << (k.bit_length() - n.bit_length() - 1)
        m = len(found) - step
        found = found[:m] * factor + found[step : step + m]
        factor = factor * factor


def governed(units: np.ndarray, counts: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first, last start) of the runs of windows of all texts that stand in a row; places are
    counted over all texts."""
    empty = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(units) < size:
        return empty
    grams, wide = gram_hashes(units, gram), size - gram + 1
    packed = (grams >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(grams), dtype=np.uint64)
    pad = -len(packed) % wide
    blocks = np.r_[packed, np.full(pad, np.iinfo(np.uint64).max)].reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(units) - size + 1
    at = (np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n]) & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts)[:n] - np.arange(n)  # units from here to the end of the text
    good = left >= size
    new = good.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~good[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return empty
    stop = good.copy()
    stop[:-1] &= (at[1:] != at[:-1]) | ~good[1:] | (left[:-1] == size)
    # A text's first window begins a run even where the text before ended with the same anchor place.
    return grams[at[first]], first, np.flatnonzero(stop)


def packed(column: str = "text") -> Column:
    """The text (null: empty), compressed for the way through a shuffle."""

    @F.arrow_udf("binary")
    def made(texts: pa.Array) -> pa.Array:
        pack = zstandard.ZstdCompressor(level=3)
        return pa.array([pack.compress(t) for t in byte_rows(texts)], pa.binary())

    return made(F.col(column))


def unpacked(rows: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(x, max_output_size=0) if x else b"" for x in rows.to_pylist()]


def _runs(keyed: DataFrame, units: Units) -> DataFrame:
    @F.arrow_udf("struct<n:long,anchors:array<long>,segments:array<long>,firsts:array<int>,lasts:array<int>>")
    def found(texts: pa.Array) -> pa.Array:
        own, rows = byte_rows(texts), []
        for part in runs([len(t) for t in own], 500_000):
            hashes, counts = units.hashes(own[part])
            begin = np.cumsum(counts) - counts
            ids = []
            for at in range(0, max(1, len(hashes)), 1 << 20):  # only a text of more than 2 ** 20 units is cut here
                end = min(len(hashes), at + (1 << 20) + units.size - 1)
                inner = np.minimum(np.maximum(begin + counts - at, 0), end - at) - np.minimum(np.maximum(begin - at, 0), end - at)
                a, f, l = governed(hashes[at:end], inner, units.size, units.gram)
                ids.append((a, f + at, l + at))
            anchor, first, last = (np.concatenate(x) for x in zip(*ids))
            segment = np.fromiter((xxhash.xxh3_64_intdigest(hashes[a : b + units.size].tobytes()) for a, b in zip(first, last)), np.uint64, len(first))
            edge = np.searchsorted(first, np.r_[begin, len(hashes)])
            for i in range(len(counts)):
                s = slice(edge[i], edge[i + 1])
                rows.append((int(counts[i]), anchor[s].view(np.int64), segment[s].view(np.int64), (first[s] - begin[i]).astype(np.int32), (last[s] - begin[i]).astype(np.int32)))
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        columns = list(zip(*rows)) or [[]] * 5
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["n", "anchors", "segments", "firsts", "lasts"])

    return keyed.select("row_key", found("text").alias("s")).select("row_key", "s.*")


def _segments(wanted: DataFrame, texts: DataFrame, units: Units) -> DataFrame:
    """(anchor, segment, copies, hot, row_no, content) of segments; wanted names for each a row and a place in it."""
    per_row = wanted.groupBy("row_key", "row_no").agg(F.collect_list(F.struct("anchor", "segment", "copies", "hot", "first", "last")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("cuts").to_pylist(), batch.column("row_no").to_pylist(), unpacked(batch.column("packed")))
            for cuts, row_no, text in rows:
                parts = units.cut(text, [(c["first"], c["last"] + units.size) for c in cuts])
                columns = [pa.array([c[k] for c in cuts], pa.int64()) for k in ("anchor", "segment", "copies")]
                columns += [pa.array([c["hot"] for c in cuts], pa.bool_()), pa.array([row_no] * len(cuts), pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "segment", "copies", "hot", "row_no", "content"])

    return per_row.join(texts, "row_key").select("cuts", "row_no", "packed").mapInArrow(cut, "anchor long, segment long, copies long, hot boolean, row_no long, content binary")


def _solved(segments: DataFrame, solver: Solver, most: int) -> DataFrame:
    """(anchor, segment, ranges): deal segments out by anchor, and solve them shard by shard. A shard holds whole
    anchors up to about `most` bytes. A segment that comes twice, from repeated rows, counts once."""

    def solve(held: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
        ranges = solver([x[4] for x in held], [x[0] for x in held], [x[2] for x in held], [x[3] for x in held])
        kept = [(x[0], x[1], [{"a": a, "b": b, "full": full} for a, b, full in r]) for x, r in zip(held, ranges) if r]
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], t) for i, t in enumerate((pa.int64(), pa.int64(), ARROW_RANGES))], names=["anchor", "segment", "ranges"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []
        weight = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("anchor", "segment", "copies", "row_no", "content"))):
                if held and row[:2] == held[-1][:2]:
                    continue
                if weight > most and row[0] != held[-1][0]:
                    yield solve(held)
                    held, weight = [], 0
                held.append(row)
                weight += len(row[4]) + 1
        if held:
            yield solve(held)

    return segments.repartition(partitions(segments.sparkSession), "anchor").sortWithinPartitions("anchor", "segment").mapInArrow(over, f"anchor long, segment long, ranges {RANGES}")


def _blocks(segments: DataFrame, units: Units) -> DataFrame:
    """Segments of hot anchors in blocks of windows: (key, sub, anchor, segment, copies, row_no, begin, content). key:
    hash of anchor, block and core; sub: hash of the content; begin: where it begins in the segment."""
    width, wide = max(1, units.size // BLOCKS), units.size - units.gram + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, segment, copies, row_no, content in zip(*(batch.column(k).to_pylist() for k in ("anchor", "segment", "copies", "row_no", "content"))):
                hashes, counts = units.hashes([content])
                places = gram_hashes(hashes, units.gram) >> np.uint64(POSITION_BITS)
                at, last = int(places.argmin()), int(counts[0]) - units.size  # all windows have the least one in common
                rows, cuts = [], []
                for block in range(-(-wide // width)):
                    low, high = max(0, at - (block + 1) * width + 1), min(last, at - block * width)
                    if low <= high:
                        core = hashes[at - block * width : at - (block + 1) * width + 1 + units.size]
                        key = xxhash.xxh3_64_intdigest(core.tobytes(), seed=(anchor ^ block) & (2**64 - 1))
                        rows.append((key, xxhash.xxh3_64_intdigest(hashes[low : high + units.size].tobytes()), low))
                        cuts.append((low, high + units.size))
                n = len(rows)
                key, sub, begin = zip(*rows)
                own = [np.array(x, np.uint64).view(np.int64) for x in (key, sub)]
                columns = [*own, *(np.full(n, x, np.int64) for x in (anchor, segment, copies, row_no)), np.array(begin, np.int32), units.cut(content, cuts)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:-1]), pa.array(columns[-1], pa.binary())], names=["key", "sub", "anchor", "segment", "copies", "row_no", "begin", "content"])

    return segments.mapInArrow(cut, "key long, sub long, anchor long, segment long, copies long, row_no long, begin int, content binary")


def _counted(subs: DataFrame, units: Units) -> DataFrame:
    """(anchor, segment, ranges) of segments whose windows are compared one by one, by hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, segment, copies, content in zip(*(batch.column(k).to_pylist() for k in ("anchor", "segment", "copies", "content"))):
                hashes, _ = units.hashes([content])
                n = len(hashes) - units.size + 1
                found = np.fromiter((xxhash.xxh3_64_intdigest(hashes[i : i + units.size].tobytes()) for i in range(n)), np.uint64, n).view(np.int64)
                columns = [np.full(n, anchor), np.full(n, segment), np.full(n, copies), np.arange(n, dtype=np.int32), found]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["anchor", "segment", "copies", "i", "window"])

    windows = stored(subs.select("anchor", "segment", "copies", "content").mapInArrow(cut, "anchor long, segment long, copies long, i int, window long"), "windows")
    again = stored(windows.groupBy("anchor", "window").agg(F.sum("copies").alias("n")).where("n > 1").drop("n"), "again")
    found = windows.join(again, ["anchor", "window"]).groupBy("anchor", "segment")
    return found.agg(F.collect_list(F.struct(F.col("i").alias("a"), (F.col("i") + units.size).alias("b"), F.lit(True).alias("full"))).cast(RANGES).alias("ranges"))


def _solved_hot(segments: DataFrame, units: Units, solver: Solver, most: int) -> DataFrame:
    """(anchor, segment, ranges) of segments of anchors with very many of them."""
    blocks = stored(_blocks(segments.dropDuplicates(["anchor", "segment"]), units), "blocks")
    subs = stored(blocks.groupBy("key", "sub").agg(F.sum("copies").alias("copies"), F.min(F.struct("row_no", "content")).alias("c")).select(F.col("key").alias("anchor"), F.col("sub").alias("segment"), "copies", "c.*"), "subs")
    keys = stored(subs.groupBy("anchor").agg(F.sum("copies").alias("n"), F.sum(F.length("content")).alias("weight")).where("n > 1").drop("n"), "cores")
    met = subs.join(keys, "anchor")
    found = _solved(met.where(F.col("weight") <= HOT_BYTES).drop("weight"), solver, most)
    found = stored(found.unionByName(_counted(met.where(F.col("weight") > HOT_BYTES).drop("weight"), units)), "solved")
    back = blocks.select(F.col("key"), F.col("sub"), "anchor", "segment", "begin").join(found.select(F.col("anchor").alias("key"), F.col("segment").alias("sub"), "ranges"), ["key", "sub"])
    moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("begin")).alias("a"), (r["b"] + F.col("begin")).alias("b"), r["full"].alias("full")))
    return back.groupBy("anchor", "segment").agg(F.flatten(F.collect_list(moved)).cast(RANGES).alias("ranges"))


def repeated_ranges(docs: DataFrame, units: Units, solver: Solver, shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """What repeats in docs (doc_id, text): a table row_key, ranges (of units, end exclusive, unmerged) for rows
    that have any; and a table row_key, doc_id, packed of all rows.

    Equal texts under one id share a row_key and stand in the first table once. Segments that stand in many places
    are dealt to the solver once, with their number. Tables are stored before they meet by anchor, so that Spark can
    split a partition in which one anchor gathers."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(row_key().alias("row_key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = stored(_runs(keyed, units).withColumn("row_no", F.monotonically_increasing_id()), "runs")
    places = found.select("row_no", F.explode(F.arrays_zip("anchors", "segments", "firsts", "lasts")).alias("p"))
    places = places.select("row_no", *(F.col(f"p.{a}").alias(b) for a, b in (("anchors", "anchor"), ("segments", "segment"), ("firsts", "first"), ("lasts", "last"))))
    recurring = stored(places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    places = stored(places.join(recurring, "anchor"), "places")
    distinct = stored(places.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row_no", "first", "last")).alias("p")), "distinct")
    weight = F.sum((F.col("p.last") - F.col("p.first") + units.size) * units.bytes_each)
    hot = stored(distinct.groupBy("anchor").agg(weight.alias("weight")).where(F.col("weight") > HOT_BYTES).select("anchor", F.lit(True).alias("hot")), "hot")
    keys = found.select("row_no", "row_key")
    wanted = distinct.join(hot, "anchor", "left").select("anchor", "segment", "copies", F.coalesce("hot", F.lit(False)).alias("hot"), "p.*").join(keys, "row_no")
    segments = _segments(wanted, keyed.select("row_key", packed().alias("packed")), units)
    if hot.limit(1).count():  # both kinds come from one pass over the texts
        segments = stored(segments, "segments")
        of_hot = [stored(_solved_hot(segments.where("hot"), units, solver, shard_bytes), "solved")]
    else:
        of_hot = []
    solved = stored(_solved(segments.where("NOT hot"), solver, shard_bytes), "solved")
    for more in of_hot:
        solved = solved.unionByName(more)
    moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b"), r["full"].alias("full")))
    hits = places.join(solved, ["anchor", "segment"]).select("row_no", F.explode(moved).alias("r"))
    ranges = hits.groupBy("row_no").agg(F.collect_set("r").alias("ranges")).join(keys, "row_no").select("row_key", "ranges").dropDuplicates(["row_key"])
    return ranges, keyed.select("row_key", "doc_id", packed().alias("packed"))


def covered(ranges: list[dict] | None, n: int, full: bool = True) -> tuple[np.ndarray, int]:
    """Which of n units the ranges cover, and how many maximal runs they form; without full, shorter ones count too."""
    edges = np.zeros(n + 1, np.int64)
    ranges = [r for r in ranges or () if r["full"] or not full]
    if ranges:
        np.add.at(edges, [r["a"] for r in ranges], 1)
        np.add.at(edges, [r["b"] for r in ranges], -1)
    inside = np.cumsum(edges)[:n] > 0
    return inside, int((inside[1:] & ~inside[:-1]).sum() + (n > 0 and inside[0]))
