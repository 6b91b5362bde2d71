"""Suffix-array deduplication by threshold-bounded interval expansion: on a Burrows-Wheeler transform, intervals
grow by backward extension, breadth first, so that common prefixes become known by increasing length; at the
threshold the expansion stops, and what is not yet known to differ is a repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.repeats import POSITION_BITS, RANGES, Units, covered, gram_hashes, repeated_ranges, unpacked
from tessera.llm.shingles import small_batches

#: Bytes of a repeated string, and of an anchor.
LENGTH, GRAM = 400, 64
#: Bytes of shorter repeats that are reported beside, where the transform meets them.
PASSAGE = 256
#: Bytes of distinct segments in one transform; a recurring anchor with more has one for itself.
SHARD_BYTES = 1_000_000
BYTE_HASH = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)


def byte_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_HASH[np.frombuffer(b"".join(texts), np.uint8)], np.fromiter(map(len, texts), np.int64, len(texts))


def _ranks(order: np.ndarray, new: np.ndarray, rank: np.ndarray) -> None:
    """Give each place the position of the first of its equals in order."""
    at = np.arange(len(order))
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))


def sorted_suffixes(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of a text of small codes, sorted by the `depth` codes that begin there; the text is a circle.
    Ranks by 8 codes, then triples of ranks, sort three times as deep each round; only ties are sorted again."""
    n = len(codes)
    wide = np.resize(codes, n + 8)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | wide[i : i + n]
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    _ranks(order, new, rank)
    done, bits = 8, max(1, n.bit_length())
    parts = 3 if 3 * bits <= 63 else 2
    while done < depth:
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))  # positions in groups of two and more
        if not len(tied):
            break
        at = order[tied]
        step = min(done, (depth - done + parts - 2) // (parts - 1))
        key = rank[at].astype(np.uint64)
        for k in range(1, parts):
            key = (key << np.uint64(bits)) | rank[(at + k * step) % n].astype(np.uint64)
        sub = np.argsort(key)
        order[tied], key = at[sub], key[sub]
        fresh = np.r_[True, key[1:] != key[:-1]]
        new[tied] = fresh
        _ranks(order, new, rank)
        done += (parts - 1) * step
    return order


def short_prefixes(order: np.ndarray, codes: np.ndarray, most: int) -> np.ndarray:
    """For each position in order but the first: how many codes its suffix shares with the one before, counted up
    to `most` (compared directly)."""
    n = len(codes)
    wide = np.resize(codes, n + most)
    shared = np.full(n, most, np.int32)
    if n:
        shared[0] = -1
    open_ = np.arange(1, n)
    for k in range(most):
        same = wide[order[open_] + k] == wide[order[open_ - 1] + k]
        shared[open_[~same]] = k
        open_ = open_[same]
    return shared


def common_prefixes(order: np.ndarray, codes: np.ndarray, length: int, seed: int = 12) -> np.ndarray:
    """How many codes each suffix shares with the one before it in order; `length` stands for as many or more, -1 for
    the first.

    Common prefixes shorter than seed are compared directly. From there intervals of strings of k codes, whose
    upper boundary has just become known, are extended to the left: the interval of c + string lies at the images
    (under the last-to-first mapping) of those positions whose preceding code is c. Where the upper boundary of
    the new interval is unknown, the strings there share k codes and no more, and the interval goes on to the
    next round. Each boundary becomes known once."""
    n = len(codes)
    if n < 2:
        return np.full(n, -1)
    seed = min(seed, length)
    known = short_prefixes(order, codes, seed)
    known[known == seed] = -2  # not yet
    before = codes[order - 1]  # the transform; order 0 takes the last code
    back = np.argsort(before, kind="stable")  # the position whose image is here
    image = np.empty(n, np.int64)
    image[back] = np.arange(n)
    # Intervals of strings of `seed` codes whose upper boundary shares exactly seed - 1.
    starts = np.flatnonzero(known != -2)
    ends = np.r_[starts[1:], n]
    shared_above = np.r_[known[1:], -1][ends - 1]
    pick = shared_above == seed - 1
    low, high = starts[pick], ends[pick]
    owner = np.full(n, -1, np.int64)
    for k in range(seed, length):
        if not len(low):
            break
        sizes = high - low
        which = np.repeat(np.arange(len(low)), sizes)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        owner[inside] = which
        to = np.sort(image[inside])
        source = back[to]
        own, code = owner[source], before[source]
        cut = np.r_[True, (own[1:] != own[:-1]) | (code[1:] != code[:-1]) | (to[1:] != to[:-1] + 1)]
        first = np.flatnonzero(cut)
        new_low, new_high = to[first], np.r_[to[first[1:] - 1], to[-1]] + 1
        open_ = new_high < n
        open_[open_] = known[new_high[open_]] == -2
        known[new_high[open_]] = k
        low, high = new_low[open_], new_high[open_]
    known[known == -2] = length
    return known


def repeated_starts(contents: list[bytes], length: int, rows: list[int] | None = None, passage: int | None = None) -> tuple[list[np.ndarray], list[list[tuple[int, int]]]]:
    """For each string, where a substring of so many bytes begins that begins elsewhere too, in any of them. And, if
    asked for, ranges of shorter substrings, of at least `passage` bytes, that neighbours in the order share; they
    must come from different rows, as strings of one row may overlap there."""
    joined = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    alphabet = np.unique(joined)
    codes = (np.searchsorted(alphabet, joined) + 1).astype(np.uint8)  # UTF-8 never has all byte values
    ends = np.cumsum([len(c) + 1 for c in contents]) - 1
    codes[ends] = 0  # separators, which equal no byte of a text
    order = sorted_suffixes(codes, length)
    shared = common_prefixes(order, codes, length)
    again = np.zeros(len(codes), bool)
    pair = np.flatnonzero(shared == length)
    again[order[pair]] = again[order[pair - 1]] = True
    out, at = [], 0
    for c in contents:
        out.append(np.flatnonzero(again[at : at + max(0, len(c) - length + 1)]))
        at += len(c) + 1
    if passage is None:
        return out, [[] for _ in contents]
    pair = np.flatnonzero((shared >= passage) & (shared < length))
    x, y = order[pair - 1], order[pair]
    of_x, of_y = np.searchsorted(ends, x), np.searchsorted(ends, y)
    size = np.minimum(shared[pair], np.minimum(ends[of_x] - x, ends[of_y] - y))
    own = np.array(rows)
    good = (size >= passage) & (own[of_x] != own[of_y])
    first, size, owner = np.r_[x[good], y[good]], np.r_[size[good], size[good]], np.r_[of_x[good], of_y[good]]
    by_place = np.argsort(first)
    first, owner = first[by_place], owner[by_place]
    reach = np.maximum.accumulate(first + size[by_place]) if len(first) else first
    cut = np.flatnonzero(first[1:] > reach[:-1]) + 1  # no range reaches beyond its string
    begins = np.r_[0, ends[:-1] + 1]
    short: list[list[tuple[int, int]]] = [[] for _ in contents]
    for a, b in zip(np.r_[0, cut], np.r_[cut, len(first)]):
        if a < b:
            short[owner[a]].append((int(first[a] - begins[owner[a]]), int(reach[b - 1] - begins[owner[a]])))
    return out, short


def _merged(starts: np.ndarray, length: int) -> list[tuple[int, int, bool]]:
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    first, last = starts[np.r_[0, gap + 1]].tolist(), (starts[np.r_[gap, len(starts) - 1]] + length).tolist()
    return [(a, b, True) for a, b in zip(first, last)]


def shared_around(contents: list[bytes], anchors: list[int], side: int) -> list[bool]:
    """For each segment, whether another of its anchor has the same `side` bytes behind the anchor, or before it.

    Equal strings of GRAM + 2 * side bytes or more that hold the anchor have one of these in common, so that other
    segments need not enter the transform."""
    hashes, counts = byte_hashes(contents)
    grams = gram_hashes(hashes, GRAM) >> np.uint64(POSITION_BITS)
    seen: dict[tuple[int, int, bytes], int] = {}
    around, at = [], 0
    for content, anchor, n in zip(contents, anchors, counts.tolist()):
        place = int(grams[at : at + n - GRAM + 1].argmin())  # the anchor is the least run of a segment
        own = [(anchor, 1, content[place : place + GRAM + side])] if place + GRAM + side <= n else []
        if place >= side:
            own.append((anchor, 0, content[place - side : place + GRAM]))
        for x in own:
            seen[x] = seen.get(x, 0) + 1
        around.append(own)
        at += n
    return [any(seen[x] > 1 for x in own) for own in around]


def solver(contents: list[bytes], anchors: list[int], copies: list[int], rows: list[int]) -> list[list[tuple[int, int, bool]]]:
    """Repeated bytes of segments, and shorter repeats. A segment that stands in more than one place repeats
    throughout. Segments that share too little around their anchor for a passage are left out of the transform."""
    keep = [i for i, x in enumerate(shared_around(contents, anchors, (PASSAGE - GRAM) // 2)) if x]
    found, short = repeated_starts([contents[i] for i in keep], LENGTH, [rows[i] for i in keep], PASSAGE) if keep else ([], [])
    out: list[list[tuple[int, int, bool]]] = [[] for _ in contents]
    for i, starts, more in zip(keep, found, short):
        out[i] = [*_merged(starts, LENGTH), *((a, b, False) for a, b in more)]
    return [[(0, len(c), True)] if n > 1 else x for c, n, x in zip(contents, copies, out)]


def _cut(text: bytes, places: list[tuple[int, int]]) -> list[bytes]:
    return [text[a:b] for a, b in places]


UNITS = Units(LENGTH, GRAM, byte_hashes, _cut, 1)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, kept binary"


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, n_repeated and, if asked for, kept: the
    bytes of each text that no repeated string of LENGTH bytes covers.

    n_repeated counts the removed bytes and, beside them, those of strings of PASSAGE bytes or more that another text
    has too, which stay. Of strings shorter than LENGTH only those are found whose anchor governs a window in both
    texts, so that it is a lower bound.

    Strings are judged on the input; one repeats if it begins anywhere else, in the same text too; none crosses
    texts. A null text is empty; texts shorter than LENGTH are left alone. Each row of docs gives one row, repeated
    ones too, null ids included; other columns are ignored."""
    spark = docs.sparkSession
    small_batches(spark)
    ranges, texts = repeated_ranges(docs, UNITS, solver, SHARD_BYTES)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, r, text in zip(batch.column("doc_id").to_pylist(), batch.column("ranges").to_pylist(), unpacked(batch.column("packed"))):
                kept, spans, repeated = text, 0, 0
                if r:
                    gone, spans = covered(r, len(text))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    repeated = int(covered(r, len(text), full=False)[0].sum())
                rows.append((i, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), repeated, kept if keep_text else None))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary()]
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in RESULT.split(", ")])

    return texts.join(ranges, "row_key", "left").select("doc_id", "packed", F.col("ranges").cast(RANGES).alias("ranges")).mapInArrow(over, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents outside repeated strings."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False).drop("kept")
