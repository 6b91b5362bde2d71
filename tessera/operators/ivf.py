"""Nearest vectors by an inverted file: vectors are dealt to lists around centroids, a search looks into the lists
nearest to it, and what it finds there is scored exactly. With all lists it is an exact search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import ranked
from tessera.session import written

#: Rows of the sample on which centroids are fitted, and searches on which the number of probes is measured.
SAMPLE_ROWS, SAMPLE_SEARCHES = 20_000, 256
ROUNDS, MOST_LISTS, BLOCK_ROWS = 8, 4096, 4096
BLOCK = "list int, part int, ids binary, vectors binary"


def units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return vectors / np.maximum(np.sqrt((vectors**2).sum(1, keepdims=True)), 1e-300)


def usable(rows: DataFrame, size: int, embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of rows whose vector has this length and no null, NaN or infinite component."""
    sound = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return rows.select("vec_id", F.col(embedding).cast("array<double>").alias("embedding")).where((F.size("embedding") == size) & sound)


def fit_centroids(rows: DataFrame, lists: int, sample: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of a sample of rows, those whose ids hash least: the first are rows far from each other, then they
    move to the mean of what is nearest to them. At most MOST_LISTS, and no more than sampled rows; at least one."""
    held = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    if not held:
        return np.zeros((1, 1))
    own = units(np.array([r.embedding for r in held]))
    lists = max(1, min(lists, MOST_LISTS, len(own)))
    centres = own[np.linspace(0, len(own) - 1, lists).astype(int)]
    for _ in range(rounds):
        near = (own @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, own)
        centres = np.where(np.bincount(near, minlength=lists)[:, None] > 0, units(sums), centres)
    return centres


def _dealt(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(list, vec_id, embedding): each row in its `probes` nearest lists."""
    held = rows.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = units(np.array(batch.column(1).to_pylist())) @ held.value.T
            lists = np.argsort(-near, 1, kind="stable")[:, :probes].astype(np.int32)
            at = np.repeat(np.arange(batch.num_rows), lists.shape[1])
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(lists.ravel()), rows.column(0), rows.column(1)], names=["list", "vec_id", "embedding"])

    return rows.mapInArrow(assign, "list int, vec_id long, embedding array<double>")


def _blocks(dealt: DataFrame) -> DataFrame:
    """Rows of a list in records of up to BLOCK_ROWS. Lists are cut into parts of about that many rows by id, so that a
    list that holds much of the table is many keys."""
    parts = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts"))
    cut = dealt.join(F.broadcast(parts), "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "embedding")
    cut = cut.repartition("list", "part").sortWithinPartitions("list", "part", "vec_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.concatenate(ids).astype(np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(vectors).tobytes()], pa.binary())], names=["list", "part", "ids", "vectors"])
        for batch in batches:
            lists, numbers = (batch.column(c).to_numpy() for c in (0, 1))
            edges = np.flatnonzero(np.r_[True, (lists[1:] != lists[:-1]) | (numbers[1:] != numbers[:-1])]) if batch.num_rows else []
            for a, b in zip(edges, [*edges[1:], batch.num_rows]):
                now = (int(lists[a]), int(numbers[a]))
                if key is not None and (now != key or sum(map(len, ids)) >= BLOCK_ROWS):
                    yield row()
                    ids, vectors = [], []
                key = now
                ids.append(batch.column(2).slice(a, b - a).to_numpy())
                vectors.append(units(np.array(batch.column(3).slice(a, b - a).to_pylist())))
        if key is not None:
            yield row()

    return cut.mapInArrow(pack, BLOCK)


def build(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """The index: every row in its nearest list, as blocks in a stored table."""
    return written(_blocks(_dealt(rows, centres, 1)))


def search(index: DataFrame, searches: DataFrame, centres: np.ndarray, most: int, probes: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): for each search (vec_id, embedding) the `most` rows of highest cosine among those
    of its `probes` nearest lists (all, if none is given), rounded to six digits; ties go to the least vec_id, and a
    search is not its own neighbour. Blocks of searches meet blocks of rows list by list, each pair in a task."""
    probes = len(centres) if probes is None else min(probes, len(centres))
    asked = _blocks(_dealt(searches, centres, probes)).select("list", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    parts = index.select("list", "part").distinct()
    asked = asked.join(F.broadcast(parts), "list")
    dim = centres.shape[1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                query_ids, query_vectors, ids, vectors = (batch.column(c)[r].as_py() for c in ("query_ids", "query_vectors", "ids", "vectors"))
                queries, own = np.frombuffer(query_ids, np.int64), np.frombuffer(ids, np.int64)
                scores = np.round(np.frombuffer(query_vectors).reshape(-1, dim) @ np.frombuffer(vectors).reshape(-1, dim).T, 6)
                scores[queries[:, None] == own] = -np.inf
                order = np.argsort(own, kind="stable")
                best = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :most]]
                values = np.take_along_axis(scores, best, 1)
                good = values > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, best.shape[1])[good.ravel()]), pa.array(own[best][good]), pa.array(values[good])], names=["query_id", "vec_id", "score"])

    pairs = asked.join(index.hint("merge"), ["list", "part"]).select("query_ids", "query_vectors", "ids", "vectors")
    found = pairs.mapInArrow(score, "query_id long, vec_id long, score double")
    return ranked(found, [F.desc("score"), F.asc("vec_id")], ["query_id"], most)


def probes_for(index: DataFrame, rows: DataFrame, centres: np.ndarray, most: int, recall: float = 0.9, sample: int = SAMPLE_SEARCHES) -> int:
    """How many lists a search must look into to find `recall` of its neighbours, measured on a sample of rows as
    searches: where the lists of their true neighbours stand in the order of their own."""
    asked = written(rows.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(sample))
    true = search(index, asked, centres, most).select("query_id", F.col("vec_id").alias("near"))
    home = _dealt(rows, centres, 1).select(F.col("vec_id").alias("near"), "list")
    lists = true.join(home, "near").groupBy("query_id").agg(F.collect_list("list").alias("lists")).collect()
    own = {r.vec_id: r.embedding for r in asked.collect()}
    if not lists:
        return 1
    places = [np.argsort(np.argsort(-(units(np.array([own[r.query_id]])) @ centres.T)[0], kind="stable"))[r.lists] for r in lists]
    return int(np.quantile(np.concatenate(places), min(1.0, recall), method="higher")) + 1


def nearest(rows: DataFrame, searches: DataFrame, most: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the exact search, without an index to fit. Vectors of another length than the
    longest of the searches meet nothing."""
    size = searches.agg(F.max(F.size("embedding"))).first()[0] or 0
    one = np.full((1, max(1, size)), 1.0)
    return search(build(usable(rows, size), one), usable(searches, size), one, most)
