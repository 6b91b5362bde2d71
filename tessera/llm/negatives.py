"""Hard negatives by angular triangle filtering.

Every vector keeps its angles to a few reference directions. From two vectors' angles to one reference the triangle
inequality gives an interval of the angle between them, and its cosine times both norms, with room for rounding, an
interval of their score. Only where that meets a window that is asked for are the integers multiplied."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import partitions, stored
from tessera.llm.shingles import small_batches

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
#: Directions, and rows of the sample from which they are chosen.
REFERENCES, SAMPLE_ROWS = 8, 4096
#: Rows of a block of vectors or anchors; blocks that make up one task's share; rows that a task sorts into blocks.
BLOCK_ROWS, ANCHOR_ROWS, SHARE, SORTED_ROWS = 2048, 512, 64, 65_536
#: Larger components, or longer vectors, could give scores that are no longs.
MOST, LONGEST = 2**26, 2048
ROOM = 1e-5
BLOCK = "block long, dim int, low long, high long, ids binary, labels binary, vectors binary, angles binary, windows binary"


def integers(embedding: Column) -> Column:
    """floor(256 * x) of each component, x as double; null if any is null or not finite, or too large."""
    whole = F.transform(embedding, lambda x: F.floor(256 * x.cast("double")))
    sound = F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < MOST / 256, F.lit(False)))  # NaN is larger
    return F.when(sound & (F.size(embedding) <= LONGEST), whole)


def prepared(rows: DataFrame, label: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, label, vector): the rows that take part. Of rows that share an id the least takes part, so that rows
    which repeat count once."""
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), integers(F.col(embedding)).alias("vector"))
    own = own.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    return own.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")


def directions(rows: DataFrame, n: int = REFERENCES, sample: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """By dimension, n unit vectors far from each other, chosen from a sample of the rows whose ids hash least."""
    found: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect():
        found.setdefault(len(r.vector), []).append(r.vector)
    out = {}
    for dim, vectors in found.items():
        units = _units(np.array(vectors, np.float64).reshape(len(vectors), dim))
        chosen = [units[0]]
        nearest = units @ chosen[0]
        while len(chosen) < n:
            chosen.append(units[int(np.argmin(nearest))])
            nearest = np.maximum(nearest, units @ chosen[-1])
        out[dim] = np.array(chosen)
    return out


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors**2).sum(1, keepdims=True)), 1e-300)


def angles(vectors: np.ndarray, references: dict[int, np.ndarray]) -> np.ndarray:
    """Angles of the rows of vectors to the directions of their dimension (a fixed one where the sample has none)."""
    dim = vectors.shape[1]
    own = references.get(dim)
    own = np.eye(1, dim) if own is None else own
    return np.arccos(np.clip(_units(vectors.astype(np.float64)) @ own.T, -1, 1)).astype(np.float32)


def intervals(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most cosine of vectors with angles a (n, references) and others with angles from low to high (m,
    references): two matrices (n, m)."""
    least, most = np.zeros((len(a), len(low)), np.float32), np.full((len(a), len(low)), np.pi, np.float32)
    for k in range(a.shape[1]):
        x = a[:, k, None]
        np.maximum(least, np.maximum(x - high[None, :, k], low[None, :, k] - x), out=least)
        np.minimum(most, np.minimum(x + high[None, :, k], 2 * np.float32(np.pi) - x - low[None, :, k]), out=most)
    return np.cos(np.minimum(most + ROOM, np.float32(np.pi))), np.cos(np.maximum(least - ROOM, 0))


def bounds(a: np.ndarray, a_norms: np.ndarray, low: np.ndarray, high: np.ndarray, least_norm: np.ndarray, most_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores, rounding allowed for."""
    down, up = intervals(a, low, high)
    room = ROOM * a_norms[:, None] * most_norm + 1
    return a_norms[:, None] * np.minimum(down * least_norm, down * most_norm) - room, a_norms[:, None] * np.maximum(up * least_norm, up * most_norm) + room


class Block:
    """Vectors of one dimension that a record holds."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, angles: bytes, dim: int):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(vectors, np.int32).reshape(len(self.ids), dim).astype(np.float64)
        self.angles = np.frombuffer(angles, np.float32).reshape(len(self.ids), -1)
        self.norms = np.sqrt((self.vectors**2).sum(1)).astype(np.float32)
        self.near, self.far = self.angles.min(0, keepdims=True), self.angles.max(0, keepdims=True)

    def times(self, other: Block, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Integer scores of some of own rows and some of the other's."""
        a, b = self.vectors[anchors], other.vectors[rows]
        if float(self.norms.max(initial=0)) * float(other.norms.max(initial=0)) < 2**52:
            return (a @ b.T).astype(np.int64)  # doubles hold all sums exactly
        return a.astype(np.int64) @ b.T.astype(np.int64)


def blocks(rows: DataFrame, references: dict[int, np.ndarray], size: int, name: str) -> DataFrame:
    """rows (vec_id, label, vector, windows) in records of up to `size`, near vectors of one label together. Rows are
    dealt by label and the angle to the first direction (and id), so that neither a label nor a vector is a hot key."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(references)
    n_rows = rows.count()
    first = [float(x) for x in next(iter(references.values()))[0]] if references else []
    beside = F.aggregate(F.zip_with("vector", F.array(*map(F.lit, first)).cast("array<double>"), lambda x, r: x * r), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    dealt = rows.withColumn("beside", F.coalesce(F.try_divide(beside, norm), F.lit(0.0))).repartitionByRange(partitions(spark), "label", "beside", "vec_id").drop("beside")
    small_batches(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, SORTED_ROWS):
            records = []
            lens = rows["vector"].combine_chunks().value_lengths().to_numpy()
            for dim in np.unique(lens).tolist():
                part = rows.take(pa.array(np.flatnonzero(lens == dim))).combine_chunks()
                vectors = part["vector"].combine_chunks().flatten().to_numpy().reshape(part.num_rows, dim)
                own = angles(vectors, held.value)
                ids, labels = part["vec_id"].to_numpy(), part["label"].to_numpy()
                windows = np.array([w + [-1] * (POSITIVES - len(w)) for w in part["windows"].to_pylist()], np.int64)
                order = np.lexsort((ids, own[np.arange(len(ids)), own.argmin(1)], own.argmin(1), labels))
                for b in range(0, len(order), size):
                    at = order[b : b + size]
                    records.append((int(ids[at].min()), dim, int(labels[at].min()), int(labels[at].max()), *(x[at].tobytes() for x in (ids, labels, vectors.astype(np.int32), own, windows))))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in records], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in BLOCK.split(", ")])

    return stored(dealt.coalesce(max(1, -(-n_rows // SORTED_ROWS))).select("vec_id", "label", "vector", "windows").mapInArrow(cut, BLOCK), name)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _met(anchors: DataFrame, rows: DataFrame, where: str) -> DataFrame:
    """Every pair of an anchors' block and a rows' block for which `where` holds. Shares of up to SHARE blocks of
    either side are keys, so that a task gets SHARE * SHARE pairs at most, and all keys are alike."""
    spark = rows.sparkSession
    n_rows, n_anchors = rows.count(), anchors.count()
    shares = max(1, -(-n_rows // SHARE), min(n_rows, partitions(spark)))
    salts = max(1, -(-n_anchors // SHARE))
    one = anchors.select(*(F.col(c).alias(f"a_{c}") for c in anchors.columns), F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    other = rows.drop("windows").withColumns({"share": F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int"), "salt": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))})
    return one.join(other.hint("merge"), ["salt", "share"]).where(where).drop("salt", "share")


class _Best:
    """The best rows so far, for each anchor of a block and each of its windows."""

    def __init__(self, anchors: Block, windows: np.ndarray | None, most: int):
        self.anchors, self.windows, self.most = anchors, windows, most
        n = len(anchors.ids) * (1 if windows is None else windows.shape[1])
        self.key, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(n, -np.inf)  # what a row's score must reach

    def ranges(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number, floor and ceiling of each window."""
        if self.windows is None:
            yield 0, self.floor, np.full(len(self.floor), np.inf)
        else:
            width = self.windows.shape[1]
            for w in range(width):
                p = self.windows[:, w]
                yield w, np.where(p < 0, np.inf, np.maximum(self.floor[w::width], p * (LOW / 100))), p * (HIGH / 100)

    def meet(self, rows: Block) -> None:
        a = self.anchors
        low, high = bounds(a.angles, a.norms, rows.near, rows.far, rows.norms.min(), rows.norms.max())
        some = np.zeros(len(a.ids), bool)
        for _, floor, ceiling in self.ranges():
            some |= (high[:, 0] >= floor) & (low[:, 0] <= ceiling)
        some = np.flatnonzero(some)
        if not len(some):
            return
        low, high = bounds(a.angles[some], a.norms[some], rows.angles, rows.angles, rows.norms, rows.norms)
        same = a.labels[some, None] == rows.labels[None, :]
        fits = same & (a.ids[some, None] != rows.ids[None, :]) if self.windows is None else ~same
        asked, every = np.zeros(low.shape, bool), list(self.ranges())
        for _, floor, ceiling in every:
            asked |= (high >= floor[some, None]) & (low <= ceiling[some, None])
        asked &= fits
        take = np.flatnonzero(asked.any(0))
        if not len(take):
            return
        scores, asked = a.times(rows, some, take), asked[:, take]
        width = len(every)
        for w, floor, _ in every:
            good = asked & (scores >= floor[some, None])
            if self.windows is not None:
                p = self.windows[some, w, None]
                good &= (LOW * p <= 100 * scores) & (100 * scores <= HIGH * p) & (p >= 0)
            if len(take) > self.most:  # ties with the last of the best stay for the order of ids
                good &= scores >= np.partition(np.where(good, scores, np.iinfo(np.int64).min), -self.most, 1)[:, -self.most, None]
            i, j = np.nonzero(good)
            self._add(some[i] * width + w, scores[i, j], rows.ids[take[j]])

    def _add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = np.r_[self.key, key], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.searchsorted(key, key)
        kept = np.arange(len(key)) - first < self.most
        self.key, self.score, self.id = key[kept], score[kept], ids[kept]
        full = np.flatnonzero(np.arange(len(key)) - first == self.most - 1)
        self.floor[key[full]] = score[full]

    def result(self) -> pa.RecordBatch:
        width = 1 if self.windows is None else self.windows.shape[1]
        asked = self.score if self.windows is None else self.windows[self.key // width, self.key % width]
        columns = (self.anchors.ids[self.key // width], asked, self.id, self.score)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "window", "vec_id", "score"])


def _searched(pairs: DataFrame, most: int, windowed: bool) -> DataFrame:
    """(anchor_id, window, vec_id, score): the best rows of each task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, block = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(k)[r].as_py() for k, c in enumerate(batch.schema.names)}
                if best is None or row["a_block"] != block:
                    if best is not None:
                        yield best.result()
                    anchors = Block(*(row[f"a_{c}"] for c in ("ids", "labels", "vectors", "angles", "dim")))
                    windows = np.frombuffer(row["a_windows"], np.int64).reshape(len(anchors.ids), -1)
                    best, block = _Best(anchors, windows if windowed else None, most), row["a_block"]
                best.meet(Block(*(row[c] for c in ("ids", "labels", "vectors", "angles", "dim"))))
        if best is not None:
            yield best.result()

    kept = ["a_block", *(f"a_{c}" for c in ("ids", "labels", "vectors", "angles", "dim", "windows")), "ids", "labels", "vectors", "angles", "dim"]
    return pairs.select(*kept).mapInArrow(search, "anchor_id long, window long, vec_id long, score long")


def _ranked(found: DataFrame, most: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id, label, vector)
    of prepared(), the anchors being those for which `anchors` holds.

    Scores are inner products; higher ones come first, of equal ones the smaller vec_id. An anchor's positives are the
    first `positives` other rows of its label; for each, the first `negatives` rows of other labels whose score is
    within LOW to HIGH hundredths of the positive's. Vectors of different lengths do not meet; a negative positive
    score has no negatives, one of zero those with zero. Without anchors, or in an empty table, there are no rows.
    All anchors are the query set: they meet all rows, block by block."""
    rows = stored(rows, "vectors")
    references = directions(rows)
    none = F.array().cast("array<bigint>")
    row_blocks = blocks(rows.withColumn("windows", none), references, BLOCK_ROWS, "rows")
    own = rows.where(anchors)
    same = _met(blocks(own.withColumn("windows", none), references, ANCHOR_ROWS, "anchors"), row_blocks, "a_dim = dim AND a_high >= low AND a_low <= high")
    near = stored(_ranked(_searched(same, positives, False), positives, "anchor_id").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = near.where("positive_score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("windows"))
    asking = blocks(own.join(windows, own["vec_id"] == windows["anchor_id"]).drop("anchor_id"), references, ANCHOR_ROWS, "asking")
    other = _met(asking, row_blocks, "a_dim = dim AND NOT (a_low = a_high AND low = high AND a_low = low)")
    far = _ranked(_searched(other, negatives, True), negatives, "anchor_id", "window").withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score", "window": "positive_score"})
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of embeddings; every seventh row's label is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(prepared(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label), F.col("vec_id") % 50 == 0)


SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
