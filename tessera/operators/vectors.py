"""Correction of anisotropic vectors: the mean and the strongest direction of a corpus are taken out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_ROWS, ITERATIONS = 16, 30
#: Searches that go out at a time.
GROUP = 20_000
#: Scores that a task holds at a time.
CELLS = 4_000_000


def calibrate(rows: DataFrame, column: str = "embedding") -> tuple[np.ndarray, np.ndarray] | None:
    """(mean, direction) of the vectors, or none for fewer than 16 rows or two dimensions.

    Tasks add up their rows; sums and products of the dimensions (their number squared at most) meet in a grouped
    sum and then on the driver, where the power iteration runs. Vectors of another length than the first longest
    are left out, nulls too."""
    dim = rows.agg(F.max(F.size(column))).first()[0] or 0
    if dim < 2:
        return None

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, products, n = np.zeros(dim), np.zeros((dim, dim)), 0
        for part in parts:
            m = np.array([x for x in part[column] if x is not None and len(x) == dim], np.float64).reshape(-1, dim)
            total, products, n = total + m.sum(0), products + m.T @ m, n + len(m)
        values = np.r_[n, total, products.ravel()]
        yield pd.DataFrame({"i": np.arange(len(values)), "v": values})

    sums = rows.select(column).mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    n = int(sums[0])
    if n < LEAST_ROWS:
        return None
    mean = sums[1 : dim + 1] / n
    spread = sums[dim + 1 :].reshape(dim, dim) / n - np.outer(mean, mean)
    v = np.where(np.arange(dim) % 2 == 0, 1.0, -1.0) / np.sqrt(dim)
    for _ in range(ITERATIONS):
        w = spread @ v
        if np.linalg.norm(w) < 1e-12:
            break
        v = w / np.linalg.norm(w)
    return mean, v


def corrected(vector: Column, mean: np.ndarray, direction: np.ndarray) -> Column:
    """The vector less the mean, without the direction, at unit length; as it is where its length differs or
    nothing is left of it. vector must be a column, not an expression."""
    mean_c, dir_c = (F.array(*(F.lit(float(x)) for x in v)) for v in (mean, direction))
    # Spark works out what stands in a lambda anew for each element: what a whole vector shares is bound to a name first.
    bound = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    given = vector.cast("array<double>")
    unit = lambda left: bound(F.sqrt(total(F.transform(left, lambda x: x * x))), lambda norm: F.when(norm > 1e-9, F.transform(left, lambda x: x / norm)).otherwise(given))
    without = lambda centred: bound(total(F.zip_with(centred, dir_c, lambda x, d: x * d)), lambda along: bound(F.zip_with(centred, dir_c, lambda x, d: x - along * d), unit))
    return F.when(F.size(vector) == len(mean), bound(F.zip_with(vector, mean_c, lambda x, m: x.cast("double") - m), without)).otherwise(given)


def nearest(rows: DataFrame, searches: DataFrame, most: int, group: int = GROUP) -> DataFrame:
    """(query_id, vec_id, score): for each search the `most` rows (vec_id, embedding) with the highest cosine, from
    each task; the caller ranks them. A search is not its own neighbour; ties go to the least vec_id.

    Searches go out in groups of a bounded number of vectors, by way of the driver; rows are never dealt out anew.
    Null vectors, and those of another length than the first search of a group, meet nothing."""
    spark = rows.sparkSession
    n = -(-searches.count() // group)
    parts = [searches.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i) for i in range(n)]
    out = None
    for part in parts:
        asked = part.select("vec_id", "embedding").where("embedding IS NOT NULL").orderBy("vec_id").toPandas()
        if not len(asked):
            continue
        size = len(asked["embedding"].iloc[0])
        asked = asked[[len(x) == size for x in asked["embedding"]]]
        held = spark.sparkContext.broadcast((asked["vec_id"].to_numpy(), _units(np.stack(asked["embedding"]))))

        def near(batches: Iterator[pd.DataFrame], held=held, size=size) -> Iterator[pd.DataFrame]:
            ids, units = held.value
            floor = np.full(len(ids), -np.inf)
            best = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
            for batch in batches:
                batch = batch[[x is not None and len(x) == size for x in batch["embedding"]]].sort_values("vec_id")
                if not len(batch):
                    continue
                own, vectors = batch["vec_id"].to_numpy(), _units(np.stack(batch["embedding"])).T
                parts, step, cut = [best], max(1, CELLS // len(own)), len(own) - most
                for k in range(0, len(ids), step):  # so many searches at a time that their scores stay bounded
                    scores = np.round(units[k : k + step] @ vectors, 6)
                    scores[ids[k : k + step, None] == own] = -np.inf
                    least = np.partition(scores, cut, axis=1)[:, cut] if cut > 0 else np.full(len(scores), -np.inf)
                    of, at = np.nonzero((scores >= np.maximum(least, floor[k : k + step])[:, None]) & (scores > -np.inf))
                    parts.append(_first(pd.DataFrame({"query_id": ids[k + of], "vec_id": own[at], "score": scores[of, at]}), most))
                best = _first(pd.concat(parts), most)
                full = best.groupby("query_id")["score"].agg(["size", "min"])  # what is below a full list's last has no place
                full = full[full["size"] == most]["min"]
                floor = full.reindex(ids).fillna(-np.inf).to_numpy()
            yield best

        found = rows.select("vec_id", "embedding").mapInPandas(near, "query_id long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "query_id long, vec_id long, score double") if out is None else out


def _first(found: pd.DataFrame, most: int) -> pd.DataFrame:
    """The first rows of each search by score, then vec_id."""
    return found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(most)


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
