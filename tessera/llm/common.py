"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where it is unset, a temporary one, which serves a
    single machine (tests). A cluster must name its folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: later stages survive lost executors
    and do not repeat the work above."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """The text with null taken as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(id_column: str = "doc_id", column: str = "text") -> Column:
    """A key of (id, text): rows that share it have equal ids and texts, hence equal results.
    Copies under different ids get different keys, so no key gathers a group of copies."""
    return F.md5(F.concat_ws("\x1f", F.coalesce(F.col(id_column).cast("string"), F.lit("~")), F.coalesce(F.col(column), F.lit(""))))


def partitions(spark: SparkSession) -> int:
    """The number of partitions that the session deals its shuffles to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every vertex of an undirected graph with the smallest vertex it can reach.

    Alternating large-star and small-star rounds, each a grouped aggregate and a join; a round's edges are
    stored in the shared folder, and only the count of changed labels returns to the driver.
    Returns (v, label) for every vertex that has an edge; null ends and loops are ignored."""
    edges = stored(edges.where((F.col(a) != F.col(b))).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("label")).distinct(), "edges")
    before = None
    while True:
        both = edges.select("v", "label").unionByName(edges.select(F.col("label").alias("v"), F.col("v").alias("label")))
        # Stored, so that Spark can split a partition in which the neighbours of one vertex gather.
        least = stored(both.groupBy("v").agg(F.min("label").alias("low")).withColumn("low", F.least("v", "low")), "least")
        # Every neighbour of v that is larger than v moves to v's smallest neighbour (large star) ...
        large = both.join(least, "v").where(F.col("label") > F.col("v")).select(F.col("label").alias("v"), F.col("low").alias("label"))
        large = large.where(F.col("v") != F.col("label")).distinct()
        # ... and every smaller neighbour, and v itself, to the smallest of them (small star).
        small_low = large.groupBy("v").agg(F.min("label").alias("low"))
        small = large.join(small_low, "v")
        small = small.select(F.col("label").alias("v"), F.col("low").alias("label")).unionByName(small_low.select("v", F.col("low").alias("label")))
        edges = stored(small.where(F.col("v") != F.col("label")).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.hash("v", "label").cast("long")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    labelled = edges.groupBy("v").agg(F.min("label").alias("label"))
    return labelled.unionByName(edges.select(F.col("label").alias("v")).distinct().join(labelled.select("v"), "v", "left_anti").withColumn("label", F.col("v")))


def fitted_in_task(sample: DataFrame, fit: Callable[[pa.Table], Any]) -> Any:
    """What fit makes of the rows of a bounded sample, in one task: neither the rows nor what the training needs pass
    through the driver, which gets the model only."""
    schema = to_arrow_schema(sample.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit(pa.Table.from_batches([b.cast(schema) for b in batches], schema))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return fit(schema.empty_table()) if found is None else pickle.loads(found[0])  # Spark may leave out a task without rows


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator. Unlike those of withColumns they are not merged into what uses
    them, where a lambda would work them out again for each element."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))
