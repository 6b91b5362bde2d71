"""Session factory shared by the tests, the bench and interactive use."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "tessera", **conf: str) -> SparkSession:
    """A local session with the settings every query of this package assumes (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores if cores != "*" else os.cpu_count()))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


GIVEN_OUT: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir. Where that is unset, a temporary folder of a
    single machine; a cluster must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    GIVEN_OUT.append(f"{found.rstrip('/')}/tessera-{uuid.uuid4().hex}")
    return GIVEN_OUT[-1]


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what reads it does not repeat the work above, nor loses it with an executor."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of more bytes have pieces enough for all cores.
FEW_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small table, which may be one piece of one file, dealt out to all cores; a large one as it is. For work on texts
    that costs more than moving them."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= FEW_BYTES else df


#: Bytes of a table (as it is stored, compressed) that one piece of it has when it is dealt by keys.
PIECE_BYTES = 4 << 20


def pieces(*tables: DataFrame) -> int:
    """How many pieces work on rows of these tables is dealt to: as many as the bytes of the files beneath ask for, so
    that a task's memory does not grow with them. Rows of unknown size get the session's number."""
    spark = tables[0].sparkSession
    leaves = [t._jdf.queryExecution().optimizedPlan().collectLeaves() for t in tables]
    sizes = [int(of.apply(i).stats().sizeInBytes()) for of in leaves for i in range(of.size())]
    size = sum(x for x in sizes if x < 1 << 60)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, -(-size // PIECE_BYTES)))


def clear_work(spark: SparkSession) -> int:
    """Delete the folders that work_dir() gave out in this process; returns how many. For the end of a job, when nothing
    reads them any more."""
    n = 0
    while GIVEN_OUT:
        path = spark._jvm.org.apache.hadoop.fs.Path(GIVEN_OUT.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
