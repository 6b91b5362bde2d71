"""N-gram Jaccard join by signature trees.

Sets that share a token of their prefixes meet in a bucket. There a signature tree over hashed bitmaps finds the
sets that may be similar enough; what it leaves connected is a cluster. In each cluster, a tree over exact
bitmaps finds the links. Buckets and clusters beyond a fixed size are cut into blocks that meet two by two."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, partitions, row_key, stored
from tessera.llm.shingles import byte_rows, mixed, runs, shingle_hashes, small_batches
from tessera.llm.signature_tree import linked_pairs, spanning

WORDS, PERCENT = 4, 85
#: Sets in a block of a bucket; sets, and shingles, in a block of a cluster.
BUCKET_BLOCK, CLUSTER_BLOCK, CLUSTER_SHINGLES = 512, 512, 250_000
SKETCH = "struct<n:long,set_key:binary,keys:array<int>,classes:array<byte>,bits:binary>"


def bit_class(n: int) -> int:
    """A set of n members has a bitmap of 2 ** class bits, n at least."""
    return min(16, max(6, (n - 1).bit_length()))


def sketch(found: np.ndarray, percent: int) -> tuple[list[int], list[int], bytes]:
    """Of a set of hashes (sorted): the keys of its buckets and their classes, and its bitmap.

    In any order two similar sets share one of their first n - ceil(percent * n / 100) + 1 members. A bucket's
    bitmaps have one width. A set that the next smaller width may hold a partner of goes there as well."""
    n = len(found)
    own = bit_class(n)
    prefix = found[: n - (percent * n + 99) // 100 + 1]
    classes = [own] + [own - 1] * (own > 6 and percent * n <= 100 << (own - 1))
    keys = np.concatenate([(mixed(prefix ^ np.uint64(c)) >> np.uint64(32)).astype(np.uint32).view(np.int32) for c in classes])
    bits = np.zeros(1 << (own - 6), np.uint64)
    at = found & np.uint64((1 << own) - 1)
    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return keys.tolist(), [c for c in classes for _ in prefix], bits.tobytes()


def folded(bits: bytes, to: int) -> np.ndarray:
    """A bitmap at 2 ** to bits: members keep their lower hash bits."""
    out = np.frombuffer(bits, np.uint64)
    while len(out) > 1 << (to - 6):
        out = out[: len(out) // 2] | out[len(out) // 2 :]
    return out


def _sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    @F.arrow_udf(SKETCH)
    def made(texts: pa.Array) -> pa.Array:
        own, rows = byte_rows(texts), []
        for part in runs([len(t) for t in own], 1_000_000):
            hashes, owner = shingle_hashes(own[part], words, lower=True)
            ends = np.searchsorted(owner, np.arange(part.stop - part.start + 1))
            for a, b in zip(ends[:-1], ends[1:]):
                found = np.unique(hashes[a:b])
                keys, classes, bits = sketch(found, percent) if len(found) else ([], [], b"")
                rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None, keys, classes, bits))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.binary()]
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["n", "set_key", "keys", "classes", "bits"])

    return docs.select("row_key", "doc_id", made("text").alias("s")).select("row_key", "doc_id", "s.*")


def _by_groups(df: DataFrame, keys: list[str], edges: Callable[[list[dict]], list[tuple[int, int]]], weigh: Callable[[dict], int], most: int) -> DataFrame:
    """Deal rows out by keys, and give runs of whole groups to edges(); a run ends beyond the weight `most`."""
    n = partitions(df.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        weight, last = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                group = tuple(row[k] for k in keys)
                if weight > most and group != last:
                    yield _edge_batch(edges(held))
                    held, weight = [], 0
                held.append(row)
                weight, last = weight + weigh(row), group
        if held:
            yield _edge_batch(edges(held))

    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(over, "a long, b long")


def _edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = sorted(set(pairs))
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def _groups(rows: list[dict], keys: list[str]) -> Iterator[list[dict]]:
    at = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or any(rows[i][k] != rows[at][k] for k in keys):
            yield rows[at:i]
            at = i


def _forest(rows: list[dict], i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    label = spanning(len(rows), i, j)
    return [(rows[k]["set_no"], rows[x]["set_no"]) for k, x in enumerate(label) if k != x]


def bucket_edges(percent: int) -> Callable[[list[dict]], list[tuple[int, int]]]:
    """Spanning edges of what may be linked within each bucket."""

    def edges(rows: list[dict]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        twos: dict[int, list[list[dict]]] = {}
        for group in _groups(rows, ["key", "class", "i", "j"]):
            if len(group) == 2:
                twos.setdefault(group[0]["class"], []).append(group)
            elif len(group) > 2:
                bits = np.stack([folded(r["bits"], r["class"]) for r in group])
                out += _forest(group, *linked_pairs(bits, np.array([r["n"] for r in group]), percent, exact=False))
        for width, pairs in twos.items():  # leaves of two sets: tested together
            x, y = (np.stack([folded(p[k]["bits"], width) for p in pairs]) for k in (0, 1))
            m, n = (np.array([p[k]["n"] for p in pairs]) for k in (0, 1))
            count = lambda z: np.bitwise_count(z).sum(1, dtype=np.int64)
            most = np.minimum(m - count(x & ~y), n - count(y & ~x))
            good = (100 + percent) * most >= percent * (m + n)
            out += [(p[0]["set_no"], p[1]["set_no"]) for p, ok in zip(pairs, good) if ok]
        return out

    return edges


def exact_bits(sets: list[np.ndarray]) -> np.ndarray:
    """Bitmaps over the members that at least two of the sets have."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    keep = counts[column] > 1
    column, owner = number[column[keep]], owner[keep]
    bits = np.zeros((len(sets), max(1, (int(number[-1]) + 64) // 64)), np.uint64)
    np.bitwise_or.at(bits, (owner, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    return bits


def cluster_edges(words: int, percent: int) -> Callable[[list[dict]], list[tuple[int, int]]]:
    """Spanning edges of the links within each cluster."""

    def edges(rows: list[dict]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for group in _groups(rows, ["label", "i", "j"]):
            if len(group) > 1:
                hashes, owner = shingle_hashes([r["text"].encode() for r in group], words, lower=True)
                ends = np.searchsorted(owner, np.arange(len(group) + 1))
                sets = [np.unique(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                out += _forest(group, *linked_pairs(exact_bits(sets), np.array([len(s) for s in sets]), percent, exact=True))
        return out

    return edges


def _in_blocks(df: DataFrame, blocks: str) -> DataFrame:
    """Put each row in a block by its set_no, and copy it to every pair (i <= j) that its block is in."""
    own = F.pmod(F.xxhash64("set_no"), F.col(blocks))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    return df.withColumn("_p", F.explode(pairs)).withColumns({"i": F.col("_p.i"), "j": F.col("_p.j")}).drop("_p", blocks)


def link_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """For each row of docs (doc_id, text): row_key, doc_id, n_shingles, set_no and component_id.

    A row's set holds the distinct shingles of its text in lower case (A-Z); two rows link when
    100 * intersection >= percent * union. component_id is the smallest doc_id that a row reaches over links,
    itself included; set_no is null for rows without words, which link with nothing, and else numbers the
    component. Null ids rank behind all others: component_id is null only where a component has no other. Rows
    with equal sets are one set throughout, however many they are."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(row_key().alias("row_key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sketches = stored(_sketches(keyed, words, percent).withColumn("no", F.monotonically_increasing_id()), "sketches")
    numbered = sketches.where("n > 0").groupBy("set_key").agg(F.min("no").alias("set_no"), F.min("doc_id").alias("least"))

    sets = sketches.where("n > 0").groupBy("set_key").agg(F.min_by(F.struct("no", "n", "keys", "classes", "bits"), "no").alias("s")).select("s.*").withColumnRenamed("no", "set_no")
    postings = sets.select("set_no", F.explode(F.arrays_zip("keys", "classes")).alias("p")).select("set_no", F.col("p.keys").alias("key"), F.col("p.classes").alias("class"))
    shared = postings.groupBy("key", "class").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BUCKET_BLOCK)).drop("count")
    met = postings.join(shared, ["key", "class"]).join(sets.select("set_no", "n", "bits"), "set_no")
    maybe = _by_groups(_in_blocks(met, "blocks"), ["key", "class", "i", "j"], bucket_edges(percent), lambda r: len(r["bits"]) + 200, 4_000_000)
    clusters = stored(connected_components(maybe.distinct()), "clusters")

    sizes = clusters.join(sketches.select(F.col("no").alias("v"), "n"), "v").groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    blocks = sizes.select("label", F.greatest(F.ceil(F.col("c") / CLUSTER_BLOCK), F.ceil(F.col("w") / CLUSTER_SHINGLES)).alias("blocks"))
    members = clusters.join(sketches.select(F.col("no").alias("v"), "row_key"), "v").join(blocks, "label").withColumnRenamed("v", "set_no")
    texts = members.join(keyed.select("row_key", "text"), "row_key").drop("row_key")
    sure = _by_groups(_in_blocks(texts, "blocks"), ["label", "i", "j"], cluster_edges(words, percent), lambda r: len(r["text"]) + 200, 2_000_000)
    linked = stored(connected_components(sure.distinct()), "linked").withColumnRenamed("v", "set_no").withColumnRenamed("label", "component")

    labelled = numbered.join(linked, "set_no", "left").withColumn("component", F.coalesce("component", "set_no"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(least, "component").select("set_key", F.col("component").alias("set_no"), "component_id")
    joined = sketches.select("row_key", "doc_id", F.col("n").alias("n_shingles"), "set_key").join(labelled, "set_key", "left")
    return joined.select("row_key", "doc_id", "n_shingles", "set_no", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies: of each component one row of its smallest doc_id stays; rows without words stay."""
    held = stored(link_rows(docs.select("doc_id", "text"), words, percent), "rows")
    first = held.where("n_shingles > 0").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("set_no").agg(F.min("row_key").alias("row_key"))
    keep = first.select("row_key").unionByName(held.where("n_shingles = 0").select("row_key").distinct())
    own = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("row_key"), (F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))
    kept = own.join(keep, "row_key", "left_semi")
    # Equal rows share their key: of those with words one stays.
    once = kept.withColumn("no", F.when(F.col("blank"), F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    return once.dropDuplicates(["row_key", "no"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between all texts of documents."""
    return link_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
