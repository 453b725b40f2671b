"""Global shuffle into shards: a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets that fit a task's memory, by a seeded hash. Pass 2 reads one bucket at
a time, puts its records in an order of their own, so that a lost executor's work comes out alike when it is done again,
and permutes them by a seeded Fisher-Yates shuffle. The buckets one after another are the shuffled sequence; running
sums of their sizes give each record its place. Record p of the sequence goes to shard p mod n as its slot p div n, so
that the shards' counts differ by one at most (law ``rows``) and every slot is filled.

The hash is over the record's id and its place in the input, so that copies of one record, however many, are scattered
like any others. The number of buckets follows the input's bytes; only their counts, one row a bucket, are summed up.

Edge cases: a null text has size 1 and an empty text's checksum; a null id is a value like any other. Repeated rows each
get a place. An empty table gives an empty result. Columns are carried whole, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandsort.llm import words as W
from strandsort.llm.common import carry, pick, put_back, table, written_table

#: Buckets are numbered in blocks, whose sums are added up before those of their members.
BLOCK = 1024
#: Buckets that a task reads, one after another, on average.
TASK_BUCKETS = 4


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def bucket_count(records: DataFrame, bucket_bytes: int, text_col: str = "text") -> int:
    total = pick(records, text=text_col).agg(F.sum(size_of(F.col("text")))).first()[0] or 0
    return max(1, -(-total // bucket_bytes))


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation: each place from the last down is swapped with one at or before it."""
    order = list(range(n))
    swaps = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = swaps[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shuffled(records: DataFrame, seed: int = 0, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_source (the records, see carry()), bucket and rank, the place in it, in shuffled order within each partition's buckets.

    There are as many tasks as let each read TASK_BUCKETS buckets, so that a task's share does not grow with the input.
    """
    buckets = bucket_count(records, bucket_bytes, text_col)
    place = carry(records, id=id_col).withColumn("at", F.monotonically_increasing_id())
    scattered = place.select("_source", F.pmod(F.xxhash64(F.lit(seed), "id", "at"), F.lit(buckets)).alias("bucket"), "at")
    schema = T.StructType([scattered.schema["_source"], T.StructField("bucket", T.LongType()), T.StructField("rank", T.LongType())])
    tasks = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // TASK_BUCKETS))

    def permuted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in W.whole_groups(batches, ["bucket"]):
            b = W.bounds(t, ["bucket"])
            for x, y in zip(b[:-1], b[1:], strict=True):
                g = t.slice(x, y - x)
                order = fisher_yates(y - x, np.random.default_rng((seed, g.column("bucket")[0].as_py())))
                for lo in range(0, y - x, 4096):
                    some = g.take(pa.array(order[lo : lo + 4096]))
                    some = some.drop_columns(["at"]).append_column("rank", pa.array(np.arange(lo, lo + some.num_rows)))
                    yield from some.combine_chunks().to_batches()

    return scattered.repartition(tasks, "bucket").sortWithinPartitions("bucket", "at").mapInArrow(permuted, schema)


def offsets(counts: DataFrame) -> DataFrame:
    """(bucket, before): how many records lie in the buckets before each, block sums first."""
    from pyspark.sql import Window

    blocks = counts.withColumn("block", F.floor(F.col("bucket") / BLOCK))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for 1024 buckets
    starts = blocks.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, "block").select("bucket", (F.col("start") + F.col("in")).alias("before"))


def sharded(records: DataFrame, shards: int, seed: int = 0, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The records with shard and slot; columns of theirs with these names get a trailing underscore. Equal counts are what is asked for, so that places need the buckets' sizes: the order is written first."""
    done = written_table(shuffled(records, seed, bucket_bytes, id_col, text_col))
    before = offsets(done.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    place = F.col("before") + F.col("rank")
    placed = done.join(F.broadcast(before) if bounded(before) else before, "bucket")
    own = [f"{x}_" if x.lower() in ("shard", "slot") else x for x in records.columns]
    return placed.select(*put_back(own), (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def bounded(rows: DataFrame, most: int = 1_000_000) -> bool:
    """Whether so few rows of two numbers may be broadcast."""
    return rows.count() <= most


def write_shards(records: DataFrame, path: str, shards: int, seed: int = 0, bucket_bytes: int = 32 << 20) -> None:
    """Parquet files under shard=<n>, in slot order within each file; a shard is written by several tasks."""
    placed = sharded(records, shards, seed, bucket_bytes)
    rows = max(1, records.count() // shards)
    parts = F.floor(F.col("slot") / F.lit(max(1, min(rows, 100_000))))
    placed.repartition(F.col("shard"), parts).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    return placed.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
