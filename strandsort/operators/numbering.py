"""Row numbers over a whole table without bringing it to one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row id has its partition above these bits, and its place in the partition below.
PLACE_BITS = 33


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in one process a temporary folder will do."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder, and read from it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``, a row's number from 0 in the order of the columns.

    Rows are dealt by ranges and sorted there, the partitions' counts, one row each, are summed up, and each row adds its
    place in the partition. The rows are written between, so that both steps see the same partitions.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    held = checkpointed(spread.withColumn("_part", F.shiftright("_id", PLACE_BITS)))
    counts = sorted((r["_part"], r["count"]) for r in held.groupBy("_part").count().collect())
    before, rows = [], 0
    for part, n in counts:
        before.append((part, rows))
        rows += n
    starts = df.sparkSession.createDataFrame(before, "_part long, _before long")
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return held.join(F.broadcast(starts), "_part").select(*df.columns, place.alias(name))
