"""Small helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as Java, Python and DuckDB patterns write it.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset a temporary one if all runs in one process, else an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there, so that later steps survive lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written_table(df: DataFrame) -> DataFrame:
    """As cut(), for rows with whole texts: a compressed columnar table in the checkpoint folder, removed when Python ends."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, and its folder with it
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names given; other columns, whatever their names, are left behind.

    Of names that differ only in case the one that is spelt as asked for is meant.
    """
    as_spelt = {f.name: i for i, f in enumerate(df.schema.fields)}
    if len({x.lower() for x in as_spelt}) < len(as_spelt):
        df = df.toDF(*[f"_{i}" for i in range(len(as_spelt))])
        columns = {new: f"_{as_spelt[old]}" for new, old in columns.items()}
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def carry(df: DataFrame, **columns: str) -> DataFrame:
    """The whole row as a struct ``_source`` of numbered fields, which no name can clash with, and the named columns under the names given."""
    place = {f.name: i for i, f in enumerate(df.schema.fields)}
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(F.struct(*flat.columns).alias("_source"), *[F.col(f"_{place[old]}").alias(new) for new, old in columns.items()])


def put_back(names: list[str], instead: dict[str, Column] | None = None) -> list[Column]:
    """The columns of rows that were carried, some of them replaced."""
    return [(instead or {}).get(x, F.col(f"_source._{i}")).alias(x) for i, x in enumerate(names)]


def behind_barrier(df: DataFrame, keep: list[str]) -> DataFrame:
    """The same rows and columns; the columns beside ``keep`` are computed once, where they are.

    A filter on a column is pushed below the projections that make it, and their expressions go with it, each as often as
    it is used. It does not pass a projection with a row id, which stays as the columns are made to depend on it.
    """
    held = df.withColumn("_barrier", F.monotonically_increasing_id())
    return held.select(*[F.col(f"`{c}`") if c in keep else F.when(F.col("_barrier") >= 0, F.col(f"`{c}`")).alias(c) for c in df.columns])


def text_key(text: Column | str) -> Column:
    """A 64-bit digest of a text as it stands: with the id, what a row is known by where ids may be null or repeated."""
    return F.xxhash64(text)
