"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own only where it is unset and all of Spark is in this process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = folder or tempfile.mkdtemp(prefix="spelunka-checkpoint-")
        context.setCheckpointDir(folder)
    return folder or context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: later reads survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As durable, by a table in the shared folder: the plan starts anew, without what a checkpoint knows of its origin."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a key beyond which hot_join treats it apart, and the most such keys that are broadcast.
HOT_ROWS, MAX_HOT_KEYS = 1000, 1_000_000


def hot_join(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """many joined with few (key, unique, and n: how many rows of many have it) on key. Keys with very many rows are
    broadcast, after they have been counted, so that no task gets all rows of one; the others are shuffled."""
    hot = few.where(F.col("n") > HOT_ROWS).drop("n")
    count = hot.count()
    if count == 0 or count > MAX_HOT_KEYS:
        return many.join(few.drop("n"), key)
    cold = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(few.where(F.col("n") <= HOT_ROWS).drop("n"), key)
    return many.join(F.broadcast(hot), key).unionByName(cold)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo folds; null ids fall into no fold of their own (-1)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


#: Rows and bytes of text that a Python task takes at a time.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that none holds more than that many rows, or more than about size bytes of text unless one row does."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        start = 0
        while start < batch.num_rows:
            stop = min(batch.num_rows, start + rows)
            while stop - start > 1 and column.slice(start, stop - start).nbytes > size:
                stop = start + (stop - start) // 2
            yield batch.slice(start, stop - start)
            start = stop


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores more as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def map_texts(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """mapInArrow; work takes an iterator of record batches."""
    return df.mapInArrow(work, schema)
