"""Helpers shared by the training-data operators: shared scratch tables, held-out folds, safe inputs."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import folder as scratch_dir

_written: list[tuple[SparkSession, str]] = []
#: Rows that a task takes from a batch at a time, where it passes whole texts on.
ROWS_A_TIME = 256

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(task: Task) -> Task:
    """``task`` for ``mapInArrow``, with what Arrow no longer uses given back after each batch read and at the end.

    Workers outlive their tasks and stages, and Arrow's allocator keeps freed memory for itself: what one stage's peak left there
    would stand in the executor beside the next stage's numpy arrays and dictionaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()

        def read() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                pool.release_unused()

        try:
            yield from task(read())
        finally:
            pool.release_unused()

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_A_TIME) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again.

    This cuts the lineage: after a lost executor, a task rereads files instead of computing the whole past again.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/factloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release_scratch() -> None:
    """Delete the tables ``materialise`` wrote; call when results that read them have been stored."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may have ended; the folder is then the cluster's to clean
            return


atexit.register(release_scratch)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def fresh(columns: list[str]) -> str:
    """A column name that clashes with none of ``columns``."""
    name = "made"
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
