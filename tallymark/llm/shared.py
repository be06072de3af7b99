"""Helpers of the operators: shared tables, batches and row keys."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ROW = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session, whose tasks all run on this
    machine, may have one made for it; a cluster without the setting is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tallymark-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Shuffle files of a query go when it ends, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder and read back, and its folder. No other query reads the
    shuffle files of the write, so they are deleted with its end."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    return written(df, name, compression)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def joined_by_count(rows: DataFrame, keyed: DataFrame, key: str | list[str], count: str, hot: int = 1000) -> DataFrame:
    """``rows`` joined (inner) with ``keyed``, which has one row a key and how many of ``rows`` hold it.
    A key with more than one in ``hot`` of the rows counted is broadcast (there are fewer than ``hot`` of
    them); all others are hash-joined, so no task gets more than its share of one key."""
    on = [key] if isinstance(key, str) else key
    total = keyed.agg(F.sum(count)).first()[0] or 0
    frequent = F.broadcast(keyed.where(F.col(count) * hot > total))
    rest = keyed.where(F.col(count) * hot <= total)
    return rows.join(frequent, on).unionByName(
        rows.join(frequent.select(*on), on, "left_anti").join(rest, on)
    )


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """The rows of a table of numbers as a column of binaries."""
    size = rows.shape[1] * rows.itemsize if rows.ndim == 2 else 0
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)
    data = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def fixed_rows(column: pa.Array, kind: type) -> np.ndarray:
    """A column of binaries of one length as a table of numbers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data.reshape(len(column), -1).view(kind) if len(column) else np.zeros((0, 0), kind)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the built-in that needs no look-up."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with about ``limit`` characters each (one row at least; a row counts as
    ``ROW`` more), with their texts; null is the empty text. Bounds what a task holds, whatever the length
    and number of the rows."""
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate([*(n + ROW for n in sizes), limit]):
            if i > start and (size + n > limit or i == len(sizes)):
                part = batch.slice(start, i - start)
                yield part, [t or "" for t in part.column(text).to_pylist()]
                start, size = i, 0
            size += n


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose number (in reading order) is in ``gone``, a one-column table."""
    row = free_name(docs, "row")
    return docs.withColumn(row, F.monotonically_increasing_id()).join(gone.toDF(row), row, "left_anti").drop(row)


def part_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file (a parameter of the operators; never copied)."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
