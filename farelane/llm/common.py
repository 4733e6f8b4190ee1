"""Shared folders, intermediate tables and counting helpers of the operators in this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, on a local master, as in tests) a new local one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = getattr(spark, "_farelane_shared", None) or tempfile.mkdtemp(prefix="farelane-")
        spark._farelane_shared = place
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(place)
    return place


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialize()d table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def maybe_in(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test of longs: true for all that the column holds and for few others (a Bloom filter of 16 bits a key, 4 MB at most).

    Rows that fail it need no join with keys. keys is read twice and should be a written table.
    """
    spark = keys.sparkSession
    bits = min(max(math.ceil(math.log2(16 * keys.count() + 1)), 13), 25)
    slots = keys.select(F.explode(F.array(F.col(column), F.shiftrightunsigned(column, 32))).alias("h")).select(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("h"))
    got = slots.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b")).toArrow()
    table = np.zeros(1 << bits - 6, np.int64)
    table[got.column("w").to_numpy()] = got.column("b").to_numpy()
    held = spark.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")  # loads no pandas
    def seen(key: pa.Array) -> pa.Array:
        out, h = np.ones(len(key), bool), key.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for part in (h, h >> np.uint64(32)):
            i = (part & np.uint64((1 << bits) - 1)).astype(np.int64)
            out &= (held.value[i >> 6] >> (i & 63) & 1).astype(bool)
        return pa.array(out)

    return seen


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run for mapInArrow; memory that it has freed goes back to the system when its task ends, as workers live on and count for their executor."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions_for(spark: SparkSession, n_bytes: float, each: float) -> int:
    """Partitions of about `each` bytes, at least as many as the cluster runs at once."""
    return max(int(spark.sparkContext.defaultParallelism), math.ceil(n_bytes / each))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc32_of_id(doc_id: Column) -> Column:
    """CRC-32 of the id as decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
