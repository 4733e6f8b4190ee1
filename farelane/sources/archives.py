"""Zip archives on any file system, opened by the tasks that read them."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """path of each archive, one in a partition. Only names are listed: contents stay where they are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path")
    return files.repartitionByRange(max(1, files.count()), "path")


@contextmanager
def opened(path: str) -> Iterator[zipfile.ZipFile]:
    """An archive read by ranges: its directory first, then what is asked for."""
    place, name = pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    with place.open_input_file(name) as source, zipfile.ZipFile(source) as archive:
        yield archive


def folders(spark: SparkSession, root: str) -> list[str]:
    """Full names of the folders in root, by the session's file systems."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().toString() for s in found if s.isDirectory())


def names(df: DataFrame) -> DataFrame:
    """df with the last part of its path as `file`."""
    return df.withColumn("file", F.element_at(F.split("path", "/"), -1))
