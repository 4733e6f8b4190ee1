"""Partitioned writes that can be repeated, releases as manifests, checksums, and checks of keys after a write."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bronze(df: DataFrame, root: str, source: str, by: tuple[str, ...] = ("year", "month", "day"), date: str = "event_date") -> str:
    """Overwrite just the partitions that df has; other partitions of the source stay."""
    path = f"{root}/{source}"
    parts = {"year": F.year(date), "month": F.month(date), "day": F.day(date)}
    out = df.withColumns({p: parts[p] for p in by if p not in df.columns})
    out.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return path


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """A bronze source with event_date rebuilt from its folders, where it has days."""
    rows = spark.read.parquet(path)
    return rows.withColumn("partition_date", F.make_date("year", "month", "day")) if "day" in rows.columns else rows


def replace_period(df: DataFrame, path: str, period: str) -> None:
    """Replace the periods (values of column `period`) in df and only those; running it again changes nothing."""
    df.repartition(period).sortWithinPartitions(*[c for c in df.columns if c != period][:2]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)


def partition_name(table: str, year: int, month: int, day: int | None = None) -> str:
    return f"{table}_y{year:04d}m{month:02d}" if day is None else f"{table}_d{year:04d}{month:02d}{day:02d}"


def release(spark: SparkSession, root: str, name: str, tables: dict[str, DataFrame]) -> dict[str, str]:
    """Write tables into a new version folder, then add a manifest that names it: readers see old or new, never a mix or nothing.

    Manifests are never overwritten. Each is a file of its own with the next number, created only if it isn't there yet, so of two
    writers one gets the next number after it; the highest number counts.
    """
    version, paths = uuid.uuid4().hex, {}
    for table, df in tables.items():
        paths[table] = f"{root}/versions/{version}/{table}"
        df.write.parquet(paths[table])
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/releases/{name}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    # written under another name first, so that no reader meets half a manifest
    hidden = jvm.org.apache.hadoop.fs.Path(folder, f"_{version}")
    out = files.create(hidden, False)
    out.write(bytearray(json.dumps({"name": name, "version": version, "tables": paths}).encode()))
    out.close()
    n = max(_release_numbers(files, folder), default=0) + 1
    while not files.rename(hidden, jvm.org.apache.hadoop.fs.Path(folder, f"{n:010d}.json")):
        n += 1
    return paths


def _release_numbers(files, folder) -> list[int]:
    return [int(x[:-5]) for s in files.listStatus(folder) if (x := s.getPath().getName()).endswith(".json")]


def open_release(spark: SparkSession, root: str, name: str, number: int | None = None) -> dict[str, DataFrame]:
    """Tables of a release: the newest, or the one of a number (from 1)."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/releases/{name}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = number or max(_release_numbers(files, folder))
    tables = json.loads(spark.read.text(f"{root}/releases/{name}/{n:010d}.json", wholetext=True).first()[0])["tables"]
    return {t: spark.read.parquet(p) for t, p in tables.items()}


def replace_all(df: DataFrame, path: str) -> None:
    """Replace a table's rows wholesale (truncate and load). df may read the table itself: it is written beside it first."""
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    spark.read.schema(df.schema).parquet(fresh).write.mode("overwrite").parquet(path)
    _delete(spark, fresh)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def create_as(df: DataFrame, path: str, comment: str | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """Write a query's rows as a new table, which must not exist, with comments if any; the table as read back."""
    described(df, comment, columns).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Add a query's rows to a table by column name; columns it lacks are null, columns it hasn't are refused."""
    have = df.sparkSession.read.parquet(path).schema
    unknown = set(df.columns) - set(have.names)
    if unknown:
        raise ValueError(f"{path} has no columns {sorted(unknown)}")
    df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in have]).write.mode("append").parquet(path)


def load_csv(spark: SparkSession, text: str | list[str] | DataFrame, schema: str, sep: str = ",", header: bool = False) -> DataFrame:
    """Rows of a CSV blob, of its lines, or of a table of lines (value), typed by schema; a row that doesn't fit fails."""
    if isinstance(text, DataFrame):
        rows = text
    else:
        lines = text.splitlines() if isinstance(text, str) else text
        rows = spark.createDataFrame([(x,) for x in lines[int(header) :] if x], "value string")
    parsed = rows.select(F.from_csv("value", schema, {"sep": sep, "mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


def described(df: DataFrame, comment: str | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """df whose columns carry comments (where a column comes from); they are kept in the files. A comment on the table is
    kept with its first column."""
    for name, text in (columns or {}).items():
        df = df.withMetadata(name, {**df.schema[name].metadata, "comment": text})
    if comment and df.columns:
        first = df.columns[0]
        df = df.withMetadata(first, {**df.schema[first].metadata, "table_comment": comment})
    return df


def comments(df: DataFrame) -> DataFrame:
    """(column, comment) of a table as read; column is null for the table's own."""
    rows = [(f.name, f.metadata["comment"]) for f in df.schema if "comment" in f.metadata]
    rows += [(None, f.metadata["table_comment"]) for f in df.schema if "table_comment" in f.metadata]
    return df.sparkSession.createDataFrame(rows, "column string, comment string")


def with_generated(df: DataFrame, **columns: str) -> DataFrame:
    """df with stored columns generated from others by SQL expressions; values given for them are refused."""
    given = [c for c in columns if c in df.columns]
    if given:
        raise ValueError(f"generated columns can't be given: {given}")
    return df.withColumns({c: F.expr(e) for c, e in columns.items()})


def load_then_index(df: DataFrame, path: str, by: list[str], sort: list[str], buckets: int = 0) -> DataFrame:
    """Bulk load, then what indexes are for: rows are laid out by `by` (ranges, in as many files as `buckets` if given) and sorted
    by `sort`, so file and row-group statistics let a scan skip what a filter on them can't match. Returns the column
    statistics that a planner would read: column, n, nulls, distinct (estimated), least, most."""
    laid = df.repartitionByRange(buckets, *by) if buckets else df.repartitionByRange(*by)
    laid.sortWithinPartitions(*dict.fromkeys([*by, *sort])).write.mode("overwrite").parquet(path)
    rows = df.sparkSession.read.parquet(path)
    each = [
        F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(c).alias("distinct"),
            F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("most"),
        ).alias(c) for c in dict.fromkeys([*by, *sort])
    ]
    return rows.agg(F.array(*each).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def read_feature_files(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All daily feature files (date=<day>.parquet) under path as one table, with the day from the name as `date`; columns that
    some files lack are null there."""
    rows = spark.read.option("mergeSchema", True).option("pathGlobFilter", "date=*.parquet").option("recursiveFileLookup", True).parquet(path)
    day = F.to_date(F.regexp_extract(F.col("_metadata.file_path"), r"date=(\d{4}-\d{2}-\d{2})[^/]*\.parquet", 1))
    rows = rows.withColumn("date", day)
    return rows.select(*columns) if columns else rows


def read_database(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """Rows of a database query over JDBC; partition (column, least, most, parts) reads it in several tasks."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition is None:
        return reader.option("query", query).load()
    column, least, most, parts = partition
    reader = reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", least).option("upperBound", most)
    return reader.option("numPartitions", parts).load()


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, length and SHA-256 of every file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def backfill(df: DataFrame, new: DataFrame, on: list[str], column: str, default=None) -> DataFrame:
    """df with `column` taken from new by key; rows without a match keep the default."""
    got = df.drop(column).join(new.select(*on, column), on, "left")
    return got if default is None else got.withColumn(column, F.coalesce(column, F.lit(default)))


def insert_missing(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """old and those rows of new whose key it has not; of several new rows with a key the smallest."""
    fresh = new.join(old.select(*on), on, "left_anti").select(*new.columns)
    one = fresh.groupBy(*on).agg(F.min(F.struct(*[c for c in fresh.columns if c not in on])).alias("_v")).select(*on, "_v.*")
    return old.unionByName(one)


def violations(df: DataFrame, unique: list[str] | None = None, not_null: list[str] | None = None, check: str | None = None, refers: tuple[str, DataFrame, str] | None = None) -> DataFrame:
    """(rule, n) for broken rules: duplicate keys, nulls, a false check expression, references without a target."""
    spark, parts = df.sparkSession, []
    if unique:
        parts.append(df.groupBy(*unique).count().where("count > 1").agg(F.lit(f"unique {','.join(unique)}").alias("rule"), F.count(F.lit(1)).alias("n")))
    for c in not_null or []:
        parts.append(df.agg(F.lit(f"not null {c}").alias("rule"), F.count_if(F.col(c).isNull()).alias("n")))
    if check:
        parts.append(df.agg(F.lit(f"check {check}").alias("rule"), F.count_if(~F.expr(check)).alias("n")))
    if refers:
        own, target, key = refers
        missing = df.where(F.col(own).isNotNull()).join(target.select(F.col(key).alias(own)), own, "left_anti")
        parts.append(missing.agg(F.lit(f"reference {own}").alias("rule"), F.count(F.lit(1)).alias("n")))
    out = spark.createDataFrame([], "rule string, n long")
    for p in parts:
        out = out.unionByName(p)
    return out.where("n > 0")
