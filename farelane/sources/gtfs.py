"""Schedule exports: zipped CSV tables, their file names, and the nearest snapshot where a table is missing."""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelane.sources import archives

#: Columns read as dates of the form YYYYMMDD.
DATES = {"calendar": ("start_date", "end_date"), "calendar_dates": ("date",)}
#: Tables that may be taken from the nearest other export.
SUBSTITUTED = ("calendar_dates", "stop_times")
#: File names of exports, tried in order. Fixed values.
NAMES = (
    re.compile(r"exportacao_(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})\.zip$"),
    re.compile(r"exportacao ?(?P<d>\d{2})(?P<m>\d{2})(?P<y>\d{4})\.zip$"),
    re.compile(r"exportacao_(?P<d>\d{2})-(?P<m>\d{2})-(?P<y>\d{4})\.zip$"),
)
#: Years of file names that are known to be mistyped.
TYPOS = {"exportacao 05072818.zip": 2018}


def export_date(name: str) -> dt.date | None:
    """Date of an export by its file name; null if it is none of an export."""
    for pattern in NAMES:
        if m := pattern.match(name):
            return dt.date(TYPOS.get(name, int(m["y"])), int(m["m"]), int(m["d"]))
    return None


def nearest(target: dt.date, candidates: Sequence[tuple[dt.date, str]]) -> tuple[dt.date, str]:
    """The candidate of least distance in days; of two at one distance the earlier."""
    return min(candidates, key=lambda c: (abs((c[0] - target).days), c[0]))


def read_table(spark: SparkSession, path: str, table: str, columns: Sequence[str]) -> DataFrame:
    """One table of every export under path as text columns, with feed_version_date by file name; absent columns are null."""
    names = list(columns)
    schema = pa.schema([*((c, pa.string()) for c in names), ("feed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place in (p for batch in batches for p in batch.column("path").to_pylist()):
            if (day := export_date(place.rsplit("/", 1)[-1].replace("%20", " "))) is None:
                continue
            with archives.opened(place) as archive:
                if f"{table}.txt" not in archive.namelist():
                    continue
                with archive.open(f"{table}.txt") as stream:
                    rows: list[dict] = []
                    for one in csv.DictReader(io.TextIOWrapper(stream, "utf-8-sig")):
                        rows.append({c: one.get(c) or None for c in names} | {"feed": day.isoformat()})
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    out = archives.listed(spark, path).mapInArrow(run, ", ".join(f"{c} string" for c in (*names, "feed")))
    out = out.withColumn("feed_version_date", F.to_date("feed")).drop("feed")
    return out.withColumns({c: F.to_date(F.try_to_timestamp(c, F.lit("yyyyMMdd"))) for c in DATES.get(table, ()) if c in names})


def substituted(rows: DataFrame, feeds: DataFrame) -> DataFrame:
    """rows for every date of feeds: those of the nearest export that has any, stamped with copied_from_feed_version_date."""
    have = rows.select(F.col("feed_version_date").alias("have")).distinct()
    pick = feeds.select("feed_version_date").distinct().crossJoin(F.broadcast(have))  # a few hundred exports at most
    pick = pick.groupBy("feed_version_date").agg(F.min(F.struct(F.abs(F.datediff("have", "feed_version_date")).alias("n"), F.col("have"))).alias("b")).select("feed_version_date", F.col("b.have").alias("have"))
    out = pick.join(rows.withColumnRenamed("feed_version_date", "have"), "have")
    return out.withColumn("copied_from_feed_version_date", F.when(F.col("have") != F.col("feed_version_date"), F.col("have"))).drop("have")
