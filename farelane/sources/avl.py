"""Vehicle position files: headerless CSV by position, month folders, one file a day or (2018) a month."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelane.functions.scalars import all_present
from farelane.sources import archives

COLUMNS = ("direction", "latitude", "longitude", "metric_timestamp", "odometer", "route_code", "speed", "device_id", "vehicle_id")
REQUIRED = tuple(c for c in COLUMNS if c not in ("latitude", "longitude"))
TYPES = {"direction": "int", "latitude": "double", "longitude": "double", "odometer": "long", "route_code": "int", "speed": "int", "device_id": "string", "vehicle_id": "int"}
#: Portuguese month names, January first.
MONTHS = ("JANEIRO", "FEVEREIRO", "MARCO", "ABRIL", "MAIO", "JUNHO", "JULHO", "AGOSTO", "SETEMBRO", "OUTUBRO", "NOVEMBRO", "DEZEMBRO")


def read(spark: SparkSession, paths: str | list[str], header: bool = False) -> DataFrame:
    """Raw rows as text columns by position (a header line is skipped, its names ignored), with source_file.

    Short lines give nulls; longer ones lose the rest. Empty files give no rows.
    """
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    rows = spark.read.schema(schema).option("header", header).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(paths)
    return rows.withColumn("source_file", F.col("_metadata.file_name"))


def typed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): rows with all required fields and a readable time become typed; the rest keep their text and a reason.

    Pings of any file fall into their own UTC date, so a file that spills over midnight needs no special case.
    """
    at = F.try_to_timestamp("metric_timestamp", F.lit("yyyyMMddHHmmss"))
    present = all_present(*[F.col(c) for c in REQUIRED])
    wrong = [c for c in ("direction", "odometer", "route_code", "speed", "vehicle_id")]
    castable = F.expr(" and ".join(f"try_cast({c} as {TYPES[c]}) is not null" for c in wrong))
    reason = F.when(~F.coalesce(present, F.lit(False)), "missing field").when(at.isNull(), "bad time").when(~castable, "bad number")
    judged = raw.withColumns({"_reason": reason, "_at": at})
    good = judged.where("_reason is null").select(*[F.col(c).try_cast(t).alias(c) for c, t in TYPES.items()], F.col("_at").alias("metric_timestamp"), F.to_date("_at").alias("event_date"), "source_file")
    return good, judged.where("_reason is not null").select(*COLUMNS, "source_file", F.col("_reason").alias("reason"))


def month_of(folder: str) -> int | None:
    """Month of a folder named after it, whatever accents, digits and signs surround the name."""
    text = "".join(c for c in unicodedata.normalize("NFKD", folder).upper() if "A" <= c <= "Z")
    found = [i for i, name in enumerate(MONTHS, 1) if text == name]
    return found[0] if found else None


def month_folder(spark: SparkSession, root: str, year: int, month: int) -> str:
    """The folder of a month under root/year, on any file system the session reads; it must be one."""
    base = f"{root.rstrip('/')}/{year}"
    found = [d for d in archives.folders(spark, base) if month_of(d.rstrip("/").rsplit("/", 1)[-1]) == month]
    if not found:
        raise FileNotFoundError(f"no folder of month {month} in {base}")
    if len(found) > 1:
        raise ValueError(f"several folders of month {month} in {base}: {found}")
    return found[0]


def monthly_file(name: str) -> tuple[int, int] | None:
    """(year, month) of a 2018-style monthly file with a header."""
    m = re.fullmatch(r"Paint(\d{2})(2018)\.csv", name)
    return (int(m[2]), int(m[1])) if m else None
