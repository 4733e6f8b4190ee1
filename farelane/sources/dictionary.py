"""Vehicle dictionaries: small delimited files of several layouts, each a snapshot of a day."""

from __future__ import annotations

import datetime as dt
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    columns: tuple[tuple[str, str], ...]  # header and column name
    sep: str = ";"
    encoding: str = "UTF-8"
    dated: bool = False  # the snapshot date must be given


LAYOUTS = {
    "codes": Layout((("cod_veiculo", "vehicle_code"), ("id_veiculo", "vehicle_id"))),
    "codes_old": Layout((("cod_veiculo", "vehicle_code"), ("id_veiculo", "vehicle_id")), encoding="ISO-8859-1"),
    "bus_numbers": Layout((("vehicleid", "vehicle_id"), ("numbus", "bus_number"))),
    "cars": Layout((("id", "vehicle_id"), ("carro", "bus_number"), ("obs1", "note1"), ("obs2", "note2"))),
    "cars_old": Layout((("id", "vehicle_id"), ("carro", "bus_number"), ("obs1", "note1"), ("obs2", "note2")), encoding="ISO-8859-1"),
    "devices": Layout(
        (
            ("Código", "codigo"), ("ID", "device_id"), ("Tipo de Veículo", "vehicle_type"), ("Empresa", "company"), ("Placa", "plate"),
            ("Número de Ordem", "vehicle_number"), ("Situação", "status"), ("Ação", "action"),
        ), sep=",", dated=True,
    ),
}


def _plain(header: str) -> str:
    """A header as it is compared: without a byte order mark, outer blanks and case."""
    return unicodedata.normalize("NFC", header).strip("\ufeff ").lower()


def read(spark: SparkSession, name: str, path: str, snapshot: dt.date | None = None) -> DataFrame:
    """A dictionary as text columns with snapshot_date (today unless given; the device registry needs one)."""
    layout = LAYOUTS[name]
    if layout.dated and snapshot is None:
        raise ValueError(f"{name} needs a snapshot date")
    rows = spark.read.option("header", True).option("sep", layout.sep).option("encoding", layout.encoding).option("inferSchema", False).csv(path)
    have = {_plain(c): c for c in rows.columns}
    if layout.columns and not any(_plain(h) in have for h, _ in layout.columns):
        raise ValueError(f"{path} has none of the columns of {name}: {rows.columns}")
    cols = [(rows[f"`{have[_plain(h)]}`"] if _plain(h) in have else F.lit(None).cast("string")).alias(c) for h, c in layout.columns]
    return rows.select(*cols, F.lit(snapshot or dt.date.today()).alias("snapshot_date"))
