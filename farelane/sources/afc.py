"""Fare-collection dumps: zipped XML of seven nested levels, one row for each boarding."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelane.sources import archives

DUMP = re.compile(r"V(\d{4})(\d{2})(\d{2})t?\.zip$")
#: Element of each level, the outermost first, and its attributes with the columns they become. Fixed values.
LEVELS: tuple[tuple[str, dict[str, str]], ...] = (
    ("MovimentoDiario", {"data_mov": "service_date"}),
    ("Categoria", {"Tipo": "category_type"}),
    ("Empresa", {"Codigo": "company_code", "modalidade": "company_modality"}),
    ("Veiculo", {"Numero": "vehicle_number", "validador": "validator_id"}),
    ("Linha", {
        "Numero": "line_number", "jornada": "line_shift", "num_operador": "line_operator_number", "tabela": "line_fare_table",
        "hora_abertura": "line_opened_at", "hora_fechamento": "line_closed_at",
    }),
    ("Viagem", {
        "data_hora_abertura": "trip_opened_at", "data_hora_fechamento": "trip_closed_at", "catraca_inicio": "turnstile_start", "catraca_final": "turnstile_end",
        "sentido": "direction", "ponto_abertura": "stop_open", "ponto_fechamento": "stop_close",
    }),
    ("Passageiro", {
        "data_hora": "boarding_at", "integracao_bum": "integration_bum", "integracao": "integration_type", "evento": "event_id", "sigben": "sigben", "tipo": "passenger_type",
        "Matricula": "card_id", "valor_pago": "fare_paid", "valor_subsidio": "subsidy_value", "valor_repasse_metro": "metro_transfer_value", "latitude": "latitude", "longitude": "longitude",
    }),
)
COLUMNS = tuple(c for _, attrs in LEVELS for c in attrs.values())


def flatten(stream) -> Iterator[dict[str, str | None]]:
    """Boardings of one XML stream, each with what its ancestors say; empty attributes are null.

    A level that begins or ends clears itself and the deeper ones, so nothing stale is carried over a missing level.
    """
    depth = {name: i for i, (name, _) in enumerate(LEVELS)}
    context: list[dict[str, str | None]] = [{} for _ in LEVELS]
    for event, element in ET.iterparse(stream, events=("start", "end")):
        i = depth.get(element.tag)
        if i is None:
            continue
        if event == "start":
            context[i] = {c: element.attrib.get(a) or None for a, c in LEVELS[i][1].items()}
            context[i + 1 :] = [{} for _ in context[i + 1 :]]
            if i == len(LEVELS) - 1:
                row: dict[str, str | None] = dict.fromkeys(COLUMNS)
                for part in context:
                    row |= part
                yield row
        else:
            context[i:] = [{} for _ in context[i:]]
            element.clear()


def read(spark: SparkSession, path: str) -> DataFrame:
    """All dumps under path (zip files named V<date>.zip) as text columns, with dump_date. One task reads one dump, as a
    stream: neither the archive nor a member is ever held whole."""
    schema = pa.schema([*((c, pa.string()) for c in COLUMNS), ("dump", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place in (p for batch in batches for p in batch.column("path").to_pylist()):
            if not (m := DUMP.search(place.rsplit("/", 1)[-1])):
                continue
            with archives.opened(place) as archive:
                for member in archive.namelist():
                    rows: list[dict] = []
                    with archive.open(member) as stream:
                        for one in flatten(stream):
                            rows.append(one | {"dump": "-".join(m.groups())})
                            if len(rows) == 5000:
                                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                                rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    out = archives.listed(spark, path, "V*.zip").mapInArrow(run, ", ".join(f"{c} string" for c in (*COLUMNS, "dump")))
    return out.withColumn("dump_date", F.to_date("dump")).drop("dump")


def typed(raw: DataFrame, zone: str = "America/Fortaleza") -> DataFrame:
    """Local times become UTC instants, money exact decimals; ids stay text. Event id 0 means none and becomes null."""
    times = {c: F.to_utc_timestamp(F.try_to_timestamp(c), zone) for c in ("line_opened_at", "line_closed_at", "trip_opened_at", "trip_closed_at", "boarding_at")}
    money = {c: F.col(c).try_cast("decimal(10,2)") for c in ("fare_paid", "subsidy_value", "metro_transfer_value")}
    places = {c: F.col(c).try_cast("double") for c in ("latitude", "longitude")}
    counts = {c: F.col(c).try_cast("long") for c in ("turnstile_start", "turnstile_end")}
    return raw.withColumns(times | money | places | counts | {"service_date": F.to_date(F.try_to_timestamp("service_date")), "event_id": F.nullif("event_id", F.lit("0"))})
