import datetime as dt
import io
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from farelane.sources import afc, avl, dictionary, gtfs, sinks


def test_avl_good_and_rejected_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,-3.7,-38.5,20231101235959,10,0,20,ep1,7\n1,,,20231102000001,10,0,20,ep1,7\n1,-3.7,-38.5,bad,10,0,20,ep1,7\n1,-3.7\n1,-3.7,-38.5,20231101000000,x,0,20,ep1,7\n")
    (tmp_path / "b.csv").write_text("")
    good, bad = avl.typed(avl.read(spark, str(tmp_path)))
    assert [(r["event_date"], r["latitude"]) for r in good.orderBy("metric_timestamp").collect()] == [(dt.date(2023, 11, 1), -3.7), (dt.date(2023, 11, 2), None)]
    assert sorted(r["reason"] for r in bad.collect()) == ["bad number", "bad time", "missing field"]


def test_avl_folders_and_monthly_files(spark, tmp_path):
    for name in ("01 - Janeiro", "03_MARÇO", "notes"):
        (tmp_path / "2023" / name).mkdir(parents=True)
    assert avl.month_folder(spark, str(tmp_path), 2023, 3).endswith("03_MARÇO")
    with pytest.raises(FileNotFoundError):
        avl.month_folder(spark, str(tmp_path), 2023, 4)
    (tmp_path / "2023" / "janeiro2").mkdir()
    with pytest.raises(ValueError):
        avl.month_folder(spark, str(tmp_path), 2023, 1)
    assert avl.monthly_file("Paint072018.csv") == (2018, 7) and avl.monthly_file("x.csv") is None


LINE = 'Numero="0614" jornada="1" num_operador="77" tabela="3" hora_abertura="2023-11-01 04:50:00" hora_fechamento="2023-11-01 22:00:00"'
TRIP = 'data_hora_abertura="2023-11-01 06:00:00" data_hora_fechamento="2023-11-01 07:00:00" catraca_inicio="100" catraca_final="140" sentido="0" ponto_abertura="11" ponto_fechamento="12"'
RIDER = 'data_hora="2023-11-01 06:10:00" integracao_bum="0" integracao="N" evento="7" sigben="A" tipo="1" Matricula="01" valor_pago="4.50" valor_subsidio="0.25" valor_repasse_metro="0.00" latitude="-3.7" longitude="-38.5"'
XML = f"""<Movimentos><MovimentoDiario data_mov="2023-11-01"><Categoria Tipo="1"><Empresa Codigo="02" modalidade="o">
<Veiculo Numero="02018" validador=""><Linha {LINE}><Viagem data_hora_abertura="2023-11-01 05:00:00" data_hora_fechamento="1899-12-30 00:00:00"/>
<Viagem {TRIP}><Passageiro {RIDER}/><Passageiro evento="0" data_hora="2023-11-01 06:20:00"/></Viagem></Linha>
<Viagem data_hora_abertura="2023-11-01 08:00:00"><Passageiro evento="10"/></Viagem></Veiculo></Empresa></Categoria></MovimentoDiario></Movimentos>"""


def test_afc_levels_do_not_go_stale(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "V20231102t.zip", "w") as z:
        z.writestr("d.xml", XML)
    (tmp_path / "V2023.zip").write_bytes(b"no dump")
    rows = afc.typed(afc.read(spark, str(tmp_path))).orderBy("boarding_at").collect()
    assert len(rows) == 3 and rows[0]["line_number"] is None and rows[0]["trip_opened_at"] is not None  # no line around this one
    first, second = rows[1], rows[2]
    assert [c for c in first.asDict() if first[c] is None] == ["validator_id"] and len(afc.COLUMNS) == 31
    assert (first["line_number"], first["direction"], first["event_id"], first["fare_paid"], first["subsidy_value"], first["card_id"], first["dump_date"]) == ("0614", "0", "7", Decimal("4.50"), Decimal("0.25"), "01", dt.date(2023, 11, 2))
    assert first["boarding_at"] == dt.datetime(2023, 11, 1, 9, 10) and first["trip_closed_at"] == dt.datetime(2023, 11, 1, 10, 0)  # three hours behind UTC
    assert (first["turnstile_start"], first["turnstile_end"], second["event_id"], second["card_id"]) == (100, 140, None, None)


def test_gtfs_names_nearest_and_substitution(spark, tmp_path):
    names = {"exportacao_2023-11-10.zip": (2023, 11, 10), "exportacao25052018.zip": (2018, 5, 25), "exportacao 25052018.zip": (2018, 5, 25), "exportacao_10-11-2019.zip": (2019, 11, 10), "exportacao 05072818.zip": (2018, 7, 5)}
    assert {n: gtfs.export_date(n) for n in names} == {n: dt.date(*d) for n, d in names.items()}
    assert gtfs.export_date("gtfs_2023-11-10.zip") is None and gtfs.export_date("20231110.zip") is None
    day = dt.date
    assert gtfs.nearest(day(2022, 6, 27), [(day(2022, 4, 7), "a"), (day(2022, 8, 22), "b")])[1] == "b"
    assert gtfs.nearest(day(2022, 1, 15), [(day(2022, 1, 20), "b"), (day(2022, 1, 10), "a")])[1] == "a"
    assert gtfs.nearest(day(2022, 1, 1), [(day(2022, 3, 1), "x")])[1] == "x"
    for name, with_times in (("2023-11-10", True), ("2023-11-20", False)):
        with zipfile.ZipFile(tmp_path / f"exportacao_{name}.zip", "w") as z:
            z.writestr("calendar.txt", "service_id,start_date,end_date\n007,20231101,20231130\n")
            if with_times:
                z.writestr("stop_times.txt", "trip_id,arrival_time,stop_id\n1,25:10:00,0042\n")
    calendar = gtfs.read_table(spark, str(tmp_path), "calendar", ["service_id", "start_date", "other"])
    assert {(r["service_id"], r["start_date"], r["other"]) for r in calendar.collect()} == {("007", day(2023, 11, 1), None)}
    times = gtfs.substituted(gtfs.read_table(spark, str(tmp_path), "stop_times", ["trip_id", "arrival_time", "stop_id"]), calendar)
    assert {(r["feed_version_date"], r["copied_from_feed_version_date"], r["stop_id"]) for r in times.collect()} == {(day(2023, 11, 10), None, "0042"), (day(2023, 11, 20), day(2023, 11, 10), "0042")}


def test_dictionaries(spark, tmp_path):
    (tmp_path / "old.csv").write_bytes("cod_veiculo;id_veiculo\n02018v;ção\n".encode("latin-1"))
    row = dictionary.read(spark, "codes_old", str(tmp_path / "old.csv"), dt.date(2023, 1, 1)).first()
    assert (row["vehicle_code"], row["vehicle_id"]) == ("02018v", "ção")
    with pytest.raises(ValueError):
        dictionary.read(spark, "devices", str(tmp_path / "old.csv"))
    (tmp_path / "devices.csv").write_text("Código,ID,Tipo de Veículo,Empresa,Placa,Número de Ordem,Situação,Ação\n1,ep1,Ônibus,02,ABC1D23,02018,Ativo,Editar\n")
    row = dictionary.read(spark, "devices", str(tmp_path / "devices.csv"), dt.date(2023, 1, 1)).first()
    assert tuple(row)[:8] == ("1", "ep1", "Ônibus", "02", "ABC1D23", "02018", "Ativo", "Editar")
    with pytest.raises(ValueError):
        dictionary.read(spark, "devices", str(tmp_path / "old.csv"), dt.date(2023, 1, 1))


def test_sinks(spark, tmp_path):
    assert sinks.partition_name("avl_pings", 2023, 11) == "avl_pings_y2023m11" and sinks.partition_name("gtfs_stop_times", 2024, 3, 28) == "gtfs_stop_times_d20240328"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"abc")
    assert sinks.manifest(spark, str(tmp_path / "f")).first()["sha256"].startswith("ba7816bf")
    df = spark.createDataFrame([(1, 5), (1, 6), (None, 7)], "k int, v int")
    got = {r["rule"]: r["n"] for r in sinks.violations(df, ["k"], ["k"], "v < 7", ("v", spark.createDataFrame([(5,)], "v int"), "v")).collect()}
    assert got == {"unique k": 1, "not null k": 1, "check v < 7": 1, "reference v": 2}
    assert sinks.insert_missing(df.where("k = 1").limit(1), df, ["k"]).where(F.col("k").isNull()).count() == 1


def test_releases_are_never_absent_or_mixed(spark, tmp_path):
    one, two = (spark.createDataFrame([(k,)], "k int") for k in (1, 2))
    sinks.release(spark, str(tmp_path), "m", {"t": one})
    sinks.release(spark, str(tmp_path), "m", {"t": two})
    assert sinks.open_release(spark, str(tmp_path), "m")["t"].first()["k"] == 2 and sinks.open_release(spark, str(tmp_path), "m", 1)["t"].first()["k"] == 1
    assert sorted(p.name for p in (tmp_path / "releases" / "m").iterdir() if p.suffix == ".json") == ["0000000001.json", "0000000002.json"]


def test_tables_from_queries(spark, tmp_path):
    path = f"{tmp_path}/t"
    made = sinks.create_as(spark.createDataFrame([(1, "a")], "k int, v string"), path, "from dumps", {"v": "attribute x"})
    assert {tuple(r) for r in sinks.comments(made).collect()} == {("v", "attribute x"), (None, "from dumps")}
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.create_as(made, path)
    sinks.append(spark.createDataFrame([(2,)], "k long"), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        sinks.append(spark.createDataFrame([(2,)], "z long"), path)
    sinks.replace_all(spark.read.parquet(path).where("k = 2"), path)  # reads what it replaces
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(2, None)]
    got = sinks.load_csv(spark, "k,v\n1,x\n2,\n", "k int, v string", header=True)
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="MALFORMED"):
        sinks.load_csv(spark, ["x,y"], "k int, v string").collect()
    assert sinks.with_generated(got, w="k * 2").where("k = 1").first()["w"] == 2
    with pytest.raises(ValueError):
        sinks.with_generated(got, v="k")


def test_layout_by_ranges_prunes_and_reports(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.when(F.col("id") % 10 > 0, F.col("id")).alias("v"))
    stats = {r["column"]: r for r in sinks.load_then_index(df, f"{tmp_path}/x", ["k"], ["v"], 4).collect()}
    assert (stats["k"]["n"], stats["k"]["nulls"], stats["k"]["least"], stats["k"]["most"], stats["v"]["nulls"]) == (1000, 0, "0", "999", 100)
    files = spark.read.parquet(f"{tmp_path}/x").groupBy(F.input_file_name()).agg(F.min("k").alias("a"), F.max("k").alias("z")).orderBy("a").collect()
    assert len(files) == 4 and all(x["z"] < y["a"] for x, y in zip(files[:-1], files[1:], strict=True))


def test_feature_files_of_many_days(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"bus": ["a"], "x": [1.0]}).to_parquet(tmp_path / "date=2023-11-01.parquet")
    pd.DataFrame({"bus": ["b"], "x": [2.0], "y": [3.0]}).to_parquet(tmp_path / "date=2023-11-02.parquet")
    pd.DataFrame({"z": [1]}).to_parquet(tmp_path / "other.parquet")
    got = sinks.read_feature_files(spark, str(tmp_path), ["date", "bus", "x", "y"]).collect()
    assert sorted(map(tuple, got)) == [(dt.date(2023, 11, 1), "a", 1.0, None), (dt.date(2023, 11, 2), "b", 2.0, 3.0)]


def test_database_reads(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(100).select(F.col("id").alias("K"), (F.col("id") % 3).alias("G")).write.format("jdbc").option("url", url).options(**driver, dbtable="T").save()
    assert sinks.read_database(spark, url, "select K from T where G = 1", **driver).count() == 33
    parts = sinks.read_database(spark, url, "select K, G from T", ("K", 0, 100, 4), **driver)
    assert parts.count() == 100 and parts.rdd.getNumPartitions() == 4


def test_flatten_needs_no_root_levels():
    assert list(afc.flatten(io.BytesIO(b"<a><Passageiro evento='1'/></a>")))[0]["event_id"] == "1"
