"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime as dt
import math

import duckdb
import pandas as pd
import pytest

from farelane.plans import catalog, registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, (dt.date, pd.Timestamp)):
            return str(v)[:10]
        if hasattr(v, "item"):
            v = v.item()
        return round(v, 5) if isinstance(v, float) else v

    own = df[sorted(df.columns)]
    return sorted((tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in map(plain, r)) for r in own.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_assignment_gives_each_bus_one_device_and_each_device_one_bus(spark, duck):
    buses = {r[0] for r in duck.execute("SELECT DISTINCT lpad(CAST(l_suppkey AS VARCHAR), 5, '0') FROM lineitem").fetchall()}
    got = catalog.QUERIES["m09_global_assignment"](spark, SF).toPandas()
    assert set(got.bus_id) == buses and not got.duplicated(["date", "bus_id"]).any()
    held = got.dropna(subset=["device_id"])
    assert len(held) and not held.duplicated(["date", "device_id"]).any() and (got.margin >= -1e-9).all()


def test_owner_of_customers_whose_bus_ids_are_cut(spark, tmp_path):
    """From customer 100000 on, five digits name several customers; each trip's owner is its own."""
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        for key in ("c_custkey", "o_custkey"):
            df = df.withColumn(key, df[key] + 1000000) if key in df.columns else df
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    got = {r["trip_id"]: r["owner"] for r in catalog.QUERIES["p21_correlated_scalar"](spark, str(tmp_path)).collect()}
    orders = pd.read_parquet(f"{SF}/orders.parquet")
    lines, names = set(pd.read_parquet(f"{SF}/lineitem.parquet").l_orderkey), pd.read_parquet(f"{SF}/customer.parquet").set_index("c_custkey").c_name
    assert got == {o: names[c] for o, c in zip(orders.o_orderkey, orders.o_custkey, strict=True) if o in lines} and len(set(got.values())) > 50
