"""Transit-shaped views of the generic test tables, in Spark and as SQL for the comparison engine.

Each view is arithmetic on stored columns, so both engines compute the same numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
START = 1704067200

_LAT = "CASE WHEN event_id % 101 = 0 THEN 0e0 WHEN event_id % 97 = 0 THEN -3.8e0 + 0.1e0 * p + 2e0 ELSE -3.8e0 + 0.1e0 * p END"
_LON = "CASE WHEN event_id % 101 = 0 THEN 0e0 WHEN event_id % 97 = 0 THEN -38.55e0 + 0.04e0 * p + 2e0 ELSE -38.55e0 + 0.04e0 * p END"


def _views(epoch: str, epoch_of: str) -> dict[str, str]:
    """epoch: seconds of events.ts with fractions; epoch_of: format for whole seconds of a timestamp column."""
    return {
        "pings": f"SELECT event_id, user_id AS trip_id, user_id % 5 AS route, concat('ep1-', lpad(CAST(user_id AS VARCHAR(20)), 6, '0')) AS device, ep, {_LAT} AS lat, {_LON} AS lon, CAST(event_id * 7 % 400 AS INT) AS heading "
        f"FROM (SELECT event_id, user_id, ep, (ep - {START}e0) / 2592000e0 + (event_id * 37 % 11 - 5) / 200e0 AS p FROM (SELECT *, {epoch} AS ep FROM events) e0) e1",
        "windows": f"SELECT event_id AS window_id, concat('ep1-', lpad(CAST(user_id AS VARCHAR(20)), 6, '0')) AS device, {epoch} AS opened, {epoch} + CASE WHEN event_id % 13 = 0 THEN -60e0 ELSE 172800e0 END AS closed FROM events WHERE event_type = 'signup'",
        "trips": "SELECT o_orderkey AS trip_id, lpad(CAST(o_custkey AS VARCHAR(20)), 5, '0') AS bus_id, concat('0', left(o_orderpriority, 1)) AS route_id, o_orderstatus AS status, CAST(o_orderkey % 3 AS INT) AS direction, "
        f"{epoch_of.format('o_orderdate')} AS opened, {epoch_of.format('last_ship')} AS closed, CAST(o_orderdate AS DATE) AS trip_date, o_totalprice AS price "
        "FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) l0 ON l_orderkey = o_orderkey",
        "taps": f"SELECT l_orderkey AS trip_id, l_linenumber AS seq, lpad(CAST(l_suppkey AS VARCHAR(20)), 4, '0') AS card, l_partkey % 25 AS stop_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS fare_cents, l_returnflag AS kind, {epoch_of.format('l_shipdate')} AS tapped, CAST(l_shipdate AS DATE) AS tap_date FROM lineitem",
        "stops": "SELECT CAST(n_nationkey AS BIGINT) AS stop_id, n_nationkey + 1 AS seq, n_name AS stop_name, CAST(n_regionkey AS BIGINT) AS zone, -3.8e0 + 0.1e0 * n_nationkey / 24e0 AS lat, -38.55e0 + 0.04e0 * n_nationkey / 24e0 AS lon FROM nation",
        "shape": "SELECT r_regionkey AS k, -3.8e0 + 0.025e0 * r_regionkey AS lat, -38.55e0 + 0.01e0 * r_regionkey + 0.002e0 * (r_regionkey % 2) AS lon FROM region",
        # five routes: each bends and ends a little differently, and skips stops of its own
        "lines": "SELECT a.r_regionkey AS route, b.r_regionkey AS k, -3.8e0 + 0.025e0 * b.r_regionkey + 0.001e0 * a.r_regionkey AS lat, -38.55e0 + 0.01e0 * b.r_regionkey + 0.002e0 * (b.r_regionkey % 2) * (a.r_regionkey - 1) AS lon FROM region a CROSS JOIN region b",
        "route_stops": "SELECT r_regionkey AS route, CAST(n_nationkey AS BIGINT) AS stop_id, n_nationkey + 1 AS seq, -3.8e0 + 0.1e0 * n_nationkey / 24e0 AS lat, -38.55e0 + 0.04e0 * n_nationkey / 24e0 AS lon FROM nation CROSS JOIN region WHERE (n_nationkey + r_regionkey) % 4 <> 0",
        "dictionary": "SELECT s_suppkey AS entry, s_name AS raw_code, CASE WHEN s_suppkey % 10 = 0 THEN 'none' ELSE concat(CAST(s_suppkey AS VARCHAR(20)), CASE WHEN s_suppkey % 3 = 0 THEN 'v' WHEN s_suppkey % 3 = 1 THEN ' - off' ELSE '' END) END AS code, s_nationkey AS source FROM supplier",
        "gtfs_times": "SELECT event_id, concat(lpad(CAST(event_id % 31 AS VARCHAR(20)), 2, '0'), ':', lpad(CAST(event_id % 60 AS VARCHAR(20)), 2, '0'), ':', lpad(CAST(event_id * 7 % 60 AS VARCHAR(20)), 2, '0')) AS clock, user_id % 40 AS route FROM events",
        "feeds": "SELECT DISTINCT left(o_orderpriority, 1) AS route, CAST(o_orderdate AS DATE) AS feed_date FROM orders",
        # about eight candidate devices for each bus on twelve dates; device numbers lie near the bus's
        "candidates": "SELECT lpad(CAST(b AS VARCHAR(20)), 5, '0') AS bus_id, make_date(2023, 11, CAST(d + 1 AS INT)) AS date, concat('ep', lpad(CAST(dev AS VARCHAR(20)), 6, '0')) AS device_id, "
        "CASE WHEN (b + dev) % 37 = 0 THEN NULL ELSE (n * 7 + dev * 3) % 11 / 10e0 END AS score, (b + dev) % 3 <> 0 AS is_model_score, n_dictionary, b % 7 = 0 AS dictionary_conflict, (b * 31 + d * 17 + dev * 7) % 23 AS h "
        "FROM (SELECT l_suppkey AS b, l_orderkey % 12 AS d, l_suppkey + l_partkey % 8 AS dev, count(*) AS n, max(CASE WHEN l_linenumber = 7 THEN 2 WHEN l_linenumber = 6 THEN 1 ELSE 0 END) AS n_dictionary FROM lineitem GROUP BY l_suppkey, l_orderkey % 12, l_suppkey + l_partkey % 8) c0",
        "bus_cells": "SELECT make_date(2023, 11, CAST(l_orderkey % 12 + 1 AS INT)) AS date, lpad(CAST(l_suppkey AS VARCHAR(20)), 5, '0') AS bus_id, l_partkey % 10 AS cell_x, l_orderkey % 20 AS cell_y, CAST(month(l_shipdate) AS INT) AS time_bucket FROM lineitem WHERE l_linenumber % 2 = 0",
        "device_cells": "SELECT make_date(2023, 11, CAST(l_orderkey % 12 + 1 AS INT)) AS date, concat('ep', lpad(CAST(l_suppkey AS VARCHAR(20)), 6, '0')) AS device_id, l_partkey % 10 AS cell_x, l_orderkey % 20 AS cell_y, CAST(month(l_shipdate) AS INT) AS time_bucket FROM lineitem WHERE l_linenumber % 2 = 1",
        "dictionary_pairs": "SELECT lpad(CAST(s_suppkey AS VARCHAR(20)), 5, '0') AS bus_id, concat('ep', lpad(CAST(s_suppkey + CASE WHEN s_suppkey % 5 = 0 THEN k ELSE s_nationkey % 3 END AS VARCHAR(20)), 6, '0')) AS device_id, concat('o', CAST(k AS VARCHAR(20))) AS origin FROM supplier CROSS JOIN (VALUES (1), (2)) AS o(k) WHERE k = 1 OR s_suppkey % 2 = 0",
        "pair_labels": "SELECT bus_id, device_id, CASE WHEN n % 3 = 0 THEN 'correct' WHEN n % 3 = 1 THEN 'wrong' ELSE 'unsure' END AS verdict, CASE WHEN n % 2 = 0 THEN 'audit' ELSE 'queue' END AS label_source, 0.85e0 + (n * 7 % 150) / 1000e0 AS model_confidence FROM (SELECT DISTINCT bus_id, device_id, CAST(bus_id AS INT) + CAST(right(device_id, 3) AS INT) AS n FROM dictionary_pairs WHERE CAST(bus_id AS INT) % 2 = 1) q",
        "pair_scores": "SELECT bus_id, device_id, max(CASE WHEN CAST(bus_id AS INT) % 11 = 0 THEN 0.001e0 WHEN h % 3 = 0 THEN 0.995e0 ELSE h / 23e0 END) AS pair_score FROM candidates GROUP BY bus_id, device_id",
        "votes": "SELECT bus_id, date, CASE WHEN h = 1 THEN NULL ELSE device_id END AS device_id, CASE h WHEN 0 THEN 'match' WHEN 1 THEN 'none_of_these' ELSE 'unsure' END AS decision FROM candidates WHERE h < 3",
        # one device a bus and day, one bus a device and day
        "assigned": "SELECT bus_id, date, device_id FROM (SELECT *, row_number() OVER (PARTITION BY bus_id, date ORDER BY s DESC, device_id) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY device_id, date ORDER BY s DESC, bus_id) AS r1 FROM (SELECT *, coalesce(score, 0e0) + CASE WHEN h % 5 = 0 THEN 0e0 ELSE (CAST(right(bus_id, 2) AS INT) + CAST(right(device_id, 2) AS INT)) % 4 END AS s FROM candidates) a0) a1 WHERE r1 = 1) a2 WHERE r2 = 1",
    }


SPARK_VIEWS = _views("unix_micros(CAST(ts AS TIMESTAMP)) / 1e6", "CAST(unix_micros(CAST({} AS TIMESTAMP)) / 1e6 AS DOUBLE)")
DUCK_VIEWS = _views("epoch_us(ts) / 1e6", "CAST(epoch_us({}) / 1e6 AS DOUBLE)")


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of the tables and bridge views in a folder; nothing to do where they stand already."""
    if getattr(spark, "_farelane_views", None) == sf_dir:
        return
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name, sql in SPARK_VIEWS.items():
        spark.sql(sql.replace("VARCHAR(20)", "STRING")).createOrReplaceTempView(name)
    spark._farelane_views = sf_dir


def view(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def duck(sql: str) -> str:
    """sql with the views that it names in front as common table expressions."""
    used, text = [], sql
    for v in reversed(DUCK_VIEWS):  # views build on earlier ones
        if re.search(rf"\b{v}\b", text):
            used.insert(0, v)
            text += DUCK_VIEWS[v]
    heads = ", ".join(f"{v} AS ({DUCK_VIEWS[v]})" for v in used)
    if not heads:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    return f"WITH {heads}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"
