"""Scalar functions and geometry over the bridge views."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farelane.functions import geo as G
from farelane.functions import scalars as S
from farelane.operators import relational as R
from farelane.plans.catalog import plain, query

KEY = b"demonstration key"


@query("f01_pad_short", "SELECT entry, CASE WHEN length(c) < 3 THEN lpad(c, 3, '0') ELSE c END AS code FROM (SELECT entry, CAST(entry * 37 AS VARCHAR) AS c FROM dictionary) d")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("dictionary").select("entry", S.pad_short((F.col("entry") * 37).cast("string"), 3).alias("code"))


plain("f02_left_right_case", "SELECT trip_id, left(bus_id, 2) AS company, right(bus_id, 3) AS unit, lower(status) AS state, length(bus_id) AS n FROM trips")


@query("f03_strip_zeros", "SELECT trip_id, ltrim(bus_id, '0') AS bare FROM trips")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("trips").select("trip_id", S.route_join_key(F.col("bus_id")).alias("bare"))


@query("f04_digits", "SELECT entry, CASE WHEN length(d) < 5 THEN lpad(d, 5, '0') ELSE d END AS bus_id FROM (SELECT entry, nullif(regexp_replace(raw_code, '[^0-9]', '', 'g'), '') AS d FROM dictionary) x")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("dictionary").select("entry", S.bus_code(F.col("raw_code")).alias("bus_id"))


@query("f05_gtfs_seconds", "SELECT event_id, CAST(split_part(clock, ':', 1) AS INT) * 3600 + CAST(split_part(clock, ':', 2) AS INT) * 60 + CAST(split_part(clock, ':', 3) AS INT) AS seconds FROM gtfs_times")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("gtfs_times").select("event_id", S.gtfs_seconds(F.col("clock")).alias("seconds"))


@query("f06_hour_bucket", "SELECT event_id, CAST(CAST(split_part(clock, ':', 1) AS INT) % 24 AS BIGINT) AS hour FROM gtfs_times")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("gtfs_times").select("event_id", S.hour_of_seconds(S.gtfs_seconds(F.col("clock"))).cast("long").alias("hour"))


@query("f07_sorted_labels", "SELECT trip_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM taps GROUP BY trip_id")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("taps").groupBy("trip_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("kind"))).alias("kinds"))


@query("f08_unicode_normal_form", "SELECT n_nationkey AS k, nfc_normalize(trim(n_name || 'e' || chr(769))) AS label FROM nation")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("nation").select(F.col("n_nationkey").alias("k"), S.composed(F.concat("n_name", F.lit("é "))).alias("label"))


plain("f09_parse_dates", "SELECT trip_id, to_date(s, 'yyyyMMdd') AS d, try_to_timestamp(concat(s, CASE WHEN trip_id % 3 = 0 THEN 'x' ELSE '120000' END), 'yyyyMMddHHmmss') IS NULL AS bad FROM (SELECT trip_id, date_format(trip_date, 'yyyyMMdd') AS s FROM trips) t", "SELECT trip_id, trip_date AS d, trip_id % 3 = 0 AS bad FROM trips")


@query("f10_time_zones", "SELECT trip_id, CAST((opened + 3 * 3600) AS BIGINT) AS utc_s, CAST(floor((CAST(opened AS BIGINT) - 3 * 3600) / 3600e0) AS BIGINT) % 24 AS local_hour FROM trips WHERE trip_date < DATE '1999-01-01'")
def _(spark: SparkSession) -> DataFrame:
    ts = F.timestamp_seconds("opened")
    return spark.table("trips").where("trip_date < DATE '1999-01-01'").select("trip_id", F.unix_seconds(F.to_utc_timestamp(ts, S.LOCAL_ZONE)).alias("utc_s"), F.hour(F.from_utc_timestamp(ts, S.LOCAL_ZONE)).cast("long").alias("local_hour"))


@query("f11_epoch", "SELECT event_id, epoch_us(ts) / 1e6 AS s FROM events")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("events").select("event_id", S.epoch(F.col("ts")).alias("s"))


@query("f12_weekday", "SELECT trip_id, CAST(isodow(trip_date) AS INT) AS iso_day, isodow(trip_date) >= 6 AS weekend FROM trips")
def _(spark: SparkSession) -> DataFrame:
    d = S.iso_weekday(F.col("trip_date"))
    return spark.table("trips").select("trip_id", d.alias("iso_day"), (d >= 6).alias("weekend"))


plain("f13_date_arithmetic", "SELECT trip_id, date_add(trip_date, 30) AS due, datediff(trip_date, DATE '1995-06-17') AS days FROM trips", "SELECT trip_id, trip_date + 30 AS due, CAST(trip_date - DATE '1995-06-17' AS INT) AS days FROM trips")


@query("f14_time_interpolation", "SELECT window_id, CAST(round((opened + (closed - opened) * 0.25e0) * 1e6) AS BIGINT) AS at_us FROM windows")
def _(spark: SparkSession) -> DataFrame:
    at = S.at_epoch(F.col("opened") + (F.col("closed") - F.col("opened")) * F.lit(0.25))
    return spark.table("windows").select("window_id", F.unix_micros(at).alias("at_us"))


@query("f15_three_days", "SELECT event_id, CAST(ts AS DATE) AS event_date, CAST(ts - INTERVAL 3 HOUR AS DATE) AS local_date, CAST(ts - INTERVAL 6 HOUR AS DATE) AS operational_date FROM events")
def _(spark: SparkSession) -> DataFrame:
    a, b, c = S.days(F.col("ts").cast("timestamp"))
    return spark.table("events").select("event_id", a.alias("event_date"), b.alias("local_date"), c.alias("operational_date"))


plain("f16_grid_cells", "SELECT event_id, CAST(floor(lon / 0.003e0) AS BIGINT) AS cx, CAST(floor(lat / 0.003e0) AS BIGINT) AS cy, CAST(floor(ep / 900) AS BIGINT) AS bucket FROM pings")
plain("f17_math", "SELECT event_id, round(abs(lat), 9) AS a, round(sqrt(ep), 6) AS b, round(ln(ep), 9) AS c, round(exp(lat), 9) AS d, greatest(lat, lon) AS g, least(lat, lon) AS l, round(power(lat, 2), 9) AS p FROM pings")


@query("f18_log_odds", "SELECT event_id, round(ln(q / (1 - q)), 9) AS logit, round(-ln(q), 9) AS cost FROM (SELECT event_id, least(greatest(event_id % 101 / 100e0, 1e-9), 1 - 1e-9) AS q FROM events) e")
def _(spark: SparkSession) -> DataFrame:
    p = F.col("event_id") % 101 / F.lit(100.0)
    return spark.table("events").select("event_id", F.round(S.logit(p), 9).alias("logit"), F.round(-F.log(S.clip(p, 1e-9, 1 - 1e-9)), 9).alias("cost"))


plain("f19_coalesce_case", "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS kind, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS code FROM events")
plain("f20_try_cast", "SELECT entry, try_cast(code AS INT) AS number FROM dictionary")


@query("f21_circular_difference", "SELECT event_id, least(abs(heading - 180), 360 - abs(heading - 180)) AS off FROM pings WHERE heading < 360")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("pings").where("heading < 360").select("event_id", S.circular_difference(F.col("heading"), F.lit(180)).alias("off"))


@query("f22_bearing", "SELECT event_id, round((degrees(atan2(lon + 38.5e0, lat + 3.75e0)) + 360e0) % 360e0, 7) AS bearing FROM pings")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("pings").select("event_id", F.round(S.bearing(F.col("lon") + 38.5, F.col("lat") + 3.75), 7).alias("bearing"))


plain("f23_array_subscripts", "SELECT trip_id, element_at(a, 1) AS head, element_at(a, -1) AS tail, size(a) AS n FROM (SELECT trip_id, transform(array_sort(collect_list(struct(seq, stop_id))), e -> e.stop_id) AS a FROM taps GROUP BY trip_id) x", "SELECT trip_id, a[1] AS head, a[-1] AS tail, CAST(len(a) AS INT) AS n FROM (SELECT trip_id, list(stop_id ORDER BY seq, stop_id) AS a FROM taps GROUP BY trip_id) x")


@query("f24_array_order", "SELECT trip_id, row_number() OVER (ORDER BY a, trip_id) AS place FROM (SELECT trip_id, list(stop_id ORDER BY seq, stop_id) AS a FROM taps GROUP BY trip_id) x")
def _(spark: SparkSession) -> DataFrame:
    lists = spark.table("taps").groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop_id"))), lambda e: e.stop_id).alias("a"))
    return R.numbered(lists, "place", "a", "trip_id").select("trip_id", "place")


plain("f25_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
plain("f26_maps", "SELECT trip_id, element_at(m, 'bus') AS bus, element_at(m, 'state') AS state FROM (SELECT trip_id, map('bus', bus_id, 'state', status) AS m FROM trips) x", "SELECT trip_id, bus_id AS bus, status AS state FROM trips")


@query("f27_entity_id", "SELECT trip_id, md5(concat_ws(chr(31), 'trip', bus_id, CAST(trip_date AS VARCHAR), coalesce(nullif(status, 'P'), ''))) AS id FROM trips")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("trips").select("trip_id", S.entity_id("trip", F.col("bus_id"), F.col("trip_date"), F.nullif("status", F.lit("P"))).alias("id"))


@query("f28_seeded_order")
def _(spark: SparkSession) -> DataFrame:
    return R.hashed_sample(spark.table("pings").select("event_id"), 50, "event_id", seed=7)


@query("x01_sql_function", "SELECT event_id, CAST(split_part(clock, ':', 1) AS INT) * 3600 + CAST(split_part(clock, ':', 2) AS INT) * 60 + CAST(split_part(clock, ':', 3) AS INT) AS seconds FROM gtfs_times")
def _(spark: SparkSession) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION parse_gtfs_time(t STRING) RETURNS INT RETURN CAST(split_part(t, ':', 1) AS INT) * 3600 + CAST(split_part(t, ':', 2) AS INT) * 60 + CAST(split_part(t, ':', 3) AS INT)")
    return spark.sql("SELECT event_id, parse_gtfs_time(clock) AS seconds FROM gtfs_times")


@query("x05_keyed_hash")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("taps").select("card").distinct().withColumn("card_key", S.keyed_hash(KEY)("card"))


# ---- geometry ------------------------------------------------------------------------------------------------------
_HAVERSINE = "2 * 6371008.8e0 * asin(sqrt(least(power(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * power(sin(radians({d} - {c}) / 2), 2), 1e0)))"


@query("g01_points", "SELECT event_id, lon AS x, lat AS y FROM pings WHERE NOT (lat = 0 AND lon = 0)")
def _(spark: SparkSession) -> DataFrame:
    seen = ~((F.col("lat") == 0) & (F.col("lon") == 0))
    p = spark.table("pings").withColumn("p", G.point(F.when(seen, F.col("lon")), F.when(seen, F.col("lat"))))
    return p.where("p is not null").select("event_id", "p.x", "p.y")


@query("g02_distance", f"SELECT event_id, round({_HAVERSINE.format(a='lat', b='-3.75e0', c='lon', d='-38.53e0')}, 3) AS metres FROM pings")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("pings").select("event_id", F.round(G.haversine(F.col("lon"), F.col("lat"), F.lit(-38.53), F.lit(-3.75)), 3).alias("metres"))


def route_lines(spark: SparkSession) -> DataFrame:
    """(route, line): one line for each route."""
    return spark.table("lines").groupBy("route").agg(G.make_line(F.col("k"), F.col("lon"), F.col("lat")).alias("line"))


def on_route(spark: SparkSession) -> DataFrame:
    """Pings with the line of their route: an equality join by route."""
    return spark.table("pings").join(route_lines(spark), "route")


_LOCATE = """WITH seg AS (SELECT route, k, lon AS ax, lat AS ay, lead(lon) OVER w - lon AS dx, lead(lat) OVER w - lat AS dy FROM lines WINDOW w AS (PARTITION BY route ORDER BY k)),
s AS (SELECT *, sqrt(dx * dx + dy * dy) AS len, coalesce(sum(sqrt(dx * dx + dy * dy)) OVER (PARTITION BY route ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(sqrt(dx * dx + dy * dy)) OVER (PARTITION BY route) AS total FROM seg WHERE dx IS NOT NULL),
t AS (SELECT event_id, p.lon, p.lat, s.*, least(greatest(((p.lon - ax) * dx + (p.lat - ay) * dy) / (dx * dx + dy * dy), 0), 1) AS t FROM pings p JOIN s ON s.route = p.route),
r AS (SELECT event_id, (before + t * len) / total AS fraction, (lon - ax - t * dx) * (lon - ax - t * dx) + (lat - ay - t * dy) * (lat - ay - t * dy) AS d2, k FROM t),
best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d2, k) AS rn FROM r) """


@query("g03_cross_track", _LOCATE + "SELECT event_id, round(sqrt(d2), 9) AS offset_deg FROM best WHERE rn = 1")
def _(spark: SparkSession) -> DataFrame:
    p = on_route(spark)
    return p.select("event_id", F.round(F.sqrt(G.locate(F.col("line"), F.col("lon"), F.col("lat"))["d2"]), 9).alias("offset_deg"))


@query("g04_make_line", "SELECT device, count(*) AS n_points, arg_min(lat, (ep, event_id)) AS first_lat, arg_max(lat, (ep, event_id)) AS last_lat FROM pings GROUP BY device HAVING count(*) >= 2")
def _(spark: SparkSession) -> DataFrame:
    lines = spark.table("pings").groupBy("device").agg(G.make_line(F.struct("ep", "event_id"), F.col("lon"), F.col("lat")).alias("line")).where("line is not null")
    return lines.select("device", F.size("line").cast("long").alias("n_points"), F.element_at("line", 1)["y"].alias("first_lat"), F.element_at("line", -1)["y"].alias("last_lat"))


@query("g05_locate_on_line", _LOCATE + "SELECT event_id, round(fraction, 9) AS fraction FROM best WHERE rn = 1")
def _(spark: SparkSession) -> DataFrame:
    p = on_route(spark)
    return p.select("event_id", F.round(G.locate(F.col("line"), F.col("lon"), F.col("lat"))["fraction"], 9).alias("fraction"))


@query("g06_line_length", f"SELECT route, round(sum({_HAVERSINE.format(a='lat', b='lat2', c='lon', d='lon2')}), 3) AS metres FROM (SELECT route, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM lines WINDOW w AS (PARTITION BY route ORDER BY k)) s WHERE lat2 IS NOT NULL GROUP BY route")
def _(spark: SparkSession) -> DataFrame:
    return route_lines(spark).select("route", F.round(G.line_length_metres(F.col("line")), 3).alias("metres"))


@query("g07_end_points", "SELECT device, arg_min(lon, (ep, event_id)) AS start_x, arg_max(lon, (ep, event_id)) AS end_x FROM pings GROUP BY device HAVING count(*) >= 2")
def _(spark: SparkSession) -> DataFrame:
    lines = spark.table("pings").groupBy("device").agg(G.make_line(F.struct("ep", "event_id"), F.col("lon"), F.col("lat")).alias("line")).where("line is not null")
    return lines.select("device", F.element_at("line", 1)["x"].alias("start_x"), F.element_at("line", -1)["x"].alias("end_x"))


plain("g08_centroid", "SELECT device, round(avg(lon), 9) AS x, round(avg(lat), 9) AS y FROM pings GROUP BY device")

_KRUEGER = G._ALPHA
_UTM = (
    f"WITH a AS (SELECT event_id, sinh(atanh(sin(radians(lat))) - {G._E!r} * atanh({G._E!r} * sin(radians(lat)))) AS t, radians(lon + 39e0) AS dl FROM pings WHERE lat < 0), "
    "b AS (SELECT event_id, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM a) "
    f"SELECT event_id, round(500000e0 + {0.9996 * G._R!r} * (eta" + "".join(f" + {c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(_KRUEGER, 1)) + "), 3) AS east, "
    f"round(10000000e0 + {0.9996 * G._R!r} * (xi" + "".join(f" + {c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(_KRUEGER, 1)) + "), 3) AS north FROM b"
)


@query("g09_utm", _UTM)
def _(spark: SparkSession) -> DataFrame:
    east, north = G.utm24s(F.col("lon"), F.col("lat"))
    return spark.table("pings").where("lat < 0").select("event_id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


def _tracks(spark: SparkSession) -> DataFrame:
    p = spark.table("pings").where("event_id % 101 <> 0 and event_id % 97 <> 0")
    return p.groupBy("device", "route").agg(G.make_line(F.struct("ep", "event_id"), F.col("lon"), F.col("lat")).alias("line")).where("line is not null")


@F.pandas_udf(T.StructType([T.StructField("frechet", T.DoubleType()), T.StructField("hausdorff", T.DoubleType())]))
def compare_lines(lines: pd.Series, others: pd.Series) -> pd.DataFrame:
    """struct(frechet, hausdorff) of two line columns, row by row."""
    pairs = [(G.as_array(a), G.as_array(b)) for a, b in zip(lines, others, strict=True)]
    return pd.DataFrame({"frechet": [G.frechet(a, b) for a, b in pairs], "hausdorff": [G.hausdorff(a, b) for a, b in pairs]})


def _compared(spark: SparkSession) -> DataFrame:
    both = _tracks(spark).join(route_lines(spark).withColumnRenamed("line", "shape"), "route")
    return both.select("device", "route", "line", "shape", compare_lines("line", "shape").alias("d"))


#: Points of two lines meet in order; the best largest step over all ways that go on in both, by a table filled cell by cell.
_FRECHET = """WITH RECURSIVE a AS (SELECT device, route, row_number() OVER (PARTITION BY device ORDER BY ep, event_id) AS i, lon, lat, count(*) OVER (PARTITION BY device) AS n FROM pings WHERE event_id % 101 <> 0 AND event_id % 97 <> 0),
b AS (SELECT route, CAST(k + 1 AS BIGINT) AS j, lon, lat FROM lines), d AS (SELECT a.device, i, n, list(sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) ORDER BY j) AS d FROM a JOIN b ON b.route = a.route WHERE n >= 2 GROUP BY a.device, i, n),
f AS (SELECT device, i, n, list_transform(range(1, 6), lambda j: list_max(d[1:j])) AS c FROM d WHERE i = 1
 UNION ALL SELECT d.device, d.i, d.n, [greatest(f.c[1], d.d[1]), g2, g3, g4, greatest(least(f.c[4], f.c[5], g4), d.d[5])] FROM f JOIN (SELECT * FROM d) d ON d.device = f.device AND d.i = f.i + 1,
 LATERAL (SELECT greatest(least(f.c[1], f.c[2], greatest(f.c[1], d.d[1])), d.d[2]) AS g2) x2, LATERAL (SELECT greatest(least(f.c[2], f.c[3], g2), d.d[3]) AS g3) x3, LATERAL (SELECT greatest(least(f.c[3], f.c[4], g3), d.d[4]) AS g4) x4)
SELECT device, round(c[5], 9) AS frechet FROM f WHERE i = n"""


@query("g10_frechet", _FRECHET)
def _(spark: SparkSession) -> DataFrame:
    return _compared(spark).select("device", F.round("d.frechet", 9).alias("frechet"))


@query("g11_hausdorff", "WITH d AS (SELECT p.device, p.event_id, s.k, sqrt((p.lon - s.lon) * (p.lon - s.lon) + (p.lat - s.lat) * (p.lat - s.lat)) AS d FROM pings p JOIN lines s ON s.route = p.route WHERE p.event_id % 101 <> 0 AND p.event_id % 97 <> 0), a AS (SELECT device, max(m) AS h FROM (SELECT device, event_id, min(d) AS m FROM d GROUP BY device, event_id) x GROUP BY device HAVING count(*) >= 2), b AS (SELECT device, max(m) AS h FROM (SELECT device, k, min(d) AS m FROM d GROUP BY device, k) x GROUP BY device) SELECT a.device, round(greatest(a.h, b.h), 9) AS hausdorff FROM a JOIN b ON a.device = b.device")
def _(spark: SparkSession) -> DataFrame:
    return _compared(spark).select("device", F.round("d.hausdorff", 9).alias("hausdorff"))


plain("g12_dump_points", "SELECT device, pos, p.x AS x, p.y AS y FROM (SELECT device, posexplode(transform(array_sort(collect_list(struct(ep, event_id, lon, lat))), e -> struct(e.lon AS x, e.lat AS y))) AS (pos, p) FROM pings GROUP BY device) q", "SELECT device, CAST(row_number() OVER (PARTITION BY device ORDER BY ep, event_id) - 1 AS INT) AS pos, lon AS x, lat AS y FROM pings")


@query("g13_project_points", _LOCATE + "SELECT event_id, round(fraction, 9) AS fraction, round(sqrt(d2), 9) AS off, CAST(k AS INT) AS segment FROM best WHERE rn = 1")
def _(spark: SparkSession) -> DataFrame:
    """Points go along as one array for each trip, and a whole trip is projected onto its route's line at once."""

    @F.pandas_udf("array<struct<fraction:double,off:double,segment:int>>")
    def run(lines: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for line, x, y in zip(lines, xs, ys, strict=True):
            shape = G.as_array(line)
            along, off, seg = G.project(shape, np.stack([x, y], axis=1))
            total = float(np.sqrt((np.diff(shape, axis=0) ** 2).sum(axis=1)).sum())
            out.append([{"fraction": a / total, "off": o, "segment": int(k)} for a, o, k in zip(along, off, seg, strict=True)])
        return pd.Series(out)

    trips = spark.table("pings").groupBy("trip_id", "route").agg(F.collect_list(F.struct("event_id", "lon", "lat")).alias("at"))
    p = trips.join(route_lines(spark), "route").withColumn("r", run("line", "at.lon", "at.lat"))
    p = p.select(F.explode(F.arrays_zip(F.col("at.event_id").alias("event_id"), "r")).alias("z"))
    return p.select("z.event_id", F.round("z.r.fraction", 9).alias("fraction"), F.round("z.r.off", 9).alias("off"), "z.r.segment")


@query("g14_nearest_candidate", "SELECT event_id, round(min(sqrt((p.lat - s.lat) * (p.lat - s.lat) + (p.lon - s.lon) * (p.lon - s.lon))), 9) AS nearest FROM pings p JOIN route_stops s ON s.route = p.route GROUP BY event_id")
def _(spark: SparkSession) -> DataFrame:
    """Candidates are those of the ping's route, as one array: a ping is one row before and after."""
    stops = spark.table("route_stops").groupBy("route").agg(F.collect_list(F.struct("lon", "lat")).alias("stops"))
    d = F.transform("stops", lambda s: F.sqrt((F.col("lat") - s["lat"]) * (F.col("lat") - s["lat"]) + (F.col("lon") - s["lon"]) * (F.col("lon") - s["lon"])))
    return spark.table("pings").join(stops, "route").select("event_id", F.round(F.array_min(d), 9).alias("nearest"))


@query("g22_nearest_facility", "SELECT t.trip_id, round(min(CASE WHEN s.zone = t.direction THEN abs(s.lat + 3.75e0) END), 9) AS nearest_own, round(min(abs(s.lat + 3.75e0)), 9) AS nearest_any FROM trips t CROSS JOIN (SELECT zone, lat FROM stops WHERE stop_id % 4 = 0) s GROUP BY t.trip_id")
def _(spark: SparkSession) -> DataFrame:
    """The nearest facility of the own kind by key, that of any kind as one value."""
    f = spark.table("stops").where("stop_id % 4 = 0").select("zone", F.abs(F.col("lat") + 3.75).alias("d"))
    own = f.groupBy(F.col("zone").alias("direction")).agg(F.round(F.min("d"), 9).alias("nearest_own"))
    anywhere = f.agg(F.round(F.min("d"), 9).alias("nearest_any"))  # one row
    return spark.table("trips").select("trip_id", "direction").join(own, "direction", "left").crossJoin(anywhere).select("trip_id", "nearest_own", "nearest_any")


@query("g23_straightness", "WITH o AS (SELECT device, lon, lat, lag(lon) OVER w AS px, lag(lat) OVER w AS py, first_value(lon) OVER w AS fx, first_value(lat) OVER w AS fy, row_number() OVER (PARTITION BY device ORDER BY ep DESC, event_id DESC) AS rl FROM pings WHERE event_id % 101 <> 0 AND event_id % 97 <> 0 WINDOW w AS (PARTITION BY device ORDER BY ep, event_id)), l AS (SELECT device, sum(sqrt((lon - px) * (lon - px) + (lat - py) * (lat - py))) AS len, max(CASE WHEN rl = 1 THEN sqrt((lon - fx) * (lon - fx) + (lat - fy) * (lat - fy)) END) AS straight, count(*) AS n FROM o GROUP BY device) SELECT device, round(straight / nullif(len, 0), 7) AS straightness FROM l WHERE n >= 2")
def _(spark: SparkSession) -> DataFrame:
    a, b = F.element_at("line", 1), F.element_at("line", -1)
    straight = F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
    return _tracks(spark).select("device", F.round(S.ratio(straight, G.line_length(F.col("line"))), 7).alias("straightness"))


@query("g24_direction_correlation", _LOCATE + "SELECT p.device, count(*) AS n_points, round(covar_pop(b.fraction, p.ep) / nullif(stddev_pop(b.fraction) * stddev_pop(p.ep), 0), 5) AS r FROM pings p JOIN best b ON b.event_id = p.event_id AND b.rn = 1 GROUP BY p.device")
def _(spark: SparkSession) -> DataFrame:
    p = on_route(spark)
    p = p.withColumn("fraction", G.locate(F.col("line"), F.col("lon"), F.col("lat"))["fraction"])
    return p.groupBy("device").agg(F.count(F.lit(1)).alias("n_points"), F.round(S.pearson(F.col("fraction"), F.col("ep")), 5).alias("r"))


plain("g26_device_cells", "SELECT DISTINCT device, CAST(floor(ep / 86400) AS BIGINT) AS day, CAST(floor(lon / 0.003e0) AS BIGINT) AS cx, CAST(floor(lat / 0.003e0) AS BIGINT) AS cy, CAST(floor(ep / 900) AS BIGINT) AS bucket FROM pings")


@query("g25_walked_cells", "WITH s AS (SELECT trip_id, opened, closed, unnest(range(0, 11)) AS i FROM trips WHERE closed > opened) SELECT DISTINCT trip_id, CAST(floor((-38.55e0 + 0.04e0 * i / 10e0) / 0.003e0) AS BIGINT) AS cx, CAST(floor((opened + (closed - opened) * i / 10e0) / 86400) AS BIGINT) AS bucket FROM s")
def _(spark: SparkSession) -> DataFrame:
    s = spark.table("trips").where("closed > opened").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(10))))
    cx = F.floor((F.lit(-38.55) + F.lit(0.04) * F.col("i") / F.lit(10.0)) / F.lit(0.003))
    return s.select("trip_id", cx.alias("cx"), F.floor((F.col("opened") + (F.col("closed") - F.col("opened")) * F.col("i") / F.lit(10.0)) / 86400).alias("bucket")).distinct()


@query("g27_fare_location", "WITH a AS (SELECT w.window_id, w.opened, w.device, p.ep AS t1, p.lat AS y1 FROM windows w ASOF LEFT JOIN pings p ON p.device = w.device AND p.ep <= w.opened), b AS (SELECT a.*, p.ep AS t2, p.lat AS y2 FROM a ASOF LEFT JOIN pings p ON p.device = a.device AND p.ep >= a.opened) SELECT window_id, round(CASE WHEN t1 = t2 THEN NULL ELSE y1 + (y2 - y1) * (opened - t1) / (t2 - t1) END, 9) AS lat FROM b")
def _(spark: SparkSession) -> DataFrame:
    pings = spark.table("pings")
    one = R.asof(spark.table("windows"), pings, ["device"], "opened", "ep", ["lat"], prefix="a_")
    two = R.asof(one, pings, ["device"], "opened", "ep", ["lat"], "forward", prefix="b_")
    share = F.try_divide(F.col("opened") - F.col("a_time"), F.col("b_time") - F.col("a_time"))
    return two.select("window_id", F.round(F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * share, 9).alias("lat"))


@query("g29_isotonic_progress")
def _(spark: SparkSession) -> DataFrame:
    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["ep", "event_id"])
        return pd.DataFrame({"event_id": g.event_id, "fitted": G.isotonic(g.lat.to_numpy())})

    return spark.table("pings").select("device", "event_id", "ep", "lat").groupBy("device").applyInPandas(fit, "event_id long, fitted double")


@query("g30_map_matching")
def _(spark: SparkSession) -> DataFrame:
    """Likeliest stop sequence of each trip along its route: nearer stops emit likelier, far jumps along the route are unlikely."""

    @F.pandas_udf("array<long>")
    def match(sx: pd.Series, sy: pd.Series, seq: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for a, b, k, x, y in zip(sx, sy, seq, xs, ys, strict=True):
            stops = np.stack([a, b], axis=1)
            jump = -np.abs(np.arange(len(stops))[:, None] - np.arange(len(stops))[None, :]) / 2.0
            emit = -((G.distances(np.stack([x, y], axis=1), stops) / 0.002) ** 2) / 2
            out.append(np.asarray(k)[G.viterbi(np.zeros(len(stops)), jump, emit)].astype(np.int64))
        return pd.Series(out)

    stops = spark.table("route_stops").groupBy("route").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("stops"))
    trips = spark.table("pings").where("not (lat = 0 and lon = 0)").groupBy("trip_id", "route").agg(F.array_sort(F.collect_list(F.struct("ep", "event_id", "lon", "lat"))).alias("at"))
    got = trips.join(stops, "route").withColumn("r", match("stops.lon", "stops.lat", "stops.seq", "at.lon", "at.lat"))
    return got.select(F.explode(F.arrays_zip(F.col("at.event_id").alias("event_id"), F.col("r").alias("stop_seq"))).alias("z")).select("z.event_id", "z.stop_seq")


@query("g28_forward_stops")
def _(spark: SparkSession) -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(lines: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([G.forward_stops(G.as_array(line), np.stack([x, y], axis=1)) for line, x, y in zip(lines, xs, ys, strict=True)])

    stops = spark.table("route_stops").groupBy("route").agg(F.array_sort(F.collect_list(F.struct("seq", "stop_id", "lon", "lat"))).alias("s"))
    got = stops.join(route_lines(spark), "route").withColumn("r", run("line", "s.lon", "s.lat"))
    return got.select("route", F.explode(F.arrays_zip(F.col("s.stop_id").alias("stop_id"), F.col("r").alias("chainage"))).alias("z")).select("route", "z.stop_id", "z.chainage")


#: A zone that is neither convex nor parallel to the axes.
ZONE = ((-38.545, -3.79), (-38.52, -3.78), (-38.51, -3.72), (-38.53, -3.75), (-38.54, -3.73))
_CROSS = " + ".join(f"CASE WHEN ({ay!r} > lat) <> ({by!r} > lat) AND lon < ({bx - ax!r}) * (lat - ({ay!r})) / ({by - ay!r}) + ({ax!r}) THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(ZONE, ZONE[1:] + ZONE[:1], strict=True))


@query("g31_polygon_zone", f"SELECT event_id FROM pings WHERE ({_CROSS}) % 2 = 1")
def _(spark: SparkSession) -> DataFrame:
    """The zone's box prunes in the scan; the even-odd rule over its edges is column arithmetic."""
    x, y = [p[0] for p in ZONE], [p[1] for p in ZONE]
    near = spark.table("pings").where(F.col("lon").between(min(x), max(x)) & F.col("lat").between(min(y), max(y)))
    return near.where(G.in_polygon_column(ZONE, F.col("lon"), F.col("lat"))).select("event_id")



