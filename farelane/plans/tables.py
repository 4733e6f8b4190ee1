"""Derived tables: trips from taps, fares, schedules, the star schema, matching and its outputs, point queries, checks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farelane.functions import scalars as S
from farelane.operators import matching as M
from farelane.operators import relational as R
from farelane.operators import tallies as T
from farelane.plans.catalog import plain, query

# ---- derived tables ------------------------------------------------------------------------------------------------
plain("d01_trips_from_taps", "SELECT trip_id, min(card) AS card, min(tapped) AS start_s, max(tapped) AS end_s, CASE WHEN max(tapped) < min(tapped) THEN NULL ELSE max(tapped) - min(tapped) END AS duration_s, count(*) AS fare_count, CAST(sum(fare_cents) AS BIGINT) AS fare_cents FROM taps GROUP BY trip_id")
plain("d02_trip_fares", "SELECT t.trip_id, t.bus_id, x.seq, x.fare_cents, x.tapped - t.opened AS since_open FROM taps x JOIN trips t ON t.trip_id = x.trip_id WHERE t.status <> 'P'")


@query("d03_route_schedule", "SELECT route, CAST(min(s) AS INT) AS first_s, CAST(max(s) AS INT) AS last_s, count(DISTINCT (s // 3600) % 24) AS hours FROM (SELECT route, CAST(split_part(clock, ':', 1) AS INT) * 3600 + CAST(split_part(clock, ':', 2) AS INT) * 60 + CAST(split_part(clock, ':', 3) AS INT) AS s FROM gtfs_times) x GROUP BY route")
def _(spark: SparkSession) -> DataFrame:
    x = spark.table("gtfs_times").select("route", S.gtfs_seconds(F.col("clock")).alias("s"))
    return x.groupBy("route").agg(F.min("s").alias("first_s"), F.max("s").alias("last_s"), F.countDistinct(S.hour_of_seconds(F.col("s"))).alias("hours"))


plain("d04_trip_metrics", "SELECT trip_id, count(*) AS n, CAST(max(tapped) - min(tapped) AS DOUBLE) AS span_s, round(avg(gap), 3) AS gap_mean, round(stddev_samp(gap), 3) AS gap_std, max(gap) AS gap_max FROM (SELECT trip_id, tapped, tapped - lag(tapped) OVER (PARTITION BY trip_id ORDER BY tapped, seq, fare_cents) AS gap FROM taps) x GROUP BY trip_id")


@query("d05_trip_positions", "SELECT w.window_id, count(*) AS n, min(p.ep) AS first_at, max(p.ep) AS last_at FROM windows w JOIN pings p ON p.device = w.device AND p.ep BETWEEN w.opened AND w.closed GROUP BY w.window_id")
def _(spark: SparkSession) -> DataFrame:
    x = R.contained(spark.table("pings"), spark.table("windows"), ["device"], "ep", "opened", "closed", 86400.0)
    return x.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.min("ep").alias("first_at"), F.max("ep").alias("last_at"))


@query("d06_ratio_features", "SELECT t.trip_id, CAST(x.n AS DOUBLE) / nullif(closed - opened, 0) AS fares_per_s, CASE WHEN closed - opened IS NULL THEN NULL ELSE greatest(0e0, closed - opened) END AS duration_clip, isodow(trip_date) >= 6 AS weekend FROM trips t LEFT JOIN (SELECT trip_id, count(*) AS n FROM taps GROUP BY trip_id) x ON x.trip_id = t.trip_id")
def _(spark: SparkSession) -> DataFrame:
    x = spark.table("taps").groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))
    t = spark.table("trips").join(x, "trip_id", "left").withColumn("d", F.col("closed") - F.col("opened"))
    return t.select("trip_id", S.ratio(F.col("n"), F.col("d")).alias("fares_per_s"), S.at_least_zero(F.col("d")).alias("duration_clip"), (S.iso_weekday(F.col("trip_date")) >= 6).alias("weekend"))


plain("d07_final_labels", "SELECT trip_id, is_valid, label_source FROM (SELECT trip_id, status = 'F' AS is_valid, 'human' AS label_source FROM trips WHERE trip_id % 50 = 0 UNION ALL SELECT trip_id, (trip_id * 7919 % 1000) / 1000e0 >= 0.8454e0 AS is_valid, 'model' AS label_source FROM trips WHERE trip_id % 50 <> 0) x")
plain("d08_unmatched_devices", "SELECT s.entry, CASE WHEN c.k IS NULL THEN 'never_blocked' WHEN c.best < 7 THEN 'lost_competition' ELSE 'claimed' END AS reason FROM dictionary s LEFT JOIN (SELECT l_suppkey AS k, max(l_linenumber) AS best FROM lineitem GROUP BY l_suppkey) c ON c.k = s.entry")


@query("d09_star_schema", "SELECT md5(concat_ws(chr(31), 'trip', bus_id, CAST(opened AS BIGINT)::VARCHAR, CAST(trip_id AS VARCHAR))) AS trip_key, md5(concat_ws(chr(31), 'bus', bus_id)) AS bus_key, left(bus_id, 2) AS company_code, CASE direction WHEN 0 THEN 'I' WHEN 1 THEN 'V' END AS direction, n AS fares FROM trips JOIN (SELECT trip_id AS id, count(*) AS n FROM taps GROUP BY trip_id) x ON id = trip_id")
def _(spark: SparkSession) -> DataFrame:
    n = spark.table("taps").groupBy("trip_id").agg(F.count(F.lit(1)).alias("fares"))
    t = spark.table("trips").join(n, "trip_id")
    key = S.entity_id("trip", F.col("bus_id"), F.col("opened").cast("long"), F.col("trip_id"))
    return t.select(key.alias("trip_key"), S.entity_id("bus", F.col("bus_id")).alias("bus_key"), S.company_code(F.col("bus_id")).alias("company_code"), S.direction(F.col("direction"), F.col("route_id")).alias("direction"), "fares")


plain("d11_point_lookup", "SELECT t.trip_id, t.bus_id, t.trip_date, c.c_name AS owner FROM trips t LEFT JOIN customer c ON lpad(CAST(c.c_custkey AS VARCHAR(20)), 5, '0') = t.bus_id WHERE t.trip_id = 7")
plain("d12_boardings_by_route_hour", "SELECT t.route_id, CAST(floor(x.tapped / 3600) AS BIGINT) % 24 AS hour, count(*) AS boardings, CAST(sum(x.fare_cents) AS BIGINT) AS cents FROM taps x JOIN trips t ON t.trip_id = x.trip_id GROUP BY t.route_id, CAST(floor(x.tapped / 3600) AS BIGINT) % 24")


@query("g20_canonical_pattern", "WITH v AS (SELECT pattern, route_id, count(*) AS n FROM (SELECT t.trip_id, t.route_id, string_agg(CAST(x.kind AS VARCHAR), '' ORDER BY x.kind) AS pattern FROM trips t JOIN taps x ON x.trip_id = t.trip_id GROUP BY t.trip_id, t.route_id) q GROUP BY pattern, route_id), r AS (SELECT *, length(pattern) % 3 = 0 AS coherent FROM v) SELECT route_id, pattern, n, ambiguous FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY coherent DESC, n DESC, pattern) AS rn, count(*) FILTER (WHERE coherent) OVER (PARTITION BY route_id) > 1 AS ambiguous FROM r) z WHERE rn = 1")
def _(spark: SparkSession) -> DataFrame:
    x = spark.table("taps").join(spark.table("trips").select("trip_id", "route_id"), "trip_id")
    lists = x.groupBy("trip_id", "route_id").agg(F.array_join(F.array_sort(F.collect_list("kind")), "").alias("pattern"))
    v = lists.groupBy("pattern", "route_id").agg(F.count(F.lit(1)).alias("n")).withColumn("coherent", F.length("pattern") % 3 == 0)
    v = v.withColumn("ambiguous", F.count_if("coherent").over(W.partitionBy("route_id")) > 1)
    return R.first_per(v, ["route_id"], F.col("coherent").desc_nulls_first(), F.desc("n"), F.col("pattern")).select("route_id", "pattern", "n", "ambiguous")


plain("g21_pattern_variants", "SELECT route_id, kinds, n, CAST(row_number() OVER (PARTITION BY route_id ORDER BY n DESC, kinds) AS BIGINT) AS variant_id FROM (SELECT route_id, kinds, count(*) AS n FROM (SELECT t.trip_id, t.route_id, concat(min(x.kind), max(x.kind)) AS kinds FROM trips t JOIN taps x ON x.trip_id = t.trip_id GROUP BY t.trip_id, t.route_id) a GROUP BY route_id, kinds) b")



@query("m13_contestedness", "SELECT t.trip_id, count(DISTINCT b.bus_id) AS rivals FROM trips t LEFT JOIN trips b ON b.route_id = t.route_id AND b.trip_date = t.trip_date AND b.bus_id <> t.bus_id AND b.opened < t.closed AND b.closed > t.opened GROUP BY t.trip_id")
def _(spark: SparkSession) -> DataFrame:
    return T.distinct_overlapping(spark.table("trips"), ["route_id", "trip_date"], "trip_id", "bus_id", "opened", "closed", "rivals")




@query("m19_metrics", "WITH s AS (SELECT CASE WHEN event_id * 31 % 7 < event_id * 7919 % 1000 / 150e0 THEN 1e0 ELSE 0e0 END AS y, (event_id * 7919 % 1000) / 1000e0 AS p FROM events), r AS (SELECT *, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0) AS rk FROM s), a AS (SELECT (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc, avg((p - y) * (p - y)) AS brier, avg(-(y * ln(least(greatest(p, 1e-9), 1 - 1e-9)) + (1 - y) * ln(1 - least(greatest(p, 1e-9), 1 - 1e-9)))) AS ll, count(*) AS n FROM r), e AS (SELECT sum(g) / sum(n) AS ece FROM (SELECT abs(sum(y) - sum(p)) AS g, count(*) AS n FROM s GROUP BY least(floor(p * 10), 9)) q) SELECT n, round(auc, 7) AS auc, round(brier, 7) AS brier, round(ll, 6) AS log_loss, round(ece, 7) AS ece FROM a CROSS JOIN e")
def _(spark: SparkSession) -> DataFrame:
    p = F.col("event_id") * 7919 % 1000 / F.lit(1000.0)
    s = spark.table("events").select(F.when(F.col("event_id") * 31 % 7 < F.col("event_id") * 7919 % 1000 / F.lit(150.0), 1).otherwise(0).alias("y"), p.alias("p"))
    m = M.calibration_metrics(s, "y", "p")
    return m.select("n", F.round("auc", 7).alias("auc"), F.round("brier", 7).alias("brier"), F.round("log_loss", 6).alias("log_loss"), F.round("ece", 7).alias("ece"))


@query("m18_platt_calibration")
def _(spark: SparkSession) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    p = F.col("event_id") * 7919 % 1000 / F.lit(1000.0)
    s = spark.table("events").select("event_id", F.when(F.col("event_id") * 31 % 7 < 3, 1.0).otherwise(0.0).alias("label"), S.logit(p, 1e-3).alias("x"))
    v = VectorAssembler(inputCols=["x"], outputCol="features").transform(s)
    return LogisticRegression(maxIter=50).fit(v).transform(v).select("event_id", F.round(vector_to_array("probability")[1], 6).alias("p"))


@query("m20_best_threshold", "WITH s AS (SELECT CASE WHEN event_id * 31 % 7 < event_id * 7919 % 1000 / 150e0 THEN 1 ELSE 0 END AS y, (event_id * 7919 % 1000) / 1000e0 AS p FROM events), g AS (SELECT p, sum(y) AS y, count(*) AS n FROM s GROUP BY p), c AS (SELECT p, sum(y) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS pred, sum(y) OVER () AS pos FROM g) SELECT p AS threshold, round(2e0 * tp / (pred + pos), 9) AS f1 FROM c ORDER BY 2 DESC, 1 DESC LIMIT 1")
def _(spark: SparkSession) -> DataFrame:
    p = F.col("event_id") * 7919 % 1000 / F.lit(1000.0)
    s = spark.table("events").select(F.when(F.col("event_id") * 31 % 7 < F.col("event_id") * 7919 % 1000 / F.lit(150.0), 1).otherwise(0).alias("y"), p.alias("p"))
    g = s.groupBy("p").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))  # distinct scores, not rows
    # scores are cumulated in blocks first, so no task sorts them all
    g = g.withColumn("block", F.floor(F.col("p") * 1000))
    sums = g.groupBy("block").agg(F.sum("y").alias("by"), F.sum("n").alias("bn"))
    above = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("block", F.coalesce(F.sum("by").over(above), F.lit(0)).alias("ay"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"))
    w = W.partitionBy("block").orderBy(F.desc("p"))
    c = g.join(sums, "block").select("p", (F.sum("y").over(w) + F.col("ay")).alias("tp"), (F.sum("n").over(w) + F.col("an")).alias("pred")).crossJoin(g.agg(F.sum("y").alias("pos")))
    return c.select(F.col("p").alias("threshold"), F.round(2.0 * F.col("tp") / (F.col("pred") + F.col("pos")), 9).alias("f1")).orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


@query("m22_split_detector", "WITH s AS (SELECT l_suppkey AS bus_id, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_shipdate < TIMESTAMP '1995-06-01' + INTERVAL (l_suppkey) DAY OR l_suppkey % 5 = 0 AND l_linenumber = 1 THEN 'a' ELSE 'b' END AS device_id, max(0.9e0 + l_discount) AS day_score FROM lineitem GROUP BY 1, 2, 3), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bus_id, date ORDER BY day_score DESC, device_id) AS rn FROM s) x WHERE rn = 1), q AS (SELECT *, CASE WHEN lag(device_id) OVER (PARTITION BY bus_id ORDER BY date) <> device_id THEN 1 ELSE 0 END AS sw FROM w), ok AS (SELECT bus_id FROM q GROUP BY bus_id HAVING count(DISTINCT device_id) = 2 AND sum(sw) = 1), p AS (SELECT q.bus_id, q.device_id, min(date) AS start_date, max(date) AS end_date, count(*) AS n_days FROM q JOIN ok ON ok.bus_id = q.bus_id GROUP BY 1, 2) SELECT * FROM p WHERE bus_id IN (SELECT bus_id FROM p GROUP BY bus_id HAVING min(n_days) >= 2)")
def _(spark: SparkSession) -> DataFrame:
    x = spark.sql("SELECT l_suppkey AS bus_id, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_shipdate < TIMESTAMP '1995-06-01' + make_dt_interval(CAST(l_suppkey AS INT)) OR l_suppkey % 5 = 0 AND l_linenumber = 1 THEN 'a' ELSE 'b' END AS device_id, 0.9e0 + l_discount AS s FROM lineitem")
    return M.splits(x.groupBy("bus_id", "date", "device_id").agg(F.max("s").alias("day_score")))


_CLASS_ROWS = "SELECT s_suppkey AS bus, s_suppkey % 11 = 0 AS excluded, s_suppkey % 7 AS n, CASE WHEN s_suppkey % 13 = 0 THEN 'match' END AS hand, s_suppkey % 5 = 0 AS unsure, s_suppkey % 2 = 0 AS split, s_suppkey % 3 = 0 AS single, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE (s_suppkey * 37 % 100) / 100e0 END AS best FROM supplier"


@query("m23_final_class", f"SELECT bus, CASE WHEN excluded THEN 'excluded' WHEN n = 0 THEN 'no_candidates' WHEN hand IS NOT NULL THEN 'hand_' || hand WHEN unsure AND split THEN 'unsure_split' WHEN unsure AND single THEN 'unsure_single' WHEN unsure THEN 'unsure_review' WHEN best IS NULL OR best < 0.01e0 THEN 'no_evidence' WHEN best >= 0.9e0 THEN 'model' ELSE 'model_below' END AS method FROM ({_CLASS_ROWS}) r")
def _(spark: SparkSession) -> DataFrame:
    c = F.col
    return spark.sql(_CLASS_ROWS).select("bus", M.final_class(c("excluded"), c("n"), c("hand"), c("unsure"), c("split"), c("single"), c("best")).alias("method"))




@query("m28_tap_linkage", "SELECT window_id, device, round(sum(llr), 6) AS score FROM (SELECT w.window_id, w.device, CASE WHEN abs(p.ep - w.opened) <= 3600 THEN ln(8e0) ELSE -ln(1.5e0) END AS llr FROM windows w JOIN pings p ON p.device = w.device AND p.ep BETWEEN w.opened AND w.closed) x GROUP BY window_id, device")
def _(spark: SparkSession) -> DataFrame:
    x = R.contained(spark.table("pings"), spark.table("windows"), ["device"], "ep", "opened", "closed", 86400.0)
    llr = F.when(F.abs(F.col("ep") - F.col("opened")) <= 3600, F.lit(math.log(8.0))).otherwise(F.lit(-math.log(1.5)))
    return x.groupBy("window_id", "device").agg(F.round(F.sum(llr), 6).alias("score"))


@query("m29_activity_runs", "WITH s AS (SELECT event_id, device, ep, lat, sum(j) OVER (PARTITION BY device ORDER BY ep, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ep - lag(ep) OVER (PARTITION BY device ORDER BY ep, event_id) > 36000 THEN 1 ELSE 0 END AS j FROM pings) x) SELECT device, CAST(session AS BIGINT) AS session, min(ep) AS started, max(ep) AS ended, count(*) AS n, CASE WHEN max(lat) - min(lat) < 0.002e0 THEN 'idle' ELSE 'moving' END AS activity FROM s GROUP BY device, session")
def _(spark: SparkSession) -> DataFrame:
    s = R.sessions(spark.table("pings"), ["device"], "ep", 36000.0, "event_id")
    return s.groupBy("device", "session").agg(F.min("ep").alias("started"), F.max("ep").alias("ended"), F.count(F.lit(1)).alias("n"), F.when(F.max("lat") - F.min("lat") < 0.002, "idle").otherwise("moving").alias("activity"))


plain("m30_reconciliation", "SELECT t.trip_id, CASE WHEN x.n IS NULL THEN 'no_fares' WHEN t.closed < t.opened THEN 'reversed' WHEN x.first_tap < t.opened OR x.last_tap > t.closed THEN 'outside' ELSE 'consistent' END AS status FROM trips t LEFT JOIN (SELECT trip_id, count(*) AS n, min(tapped) AS first_tap, max(tapped) AS last_tap FROM taps GROUP BY trip_id) x ON x.trip_id = t.trip_id")


@query("m31_boarding_assignment", "SELECT w.window_id, p.event_id AS ping FROM windows w ASOF LEFT JOIN pings p ON p.device = w.device AND p.ep <= w.opened WHERE w.closed >= w.opened")
def _(spark: SparkSession) -> DataFrame:
    w = spark.table("windows").where("closed >= opened")
    return R.asof(w, spark.table("pings"), ["device"], "opened", "ep", ["event_id"]).select("window_id", F.col("asof_event_id").alias("ping"))


plain("m33_learned_patterns", "SELECT stop_id, kind, n, round(n * 1e0 / total, 9) AS support FROM (SELECT stop_id, kind, count(*) AS n, sum(count(*)) OVER (PARTITION BY stop_id) AS total FROM taps GROUP BY stop_id, kind) x WHERE n * 1e0 / total >= 0.3e0")

# ---- checks ----------------------------------------------------------------------------------------------------------
plain("c01_conservation", "SELECT (SELECT count(*) FROM taps) AS taps, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT trip_id, count(*) AS n FROM taps GROUP BY trip_id) x) AS by_trip, (SELECT count(*) FROM lineitem) AS source")
plain("c02_ratio_checks", "SELECT count(*) AS n, count(*) FILTER (WHERE r IS NULL) AS nulls, count(*) FILTER (WHERE r < 0) AS negative FROM (SELECT CAST(seq AS DOUBLE) / nullif(tapped - opened, 0) AS r FROM taps JOIN trips ON trips.trip_id = taps.trip_id) x")


@query("c03_positions_inside", "SELECT w.device, count(*) AS positions, count(DISTINCT p.event_id) AS pings, count(*) FILTER (WHERE p.ep < w.opened + 3600) AS early FROM windows w JOIN pings p ON p.device = w.device AND p.ep >= w.opened AND p.ep <= w.closed GROUP BY w.device")
def _(spark: SparkSession) -> DataFrame:
    """Positions lie inside their own window only: as many as a plain range join finds, early ones too, none for other devices."""
    x = R.contained(spark.table("pings"), spark.table("windows"), ["device"], "ep", "opened", "closed", 86400.0)
    return x.groupBy("device").agg(F.count(F.lit(1)).alias("positions"), F.countDistinct("event_id").alias("pings"), F.count_if(F.col("ep") < F.col("opened") + 3600).alias("early"))


plain("c05_one_bucket_a_bus", f"SELECT count(*) AS wrong FROM (SELECT bus, count(*) AS n FROM ({_CLASS_ROWS}) r GROUP BY bus) x WHERE n <> 1")
plain("c06_subset_minimum", "SELECT count(*) AS wrong FROM (SELECT trip_id, min(fare_cents) AS whole, min(CASE WHEN kind = 'R' THEN fare_cents END) AS part FROM taps GROUP BY trip_id) x WHERE part < whole")
plain("c07_accounting", "SELECT kind, count(*) AS records, count(*) FILTER (WHERE fare_cents > 0) AS accepted, count(*) FILTER (WHERE fare_cents <= 0) AS rejected, count(*) = count(*) FILTER (WHERE fare_cents > 0) + count(*) FILTER (WHERE fare_cents <= 0) AS balanced FROM taps GROUP BY kind")


@query("c08_plausibility", "WITH d AS (SELECT tap_date, isodow(tap_date) >= 6 AS weekend, count(*) AS n FROM taps GROUP BY 1, 2), m AS (SELECT *, median(n) OVER (PARTITION BY weekend ORDER BY tap_date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS usual FROM d) SELECT tap_date, n, CASE WHEN usual IS NULL THEN 'unknown' WHEN n < 0.2 * usual OR n > 3 * usual THEN 'fail' WHEN n < 0.5 * usual OR n > 1.5 * usual THEN 'warn' ELSE 'pass' END AS state FROM m")
def _(spark: SparkSession) -> DataFrame:
    d = spark.table("taps").groupBy("tap_date").agg(F.count(F.lit(1)).alias("n")).withColumn("weekend", S.iso_weekday(F.col("tap_date")) >= 6)
    usual = F.percentile("n", F.lit(0.5)).over(W.partitionBy("weekend").orderBy("tap_date").rowsBetween(-8, -1))
    m = d.withColumn("usual", usual)
    n, u = F.col("n"), F.col("usual")
    return m.select("tap_date", "n", F.when(u.isNull(), "unknown").when((n < 0.2 * u) | (n > 3 * u), "fail").when((n < 0.5 * u) | (n > 1.5 * u), "warn").otherwise("pass").alias("state"))


