"""Projections, filters, joins, aggregates, windows, sorts and set operations over the bridge views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farelane.functions import scalars as S
from farelane.operators import relational as R
from farelane.operators import sweeps as P
from farelane.plans.catalog import plain, query

# ---- scans ---------------------------------------------------------------------------------------------------------
plain("s13_pruned_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-02-01'")
plain("s14_inline_values", "SELECT v.code, v.name, count(*) AS n FROM trips JOIN (VALUES ('00', 'first'), ('01', 'second')) AS v(code, name) ON left(bus_id, 2) = v.code GROUP BY v.code, v.name")

# ---- projections, filters, predicates --------------------------------------------------------------------------------
plain("p01_projection", "SELECT device AS avl_device, event_id AS ping_id, lon, lat FROM pings")
plain("p02_case", "SELECT trip_id, CASE WHEN closed < opened THEN 'reversed' WHEN closed - opened < 864000 THEN 'short' ELSE 'long' END AS length_class FROM trips")


@query("p03_month_range", "SELECT trip_id, trip_date FROM trips WHERE trip_date >= DATE '1996-12-01' AND trip_date < DATE '1997-01-01'")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("trips").where(S.between_months(F.col("trip_date").cast("timestamp"), 1996, 12)).select("trip_id", "trip_date")


plain("p04_between", "SELECT trip_id, trip_date FROM trips WHERE trip_date BETWEEN DATE '1995-01-01' AND DATE '1995-03-31'")
plain("p05_membership", "SELECT trip_id, status FROM trips WHERE status IN ('F', 'P') AND route_id NOT IN ('01')", )
plain("p06_suffix", "SELECT s_suppkey AS entry, s_name AS name FROM supplier WHERE s_name LIKE '%7'")


@query("p07_regex", "SELECT entry, code FROM dictionary WHERE regexp_matches(code, '^[0-9]+$')")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("dictionary").where(F.col("code").rlike("^[0-9]+$")).select("entry", "code")


plain("p08_null_symmetry", "SELECT event_id, (nullif(event_id % 5, 0) IS NULL) <> (nullif(event_id % 3, 0) IS NULL) AS odd FROM events")
plain("p09_sentinel_filter", "SELECT event_id, lat, lon FROM pings WHERE NOT (lat = 0 AND lon = 0)")


@query("p10_all_present", "SELECT entry FROM (SELECT entry, nullif(code, 'none') AS a, raw_code AS b FROM dictionary) d WHERE a IS NOT NULL AND a <> '' AND b IS NOT NULL AND b <> ''")
def _(spark: SparkSession) -> DataFrame:
    d = spark.table("dictionary").withColumn("a", F.nullif("code", F.lit("none")))
    return d.where(S.all_present(F.col("a"), F.col("raw_code"))).select("entry")


plain("p11_exists", "SELECT trip_id FROM trips t WHERE EXISTS (SELECT 1 FROM taps x WHERE x.trip_id = t.trip_id AND x.fare_cents > 9000000) AND NOT EXISTS (SELECT 1 FROM taps y WHERE y.trip_id = t.trip_id AND y.kind = 'R')")
plain("p12_in_subquery", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")


@query("p13_safe_ratio", "SELECT trip_id, seq, CAST(fare_cents AS DOUBLE) / nullif(CAST(seq - 3 AS DOUBLE), 0) AS per_step FROM taps")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("taps").select("trip_id", "seq", S.ratio(F.col("fare_cents"), F.col("seq") - 3).alias("per_step"))


@query("p14_safe_clip", "SELECT event_id, CASE WHEN x IS NULL THEN NULL ELSE greatest(0e0, x) END AS clipped FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 9 - 4 AS DOUBLE) END AS x FROM events) e")
def _(spark: SparkSession) -> DataFrame:
    e = spark.table("events").select("event_id", F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 9 - 4).cast("double")).alias("x"))
    return e.select("event_id", S.at_least_zero(F.col("x")).alias("clipped"))


@query("p15_heading", "SELECT event_id, CASE WHEN heading >= 360 THEN 0 ELSE heading END AS clamped, CAST(heading % 360 AS INT) AS wrapped FROM pings")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("pings").select("event_id", S.heading(F.col("heading")).cast("int").alias("clamped"), (F.col("heading") % 360).cast("int").alias("wrapped"))


@query("p16_confidence", "SELECT event_id, gap, CASE WHEN gap <= 60 THEN 'high' WHEN gap <= 180 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT event_id, event_id % 240 AS gap FROM events) e")
def _(spark: SparkSession) -> DataFrame:
    e = spark.table("events").select("event_id", (F.col("event_id") % 240).alias("gap"))
    return e.withColumn("confidence", S.confidence(F.col("gap")))


@query("p17_coordinate_flags", "SELECT event_id, CASE WHEN bad THEN NULL ELSE lat END AS lat, CAST(CASE WHEN bad THEN 1 ELSE 0 END | CASE WHEN lat > -3 THEN 2 ELSE 0 END AS INT) AS quality_flags FROM (SELECT *, lat = 0 AND lon = 0 AS bad FROM pings) p")
def _(spark: SparkSession) -> DataFrame:
    bad = (F.col("lat") == 0) & (F.col("lon") == 0)
    return spark.table("pings").select("event_id", F.when(~bad, F.col("lat")).alias("lat"), S.flag(bad, F.col("lat") > -3).alias("quality_flags"))


@query("p18_flag_bits", "SELECT trip_id, CAST((CASE WHEN closed < opened THEN 1 ELSE 0 END) | (CASE WHEN direction = 2 THEN 2 ELSE 0 END) | (CASE WHEN price > 300000 THEN 4 ELSE 0 END) AS INT) AS flags FROM trips")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("trips").select("trip_id", S.flag(F.col("closed") < F.col("opened"), F.col("direction") == 2, F.col("price") > 300000).alias("flags"))


plain("p19_sentinel_table", "SELECT d.entry, CASE WHEN s.value IS NOT NULL THEN NULL ELSE d.code END AS code FROM dictionary d LEFT JOIN (VALUES ('none'), ('0')) AS s(value) ON d.code = s.value")
plain("p20_scalar_subqueries", "SELECT (SELECT count(*) FROM trips) AS n_trips, (SELECT count(*) FROM taps) AS n_taps, (SELECT count(DISTINCT bus_id) FROM trips) AS n_buses")


@query("p21_correlated_scalar", "SELECT trip_id, (SELECT c_name FROM customer WHERE lpad(CAST(c_custkey AS VARCHAR(20)), 5, '0') = bus_id) AS owner FROM trips")
def _(spark: SparkSession) -> DataFrame:
    """Bus ids are cut to five digits, so from customer 100000 on several share one; there the trip's own customer is its owner.
    (The SQL stops at such an id.) Two customers of one key are an error, as in SQL."""
    return spark.sql("""
        WITH t AS (SELECT o_orderkey AS trip_id, o_custkey AS own, lpad(CAST(o_custkey AS STRING), 5, '0') AS bus FROM orders LEFT SEMI JOIN lineitem ON l_orderkey = o_orderkey),
        k AS (SELECT c_custkey AS own, lpad(CAST(c_custkey AS STRING), 5, '0') AS bus, count(*) AS n, min(c_name) AS name FROM customer GROUP BY c_custkey),
        b AS (SELECT bus, sum(n) AS n, min(name) AS name FROM k GROUP BY bus)
        SELECT trip_id, CASE WHEN b.n > 1 AND k.n > 1 THEN raise_error('more than one customer of a key') WHEN b.n > 1 THEN k.name ELSE b.name END AS owner
        FROM t LEFT JOIN b ON b.bus = t.bus LEFT JOIN k ON k.own = t.own""")


plain("p22_cte_chain", "WITH a AS (SELECT trip_id, sum(fare_cents) AS s FROM taps GROUP BY trip_id), b AS (SELECT trip_id, s FROM a WHERE s > 10000000), c AS (SELECT count(*) AS n, CAST(max(s) AS BIGINT) AS top FROM b) SELECT n, top FROM c")
plain("p23_cast", "SELECT trip_id, CAST(price AS BIGINT) AS whole, CAST(trip_id AS VARCHAR(20)) AS label FROM trips", "SELECT trip_id, CAST(trunc(price) AS BIGINT) AS whole, CAST(trip_id AS VARCHAR) AS label FROM trips")

# ---- joins ---------------------------------------------------------------------------------------------------------
plain("j01_inner", "SELECT t.trip_id, x.seq, x.fare_cents, t.bus_id FROM trips t JOIN taps x ON x.trip_id = t.trip_id WHERE x.kind = 'R'")
plain("j02_composite_key", "SELECT t.trip_id, count(*) AS n FROM trips t JOIN orders o ON lpad(CAST(o.o_custkey AS VARCHAR(20)), 5, '0') = t.bus_id AND CAST(o.o_orderdate AS DATE) = t.trip_date GROUP BY t.trip_id")
plain("j03_using", "SELECT trip_id, bus_id, seq FROM trips JOIN taps USING (trip_id) WHERE seq = 1")
plain("j04_left", "SELECT t.trip_id, d.code FROM trips t LEFT JOIN dictionary d ON d.code = CAST(t.trip_id % 211 AS VARCHAR(20))")
plain("j05_full_provenance", "SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000) b ON a.k = b.k")
plain("j06_semi_anti", "SELECT c_custkey, CASE WHEN o.k IS NULL THEN 'idle' ELSE 'active' END AS state FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey")

_ASOF = "SELECT w.window_id, p.ep AS asof_time, p.event_id AS asof_event_id FROM windows w ASOF LEFT JOIN pings p ON p.device = w.device AND p.ep {} w.opened"


@query("j07_asof_backward", _ASOF.format("<="))
def _(spark: SparkSession) -> DataFrame:
    return R.asof(spark.table("windows"), spark.table("pings"), ["device"], "opened", "ep", ["event_id"]).select("window_id", "asof_time", "asof_event_id")


@query("j08_asof_forward", _ASOF.format(">="))
def _(spark: SparkSession) -> DataFrame:
    return R.asof(spark.table("windows"), spark.table("pings"), ["device"], "opened", "ep", ["event_id"], "forward").select("window_id", "asof_time", "asof_event_id")


@query("j09_nearest_feed", "SELECT trip_id, trip_date, feed_date FROM (SELECT trip_id, trip_date, feed_date, row_number() OVER (PARTITION BY trip_id ORDER BY feed_date > trip_date, abs(feed_date - trip_date)) AS rn FROM trips LEFT JOIN feeds ON route = ltrim(route_id, '0')) x WHERE rn = 1")
def _(spark: SparkSession) -> DataFrame:
    t = spark.table("trips").select("trip_id", "trip_date", S.route_join_key(F.col("route_id")).alias("route"))
    return R.nearest_prefer_past(t, spark.table("feeds"), ["route"], "trip_date", "feed_date").select("trip_id", "trip_date", "feed_date")


@query("j10_latest_changed_snapshot", "WITH s AS (SELECT route, feed_date, CAST(day(feed_date) % 4 AS INT) AS digest FROM feeds), c AS (SELECT * FROM (SELECT *, lag(digest) OVER (PARTITION BY route ORDER BY feed_date) AS before FROM s) q WHERE before IS NULL OR before <> digest) SELECT t.trip_id, c.feed_date AS snapshot FROM (SELECT trip_id, ltrim(route_id, '0') AS route, trip_date FROM trips) t ASOF LEFT JOIN c ON c.route = t.route AND c.feed_date <= t.trip_date")
def _(spark: SparkSession) -> DataFrame:
    s = spark.table("feeds").withColumn("digest", (F.day("feed_date") % 4).cast("int"))
    before = F.lag("digest").over(W.partitionBy("route").orderBy("feed_date"))
    changed = s.withColumn("before", before).where("before is null or before <> digest")
    t = spark.table("trips").select("trip_id", S.route_join_key(F.col("route_id")).alias("route"), "trip_date")
    return R.asof(t, changed, ["route"], "trip_date", "feed_date", ["digest"]).select("trip_id", F.col("asof_time").alias("snapshot"))


@query("j11_interval_containment", "SELECT w.window_id, p.event_id FROM windows w JOIN pings p ON p.device = w.device AND p.ep BETWEEN w.opened AND w.closed")
def _(spark: SparkSession) -> DataFrame:
    return R.contained(spark.table("pings"), spark.table("windows"), ["device"], "ep", "opened", "closed", 86400.0).select("window_id", "event_id")


plain("j12_date_interval", "SELECT t.trip_id, i.device FROM trips t JOIN (SELECT lpad(CAST(s_suppkey AS VARCHAR(20)), 5, '0') AS bus_id, s_name AS device, DATE '1994-01-01' AS start_date, DATE '1996-06-30' AS end_date FROM supplier) i ON i.bus_id = t.bus_id AND t.trip_date BETWEEN i.start_date AND i.end_date")


@query("j13_interval_overlap", "SELECT a.trip_id AS a, b.trip_id AS b FROM trips a JOIN trips b ON a.route_id = b.route_id AND a.trip_date = b.trip_date AND a.bus_id <> b.bus_id AND b.opened < a.closed AND b.closed > a.opened")
def _(spark: SparkSession) -> DataFrame:
    return P.overlap_pairs(spark.table("trips"), ["route_id", "trip_date"], "trip_id", "opened", "closed", "bus_id")


@query("j14_progress_theta", "SELECT p.event_id, count(s.stop_id) AS passed FROM pings p LEFT JOIN stops s ON s.lat <= p.lat AND s.zone = p.trip_id % 5 GROUP BY p.event_id")
def _(spark: SparkSession) -> DataFrame:
    """Stops of a zone go along as one sorted array, so a ping meets its zone once."""
    stops = spark.table("stops").groupBy("zone").agg(F.array_sort(F.collect_list("lat")).alias("lats"))
    p = spark.table("pings").withColumn("zone", F.col("trip_id") % 5).join(stops, "zone", "left")
    return p.select("event_id", F.coalesce(F.size(F.filter("lats", lambda x: x <= F.col("lat"))), F.lit(0)).cast("long").alias("passed"))


plain("j15_cross_small", "SELECT s.stop_id, round(min(sqrt((s.lat - g.lat) * (s.lat - g.lat) + (s.lon - g.lon) * (s.lon - g.lon))), 9) AS nearest FROM stops s CROSS JOIN (VALUES (-3.75e0, -38.53e0), (-3.7e0, -38.5e0)) AS g(lat, lon) GROUP BY s.stop_id")


@query("j16_unnest_ordinality", "SELECT trip_id, ord, stop_id FROM (SELECT trip_id, unnest(range(1, 4)) AS ord, unnest([trip_id % 5, trip_id % 7, trip_id % 11]) AS stop_id FROM trips) x")
def _(spark: SparkSession) -> DataFrame:
    t = spark.table("trips").select("trip_id", F.posexplode(F.array(*[F.col("trip_id") % k for k in (5, 7, 11)])).alias("pos", "stop_id"))
    return t.select("trip_id", (F.col("pos") + 1).cast("long").alias("ord"), "stop_id")


plain("j17_preaggregate", "SELECT t.trip_id, x.n, x.fares FROM trips t JOIN (SELECT trip_id, count(*) AS n, CAST(sum(fare_cents) AS BIGINT) AS fares FROM taps GROUP BY trip_id) x ON x.trip_id = t.trip_id")
plain("j18_or_split", "SELECT t.trip_id, s.s_suppkey FROM trips t JOIN supplier s ON s.s_suppkey = t.trip_id WHERE s.s_suppkey % 2 = 0 UNION ALL SELECT t.trip_id, s.s_suppkey FROM trips t JOIN supplier s ON lpad(CAST(s.s_suppkey AS VARCHAR(20)), 5, '0') = t.bus_id WHERE s.s_suppkey % 2 = 1")
plain("j19_blocking", "SELECT a.bus, b.dev, count(*) AS overlap FROM (SELECT DISTINCT l_suppkey AS bus, l_partkey % 40 AS cx, l_orderkey % 30 AS cy, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_linenumber = 1) a JOIN (SELECT DISTINCT l_suppkey AS dev, l_partkey % 40 AS cx, l_orderkey % 30 AS cy, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_linenumber = 2) b ON a.d = b.d AND a.cx = b.cx AND a.cy = b.cy GROUP BY a.bus, b.dev")


@query("j20_overlap_check", "SELECT bus_id, count(*) AS overlaps FROM (SELECT bus_id, opened, max(closed) OVER (PARTITION BY bus_id ORDER BY opened, trip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM trips) x WHERE before > opened GROUP BY bus_id")
def _(spark: SparkSession) -> DataFrame:
    before = F.max("closed").over(W.partitionBy("bus_id").orderBy("opened", "trip_id").rowsBetween(W.unboundedPreceding, -1))
    return spark.table("trips").withColumn("before", before).where("before > opened").groupBy("bus_id").agg(F.count(F.lit(1)).alias("overlaps"))


plain("j21_group_max", "SELECT trip_id, seq, fare_cents, max(fare_cents) OVER (PARTITION BY trip_id) AS trip_max FROM taps")


@query("j22_space_time_candidates", "WITH p AS (SELECT * FROM pings WHERE NOT (lat = 0e0 AND lon = 0e0)) SELECT a.event_id AS a, b.event_id AS b FROM p a JOIN p b ON a.event_id < b.event_id AND (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) <= 0.005e0 * 0.005e0 AND abs(a.ep - b.ep) <= 1800e0")
def _(spark: SparkSession) -> DataFrame:
    p = spark.table("pings").where("not (lat = 0 and lon = 0)")  # no position
    return P.near_pairs(p, "event_id", "lon", "lat", "ep", 0.005, 1800.0)


plain("j23_radius_zone", "SELECT p.event_id, z.stop_id AS zone_id FROM pings p JOIN (SELECT * FROM stops WHERE stop_id % 6 = 0) z ON (p.lat - z.lat) * (p.lat - z.lat) + (p.lon - z.lon) * (p.lon - z.lon) <= 0.0001e0")

# ---- aggregates ----------------------------------------------------------------------------------------------------
plain("a01_group", "SELECT route_id, status, count(*) AS n, min(opened) AS first_open, max(closed) AS last_close, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) AS cents, round(avg(price), 6) AS mean_price FROM trips GROUP BY route_id, status")
plain("a02_min_as_any", "SELECT trip_id, min(card) AS card, min(kind) AS kind FROM taps GROUP BY trip_id")
plain("a03_count_distinct", "SELECT route_id, count(DISTINCT bus_id) AS buses, count(DISTINCT (bus_id, trip_date)) AS bus_days FROM trips GROUP BY route_id", )
plain("a04_filter", "SELECT trip_id, count(*) FILTER (WHERE kind = 'R') AS returned, CAST(sum(fare_cents) FILTER (WHERE seq <= 2) AS BIGINT) AS first_fares FROM taps GROUP BY trip_id")
plain("a05_having", "SELECT trip_id, count(*) AS n FROM taps GROUP BY trip_id HAVING count(*) >= 2 AND count(DISTINCT stop_id) > 1")
plain("a06_ordered_array", "SELECT trip_id, array_join(transform(array_sort(collect_list(struct(seq, stop_id, fare_cents))), e -> CAST(e.stop_id AS STRING)), ',') AS stop_list FROM taps GROUP BY trip_id", "SELECT trip_id, string_agg(CAST(stop_id AS VARCHAR), ',' ORDER BY seq, stop_id, fare_cents) AS stop_list FROM taps GROUP BY trip_id")


@query("a07_last_two", "SELECT device, max(CASE WHEN rn = 1 THEN ep END) AS last_at, max(CASE WHEN rn = 2 THEN ep END) AS before_at FROM (SELECT device, ep, row_number() OVER (PARTITION BY device ORDER BY ep DESC, event_id DESC) AS rn FROM pings) x WHERE rn <= 2 GROUP BY device")
def _(spark: SparkSession) -> DataFrame:
    x = R.top_per(spark.table("pings"), ["device"], 2, F.desc("ep"), F.desc("event_id"))
    return x.groupBy("device").agg(F.max(F.when(F.col("rank") == 1, F.col("ep"))).alias("last_at"), F.max(F.when(F.col("rank") == 2, F.col("ep"))).alias("before_at"))


plain("a08_group_by_list", "SELECT array_join(transform(stops, x -> CAST(x AS STRING)), ',') AS pattern, count(*) AS trips FROM (SELECT trip_id, transform(array_sort(collect_list(struct(seq, stop_id))), e -> e.stop_id % 2) AS stops FROM taps GROUP BY trip_id) q GROUP BY stops", "SELECT pattern, count(*) AS trips FROM (SELECT string_agg(CAST(stop_id % 2 AS VARCHAR), ',' ORDER BY seq, stop_id) AS pattern FROM taps GROUP BY trip_id) q GROUP BY pattern")
plain("a09_stddev", "SELECT trip_id, round(stddev_samp(fare_cents), 3) AS spread FROM taps GROUP BY trip_id")


@query("a10_correlation", "SELECT trip_id, round(covar_pop(fare_cents, seq) / nullif(stddev_pop(fare_cents) * stddev_pop(seq), 0), 6) AS r FROM taps GROUP BY trip_id")
def _(spark: SparkSession) -> DataFrame:
    return spark.table("taps").groupBy("trip_id").agg(F.round(S.pearson(F.col("fare_cents").cast("double"), F.col("seq").cast("double")), 6).alias("r"))


plain("a11_any", "SELECT bus_id, bool_or(closed < opened) AS any_reversed, bool_or(status = 'F') AS any_final FROM trips GROUP BY bus_id")
plain("a12_percentiles", "SELECT route_id, percentile_cont(0.5) WITHIN GROUP (ORDER BY closed - opened) AS median_s, percentile_cont(0.9) WITHIN GROUP (ORDER BY closed - opened) AS p90_s FROM trips GROUP BY route_id")
plain("a13_nan_aware", "SELECT bus_id, percentile_cont(0.5) WITHIN GROUP (ORDER BY nullif(direction, 0) * 1e0) AS median_dir, max(nullif(direction, 2)) AS top_dir FROM trips GROUP BY bus_id")
plain("a14_multi_stat", "SELECT bus_id, percentile_cont(0.5) WITHIN GROUP (ORDER BY price) AS price_median, round(avg(price), 6) AS price_mean, round(stddev_samp(price), 3) AS price_std, count(price) AS n FROM trips GROUP BY bus_id")
plain("a15_fraction_true", "SELECT bus_id, round(avg(CASE WHEN status = 'F' THEN 1e0 ELSE 0e0 END), 9) AS share_final, count(*) FILTER (WHERE price > 200000) AS n_dear FROM trips GROUP BY bus_id")
plain("a16_rms_to_centroid", "SELECT p.device, round(sqrt(avg((p.lat - c.lat) * (p.lat - c.lat) + (p.lon - c.lon) * (p.lon - c.lon))), 7) AS rms FROM pings p JOIN (SELECT device, avg(lat) AS lat, avg(lon) AS lon FROM pings GROUP BY device) c ON c.device = p.device GROUP BY p.device")


@query("a17_leave_one_out", "SELECT trip_id, (sum(x) OVER w - coalesce(x, 0)) / nullif(count(x) OVER w - CASE WHEN x IS NULL THEN 0 ELSE 1 END, 0) AS others, count(x) OVER w - CASE WHEN x IS NULL THEN 0 ELSE 1 END AS n_loo FROM (SELECT *, CASE WHEN trip_id % 6 = 0 THEN NULL ELSE CAST(direction + trip_id % 50 AS DOUBLE) END AS x FROM trips) t WINDOW w AS (PARTITION BY route_id, bus_id)")
def _(spark: SparkSession) -> DataFrame:
    t = spark.table("trips").withColumn("x", F.when(F.col("trip_id") % 6 != 0, (F.col("direction") + F.col("trip_id") % 50).cast("double")))
    mean, n = R.leave_one_out(F.col("x"), W.partitionBy("route_id", "bus_id"))
    return t.select("trip_id", mean.alias("others"), n.alias("n_loo"))


plain("a18_reverse_group", "SELECT t.trip_id, r.m AS reverse_mean FROM trips t LEFT JOIN (SELECT route_id, direction, avg(CAST(trip_id % 100 AS DOUBLE)) AS m FROM trips GROUP BY route_id, direction) r ON r.route_id = t.route_id AND r.direction = CASE t.direction WHEN 0 THEN 1 WHEN 1 THEN 0 END")
plain("a19_distinct", "SELECT DISTINCT route_id, status FROM trips UNION SELECT DISTINCT card, kind FROM taps")
plain("a20_conservation", "SELECT coalesce(a.d, b.d) AS d, coalesce(a.n, 0) AS fares, coalesce(b.n, 0) AS joined, coalesce(a.n, 0) = coalesce(b.n, 0) AS kept FROM (SELECT tap_date AS d, count(*) AS n FROM taps GROUP BY tap_date) a FULL JOIN (SELECT tap_date AS d, count(*) AS n FROM taps JOIN trips ON trips.trip_id = taps.trip_id GROUP BY tap_date) b ON a.d = b.d")
plain("a21_device_profile", "SELECT c.device, round(sqrt(c.vy + c.vx), 6) AS gyration, m.zone FROM (SELECT device, var_pop(lat) AS vy, var_pop(lon) AS vx FROM pings GROUP BY device) c JOIN (SELECT device, zone FROM (SELECT device, zone, row_number() OVER (PARTITION BY device ORDER BY n DESC, zone) AS rn FROM (SELECT device, event_id % 4 AS zone, count(*) AS n FROM pings GROUP BY device, event_id % 4) z) y WHERE rn = 1) m ON m.device = c.device")
plain("a22_contingency", "SELECT kind, count(*) FILTER (WHERE stop_id < 8) AS low, count(*) FILTER (WHERE stop_id BETWEEN 8 AND 16) AS middle, count(*) FILTER (WHERE stop_id > 16) AS high FROM taps GROUP BY kind")
plain("a23_value_counts", "SELECT event_type, count(*) AS n, round(count(*) * 1e0 / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY event_type")

# ---- windows -------------------------------------------------------------------------------------------------------
plain("w01_lag", "SELECT event_id, ep - lag(ep) OVER (PARTITION BY device ORDER BY ep, event_id) AS gap FROM pings")
plain("w02_running_sum_range", "SELECT trip_id, CAST(sum(direction) OVER (PARTITION BY route_id ORDER BY trip_date) AS BIGINT) AS so_far FROM trips")
plain("w03_running_max", "SELECT event_id, max(lat) OVER (PARTITION BY device ORDER BY ep) AS progress FROM pings")
plain("w04_top_n", "SELECT bus_id, trip_id, CAST(rn AS BIGINT) AS rn FROM (SELECT bus_id, trip_id, row_number() OVER (PARTITION BY bus_id ORDER BY price DESC, trip_id) AS rn FROM trips) x WHERE rn <= 3")
plain("w05_boolean_order_nulls_first", "SELECT route_id, trip_id FROM (SELECT route_id, trip_id, row_number() OVER (PARTITION BY route_id, bus_id ORDER BY (nullif(direction, 2) = 1) DESC NULLS FIRST, price DESC, trip_id) AS rn FROM trips) x WHERE rn = 1")
plain("w06_window_count_if", "SELECT trip_id, CAST(sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY bus_id) AS BIGINT) AS final_of_bus FROM trips")
plain("w07_partition_totals", "SELECT trip_id, seq, CAST(sum(fare_cents) OVER (PARTITION BY trip_id) AS BIGINT) AS total, count(*) OVER (PARTITION BY trip_id) AS n FROM taps")
plain("w08_total_order_ids", "SELECT trip_id, CAST(row_number() OVER (ORDER BY bus_id, opened, trip_id) AS BIGINT) AS surrogate FROM trips")


@query("w09_first_per_key", "SELECT bus_id, trip_id, trip_date FROM (SELECT *, row_number() OVER (PARTITION BY bus_id ORDER BY trip_date, trip_id) AS rn FROM trips) x WHERE rn = 1")
def _(spark: SparkSession) -> DataFrame:
    return R.first_per(spark.table("trips"), ["bus_id"], F.col("trip_date"), F.col("trip_id")).select("bus_id", "trip_id", "trip_date")


plain("w10_first_and_last", "SELECT trip_id, max(CASE WHEN rf = 1 THEN card END) AS first_card, max(CASE WHEN rl = 1 THEN card END) AS last_card FROM (SELECT trip_id, card, row_number() OVER (PARTITION BY trip_id ORDER BY seq, card, fare_cents) AS rf, row_number() OVER (PARTITION BY trip_id ORDER BY seq DESC, card DESC, fare_cents DESC) AS rl FROM taps) x GROUP BY trip_id")
plain("w11_ranks", "SELECT trip_id, seq, fare_cents, CAST(rank() OVER (PARTITION BY trip_id ORDER BY kind) AS BIGINT) AS min_rank FROM taps")


@query("w12_best_elsewhere", "SELECT trip_id, status, CASE WHEN rn = 1 THEN second ELSE best END AS best_elsewhere FROM (SELECT trip_id, status, row_number() OVER w AS rn, max(price) OVER (PARTITION BY route_id, trip_date) AS best, nth_value(price, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM trips WINDOW w AS (PARTITION BY route_id, trip_date ORDER BY price DESC, trip_id)) x")
def _(spark: SparkSession) -> DataFrame:
    w = W.partitionBy("route_id", "trip_date").orderBy(F.desc("price"), "trip_id")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = spark.table("trips").withColumns({"rn": F.row_number().over(w), "best": F.max("price").over(W.partitionBy("route_id", "trip_date")), "second": F.nth_value("price", 2).over(whole)})
    return x.select("trip_id", "status", F.when(F.col("rn") == 1, F.col("second")).otherwise(F.col("best")).alias("best_elsewhere"))


@query("w13_softmax", "SELECT trip_id, seq, fare_cents, round(exp(s - max(s) OVER w) / sum(exp(s - m)) OVER w, 9) AS p FROM (SELECT *, max(s) OVER (PARTITION BY trip_id) AS m FROM (SELECT *, fare_cents / 1e6 AS s FROM taps) a) b WINDOW w AS (PARTITION BY trip_id)")
def _(spark: SparkSession) -> DataFrame:
    p = R.softmax(F.col("fare_cents") / F.lit(1e6), W.partitionBy("trip_id"))
    return spark.table("taps").withColumn("p", F.round(p, 9)).select("trip_id", "seq", "fare_cents", "p")


plain("w14_margin", "SELECT bus_id, trip_id, price - runner_up AS margin FROM (SELECT bus_id, trip_id, price, lead(price) OVER w AS runner_up, row_number() OVER w AS rn FROM trips WINDOW w AS (PARTITION BY bus_id ORDER BY price DESC, trip_id)) x WHERE rn = 1")


@query("w15_day_islands", "SELECT bus_id, min(d) AS start_date, max(d) AS end_date, count(*) AS n_days FROM (SELECT bus_id, d, d - CAST(row_number() OVER (PARTITION BY bus_id ORDER BY d) AS INT) AS a FROM (SELECT DISTINCT lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS bus_id, CAST(l_shipdate AS DATE) AS d FROM lineitem) x) y GROUP BY bus_id, a")
def _(spark: SparkSession) -> DataFrame:
    x = spark.table("lineitem").select(F.lpad(F.col("l_suppkey").cast("string"), 5, "0").alias("bus_id"), F.to_date("l_shipdate").alias("d"))
    return R.day_islands(x, ["bus_id"], "d")


@query("w16_sessions", "SELECT event_id, CAST(sum(j) OVER (PARTITION BY device ORDER BY ep, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN ep - lag(ep) OVER (PARTITION BY device ORDER BY ep, event_id) > 36000 THEN 1 ELSE 0 END AS j FROM pings) x")
def _(spark: SparkSession) -> DataFrame:
    return R.sessions(spark.table("pings"), ["device"], "ep", 36000.0, "event_id").select("event_id", "session")


plain("w17_headway", "SELECT trip_id, seq, fare_cents, tapped - lag(tapped) OVER (PARTITION BY stop_id, kind ORDER BY tapped, trip_id, seq, fare_cents) AS headway FROM taps")
plain("w18_previous_and_next", "SELECT trip_id, lag(trip_id) OVER (PARTITION BY bus_id ORDER BY opened, trip_id) AS previous, lead(trip_id) OVER (PARTITION BY bus_id ORDER BY opened, trip_id) AS following FROM trips")
plain("w20_named_window", "SELECT event_id, lag(lat) OVER w AS before, max(lat) OVER w AS progress FROM pings WINDOW w AS (PARTITION BY device ORDER BY ep, event_id)")

# ---- sorts, limits, samples ------------------------------------------------------------------------------------------
plain("o01_order_nulls_last", "SELECT bus_id, CAST(row_number() OVER (ORDER BY last_final DESC NULLS LAST, bus_id) AS BIGINT) AS place FROM (SELECT bus_id, max(CASE WHEN status = 'F' THEN price END) AS last_final FROM trips GROUP BY bus_id) x")
plain("o02_top_k", "SELECT trip_id, price FROM trips ORDER BY price DESC, trip_id LIMIT 20")
plain("o03_top_n_per_group", "SELECT kind, trip_id, fare_cents FROM (SELECT kind, trip_id, fare_cents, row_number() OVER (PARTITION BY kind, tap_date ORDER BY fare_cents DESC, trip_id, seq) AS rn FROM taps) x WHERE rn <= 10")


@query("o04_hashed_sample")
def _(spark: SparkSession) -> DataFrame:
    return R.hashed_sample(spark.table("trips").select("trip_id"), 100, "trip_id")


@query("o05_evenly_spaced", "WITH r AS (SELECT trip_id, bus_id, row_number() OVER (PARTITION BY bus_id ORDER BY opened, trip_id) - 1 AS i, count(*) OVER (PARTITION BY bus_id) AS n FROM trips) SELECT trip_id FROM r WHERE n <= 8 OR list_contains([CAST(round_even(k * (n - 1) / 7e0, 0) AS BIGINT) FOR k IN range(0, 8)], i)")
def _(spark: SparkSession) -> DataFrame:
    return R.evenly_spaced(spark.table("trips"), ["bus_id"], ["opened", "trip_id"], 8).select("trip_id")


plain("o06_strided", "SELECT bus_id, trip_id FROM (SELECT bus_id, trip_id, row_number() OVER (PARTITION BY bus_id ORDER BY opened, trip_id) AS rn, count(*) OVER (PARTITION BY bus_id) AS n FROM trips) x WHERE (rn - 1) % greatest(CAST(floor(n / 3) AS BIGINT), 1) = 0 AND (rn - 1) / greatest(CAST(floor(n / 3) AS BIGINT), 1) < 3", "SELECT bus_id, trip_id FROM (SELECT bus_id, trip_id, row_number() OVER (PARTITION BY bus_id ORDER BY opened, trip_id) AS rn, count(*) OVER (PARTITION BY bus_id) AS n FROM trips) x WHERE (rn - 1) % greatest(n // 3, 1) = 0 AND (rn - 1) // greatest(n // 3, 1) < 3")
plain("o07_most_uncertain", "SELECT event_id, p FROM (SELECT event_id, (event_id * 7919 % 1000) / 1000e0 AS p FROM events) e ORDER BY abs(p - 0.5e0), event_id LIMIT 200")


@query("o08_stratified_sample")
def _(spark: SparkSession) -> DataFrame:
    t = spark.table("trips").withColumn("band", F.floor(F.col("price") / 100000).cast("int"))
    return R.top_per(t, ["band"], 25, F.xxhash64("trip_id", F.lit(42)), F.col("trip_id")).select("band", "trip_id")


plain("o09_entity_time_order", "SELECT device, ep, event_id FROM pings SORT BY device, ep", "SELECT device, ep, event_id FROM pings")

# ---- set operations ------------------------------------------------------------------------------------------------
plain("u01_union_all", "SELECT trip_id, opened AS at FROM trips UNION ALL SELECT trip_id, tapped FROM taps")
plain("u02_union", "SELECT bus_id FROM trips UNION SELECT card FROM taps")
plain("u03_set_algebra", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT l_suppkey FROM lineitem")
plain("u04_concat_keep_first", "SELECT k, origin FROM (SELECT k, origin, row_number() OVER (PARTITION BY k ORDER BY origin) AS rn FROM (SELECT o_custkey AS k, 1 AS origin FROM orders UNION ALL SELECT c_custkey, 2 FROM customer) u) x WHERE rn = 1")
plain("u05_dedup_with_conflict", "SELECT l_orderkey, l_linenumber, l_partkey, conflicting FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) AS rn, min(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) <> max(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS conflicting FROM lineitem) x WHERE rn = 1")
