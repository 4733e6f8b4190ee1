"""Blocking, pair features, labels, rankings, audits, exclusions, unclaimed devices, crosswalk and device classes over the bridge views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelane.operators import pairs as P
from farelane.plans.catalog import query

_RUN = "running AS (SELECT DISTINCT bus_id, date FROM candidates)"


def _running(spark: SparkSession) -> DataFrame:
    return spark.table("candidates").select("bus_id", "date").distinct()


@query(
    "m12_candidate_blocking",
    f"""WITH {_RUN}, o AS (SELECT b.date, b.bus_id, d.device_id, count(*) AS n FROM (SELECT DISTINCT * FROM bus_cells) b JOIN (SELECT DISTINCT * FROM device_cells) d ON d.date = b.date AND d.cell_x = b.cell_x AND d.cell_y = b.cell_y AND d.time_bucket = b.time_bucket GROUP BY b.date, b.bus_id, d.device_id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, bus_id ORDER BY n DESC, device_id) AS rn FROM o) x WHERE rn <= 10),
c AS (SELECT DISTINCT r.date, r.bus_id, p.device_id FROM running r JOIN dictionary_pairs p ON p.bus_id = r.bus_id)
SELECT coalesce(t.date, c.date) AS date, coalesce(t.bus_id, c.bus_id) AS bus_id, coalesce(t.device_id, c.device_id) AS device_id, n AS overlap_count, t.bus_id IS NOT NULL AS from_blocking, c.bus_id IS NOT NULL AS from_dictionary FROM t FULL JOIN c ON c.date = t.date AND c.bus_id = t.bus_id AND c.device_id = t.device_id""",
)
def _(spark: SparkSession) -> DataFrame:
    return P.candidates(spark.table("bus_cells"), spark.table("device_cells"), spark.table("dictionary_pairs"), _running(spark))


_DAYS = "days AS (SELECT bus_id, device_id, date, h % 3 AS n_trips_with_data, score AS day_score, " + ", ".join(f"CASE WHEN h % {k + 4} = 0 THEN NULL ELSE h * {k + 1} % 23 / 22e0 END AS {c}" for k, c in enumerate(P.CARRIED)) + " FROM candidates)"
_STATS = ", ".join(f"round(median({c}), 9) AS {c}__median, round(avg({c}), 9) AS {c}__mean, round(stddev_samp({c}), 9) AS {c}__std" for c in P.CARRIED)
_FEATURES = f"""WITH {_RUN}, {_DAYS},
a AS (SELECT bus_id, device_id, {_STATS}, count(*) AS n_days_with_features, count(*) FILTER (WHERE n_trips_with_data > 0) AS n_days_with_data, median(day_score) AS day_score_median, round(avg(day_score), 9) AS day_score_mean, max(day_score) AS day_score_max, min(day_score) AS day_score_min, round(stddev_samp(day_score), 9) AS day_score_std, round(avg(CASE WHEN day_score >= 0.5 THEN 1e0 ELSE 0e0 END), 9) AS day_score_frac_above_half FROM days GROUP BY bus_id, device_id),
r AS (SELECT *, CASE WHEN day_score_mean IS NOT NULL THEN rank() OVER (PARTITION BY bus_id ORDER BY day_score_mean DESC NULLS LAST) END AS bus_rank, round(max(day_score_mean) OVER (PARTITION BY bus_id) - day_score_mean, 9) AS score_gap_to_bus_best, count(*) OVER (PARTITION BY bus_id) AS n_candidates_for_bus,
 CASE WHEN day_score_mean IS NOT NULL THEN rank() OVER (PARTITION BY device_id ORDER BY day_score_mean DESC NULLS LAST) END AS device_rank, round(max(day_score_mean) OVER (PARTITION BY device_id) - day_score_mean, 9) AS score_gap_to_device_best, count(*) OVER (PARTITION BY device_id) AS n_buses_claiming_device FROM a),
n1 AS (SELECT bus_id, device_id, count(DISTINCT origin) AS s FROM dictionary_pairs GROUP BY bus_id, device_id), n2 AS (SELECT bus_id, count(DISTINCT device_id) AS b FROM dictionary_pairs GROUP BY bus_id), n3 AS (SELECT device_id, count(DISTINCT bus_id) AS d FROM dictionary_pairs GROUP BY device_id), n4 AS (SELECT bus_id, count(DISTINCT date) AS ran FROM running GROUP BY bus_id)
SELECT r.*, CASE WHEN bus_rank = 1 AND device_rank = 1 THEN 1 ELSE 0 END AS is_mutual_best, coalesce(s, 0) AS n_dictionary_sources, CASE WHEN s IS NULL THEN 0 ELSE b END AS n_dict_devices_for_bus, CASE WHEN s IS NULL THEN 0 ELSE d END AS n_dict_buses_for_device, coalesce(ran, 0) AS n_days_bus_ran,
CASE WHEN s IS NOT NULL AND b > 1 THEN 1 ELSE 0 END AS bus_has_dictionary_conflict, CASE WHEN s IS NOT NULL AND d > 1 THEN 1 ELSE 0 END AS device_has_dictionary_conflict, round(CASE WHEN ran > 0 THEN n_days_with_data * 1e0 / ran END, 9) AS frac_bus_days_with_data
FROM r LEFT JOIN n1 ON n1.bus_id = r.bus_id AND n1.device_id = r.device_id LEFT JOIN n2 ON n2.bus_id = r.bus_id LEFT JOIN n3 ON n3.device_id = r.device_id LEFT JOIN n4 ON n4.bus_id = r.bus_id"""


def days(spark: SparkSession) -> DataFrame:
    return spark.sql(f"WITH {_DAYS} SELECT * FROM days")


@query("m14_pair_month_features", _FEATURES)
def _(spark: SparkSession) -> DataFrame:
    out = P.pair_features(days(spark).withColumn("day_score", F.col("day_score")), spark.table("dictionary_pairs"), _running(spark))
    whole = {"day_score_median", "day_score_max", "day_score_min"}
    return out.select(*[F.round(f.name, 9).alias(f.name) if f.dataType.typeName() == "double" and f.name not in whole else f.name for f in out.schema])


_RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY bus_id ORDER BY pair_score DESC, device_id) AS pair_rank, count(*) OVER (PARTITION BY bus_id) AS n_candidates_for_bus FROM pair_scores), rm AS (SELECT bus_id, max(pair_score) - coalesce(max(CASE WHEN pair_rank = 2 THEN pair_score END), 0) AS pair_margin FROM rk GROUP BY bus_id), ranked AS (SELECT rk.*, pair_margin FROM rk JOIN rm ON rm.bus_id = rk.bus_id)"


def _ranked(spark: SparkSession) -> DataFrame:
    return P.ranked(spark.table("pair_scores"))


@query(
    "m15_label_expansion",
    """WITH good AS (SELECT bus_id, device_id FROM pair_labels WHERE verdict = 'correct'), bad AS (SELECT bus_id, device_id FROM pair_labels WHERE verdict = 'wrong')
SELECT s.bus_id, s.device_id, EXISTS (SELECT 1 FROM good g WHERE g.bus_id = s.bus_id AND g.device_id = s.device_id) AS label FROM pair_scores s WHERE s.bus_id IN (SELECT bus_id FROM good)
UNION ALL SELECT s.bus_id, s.device_id, FALSE FROM pair_scores s JOIN bad ON bad.bus_id = s.bus_id AND bad.device_id = s.device_id WHERE s.bus_id NOT IN (SELECT bus_id FROM good)""",
)
def _(spark: SparkSession) -> DataFrame:
    return P.training_rows(spark.table("pair_scores"), spark.table("pair_labels")).select("bus_id", "device_id", "label")


@query("m17_group_folds", "SELECT CAST(k AS INT) AS fold, count(*) AS groups FROM (SELECT (row_number() OVER (ORDER BY bus_id) - 1) % 5 AS k FROM (SELECT DISTINCT bus_id FROM trips) b) x GROUP BY k")
def _(spark: SparkSession) -> DataFrame:
    """Folds hold whole groups and nearly equal numbers of them."""
    f = P.folds(spark.table("trips").select("trip_id", "bus_id"), "bus_id")
    return f.groupBy("fold").agg(F.countDistinct("bus_id").alias("groups"))


_OUT_BUSES = "real AS (SELECT DISTINCT bus_id FROM candidates), dev AS (SELECT s_nationkey AS company, concat('ep', lpad(CAST(s_suppkey + s_nationkey % 3 AS VARCHAR(20)), 6, '0')) AS device_id, s_suppkey AS k FROM supplier), ping AS (SELECT DISTINCT device_id FROM candidates WHERE CAST(bus_id AS INT) % 4 = 1), silent AS (SELECT company FROM dev LEFT JOIN ping USING (device_id) GROUP BY company HAVING count(ping.device_id) = 0), ex AS (SELECT bus_id FROM real WHERE bus_id LIKE '0000%' OR bus_id IN (SELECT lpad(CAST(k AS VARCHAR(20)), 5, '0') FROM dev WHERE company IN (SELECT company FROM silent)))"


def _excluded(spark: SparkSession) -> DataFrame:
    dev = spark.sql("SELECT s_nationkey AS company, concat('ep', lpad(CAST(s_suppkey + s_nationkey % 3 AS STRING), 6, '0')) AS device_id, concat('N-', s_suppkey) AS vehicle_number FROM supplier")
    ping = spark.table("candidates").where("CAST(bus_id AS INT) % 4 = 1").select("device_id")
    return P.excluded_buses(dev, ping, _running(spark), ("0000",))


@query("m25_structural_exclusions", f"WITH {_OUT_BUSES.replace('ping.device_id)', 'p.device_id)').replace('LEFT JOIN ping USING (device_id)', 'LEFT JOIN ping p ON p.device_id = dev.device_id')} SELECT bus_id FROM ex")
def _(spark: SparkSession) -> DataFrame:
    return _excluded(spark)


@query(
    "m24_unclaimed_reasons",
    f"""WITH {_RANKED}, active AS (SELECT concat('ep', lpad(CAST(k AS VARCHAR(20)), 6, '0')) AS device_id, k % 7 AS n_pings FROM (SELECT s_suppkey + 3 AS k FROM supplier) x), claimed AS (SELECT device_id FROM ranked WHERE pair_rank = 1 AND pair_score >= 0.9e0), out_ AS (SELECT DISTINCT bus_id FROM candidates WHERE bus_id LIKE '%5'),
tries AS (SELECT device_id, count(*) AS buses, count(*) FILTER (WHERE bus_id NOT IN (SELECT bus_id FROM out_)) AS in_scope FROM (SELECT DISTINCT bus_id, device_id FROM candidates) c GROUP BY device_id),
best AS (SELECT device_id, bus_id, pair_score FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY pair_score DESC, bus_id) AS rn FROM ranked) x WHERE rn = 1), named AS (SELECT device_id, string_agg(DISTINCT bus_id, ',' ORDER BY bus_id) AS dictionary_bus_ids FROM dictionary_pairs GROUP BY device_id)
SELECT a.device_id, n_pings, dictionary_bus_ids, CASE WHEN buses IS NULL THEN 'never_blocked' WHEN in_scope = 0 THEN 'blocked_only_to_excluded_bus' ELSE 'lost_competition' END AS reason, dictionary_bus_ids IS NOT NULL AS in_dictionary, CASE WHEN in_scope > 0 THEN bus_id END AS best_candidate_bus_id, CASE WHEN in_scope > 0 THEN pair_score END AS best_candidate_score
FROM active a LEFT JOIN tries t ON t.device_id = a.device_id LEFT JOIN best b ON b.device_id = a.device_id LEFT JOIN named n ON n.device_id = a.device_id WHERE a.device_id NOT IN (SELECT device_id FROM claimed)""",
)
def _(spark: SparkSession) -> DataFrame:
    rank = _ranked(spark)
    active = spark.sql("SELECT concat('ep', lpad(CAST(s_suppkey + 3 AS STRING), 6, '0')) AS device_id, (s_suppkey + 3) % 7 AS n_pings FROM supplier")
    claimed = rank.where("pair_rank = 1 and pair_score >= 0.9")
    return P.unclaimed(active, claimed, spark.table("candidates"), spark.table("candidates").where("bus_id LIKE '%5'"), rank, spark.table("dictionary_pairs"))


_BANDS = "CASE WHEN model_confidence >= 0.9e0 AND model_confidence < 0.99e0 THEN '0.9-0.99' WHEN model_confidence >= 0.99e0 AND model_confidence < 0.999e0 THEN '0.99-0.999' WHEN model_confidence >= 0.999e0 AND model_confidence < 1.01e0 THEN '0.999-1.01' END"
_AUDIT = f"own AS (SELECT *, {_BANDS} AS band FROM pair_labels WHERE label_source = 'audit' AND verdict IN ('correct', 'wrong')), au AS (SELECT band, count(*) AS n, count(*) FILTER (WHERE verdict = 'correct') AS n_correct FROM own WHERE band IS NOT NULL GROUP BY band UNION ALL SELECT 'all', count(*), count(*) FILTER (WHERE verdict = 'correct') FROM own)"


@query("m26_audit_by_band", f"WITH {_AUDIT} SELECT band, n, n_correct, n_correct * 1e0 / nullif(n, 0) AS precision FROM au")
def _(spark: SparkSession) -> DataFrame:
    return P.audit(spark.table("pair_labels"))


@query("m26_precision_at", f"WITH {_RANKED} SELECT count(l.verdict) AS n, count(*) FILTER (WHERE l.verdict = 'correct') AS n_correct, count(*) FILTER (WHERE l.verdict = 'correct') * 1e0 / nullif(count(l.verdict), 0) AS precision, count(*) AS coverage_buses FROM ranked r LEFT JOIN (SELECT * FROM pair_labels WHERE verdict <> 'unsure') l ON l.bus_id = r.bus_id AND l.device_id = r.device_id WHERE pair_rank = 1 AND pair_score >= 0.9e0")
def _(spark: SparkSession) -> DataFrame:
    return P.precision_at(_ranked(spark), spark.table("pair_labels"))


@query(
    "m26_stopping_signal",
    f"WITH {_RANKED}, {_AUDIT}, q AS (SELECT count(*) AS queue, count(*) FILTER (WHERE pair_score < 0.9e0) AS remaining FROM ranked WHERE pair_rank = 1 AND pair_score >= 0.01e0 AND bus_id NOT IN (SELECT bus_id FROM pair_labels)), m AS (SELECT n, n_correct * 1e0 / nullif(n, 0) AS p FROM au WHERE band = 'all') SELECT remaining, n AS n_measured, p AS precision, CASE WHEN n < 30 THEN 'too_early' WHEN p < 0.95 THEN 'precision_low' WHEN queue = 0 THEN 'queue_empty' WHEN remaining = 0 THEN 'done' ELSE 'keep_going' END AS verdict FROM q CROSS JOIN m",
)
def _(spark: SparkSession) -> DataFrame:
    return P.stopping_signal(_ranked(spark), spark.table("pair_labels"))


@query(
    "m27_crosswalk",
    """WITH v AS (SELECT CASE WHEN length(n) < 5 THEN lpad(n, 5, '0') ELSE n END AS bus_id, min(CAST(entry AS BIGINT)) AS v FROM (SELECT regexp_replace(code, '[^0-9]', '', 'g') AS n, entry FROM dictionary) x WHERE n <> '' GROUP BY 1),
d AS (SELECT lpad(code, 5, '0') AS bus_id, min(raw_code) AS d FROM dictionary WHERE regexp_matches(code, '^[0-9]+$') GROUP BY 1)
SELECT b.bus_id, d IS NOT NULL OR v IS NOT NULL AS avl_matched, CASE WHEN d IS NOT NULL THEN 'dictionary_device' WHEN v IS NOT NULL THEN 'dictionary_vehicle' END AS avl_match_source, CASE WHEN d IS NULL THEN v END AS avl_vehicle_id, d AS avl_device_id FROM (SELECT DISTINCT bus_id FROM trips) b LEFT JOIN d ON d.bus_id = b.bus_id LEFT JOIN v ON v.bus_id = b.bus_id""",
)
def _(spark: SparkSession) -> DataFrame:
    d = spark.table("dictionary")
    return P.crosswalk(spark.table("trips"), d.select("code", F.col("entry").alias("vehicle_id")), d.select("code", F.col("raw_code").alias("device_id")))


_FAR = "2 * 6371008.8e0 * asin(sqrt(least(power(sin(radians(lat - {y}) / 2), 2) + cos(radians({y})) * cos(radians(lat)) * power(sin(radians(lon - {x}) / 2), 2), 1e0)))"


@query(
    "m34_device_classes",
    f"""WITH s AS (SELECT *, event_id % 40 AS speed, ep - lag(ep) OVER w AS dt, lag(lat) OVER w AS py, lag(lon) OVER w AS px, avg(lat) OVER (PARTITION BY device) AS cy, avg(lon) OVER (PARTITION BY device) AS cx FROM pings WHERE lat < 0 WINDOW w AS (PARTITION BY device ORDER BY ep, event_id)),
a AS (SELECT device, count(DISTINCT CAST(floor(ep / 86400) AS BIGINT)) AS active_days, count(*) AS n_pings, sqrt(avg({_FAR.format(x='cx', y='cy')} * {_FAR.format(x='cx', y='cy')})) AS radius_m, avg(CASE WHEN speed <= 3 THEN 1e0 ELSE 0e0 END) AS stationary_share, avg(CASE WHEN dt > 0 THEN CASE WHEN {_FAR.format(x='px', y='py')} / dt * 3.6e0 > 150 THEN 1e0 ELSE 0e0 END END) AS wild FROM s GROUP BY device)
SELECT device, active_days, n_pings, round(radius_m, 3) AS radius_m, round(stationary_share, 9) AS stationary_share, CASE WHEN n_pings < 20 OR active_days < 2 THEN 'sparse' WHEN wild > 0.5e0 THEN 'erratic' WHEN radius_m < 200 THEN 'stationary' ELSE 'mobile' END AS class FROM a""",
)
def _(spark: SparkSession) -> DataFrame:
    p = spark.table("pings").where("lat < 0").select("device", F.floor(F.col("ep") / 86400).alias("day"), F.col("ep").alias("at"), "lon", "lat", (F.col("event_id") % 40).alias("speed"), F.col("event_id").alias("point_id"))
    return P.device_profiles(p).withColumns({"radius_m": F.round("radius_m", 3), "stationary_share": F.round("stationary_share", 9)})


_TOPS = "SELECT bus_id, device_id, pair_score, {}n_candidates_for_bus FROM ranked WHERE pair_rank = 1 AND "


@query("m35_label_queue", f"WITH {_RANKED} {_TOPS.format('pair_margin, ')} pair_score >= 0.01e0 AND bus_id NOT IN (SELECT bus_id FROM pair_labels) ORDER BY pair_margin, bus_id LIMIT 50")
def _(spark: SparkSession) -> DataFrame:
    return P.hard_buses(_ranked(spark), spark.table("pair_labels"))


@query("m35_no_evidence", f"WITH {_RANKED} {_TOPS.format('')} pair_score < 0.01e0")
def _(spark: SparkSession) -> DataFrame:
    return P.no_evidence(_ranked(spark))
