"""Candidate pairs of buses and devices: blocking, features over a period, labels, rankings, audits, and what stays unclaimed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farelane.functions import geo as G
from farelane.operators import relational as R
from farelane.operators import tallies as T

PAIR = ["bus_id", "device_id"]
# Fixed values.
TOP_BLOCKED, EVIDENCE, SHIP, AUDIT_LEAST, PREFIXES = 10, 0.01, 0.9, 30, ("67",)
BANDS = ((0.90, 0.99), (0.99, 0.999), (0.999, 1.01))
#: Day features that are carried up to the pair, each as median, mean and standard deviation. Fixed values.
CARRIED = (
    "frac_good_trips", "median_buffer_coverage_50", "median_shape_coverage", "median_direction_margin", "median_route_id_agreement", "median_offset_m", "worst_contradiction_fraction",
    "max_excursion_m", "median_start_dist_stop_m", "median_end_dist_stop_m", "median_heading_consistency", "median_direction_agreement", "median_fare_stationary_fraction", "median_fare_near_stop_m",
    "frac_device_points_in_windows", "frac_device_moving_points_in_windows", "n_clearly_bad_trips",
)


def candidates(buses: DataFrame, devices: DataFrame, dictionary: DataFrame, running: DataFrame, top: int = TOP_BLOCKED) -> DataFrame:
    """(date, bus_id, device_id, overlap_count, from_blocking, from_dictionary): the `top` devices that share most cells with a
    bus on a date (ties by device), and every pair of the dictionary on dates the bus runs.

    buses, devices: date, cell_x, cell_y, time_bucket and their id; repeated rows count once. Pairs are counted in tiles of a date and
    never listed, however many meet in a crowded cell.
    """
    cell = ["date", "cell_x", "cell_y", "time_bucket"]
    best = T.most_shared(buses, devices, "date", cell[1:], "bus_id", "device_id", top, "overlap_count").withColumn("from_blocking", F.lit(True))
    named = running.select("date", "bus_id").distinct().join(dictionary.select(*PAIR).distinct(), "bus_id").withColumn("from_dictionary", F.lit(True))
    out = best.join(named, ["date", "bus_id", "device_id"], "full")
    return out.select("date", *PAIR, "overlap_count", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("from_blocking", "from_dictionary")])


def pair_features(days: DataFrame, dictionary: DataFrame, running: DataFrame, carried: tuple[str, ...] = CARRIED) -> DataFrame:
    """One row a pair from its days (bus_id, device_id, date, n_trips_with_data, day_score and `carried`).

    Medians, means and deviations of the carried features; the day score's spread and its share from a half up; ranks among the
    bus's and the device's candidates by mean score (to 9 digits; ties share the better rank), gaps to the best, mutual best; how
    many dictionaries name the pair and whether they contradict; and the share of the bus's running days with data.
    dictionary: bus_id, device_id, origin. running: bus_id, date.
    """
    stats = [f(F.col(c)).alias(f"{c}__{name}") for c in carried for name, f in (("median", F.median), ("mean", F.avg), ("std", F.stddev_samp))]
    s = F.col("day_score")
    scores = [F.median(s).alias("day_score_median"), F.avg(s).alias("day_score_mean"), F.max(s).alias("day_score_max"), F.min(s).alias("day_score_min"), F.stddev_samp(s).alias("day_score_std"), F.avg((F.coalesce(s, F.lit(0.0)) >= 0.5).cast("double")).alias("day_score_frac_above_half")]
    pairs = days.groupBy(*PAIR).agg(*stats, F.count(F.lit(1)).alias("n_days_with_features"), F.count_if(F.col("n_trips_with_data") > 0).alias("n_days_with_data"), *scores)
    mean = F.round("day_score_mean", 9)  # sums in another order don't tell equal means apart
    for key, rank, gap, n in (("bus_id", "bus_rank", "score_gap_to_bus_best", "n_candidates_for_bus"), ("device_id", "device_rank", "score_gap_to_device_best", "n_buses_claiming_device")):
        w = W.partitionBy(key)
        pairs = pairs.withColumns({rank: F.when(mean.isNotNull(), F.rank().over(w.orderBy(mean.desc_nulls_last()))), gap: F.max(mean).over(w) - mean, n: F.count(F.lit(1)).over(w)})
    pairs = pairs.withColumn("is_mutual_best", F.when((F.col("bus_rank") == 1) & (F.col("device_rank") == 1), 1).otherwise(0))
    sources = dictionary.groupBy(*PAIR).agg(F.countDistinct("origin").alias("n_dictionary_sources"))
    by_bus = dictionary.groupBy("bus_id").agg(F.countDistinct("device_id").alias("of_bus"))
    by_device = dictionary.groupBy("device_id").agg(F.countDistinct("bus_id").alias("of_device"))
    ran = running.groupBy("bus_id").agg(F.countDistinct("date").alias("n_days_bus_ran"))
    named = sources.join(by_bus, "bus_id").join(by_device, "device_id").select(*PAIR, "n_dictionary_sources", F.col("of_bus").alias("n_dict_devices_for_bus"), F.col("of_device").alias("n_dict_buses_for_device"))
    out = pairs.join(named, PAIR, "left").join(ran, "bus_id", "left").na.fill(0, ["n_dictionary_sources", "n_dict_devices_for_bus", "n_dict_buses_for_device", "n_days_bus_ran"])
    return out.withColumns({
        "bus_has_dictionary_conflict": (F.col("n_dict_devices_for_bus") > 1).cast("int"), "device_has_dictionary_conflict": (F.col("n_dict_buses_for_device") > 1).cast("int"),
        "frac_bus_days_with_data": F.when(F.col("n_days_bus_ran") > 0, F.col("n_days_with_data") / F.col("n_days_bus_ran")),
    })


def training_rows(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs with `label`, for those that a verdict decides: a correct pair, all other candidates of its bus as negatives, and
    wrong pairs. A correct verdict outweighs a wrong one on another pair of the bus only by what it says; unsure says nothing."""
    good = labels.where("verdict = 'correct'").select(*PAIR).distinct()
    bad = labels.where("verdict = 'wrong'").select(*PAIR).distinct()
    sure = pairs.join(good.select("bus_id").distinct(), "bus_id", "left_semi").join(good.withColumn("label", F.lit(True)), PAIR, "left").withColumn("label", F.coalesce("label", F.lit(False)))
    rest = pairs.join(bad, PAIR, "left_semi").join(good.select("bus_id").distinct(), "bus_id", "left_anti").withColumn("label", F.lit(False))
    return sure.unionByName(rest)


def ranked(pairs: DataFrame) -> DataFrame:
    """pairs (with pair_score) and pair_rank in their bus, pair_margin of its best over its runner-up (0 if none), n_candidates_for_bus."""
    w = W.partitionBy("bus_id")
    order = w.orderBy(F.desc("pair_score"), F.col("device_id"))
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    margin = F.max("pair_score").over(w) - F.coalesce(F.nth_value("pair_score", 2).over(whole), F.lit(0.0))
    return pairs.withColumns({"pair_rank": F.row_number().over(order), "pair_margin": margin, "n_candidates_for_bus": F.count(F.lit(1)).over(w)})


def hard_buses(rank: DataFrame, labels: DataFrame, limit: int = 50) -> DataFrame:
    """The labelling queue: best candidates of unlabelled buses with evidence, the least margin first."""
    tops = rank.where((F.col("pair_rank") == 1) & (F.col("pair_score") >= EVIDENCE)).join(labels.select("bus_id").distinct(), "bus_id", "left_anti")
    return tops.orderBy("pair_margin", "bus_id").limit(limit).select(*PAIR, "pair_score", "pair_margin", "n_candidates_for_bus")


def no_evidence(rank: DataFrame) -> DataFrame:
    """Buses whose best candidate has no evidence."""
    return rank.where((F.col("pair_rank") == 1) & (F.col("pair_score") < EVIDENCE)).select(*PAIR, "pair_score", "n_candidates_for_bus")


def audit(labels: DataFrame) -> DataFrame:
    """(band, n, n_correct, precision) over decided audit labels (label_source audit): one row a band of model_confidence that
    has any, and one for all (band "all")."""
    own = labels.where("label_source = 'audit' and verdict in ('correct', 'wrong')").withColumn("hit", F.col("verdict") == "correct")
    band: Column = F.lit(None).cast("string")
    for low, high in BANDS:
        band = F.when((F.col("model_confidence") >= low) & (F.col("model_confidence") < high), f"{low:g}-{high:g}").otherwise(band)
    counts = [F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_correct")]
    per = own.withColumn("band", band).where("band is not null").groupBy("band").agg(*counts).unionByName(own.agg(F.lit("all").alias("band"), *counts))
    return per.withColumn("precision", F.try_divide(F.col("n_correct"), F.col("n")))


def precision_at(rank: DataFrame, labels: DataFrame, threshold: float = SHIP) -> DataFrame:
    """One row: of best candidates at or above threshold how many are judged (n), right (n_correct), and how many buses they cover."""
    tops = rank.where("pair_rank = 1")
    judged = tops.join(labels.where("verdict in ('correct', 'wrong')").select(*PAIR, "verdict"), PAIR).where(F.col("pair_score") >= threshold)
    out = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "correct").alias("n_correct"))
    return out.withColumn("precision", F.try_divide(F.col("n_correct"), F.col("n"))).crossJoin(tops.agg(F.count_if(F.col("pair_score") >= threshold).alias("coverage_buses")))


def stopping_signal(rank: DataFrame, labels: DataFrame, threshold: float = SHIP, target: float = 0.95, least: int = AUDIT_LEAST) -> DataFrame:
    """One row: remaining (buses with evidence, unlabelled, below threshold), n_measured, precision of the audit, and verdict:
    too_early, precision_low, queue_empty, done (nothing remains) or keep_going."""
    open_ = rank.where((F.col("pair_rank") == 1) & (F.col("pair_score") >= EVIDENCE)).join(labels.select("bus_id").distinct(), "bus_id", "left_anti")
    rest = open_.agg(F.count_if(F.col("pair_score") < threshold).alias("remaining"), F.count(F.lit(1)).alias("queue"))
    measured = audit(labels).where("band = 'all'").select(F.col("n").alias("n_measured"), "precision")
    n, p = F.col("n_measured"), F.col("precision")
    verdict = F.when(n < least, "too_early").when(p < target, "precision_low").when(F.col("queue") == 0, "queue_empty").when(F.col("remaining") == 0, "done").otherwise("keep_going")
    return rest.crossJoin(measured).select("remaining", "n_measured", "precision", verdict.alias("verdict"))


def excluded_buses(devices: DataFrame, pinging: DataFrame, running: DataFrame, prefixes: tuple[str, ...] = PREFIXES) -> DataFrame:
    """bus_id of running buses that can't be matched: those of companies of whose devices none pings, and those of a prefix.

    devices: company, device_id, vehicle_number. The bus is the number's digits, padded to five."""
    seen = devices.where("device_id is not null").join(pinging.select("device_id").distinct().withColumn("pings", F.lit(1)), "device_id", "left")
    silent = seen.groupBy("company").agg(F.count("pings").alias("n")).where("n = 0").select("company")
    digits = F.regexp_replace("vehicle_number", "[^0-9]", "")
    named = devices.join(silent, "company", "left_semi").select(F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits).alias("bus_id")).where("bus_id <> '' and bus_id <> '00000'")
    buses = running.select("bus_id").distinct()
    starts = F.lit(False)
    for p in prefixes:
        starts = starts | F.col("bus_id").startswith(p)
    return buses.join(named.distinct(), "bus_id", "left_semi").unionByName(buses.where(starts)).distinct()


def unclaimed(active: DataFrame, claimed: DataFrame, tried: DataFrame, excluded: DataFrame, rank: DataFrame, dictionary: DataFrame) -> DataFrame:
    """active devices (device_id, n_pings, ...) that no bus has, and why: never_blocked (no candidacy), blocked_only_to_excluded_bus
    or lost_competition, then with the best bus that was tried and its score; and the buses that dictionaries name."""
    open_ = active.join(claimed.select("device_id").distinct(), "device_id", "left_anti")
    tries = tried.select(*PAIR).distinct().join(excluded.select("bus_id").distinct().withColumn("out", F.lit(1)), "bus_id", "left").groupBy("device_id").agg(F.count(F.lit(1)).alias("buses"), F.count_if(F.col("out").isNull()).alias("in_scope"))
    best = R.first_per(rank.select("device_id", F.col("bus_id").alias("best_candidate_bus_id"), F.col("pair_score").alias("best_candidate_score")), ["device_id"], F.desc("best_candidate_score"), F.col("best_candidate_bus_id"))
    named = dictionary.groupBy("device_id").agg(F.array_join(F.array_sort(F.collect_set("bus_id")), ",").alias("dictionary_bus_ids"))
    out = open_.join(tries, "device_id", "left").join(best, "device_id", "left").join(named, "device_id", "left")
    reason = F.when(F.col("buses").isNull(), "never_blocked").when(F.col("in_scope") == 0, "blocked_only_to_excluded_bus").otherwise("lost_competition")
    lost = reason == "lost_competition"
    out = out.withColumns({"reason": reason, "in_dictionary": F.col("dictionary_bus_ids").isNotNull()} | {c: F.when(lost, F.col(c)) for c in ("best_candidate_bus_id", "best_candidate_score")})
    return out.drop("buses", "in_scope")


def crosswalk(buses: DataFrame, vehicles: DataFrame, devices: DataFrame) -> DataFrame:
    """Per bus: avl_matched, avl_match_source, avl_vehicle_id, avl_device_id. The device registry goes before the vehicle dictionary;
    of several codes of a bus the smallest counts.

    vehicles: code, vehicle_id (any signs in the code are ignored); devices: code (digits only count), device_id."""
    pad = lambda c: F.when(F.length(c) < 5, F.lpad(c, 5, "0")).otherwise(c)
    norm = F.regexp_replace("code", "[^0-9]", "")
    v = vehicles.where(norm != "").select(pad(norm).alias("bus_id"), F.col("vehicle_id").cast("long").alias("vehicle_id")).groupBy("bus_id").agg(F.min("vehicle_id").alias("v"))
    d = devices.where(F.col("code").rlike("^[0-9]+$") & F.col("device_id").isNotNull()).select(pad(F.col("code")).alias("bus_id"), "device_id").groupBy("bus_id").agg(F.min("device_id").alias("d"))
    out = buses.select("bus_id").distinct().join(d, "bus_id", "left").join(v, "bus_id", "left")
    source = F.when(F.col("d").isNotNull(), "dictionary_device").when(F.col("v").isNotNull(), "dictionary_vehicle")
    return out.select("bus_id", source.isNotNull().alias("avl_matched"), source.alias("avl_match_source"), F.when(F.col("d").isNull(), F.col("v")).alias("avl_vehicle_id"), F.col("d").alias("avl_device_id"))


def folds(df: DataFrame, group: str, n: int = 5, seed: int = 42) -> DataFrame:
    """df with `fold` (0 to n - 1), the same for all rows of a group and near equal in number of groups."""
    order = df.select(group).distinct()
    placed = R.numbered(order.withColumn("_h", F.xxhash64(group, F.lit(seed))), "_place", "_h", group)
    return df.join(placed.select(group, F.pmod(F.col("_place") - 1, F.lit(n)).cast("int").alias("fold")), group)


@dataclass(frozen=True)
class Profile:
    """Limits of device classes: pings, days, metres, share of implausible steps."""

    least_pings: int = 20
    least_days: int = 2
    still_m: float = 200.0
    noise: float = 0.5


def device_profiles(pings: DataFrame, par: Profile = Profile()) -> DataFrame:
    """Per device: active_days, n_pings, radius_m (root mean square distance from the centroid), stationary_share, and class:
    sparse, erratic, stationary or mobile. pings: device, day, at, lon, lat, speed, and an id for ties.

    A step faster than 150 km/h is noise."""
    w = W.partitionBy("device").orderBy("at", "point_id")
    metres = G.haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    dt = F.col("at") - F.lag("at").over(w)
    whole = W.partitionBy("device")
    rows = pings.withColumns({"wild": F.when(dt > 0, (metres / dt * 3.6 > 150).cast("double")), "cx": F.avg("lon").over(whole), "cy": F.avg("lat").over(whole)})
    far = G.haversine(F.col("cx"), F.col("cy"), F.col("lon"), F.col("lat"))
    out = rows.groupBy("device").agg(F.countDistinct("day").alias("active_days"), F.count(F.lit(1)).alias("n_pings"), F.sqrt(F.avg(far * far)).alias("radius_m"), F.avg((F.col("speed") <= 3).cast("double")).alias("stationary_share"), F.avg("wild").alias("wild"))
    kind = F.when((F.col("n_pings") < par.least_pings) | (F.col("active_days") < par.least_days), "sparse").when(F.col("wild") > par.noise, "erratic").when(F.col("radius_m") < par.still_m, "stationary").otherwise("mobile")
    return out.select("device", "active_days", "n_pings", "radius_m", "stationary_share", kind.alias("class"))


def stop_events(pings: DataFrame, lines: DataFrame, stops: DataFrame, arrivals: DataFrame, dwell_m: float = 40.0, on: str = "route") -> DataFrame:
    """One row a trip and stop of its route: status, arrived, departed.

    observed: the vehicle stood within dwell_m of the stop, first and last such ping are the times; passed: no dwell, the time is
    interpolated; extrapolated: just beyond the track; not_reached: outside the part of the line that the track covers;
    unobserved: inside it, but the track doesn't say when. pings: trip_id, route, ep, lon, lat, speed; arrivals: stop_arrivals().
    Trips meet stops by route, a stop is one row of its trip; no time is invented.
    """
    at = G.locate(F.col("line"), F.col("lon"), F.col("lat"))["fraction"]
    reach = pings.join(lines, on).withColumn("s", at).groupBy("trip_id", on).agg(F.min("s").alias("low"), F.max("s").alias("high"))
    placed = stops.join(lines, on).select(on, "stop_id", at.alias("s"), F.col("lon").alias("stop_x"), F.col("lat").alias("stop_y"))
    rows = reach.join(placed, on)
    array = placed.groupBy(on).agg(F.collect_list(F.struct("stop_id", "stop_x", "stop_y")).alias("stops"))
    still = pings.where("speed <= 3").join(array, on)
    close = F.filter("stops", lambda p: G.haversine(p["stop_x"], p["stop_y"], F.col("lon"), F.col("lat")) <= dwell_m)
    dwell = still.withColumn("hit", F.explode(close)).groupBy("trip_id", F.col("hit.stop_id").alias("stop_id")).agg(F.min("ep").alias("a"), F.max("ep").alias("z"))
    rows = rows.join(dwell, ["trip_id", "stop_id"], "left").join(arrivals.select("trip_id", "stop_id", "arrived", "extrapolated"), ["trip_id", "stop_id"], "left")
    status = F.when(F.col("a").isNotNull(), "observed").when(F.col("extrapolated"), "extrapolated").when(F.col("arrived").isNotNull(), "passed").when((F.col("s") < F.col("low")) | (F.col("s") > F.col("high")), "not_reached").otherwise("unobserved")
    return rows.select("trip_id", "stop_id", status.alias("status"), F.coalesce("a", "arrived").alias("arrived"), F.coalesce("z", "arrived").alias("departed"))
