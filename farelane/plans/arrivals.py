"""Stop arrival times from vehicle positions: speed segmentation, progress along the shape, crossings, gates, confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farelane.functions import geo as G
from farelane.functions import scalars as S
from farelane.plans.catalog import query
from farelane.plans.expressions import _HAVERSINE, _LOCATE, route_lines

DEGREE = 111_320.0  # metres


@dataclass(frozen=True)
class Limits:
    speed_kmh: float = 100.0
    offset_m: float = 100.0
    boundary_m: float = 100.0
    boundary_s: float = 60.0
    weight: float = 10.0


#: The bridge's vehicles report hours apart, so its limits are wider than a real feed's.
BRIDGE = Limits(speed_kmh=5.0, offset_m=3000.0, boundary_m=3000.0, boundary_s=86400.0)


def speed_runs(pings: DataFrame, limit_kmh: float) -> DataFrame:
    """Adds run: it grows where the step from the ping before is faster than the limit; runs of one ping go.

    A first ping, or one at the time of the ping before, starts no run. Pings at one time share their run (range frame).
    """
    w = W.partitionBy("trip_id").orderBy("ep", "event_id")
    dt = F.col("ep") - F.lag("ep").over(w)
    metres = G.haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    fast = F.when((dt > 0) & (metres / dt * 3.6 > limit_kmh), 1).otherwise(0)
    runs = pings.withColumn("_fast", fast).withColumn("run", F.sum("_fast").over(W.partitionBy("trip_id").orderBy("ep"))).drop("_fast")
    return runs.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("trip_id", "run"))).where("_n >= 2").drop("_n")


def progress(pings: DataFrame, lines: DataFrame, on: str = "route") -> DataFrame:
    """Adds fraction, offset_m and progress (running maximum of fraction along a trip). lines: (route, line); pings join their own."""
    at = pings.join(lines, on).withColumn("_at", G.locate(F.col("line"), F.col("lon"), F.col("lat")))
    out = at.withColumns({"fraction": F.col("_at.fraction"), "offset_m": F.sqrt(F.col("_at.d2")) * DEGREE}).drop("_at", "line")
    return out.withColumn("progress", F.max("fraction").over(W.partitionBy("trip_id").orderBy("ep")))


def route_arrays(lines: DataFrame, stops: DataFrame, on: str = "route") -> DataFrame:
    """(route, stops, metres): a route's stops with their fraction of its line, as one array, and the line's length."""
    at = G.locate(F.col("line"), F.col("lon"), F.col("lat"))["fraction"]
    placed = stops.join(lines, on).groupBy(on).agg(F.collect_list(F.struct("stop_id", at.alias("s"))).alias("stops"))
    return placed.join(lines.select(on, (G.line_length(F.col("line")) * DEGREE).alias("metres")), on)


def crossings(pings: DataFrame, lines: DataFrame, stops: DataFrame, limits: Limits, on: str = "route") -> DataFrame:
    """Pairs of neighbouring pings with each stop that is reached between them, or (extrapolated) after the last.

    A stop is crossed at the first ping whose progress reaches it and that has a ping before; past the last ping it is
    extrapolated from the last two. The stops of a route are few: each ping filters its route's as an array, so pings never
    meet stops in a range join, and everything after the join by route stays within a trip.
    """
    seen = progress(speed_runs(pings.where("not (lat = 0 and lon = 0)"), limits.speed_kmh), lines, on)
    w = W.partitionBy("trip_id").orderBy("ep", "event_id")
    before = {f"{c}1": F.lag(c).over(w) for c in ("ep", "fraction", "offset_m", "progress")}
    pair = seen.withColumns(before | {"_last": F.row_number().over(W.partitionBy("trip_id").orderBy(F.desc("ep"), F.desc("event_id"))), "_top": F.max("fraction").over(W.partitionBy("trip_id"))})
    pair = pair.where("ep1 is not null").join(route_arrays(lines, stops, on), on)
    inner = F.filter("stops", lambda s: (s["s"] > F.col("progress1")) & (s["s"] <= F.col("progress")))
    past = F.when(F.col("_last") == 1, F.filter("stops", lambda s: s["s"] > F.col("_top"))).otherwise(F.filter("stops", lambda s: F.lit(False)))
    hits = F.concat(F.transform(inner, lambda s: F.struct(s["stop_id"].alias("stop_id"), s["s"].alias("s"), F.lit(False).alias("extrapolated"))), F.transform(past, lambda s: F.struct(s["stop_id"].alias("stop_id"), s["s"].alias("s"), F.lit(True).alias("extrapolated"))))
    out = pair.withColumn("hit", F.explode(hits)).drop("stops").select("*", "hit.stop_id", "hit.s", "hit.extrapolated").drop("hit")
    return out.withColumn("w", F.try_divide(F.col("s") - F.col("fraction1"), F.col("fraction") - F.col("fraction1")))


def stop_arrivals(pings: DataFrame, lines: DataFrame, stops: DataFrame, limits: Limits = Limits(), on: str = "route") -> DataFrame:
    """(trip_id, stop_id, arrived, extrapolated, gap_s, confidence), one row a trip and stop at most.

    pings: trip_id, event_id, ep, lon, lat and their route; lines: route, line; stops: route, stop_id, lon, lat.
    """
    both = crossings(pings, lines, stops, limits, on).where(F.abs("w") <= limits.weight)
    both = both.withColumn("arrived", F.col("ep1") + (F.col("ep") - F.col("ep1")) * F.col("w"))
    inside = (F.col("fraction1") < F.col("s")) & (F.col("s") <= F.col("fraction"))
    early = F.col("s") < F.col("fraction1")
    ref_f, ref_t = F.when(early, F.col("fraction1")).otherwise(F.col("fraction")), F.when(early, F.col("ep1")).otherwise(F.col("ep"))
    edge = (F.abs(F.col("s") - ref_f) * F.col("metres") <= limits.boundary_m) & (F.abs(F.col("arrived") - ref_t) <= limits.boundary_s)
    both = both.where((F.col("offset_m") <= limits.offset_m) & (F.col("offset_m1") <= limits.offset_m) & (inside | edge))
    gap = F.col("ep") - F.col("ep1")
    return both.select("trip_id", "stop_id", "arrived", "extrapolated", gap.alias("gap_s"), S.confidence(gap).alias("confidence"))


_RUNS = f"""steps AS (SELECT *, ep - lag(ep) OVER w AS dt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM pings WHERE NOT (lat = 0 AND lon = 0) WINDOW w AS (PARTITION BY trip_id ORDER BY ep, event_id)),
runs AS (SELECT *, sum(CASE WHEN dt > 0 AND {_HAVERSINE.format(a='plat', b='lat', c='plon', d='lon')} / dt * 3.6e0 > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id ORDER BY ep) AS run FROM steps),
kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY trip_id, run) AS n FROM runs) q WHERE n >= 2) """


@query("g15_speed_runs", f"WITH {_RUNS} SELECT event_id, CAST(run AS BIGINT) AS run FROM kept")
def _(spark: SparkSession) -> DataFrame:
    return speed_runs(spark.table("pings").where("not (lat = 0 and lon = 0)"), BRIDGE.speed_kmh).select("event_id", "run")


_FRACTIONS = _LOCATE.strip() + f""", at_stop AS (SELECT route, stop_id, fraction AS s FROM (SELECT route, stop_id, (before + t * len) / total AS fraction, row_number() OVER (PARTITION BY route, stop_id ORDER BY (lon - ax - t * dx) * (lon - ax - t * dx) + (lat - ay - t * dy) * (lat - ay - t * dy), k) AS rn FROM (SELECT stop_id, st.lon, st.lat, s.*, least(greatest(((st.lon - ax) * dx + (st.lat - ay) * dy) / (dx * dx + dy * dy), 0), 1) AS t FROM route_stops st JOIN s ON s.route = st.route) x) y WHERE rn = 1),
{_RUNS}, seen AS (SELECT k.*, b.fraction, sqrt(b.d2) * 111320e0 AS off, max(b.fraction) OVER (PARTITION BY k.trip_id ORDER BY k.ep) AS progress FROM kept k JOIN best b ON b.event_id = k.event_id AND b.rn = 1),
pair AS (SELECT trip_id, route, ep, fraction, off, progress, lag(ep) OVER w AS ep1, lag(fraction) OVER w AS fraction1, lag(off) OVER w AS off1, lag(progress) OVER w AS progress1, row_number() OVER (PARTITION BY trip_id ORDER BY ep DESC, event_id DESC) AS last, max(fraction) OVER (PARTITION BY trip_id) AS top FROM seen WINDOW w AS (PARTITION BY trip_id ORDER BY ep, event_id)),
hits AS (SELECT p.*, a.stop_id, a.s, FALSE AS extrapolated FROM pair p JOIN at_stop a ON a.route = p.route AND a.s > p.progress1 AND a.s <= p.progress WHERE ep1 IS NOT NULL UNION ALL SELECT p.*, a.stop_id, a.s, TRUE FROM pair p JOIN at_stop a ON a.route = p.route AND a.s > p.top WHERE ep1 IS NOT NULL AND last = 1),
timed AS (SELECT *, (s - fraction1) / nullif(fraction - fraction1, 0) AS w, ep1 + (ep - ep1) * ((s - fraction1) / nullif(fraction - fraction1, 0)) AS arrived FROM hits),
metres AS (SELECT route AS of, sum(len) * 111320e0 AS m FROM s GROUP BY route)"""
_ARRIVALS = _FRACTIONS + """ SELECT trip_id, stop_id, round(arrived, 3) AS arrived, extrapolated, CASE WHEN ep - ep1 <= 60 THEN 'high' WHEN ep - ep1 <= 180 THEN 'medium' ELSE 'low' END AS confidence FROM timed JOIN metres ON of = route WHERE abs(w) <= 10 AND off <= 3000 AND off1 <= 3000
AND ((fraction1 < s AND s <= fraction) OR (abs(s - CASE WHEN s < fraction1 THEN fraction1 ELSE fraction END) * m <= 3000 AND abs(arrived - CASE WHEN s < fraction1 THEN ep1 ELSE ep END) <= 86400))"""


def _inputs(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.table("pings"), route_lines(spark), spark.table("route_stops")


@query("d10_stop_arrivals", _ARRIVALS)
def flagship(spark: SparkSession) -> DataFrame:
    out = stop_arrivals(*_inputs(spark), BRIDGE)
    return out.select("trip_id", "stop_id", F.round("arrived", 3).alias("arrived"), "extrapolated", "confidence")


@query("g16_first_crossing", _FRACTIONS + " SELECT trip_id, stop_id, ep AS crossed_at, ep1 AS before_at FROM hits WHERE NOT extrapolated")
def _(spark: SparkSession) -> DataFrame:
    return crossings(*_inputs(spark), BRIDGE).where("not extrapolated").select("trip_id", "stop_id", F.col("ep").alias("crossed_at"), F.col("ep1").alias("before_at"))


@query("g17_past_the_last_ping", _FRACTIONS + " SELECT trip_id, stop_id, ep AS last_at FROM hits WHERE extrapolated")
def _(spark: SparkSession) -> DataFrame:
    return crossings(*_inputs(spark), BRIDGE).where("extrapolated").select("trip_id", "stop_id", F.col("ep").alias("last_at"))


@query("g18_safe_weights", _FRACTIONS + " SELECT trip_id, stop_id, round(w, 7) AS w FROM timed WHERE NOT extrapolated AND abs(w) <= 10")
def _(spark: SparkSession) -> DataFrame:
    return crossings(*_inputs(spark), BRIDGE).where("not extrapolated and abs(w) <= 10").select("trip_id", "stop_id", F.round("w", 7).alias("w"))


@query("g19_gated_arrivals", _ARRIVALS.replace("SELECT trip_id, stop_id, round(arrived", "SELECT trip_id, count(*) AS n FROM (SELECT trip_id, stop_id, round(arrived") + ") z GROUP BY trip_id")
def _(spark: SparkSession) -> DataFrame:
    return stop_arrivals(*_inputs(spark), BRIDGE).groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))
