"""Matching vehicles and devices: beliefs, global assignment, smoothing, splits and final classes.

Beliefs, suppression, smoothing, extension, splits and classes are columns, windows and keyed joins. Assignment is sequential
by nature and runs in one task a date, which a fleet bounds.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farelane.functions import scalars as S
from farelane.operators import relational as R


@dataclass(frozen=True)
class Beliefs:
    """Fixed values of the belief model."""

    match_ratio: float = 9.0
    mismatch_ratio: float = 1.3
    prior_weight: float = 0.15
    none_odds: float = 0.3
    score_least: float = 0.02
    score_most: float = 0.98
    temporal_weight: float = 0.5
    temporal_odds: float = 5.0
    dictionary_weight: float = 0.6
    dictionary_one: float = 4.0
    dictionary_both: float = 12.0
    dictionary_conflict: float = 0.5
    dictionary_within: float = 0.2
    suppress_over: float = 0.6
    suppress_by: float = 3.0
    resolved_p: float = 0.85
    resolved_margin: float = 0.3
    resolved_votes: int = 1


KEY = ["bus_id", "date"]
MODEL_WEIGHT = 0.6


def beliefs(candidates: DataFrame, votes: DataFrame, model_weight: float = MODEL_WEIGHT, par: Beliefs = Beliefs()) -> DataFrame:
    """Posterior of each candidate device of a bus and date, and of none of them (device_id null), before suppression.

    candidates: bus_id, date, device_id, score (prior probability; null: even odds) and, where known, is_model_score, temporal,
    dictionary_conflict (boolean) and n_dictionary. votes: bus_id, date, device_id (null: none of these), decision in match,
    none_of_these, unsure; unsure ones carry nothing. The prior's log odds count by model_weight where a model gave
    them, else by prior_weight. Each vote multiplies its option's odds by match_ratio and divides all others' by
    mismatch_ratio. Dictionary support counts for candidates within dictionary_within of the best score only.
    """
    have = set(candidates.columns)
    for name, empty in (("is_model_score", F.lit(False)), ("temporal", F.lit(False)), ("dictionary_conflict", F.lit(False)), ("n_dictionary", F.lit(0))):
        if name not in have:
            candidates = candidates.withColumn(name, empty)
    cast = votes.where("decision <> 'unsure'")
    own = cast.where("decision = 'match'").groupBy(*KEY, "device_id").agg(F.count(F.lit(1)).alias("n_for"))
    total = cast.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_votes"), F.count_if(F.col("decision") == "none_of_these").alias("nones"))
    w = W.partitionBy(*KEY)
    c = candidates.join(own, [*KEY, "device_id"], "left").join(total, KEY, "left").na.fill(0, ["n_for", "n_votes", "nones"])
    weight = F.when(F.col("is_model_score"), model_weight).otherwise(par.prior_weight)
    prior = F.when(F.col("score").isNotNull(), weight * S.logit(S.clip(F.col("score"), par.score_least, par.score_most))).otherwise(0.0)
    odds = F.when(F.col("n_dictionary") >= 2, math.log(par.dictionary_both)).when(F.col("n_dictionary") == 1, math.log(par.dictionary_one)).otherwise(0.0)
    support = par.dictionary_weight * F.when(F.col("dictionary_conflict"), par.dictionary_conflict).otherwise(1.0) * odds
    near_best = F.coalesce("score", F.lit(0.0)) >= F.coalesce(F.max("score").over(w), F.lit(0.0)) - par.dictionary_within

    def voted(n_for: Column) -> Column:
        return n_for * math.log(par.match_ratio) - (F.col("n_votes") - n_for) * math.log(par.mismatch_ratio)

    steady = F.when(F.col("temporal"), par.temporal_weight * math.log(par.temporal_odds)).otherwise(0.0)
    rows = c.select(*KEY, "device_id", (prior + steady + F.when(near_best, support).otherwise(0.0) + voted(F.col("n_for"))).alias("log_odds"), "n_votes", "nones")
    none = rows.groupBy(*KEY).agg(F.max("n_votes").alias("n_votes"), F.max("nones").alias("nones"))
    none = none.select(*KEY, F.lit(None).cast("string").alias("device_id"), (F.lit(par.prior_weight * math.log(par.none_odds)) + voted(F.col("nones"))).alias("log_odds"), "n_votes", "nones")
    out = rows.unionByName(none)
    return out.withColumn("p", R.softmax(F.col("log_odds"), w)).select(*KEY, "device_id", "log_odds", "p", "n_votes")


def with_temporal(candidates: DataFrame, confirmed: DataFrame) -> DataFrame:
    """candidates with `temporal`: the pair is confirmed (bus_id, device_id, date) on another date."""
    known = confirmed.select("bus_id", "device_id", "date").distinct()
    days = known.groupBy("bus_id", "device_id").agg(F.count(F.lit(1)).alias("_days"))
    rows = candidates.drop("temporal").join(days, ["bus_id", "device_id"], "left").join(known.withColumn("_here", F.lit(1)), ["bus_id", "device_id", "date"], "left")
    return rows.withColumn("temporal", F.coalesce("_days", F.lit(0)) - F.coalesce("_here", F.lit(0)) > 0).drop("_days", "_here")


def two_pass(candidates: DataFrame, votes: DataFrame, model_weight: float = MODEL_WEIGHT, par: Beliefs = Beliefs()) -> DataFrame:
    """Suppressed beliefs in which pairs confirmed on other dates have support. What is confirmed comes from a first pass without any."""
    first = summary(suppress(beliefs(candidates.drop("temporal"), votes, model_weight, par), par), par)
    sure = first.where("resolved and decision = 'match'").select("bus_id", F.col("top_device").alias("device_id"), "date")
    return suppress(beliefs(with_temporal(candidates, sure), votes, model_weight, par), par)


def suppress(belief: DataFrame, par: Beliefs = Beliefs()) -> DataFrame:
    """Lower a device's log odds where it is believed on another bus of the date, then normalise again."""
    w = W.partitionBy("date", "device_id").orderBy(F.desc("p"), "bus_id")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    known = belief.where("device_id is not null")
    elsewhere = F.when(F.row_number().over(w) == 1, F.nth_value("p", 2).over(whole)).otherwise(F.first("p").over(whole))
    known = known.withColumn("elsewhere", elsewhere)
    out = known.unionByName(belief.where("device_id is null").withColumn("elsewhere", F.lit(None).cast("double")))
    out = out.withColumn("log_odds", F.col("log_odds") - F.when(F.col("elsewhere") > par.suppress_over, par.suppress_by * F.col("elsewhere")).otherwise(0.0))
    return out.withColumn("p", R.softmax(F.col("log_odds"), W.partitionBy("bus_id", "date")))


def summary(belief: DataFrame, par: Beliefs = Beliefs()) -> DataFrame:
    """Per bus and date: top_device, top_p, margin over the runner-up, n_votes, confident (by p and margin), resolved (confident
    and voted on), decision (match or none_of_these)."""
    w = W.partitionBy(*KEY).orderBy(F.desc("p"), F.col("device_id").asc_nulls_last())
    top = belief.withColumns({"rn": F.row_number().over(w), "second": F.lead("p").over(w)}).where("rn = 1")
    top = top.withColumn("margin", F.col("p") - F.coalesce("second", F.lit(0.0)))
    top = top.withColumn("confident", (F.col("p") >= par.resolved_p) & (F.col("margin") >= par.resolved_margin))
    decision = F.when(F.col("device_id").isNull(), "none_of_these").otherwise("match")
    return top.select(*KEY, F.col("device_id").alias("top_device"), F.col("p").alias("top_p"), "margin", "n_votes", "confident", (F.col("confident") & (F.col("n_votes") >= par.resolved_votes)).alias("resolved"), decision.alias("decision"))


def model_weight(ece: float | None, n_resolved: int) -> float:
    """Weight of the model's prior: none under 15 resolved cases, then from 0 at an error of 0.3 to 0.6 at 0.05."""
    if n_resolved < 15 or ece is None or math.isnan(ece):
        return 0.0
    return MODEL_WEIGHT * min(1.0, max(0.0, (0.3 - ece) / 0.25))


def model_weight_of(ece: Column, n_resolved: Column) -> Column:
    """model_weight() of columns."""
    quality = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (0.3 - ece) / 0.25))
    return F.when((n_resolved < 15) | ece.isNull() | F.isnan(ece), 0.0).otherwise(MODEL_WEIGHT * quality)


# ---- assignment ----------------------------------------------------------------------------------------------------
Edges = list[list[tuple[int, float]]]


def solve(edges: Edges, n_columns: int) -> tuple[list[int], list[float], list[float]]:
    """Column of each row in a matching of least total cost, and dual values of rows and columns.

    edges lists (column, cost >= 0) for each row. Shortest augmenting paths with a heap over the edges there are, after a
    greedy start on the cheapest edge of each row.
    """
    n = len(edges)
    u, v = [min((c for _, c in e), default=0.0) for e in edges], [0.0] * n_columns
    row_of, col_of = [-1] * n_columns, [-1] * n
    for i, e in enumerate(edges):
        for j, c in e:
            if c == u[i] and row_of[j] < 0:
                row_of[j], col_of[i] = i, j
                break
    for start in range(n):
        if col_of[start] >= 0:
            continue
        dist: dict[int, float] = {}
        back: dict[int, int] = {}
        done: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        i, low, end = start, 0.0, -1
        while end < 0:
            base = low - u[i]
            for j, c in edges[i]:
                if j not in done and (d := base + c - v[j]) < dist.get(j, math.inf):
                    dist[j], back[j] = d, i
                    heapq.heappush(heap, (d, j))
            while heap and (heap[0][1] in done or heap[0][0] > dist[heap[0][1]]):
                heapq.heappop(heap)
            if not heap:
                raise ValueError("no full matching")
            low, j = heapq.heappop(heap)
            done[j] = low
            if row_of[j] < 0:
                end = j
            else:
                i = row_of[j]
        u[start] += low
        for j, d in done.items():
            if row_of[j] >= 0:
                u[row_of[j]] += low - d
            v[j] -= low - d
        j = end
        while j >= 0:
            i = back[j]
            row_of[j] = i
            col_of[i], j = j, col_of[i]
    return col_of, u, v


def margins(edges: Edges, col_of: list[int], u: list[float], v: list[float]) -> list[float]:
    """For each row, how much the total grows when its own edge is forbidden; infinite if no matching is left.

    One shortest path each over reduced costs, from the row round to its own column, or to a free column and on from there
    (what that costs is one search for all rows). The search ends where it can't beat what is found: with a cheap
    stand-in that is after a few steps.
    """
    row_of = {j: i for i, j in enumerate(col_of)}
    # what it costs to give up a column once a free one has been taken: leave it free, or hand it on
    spare = [-x for x in v]
    heap = [(spare[j], j) for j in col_of]
    heapq.heapify(heap)
    while heap:
        d, j = heapq.heappop(heap)
        if d > spare[j]:
            continue
        i = row_of[j]
        for k, c in edges[i]:
            if k in row_of and (more := max(d + c - u[i] - v[k], d)) < spare[k]:
                spare[k] = more
                heapq.heappush(heap, (more, k))
    out = []
    for row, own in enumerate(col_of):
        best, dist, done = math.inf, {}, set()
        heap = []
        i, low = row, 0.0
        while True:
            base = low - u[i]
            for j, c in edges[i]:
                if i == row and j == own or j in done:
                    continue
                d = max(base + c - v[j], low)
                if j == own:
                    best = min(best, d)
                elif j not in row_of:
                    best = min(best, d + spare[own])
                elif d < dist.get(j, best):
                    dist[j] = d
                    heapq.heappush(heap, (d, j))
            while heap and (heap[0][1] in done or heap[0][0] > dist[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= best:
                break
            low, j = heapq.heappop(heap)
            done.add(j)
            i = row_of[j]
        out.append(best)
    return out


P_LEAST, P_MOST = 1e-9, 1 - 1e-9


def assign_date(belief: pd.DataFrame) -> pd.DataFrame:
    """One date's beliefs (bus_id, device_id or null for none, p): the choice of least total -log p, at most one device a
    bus and one bus a device. "None" costs what the bus itself believes of it. Every bus comes back, with its cost and margin."""
    belief = belief.assign(cost=-np.log(belief.p.clip(P_LEAST, P_MOST)))
    buses = sorted(belief.bus_id.unique())
    known = belief[belief.device_id.notna()].groupby(["bus_id", "device_id"], as_index=False)["cost"].min()
    devices = sorted(known.device_id.unique())
    at, place = {x: i for i, x in enumerate(buses)}, {x: i for i, x in enumerate(devices)}
    none = belief[belief.device_id.isna()].groupby("bus_id")["cost"].min()
    edges: Edges = [[(len(devices) + i, float(none.get(x, -math.log(P_LEAST))))] for i, x in enumerate(buses)]
    for bus, device, cost in known.itertuples(index=False):
        edges[at[bus]].append((place[device], float(cost)))
    col, u, v = solve(edges, len(devices) + len(buses))
    spare = margins(edges, col, u, v)
    rows = [(belief.date.iloc[0], x, devices[col[i]] if col[i] < len(devices) else None, dict(edges[i])[col[i]], spare[i]) for i, x in enumerate(buses)]
    return pd.DataFrame(rows, columns=["date", "bus_id", "device_id", "cost", "margin"])


def assign(belief: DataFrame) -> DataFrame:
    """Per bus and date of beliefs(): device_id (null: none), cost, margin. A date, that is one fleet, is one task."""
    return belief.select("date", "bus_id", "device_id", "p").groupBy("date").applyInPandas(assign_date, "date date, bus_id string, device_id string, cost double, margin double")


# ---- smoothing and splits --------------------------------------------------------------------------------------------
def _runs(days: DataFrame) -> DataFrame:
    """Runs of one bus on consecutive days of a device: device_id, run, bus_id, from_date, to_date, n_days, n_corrected."""
    w = W.partitionBy("device_id").orderBy("date")
    new = F.coalesce((F.lag("bus_id").over(w) != F.col("bus_id")) | (F.datediff("date", F.lag("date").over(w)) != 1), F.lit(True))
    rows = days.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("device_id", "run", "bus_id").agg(F.min("date").alias("from_date"), F.max("date").alias("to_date"), F.count(F.lit(1)).alias("n_days"), F.sum("corrected").alias("n_corrected"))


def smooth_devices(assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(intervals, corrections) of assigned days (bus_id, date, device_id; a device has one bus a day).

    A run of a single day between two runs of one other bus goes to that bus, unless another device has it on that day; runs
    are judged as assigned, not as corrected. Then runs of one bus that follow each other are one interval, unless another
    device has the bus on a day between them. intervals: device_id, bus_id, from_date, to_date, n_days, n_corrected.
    corrections: device_id, date, from_bus, to_bus.
    """
    days = assigned.where("device_id is not null").select("device_id", "date", "bus_id").distinct()
    owners = days.select(F.col("bus_id").alias("own_bus"), F.col("date").alias("own_date"), F.col("device_id").alias("owner"))
    w = W.partitionBy("device_id").orderBy("run")
    runs = _runs(days.withColumn("corrected", F.lit(0))).withColumns({"before": F.lag("bus_id").over(w), "after": F.lead("bus_id").over(w)})
    odd = runs.where("n_days = 1 and before = after and before <> bus_id").select("device_id", F.col("from_date").alias("date"), F.col("bus_id").alias("from_bus"), F.col("before").alias("to_bus"))
    held = (F.col("to_bus") == F.col("own_bus")) & (F.col("date") == F.col("own_date")) & (F.col("owner") != F.col("device_id"))
    corrections = odd.join(owners, held, "left_anti")
    fixed = days.join(corrections.select("device_id", "date", "to_bus"), ["device_id", "date"], "left")
    fixed = fixed.select("device_id", "date", F.coalesce("to_bus", "bus_id").alias("bus_id"), F.col("to_bus").isNotNull().cast("int").alias("corrected"))
    runs = _runs(fixed).withColumns({"before": F.lag("bus_id").over(w), "last": F.lag("to_date").over(w)})
    gaps = runs.where("before = bus_id").select("device_id", "run", "bus_id", "last", "from_date")
    between = (F.col("bus_id") == F.col("own_bus")) & (F.col("own_date") > F.col("last")) & (F.col("own_date") < F.col("from_date")) & (F.col("owner") != F.col("device_id"))
    joined = gaps.join(owners, between, "left_anti").select("device_id", "run", F.lit(0).alias("cut"))
    runs = runs.join(joined, ["device_id", "run"], "left").withColumn("cut", F.coalesce("cut", F.lit(1)))
    runs = runs.withColumn("part", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy("device_id", "bus_id", "part").agg(F.min("from_date").alias("from_date"), F.max("to_date").alias("to_date"), F.sum("n_days").alias("n_days"), F.sum("n_corrected").alias("n_corrected"))
    return out.drop("part"), corrections


def corrected_owners(assigned: DataFrame, corrections: DataFrame) -> DataFrame:
    """(device_id, date, bus_id) of assigned days with the corrections applied."""
    days = assigned.where("device_id is not null").select("device_id", "date", "bus_id").distinct()
    moved = corrections.select("device_id", "date", "to_bus")
    return days.join(moved, ["device_id", "date"], "full").select("device_id", "date", F.coalesce("to_bus", "bus_id").alias("bus_id"))


def extend_single(intervals: DataFrame, running: DataFrame, owners: DataFrame) -> DataFrame:
    """intervals with n_extended: a bus of one device in all its intervals has it on all its running days (bus_id, date) on which
    the device isn't on another bus (owners: device_id, date, bus_id).

    Running days join into one interval unless the device is elsewhere on a calendar day from one to the next. Buses of
    several devices, or without running days, stay as they are.
    """
    per = intervals.groupBy("bus_id").agg(F.countDistinct("device_id").alias("n"), F.min("device_id").alias("device_id")).where("n = 1").drop("n")
    days = running.select("bus_id", "date").distinct().join(per, "bus_id")
    spans = intervals.select(F.col("bus_id").alias("in_bus"), "from_date", "to_date")
    covered = days.join(spans, (F.col("bus_id") == F.col("in_bus")) & F.col("date").between(F.col("from_date"), F.col("to_date")), "left_semi").select("bus_id", "date", F.lit(1).alias("covered"))
    other = owners.select(F.col("device_id").alias("of"), F.col("date").alias("on"), F.col("bus_id").alias("else_bus"))
    away = days.join(other, (F.col("device_id") == F.col("of")) & (F.col("date") == F.col("on")) & (F.col("else_bus") != F.col("bus_id")), "left_semi").select("bus_id", "date", F.lit(1).alias("away"))
    days = days.join(covered, ["bus_id", "date"], "left").join(away, ["bus_id", "date"], "left").where("covered is not null or away is null")
    w = W.partitionBy("bus_id").orderBy("date")
    days = days.withColumn("last", F.lag("date").over(w))
    clash = (F.col("device_id") == F.col("of")) & F.col("on").between(F.col("last"), F.col("date")) & (F.col("else_bus") != F.col("bus_id"))
    joined = days.where("last is not null").join(other, clash, "left_anti").select("bus_id", "date", F.lit(0).alias("cut"))
    days = days.join(joined, ["bus_id", "date"], "left").withColumn("part", F.sum(F.coalesce("cut", F.lit(1))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = days.groupBy("bus_id", "device_id", "part").agg(F.min("date").alias("a"), F.max("date").alias("z"), F.count_if(F.col("covered").isNull()).alias("n_extended"))
    inside = intervals.select(F.col("bus_id").alias("in_bus"), "from_date", "to_date", "n_days", "n_corrected")
    runs = runs.join(inside, (F.col("bus_id") == F.col("in_bus")) & (F.col("from_date") >= F.col("a")) & (F.col("to_date") <= F.col("z")), "left")
    runs = runs.groupBy("device_id", "bus_id", F.col("a").alias("from_date"), F.col("z").alias("to_date"), "n_extended").agg(F.coalesce(F.sum("n_days"), F.lit(0)).alias("n_days"), F.coalesce(F.sum("n_corrected"), F.lit(0)).alias("n_corrected"))
    rest = intervals.join(days.select("bus_id").distinct(), "bus_id", "left_anti").withColumn("n_extended", F.lit(0).cast("long"))
    lost = per.join(running.select("bus_id").distinct(), "bus_id", "left_semi").select("bus_id")  # of one device but free on no day
    rest = rest.join(lost, "bus_id", "left_anti")
    return runs.unionByName(rest.select(*runs.columns))


def splits(scores: DataFrame, least: float = 0.9, days: int = 2) -> DataFrame:
    """Buses that change device once. scores: bus_id, date, device_id, day_score. Days below `least` don't count; each day the
    best device wins; exactly two devices, one switch, `days` days each."""
    w = W.partitionBy("bus_id").orderBy("date")
    win = R.first_per(scores.where(F.col("day_score") >= least), ["bus_id", "date"], F.desc("day_score"), F.col("device_id"))
    seq = win.withColumn("switch", F.when(F.lag("device_id").over(w) != F.col("device_id"), 1).otherwise(0))
    ok = seq.groupBy("bus_id").agg(F.countDistinct("device_id").alias("n"), F.sum("switch").alias("s")).where("n = 2 and s = 1").select("bus_id")
    part = seq.join(ok, "bus_id").groupBy("bus_id", "device_id").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("n_days"))
    good = part.groupBy("bus_id").agg(F.min("n_days").alias("least")).where(F.col("least") >= days).select("bus_id")
    return part.join(good, "bus_id")


def final_class(excluded: Column, n_candidates: Column, hand: Column, unsure: Column, split: Column, single: Column, best: Column) -> Column:
    """The method that decides a bus, by priority; best is the model's highest score."""
    return (
        F.when(excluded, "excluded").when(n_candidates == 0, "no_candidates").when(hand.isNotNull(), F.concat(F.lit("hand_"), hand)).when(unsure & split, "unsure_split").when(unsure & single, "unsure_single")
        .when(unsure, "unsure_review").when(best.isNull() | (best < 0.01), "no_evidence").when(best >= 0.9, "model").otherwise("model_below")
    )


# ---- model scores ----------------------------------------------------------------------------------------------------
def calibration_metrics(scored: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """One row: n, auc (ties count half), brier, log_loss, ece over equal bins."""
    q = S.clip(F.col(p), 1e-9, 1 - 1e-9)
    y = F.col(label).cast("double")
    low = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    by_bin = scored.groupBy(low.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.sum(y) - F.sum(p)).alias("gap"))
    ece = by_bin.agg((F.sum("gap") / F.sum("n")).alias("ece"))
    per = scored.groupBy(F.col(p).alias("p")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    # distinct scores are cumulated in coarse blocks first, so no task sorts them all
    block = F.floor(F.col("p") * 1000)
    per = per.withColumn("block", block)
    before = per.groupBy("block").agg(F.sum("neg").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    below = F.coalesce("before", F.lit(0.0)) + F.coalesce(F.sum("neg").over(W.partitionBy("block").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    auc = per.join(before.select("block", "before"), "block").withColumn("below", below).agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))
    whole = scored.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"))
    return whole.crossJoin(auc).crossJoin(ece)
