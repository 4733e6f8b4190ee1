"""Mixing sources to target weights by pivotal dependent rounding of fractional copy counts.

Every document of a source wants target/source_size copies: a whole number and a fraction p. Equal rows are one unit and
are dealt by number: of r equal rows floor(r * p) get one copy more and one row at most stays open, with the rest of the
mass. The open fractions are rounded by the pivotal method on word mass: two documents at a time, one takes words from the
other until one of the two fractions is 0 or 1, with chances that keep each document's expectation. The source's mass
stays what it was, up to the one document that is left at the end. Documents are dealt into groups of about GROUP; each
group hands its one unfinished document on, and these meet in groups again: a reduction tree.

A document that is larger than pairs with all the others could ever settle (its square is above the sum of their
squares) is paired first with all smaller ones of its group as one unit, which share what they give or get evenly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelane.llm import textbytes as tb
from farelane.llm.common import WORD, drop_table, materialize, unused

GROUP, CYCLE, SHARE, MOST = 4000, (5.0, 2.0, 1.0), 1.5, 2.0
_UNIT = "doc_id long, source string, mark long, size long, repeats long, whole int, extra long, open double"


def targets(sizes: dict[str | None, int], cycle: tuple[float, ...] = CYCLE, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words wanted of each source: `share` of all words by weight, none above `most` times its own size."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _uniform(*parts: int) -> float:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for x in parts:
            h = tb.mix(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(x & 0xFFFFFFFFFFFFFFFF))
    return (float(int(h) >> 11) + 0.5) / 2.0**53


def _giants(p: list[float], room: list[int], extra: list[int], draws: np.ndarray) -> int:
    """Settle the leading units that dwarf all after them, each against those as one unit; how many are settled.

    All fractions are equal, before and after, so every unit keeps its expectation.
    """
    rest, squares, q = float(sum(room)), float(sum(x * x for x in room)), p[0]
    for i in range(len(p)):
        rest, squares = rest - room[i], squares - float(room[i]) ** 2
        if rest <= 0 or float(room[i]) ** 2 <= squares:
            break
        mine, theirs = q * room[i], q * rest
        gain, give = min(room[i] - mine, theirs), min(mine, rest - theirs)
        up = draws[i] * (gain + give) < give
        moved = gain if up else -give
        if up and gain < room[i] - mine or not up and give < mine:  # the others are all empty or full now
            p[i] = (mine + moved) / room[i]
            for j in range(i + 1, len(p)):
                extra[j] += int(not up)
                p[j] = 0.0
            return i
        extra[i] += int(up)
        p[i], q = 0.0, (theirs - moved) / rest
        if not 1e-12 < q < 1 - 1e-12:
            for j in range(i + 1, len(p)):
                extra[j] += int(q > 0.5)
                p[j] = 0.0
            return i + 1
    else:
        return len(p)
    for j in range(i, len(p)):
        p[j] = q
    return i


def _pairs(p: list[float], room: list[int], extra: list[int], draws: np.ndarray, begin: int) -> int | None:
    """Each open unit in turn against the one that is still open; the one that is left, whose fraction stays in p."""
    held = None
    for i in range(begin, len(p)):
        if not 0 < p[i] < 1:
            continue
        if held is None:
            held = i
            continue
        j, mine, theirs = held, p[i] * room[i], p[held] * room[held]
        gain, give = min(room[i] - mine, theirs), min(mine, room[j] - theirs)
        if draws[i] * (gain + give) < give:  # i gains: it is full, or j is empty
            i_done, j_done = room[i] - mine <= theirs, theirs <= room[i] - mine
            p[i], p[j] = (1.0 if i_done else (mine + gain) / room[i]), (0.0 if j_done else (theirs - gain) / room[j])
        else:
            i_done, j_done = mine <= room[j] - theirs, room[j] - theirs <= mine
            p[i], p[j] = (0.0 if i_done else (mine - give) / room[i]), (1.0 if j_done else (theirs + give) / room[j])
        for k, done in ((i, i_done), (j, j_done)):
            if done:
                extra[k] += int(p[k] >= 0.5)
                p[k] = 0.0
        held = None if i_done and j_done else j if i_done else i
    return held


def pivot(units: pd.DataFrame, last: bool) -> pd.DataFrame:
    """Round one group's open fractions: at most one unit stays open, and none if this is the last level."""
    units = units.sort_values(["size", "doc_id", "mark"], ascending=[False, True, True], ignore_index=True)
    mark, room, extra, p = units["mark"].tolist(), units["size"].tolist(), units["extra"].tolist(), units["open"].tolist()
    draws = (tb.mix(units["mark"].to_numpy(np.int64).view(np.uint64) ^ np.uint64(0xA4093822299F31D0)) >> np.uint64(11)).astype(float) / 2.0**53
    for i in range(len(p)):
        if room[i] == 0 and p[i] > 0:  # no words to give or take
            extra[i] += int(_uniform(mark[i], 2) < p[i])
            p[i] = 0.0
    some = [i for i in range(len(p)) if p[i] > 0]
    begin = 0
    if len({p[i] for i in some}) == 1 and some == list(range(len(some))):
        head = len(some)
        mine, rooms, more = p[:head], room[:head], extra[:head]
        begin = _giants(mine, rooms, more, draws)
        p[:head], extra[:head] = mine, more
    held = _pairs(p, room, extra, draws, begin)
    if last and held is not None:
        extra[held] += int(_uniform(mark[held], 3) < p[held])
        p[held] = 0.0
    units["open"], units["extra"] = p, extra
    return units[[x.split()[0] for x in _UNIT.split(", ")]]


def _round(last: bool):
    return lambda group: pivot(group, last)


def mix_copies(docs: DataFrame, cycle: tuple[float, ...] = CYCLE, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per distinct row of docs (doc_id, text, source): doc_id, source, mark, size, repeats, whole, extra, source_size, target.

    size is the number of words of the whole text (null: 0), mark the row's hash, repeats how many equal rows there are;
    each of them is taken `whole` times and `extra` of them once more. Null sources are one source, the last; null ids are
    rows like others. Extra columns only tell rows apart. An empty table gives an empty result. Sources are collected to the
    driver: one number for each.
    """
    spark = docs.sparkSession
    mark = F.xxhash64(*[docs[c] for c in docs.columns])
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), mark.alias("mark"), size.alias("size"))
    units = materialize(units.groupBy("doc_id", "source", "mark", "size").agg(F.count(F.lit(1)).alias("repeats")), "mix-units")
    per = {r[0]: (int(r[1]), r[2]) for r in units.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")), F.count(F.lit(1))).collect()}
    want = targets({s: w for s, (w, _) in per.items()}, cycle, share, most)
    rows = []
    for s, (words, n) in per.items():
        f = min(most, want[s] / words) if words else 0.0
        rows.append((s, words, float(want[s]), math.ceil(n / GROUP), int(f), f - int(f)))
    known = spark.createDataFrame(rows, "of string, source_size long, target double, groups int, whole int, p double")
    now = units.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("of")))
    # of equal rows a whole number is dealt at once, and one at most is left open
    now = now.withColumn("mass", F.col("repeats") * F.col("p")).withColumn("extra", F.floor("mass"))
    now = now.select("doc_id", "source", "mark", "size", "repeats", "whole", "extra", (F.col("mass") - F.col("extra")).alias("open"), "groups")
    done, levels, groups = None, [units], max([r[3] for r in rows], default=1)
    while True:
        last = groups == 1
        dealt = now.withColumn("bucket", F.pmod(F.xxhash64("mark", F.lit(groups)), F.col("groups")))
        level = materialize(dealt.groupBy("source", "bucket").applyInPandas(_round(last), _UNIT), "mix-level")
        levels.append(level)
        finished = level.where("open = 0").drop("open")
        done = finished if done is None else done.unionByName(finished)
        if last:
            break
        groups = math.ceil(groups / GROUP)
        fewer = F.ceil(F.col("groups") / F.lit(GROUP)).cast("int").alias("groups")
        now = level.where("open > 0").join(F.broadcast(known.select("of", fewer)), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    known = known.select("of", "source_size", "target")
    out = done.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "mark", "size", "repeats", "whole", "extra", "source_size", "target")
    out = materialize(out, "mix")
    for table in levels:
        drop_table(spark, table)
    return out


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, with docs' columns, whatever their names."""
    own, of_id, of_mark, n, copy = unused(docs, "own", "id", "mark", "n", "copy")
    plan = mix_copies(docs).select(F.col("doc_id").alias(of_id), F.col("mark").alias(of_mark), (F.col("whole") * F.col("repeats") + F.col("extra")).alias(n), F.col("repeats").alias(copy)).where(F.col(n) > 0)
    keyed = docs.withColumn(own, F.xxhash64(*[docs[c] for c in docs.columns]))
    # of equal rows one is kept and taken as often as all of them; only rows that repeat are shuffled for it
    again = plan.where(F.col(copy) > 1)
    match = (F.col(own) == F.col(of_mark)) & F.col("doc_id").cast("long").eqNullSafe(F.col(of_id))
    single = keyed.join(plan.where(F.col(copy) == 1), match)
    if not again.isEmpty():
        single = single.unionByName(keyed.join(again, match).dropDuplicates([of_id, of_mark]))
    return single.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)


def taken(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, source, copies."""
    out = mix_copies(docs).withColumn("k", F.explode(F.expr("sequence(1L, repeats)")))
    out = out.withColumn("copies", (F.col("whole") + F.when(F.col("k") <= F.col("extra"), 1).otherwise(0)).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
