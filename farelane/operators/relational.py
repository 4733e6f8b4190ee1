"""Joins, windows and selections that Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farelane.session import scratch


# ---- as-of joins ---------------------------------------------------------------------------------------------------
def asof(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, keep: list[str], how: str = "backward", prefix: str = "asof_") -> DataFrame:
    """Rows of left with the columns `keep` of the last right row at or before left_time (backward) or the first at or after (forward).

    Both sides are laid together and sorted once by key and time; a running last (or first) value does the rest, so
    the cost is a sort and never a range join. Of right rows at one time the largest (backward) or smallest (forward) by `keep` counts.
    Rows with null keys or times stay, unmatched.
    """
    back = how == "backward"
    payload = F.struct(F.col(right_time).alias("_t"), *[F.col(c) for c in keep])
    cols = left.columns
    a = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)], F.col(left_time).alias("_at"), F.lit(1 if back else 0).alias("_side"), F.struct(*cols).alias("_row"), F.lit(None).cast(right.select(payload).schema[0].dataType).alias("_hit"))
    b = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)], F.col(right_time).alias("_at"), F.lit(0 if back else 1).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), payload.alias("_hit"))
    w = W.partitionBy(*[f"_k{i}" for i in range(len(on))])
    order = [F.col("_at").asc(), F.col("_side").asc(), F.col("_hit").asc()]
    frame = w.orderBy(*order).rowsBetween(W.unboundedPreceding, 0) if back else w.orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    found = (F.last if back else F.first)("_hit", ignorenulls=True).over(frame)
    out = a.unionByName(b).withColumn("_got", found).where("_row is not null")
    known = F.expr(" and ".join([*(f"_k{i} is not null" for i in range(len(on))), "_at is not null"]))
    got = F.when(known, F.col("_got"))
    return out.select(*[F.col("_row")[c].alias(c) for c in cols], got["_t"].alias(f"{prefix}time"), *[got[c].alias(f"{prefix}{c}") for c in keep])


def nearest_prefer_past(left: DataFrame, right: DataFrame, on: list[str], left_day: str, right_day: str) -> DataFrame:
    """Every left row, repeated ones too, with the right day nearest before or at left_day, else the nearest after, else null.

    Right's days of a key go along as one sorted array, so left is joined once and never grouped.
    """
    days = right.where(F.col(right_day).isNotNull()).groupBy(*on).agg(F.array_sort(F.collect_set(right_day)).alias("_days"))
    past = F.element_at(F.filter("_days", lambda d: d <= F.col(left_day)), -1)
    ahead = F.get(F.filter("_days", lambda d: d > F.col(left_day)), F.lit(0))
    past = F.when(F.size(F.filter("_days", lambda d: d <= F.col(left_day))) > 0, past)
    return left.join(days, on, "left").select(*left.columns, F.coalesce(past, ahead).alias(right_day))


# ---- interval joins ------------------------------------------------------------------------------------------------
def _buckets(start: Column, end: Column, width: float) -> Column:
    first, last = F.floor(start / width), F.floor(end / width)
    return F.when(end >= start, F.sequence(first, last))


def contained(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Inner join of points with spans of the same key that contain them, both ends included.

    Spans are dealt to time buckets of `width` and joined by key and bucket: an equality join of any size, with the range as a
    filter. Spans whose end is before their start hold nothing.
    """
    dealt = spans.withColumn("_bucket", F.explode(_buckets(F.col(start), F.col(end), width)))
    own = points.withColumn("_bucket", F.floor(F.col(at) / width))
    return own.join(dealt, [*on, "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_bucket")


def overlapping(a: DataFrame, b: DataFrame, on: list[str], start_a: str, end_a: str, start_b: str, end_b: str, width: float | None = None) -> DataFrame:
    """Inner join of intervals of the same key that overlap (strictly). A pair meets once: in the bucket where its overlap begins.

    Without width there are no buckets: for keys that hold few of the times, as a day does, where buckets only copy rows.
    """
    if width is None:
        return a.hint("merge").join(b, on).where((F.col(start_b) < F.col(end_a)) & (F.col(end_b) > F.col(start_a)))
    x = a.withColumn("_bucket", F.explode(_buckets(F.col(start_a), F.col(end_a), width)))
    y = b.withColumn("_bucket", F.explode(_buckets(F.col(start_b), F.col(end_b), width)))
    first = F.floor(F.greatest(F.col(start_a), F.col(start_b)) / width)
    return x.join(y, [*on, "_bucket"]).where((F.col(start_b) < F.col(end_a)) & (F.col(end_b) > F.col(start_a)) & (F.col("_bucket") == first)).drop("_bucket")


def near(a: DataFrame, b: DataFrame, xa: str, ya: str, ta: str, xb: str, yb: str, tb: str, radius: float, seconds: float) -> DataFrame:
    """Pairs within radius and seconds: b is dealt to its 27 neighbouring grid cells, then the exact test.

    Both sides are sorted by cell: estimates don't see the 27 copies, so neither may be broadcast.
    """
    cell = lambda c, w: F.floor(F.col(c) / w)
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    left = a.withColumns({"_cx": cell(xa, radius), "_cy": cell(ya, radius), "_ct": cell(ta, seconds)})
    right = b
    for name, col, width in (("_cx", xb, radius), ("_cy", yb, radius), ("_ct", tb, seconds)):
        right = right.withColumn("_d", F.explode(around)).withColumn(name, cell(col, width) + F.col("_d")).drop("_d")
    dx, dy = F.col(xa) - F.col(xb), F.col(ya) - F.col(yb)
    return left.hint("merge").join(right, ["_cx", "_cy", "_ct"]).where((dx * dx + dy * dy <= radius * radius) & (F.abs(F.col(ta) - F.col(tb)) <= seconds)).drop("_cx", "_cy", "_ct")


# ---- windows and selections ------------------------------------------------------------------------------------------
def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in a total order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with its place (from 1) in a total order of all rows, in several tasks: rows are dealt by range and sorted there, and each
    range starts where the ones before it end."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    path = scratch(df.sparkSession, "numbered")  # written, as another run might draw other ranges
    at.write.parquet(path)
    at = df.sparkSession.read.parquet(path)
    sizes = at.groupBy("_part").agg((F.max("_at") + 1).alias("_n"))
    before = sizes.select(F.col("_part").alias("_of"), (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    return at.join(F.broadcast(before), F.col("_part") == F.col("_of")).withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_of", "_at", "_before")


def top_per(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def day_islands(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Runs of consecutive days of a key: start_date, end_date, n_days."""
    one = df.select(*keys, day).distinct()
    anchor = F.date_sub(F.col(day), F.row_number().over(W.partitionBy(*keys).orderBy(day)))
    return one.withColumn("_a", anchor).groupBy(*keys, "_a").agg(F.min(day).alias("start_date"), F.max(day).alias("end_date"), F.count(F.lit(1)).alias("n_days")).drop("_a")


def sessions(df: DataFrame, keys: list[str], at: str, gap: float, *tie: str) -> DataFrame:
    """Adds session: a number that grows when `at` is more than gap after the row before."""
    w = W.partitionBy(*keys).orderBy(at, *tie)
    jump = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_jump", jump).withColumn("session", F.sum("_jump").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_jump")


def softmax(score: Column, w: W) -> Column:
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def leave_one_out(x: Column, w: W) -> tuple[Column, Column]:
    """Mean of the other rows of the group and their number. A null row sees the plain mean; none left: null."""
    total, n = F.sum(x).over(w), F.count(x).over(w)
    others = n - F.when(x.isNotNull(), 1).otherwise(0)
    return F.try_divide(total - F.coalesce(x, F.lit(0.0)), others), others


def hashed_sample(df: DataFrame, n: int, *key: str, seed: int = 42) -> DataFrame:
    """n rows in an order that only depends on the keys."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """At most n rows a key, at even ranks from first to last (half ranks round to even)."""
    w = W.partitionBy(*keys)
    ranked = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    want = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(n - 1))).cast("int")))
    return ranked.where((F.col("_n") <= n) | F.array_contains(want, F.col("_i"))).drop("_i", "_n")
