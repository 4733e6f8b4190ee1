"""Hierarchical weighted hash tree: rows descend region, rack and shard levels by weighted hash draws.

A node's weight is the sum of its children's. At each level every child of the node that a key has reached draws for it:
-ln(u)/weight with u hashed from key, level and child, an exponential draw with the child's weight as rate, and the least
wins. A greater weight only lowers a child's own draws and a smaller one only raises them. So when a shard's weight
changes, rows cross between its region and the others, between its rack and the others of its region, and between it
and the others of its rack, always into the heavier side; all other subtrees keep their rows. One more shard is
added as a region of its own, so it takes rows only into itself. All of it is built-in column arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farelane.llm.common import materialize

RACK, REGION = 4, 3
SLOT_ROWS = 2000


def topology(n: int, weights: dict[int, float] | None = None) -> list[list[list[tuple[int, float]]]]:
    """Regions of REGION racks of RACK shards, filled in order; weights default to 1."""
    shards = [(s, (weights or {}).get(s, 1.0)) for s in range(n)]
    racks = [shards[i : i + RACK] for i in range(0, n, RACK)]
    return [racks[i : i + REGION] for i in range(0, len(racks), REGION)]


def weight_of(node) -> float:
    """Summed weight of a shard, rack or region."""
    return float(node[1]) if isinstance(node, tuple) else sum(weight_of(x) for x in node)


def draw(key: Column, level: str, node: int, weight: float) -> Column:
    """Exponential draw of one node, with its weight as rate."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(node)), 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))
    return -F.log(u) / F.lit(weight)


def least(key: Column, level: str, children: list[tuple[int, float]]) -> Column:
    """struct(draw, node) of the child with the least draw."""
    drawn = [F.struct(draw(key, level, i, w).alias("draw"), F.lit(i).alias("node")) for i, w in children if w > 0]
    return F.least(*drawn) if len(drawn) > 1 else drawn[0]


def descend(rows: DataFrame, key: str, tree: list[list[list[tuple[int, float]]]]) -> DataFrame:
    """rows with region_draw, region, rack and shard of their key: a rack is drawn in the region, a shard in the rack."""

    def within(column: str, level: str, groups: list[list[tuple[int, float]]]) -> Column:
        out = F
        for i, group in enumerate(groups):
            if any(w > 0 for _, w in group):
                out = out.when(F.col(column) == i, least(F.col(key), level, group)["node"])
        return out

    racks = [rack for region in tree for rack in region]
    number = iter(range(len(racks)))
    in_region = [[(next(number), weight_of(rack)) for rack in region] for region in tree]
    top = least(F.col(key), "region", [(i, weight_of(region)) for i, region in enumerate(tree)])
    rows = rows.withColumn("top", top).withColumns({"region_draw": F.col("top.draw"), "region": F.col("top.node")}).drop("top")
    return rows.withColumn("rack", within("region", "rack", in_region)).withColumn("shard", within("rack", "shard", racks))


def assign(docs: DataFrame, n: int = 24, weights: dict[int, float] | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, size, text_crc32, law 'key', shard, slot, grown_shard, region, rack.

    size is the text's UTF-8 bytes plus 8 and a null text counts as empty; null ids share one key. Equal ids go to one
    shard. Slots are gapless from 0 in each shard: a shard's rows are numbered in buckets of about SLOT_ROWS,
    and a bucket starts where the ones before it end, so no task holds a whole shard. Repeated rows are counted before the
    numbering and get one slot each, so any number of them is one row of a bucket;
    an empty table gives an empty result; extra columns are ignored.
    """
    total = max(1, docs.select("doc_id").count())
    buckets = max(1, math.ceil(total / (n * SLOT_ROWS)))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # rows of equal id and text are told apart by nothing: they are counted, and numbered where they come together
    kinds = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    tree = topology(n, weights)
    kinds = descend(kinds, "doc_id", tree)
    one_more = draw(F.col("doc_id"), "region", len(tree), 1.0)
    kinds = kinds.withColumn("grown_shard", F.when(one_more < F.col("region_draw"), n).otherwise(F.col("shard"))).drop("region_draw")
    kinds = materialize(kinds.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("slot")), F.lit(buckets))), "kinds")
    counts = kinds.groupBy("shard", "bucket").agg(F.sum("n").alias("all"))
    before = counts.select("shard", "bucket", (F.sum("all").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("all")).alias("before"))
    within = W.partitionBy("shard", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, 0)
    out = kinds.withColumn("at", F.sum("n").over(within) - F.col("n")).join(before, ["shard", "bucket"])
    out = out.withColumn("first", F.col("before") + F.col("at")).withColumn("slot", F.explode(F.expr("sequence(first, first + n - 1)")))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
