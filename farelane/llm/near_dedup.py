"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

1. A document becomes the set of its k-word shingles (64-bit hashes). Equal sets share one node, so exact
   copies, however many, cost one row each and no comparison.
2. HASHES minima per node, cut into bands of ROWS: a pair at the similarity threshold shares no band with
   probability (1 - t**ROWS)**(HASHES/ROWS), 4.6e-7 for 0.8.
3. In each bucket every member is compared with the bucket's smallest member (the hub). Links found so are
   joined into components. In buckets that still hold several components, members outside the largest one are compared
   with all of other components, on signatures alone; those with a likely partner come again with their full sets. Rows
   grow with the members of buckets, not with pairs: a bucket is one tile, cut further only where it is beyond a tile's
   bound. A pair is judged in the first bucket that it shares. So no link between components is lost and no
   list of pairs is ever emitted.
4. A comparison reads the two signatures in batches and stops as soon as the posterior probability of
   similarity >= t (uniform prior) falls below MISS; survivors are confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelane.llm import textbytes as tb
from farelane.llm.common import drop_table, materialize, maybe_in, trimmed, unused

HASHES, ROWS, BATCH = 288, 6, 48
MISS = 1e-6
#: A tile holds at most so many members with signatures, so many bytes of sets; pairs are judged so many at a time.
TILE_ROWS, BLOCK_BYTES, PAIRS = 4096, 8 << 20, 1 << 16
#: Whole signatures or sets of so many pairs are gathered at a time; from MANY pairs on a tile's sets are compared as bits. Rows that are read at a time.
GATHER, MANY, READ = 1 << 12, 64, 1 << 11


@lru_cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = tb.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return x[:n].astype(np.uint32) | np.uint32(1), x[n:].astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of a non-empty shingle set."""
    a, b = _permutations(HASHES)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(best, (a[:, None] * x[None, i : i + 256] + b[:, None]).min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    h = np.arange(HASHES // ROWS, dtype=np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for part in sig.reshape(-1, ROWS).T:
            h = tb.mix(h * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64))
    return h


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits that name a shingle set."""
    with np.errstate(over="ignore"):
        return b"".join(int(tb.mix(shingles ^ np.uint64(c)).sum(dtype=np.uint64)).to_bytes(8, "big") for c in (0x243F6A8885A308D3, 0x13198A2E03707344))


@lru_cache
def needed_matches(threshold: float, miss: float, batch: int, total: int) -> list[int]:
    """For each batch, the least number of matches so far with P(similarity >= threshold) >= miss."""
    out = []
    for n in range(batch, total + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tb.column_bytes(batch.column("text"))
            n = np.zeros(len(off) - 1, np.int64)
            node: list[bytes | None] = [None] * len(n)
            bands: list[np.ndarray | None] = [None] * len(n)
            for i, j, at, h in tb.word_hashes(raw, off):
                for q in range(i, j):
                    s = tb.shingle_set(h[at[q - i] : at[q - i + 1]], k)
                    if len(s):
                        n[q], node[q], bands[q] = len(s), fingerprint(s), band_keys(signature(s)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "mark", "text_key")), pa.array(n), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "mark", "text_key", "n_shingles", "node", "bands"])

    return run


def _sets(k: int):
    """Node, signature and whole shingle set of candidate documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tb.column_bytes(batch.column("text"))
            for i, j, at, h in tb.word_hashes(raw, off):
                sets = [tb.shingle_set(h[at[q] : at[q + 1]], k) for q in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(i, j - i), pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["node", "sig", "shingles"],
                )

    return run


def _by_run(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys from sorted rows, with the positions where a run begins and the end."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        starts = _starts(held, keys)
        a = 0
        while a < len(starts) - 1:  # a few runs at a time, as readers copy what they read
            b = min(max(a + 1, int(np.searchsorted(starts, starts[a] + READ, "right")) - 1), len(starts) - 1)
            yield held.slice(int(starts[a]), int(starts[b] - starts[a])), starts[a : b + 1] - starts[a]
            a = b
        held = held.slice(int(starts[-1]))
    if held is not None and held.num_rows:
        yield held, np.append(_starts(held, keys), held.num_rows)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        col = table.column(k)
        x = _pairs(col) if pa.types.is_binary(col.type) else col.to_numpy()[:, None]
        new[1:] |= (x[1:] != x[:-1]).any(axis=1)
    return np.flatnonzero(new)


def _pairs(col: pa.ChunkedArray) -> np.ndarray:
    """16-byte names as two numbers each."""
    return tb.column_bytes(col)[0].view(">u8").astype(np.uint64).reshape(-1, 2)


def _likely(sig: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, apart, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (left, right) that apart(left, right) admits and whose signatures, read in batches, keep the posterior
    probability of similarity >= percent/100 at MISS or more; and how many minima they share. At most about PAIRS at a time:
    of a tile's members nearly all pairs can be likely, and are never held at once."""
    need = needed_matches(percent / 100, MISS, BATCH, HASHES)
    low = np.ascontiguousarray(sig[:, :BATCH].astype(np.uint8))  # of the first batch the lowest byte: at most more matches
    step = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), step):
        own = left[at : at + step]
        for to in range(0, len(right), PAIRS):
            others = right[to : to + PAIRS]
            n, m = size[own][:, None], size[others][None, :]
            # sizes alone bound the similarity: min/max >= t
            good = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & apart(own, others)
            if not good.any():
                continue
            same = (low[own][:, None, :] == low[others][None, :, :]).view(np.uint64)
            good &= np.bitwise_count(same).sum(axis=2) >= need[0]
            i, j = np.nonzero(good)
            i, j, seen = own[i], others[j], np.zeros(len(i), np.int64)
            for b, least in enumerate(need):
                if not len(i):
                    break
                cut = slice(b * BATCH, (b + 1) * BATCH)
                seen += (sig[i, cut] == sig[j, cut]).sum(axis=1)
                keep = seen >= least
                i, j, seen = i[keep], j[keep], seen[keep]
            if len(i):
                yield i, j, seen


def _first_band(sig: np.ndarray, i: np.ndarray, j: np.ndarray, band: int) -> np.ndarray:
    """Whether `band` is the first that a pair shares; so a pair is judged in one bucket only."""
    own, out = int(np.flatnonzero(band_keys(sig[i[0]]).view(np.int64) == band)[0]), np.empty(len(i), bool)
    for at in range(0, len(i), GATHER):
        x, y = i[at : at + GATHER], j[at : at + GATHER]
        same = (sig[x].reshape(len(x), -1, ROWS) == sig[y].reshape(len(y), -1, ROWS)).all(axis=2)
        out[at : at + GATHER] = same.argmax(axis=1) == own
    return out


class _Joined:
    """Components of a tile's members [s, e), as confirmed pairs join them: two that earlier pairs have joined aren't joined again."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, comp: np.ndarray, s: int, e: int, percent: int):
        self.raw, self.off, self.s, self.e, self.percent = raw, off, s, e, percent
        self.label = np.unique(comp[s:e], axis=0, return_inverse=True)[1].ravel()
        self.pairs, self.bits = 0, None

    def _similar(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        row, table, size = self.bits
        x, y = row[x + self.s], row[y + self.s]
        both = np.bitwise_count(table[x] & table[y]).sum(axis=1, dtype=np.int64)
        return 100 * both >= self.percent * (size[x] + size[y] - both)

    def _alike(self, p: int, q: int) -> bool:
        x, y = (self.raw[self.off[m + self.s] : self.off[m + self.s + 1]].view(np.uint64) for m in (p, q))
        place = np.minimum(np.searchsorted(x, y), len(x) - 1)
        both = int((x[place] == y).sum())
        return 100 * both >= self.percent * (len(x) + len(y) - both)

    def links(self, i: np.ndarray, j: np.ndarray, seen: np.ndarray) -> list[tuple[int, int]]:
        """Of these pairs, likeliest first, those of similarity >= percent/100 on the full sets that join two components."""
        if self.pairs < MANY <= self.pairs + len(i):  # bits of all sets pay from here on
            self.bits = _bits(self.raw, self.off, np.arange(self.s, self.e))
        self.pairs += len(i)
        order = np.argsort(-seen, kind="stable")
        i, j, label, out = i[order] - self.s, j[order] - self.s, self.label, []
        step = GATHER if self.bits is None else min(GATHER, max(1, BLOCK_BYTES // (8 * self.bits[1].shape[1] + 1)))
        for at in range(0, len(i), step):
            x, y = i[at : at + step], j[at : at + step]
            open_ = label[x] != label[y]
            x, y = x[open_], y[open_]
            if self.bits is not None and len(x):
                good = self._similar(x, y)
                x, y = x[good], y[good]
            for p, q in zip(x, y, strict=True):
                if label[p] != label[q] and (self.bits is not None or self._alike(p, q)):
                    label[label == label[q]] = label[p]
                    out.append((int(p) + self.s, int(q) + self.s))
        return out


def _bits(raw: np.ndarray, off: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(row of each member, sets as bits over the shingles that two or more members have, set sizes); None if too large."""
    sets = [raw[off[p] : off[p + 1]].view(np.uint64) for p in members]
    size = np.array([len(x) for x in sets])
    every, of, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n > 1)
    width = max(1, -(-len(shared) // 64))
    if 8 * width * len(members) > 4 * BLOCK_BYTES:
        return None
    place = np.full(len(every), -1, np.int64)
    place[shared] = np.arange(len(shared))
    at, owner = place[of.ravel()], np.repeat(np.arange(len(members)), size)
    owner, at = owner[at >= 0], at[at >= 0]
    table = np.zeros((len(members), width), np.uint64)
    np.bitwise_or.at(table, (owner, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    row = np.zeros(int(members[-1]) + 1, np.int64)
    row[members] = np.arange(len(members))
    return row, table, size


def _judge(percent: int, exact: bool):
    """Over tiles of a bucket, sorted by (key, l, r): side 0 is left only, 1 right only, 2 both; `odd` marks left members.

    Not exact: (key, node) of members with a likely partner of another component. Exact: links between components,
    confirmed on the full sets; a component that a link has joined in the tile isn't compared with its own again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _by_run(batches, ["key", "l", "r"]):
            node, comp = _pairs(table.column("node")), _pairs(table.column("comp"))
            sig = tb.column_bytes(table.column("sig"))[0].view(np.uint32).reshape(-1, HASHES)
            side, size = table.column("side").to_numpy(), table.column("size").to_numpy()
            banded = not pa.types.is_binary(table.schema.field("key").type)
            key = table.column("key").to_numpy() if banded else None
            names = table.column("comp") if exact else table.column("node")
            raw, off = tb.column_bytes(table.column("shingles")) if exact else (None, None)
            found: list = []

            def apart(a: np.ndarray, b: np.ndarray, node=node, comp=comp, side=side) -> np.ndarray:
                differ = (comp[a][:, None] != comp[b][None]).any(axis=2)
                x, y = node[a][:, None], node[b][None]
                later = (y[..., 0] > x[..., 0]) | (y[..., 0] == x[..., 0]) & (y[..., 1] > x[..., 1])
                return differ & (later | (side[b] == 1)[None])

            for s, e in zip(starts[:-1], starts[1:], strict=True):
                at = np.arange(s, e)
                left, right = at[np.isin(side[s:e], (0, 2))], at[np.isin(side[s:e], (1, 2, 3))]
                joined, hit = None, np.zeros(e - s, bool)
                for i, j, seen in _likely(sig, size, left, right, apart, percent):
                    if banded:
                        keep = _first_band(sig, i, j, int(key[s]))
                        i, j, seen = i[keep], j[keep], seen[keep]
                    if not len(i):
                        continue
                    if not exact:
                        hit[i - s] = hit[j - s] = True
                        continue
                    joined = joined or _Joined(raw, off, comp, int(s), int(e), percent)
                    found += joined.links(i, j, seen)
                if not exact:
                    found.append(np.flatnonzero(hit) + s)
            if exact:
                cols = [names.take(pa.array([f[k] for f in found], pa.int64())).combine_chunks() for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, ["a", "b"])
            else:
                at = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([table.column("key").take(at).combine_chunks(), names.take(at).combine_chunks()], ["key", "node"])

    return run


def _tiles(members: DataFrame, weight: str, most: int) -> DataFrame:
    """Members (key, node, comp, size, odd) of buckets, dealt to tiles (l, r) whose left and right sides weigh at most about
    `most`: odd members against all. A bucket that fits in one tile goes there once, so rows grow with the members."""
    sums = members.groupBy("key").agg(F.sum(weight).alias("whole"), F.sum(F.when(F.col("odd"), F.col(weight)).otherwise(0)).alias("part"))
    cuts = sums.select("key", F.ceil(F.col("part") / most).cast("int").alias("ls"), F.ceil(F.col("whole") / most).cast("int").alias("rs"))
    dealt = members.join(cuts, "key").withColumn("h", F.xxhash64("node"))
    one = "array(named_struct('l', 0, 'r', 0, 'side', case when odd then 2 else 1 end))"
    own_l, own_r = "cast(pmod(h, ls) as int)", "cast(pmod(h, rs) as int)"
    lefts = f"case when odd then transform(sequence(0, rs - 1), x -> named_struct('l', {own_l}, 'r', x, 'side', 0)) else array() end"
    rights = f"transform(sequence(0, ls - 1), x -> named_struct('l', x, 'r', {own_r}, 'side', case when odd then 3 else 1 end))"
    dealt = dealt.where("ls > 0").withColumn("t", F.explode(F.expr(f"case when ls = 1 and rs = 1 then {one} else concat({lefts}, {rights}) end")))
    return dealt.select("key", "t.l", "t.r", "t.side", "node", "comp", "size")


def _judged(tiles: DataFrame, sets: DataFrame, percent: int, exact: bool) -> DataFrame:
    key = tiles.schema["key"].dataType.simpleString()
    rows = tiles.join(sets if exact else sets.drop("shingles"), "node").repartition("key", "l", "r").sortWithinPartitions("key", "l", "r")
    return rows.mapInArrow(trimmed(_judge(percent, exact)), "a binary, b binary" if exact else f"key {key}, node binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of an undirected edge list (a, b): comp is the smallest node reachable.

    Alternating large-star and small-star steps; each step is two keyed joins or aggregates over the edges, written
    to the shared folder, until the edge set no longer changes.
    """
    spark = edges.sparkSession
    mark = F.expr("struct(count(*), coalesce(sum(cast(xxhash64(a, b) as decimal(38, 0))), 0))").alias("m")
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last, old = None, now.agg(mark).first()["m"]
    while last != old:
        last, before = old, now
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = materialize(small, "edges")
        old = now.agg(mark).first()["m"]
        drop_table(spark, before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select("b", "b").distinct())


def cluster(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links of similarity >= percent/100 on distinct k-word
    shingles. Null and empty texts (or texts of white space) have no shingles and are linked with nothing. Null
    ids take part in links but never name a component unless all its ids are null. Repeated rows are equal
    texts. Extra columns are ignored; an empty table gives an empty result.
    """
    out = _named(docs.select("doc_id", "text", F.lit(0).cast("long").alias("mark")), k, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _named(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, mark, n_shingles, node, comp, component_id) per row of docs (doc_id, text, mark); comp is null without words."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "mark", F.xxhash64("text").alias("text_key"))
    each = materialize(docs.mapInArrow(trimmed(_sketches(k)), "doc_id long, mark long, text_key long, n_shingles long, node binary, bands array<long>"), "sketches")
    ids = each.select("doc_id", "mark", "n_shingles", "node")
    nodes = each.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    member = materialize(nodes.select("node", "size", F.explode("bands").alias("band")), "bands")
    often = member.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")  # most bands are alone: they move without names
    held = materialize(member.join(often, "band", "left_semi"), "often")
    drop_table(spark, member)
    shared = materialize(held.join(held.groupBy("band").agg(F.min("node").alias("hub")), "band").select("band", "node", "size", "hub"), "buckets")
    drop_table(spark, held)

    # one text of each candidate node is read again for its whole set
    wanted = each.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("lead"))
    wanted = materialize(wanted.select("node", F.col("lead.doc_id").alias("_id"), F.col("lead.text_key").alias("_key")), "wanted")
    again = docs.where(maybe_in(wanted, "_key")(F.col("text_key"))).join(wanted, (docs["text_key"] == F.col("_key")) & docs["doc_id"].eqNullSafe(F.col("_id"))).select("node", "text").dropDuplicates(["node"])
    sets = materialize(again.mapInArrow(trimmed(_sets(k)), "node binary, sig binary, shingles binary"), "sets")
    comp = _link(shared, sets, percent)
    named = ids.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.where("node is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    named = named.join(least, "comp", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    out = materialize(named.select("doc_id", "mark", "n_shingles", "node", "comp", "component_id"), "named")
    for done in (each, shared, sets, comp, wanted):
        drop_table(spark, done)
    return out


def _link(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, comp) of every node with a link, from buckets (band, node, size, hub)."""
    spark = shared.sparkSession
    star = shared.where("node <> hub").select(F.col("hub").alias("key"), "node", F.col("node").alias("comp"), "size", F.lit(False).alias("odd")).distinct()
    hubs = shared.where("node = hub").select(F.col("node").alias("key"), "node", F.col("node").alias("comp"), "size", F.lit(True).alias("odd")).distinct()
    stars = star.unionByName(hubs).withColumn("bytes", F.when(F.col("odd"), F.lit(1)).otherwise(F.col("size") * 8 + 1152))
    links = materialize(_judged(_tiles(stars, "bytes", BLOCK_BYTES), sets, percent, True), "links")
    comp = components(links)

    # buckets of several components: members outside the largest one against all of other components
    held = shared.join(comp, "node", "left").select("band", "node", "size", F.coalesce("comp", "node").alias("comp"))
    parts = held.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    top = parts.groupBy("band").agg(F.max(F.struct("n", "comp"))["comp"].alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("band", "top")
    mixed = materialize(held.join(top, "band").select(F.col("band").alias("key"), "node", "comp", "size", (F.col("comp") != F.col("top")).alias("odd"), F.lit(1).alias("one")), "mixed")
    likely = materialize(_judged(_tiles(mixed, "one", TILE_ROWS), sets, percent, False).distinct(), "likely")
    rest = mixed.join(likely, ["key", "node"]).withColumn("bytes", F.col("size") * 8 + 1152)
    more_links = materialize(_judged(_tiles(rest, "bytes", BLOCK_BYTES), sets, percent, True), "links")
    more = components(more_links).select(F.col("node").alias("comp"), F.col("comp").alias("joined"))
    final = comp.join(more, "comp", "left").select("node", F.coalesce("joined", "comp").alias("comp"))
    # nodes that only the second search linked
    alone = more.join(comp, more["comp"] == comp["node"], "left_anti").select(F.col("comp").alias("node"), F.col("joined").alias("comp"))
    out = materialize(final.unionByName(alone), "linked")
    for done in (links, mixed, likely, more_links, comp, more):
        drop_table(spark, done)
    return out


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each group of cluster(), with docs' columns: a row with the group's id.

    Of several rows with that id the one of least row hash stays, and of equal rows one. Rows without words are no
    group and all stay. A group whose ids are all null keeps one row as well. Columns of any name survive.
    """
    key = F.xxhash64(*[docs[c] for c in docs.columns])
    named = _named(docs.select("doc_id", "text", key.alias("mark")), k, percent).where("comp is not null")
    first = named.where("doc_id <=> component_id").groupBy("comp").agg(F.min("mark").alias("first"))
    judged = named.join(first, "comp").withColumn("keep", F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("first")))
    again = judged.where("keep").groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark")
    others = judged.where("not keep").select("doc_id", "mark")
    own, of_id, of_mark = unused(docs, "own", "id", "mark")
    rows = docs.withColumn(own, key)

    def those(keys: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        named_keys = keys.select(F.col("doc_id").alias(of_id), F.col("mark").alias(of_mark))
        return rows.join(named_keys, (F.col(own) == F.col(of_mark)) & F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)), how)

    again = materialize(again, "repeated")
    drop = materialize(others.union(again).distinct(), "dropped")
    maybe = maybe_in(drop, "mark")(F.col(own))
    # only rows that may be dropped are joined; all others stay as they lie
    one_each = rows.where(~maybe).unionByName(those(drop, "left_anti", rows.where(maybe))).select(*docs.columns)
    if again.isEmpty():
        return one_each
    return one_each.unionByName(those(again, "left_semi", rows).dropDuplicates(["doc_id", own]).select(*docs.columns))
