"""Benchmark decontamination: n-gram seeds bring passages and test items together, Smith-Waterman scores them.

1. Every word n-gram of a test item is a seed. Which of them an edited copy still holds can't be known beforehand, so none
   is left out, however rare or common it is in the documents.
2. One pass looks the seeds up in each text. Hits of one item within reach of each other make a passage. A passage that
   lacks too many of the item's words to reach THRESHOLD is dropped; each other one is aligned with the item word by
   word, and score is the best local alignment over that of the item with itself.

Test items come to the tasks in blocks of at most BLOCK_BYTES of text, one pass a block, so what is broadcast
is bounded however large the benchmark is. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farelane.llm import textbytes as tb
from farelane.llm.common import trimmed

N, THRESHOLD = 3, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 32 << 20
_MASK = np.uint64((1 << 20) - 1)


@dataclass
class Items:
    """Test items of one block and their n-grams: `of` and `at` give the item and word of each n-gram, sorted by hash."""

    ids: list[list[int]]
    words: list[np.ndarray]
    grams: np.ndarray
    of: np.ndarray
    at: np.ndarray
    seen: np.ndarray = field(init=False)
    starts: np.ndarray = field(init=False)
    distinct: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.distinct, self.starts = np.unique(self.grams, return_index=True)
        self.starts = np.append(self.starts, len(self.grams))
        self.seen = np.zeros(int(_MASK) + 1, bool)
        self.seen[(self.distinct & _MASK).astype(np.int64)] = True

    @classmethod
    def of_texts(cls, rows: list[tuple[int, str]]) -> Items:
        raw, off = tb.column_bytes(pa.array([t for _, t in rows], pa.string()))
        same: dict[bytes, int] = {}
        ids: list[list[int]] = []
        words: list[np.ndarray] = []
        for i, j, bounds, h in tb.word_hashes(raw, off):
            for q in range(j - i):
                own = h[bounds[q] : bounds[q + 1]].copy()
                if len(own) < N:
                    continue
                k = same.setdefault(own.tobytes(), len(words))
                if k == len(words):
                    ids.append([])
                    words.append(own)
                ids[k].append(rows[i + q][0])
        grams = [tb.chain(w, N) for w in words]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        return cls(ids, words, flat[order], of[order], at[order])

    def hits(self, bounds: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents (0 is the block's first), word positions in h, and indexes into distinct of the n-grams found."""
        g = tb.chain(h, N)
        at = np.flatnonzero(self.seen[(g & _MASK).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.distinct, g[at]), len(self.distinct) - 1)
        right = self.distinct[k] == g[at]
        at, k = at[right], k[right]
        doc = np.searchsorted(bounds, at, "right") - 1
        inside = at + N <= bounds[doc + 1]
        return doc[inside], at[inside], k[inside]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman over words: (best score / the item's score with itself, first and last word of the passage used)."""
    n = len(passage)
    steps = np.arange(n + 1) * -GAP
    score, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, span = 0, (0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(passage == word, MATCH, MISMATCH)
        up = score[1:] + GAP
        now = np.concatenate([[0], np.maximum(np.maximum(diagonal, up), 0)])
        source = np.concatenate([[0], np.where(diagonal >= up, begin[:-1], begin[1:])])
        source = np.where(now == 0, np.arange(n + 1), source)
        # gaps along the passage: the best of all cells to the left, less their distance
        ahead = np.maximum.accumulate(now + steps)
        who = np.maximum.accumulate(np.where(now + steps == ahead, np.arange(n + 1), 0))
        begin, score = source[who], ahead - steps
        if (top := int(score.argmax())) and score[top] > best:
            best, span = int(score[top]), (int(begin[top]), top - 1)
    return best / (MATCH * len(item)), *span


def passages(positions: np.ndarray, offsets: np.ndarray, length: int, total: int) -> list[tuple[int, int]]:
    """Where in a text of `total` words an item of `length` words may lie, from seed hits; hits closer than `length` join."""
    order = np.argsort(positions, kind="stable")
    positions, offsets = positions[order], offsets[order]
    cut = np.flatnonzero(np.diff(positions) > length) + 1
    slack, out = length, []  # a copy that reaches THRESHOLD has at most so many words put in or left out
    for p, o in zip(np.split(positions, cut), np.split(offsets, cut), strict=True):
        out.append((max(0, int((p - o).min()) - slack), min(total, int((p - o).max()) + length + slack)))
    return out


def leaks(seeds: Items, bounds: np.ndarray, h: np.ndarray, cache: dict) -> Iterator[tuple[int, int, float, int, int]]:
    """(document, item, score, first word, last word) of the best alignment of each pair that reaches THRESHOLD."""
    if not len(seeds.distinct):
        return
    doc, at, k = seeds.hits(bounds, h)
    for d in np.unique(doc):
        mine = doc == d
        sizes = seeds.starts[k[mine] + 1] - seeds.starts[k[mine]]
        where = np.repeat(at[mine] - bounds[d], sizes)
        post = np.repeat(seeds.starts[k[mine]] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        order = np.argsort(seeds.of[post], kind="stable")
        item, offset, where = seeds.of[post][order], seeds.at[post][order], where[order]
        text = h[bounds[d] : bounds[d + 1]]
        for own in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
            i, best = item[own[0]], (0.0, 0, 0)
            for a, z in passages(where[own], offset[own], len(seeds.words[i]), len(text)):
                if np.isin(seeds.words[i], text[a:z]).sum() < THRESHOLD * len(seeds.words[i]):
                    continue
                key = (int(i), text[a:z].tobytes())
                if key not in cache:
                    if len(cache) > 20_000:
                        cache.clear()
                    cache[key] = align(seeds.words[i], text[a:z])
                score, s, e = cache[key]
                if score > best[0]:
                    best = (score, a + s, a + e)
            if best[0] >= THRESHOLD:
                yield int(d), int(i), *best


def _find(seeds: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            raw, off = tb.column_bytes(batch.column("text"))
            ids, out = batch.column("doc_id"), []
            for i, _, bounds, h in tb.word_hashes(raw, off):
                for d, item, score, first, last in leaks(seeds, bounds, h, cache):
                    out += [(ids[i + d].as_py(), x, score, first, last, len(seeds.words[item])) for x in seeds.ids[item]]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "score", "first_word", "last_word", "item_words"])

    return run


def _clean(seeds: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            raw, off = tb.column_bytes(batch.column("text"))
            keep = np.ones(len(off) - 1, bool)
            for i, _, bounds, h in tb.word_hashes(raw, off):
                keep[[i + d for d, *_ in leaks(seeds, bounds, h, cache)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark's items, at most about BLOCK_BYTES of text at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= BLOCK_BYTES:
        yield Items.of_texts(sorted(((r[0], r[1]) for r in items.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))
        return
    sums = F.sum(F.octet_length("text").cast("long")).over(W.orderBy("item_id", "text").rowsBetween(W.unboundedPreceding, 0))
    cut = items.withColumn("block", F.floor(sums / F.lit(BLOCK_BYTES))).persist()
    for b in range(total // BLOCK_BYTES + 1):
        yield Items.of_texts([(r["item_id"], r["text"]) for r in cut.where(F.col("block") == b).orderBy("item_id", "text").collect()])
    cut.unpersist()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word, item_words) for each document and test item whose best alignment
    scores THRESHOLD or more; words count from 0.

    Null and empty texts hold nothing. Items of fewer than N words can't be told from ordinary text and aren't searched for;
    items of equal words are reported under each id. Each repeated document row is reported. Extra columns are
    ignored. Empty tables give an empty result.
    """
    schema = "doc_id long, item_id long, score double, first_word long, last_word long, item_words long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in _blocks(benchmark):
        part = rows.mapInArrow(trimmed(_find(items)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no test item is found, with docs' columns."""
    for items in _blocks(benchmark):
        docs = docs.mapInArrow(trimmed(_clean(items)), docs.schema)
    return docs
