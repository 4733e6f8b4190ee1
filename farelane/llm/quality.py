"""Compression classifier: zstandard dictionaries of good and bad text, and the calibrated difference of the sizes.

A text compresses better with the dictionary of the class that it resembles. The normalised difference
(bytes with the bad dictionary - bytes with the good one) / bytes of the text becomes the probability of label 1 by a
logistic curve, fitted on labelled texts that are in neither dictionary.

The fit reads a bounded sample of labelled rows: SAMPLE rows of each class for each of the two purposes, those of
the smallest id hash. Of these, the dictionaries take whole texts, by id hash, until DICTIONARY bytes are full; only the text
that no longer fits gives pieces spread over its whole length. Scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelane.llm import textbytes as tb
from farelane.llm.common import crc32_of_id, trimmed

SAMPLE, DICTIONARY, LEVEL, THRESHOLD = 4000, 1 << 20, 6, 0.3
PIECE = 256


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


_compressors: dict[tuple[bytes, bytes], tuple] = {}


def _pair(good: bytes, bad: bytes) -> tuple:
    if (good, bad) not in _compressors:
        _compressors.clear()
        made = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        _compressors[good, bad] = tuple(made)
    return _compressors[good, bad]


def difference(text: bytes, good: bytes, bad: bytes) -> float:
    """The normalised compressed-size difference of one text; 0 for an empty one."""
    if not text:
        return 0.0
    by_good, by_bad = _pair(good, bad)
    return (len(by_bad.compress(text)) - len(by_good.compress(text))) / len(text)


def shares(sizes: list[tuple[int, int]], size: int = DICTIONARY) -> dict[int, float]:
    """What part of its text each id gives to a dictionary of `size` bytes, of (id, bytes) in the order of choice."""
    out, room = {}, size
    for i, n in sizes:
        if n:
            out[i] = min(1.0, room / n)
            room -= min(n, room)
        if not room:
            break
    return out


def spread(text: Column, share: Column) -> Column:
    """The text, or for a share under 1 so much of it in pieces of PIECE characters at even distances from its start to its end."""
    n = F.floor(F.length(text) * share / PIECE).cast("int")
    step = (F.length(text) - PIECE) / F.greatest(n - 1, F.lit(1))
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(text, F.floor(k * step).cast("int") + 1, F.lit(PIECE)))
    return F.when(share >= 1, text).when(n > 0, F.array_join(pieces, "")).otherwise("")


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | x), by Newton steps with a small ridge on the slope in units of x's spread."""
    spread = float(x.std()) or 1.0
    a, w = np.stack([x / spread, np.ones_like(x)], 1), np.zeros(2)
    ridge = np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1])


def _measure(batch: pa.RecordBatch, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Difference and score of each text of a batch."""
    raw, off = tb.column_bytes(batch.column("text"))
    data = memoryview(np.ascontiguousarray(raw))
    d = np.array([difference(bytes(data[off[i] : off[i + 1]]), model.good, model.bad) for i in range(len(off) - 1)], float)
    return d, 1 / (1 + np.exp(-np.clip(model.slope * d + model.offset, -700, 700)))


def _score(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, score = _measure(batch, model)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(d), pa.array(score)], [*keep, "difference", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Dictionaries and calibration from labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    Rows with a null id or a label other than 0 and 1 don't count; an id labelled twice counts once, with its lower label.
    With no rows of one class all scores are a half.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    usable = usable.where(crc32_of_id(F.col("doc_id")) % 5 != 0).withColumn("use", F.pmod(F.xxhash64("doc_id", F.lit("use")), F.lit(2)).cast("int")).withColumn("order", F.xxhash64("doc_id"))
    n = {(r["quality"], r["use"]): r["count"] for r in usable.groupBy("quality", "use").count().collect()}
    # rows of small hash first, somewhat more than needed, so that only a bounded number is sorted
    small = [(F.col("quality") == q) & (F.col("use") == u) & (F.shiftrightunsigned("order", 11) <= int(min(1.0, (1.5 * sample + 1000) / c) * 2**53)) for (q, u), c in n.items()]
    if not small:
        return Model(b"good", b"bad", 0.0, 0.0)
    parts = [usable.where(x).orderBy("order", "doc_id").limit(sample) for x in small]
    usable = reduce(DataFrame.unionByName, parts).select("doc_id", "quality", "use", F.col("order").alias("rank"))
    # at most 4 * sample ids
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(usable), "doc_id")
    sizes = rows.where("use = 0").groupBy("quality", "rank", "doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("n")).collect()
    given = [(i, q, x) for q in (1, 0) for i, x in shares([(r["doc_id"], r["n"]) for r in sorted(sizes, key=lambda r: (r["rank"], r["doc_id"])) if r["quality"] == q]).items()]
    if not given:
        return Model(b"good", b"bad", 0.0, 0.0)
    chosen = docs.sparkSession.createDataFrame(given, "doc_id long, quality int, share double")
    # about DICTIONARY bytes of each class
    picked = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", spread(F.col("text"), F.col("share")).alias("text")).collect()
    picked.sort(key=lambda r: (r["doc_id"], r["text"]))
    good, bad = ("".join(r["text"] for r in picked if r["quality"] == q).encode() for q in (1, 0))
    if not good or not bad:
        return Model(b"good", b"bad", 0.0, 0.0)
    held = rows.where("use = 1").select("quality", "text").mapInArrow(_score(Model(good, bad, 1.0, 0.0), ["quality"]), "quality int, difference double, score double").select("quality", "difference").collect()
    if len({r["quality"] for r in held}) < 2:
        return Model(good, bad, 0.0, 0.0)
    return Model(good, bad, *logistic(np.array([r["difference"] for r in held]), np.array([float(r["quality"]) for r in held])))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted, difference. Null texts are empty ones; null ids count
    as empty text in held_out. Every row gives one row; extra columns are ignored; an empty table gives an empty result."""
    held = (crc32_of_id(F.col("doc_id")) % 5 == 0).alias("held_out")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text").mapInArrow(_score(model, ["doc_id", "held_out"]), "doc_id long, held_out boolean, difference double, score double")
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "difference")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score of THRESHOLD or more, with docs' columns."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_measure(batch, model)[1] >= THRESHOLD))

    return docs.mapInArrow(trimmed(run), docs.schema)
