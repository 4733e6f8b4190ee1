"""Hashed maximum-entropy language model with a class-factored softmax, trained by distributed gradient steps.

Every word of the vocabulary has a path of up to DEPTH choices of one in WIDE: the FREQUENT most frequent words (the end
of a text is one) fill whole classes in two choices, all others fall by hash into a tail class, a group and a cell. P(word |
history) is the product of a softmax for each choice, and among the words of one cell the smoothed unigram share. A
softmax adds the node's unigram bias and three rows of hashed feature tables: of the word before, the pair before and (skip)
the word before that, each hashed apart for each node.

Training makes ROUNDS updates, each from the gradient over all training documents. Tasks sum how often each weight was observed
and, at the round's weights, how often it was expected; the sums of all tasks are added, slice by slice, and each weight
moves along its gradient (observed less expected) by the iterative-scaling step RATE * log((observed + PRIOR) / (expected +
PRIOR)). At zero weights expectations follow from the biases, so the first update needs no pass of its own. Sums don't
depend on how documents are dealt to tasks, so neither do scores. Tables have more rows the more tokens there are (`rows_for`).

Word counts come from all training documents. Texts are hashed once and kept in blocks of BLOCK bytes of text: the block's distinct
words and, for each token, its place among these, both packed. A block sends its words and their own counts, cut into buckets
by hash, to be added up; what comes back are bare numbers in the order of the words (how often each occurs in other blocks),
so no table of words is joined or broadcast, and texts aren't shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelane.llm import textbytes as tb
from farelane.llm.common import crc32_of_id, materialize, partitions_for

BLOCK, PIECE, ASKED = 16 << 20, 1 << 17, 1 << 20  # bytes of text a block; tokens handled at once; words a bucket
TURN = 10  # bits by which words are turned for their order, so that cells ascend (see cell_of)
WIDE, HEADS, DEPTH = 32, 16, 3  # of the first choices, HEADS are classes of frequent words, the others tail classes
FREQUENT, CELLS = HEADS * WIDE, (WIDE - HEADS) * WIDE * WIDE
NODE_BITS = (0, 5, 9)  # binary logarithms of the nodes at each depth
ROUNDS, BATCH, RATE, PRIOR, BOUND, SLICES, TASK = 2, 1 << 13, 0.6, 4.0, 20.0, 16, 128 << 20
LEAST_ROWS, MOST_ROWS, TOKENS_A_ROW = 11, 15, 13  # binary logarithms
SMOOTH = 0.1
END, START = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)


def rows_for(tokens: int) -> int:
    """Binary logarithm of a feature table's rows: a row for each 2^TOKENS_A_ROW training tokens, between 2^LEAST_ROWS and 2^MOST_ROWS."""
    return min(max(math.ceil(math.log2(max(tokens, 1))) - TOKENS_A_ROW, LEAST_ROWS), MOST_ROWS)


@dataclass
class Model:
    """Weights and the fixed parts: frequent words sorted by hash, their rank, biases of each choice, and totals of the cells."""

    head: np.ndarray
    rank: np.ndarray
    bias: list[np.ndarray]  # DEPTH arrays (nodes, WIDE)
    cell_tokens: np.ndarray
    cell_types: np.ndarray
    bits: int  # binary logarithm of the rows a feature
    weights: np.ndarray  # (DEPTH, 3 << bits, WIDE)

    def paths(self, words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Choice of each word at each depth (frequent words make no third), and its cell (-1 for frequent words)."""
        at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
        frequent = self.head[at] == words
        rank, cell = self.rank[at], cell_of(words)
        first = np.where(frequent, rank // WIDE, HEADS + cell // (WIDE * WIDE))
        second = np.where(frequent, rank % WIDE, cell // WIDE % WIDE)
        return [first, second, cell % WIDE], np.where(frequent, -1, cell)


def cell_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(40)).astype(np.int64) % CELLS


def sequence(bounds: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all documents of a block with END after each, and where each document begins."""
    n = len(bounds) - 1
    begin = bounds + np.arange(n + 1)
    out = np.empty(len(h) + n, np.uint64)
    ends = begin[1:] - 1
    rest = np.ones(len(out), bool)
    rest[ends] = False
    out[rest], out[ends] = h, END
    return out, begin


def features(words: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Hash of each token's three features: word before, pair before, word before that (skip)."""

    def back(k: int) -> np.ndarray:
        out = np.empty_like(words)
        out[k:] = words[:-k]
        for i in range(k):
            at = begin[:-1] + i
            at = at[at < begin[1:]]
            out[at] = START
        return out

    one, two = back(1), back(2)
    with np.errstate(over="ignore"):
        return [one, tb.mix(one * np.uint64(0x9E3779B97F4A7C15) + two), tb.mix(two)]


def _rows(feature: np.ndarray, node: np.ndarray, depth: int, k: int, bits: int) -> np.ndarray:
    """Row of feature k in the table of a depth: hash bits of the feature and node, then the node itself."""
    free = bits - NODE_BITS[depth]
    with np.errstate(over="ignore"):
        h = (feature ^ (node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(64 - free)).astype(np.int64) << NODE_BITS[depth]) + node + (k << bits)


def choices(model: Model, words: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """By batch and depth: depth, tokens, the nodes where they choose, their choices, their rows of the three features."""
    taken, cell = model.paths(words)
    made = features(words, begin)
    for i in range(0, len(words), BATCH):
        at = np.arange(i, min(i + BATCH, len(words)))
        node = np.zeros(len(at), np.int64)
        for depth in range(DEPTH):
            if depth == 1:
                node = taken[0][at]
            elif depth == 2:  # groups of tail classes alone
                at = at[cell[at] >= 0]
                node = cell[at] // WIDE
            if len(at):
                yield depth, at, node, taken[depth][at], [_rows(f[at], node, depth, k, model.bits) for k, f in enumerate(made)]


def probabilities(model: Model, depth: int, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Softmax over the WIDE choices of each token; weights are bounded, so powers can't overflow."""
    x = np.take(model.bias[depth], node, axis=0)
    for r in rows:
        x += np.take(model.weights[depth], r, axis=0)
    np.exp(x, out=x)
    x *= (1 / (x @ np.ones(WIDE, np.float32)))[:, None]
    return x


class Observed:
    """How often each weight was used by the choice that was made."""

    def __init__(self, model: Model):
        self.model, self.tokens, self.sums, self.held = model, 0, np.zeros(model.weights.size, np.float64), []

    def learn(self, words: np.ndarray, begin: np.ndarray) -> None:
        self.tokens += len(words)
        size = self.model.weights[0].size
        for depth, _, _, choice, rows in choices(self.model, words, begin):
            self.held += [(depth * size + r * WIDE + choice).astype(np.int32) for r in rows]
        if sum(map(len, self.held)) > len(self.sums):
            self.flush()

    def flush(self) -> np.ndarray:
        if self.held:
            self.sums += np.bincount(np.concatenate(self.held), minlength=len(self.sums))
            self.held = []
        return self.sums


class Expected:
    """How often the model expects each weight to be used, at its weights."""

    def __init__(self, model: Model):
        self.model, self.tokens, self.sums = model, 0, np.zeros(model.weights.shape, np.float64)

    def learn(self, words: np.ndarray, begin: np.ndarray) -> None:
        self.tokens += len(words)
        for depth, _, node, _, rows in choices(self.model, words, begin):
            p, sums = probabilities(self.model, depth, node, rows).astype(np.float64).ravel(), self.sums[depth].reshape(-1)
            for row in rows:
                np.add.at(sums, (row[:, None] * WIDE + np.arange(WIDE)).ravel(), p)

    def flush(self) -> np.ndarray:
        return self.sums.ravel()


def expected_untrained(model: Model, observed: np.ndarray) -> np.ndarray:
    """What Expected sums at zero weights: a row's node gives its uses the same odds each time."""
    out = np.empty_like(observed)
    for depth, part in enumerate(observed):
        node = np.arange(part.shape[0]) & ((1 << NODE_BITS[depth]) - 1)
        out[depth] = part.sum(axis=1, keepdims=True) * np.exp(np.take(model.bias[depth], node, axis=0, mode="clip"))
    return out


def stepped(model: Model, observed: np.ndarray, expected: np.ndarray) -> Model:
    move = RATE * np.log((observed + PRIOR) / (expected + PRIOR))
    return replace(model, weights=np.clip(model.weights + move, -BOUND, BOUND).astype(np.float32))


def log_likelihood(model: Model, words: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """log10 P of each token; count holds the training count of each."""
    p = np.ones(len(words))
    for depth, at, node, choice, rows in choices(model, words, begin):
        p[at] *= probabilities(model, depth, node, rows)[np.arange(len(at)), choice]
    cell = model.paths(words)[1]
    tail = cell >= 0
    cell = cell[tail]
    p[tail] *= (count[tail] + SMOOTH) / (model.cell_tokens[cell] + SMOOTH * (model.cell_types[cell] + 1))
    return np.log10(np.maximum(p, 1e-300))


def untrained(frequent: np.ndarray, number: np.ndarray, cell_tokens: np.ndarray, cell_types: np.ndarray, tokens: int) -> Model:
    """Zero weights and unigram biases; frequent words by rank with their counts, tokens and types of each cell."""
    order = np.argsort(frequent)
    heads = np.zeros(FREQUENT)
    heads[: len(number)] = number
    mass = (cell_tokens + SMOOTH * (cell_types + 1)).reshape(WIDE - HEADS, WIDE, WIDE)
    second = np.concatenate([heads.reshape(HEADS, WIDE) + 1e-3, mass.sum(axis=2)])
    bias = [second.sum(axis=1)[None], second, mass.reshape(-1, WIDE)]
    bits = rows_for(tokens)
    return Model(
        frequent[order], np.arange(len(frequent))[order], [np.log(b / b.sum(axis=1, keepdims=True)).astype(np.float32) for b in bias],
        cell_tokens, cell_types, bits, np.zeros((DEPTH, 3 << bits, WIDE), np.float32),
    )


# ---- Spark -----------------------------------------------------------------------------------------------------
def _turned(words: np.ndarray, bits: int = TURN) -> np.ndarray:
    return (words << np.uint64(bits)) | (words >> np.uint64(64 - bits))


def _packed(x: np.ndarray) -> bytes:
    """Integers of 0 or more as compressed byte planes, with their number and how many planes there are ahead."""
    x = np.ascontiguousarray(x).astype("<u8")
    wide = max((int(x.max(initial=0)).bit_length() + 7) // 8, 1)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :wide].T)
    return np.array([len(x), wide], "<i8").tobytes() + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n, wide = (int(x) for x in np.frombuffer(data, "<i8", 2))
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = pa.Codec("zstd").decompress(memoryview(data)[16:], decompressed_size=n * wide)
        out[:, :wide] = np.frombuffer(planes, np.uint8).reshape(wide, n).T
    return out.view("<u8").ravel()


def _steps(ascending: np.ndarray) -> bytes:
    return _packed(np.diff(ascending, prepend=np.uint64(0)))


BLOCKS = "block long, doc_id array<long>, held_out array<boolean>, size array<long>, words binary, c binary, place binary, n_words long"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: its documents and their tokens' number, its turned words ascending, their count in training documents, the place of each token."""
    part, k, size = TaskContext.get().partitionId(), 0, 0
    docs: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        held_out, sizes, words = (np.concatenate(x) for x in list(zip(*docs, strict=True))[1:])
        made = pa.array(words).dictionary_encode()
        own = _turned(made.dictionary.to_numpy())
        order, place = np.argsort(own), np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        place = place[made.indices.to_numpy()]
        c = np.bincount(place, np.repeat(~held_out, sizes), len(own)).astype(np.int64)
        lists = [pa.ListArray.from_arrays([0, len(sizes)], x) for x in (pa.concat_arrays([d[0] for d in docs]), pa.array(held_out, pa.bool_()), pa.array(sizes, pa.int64()))]
        data = [pa.array([x], pa.binary()) for x in (_steps(own[order]), _packed(c), _packed(place))]
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << 24) + k], pa.int64()), *lists, *data, pa.array([len(own)], pa.int64())],
            ["block", "doc_id", "held_out", "size", "words", "c", "place", "n_words"],
        )

    for batch in batches:
        raw, off = tb.column_bytes(batch.column("text"))
        held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for i, j, bounds, h in tb.word_hashes(raw, off):
            words, begin = sequence(bounds, h)
            docs.append((batch.column("doc_id").slice(i, j - i), held[i:j], np.diff(begin), words))
            size += int(off[j] - off[i]) + 16 * (j - i)
            if size >= BLOCK:
                yield out()
                docs, k, size = [], k + 1, 0
    if docs:
        yield out()


def _asked(buckets: int):
    """A row for each block and bucket with words: the words ascending, and their counts in the block."""
    edges = np.array([-(-(b << 30) // buckets) << 34 for b in range(1, buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, c in zip(*(batch.column(x) for x in ("block", "words", "c")), strict=True):
                words, c = np.cumsum(_unpacked(words.as_py()), dtype=np.uint64), _unpacked(c.as_py())
                cut = [0, *np.searchsorted(words, edges).tolist(), len(words)]
                some = [b for b in range(buckets) if cut[b] < cut[b + 1]]
                data = [pa.array([f(x[cut[b] : cut[b + 1]]) for b in some], pa.binary()) for f, x in ((_steps, words), (_packed, c))]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([block.as_py()] * len(some), pa.int64()), *data], ["bucket", "block", "words", "c"])

    return run


def _counted(asked: pa.Table) -> pa.Table:
    """One bucket: for each block, how often each word it asked for occurs in training documents of other blocks; and, without a block, the bucket's summary."""
    words = [np.cumsum(_unpacked(x.as_py()), dtype=np.uint64) for x in asked.column("words")]
    c = np.concatenate([_unpacked(x.as_py()) for x in asked.column("c")]).astype(np.int64)
    own, inverse = np.unique(np.concatenate(words), return_inverse=True)
    n = np.bincount(inverse, c, len(own)).astype(np.int64)
    rest = np.split(n[inverse] - c, np.cumsum([len(x) for x in words])[:-1])
    data = [*(_packed(x) for x in rest), _summary(_turned(own[n > 0], 64 - TURN), n[n > 0])]
    block = asked.column("block").to_pylist()
    return pa.table({"bucket": pa.array([asked.column("bucket")[0].as_py()] * len(data), pa.int32()), "block": pa.array([*block, None], pa.int64()), "data": pa.array(data, pa.binary())})


def _most(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where the FREQUENT - 1 most frequent words but END are, and END; equal counts by the signed hash."""
    at = np.flatnonzero(words != END)
    if len(at) >= FREQUENT:
        at = at[n[at] >= np.partition(n[at], -(FREQUENT - 1))[-(FREQUENT - 1)]]
    at = at[np.lexsort((words[at].view(np.int64), -n[at]))][: FREQUENT - 1]
    return np.concatenate([np.flatnonzero(words == END), at])


def _summary(words: np.ndarray, n: np.ndarray) -> bytes:
    """Most frequent words and their counts; then cells with their tokens and types."""
    most, cell = _most(words, n), cell_of(words)
    cells, of = np.unique(cell, return_inverse=True)
    tokens, types = np.bincount(of, n, len(cells)).astype(np.int64), np.bincount(of, minlength=len(cells))
    return np.concatenate([[len(most)], words[most].view(np.int64), n[most], cells, tokens, types]).astype(np.int64).tobytes()


def _blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block: ids, held_out and number of tokens of its documents, its words, the place of each token."""
    for i in range(batch.num_rows):
        doc_id, held_out, size = (batch.column(x)[i].values for x in ("doc_id", "held_out", "size"))
        words = np.cumsum(_unpacked(batch.column("words")[i].as_py()), dtype=np.uint64)
        place = _unpacked(batch.column("place")[i].as_py()).astype(np.int64)
        yield doc_id, held_out.to_numpy(zero_copy_only=False).astype(bool), size.to_numpy(), _turned(words, 64 - TURN), place


def _pieces(size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Documents i..j-1 with about PIECE tokens or one alone, and where each begins and the last ends."""
    begin, i = np.concatenate([[0], np.cumsum(size)]), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + PIECE, "right")) - 1)
        yield i, j, begin[i : j + 1]
        i = j


def _sums(kind: type, model: Model):
    """Sums of a task's documents in SLICES parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kind(model)
        for batch in batches:
            for _, held_out, size, words, place in _blocks_of(batch):
                place, size = place[np.repeat(~held_out, size)], size[~held_out]
                for _, _, begin in _pieces(size):
                    own.learn(words[place[begin[0] : begin[-1]]], begin - begin[0])
        if own.tokens:
            for k, part in enumerate(np.array_split(own.flush(), SLICES)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], ["slice", "sums"])

    return run


def _added(parts: pd.DataFrame) -> pd.DataFrame:
    """One slice summed over tasks."""
    total = sum(np.frombuffer(data, np.float32).astype(np.float64) for data in parts["sums"])
    return pd.DataFrame({"slice": [int(parts["slice"].iloc[0])], "sums": [total.astype(np.float32).tobytes()]})


def _gathered(texts: DataFrame, kind: type, model: Model) -> np.ndarray:
    schema = "slice int, sums binary"
    # tasks' sums meet in two steps, so no task gathers those of all others
    parts = texts.mapInArrow(_sums(kind, model), schema).withColumn("near", F.spark_partition_id() % 64)
    parts = parts.groupBy("slice", "near").applyInPandas(_added, schema)
    got = sorted(parts.groupBy("slice").applyInPandas(_added, schema).collect(), key=lambda x: x["slice"])
    if not got:
        return np.zeros(model.weights.shape)
    return np.concatenate([np.frombuffer(x["sums"], np.float32) for x in got]).astype(np.float64).reshape(model.weights.shape)


def _trained(blocks: DataFrame, model: Model, tokens: int) -> Model:
    texts = blocks.select("doc_id", "held_out", "size", "words", "place").coalesce(partitions_for(blocks.sparkSession, 7.0 * tokens, TASK))
    observed = _gathered(texts, Observed, model)
    expected = expected_untrained(model, observed)
    for r in range(ROUNDS):
        model = stepped(model, observed, _gathered(texts, Expected, model) if r else expected)
    return model


def _initial(summaries: list[bytes]) -> tuple[Model, int, int]:
    """Untrained model with unigram biases; N and V."""
    most, cells = [np.zeros((2, 0), np.int64)], [np.zeros((3, 0), np.int64)]
    for x in summaries:
        x = np.frombuffer(x, np.int64)
        most.append(x[1 : 1 + 2 * x[0]].reshape(2, -1))
        cells.append(x[1 + 2 * x[0] :].reshape(3, -1))
    (words, number), (cell, n, v) = np.concatenate(most, axis=1), np.concatenate(cells, axis=1)
    tokens, types = (np.bincount(cell, x, CELLS) for x in (n, v))
    words = words.view(np.uint64)
    at = _most(words, number)
    words, number = words[at], number[at]
    np.subtract.at(tokens, cell_of(words), number)
    np.subtract.at(types, cell_of(words), 1)
    if END not in words:
        words, number = np.concatenate([[END], words]), np.concatenate([[0], number])
    return untrained(words, number.astype(float), tokens, types, int(n.sum())), int(n.sum()), int(v.sum())


def _score(model: Model, n: int, v: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        data = answers.sort_by("bucket").column("data")
        rest = np.concatenate([_unpacked(x.as_py()) for x in data]).astype(np.int64)
        batch = blocks.combine_chunks().to_batches()[0]  # a block is one row
        count = _unpacked(batch.column("c")[0].as_py()).astype(np.int64) + rest
        (doc_id, held_out, sizes, words, place) = next(_blocks_of(batch))
        out: list[list] = [[], [], []]
        for _, _, begin in _pieces(sizes):
            at, begin = place[begin[0] : begin[-1]], begin - begin[0]
            own = count[at]
            base = np.log10((own + SMOOTH) / (n + SMOOTH * (v + 1)))
            for k, x in enumerate(((own > 0).astype(np.int64), base, log_likelihood(model, words[at], begin, own))):
                out[k].append(np.add.reduceat(x, begin[:-1]))
        found, base, score = (np.concatenate(x) for x in out)
        return pa.table({"doc_id": doc_id, "held_out": pa.array(held_out), "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(found, pa.int64()), "train_tokens": pa.array(np.full(len(sizes), n), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})

    return run


def _counts(blocks: DataFrame) -> DataFrame:
    """Answers to each block and summaries by bucket (see _counted)."""
    asked = int(blocks.agg(F.sum("n_words")).first()[0] or 0)
    buckets = max(4 * int(blocks.sparkSession.sparkContext.defaultParallelism), math.ceil(asked / ASKED))
    parts = blocks.select("block", "words", "c").mapInArrow(_asked(buckets), "bucket int, block long, words binary, c binary")
    return materialize(parts.groupBy("bucket").applyInArrow(_counted, "bucket int, block long, data binary"), "lm-counts")


def score_documents(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id as text) mod 10 is not 0. Null texts are empty: one token, the end. Repeated rows count
    and are scored each; null ids count as empty text in held_out; extra columns are ignored; an empty table
    gives an empty result.
    """
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc32_of_id(F.col("doc_id")) % 10 == 0).alias("held_out"))
    blocks = materialize(rows.mapInArrow(_encoded, BLOCKS), "lm-blocks")
    counts = _counts(blocks)
    model, n, v = _initial([r["data"] for r in counts.where("block is null").select("data").collect()])
    model = _trained(blocks, model, n)
    answers = counts.where("block is not null")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(model, n, v), schema)
