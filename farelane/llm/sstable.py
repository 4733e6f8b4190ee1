"""Token ids in sorted-string-table shards, written from a tokenizer's output and read back by key.

A shard is one file:

    block*  sparse index  Bloom filter  footer

- block: zstandard frame of entries (varint shared key bytes, varint own key bytes, varint value bytes, key rest, value), keys
  ascending; the first entry of a block has its whole key. The key is 0x00 for a null id or 0x01 and the id as a big-endian
  unsigned 64-bit number with the sign bit flipped, then an 8-byte text mark and a 4-byte count that tell
  repeated ids apart. The value is the token ids, 2 bytes each if all fit, else 4, after one byte that says which.
- sparse index: for each block varint key bytes, its first key, varint offset, varint length.
- Bloom filter: 4 bytes hash count, then bits over the 9-byte ids.
- footer: eight little-endian 64-bit numbers: index offset and length, filter offset and length, entries, tokens,
  version, and 0x53535446.

Shards hold disjoint, ascending id ranges, so a lookup takes the shard by range, then filter, index and one block.
"""

from __future__ import annotations

import bisect
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farelane.llm.common import materialize, shared_dir
from farelane.llm.encoding import encoder

SHARD_BYTES, BLOCK_BYTES = 16 << 20, 64 << 10
MAGIC, VERSION = 0x53535446, 1
FOOTER = struct.Struct("<8Q")
GROUP = 1024


# ---- the file format -------------------------------------------------------------------------------------------
def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def id_key(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + ((doc_id & 0xFFFFFFFFFFFFFFFF) ^ (1 << 63)).to_bytes(8, "big")


def key_id(key: bytes) -> int | None:
    if key[0] == 0:
        return None
    n = int.from_bytes(key[1:9], "big") ^ (1 << 63)
    return n - (1 << 64) if n >> 63 else n


def _spots(key: bytes, hashes: int, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Entries must come in ascending key order."""

    def __init__(self, out, block_bytes: int = BLOCK_BYTES):
        self.out, self.block_bytes, self.at, self.tokens = out, block_bytes, 0, 0
        self.press = zstandard.ZstdCompressor(level=1)
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index, self.ids, self.entries = bytearray(), [], 0

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.block:
            at, n = self._put(self.press.compress(bytes(self.block)))
            self.index += varint(len(self.first)) + self.first + varint(at) + varint(n)
            self.block.clear()

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.block:
            self.first, shared = key, 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
        value = bytes([wide]) + ids.astype("<u4" if wide else "<u2").tobytes()
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.entries, self.tokens = key, self.entries + 1, self.tokens + len(ids)
        if not self.ids or self.ids[-1] != key[:9]:
            self.ids.append(key[:9])
        if len(self.block) >= self.block_bytes:
            self._flush()

    def close(self) -> None:
        self._flush()
        index = self._put(bytes(self.index))
        bits, hashes = max(64, 10 * len(self.ids)), 7
        field = np.zeros(-(-bits // 8), np.uint8)
        for key in self.ids:
            for s in _spots(key, hashes, len(field) * 8):
                field[s >> 3] |= 1 << (s & 7)
        bloom = self._put(struct.pack("<I", hashes) + field.tobytes())
        self._put(FOOTER.pack(*index, *bloom, self.entries, self.tokens, VERSION, MAGIC))


class Reader:
    """One shard, opened from a seekable binary file: footer, filter and index are read at once, blocks on demand."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        source.seek(source.tell() - FOOTER.size)
        at, n, bloom_at, bloom_n, self.entries, self.tokens, version, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of this format")
        bloom = self._read(bloom_at, bloom_n)
        self.hashes, self.field = struct.unpack_from("<I", bloom)[0], bloom[4:]
        index, i = self._read(at, n), 0
        self.first: list[bytes] = []
        self.where: list[tuple[int, int]] = []
        while i < n:
            size, i = read_varint(index, i)
            self.first.append(index[i : i + size])
            at, i = read_varint(index, i + size)
            length, i = read_varint(index, i)
            self.where.append((at, length))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, i, key = zstandard.ZstdDecompressor().decompress(self._read(*self.where[k])), 0, b""
        while i < len(data):
            shared, i = read_varint(data, i)
            own, i = read_varint(data, i)
            size, i = read_varint(data, i)
            key = key[:shared] + data[i : i + own]
            i += own
            yield key, np.frombuffer(data[i + 1 : i + size], "<u4" if data[i] else "<u2")
            i += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.where)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Token ids of every entry of one id: filter, binary search of the index, then its blocks."""
        want = id_key(doc_id)
        if not all(self.field[s >> 3] >> (s & 7) & 1 for s in _spots(want, self.hashes, len(self.field) * 8)):
            return []
        out, k = [], max(0, bisect.bisect_left(self.first, want) - 1)
        while k < len(self.where) and self.first[k][:9] <= want:
            out += [v for key, v in self.block(k) if key[:9] == want]
            k += 1
        return out


# ---- Spark -----------------------------------------------------------------------------------------------------
def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, place, path, out, last, again, first = None, None, "", None, None, 0, None
        enc = encoder(tokenizer)
        shard = -1
        for batch in batches:
            ids, marks, shards = batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), batch.column("shard")
            for i, j, tokens, bounds in enc.encode(batch.column("text")):
                # the end id after each text
                tokens = np.insert(tokens, bounds[1:], np.array(end_id, tokens.dtype))
                bounds = bounds + np.arange(len(bounds))
                for q in range(i, j):
                    if writer is None:
                        place, root = pafs.FileSystem.from_uri(folder)
                        shard = shards[0].as_py()
                        path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"  # a repeated task writes a file of its own
                        out = place.open_output_stream(path)
                        writer, first = Writer(out), ids[q]
                    key = id_key(ids[q]) + ((marks[q] & 0xFFFFFFFFFFFFFFFF) ^ (1 << 63)).to_bytes(8, "big")
                    again = again + 1 if key == last else 0
                    last = key
                    writer.add(key + again.to_bytes(4, "big"), tokens[bounds[q - i] : bounds[q - i + 1]])
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": path.rpartition("/")[2], "first_id": first, "entries": writer.entries, "tokens": writer.tokens}], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("first_id", pa.int64()), ("entries", pa.int64()), ("tokens", pa.int64())]))

    return run


def _scan(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place, root = pafs.FileSystem.from_uri(folder)
                start, ids, starts, sizes, sums = row["start"], [], [], [], []
                with place.open_input_file(f"{root}/{row['file']}") as source:
                    for key, tokens in Reader(source):
                        ids.append(key_id(key))
                        starts.append(start)
                        sizes.append(len(tokens))
                        sums.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                        start += len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, sizes, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def local_uri(folder: str) -> str:
    return folder if re.match(r"\w+:/", folder) else f"file://{folder}"


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Tokenise docs (doc_id, text) into shards in `folder`, a URI of a store that all executors write to.

    Gives the manifest, one row for each shard: shard, file, first_id, entries, tokens, start. Rows go in order of id
    (nulls first), then of the text's hash. Shards are cut by UTF-8 bytes from a histogram of ids, so they are about
    SHARD_BYTES of text; a shard is one task's work and a lost task writes its shard anew under another name. Null
    texts are empty and hold only the end id; an empty table gives no shard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    total = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    n = max(1, math.ceil(((total["bytes"] or 0) + 16 * total["n"]) / SHARD_BYTES), min(2 * spark.sparkContext.defaultParallelism, math.ceil((total["bytes"] or 0) / (1 << 20))))
    # Spark's own range partitioning: it samples (id, text hash), so ties of an id can be cut too
    ranged = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.col("mark"))
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("mark")).withColumn("shard", F.spark_partition_id())
    done = materialize(ranged.mapInArrow(_write(folder, tokenizer, end_id), "shard int, file string, first_id long, entries long, tokens long"), "manifest")
    return _offsets(done)


def _offsets(shards: DataFrame) -> DataFrame:
    """shards with `start`, the tokens of all shards before: sums within groups of GROUP shards, then over the groups."""
    grouped = shards.withColumn("group", F.floor(F.col("shard") / GROUP))
    sums = grouped.groupBy("group").agg(F.sum("tokens").alias("all"))
    before = sums.select(F.col("group").alias("of"), (F.sum("all").over(W.orderBy("group").rowsBetween(W.unboundedPreceding, 0)) - F.col("all")).alias("before"))
    within = F.sum("tokens").over(W.partitionBy("group").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens")
    out = grouped.withColumn("within", within).join(before, F.col("group") == F.col("of"))
    return out.select("shard", "file", "first_id", "entries", "tokens", (F.col("before") + F.col("within")).alias("start"))


def read_shards(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    files = manifest.repartitionByRange(max(1, manifest.count()), "shard")  # one shard a task
    return files.mapInArrow(_scan(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write docs as shards (into a new shared folder unless one is given) and return what the files hold."""
    spark = docs.sparkSession
    if folder is None:
        folder = f"{local_uri(shared_dir(spark)).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    place, root = pafs.FileSystem.from_uri(folder)
    place.create_dir(root)
    return read_shards(spark, write_shards(docs, tokenizer, folder), folder)
