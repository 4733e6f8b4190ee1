"""Progressive JPEG as a column codec: scans gather into coefficient arrays, these become full-resolution RGB tensors.

Decoding handles Huffman-coded progressive files (SOF2): DC and AC first scans and refinements, spectral selection,
successive approximation, end-of-band runs, restart intervals, any sampling factors, one or three components. The inverse
transform, chroma upsampling (by repetition) and colour conversion are numpy over all blocks at once.

The encoder stores a payload losslessly: each byte b is the quantised coefficient b + 256 of a 4:2:0 image, in four kinds
of scan: DC at one bit less, then its last bit; AC at one bit less (luma in the bands 1-5 and 6-63), then its last bit. Coefficients b + 256 shifted by one bit always have size category 8, so a first AC scan of such a file is
rows of equal length; the decoder sees that in the bits themselves and reads such scans, and refinements whose
coefficients are all known, as arrays. Every other scan is read code by code.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelane.llm import textbytes as tb

UNIT = 576
MCU_BYTES = 6 * 64
MOST_ACROSS = 64
MOST_DOWN = 4095  # a height has 16 bits
EOB_MOST = 0x7FFF


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag position, by walking the diagonals."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[1] if (x[0] + x[1]) % 2 else -x[1]))
    flip = [(c, r) for r, c in order]
    return np.array([r * 8 + c for r, c in flip])


ZIGZAG = _zigzag()
_DCT = np.array([[(np.sqrt(0.125) if k == 0 else 0.5) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)], np.float32)
#: Rows: the 64 pixels of each coefficient alone, in zigzag order.
_INVERSE = np.einsum("ky,lx->klyx", _DCT, _DCT).reshape(64, 64)[ZIGZAG]


# ---- Huffman tables ----------------------------------------------------------------------------------------------
@dataclass
class Codes:
    """A Huffman table as in DHT: counts of codes of each length, then symbols."""

    counts: bytes
    symbols: bytes
    of: dict[int, tuple[int, int]] = field(init=False)
    most: int = field(init=False)
    peek: list[int] = field(init=False)  # for the next `most` bits: length << 8 | symbol, or -1

    def __post_init__(self) -> None:
        code, k, self.of = 0, 0, {}
        self.most = max((i for i, n in enumerate(self.counts, 1) if n), default=1)
        self.peek = [-1] * (1 << self.most)
        for length, n in enumerate(self.counts, 1):
            for _ in range(n):
                self.of[self.symbols[k]] = (length, code)
                room = self.most - length
                self.peek[code << room : (code + 1) << room] = [length << 8 | self.symbols[k]] * (1 << room)
                code, k = code + 1, k + 1
            code <<= 1


def _table(lengths: dict[int, int]) -> Codes:
    """lengths: code length of each symbol."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return Codes(bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)), bytes(symbols))


#: DC categories 0-11 in four bits each; AC: size 8 in one bit, end-of-band runs in five.
DC_CODES, AC_CODES = _table({c: 4 for c in range(12)}), _table({0x08: 1} | {r << 4: 5 for r in range(15)})


# ---- encoding ------------------------------------------------------------------------------------------------------
def _pack(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Bits of each value, most significant first, one after another; filled up with ones."""
    most = int(lengths.max(initial=1))
    bits = ((values[:, None] >> np.arange(most - 1, -1, -1)) & 1).astype(np.uint8)
    return _filled(bits[np.arange(most) >= most - lengths[:, None]])


def _filled(bits: np.ndarray) -> bytes:
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def _stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan_header(components: list[tuple[int, int]], first: int, last: int, high: int, low: int) -> bytes:
    body = bytes([len(components)]) + b"".join(bytes([c, t]) for c, t in components) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, body)


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size category and extra bits of each value."""
    size = np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)
    return size, np.where(v < 0, v + (1 << size) - 1, v)


def grid(n_bytes: int) -> tuple[int, int]:
    """MCUs across and down for a payload: MOST_ACROSS wide, and wider where the height would pass MOST_DOWN."""
    mcus = max(1, -(-n_bytes // MCU_BYTES))
    across = max(min(mcus, MOST_ACROSS), -(-mcus // MOST_DOWN))
    return across, -(-mcus // across)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload's bytes + 256, MCU by MCU: four Y blocks, Cb, Cr."""
    across, down = grid(len(payload))
    mcus = across * down
    data = np.full(mcus * MCU_BYTES, 255, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    block = data.reshape(mcus, 6, 64).astype(np.int32) + 256
    luma = block[:, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)  # by rows of blocks
    planes = [luma, np.ascontiguousarray(block[:, 4]), np.ascontiguousarray(block[:, 5])]
    out = [b"\xff\xd8", _segment(0xDB, b"\0" + bytes([1] * 64))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_segment(0xC4, b"\x00" + DC_CODES.counts + DC_CODES.symbols) + _segment(0xC4, b"\x10" + AC_CODES.counts + AC_CODES.symbols))
    # DC of all components, interleaved by MCU
    dc = block[:, :, 0] >> 1
    diff = np.empty((mcus, 6), np.int64)
    y = dc[:, :4].ravel()
    diff[:, :4] = np.diff(y, prepend=0).reshape(mcus, 4)
    diff[:, 4], diff[:, 5] = np.diff(dc[:, 4], prepend=0), np.diff(dc[:, 5], prepend=0)
    size, extra = _magnitude(diff.ravel())
    out += [_scan_header([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1), _stuffed(_pack((size << size) | extra, 4 + size))]
    out += [_scan_header([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0), _stuffed(_filled((block[:, :, 0].ravel() & 1).astype(np.uint8)))]
    for c, plane in enumerate(planes, 1):
        for first, last in ((1, 5), (6, 63)) if c == 1 else ((1, 63),):
            rows = np.zeros((len(plane) * (last - first + 1), 9), np.uint8)  # code 0, then eight bits, of which the first is always 1
            rows[:, 1:] = np.unpackbits((plane[:, first : last + 1] >> 1).astype(np.uint8).reshape(-1, 1), axis=1)
            out += [_scan_header([(c, 0)], first, last, 0, 1), _stuffed(_filled(rows.ravel()))]
    for c, plane in enumerate(planes, 1):
        low, parts = (plane[:, 1:] & 1).astype(np.uint8), []
        for i in range(0, len(low), EOB_MOST):
            run = min(EOB_MOST, len(low) - i)
            n = run.bit_length() - 1
            length, code = AC_CODES.of[n << 4]
            head = code << n | run - (1 << n)
            parts += [np.array([head >> k & 1 for k in range(length + n - 1, -1, -1)], np.uint8), low[i : i + run].ravel()]
        bits = np.concatenate(parts)
        out += [_scan_header([(c, 0)], 1, 63, 1, 0), _stuffed(_filled(bits))]
    return b"".join([*out, b"\xff\xd9"])


def payload(image: Image, n_bytes: int) -> bytes:
    """The bytes that encode() stored."""
    y, cb, cr = (c.blocks[: c.high, : c.wide] for c in image.components)
    down, across = cb.shape[:2]
    out = np.empty((down * across, 6, 64), np.int32)
    out[:, :4] = y.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    out[:, 4], out[:, 5] = cb.reshape(-1, 64), cr.reshape(-1, 64)
    return (out.reshape(-1)[:n_bytes] - 256).astype(np.uint8).tobytes()


# ---- decoding ------------------------------------------------------------------------------------------------------
@dataclass
class Component:
    ident: int
    across: int
    down: int
    quant: int
    wide: int = 0  # blocks that hold image
    high: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))  # padded to whole MCUs; zigzag order


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]


class Bits:
    """The entropy-coded bytes of one restart interval, read bit by bit."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self) -> None:
        more = self.data[self.at : self.at + 6]
        self.held = (self.held & ((1 << self.n) - 1)) << 48 | int.from_bytes(more, "big") << 8 * (6 - len(more))
        if len(more) < 6:  # ones follow the data
            self.held |= (1 << 8 * (6 - len(more))) - 1
        self.at, self.n = self.at + 6, self.n + 48

    def take(self, n: int) -> int:
        if self.n < n:
            self.fill()
        self.n -= n
        return self.held >> self.n & ((1 << n) - 1)

    def symbol(self, codes: Codes) -> int:
        if self.n < codes.most:
            self.fill()
        found = codes.peek[self.held >> (self.n - codes.most) & ((1 << codes.most) - 1)]
        if found < 0:
            raise ValueError("no such Huffman code")
        self.n -= found >> 8
        return found & 255

    def extended(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


@dataclass
class Order:
    """Blocks of a DC scan in coding order: component index, row and column of each; `unit` blocks make an MCU."""

    scan: list[Component]
    of: np.ndarray
    row: np.ndarray
    col: np.ndarray
    unit: int

    @classmethod
    def of_scan(cls, scan: list[Component]) -> Order:
        if len(scan) == 1:
            row, col = np.divmod(np.arange(scan[0].high * scan[0].wide), max(1, scan[0].wide))
            return cls(scan, np.zeros(len(row), np.int64), row, col, 1)
        one = [(k, y, x) for k, c in enumerate(scan) for y in range(c.down) for x in range(c.across)]
        k, y, x = (np.array(v) for v in zip(*one, strict=True))
        rows, cols = scan[0].blocks.shape[0] // scan[0].down, scan[0].blocks.shape[1] // scan[0].across
        my, mx = np.divmod(np.arange(rows * cols), cols)
        down, across = np.array([c.down for c in scan])[k], np.array([c.across for c in scan])[k]
        return cls(scan, np.tile(k, rows * cols), (my[:, None] * down + y).ravel(), (mx[:, None] * across + x).ravel(), len(one))

    def intervals(self, restart: int) -> list[tuple[int, int]]:
        n, step = len(self.of), restart * self.unit or len(self.of)
        return [(i, min(i + step, n)) for i in range(0, n, max(1, step))]


def _first_dc(parts: list[bytes], order: Order, tables: list[Codes], low: int, restart: int) -> None:
    codes = [tables[k] for k in order.of[: order.unit]]
    for part, (a, z) in zip(parts, order.intervals(restart), strict=False):
        bits = Bits(part)
        symbol, extended = bits.symbol, bits.extended
        diff = np.array([extended(symbol(c)) for _ in range((z - a) // order.unit) for c in codes], np.int64)
        for k, c in enumerate(order.scan):
            mine = np.flatnonzero(order.of[a:z] == k)
            c.blocks[order.row[a:z][mine], order.col[a:z][mine], 0] = np.cumsum(diff[mine]) << low


def _refine_dc(parts: list[bytes], order: Order, low: int, restart: int) -> None:
    for part, (a, z) in zip(parts, order.intervals(restart), strict=False):
        bit = np.unpackbits(np.frombuffer(part, np.uint8), count=z - a).astype(np.int32) << low
        for k, c in enumerate(order.scan):
            mine = np.flatnonzero(order.of[a:z] == k)
            c.blocks[order.row[a:z][mine], order.col[a:z][mine], 0] |= bit[mine]


def _chunks(xs, n: int) -> list:
    return [xs[i : i + n] for i in range(0, len(xs), n)] if n else [xs]


def _equal_rows(part: bytes, n: int, codes: Codes) -> np.ndarray | None:
    """Coefficients of a first AC scan in which each has the same code, of no zeros and one size; None if it is another scan."""
    bit = np.unpackbits(np.frombuffer(part, np.uint8))
    for symbol, (length, code) in codes.of.items():
        size = symbol & 15
        if symbol >> 4 or not size or len(bit) < n * (length + size) or len(bit) >= n * (length + size) + 8:
            continue
        rows = bit[: n * (length + size)].reshape(n, length + size)
        want = np.array([code >> k & 1 for k in range(length - 1, -1, -1)], np.uint8)
        if (rows[:, :length] == want).all():
            v = np.packbits(rows[:, length : length + 8], axis=1)[:, 0].astype(np.int32)
            if size < 8:
                v >>= 8 - size
            elif size > 8:
                v = v << (size - 8) | np.packbits(rows[:, length + 8 :], axis=1)[:, 0] >> (16 - size)
            return v if (v >> (size - 1)).all() else np.where(v >> (size - 1), v, v - (1 << size) + 1)
    return None


def _first_ac(part: bytes, blocks: np.ndarray, codes: Codes, first: int, last: int, low: int) -> np.ndarray:
    """blocks: (n, 64); returns the band's coefficients."""
    n, width = len(blocks), last - first + 1
    if (rows := _equal_rows(part, n * width, codes)) is not None:
        return rows.reshape(n, width) << low
    out, bits, run = np.zeros((n, width), np.int32), Bits(part), 0
    for b in range(n):
        if run:
            run -= 1
            continue
        k = 0
        while k < width:
            zeros, size = divmod(bits.symbol(codes), 16)
            if size:
                k += zeros
                out[b, k] = bits.extended(size) << low if size else 0
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) - 1 + (bits.take(zeros) if zeros else 0)
                break
    return out


def _refine_ac(part: bytes, band: np.ndarray, codes: Codes, low: int) -> np.ndarray:
    n, width = band.shape
    out, step = band.copy(), 1 << low
    if (band != 0).all():  # only end-of-band runs and correction bits: read them as arrays
        bit, at, b = np.unpackbits(np.frombuffer(part, np.uint8)), 0, 0
        while b < n:
            head = Bits(np.packbits(bit[at : at + 40]).tobytes())
            zeros, size = divmod(head.symbol(codes), 16)
            if size or zeros == 15:
                break
            run = (1 << zeros) + (head.take(zeros) if zeros else 0)
            at += head.at * 8 - head.n
            own = bit[at : at + run * width].reshape(run, width).astype(np.int32)
            out[b : b + run] += np.where(out[b : b + run] > 0, own, -own) << low
            at, b = at + run * width, b + run
        if b == n:
            return out
        out = band.copy()
    bits, run = Bits(part), 0

    def correct(b: int, k: int) -> None:
        if bits.take(1) and not abs(int(out[b, k])) & step:
            out[b, k] += step if out[b, k] > 0 else -step

    for b in range(n):
        k = 0
        while not run and k < width:
            zeros, size = divmod(bits.symbol(codes), 16)
            fresh = 0
            if size:
                fresh = step if bits.take(1) else -step
            elif zeros < 15:
                run = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                break
            while k < width:
                if out[b, k]:
                    correct(b, k)
                elif zeros == 0:
                    if fresh:
                        out[b, k] = fresh
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
        if run:
            while k < width:
                if out[b, k]:
                    correct(b, k)
                k += 1
            run -= 1
    return out


def _entropy(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Restart intervals of the entropy-coded data from `at`, unstuffed, and where the next marker is."""
    parts, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("a scan doesn't end")
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            parts.append(data[start:at].replace(b"\xff\x00", b"\xff"))
            at = start = at + 2
        else:
            parts.append(data[start:at].replace(b"\xff\x00", b"\xff"))
            return parts, at


def decode(data: bytes) -> Image:
    """Coefficients of a progressive JPEG, all its scans accumulated."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, image, restart = 2, None, 0
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, Codes] = {}
    while True:
        marker, at = data[at + 1], at + 2
        if marker == 0xD9:
            break
        if marker == 0xFF:
            at -= 1
            continue
        (size,) = struct.unpack_from(">H", data, at)
        body, at = data[at + 2 : at + size], at + size
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.float32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = Codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            image = Image(width, height, [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)], quant)
            h, v = max(c.across for c in image.components), max(c.down for c in image.components)
            across, down = -(-width // (8 * h)), -(-height // (8 * v))
            for c in image.components:
                c.wide, c.high = -(-(-(-width * c.across // h)) // 8), -(-(-(-height * c.down // v)) // 8)
                c.blocks = np.zeros((down * c.down, across * c.across, 64), np.int32)
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("only progressive files are read")
        elif marker == 0xDA:
            parts, at = _entropy(data, at)
            n = body[0]
            scan = [next(c for c in image.components if c.ident == body[1 + 2 * i]) for i in range(n)]
            dc = [tables.get(body[2 + 2 * i] >> 4) for i in range(n)]
            ac = tables.get(0x10 | body[2] & 15)
            first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            if first == 0:
                order = Order.of_scan(scan)
                if high:
                    _refine_dc(parts, order, low, restart)
                else:
                    _first_dc(parts, order, dc, low, restart)
            else:
                c = scan[0]
                flat = c.blocks[: c.high, : c.wide].reshape(-1, 64)
                done = []
                for part, own in zip(parts, _chunks(flat, restart), strict=False):
                    done.append(_refine_ac(part, own[:, first : last + 1], ac, low) if high else _first_ac(part, own, ac, first, last, low))
                c.blocks[: c.high, : c.wide, first : last + 1] = np.concatenate(done).reshape(c.high, c.wide, -1)
    return image


def rgb(image: Image) -> np.ndarray:
    """height x width x 3 bytes: inverse transform, chroma repeated up to full resolution, colour conversion."""
    h, v = max(c.across for c in image.components), max(c.down for c in image.components)
    planes = []
    for c in image.components:
        rows, cols, _ = c.blocks.shape
        pixel = (c.blocks.reshape(-1, 64).astype(np.float32) @ (_INVERSE * image.quant[c.quant][:, None])).reshape(rows, cols, 8, 8)
        plane = np.clip(pixel + np.float32(128), 0, 255).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        planes.append(plane.repeat(v // c.down, 0).repeat(h // c.across, 1)[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(np.rint(planes[0]).astype(np.uint8)[..., None], 3, axis=2)
    y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
    out = np.empty((image.height, image.width, 3), np.uint8)
    out[..., 0] = np.rint(np.clip(y + np.float32(1.402) * cr, 0, 255))
    out[..., 1] = np.rint(np.clip(y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, 0, 255))
    out[..., 2] = np.rint(np.clip(y + np.float32(1.772) * cb, 0, 255))
    return out


# ---- Spark -----------------------------------------------------------------------------------------------------
def padded(data: bytes) -> bytes:
    """data, then bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def describe(image: Image) -> str:
    """Size, and mean colour and CRC-32 of the RGB tensor."""
    pixels = rgb(image)
    mean = pixels.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (image.width * image.height)
    return f"{image.width}x{image.height};rgb={mean[0]:.3f},{mean[1]:.3f},{mean[2]:.3f};crc={zlib.crc32(pixels.tobytes()):08x}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = tb.column_bytes(batch.column("text"))
        ids, rows = batch.column("doc_id"), []
        for i in range(len(off) - 1):
            text = raw[off[i] : off[i + 1]].tobytes()
            size = len(padded(text))
            media = encode(padded(text))
            image = decode(media)
            back = payload(image, size)
            rows.append((len(text), size, hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(image)))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store_texts(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): digests of the text stored as a progressive JPEG and read back from it.

    Null texts are empty and still fill one unit. Equal texts give equal values; repeated rows give one row each; extra columns are
    ignored; a very long text makes a taller image, and from 4095 MCU rows on a wider one. An empty table gives an empty result.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stored, schema)


def tensors(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds height, width and pixels (RGB bytes, row by row) to rows with a progressive JPEG column; all null where it is null or not
    readable as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for data in batch.column(column).to_pylist():
                try:
                    pixels = None if data is None else rgb(decode(data))
                except (ValueError, IndexError, KeyError, StopIteration, TypeError, AttributeError, struct.error):
                    pixels = None
                out.append((None,) * 3 if pixels is None else (*pixels.shape[:2], pixels.tobytes()))
            h, w, p = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(p, pa.binary())], [*batch.schema.names, "height", "width", "pixels"])

    kept = media.drop("height", "width", "pixels")
    fields = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return kept.mapInArrow(run, f"{fields}, height int, width int, pixels binary")
