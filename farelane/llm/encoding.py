"""Token ids of whole texts by a tokenizers file, many documents at a time; equal to encoding each text at once.

A byte-level tokenizer first splits a text by a fixed pattern and encodes each part by itself. Some of its borders can be
told from two neighbouring characters: before white space that follows something else, after a lone line end, and between
an ASCII letter or digit and an ASCII sign. Texts are cut there; a piece is hashed, and each different piece is encoded by
the library once and remembered: sorted hashes beside a pool of ids, so a batch of texts is looked up as arrays. Texts with
other white space than ASCII or with a special token are encoded whole, as are all texts of tokenizers of another kind.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from farelane.llm import textbytes as tb

BLOCK, CACHE, JOINED = 2 << 20, 1_500_000, 2000

_SPACE, _ALNUM, _SIGN, _ODD = (np.zeros(256, bool) for _ in range(4))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_SIGN[33:127] = ~_ALNUM[33:127]
_ODD[[28, 29, 30, 31]] = True
#: White space beyond ASCII, as UTF-8.
WIDE_SPACES = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


@dataclass
class Known:
    """Remembered pieces: sorted hashes with where their ids lie in a pool."""

    hashes: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def empty(cls) -> Known:
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Position of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, -1)

    def add(self, hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        at = np.searchsorted(self.hashes, hashes)  # both sorted
        self.hashes, self.start, self.size = (np.insert(x, at, y) for x, y in ((self.hashes, hashes), (self.start, start), (self.size, size)))


class Pool:
    """Ids of remembered pieces, in one growing array."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1 << 16, kind), 0

    def put(self, ids: np.ndarray) -> int:
        """Append ids; where they begin."""
        if self.n + len(ids) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data), len(ids)), self.data.dtype)])
        self.data[self.n : self.n + len(ids)] = ids
        self.n += len(ids)
        return self.n - len(ids)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of all elements of the spans (start, size), one span after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Encoder:
    """Keeps at most 2 * CACHE pieces, in two generations: what the older one gives moves to the younger."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        kind = repr(self.own.pre_tokenizer)
        self.cuts = kind.startswith("ByteLevel(") and "add_prefix_space=False" in kind and "use_regex=True" in kind and self.own.normalizer is None
        self.special = [t.content.encode() for t in self.own.get_added_tokens_decoder().values()]
        vocabulary = self.own.get_vocab()
        self.width = np.uint16 if max(vocabulary.values(), default=0) < 65536 else np.uint32
        self.length = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # bytes: a byte-level token has a sign for each
        for token, i in vocabulary.items():
            self.length[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.known, self.older = (Known.empty(), Pool(self.width)), (Known.empty(), Pool(self.width))

    def starts(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, and which documents are one piece that isn't cut."""
        n = len(off) - 1
        whole = np.zeros(n, bool)
        data = raw.tobytes()
        if not self.cuts:
            whole[:] = True
        else:
            there = np.bincount(raw, minlength=256)
            for what in (*WIDE_SPACES, *self.special):
                at = data.find(what) if there[what[0]] and there[what[-1]] else -1
                while at >= 0:
                    d = int(np.searchsorted(off, at, "right")) - 1
                    whole[d] = True
                    at = data.find(what, max(at + 1, int(off[d + 1]) - len(what) + 1))
            whole[np.searchsorted(off, np.flatnonzero(_ODD[raw]), "right") - 1] = True
        space, before = _SPACE[raw], np.zeros(len(raw), bool)
        cut = np.zeros(len(raw), bool)
        before[1:] = space[:-1]
        cut[1:] = space[1:] & ~space[:-1]  # white space after something else
        cut[1:] |= _SIGN[raw[1:]] & _ALNUM[raw[:-1]]
        line = (raw == 10) & ~before
        line[:-1] &= ~space[1:]
        first = off[:-1][off[1:] > off[:-1]]
        line[first] = (raw[first] == 10) & ~space[np.minimum(first + 1, len(raw) - 1)]
        cut[1:] |= line[:-1]  # something after a lone line end
        for d in np.flatnonzero(whole):
            cut[off[d] : off[d + 1]] = False
        cut[first] = True
        return np.flatnonzero(cut), whole

    def fresh(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces, where each piece's begin among them, and how many it has."""
        # a space and a word: many are encoded as one text and told apart by the bytes of their tokens
        plain = (raw[start] == 32) & (size > 1)
        plain[plain] = ~_SPACE[raw[start[plain] + 1]]
        at, alone = np.flatnonzero(plain), np.flatnonzero(~plain)
        begin, count, out, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), [], 0
        ends = np.cumsum(size[at])
        groups = [0, *np.unique(np.searchsorted(ends, np.arange(JOINED, int(ends[-1]), JOINED))), len(at)] if len(at) else [0]
        groups = [(a, z) for a, z in zip(groups[:-1], groups[1:], strict=True) if z > a]
        flat = raw[ragged(start[at], size[at])].tobytes()
        edge = np.concatenate([[0], ends])
        texts = [flat[edge[a] : edge[z]].decode() for a, z in groups]
        for (a, z), e in zip(groups, self.own.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.width)
            reach, want = np.cumsum(self.length[ids]), edge[a + 1 : z + 1] - edge[a]
            stop = np.searchsorted(reach, want) + 1
            if len(ids) and stop[-1] == len(ids) and (reach[stop - 1] == want).all():
                count[at[a:z]] = np.diff(stop, prepend=0)
                begin[at[a:z]] = n + stop - count[at[a:z]]
                out.append(ids)
                n += len(ids)
            else:
                alone = np.concatenate([alone, at[a:z]])
        texts = [raw[start[k] : start[k] + size[k]].tobytes().decode() for k in alone]
        for k, e in zip(alone, self.own.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.width)
            begin[k], count[k] = n, len(ids)
            out.append(ids)
            n += len(ids)
        return np.concatenate(out) if out else np.zeros(0, self.width), begin, count

    def _block(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, whole = self.starts(raw, off) if len(raw) else (np.zeros(0, np.int64), np.zeros(len(off) - 1, bool))
        size = np.diff(start, append=len(raw))
        doc = np.searchsorted(off, start, "right") - 1
        place, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        single = whole[doc]
        cut = np.flatnonzero(~single)
        if len(cut):
            known, pool = self.known
            older, old_pool = self.older
            if len(known.hashes) > CACHE:
                self.older = older, old_pool = known, pool
                self.known = known, pool = Known.empty(), Pool(self.width)
            h = tb.span_hashes(raw, start[cut], size[cut])
            own, one, inverse = np.unique(h, return_index=True, return_inverse=True)
            at = known.find(own)
            if (new := np.flatnonzero(at < 0)).size:
                there = older.find(own[new])
                again, made = new[there >= 0], new[there < 0]
                n, old_n, old_start = np.zeros(len(own), np.int64), older.size[there[there >= 0]], older.start[there[there >= 0]]
                again_ids = old_pool.data[ragged(old_start, old_n)]
                made_ids, made_at, made_n = self.fresh(raw, start[cut][one[made]], size[cut][one[made]])
                n[again], n[made] = old_n, made_n
                begin = np.zeros(len(own), np.int64)
                begin[again] = pool.put(again_ids) + np.cumsum(old_n) - old_n
                begin[made] = pool.put(made_ids) + made_at
                known.add(own[new], begin[new], n[new])
                at = known.find(own)
            place[cut], count[cut] = known.start[at][inverse], known.size[at][inverse]
        data = self.known[1].data
        if single.any():
            k = np.flatnonzero(single)
            texts = [raw[start[i] : start[i] + size[i]].tobytes().decode() for i in k]
            ids = [np.array(e.ids, self.width) for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]
            count[k] = [len(x) for x in ids]
            place[k] = len(data) + np.cumsum(count[k]) - count[k]
            data = np.concatenate([data, *ids])
        ends = np.concatenate([[0], np.cumsum(count)])
        bounds = ends[np.searchsorted(start, off)]
        return data[ragged(place, count)], bounds

    def encode(self, texts: pa.Array):
        """Yield (i, j, ids, bounds): texts i..j-1 have the ids ids[bounds[k]:bounds[k+1]]; nulls are empty."""
        raw, off = tb.column_bytes(texts)
        i = 0
        while i < len(off) - 1:
            j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1)
            yield i, j, *self._block(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            i = j


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
