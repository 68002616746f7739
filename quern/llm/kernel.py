"""Vectorised words and word hashes of many texts at once.

A word is a maximal run of letters, digits or underscores of the lower-cased
text. All arrays are over the UTF-8 bytes of a chunk of texts that are joined
with newlines; nothing runs by the word in Python.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
P, P_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
Q = 0xD6E8FEB86659FD93

_BYTES = np.zeros(256, bool)
_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
#: Unicode spaces, punctuation and symbols that would otherwise count as parts of words.
_OTHER = re.compile("[\u0080-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u1680\u2000-\u206f\u20a0-\u20cf\u2190-\u2bff\u3000-\u3004\u3008-\u3020\u3030\ufe30-\ufe4f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65\ufff0-\uffff]")

BLOCK = 1 << 20
_pow: dict[int, np.ndarray] = {}


def powers(base: int) -> np.ndarray:
    """base**0 .. base**BLOCK modulo 2**64."""
    if base not in _pow:
        full = np.full(BLOCK + 1, base, U64)
        full[0] = 1
        with np.errstate(over="ignore"):
            _pow[base] = np.multiply.accumulate(full)
    return _pow[base]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = x + U64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


@dataclass
class Words:
    data: bytes  # the lower-cased texts, joined with newlines
    raw: np.ndarray  # the same as bytes
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    bound: np.ndarray  # words of text i: bound[i] to bound[i + 1]
    hash: np.ndarray  # uint64 of each word

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bound) - 1), np.diff(self.bound))


def lowered(t: str | None) -> bytes:
    if not t:
        return b""
    t = t.lower()
    return t.encode() if t.isascii() else _OTHER.sub(" ", t).encode("utf-8", "replace")


def words(texts: Sequence[str | None]) -> Words:
    """Memory besides the bytes themselves is some 40 bytes a word; hashing runs by BLOCK, however long a text is."""
    parts = [lowered(t) for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    data = b"\n".join(parts) + b"\n"
    del parts
    raw = np.frombuffer(data, np.uint8)
    inside = _BYTES[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    del inside
    start, end = edge[0::2], edge[1::2]
    h = np.zeros(len(start), U64)
    up, down = powers(P), powers(P_INV)
    carry = U64(0)
    with np.errstate(over="ignore"):
        # of the sums of (byte + 1) * P**place up to each place, those at the words' ends less those at their starts
        for base in range(0, len(raw), BLOCK):
            block = raw[base : base + BLOCK]
            pre = np.empty(len(block) + 1, U64)
            pre[0] = carry
            np.cumsum((block.astype(U64) + U64(1)) * (up[: len(block)] * U64(pow(P, base, 1 << 64))), out=pre[1:])
            pre[1:] += carry
            carry = pre[-1]
            i, j = np.searchsorted(start, (base, base + len(block)))
            h[i:j] -= pre[start[i:j] - base]
            i, j = np.searchsorted(end, (base, base + len(block)), "right")
            h[i:j] += pre[end[i:j] - base]
        for base in range(0, len(raw), BLOCK):
            i, j = np.searchsorted(start, (base, base + BLOCK))
            h[i:j] *= down[start[i:j] - base] * U64(pow(P_INV, base, 1 << 64))
        h = mix(h + (end - start).astype(U64) * U64(Q))
    return Words(data, raw, start, end, np.searchsorted(start, offsets), h)


def run_hashes(h: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of each place the hash of the length hashes from there on; all lengths lie within the array."""
    out = np.zeros(len(h), U64)
    with np.errstate(over="ignore"):
        for t in range(int(length.max()) if len(h) else 0):
            i = np.flatnonzero(length > t)
            out[i] += h[i + t] * U64(pow(Q, t, 1 << 64))
        return mix(out + length.astype(U64))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all runs of k words; a text with fewer words gives its one run of all words."""
    doc = w.doc()
    i = np.arange(len(w.hash))
    left = w.bound[doc + 1] - i
    keep = (left >= k) | (i == w.bound[doc])
    return run_hashes(w.hash, np.minimum(left, k))[keep], doc[keep]


def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (44 high bits of h, doc), by doc; doc is below 2**20."""
    key = np.sort((doc.astype(U64) << U64(44)) | (h >> U64(20)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & U64((1 << 44) - 1), (key >> U64(44)).astype(np.int64)
