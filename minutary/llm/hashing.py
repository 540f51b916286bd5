"""XXH64 of many spans of one byte string at once, and spans of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

# The constants of XXH64 (fixed values of the published algorithm).
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _strided(buffer: bytes, kind: str) -> np.ndarray:
    """Little-endian numbers that begin at every byte; `buffer` must be padded by 8 bytes."""
    return np.ndarray((len(buffer) - 8,), dtype=kind, buffer=buffer, strides=(1,))


def xxh64_spans(text: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of text[start:end] for every pair. Spans of 32 bytes and more go one by one."""
    padded = text + bytes(8)
    eight, four, one = (_strided(padded, kind) for kind in ("<u8", "<u4", "u1"))
    sizes = ends - starts
    found = sizes.astype(np.uint64) + np.uint64(seed) + P5
    at = starts.copy()
    for lane in range(3):
        own = np.flatnonzero(sizes >= 8 * (lane + 1))
        mixed = _rotate(eight[at[own]] * P2, 31) * P1
        found[own] = _rotate(found[own] ^ mixed, 27) * P1 + P4
        at[own] += 8
    own = np.flatnonzero(sizes & 4)
    found[own] = _rotate(found[own] ^ (four[at[own]].astype(np.uint64) * P1), 23) * P2 + P3
    at[own] += 4
    for byte in range(3):
        own = np.flatnonzero((sizes & 3) > byte)
        found[own] = _rotate(found[own] ^ (one[at[own]].astype(np.uint64) * P5), 11) * P1
        at[own] += 1
    found ^= found >> np.uint64(33)
    found *= P2
    found ^= found >> np.uint64(29)
    found *= P3
    found ^= found >> np.uint64(32)
    for place in np.flatnonzero(sizes >= 32):
        found[place] = xxhash.xxh64_intdigest(text[starts[place] : ends[place]], seed)
    return found


def shingle_spans(texts: list[list[bytes]], size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' words joined by spaces, and (start, end, owner) of every run of `size` words.

    A text of fewer words is one span, one without words is none.
    """
    joined = b" ".join([b" ".join(words) for words in texts if words])
    ends = np.append(np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    firsts = np.cumsum(counts) - counts
    spans = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(texts)), spans)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans)
    first = firsts[owner] + nth
    last = first + np.minimum(counts[owner], size) - 1
    return joined, starts[first], ends[last], owner


# Any odd number has an inverse modulo 2^64, so a span's value does not depend on its place.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    found = np.ones(count, dtype=np.uint64)
    found[1:] = np.uint64(base)
    return np.cumprod(found)


def rolling_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of text[start:end] for every pair, from prefix sums.

    Its cost does not depend on the spans' length. Good for filters, not against an
    adversary.
    """
    values = np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(_BASE, len(text)), out=sums[1:])
    found = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(text) + 1)[starts]
    found ^= found >> np.uint64(32)
    found *= P2
    return found ^ (found >> np.uint64(29))
