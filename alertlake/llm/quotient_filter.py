"""Counting quotient filters of word-id n-grams: lossless, sorted, and merged without losing their order.

An n-gram of ids of ``width`` bits each is a number of ``n * width`` bits in two halves. A Feistel network permutes these numbers,
so that n-grams spread evenly and every one can be told from its place again. The leading bits of the permuted number are the
quotient, which a filter keeps as one bit per quotient in use and one bit per entry (the last of its quotient); the rest is the
remainder, kept in full. A counter takes a byte, and eight more from 255 on.

A filter covers the numbers that start with given bits (``share``, of ``bits`` bits); cutting a filter into shares keeps its order.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = "<BBBBQQ"
ROUNDS = 4


def halves(n: int, width: int) -> tuple[int, int]:
    """Bits of the two halves of an n-gram."""
    return width * (n - n // 2), width * (n // 2)


def mix(x: np.ndarray, turn: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)) * np.uint64(0x100000001) & np.uint64((1 << bits) - 1)


def permute(high: np.ndarray, low: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = halves(n, width)
    for turn in range(0, ROUNDS, 2):
        high = high ^ mix(low, turn, a)
        low = low ^ mix(high, turn + 1, b)
    return high, low


def restore(high: np.ndarray, low: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = halves(n, width)
    for turn in range(ROUNDS - 2, -1, -2):
        low = low ^ mix(high, turn + 1, b)
        high = high ^ mix(low, turn, a)
    return high, low


def packed(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves of n-grams given as an array with a row of n word ids each."""
    n = words.shape[1]
    cut = n - n // 2
    out = []
    for columns in (words[:, :cut], words[:, cut:]):
        half = np.zeros(len(words), np.uint64)
        for j in range(columns.shape[1]):
            half = (half << np.uint64(width)) | columns[:, j].astype(np.uint64)
        out.append(half)
    return out[0], out[1]


def unpacked(high: np.ndarray, low: np.ndarray, n: int, width: int) -> np.ndarray:
    words, mask = np.empty((len(high), n), np.int64), np.uint64((1 << width) - 1)
    cut = n - n // 2
    for half, start, stop in ((high, 0, cut), (low, cut, n)):
        for j in range(stop - 1, start - 1, -1):
            words[:, j] = (half & mask).astype(np.int64)
            half = half >> np.uint64(width)
    return words


def counted(high: np.ndarray, low: np.ndarray, counts: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct permuted n-grams in order, with the sums of their counts."""
    a, b = halves(n, width)
    if a + b <= 64:
        both = (high << np.uint64(b)) | low
        order = np.argsort(both, kind="stable")
    else:
        order = np.lexsort((low, high))
    high, low = high[order], low[order]
    if not len(high):
        return high, low, counts
    first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return high[first], low[first], np.add.reduceat(counts[order], first)


def build(high: np.ndarray, low: np.ndarray, counts: np.ndarray, n: int, width: int, bits: int, share: int) -> bytes:
    """The filter of sorted distinct permuted n-grams that all start with the share's bits."""
    a, b = halves(n, width)
    size = len(high)
    most = min(a - bits, max(size, 1).bit_length() + 1)
    rest = a + b - bits - most
    q = max(0, min(most, most - (-rest) % 8))  # whole bytes of remainder
    shift = np.uint64(a - bits - q)
    quotient = ((high >> shift) & np.uint64((1 << q) - 1)).astype(np.int64)
    used = np.zeros(1 << q, bool)
    used[quotient] = True
    ends = np.concatenate([quotient[1:] != quotient[:-1], [True]]) if size else np.zeros(0, bool)
    tail = high & ((np.uint64(1) << shift) - np.uint64(1))
    planes = [np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : -(-k // 8)].tobytes() for x, k in ((tail, int(shift)), (low, b))]
    short = np.minimum(counts, 255).astype(np.uint8)
    return b"".join([struct.pack(HEAD, n, width, bits, q, share, size), np.packbits(used).tobytes(), np.packbits(ends).tobytes(), *planes,
                     short.tobytes(), counts[short == 255].astype("<i8").tobytes()])


def entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The permuted n-grams of a filter in order, and their counts."""
    n, width, bits, q, share, size = struct.unpack_from(HEAD, data)
    a, b = halves(n, width)
    shift, at = a - bits - q, struct.calcsize(HEAD)

    def take(length: int) -> np.ndarray:
        nonlocal at
        at += length
        return np.frombuffer(data, np.uint8, length, at - length)

    used = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8)), count=1 << q))
    ends = np.unpackbits(take(-(-size // 8)), count=size)
    quotient = used[np.cumsum(ends) - ends].astype(np.uint64) if size else np.zeros(0, np.uint64)
    parts = []
    for k in (shift, b):
        wide = np.zeros((size, 8), np.uint8)
        wide[:, : -(-k // 8)] = take(size * -(-k // 8)).reshape(size, -1) if size else 0
        parts.append(wide.view("<u8").ravel())
    counts = take(size).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", -1, at)
    lead = np.uint64(share) << np.uint64(a - bits) if bits else np.uint64(0)
    return lead | (quotient << np.uint64(shift)) | parts[0], parts[1], counts


def shape(data: bytes) -> tuple[int, int, int, int]:
    """(n, width, bits, share) of a filter."""
    return struct.unpack_from(HEAD, data)[:3] + (struct.unpack_from(HEAD, data)[4],)


def merge(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of filters of one share together: in order, equal ones added up."""
    n, width, _, _ = shape(filters[0])
    parts = [entries(f) for f in filters]
    return counted(*(np.concatenate(c) for c in zip(*parts)), n, width)


def cut(high: np.ndarray, low: np.ndarray, counts: np.ndarray, n: int, width: int, bits: int):
    """(share, filter) of every share that holds entries."""
    a, _ = halves(n, width)
    shares = (high >> np.uint64(a - bits)).astype(np.int64) if bits else np.zeros(len(high), np.int64)
    found, starts = np.unique(shares, return_index=True)
    for share, start, stop in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(high)]):
        yield share, build(high[start:stop], low[start:stop], counts[start:stop], n, width, bits, share)
