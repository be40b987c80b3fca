"""Levels of an n-gram trie in Elias-Fano form, kept in memory-mapped files.

A level maps (context, successor) to the quantised parts of a smoothed probability. Contexts, the pointers to each context's
successors, and the successors themselves are monotone sequences: successors get the number of their context times the number of
names in front, so that they go on rising over all contexts. A monotone sequence of n numbers up to u costs about 2 + log2(u / n)
bits each: the low bits are packed, the high bits stand in unary. A lookup finds the context, and then the successor by a search
within that context's range alone.
"""

from __future__ import annotations

#: Probabilities are kept as 8-bit steps of their logarithm over so many decades, rounded down; code 0 means none.
DECADES, TOP = 10.0, 255
#: The successor that stands for all that have no name: it counts for its context but is no node.
UNNAMED = (1 << 56) - 1
AT_ONCE = 1 << 16


def quantise(p):
    """Codes of probabilities; what a code stands for is never above the probability."""
    import numpy as np

    with np.errstate(divide="ignore"):
        code = np.floor((TOP - 1) * (1 + np.log10(np.asarray(p, np.float64)) / DECADES) + 1e-9) + 1
    return np.where(np.asarray(p) > 0, np.clip(code, 1, TOP), 0).astype(np.uint8)


def restore(code):
    import numpy as np

    table = 10.0 ** (DECADES * (np.arange(TOP + 1) - TOP) / (TOP - 1))
    table[0] = 0.0
    return table[code]


class Mapped:
    """Arrays one after another in a temporary file that has no name and ends with the object."""

    def __init__(self):
        import tempfile

        self.file, self.size = tempfile.TemporaryFile(), 0
        self.map = None

    def add(self, array) -> tuple[int, int, str]:
        pad = -self.size % 8
        data = b"\0" * pad + array.tobytes()
        self.file.write(data)
        at, self.size = self.size + pad, self.size + len(data)
        return at, len(array), array.dtype.str

    def open(self) -> None:
        import mmap

        self.file.write(b"\0" * 8)
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)

    def get(self, place: tuple[int, int, str]):
        import numpy as np

        at, n, kind = place
        return np.frombuffer(self.map, np.dtype(kind), n, at)


class EliasFano:
    """A rising sequence of unsigned 64-bit numbers."""

    def __init__(self, values, store: Mapped):
        import numpy as np

        self.n, self.store = len(values), store
        last = int(values[-1]) if self.n else 0
        self.low_bits = min(57, max(0, (last // max(1, self.n)).bit_length() - 1)) if self.n else 0
        self.buckets = (last >> self.low_bits) + 1
        if last >> 57 and self.low_bits == 57:
            raise ValueError("numbers are too large for this sequence")
        packed = []
        for at in range(0, self.n, AT_ONCE):  # AT_ONCE * low_bits is a whole number of bytes
            bits = np.unpackbits(values[at : at + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            packed.append(np.packbits(bits[:, : self.low_bits].ravel(), bitorder="little"))
        lows = np.concatenate([*packed, np.zeros(16, np.uint8)])
        high = np.zeros(-(-(self.n + self.buckets) // 64) * 64, np.uint8)
        high[(values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(self.n)] = 1
        words = np.packbits(high, bitorder="little")
        zeros = np.concatenate([[0], np.cumsum(64 - high.reshape(-1, 64).sum(axis=1, dtype=np.int64))])
        self.places = [store.add(x) for x in (lows, words, zeros.astype(np.int64))]

    def _low(self, index):
        import numpy as np

        if not self.low_bits:
            return np.zeros(len(index), np.uint64)
        data = self.store.get(self.places[0])
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        bit = index * self.low_bits
        return (words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def _select_zero(self, k):
        """Place of the k-th zero of the high bits."""
        import numpy as np

        words, zeros = self.store.get(self.places[1]).reshape(-1, 8), self.store.get(self.places[2])
        word = np.searchsorted(zeros, k, side="right") - 1
        bits = 1 - np.unpackbits(words[word], axis=1, bitorder="little")
        inside = (np.cumsum(bits, axis=1, dtype=np.uint8) == (k - zeros[word] + 1).astype(np.uint8)[:, None]).argmax(axis=1)
        return word * 64 + inside

    def find(self, wanted):
        """Index of each wanted number, or -1."""
        import numpy as np

        out = np.full(len(wanted), -1, np.int64)
        for at in range(0, len(wanted), AT_ONCE):
            part = wanted[at : at + AT_ONCE]
            bucket = (part >> np.uint64(self.low_bits)).astype(np.int64)
            inside = np.flatnonzero((bucket >= 0) & (bucket < self.buckets)) if self.n else np.empty(0, np.int64)
            bucket, low = bucket[inside], part[inside] & np.uint64((1 << self.low_bits) - 1)
            first = np.zeros(len(inside), np.int64)
            later = np.flatnonzero(bucket > 0)
            first[later] = self._select_zero(bucket[later] - 1) + 1 - bucket[later]
            end = self._select_zero(bucket) - bucket
            stop = end.copy()
            open_ = np.flatnonzero(first < stop)
            while len(open_):  # the successor of the low part among the bucket's
                middle = (first[open_] + stop[open_]) >> 1
                less = self._low(middle) < low[open_]
                first[open_] = np.where(less, middle + 1, first[open_])
                stop[open_] = np.where(less, stop[open_], middle)
                open_ = open_[first[open_] < stop[open_]]
            there = np.flatnonzero(first < end)
            there = there[self._low(first[there]) == low[there]]
            out[at + inside[there]] = first[there]
        return out

    def get(self, index):
        """The numbers at some places."""
        import numpy as np

        out = np.empty(len(index), np.uint64)
        words, zeros = self.store.get(self.places[1]).reshape(-1, 8), self.store.get(self.places[2])
        ones = np.arange(len(zeros)) * 64 - zeros
        for at in range(0, len(index), AT_ONCE):
            part = index[at : at + AT_ONCE]
            word = np.searchsorted(ones, part, side="right") - 1
            bits = np.unpackbits(words[word], axis=1, bitorder="little")
            inside = (np.cumsum(bits, axis=1, dtype=np.uint8) == (part - ones[word] + 1).astype(np.uint8)[:, None]).argmax(axis=1)
            out[at : at + AT_ONCE] = ((word * 64 + inside - part).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(part)
        return out


class Level:
    """Contexts with their successors: quantised discounted shares, and what each context leaves to the lower order."""

    def __init__(self, context, successor, count, least: int, discount: float):
        """Sorted distinct pairs with their counts; pairs counted less than ``least`` times give their share to the lower order."""
        import numpy as np

        learned = count > 0
        context, successor, count = context[learned], successor[learned], count[learned]
        new = np.concatenate([[True], context[1:] != context[:-1]]) if len(context) else np.empty(0, bool)
        owner = np.cumsum(new) - 1
        names = context[new]
        total = np.bincount(owner, weights=count, minlength=len(names))
        kept = (count >= least) & (successor != np.uint64(UNNAMED))
        owner, successor, count = owner[kept], successor[kept], count[kept]
        share = quantise((count - discount) / total[owner])
        used = np.bincount(owner, weights=restore(share), minlength=len(names))
        words = np.unique(successor)
        self.width = max(1, len(words))
        self.store = Mapped()
        self.contexts, self.words = EliasFano(names, self.store), EliasFano(words, self.store)
        self.pointers = EliasFano(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(names)))]).astype(np.uint64), self.store)
        rising = owner.astype(np.uint64) * np.uint64(self.width) + np.searchsorted(words, successor).astype(np.uint64)
        self.successors = EliasFano(rising, self.store)
        self._shares, self._left = self.store.add(share), self.store.add(quantise(1 - used))
        self._many = self.store.add((count > 1).astype(np.uint8))
        self.store.open()

    def contexts_of(self, context):
        """(number, left code, first node) of each context; the number is -1 and the code 0 for one that was never seen."""
        import numpy as np

        number = self.contexts.find(context)
        known = np.flatnonzero(number >= 0)
        left, first = np.zeros(len(context), np.uint8), np.zeros(len(context), np.int64)
        left[known] = self.store.get(self._left)[number[known]]
        first[known] = self.pointers.get(number[known]).astype(np.int64)
        return number, left, first

    def nodes_of(self, number, successor):
        """Node of each (context number, successor), or -1: a search relative to the context."""
        import numpy as np

        word = self.words.find(successor)
        there = np.flatnonzero((number >= 0) & (word >= 0))
        node = np.full(len(successor), -1, np.int64)
        node[there] = self.successors.find(number[there].astype(np.uint64) * np.uint64(self.width) + word[there].astype(np.uint64))
        return node

    def values_of(self, node):
        """(share code, whether it was counted more than once) of each node."""
        import numpy as np

        there = np.flatnonzero(node >= 0)
        share, many = np.zeros(len(node), np.uint8), np.zeros(len(node), bool)
        share[there], many[there] = self.store.get(self._shares)[node[there]], self.store.get(self._many)[node[there]] > 0
        return share, many
