"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes that also starts elsewhere.

The order of suffixes comes from a distributed merge sort that never compares a known common prefix twice. Each run of documents
sorts its own suffixes and sends them front-coded (the length of the prefix shared with the suffix before, and the rest), cut at
sampled splitters. A receiving task merges its runs in a tournament tree of losers that keeps, for every waiting suffix, its common
prefix with the last winner: unequal prefixes decide without looking at a byte, equal ones are compared from there on.

Not every suffix needs to be sorted. Of the k-byte strings in a window of ``length`` bytes (k is half the length) the one with the
least hash is the window's anchor; equal windows have their anchors at the same offset, so a window repeats exactly if its anchor's
suffix and the bytes before agree with another's. Suffixes start at anchors only, one in fifty bytes, and only at those whose k bytes
occur twice at all: runs first exchange sorted hashes of them, as differences, and learn which occur again. In the merged order the
common prefixes say which suffixes share r bytes for any r; together with the order of the bytes before, that gives for each
anchor the least and greatest offset of a repeated window, and with them the bytes to remove.

Defined cases: a null text is empty; texts shorter than ``length`` keep all bytes; strings never cross documents; equal rows are
different documents, so their strings repeat; overlapping occurrences count; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm.common import bucketed, per_gigabyte, with_id
from alertlake.llm.runs import RUN_BYTES, answers_by_run, in_runs, pack, partitions, squeeze, unpack, unsqueeze

#: Bytes hashed at a time; longer texts are taken in overlapping segments.
SEGMENT = 1 << 20
BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Repeats:
    """part: suffixes that one task merges, about; sample: how many sampled suffixes the splitters are taken from at most."""

    length: int = 200
    part: int = 200_000
    sample: int = 20_000
    run_bytes: int = RUN_BYTES

    @property
    def k(self) -> int:
        return max(1, self.length // 2)

    @property
    def starts(self) -> int:
        """k-byte strings in a window."""
        return self.length - self.k + 1


def powers(n: int):
    import numpy as np

    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
    return up, down


def sliding(values, width: int, pick, empty):
    """pick over every ``width`` consecutive values, by doubling."""
    import numpy as np

    span = 1
    out = values
    while span * 2 <= width:
        out = pick(out[:-span], out[span:]) if len(out) > span else np.full(0, empty, values.dtype)
        span *= 2
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest and len(out) > rest else out if not rest else np.full(0, empty, values.dtype)


class Anchors:
    """Anchors of texts and the hashes of their k bytes."""

    def __init__(self, method: Repeats):
        self.method, self.up, self.down = method, *powers(SEGMENT + 2 * method.length)

    def of(self, data, ends) -> tuple:
        """(positions, hashes), for texts standing one after another in ``data`` up to ``ends``."""
        import numpy as np

        positions, hashes, at = [], [], 0
        bounds = np.concatenate([[0], ends])
        while at < len(ends):  # whole short texts together, or one long text
            upto = max(at + 1, int(np.searchsorted(ends, bounds[at] + SEGMENT, side="right")))
            low, high = int(bounds[at]), int(bounds[upto])
            for first in range(low, max(low + 1, high), SEGMENT):
                stop = min(high, first + SEGMENT + self.method.length - 1)
                p, h = self._segment(data[first:stop], bounds[at + 1 : upto + 1] - first)
                positions.append(p + first)
                hashes.append(h)
            at = upto
        if not positions:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        positions, hashes = np.concatenate(positions), np.concatenate(hashes)
        positions, once = np.unique(positions, return_index=True)
        return positions, hashes[once]

    def _segment(self, data, ends):
        import numpy as np

        k, starts, length = self.method.k, self.method.starts, self.method.length
        n = len(data) - k + 1
        if len(data) < length:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64)])
            h = (sums[k:] - sums[:-k]) * self.down[:n]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        h |= np.uint64(1)
        least = sliding(h, starts, np.minimum, 0)  # of the window that starts here
        windows = len(data) - length + 1
        crosses = np.zeros(windows + 1, np.int32)
        inner = ends[ends < len(data)]  # windows that start within a length before an end cross it
        np.add.at(crosses, np.clip(inner - length + 1, 0, windows), 1)
        np.add.at(crosses, np.clip(inner, 0, windows), -1)
        least = np.where(np.cumsum(crosses[:-1]) > 0, np.uint64(0), least[:windows])
        padded = np.concatenate([np.zeros(starts - 1, np.uint64), least, np.zeros(n - windows, np.uint64)])
        most = sliding(padded, starts, np.maximum, 0)  # over the windows that hold the string at this place
        found = np.flatnonzero(most == h)
        return found, h[found]


def texts_of(rows) -> tuple:
    """(all bytes of a run's texts, their ends)."""
    import numpy as np
    import pyarrow as pa

    texts = [x or b"" for x in rows.column("text").cast(pa.binary()).to_pylist()]
    return b"".join(texts), np.cumsum([len(x) for x in texts], dtype=np.int64) if texts else np.empty(0, np.int64)


def shares(hashes, parts: int):
    """Which part a hash belongs to, in the order of the hashes."""
    import numpy as np

    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def hash_questions(runs: DataFrame, method: Repeats, parts: int) -> DataFrame:
    """(share, run, hashes, twice): a run's distinct anchor hashes of a share, and which stand in the run more than once."""
    def ask(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        anchors = Anchors(method)
        for batch in batches:
            for i in range(batch.num_rows):
                data, ends = texts_of(unpack(batch.column(1)[i].as_py()))
                distinct, many = np.unique(anchors.of(np.frombuffer(data, np.uint8), ends)[1], return_counts=True)
                share = shares(distinct, parts)
                cuts = np.searchsorted(share, np.arange(parts + 1, dtype=np.uint64))
                own = np.flatnonzero(np.diff(cuts))
                yield pa.record_batch([
                    pa.array(own, pa.int32()), pa.array([batch.column(0)[i].as_py()] * len(own), pa.int64()),
                    pa.array([squeeze(distinct[cuts[p] : cuts[p + 1]]) for p in own], pa.binary()),
                    pa.array([np.packbits(many[cuts[p] : cuts[p + 1]] > 1).tobytes() for p in own], pa.binary())],
                    ["share", "run", "hashes", "twice"])

    return runs.select("run", "rows").mapInArrow(ask, "share int, run long, hashes binary, twice binary")


def repeated_hashes(group: pd.DataFrame) -> pd.DataFrame:
    """Of one share of all runs' hashes: for each run, bits that say which of its hashes stand elsewhere too."""
    import numpy as np

    lists = [unsqueeze(x) for x in group["hashes"]]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)).astype(bool) for x, y in zip(group["twice"], lists)]
    together = np.concatenate(lists)
    order = np.argsort(together, kind="stable")
    same = together[order[1:]] == together[order[:-1]]
    again = np.concatenate(twice)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    return pd.DataFrame({"run": group["run"], "share": group["share"], "bits": [np.packbits(x).tobytes() for x in np.split(again, cuts)]})


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that agree up to ``at``."""
    n = min(len(a), len(b))
    while at + 16 <= n and a[at : at + 16] == b[at : at + 16]:
        at += 16
    while at < n and a[at] == b[at]:
        at += 1
    return at


def prefixes(ordered: list[bytes]) -> list[int]:
    """Common prefix of each string with the one before."""
    return [0, *(common(a, b, 0) for a, b in zip(ordered, ordered[1:]))][: len(ordered)]


def front_code(entries: list[tuple[bytes, bytes]], shared: list[int], many: list[int]) -> bytes:
    """Sorted (suffix, bytes before it, reversed), with the first's prefix given whole."""
    import pyarrow as pa

    shared = [0, *shared[1:]] if shared else shared
    return pack(pa.table({"shared": pa.array(shared, pa.int32()), "rest": pa.array([e[0][s:] for e, s in zip(entries, shared)], pa.binary()),
                          "before": pa.array([e[1] for e in entries], pa.binary()), "many": pa.array(many, pa.int8())}))


def front_decode(data: bytes) -> tuple[list[bytes], list[int], list[bytes], list[int]]:
    table = unpack(data)
    shared, last, out = table.column("shared").to_pylist(), b"", []
    for s, rest in zip(shared, table.column("rest").to_pylist()):
        last = last[:s] + rest
        out.append(last)
    return out, shared, table.column("before").to_pylist(), table.column("many").to_pylist()


def sorted_runs(runs: DataFrame, answers: DataFrame, method: Repeats, parts: int) -> DataFrame:
    """(run, entries, members, samples, n): each run's sorted suffixes at anchors that stand elsewhere too.

    An entry is a distinct pair of the ``length`` bytes from an anchor on and the bytes before it that a window may hold; members
    are the anchors' positions and entries.
    """
    def sort(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        anchors = Anchors(method)
        for batch in batches:
            for i in range(batch.num_rows):
                data, ends = texts_of(unpack(batch.column(1)[i].as_py()))
                positions, hashes = anchors.of(np.frombuffer(data, np.uint8), ends)
                distinct = np.unique(hashes)
                cuts = np.searchsorted(shares(distinct, parts), np.arange(parts + 1, dtype=np.uint64))
                again = np.zeros(len(distinct), bool)
                for answer in batch.column(2)[i].as_py() or ():
                    a, b = cuts[answer["share"]], cuts[answer["share"] + 1]
                    again[a:b] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=b - a).astype(bool)
                chosen = positions[again[np.searchsorted(distinct, hashes)]] if len(distinct) else positions
                text = np.searchsorted(ends, chosen, side="right")
                highs = np.minimum(ends[text], chosen + method.length).tolist()
                lows = np.maximum(np.where(text > 0, ends[np.maximum(text - 1, 0)], 0), chosen - (method.starts - 1)).tolist()
                known: dict[tuple[bytes, bytes], int] = {}
                of = [known.setdefault((data[p:b], data[a:p][::-1]), len(known)) for p, a, b in zip(chosen.tolist(), lows, highs)]
                entries = sorted(known)
                place = np.empty(len(entries), np.int64)
                place[[known[e] for e in entries]] = np.arange(len(entries))
                of = place[np.array(of, np.int64)] if of else np.empty(0, np.int64)
                many = np.minimum(np.bincount(of, minlength=len(entries)), 2).tolist()
                step = max(1, len(entries) // 16)
                yield pa.record_batch([
                    pa.array([batch.column(0)[i].as_py()], pa.int64()),
                    pa.array([front_code(entries, prefixes([e[0] for e in entries]), many)], pa.binary()),
                    pa.array([pack(pa.table({"position": pa.array(chosen, pa.int64()), "entry": pa.array(of, pa.int32())}))], pa.binary()),
                    pa.array([[e[0][: method.k] for e in entries[step // 2 :: step]]], pa.list_(pa.binary())),
                    pa.array([len(entries)], pa.int64())], ["run", "entries", "members", "samples", "n"])

    asked = runs.select("run", "rows").join(answers_by_run(answers, "share", "bits"), "run", "left")
    found = asked.select("run", "rows", "answers").mapInArrow(sort, "run long, entries binary, members binary, samples array<binary>, n long")
    return bucketed(found, "suffix-runs", "run", partitions(runs))


def splitters(sorted_: DataFrame, method: Repeats) -> list[bytes]:
    """Prefixes that cut all suffixes into about equal parts, from a bounded sample. Suffixes with k bytes in common stay together."""
    total = sorted_.agg(F.sum("n")).first()[0] or 0
    n = per_gigabyte(total, method.part)
    if n < 2:
        return []
    sample = (sorted_.select(F.explode("samples").alias("s"), "run").orderBy(F.xxhash64("s", "run")).limit(max(method.sample, 4 * n)).select("s"))
    ranked = sorted(bytes(r["s"]) for r in sample.collect())
    return sorted({ranked[len(ranked) * i // n] for i in range(1, n)}) if ranked else []


def exchange(sorted_: DataFrame, cuts: list[bytes], method: Repeats) -> DataFrame:
    """(part, run, first, entries): the sorted runs cut at the splitters."""
    def cut(batches: Iterator) -> Iterator:
        from bisect import bisect_left, bisect_right

        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                suffixes, shared, before, many = front_decode(batch.column(1)[i].as_py())
                heads = [s[: method.k] for s in suffixes]
                at = 0
                while at < len(suffixes):
                    part = bisect_right(cuts, heads[at])
                    stop = bisect_left(heads, cuts[part], at) if part < len(cuts) else len(suffixes)
                    coded = front_code(list(zip(suffixes[at:stop], before[at:stop])), shared[at:stop], many[at:stop])
                    yield pa.record_batch([pa.array([part], pa.int32()), pa.array([batch.column(0)[i].as_py()], pa.int64()),
                                           pa.array([at], pa.int32()), pa.array([coded], pa.binary())], ["part", "run", "first", "entries"])
                    at = stop

    return sorted_.where("n > 0").select("run", "entries").mapInArrow(cut, "part int, run long, first int, entries binary")


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, common prefix with the suffix given before) in the order of the suffixes of all runs.

    Each run has its sorted suffixes and their common prefixes with the one before. A tree node keeps the loser of its match;
    every waiting suffix knows its common prefix with the winner that last beat it.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    at = [0] * leaves
    shared = [0 if i < len(runs) and runs[i][0] else -1 for i in range(leaves)]  # -1: nothing left, loses to all
    current = [runs[i][0][0] if i < len(runs) and runs[i][0] else b"" for i in range(leaves)]
    losers = [0] * leaves

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one it shares with the winner."""
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        if shared[a] < 0:
            return a, b
        x, y = current[a], current[b]
        n = common(x, y, shared[a])
        if n == len(x) or n < len(y) and x[n] < y[n]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    def play(node: int) -> int:
        if node >= leaves:
            return node - leaves
        winner, losers[node] = match(play(2 * node), play(2 * node + 1))
        return winner

    winner = play(1)
    while shared[winner] >= 0:
        yield winner, at[winner], shared[winner]
        at[winner] += 1
        suffixes, known = runs[winner]
        if at[winner] < len(suffixes):
            current[winner], shared[winner] = suffixes[at[winner]], known[at[winner]]
        else:
            shared[winner] = -1
        node = winner + leaves >> 1
        while node:
            winner, losers[node] = match(winner, losers[node])
            node >>= 1


def repeated_offsets(suffixes: list[bytes], shared, before: list[bytes], many, method: Repeats):
    """For sorted suffixes: the least and greatest offset of a repeated window around each anchor (least > greatest: none).

    The window at offset o starts o bytes before the anchor. Two anchors share it if their suffixes share length - o bytes and
    the o bytes before agree.
    """
    import numpy as np

    n, length = len(suffixes), method.length
    least, most = np.full(n, length, np.int32), np.full(n, -1, np.int32)
    first = np.maximum(0, length - np.fromiter(map(len, suffixes), np.int64, n))
    last = np.fromiter(map(len, before), np.int64, n)
    shared = np.asarray(shared, np.int64).copy()
    if n:
        shared[0] = 0
    # Equal entries (suffix and bytes before) are one; more than one of them repeats every window that fits.
    seen: dict[tuple[int, bytes], int] = {}
    lengths = np.fromiter(map(len, suffixes), np.int64, n)
    equal = np.zeros(n, bool)
    equal[1:] = (shared[1:] == lengths[1:]) & (shared[1:] == lengths[:-1])
    names = np.cumsum(~equal)
    one = np.fromiter((seen.setdefault((a, b), i) for i, (a, b) in enumerate(zip(names.tolist(), before))), np.int64, n)
    count = np.bincount(one, weights=np.asarray(many, np.float64), minlength=n)[one] if n else np.empty(0)
    sure = (count > 1) & (first <= last)
    least[sure], most[sure] = first[sure], last[sure]
    # The others are compared with all distinct entries that share k bytes with them.
    group = np.cumsum(shared < method.k)
    open_ = np.zeros(n, bool)
    open_[one] = True
    alone = open_ & ~(count > 1) & (first <= last)
    wanted = np.bincount(group, weights=alone, minlength=(group[-1] + 1) if n else 1)[group] > 0 if n else alone
    crowd = np.bincount(group, weights=open_, minlength=(group[-1] + 1) if n else 1)[group] > 1 if n else alone
    use = np.flatnonzero(open_ & wanted & crowd)
    if len(use):
        chain = np.concatenate([[0], np.minimum.reduceat(shared[: use[-1] + 1], use[:-1] + 1) if len(use) > 1 else []]).astype(np.int64)
        lefts = [before[i] for i in use]
        order = sorted(range(len(use)), key=lefts.__getitem__)
        back = np.array(prefixes([lefts[i] for i in order]), np.int64)
        rank = np.empty(len(use), np.int64)
        rank[order] = np.arange(len(use))
        lo, hi = least[use], most[use]
        for o in range(int(first[use].min()), int(last[use].max()) + 1):
            fits = np.flatnonzero((first[use] <= o) & (o <= last[use]))
            key = np.cumsum(chain < length - o)[fits] * np.int64(len(use) + 1) + np.cumsum(back < o)[rank[fits]]
            by = np.argsort(key, kind="stable")
            same = key[by[1:]] == key[by[:-1]]
            hit = np.unique(np.concatenate([by[1:][same], by[:-1][same]]))
            hit = fits[hit]
            lo[hit], hi[hit] = np.minimum(lo[hit], o), np.maximum(hi[hit], o)
        least[use], most[use] = lo, hi
    return least[one], most[one]


def merged_offsets(method: Repeats):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        group = group.sort_values("run").reset_index(drop=True)
        coded = [front_decode(x) for x in group["entries"]]
        order = list(merge([(c[0], c[1]) for c in coded]))
        suffixes, before = [coded[r][0][i] for r, i, _ in order], [coded[r][2][i] for r, i, _ in order]
        least, most = repeated_offsets(suffixes, [s for _, _, s in order], before, [coded[r][3][i] for r, i, _ in order], method)
        source, index = np.array([r for r, _, _ in order], np.int64), np.array([i for _, i, _ in order], np.int64)
        out = []
        for r in range(len(coded)):
            own = np.flatnonzero(source == r)
            both = np.empty((2, len(own)), "<i2")
            both[0, index[own]], both[1, index[own]] = least[own], most[own]
            out.append(both.tobytes())
        return pd.DataFrame({"run": group["run"], "first": group["first"], "offsets": out})

    return run


def remove_repeats(docs: DataFrame, method: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_bytes``, ``spans`` (start and end of every maximal removed stretch) and ``kept`` (the bytes that stay)."""
    runs = in_runs(docs, id_col, text_col, "suffix-docs", run_bytes=method.run_bytes)
    size = runs.agg(F.sum("n_bytes")).first()[0] or 0
    parts = per_gigabyte(size, 64 << 20, partitions(docs))
    answers = hash_questions(runs, method, parts).groupBy("share").applyInPandas(repeated_hashes, "run long, share int, bits binary")
    sorted_ = sorted_runs(runs, answers, method, parts)
    pieces = exchange(sorted_, splitters(sorted_, method), method)
    offsets = pieces.groupBy("part").applyInPandas(merged_offsets(method), "run long, first int, offsets binary")
    schema = with_id(docs, id_col, "n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return (runs.select("run", "rows").join(sorted_.select("run", "members"), "run", "left")
            .join(answers_by_run(offsets, "first", "offsets"), "run", "left").select("rows", "members", "answers")
            .mapInArrow(_remover(method, schema), schema))


def _remover(method: Repeats, schema):
    def remove(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                rows = unpack(batch.column(0)[i].as_py())
                data, ends = texts_of(rows)
                edge = np.zeros(len(data) + 1, np.int32)
                answers = sorted(batch.column(2)[i].as_py() or (), key=lambda a: a["first"])
                if answers:
                    both = [np.frombuffer(a["offsets"], "<i2").reshape(2, -1) for a in answers]
                    least, most = np.concatenate(both, axis=1).astype(np.int64)
                    members = unpack(batch.column(1)[i].as_py())
                    position, entry = (members.column(c).to_numpy() for c in ("position", "entry"))
                    hit = least[entry] <= most[entry]
                    np.add.at(edge, (position - most[entry])[hit], 1)
                    np.add.at(edge, (position - least[entry])[hit] + method.length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans, kept, sizes, start = [], [], [], 0
                for end in ends.tolist():
                    own = gone[start:end]
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    spans.append([{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()])
                    kept.append(np.frombuffer(data, np.uint8, end - start, start)[~own].tobytes() if len(turns) else data[start:end])
                    sizes.append(end - start)
                    start = end
                table = rows.combine_chunks()
                for at in range(0, table.num_rows, 256):
                    part = slice(at, at + 256)
                    owners = table.column(0).chunk(0).slice(at, 256)
                    yield pa.RecordBatch.from_arrays([owners, pa.array(sizes[part], pa.int64()), pa.array(spans[part], kinds.field(2).type),
                                                      pa.array(kept[part], pa.binary())], schema=kinds)

    return remove
