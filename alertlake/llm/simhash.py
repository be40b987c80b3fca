"""SimHash near-duplicates through an inverted index of fingerprint bytes at their positions.

Fingerprints that differ in at most three bits differ in at most three of their eight bytes, so they share at least five bytes
at equal positions. Postings of single bytes would hold every 256th fingerprint; they are read four at a time instead: of the
14 four-byte position sets that are planes of the binary 3-space, one avoids any three given positions. Within a posting the
shared positional bytes of a pair are tallied, pairs with the guaranteed minimum are retained, and their bits are compared.
Equal fingerprints are one entry. A posting gives out at most one link per entry (a spanning forest of its pairs), so no group
is expanded into pairs; the forests are joined to components by repeated star contraction over written tables.

Defined cases: a null or blank text has fingerprint zero, linked like any other; fewer words than a shingle make one shingle;
repeated rows share a component; a null id is never a component's name unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlake.llm.common import id_and_text, slices, store, unused, with_id

SEED = 42
BYTES = 8
PLANES = [p for p in combinations(range(BYTES), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
#: Postings up to this length are compared pair by pair, longer ones first by one more shared byte.
BLOCK = 4096


@dataclass(frozen=True)
class SimHash:
    """max_bits is at most 3: the position sets are made for three differing bytes."""

    shingle: int = 3
    max_bits: int = 3


def fingerprint(data: bytes | None, shingle: int) -> int:
    """Bits set in more than half of the shingles' hashes."""
    import numpy as np
    import xxhash

    words = data.lower().split() if data else []
    if not words:
        return 0
    text = memoryview(b" ".join(words))
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(text, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts, stops = (ends - lengths)[: len(words) - shingle + 1].tolist(), (ends - 1)[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 15):
        hashes = np.array([digest(text[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, method: SimHash = SimHash(), id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """(id, fp): the fingerprint as the signed long of its 64 bits; then further columns."""
    two = id_and_text(docs, id_col, text_col, *more)
    rest = two.schema.fields[2:]
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for part, texts in slices(batches):
            fps = np.array([fingerprint(x, method.shingle) for x in texts], np.uint64).view(np.int64)
            yield pa.record_batch([part.column(0), pa.array(fps), *part.columns[2:]], schema.fieldNames())

    schema = T.StructType([*with_id(docs, id_col, "fp long", "id").fields, *rest])
    return two.mapInArrow(run, schema)


def close_pairs(fps, groups, max_bits: int):
    """Index pairs of one group that share enough positional bytes and differ in few enough bits. Groups stand together."""
    import numpy as np

    left, right = [], []
    index = np.arange(len(fps))
    step = 1
    while len(index):
        index = index[index + step < len(fps)]
        index = index[groups[index] == groups[index + step]]
        diff = fps[index] ^ fps[index + step]
        shared = BYTES - (diff.view(np.uint8).reshape(-1, BYTES) != 0).sum(axis=1)
        retained = np.flatnonzero(shared >= BYTES - max_bits)
        verified = retained[np.bitwise_count(diff[retained]) <= max_bits]
        left.append(index[verified])
        right.append(index[verified] + step)
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def flipped_pairs(fps, max_bits: int):
    """The same for one long posting whose entries differ in three bytes only: probe every flip of up to three of the 24 bits."""
    import numpy as np

    varies = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [np.uint64(1 << b) for b in range(64) if varies >> b & 1]
    order = np.argsort(fps)
    ranked, left, right = fps[order], [], []
    for n in range(1, max_bits + 1):
        for chosen in combinations(bits, n):
            probe = fps ^ np.bitwise_or.reduce(np.array(chosen))
            at = np.minimum(np.searchsorted(ranked, probe), len(fps) - 1)
            hit = np.flatnonzero((ranked[at] == probe) & (fps < probe))
            left.append(hit)
            right.append(order[at[hit]])
    return np.concatenate(left), np.concatenate(right)


def roots(n: int, left, right):
    """Smallest index of each component of a graph on 0..n-1."""
    import numpy as np

    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    return root


def forest(fps, groups, max_bits: int):
    """Links (fingerprint, another of its component) that connect what is close within each posting."""
    import numpy as np

    if not len(fps):
        return fps, fps
    size = np.bincount(groups)
    long = size[groups] > BLOCK
    short = np.flatnonzero(~long)
    a, b = close_pairs(fps[short], groups[short], max_bits)
    left, right = [short[a]], [short[b]]
    for g in np.flatnonzero(size > BLOCK):
        own = np.flatnonzero(groups == g)
        octets = fps[own].view(np.uint8).reshape(-1, BYTES)
        varies = np.flatnonzero((octets != octets[0]).any(axis=0))
        if len(varies) < BYTES - 4:  # a further byte is the same in all, so it may be the only one that a pair shares
            a, b = flipped_pairs(fps[own], max_bits)
            left.append(own[a])
            right.append(own[b])
            continue
        for position in varies:  # a close pair shares one more byte at least
            order = np.argsort(octets[:, position], kind="stable")
            values = octets[order, position].astype(np.int64)
            many = np.bincount(values, minlength=256)
            few = order[many[values] <= BLOCK]
            a, b = close_pairs(fps[own[few]], octets[few, position], max_bits)
            left.append(own[few[a]])
            right.append(own[few[b]])
            for value in np.flatnonzero(many > BLOCK):
                some = own[order[values == value]]
                a, b = flipped_pairs(fps[some], max_bits)
                left.append(some[a])
                right.append(some[b])
    left, right = np.concatenate(left), np.concatenate(right)
    root = roots(len(fps), left, right)
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(u, v) links that connect all fingerprints within ``max_bits``; ``distinct`` has one row per fingerprint, column fp."""
    masks = [sum(0xFF << 8 * b for b in plane) for plane in PLANES]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    posting = F.explode(F.array(*[F.struct(F.lit(i).alias("plane"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key"))
                                  for i, m in enumerate(signed)]))
    entries = distinct.select("fp", posting.alias("p")).select("p.plane", "p.key", "fp")

    def connect(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def out(planes, keys, fps):
            new = np.concatenate([[False], (planes[1:] != planes[:-1]) | (keys[1:] != keys[:-1])])
            u, v = forest(fps.view(np.uint64), np.cumsum(new), max_bits)
            return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
            whole = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])) if len(held[0]) else []
            if len(whole):  # the last posting may go on in the next batch
                cut = whole[-1] + 1
                yield out(*[h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield out(*held)

    return (entries.repartition("plane", "key").sortWithinPartitions("plane", "key")
            .mapInArrow(connect, "u long, v long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the links and the smallest node it reaches, by alternating large and small stars."""
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.where(F.col("u") != F.col("v")).distinct(), "stars")
        # Every row of large points from a larger node to a smaller one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = store(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct(), "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31)), F.sum(F.xxhash64("v", "u") % (1 << 31))).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def simhash_components(docs: DataFrame, method: SimHash = SimHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``fp`` (signed long) and ``component_id``, the smallest id that links reach."""
    return _rooted(docs, method, id_col, text_col).select(F.col("id").alias(id_col), "fp", "component_id")


def _rooted(docs: DataFrame, method: SimHash, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, component_id, root): the root is the smallest fingerprint of the component and tells components apart."""
    fps = store(fingerprints(docs, method, id_col, text_col), "fingerprints")
    distinct = store(fps.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    nodes = components(store(links(distinct.select("fp"), method.max_bits), "links"))
    named = distinct.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = named.select("fp", "root").join(lowest, "root").select("fp", "component_id", "root")
    return fps.join(names, "fp").select("id", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, method: SimHash = SimHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each component: the one that names it. Of several rows that name it, the smallest text hash stays.

    What goes is joined to the documents rather than what stays, as it is less. The id alone tells the rows apart, unless ids repeat;
    then a hash of the text does too.
    """
    found = store(_rooted(docs, method, id_col, text_col), "components")
    named = F.col("id").eqNullSafe(F.col("component_id"))
    if not found.groupBy("id").count().where("count > 1").limit(1).count():
        gone = store(found.where(~named).select("id"), "gone")
        return docs.join(gone, docs[id_col].eqNullSafe(gone["id"]), "left_anti")
    text = F.col(text_col).cast("string")
    prints = store(fingerprints(docs, method, id_col, text_col, F.xxhash64(text).alias("print")).join(
        found.select("fp", "component_id", "root").distinct(), "fp"), "prints")
    # Rows with one id and one text are in one component, so these two name a component's row.
    first = prints.where(named).groupBy("root").agg(F.min(F.struct("id", "print")).alias("first")).select("first.id", "first.print")
    own = unused(docs, "_print")
    keyed = docs.select("*", F.xxhash64(text).alias(own))
    kept = keyed.join(first, keyed[id_col].eqNullSafe(first["id"]) & (keyed[own] == first["print"]), "left_semi")
    return kept.dropDuplicates([id_col, own]).select(*docs.columns)


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
