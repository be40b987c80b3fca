"""Vectors of texts and distances between vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 384
BYTES_AT_ONCE = 1 << 16


@F.arrow_udf(T.LongType())
def byte_sum(texts: pa.Array) -> pa.Array:
    """Sum of the UTF-8 bytes of each whole text; NULL for a NULL text. The bytes are summed where Arrow holds them, without a copy."""
    data = texts.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, data.offset * 8)
    found, filled = np.zeros(len(data), np.int64), np.flatnonzero(np.diff(offsets))
    # NumPy widens what it adds up at once, so only some bytes at a time, or one text.
    starts = offsets[filled]
    cuts = np.append(np.flatnonzero(np.diff(starts // BYTES_AT_ONCE, prepend=-1)), len(filled))
    content = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    for first, after in zip(cuts[:-1], cuts[1:]):
        own = starts[first:after]
        if len(own) == 1:
            found[filled[first]] = content[own[0] : offsets[filled[first] + 1]].sum(dtype=np.int64)
        else:
            found[filled[first:after]] = np.add.reduceat(content[own[0] : offsets[filled[after - 1] + 1]], own - own[0], dtype=np.int64)
    return pa.array(found, mask=texts.is_null().to_numpy(zero_copy_only=False))


def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Unit vector drawn from a generator seeded with the text's byte sum; equal sums share a vector.

    The values are defined by NumPy's generator, which no built-in function offers, hence the Arrow-batched function.
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(seeds: pd.Series) -> pd.Series:
        drawn: dict[int, np.ndarray] = {}
        generator = np.random.RandomState(0)
        for seed in seeds.dropna().unique():
            generator.seed(int(seed) % 2**32)
            vector = generator.rand(dimensions)
            drawn[seed] = (vector / np.sqrt((vector * vector).sum())).astype(np.float32)
        return pd.Series([drawn.get(seed) for seed in seeds], dtype=object)

    return embed(byte_sum(text))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def euclidean_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))
