"""Runs: the documents as rows of a few megabytes each, kept in buckets of the run, for operators that ask the whole corpus.

An operator reads a run, sends questions about it to other tasks, and later meets the answers by the run's number. The runs are
written once, compressed; being in buckets they stay where they are when answers are joined to them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm.common import bucketed, id_and_text, slices

RUN_BYTES = 4 << 20


def pack(table) -> bytes:
    """An Arrow table as compressed bytes."""
    import pyarrow as pa

    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def unpack(data: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(data).read_all()


def free() -> None:
    """Give back what Arrow holds in reserve, so that a worker's memory follows one run."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def partitions(df: DataFrame) -> int:
    """How many partitions the session gives a shuffle."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_runs(docs: DataFrame, id_col: str, text_col: str, label: str, *more, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(run, rows, n_bytes): the documents (id, text and further columns) in runs of about ``run_bytes`` of text."""
    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for part, texts in slices(batches):
            held.append(part)
            size += sum(len(x) for x in texts if x)
            if size >= run_bytes:
                yield pa.record_batch([pa.array([number], pa.int64()), pa.array([pack(pa.Table.from_batches(held))], pa.binary()),
                                       pa.array([size], pa.int64())], ["run", "rows", "n_bytes"])
                number, held, size = number + 1, [], 0
        if held:
            yield pa.record_batch([pa.array([number], pa.int64()), pa.array([pack(pa.Table.from_batches(held))], pa.binary()),
                                   pa.array([size], pa.int64())], ["run", "rows", "n_bytes"])

    rows = id_and_text(docs, id_col, text_col, *more).mapInArrow(gather, "run long, rows binary, n_bytes long")
    return bucketed(rows, label, "run", partitions(docs))


def answers_by_run(answers: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per run with the list of its answers."""
    return answers.groupBy("run").agg(F.collect_list(F.struct(key, *columns)).alias("answers"))


def squeeze(sorted_numbers) -> bytes:
    """Sorted unsigned 64-bit numbers as differences, byte by byte place, compressed."""
    import numpy as np
    import zstandard

    steps = np.diff(sorted_numbers, prepend=np.uint64(0))
    return zstandard.compress(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unsqueeze(data: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def planes(array) -> bytes:
    """Numbers byte by byte place, compressed: equal high bytes then cost nearly nothing."""
    import numpy as np
    import zstandard

    wide = np.ascontiguousarray(array)
    return zstandard.compress(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, wide.dtype.itemsize).T).tobytes(), 3)


def unplanes(data: bytes, kind: str):
    import numpy as np
    import zstandard

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_columns(**columns) -> bytes:
    """Number columns by name; 64-bit ones as differences, as they mostly rise."""
    import pickle

    import numpy as np

    packed = {}
    for name, column in columns.items():
        wide = column.dtype.itemsize == 8
        packed[name] = (column.dtype.str, planes(np.diff(column.view(np.uint64), prepend=np.uint64(0)) if wide else column))
    return pickle.dumps(packed)


def unpack_columns(data: bytes) -> dict:
    import pickle

    import numpy as np

    found = {}
    for name, (kind, body) in pickle.loads(data).items():
        values = unplanes(body, kind)
        found[name] = np.cumsum(values.view(np.uint64), dtype=np.uint64).view(kind) if np.dtype(kind).itemsize == 8 else values
    return found
