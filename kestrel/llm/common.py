"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kestrel.session import reachable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns that an operator is about to write; the operator's own column wins over a clashing one."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def with_columns_in_arrow(
    df: DataFrame, needs: Sequence[str], fields: Sequence[T.StructField], start: Callable[[], Callable], listed: bool = True
) -> DataFrame:
    """Append ``fields`` computed batch by batch on the executors; every other column passes through as Arrow.

    ``start()`` runs once a task and returns a function from the lists of the needed columns to the lists of the new
    ones (from their Arrow arrays where not ``listed``). No shuffle, and one batch in memory at a time; Spark cuts batches at 64 MB (spark.sql.execution.arrow.maxBytesPerBatch), so
    long texts make batches of few rows.
    """
    kept = without(df, [f.name for f in fields])
    schema = T.StructType([*kept.schema.fields, *fields])
    arrow = to_arrow_schema(schema)
    names = kept.columns
    extra = [c for c in needs if c not in names]
    wide = df.select(*[F.col(f"`{c}`") for c in names], *[F.col(f"`{c}`").alias(f"_need_{i}") for i, c in enumerate(extra)])
    n, places = len(names), [names.index(c) if c in names else len(names) + extra.index(c) for c in needs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in in_slices(batches):
            made = step(*[batch.column(i).to_pylist() if listed else batch.column(i) for i in places])
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(n)]
            columns += [pa.array(x, arrow.field(n + i).type) for i, x in enumerate(made)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return wide.mapInArrow(releasing(run), schema)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with what its task has freed handed back to the system at its end. Spark keeps a task's worker for later tasks and, idle,
    beside the workers of later stages, and the allocators would keep the memory of its largest batch."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim:
            trim(0)

    return whole


def in_slices(batches: Iterator[pa.RecordBatch], nbytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``nbytes``, a row at least, since Python's forms of rows take several times their Arrow bytes."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * nbytes / max(nbytes, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def members_of(cells: pa.ListArray) -> Iterator[list]:
    """The fields of each list of structs: booleans and numbers as arrays, binaries as lists of byte views of the batch."""
    flat, ends = cells.flatten(), np.concatenate([[0], np.cumsum(cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
    fields = []
    for column in flat.flatten():
        if pa.types.is_binary(column.type):
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            fields.append([data[a:b] for a, b in zip(at, at[1:])])
        else:
            fields.append(column.to_numpy(zero_copy_only=False))
    for a, b in zip(ends, ends[1:]):
        yield [f[a:b] for f in fields]
