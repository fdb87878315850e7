"""What the operators share: table reading, blocks of texts, unsigned CRC."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A block holds so many rows and bytes of text at most; one longer text is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows of a partition, in order, as tables of a bounded number of rows and bytes of ``text``."""
    held: list[pa.RecordBatch] = []
    n_rows = n_bytes = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        start = 0
        for i, length in enumerate(lengths):
            if n_rows and (n_rows >= rows or n_bytes + length > size):
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, start, n_rows, n_bytes = [], i, 0, 0
            n_rows += 1
            n_bytes += length
        if start < len(lengths):
            held.append(batch.slice(start))
    if n_rows:
        yield pa.Table.from_batches(held)


def block_ids() -> Iterator[int]:
    """Ids for the blocks of this task: equal again when the task runs again."""
    context = TaskContext.get()
    first = (context.partitionId() if context else 0) << 32
    return iter(range(first, first + (1 << 32)))


def to_batches(columns: dict, schema: pa.Schema, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_pydict(columns, schema=schema).to_batches(max_chunksize=rows)


def release() -> None:
    """Gives memory that a task is done with back to the system: a Python worker lives on, and so would its peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


@functools.cache
def word_tokenizer(path: str):
    """The public tokenizer of a file, once per Python worker, neither cutting nor padding."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
