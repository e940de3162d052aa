"""Tables read beside the blocks of a stored table.

A block is ``BLOCK`` consecutive rows of one file. Passes over the documents first reduce what
they find to one row per block and key, so that no key has more rows than there are blocks; what a join
of these rows brings back is stored by block, and the next pass over the documents loads it block by
block. The documents themselves are never shuffled, and a task holds one block's rows at a time.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from ..functions.scratch import scratch_folder
from .common import free_name, numbered, stored

BLOCK = 1 << 14


def blocks(docs: DataFrame, columns: dict[str, F.Column]) -> DataFrame:
    """``columns`` and the place of every row: _file, _block (within the file), _at (the row in the file)."""
    docs = stored(docs)
    name = free_name(docs, "_row")
    place = F.col(name)
    return numbered(docs, name).select(
        place["file"].alias("_file"), block_of(place), place["at"].alias("_at"), *[c.alias(n) for n, c in columns.items()])


def block_of(place: F.Column) -> F.Column:
    return (place["at"] / BLOCK).cast("long").cast("int").alias("_block")


def runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Slices of at most ``rows`` rows that lie in one block each."""
    for batch in batches:
        files, numbers = batch.column("_file").to_pylist(), batch.column("_block").to_pylist()
        at = 0
        while at < batch.num_rows:
            to = at + 1
            while to < batch.num_rows and to - at < rows and files[to] == files[at] and numbers[to] == numbers[at]:
                to += 1
            yield (files[at], numbers[at]), batch.slice(at, to - at)
            at = to
    tidy()


def tidy() -> None:
    """Give freed memory back: workers live on after a task, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def store(table: DataFrame) -> str:
    """Write ``table`` (with _file and _block) by block; the folder for ``beside``."""
    path = scratch_folder(table.sparkSession)
    named = table.withColumnsRenamed({"_file": "file", "_block": "block"})
    named.repartition("file", "block").write.partitionBy("file", "block").parquet(path)
    return path


def beside(folder: str, schema: pa.Schema) -> Callable[[tuple[int, int]], pa.Table]:
    """A loader of a block's rows for use inside a task; the last block asked for is held.

    The folder is opened through pyarrow's file systems: local or mounted folders, HDFS, S3, GCS.
    """
    last: list = [None, None]

    def load(block: tuple[int, int]) -> pa.Table:
        if last[0] != block:
            system, root = filesystem(folder)
            place = pyarrow.fs.FileSelector(f"{root}/file={block[0]}/block={block[1]}", allow_not_found=True)
            names = [x.path for x in system.get_file_info(place) if x.path.endswith(".parquet")]
            parts = [pq.read_table(system.open_input_file(x), columns=schema.names).cast(schema) for x in names]
            last[:] = block, pa.concat_tables([schema.empty_table(), *parts])
        return last[1]
    return load


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)
