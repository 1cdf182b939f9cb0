"""Rows packed into blocks of bounded text, so that one task can hold a block and no more."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa


def trim() -> None:
    """Gives freed memory back: workers are reused, and what they hold counts for the executor."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpack(payload: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p.as_py()).read_all() for p in payload]).combine_chunks()


def blocks(parts: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[pa.Table]:
    """Tables of rows in order whose texts (column ``text``) come to ``size`` characters; a longer text ends its block."""
    held, total = [], 0
    for part in parts:
        begin = 0
        for i, t in enumerate(part.column(text).to_pylist()):
            total += len(t or "") + 1
            if total >= size:
                held.append(part.slice(begin, i + 1 - begin))
                yield pa.Table.from_batches(held).combine_chunks()
                held, total, begin = [], 0, i + 1
                trim()
        if begin < part.num_rows:
            held.append(part.slice(begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
