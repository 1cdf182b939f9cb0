"""Groups of adjacent rows in a stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, from batches that are sorted by the keys (no nulls in them)."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        if not part.num_rows:
            continue
        columns = [part[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(part.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        if held:
            before = held[-1]
            change[0] = any(before[k][before.num_rows - 1].as_py() != part[k][0].as_py() for k in keys)
        cuts = np.flatnonzero(change).tolist()
        begin = 0
        for c in cuts:
            if c > begin:
                held.append(part.slice(begin, c - begin))
            if held:
                yield pa.Table.from_batches(held)
            held, begin = [], c
        held.append(part.slice(begin))
    if held:
        yield pa.Table.from_batches(held)
