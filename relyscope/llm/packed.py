"""Rows of numbers that cross a shuffle packed, many of a part a row.

Spark handles every row of a shuffle on its own; for short rows this costs more than
what they hold. A packed row has the number of its part and, column by column, the bytes
of all rows that a batch deals to the part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import by_value
from .wordseq import mixed

by_value(__name__)


def pack_rows(rows: dict[str, np.ndarray], kinds: dict[str, type], keys: np.ndarray, deals: int) -> pa.RecordBatch:
    """``deal`` and the columns of ``kinds`` as bytes, a row a part; rows of one key (uint64)
    are of one of ``deals`` parts."""
    deal = (mixed(keys * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(deals)).astype(np.uint16)
    order = np.argsort(deal, kind="stable")
    n = np.bincount(deal, minlength=deals)
    own = np.flatnonzero(n)
    ends = np.append(0, np.cumsum(n[own])).astype(np.int32)
    columns = [pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends * np.int32(x.itemsize)), pa.py_buffer(x)])
               for x in (rows[c].astype(k, copy=False)[order] for c, k in kinds.items())]
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *columns], ["deal", *kinds])


def packed_schema(kinds: dict[str, type]) -> str:
    return ", ".join(["deal int", *(f"{c} binary" for c in kinds)])


def numbers(column: pa.Array, kind: type) -> np.ndarray:
    """A column of numbers, packed or not."""
    if not pa.types.is_binary(column.type):
        return column.to_numpy()
    if not len(column):
        return np.empty(0, kind)
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].copy().view(kind)
