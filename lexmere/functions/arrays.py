"""Functions of number arrays that higher-order functions cannot do in linear time: a fold copies its state at every element."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(lists: pa.Array) -> np.ndarray:
    """Where each list of a batch begins and ends in its flat values; null lists are empty."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])


def _sums(lists: pa.Array) -> pa.Array:
    ends = _edges(lists)
    total = np.concatenate([[0], np.cumsum(pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    # each list's own sums: those of the batch less what stands before the list
    before = np.repeat(total[ends[:-1]], np.diff(ends))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(total[1:] - before))


def running_sums(numbers: Column) -> Column:
    """Sums of an array's numbers up to each one, itself included, as array<bigint>; nulls count as 0, null arrays as empty."""
    return F.arrow_udf(_sums, "array<bigint>")(numbers)
