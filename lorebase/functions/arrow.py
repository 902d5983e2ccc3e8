"""Arrow-batched Python functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows, and bytes of their arguments, that are Python objects at once.
SLICE_ROWS = 256
SLICE_BYTES = 1 << 20


def arrow_function(returns: T.DataType) -> Callable:
    """A function of Pandas series that the optimizer neither repeats nor pushes around.

    A batch comes and goes as Arrow arrays; only a slice of its rows is held as Python
    objects at a time, so a task's memory does not grow with how full its batches are.

    Python work and model calls are the expensive part of a plan. Declared
    deterministic, a filter on the result would run them once for the filter and once
    more for the projection, and a union would run them in each of its branches.
    """

    kind = to_arrow_type(returns)

    def declare(function: Callable):
        def sliced(*columns: pa.Array) -> pa.Array:
            rows, start, parts = len(columns[0]), 0, []
            while start < rows:
                length = _fitting(columns, start)
                given = [c.slice(start, length).to_pandas() for c in columns]
                parts.append(_arrow(function(*given), kind))
                start += length
            return pa.concat_arrays(parts) if parts else pa.array([], kind)

        return F.arrow_udf(sliced, returns).asNondeterministic()

    return declare


def _fitting(columns: tuple[pa.Array, ...], start: int) -> int:
    """Rows from ``start`` on that make a slice: fewer where they are large, one at least."""
    length = min(SLICE_ROWS, len(columns[0]) - start)
    while length > 1 and sum(c.slice(start, length).nbytes for c in columns) > SLICE_BYTES:
        length //= 2
    return length


def _arrow(found: pd.Series | pd.DataFrame, kind: pa.DataType) -> pa.Array:
    if isinstance(found, pd.DataFrame):
        return pa.StructArray.from_arrays([_arrow(found[f.name], f.type) for f in kind], fields=list(kind))
    return pa.array(found.tolist() if found.dtype == object else found, type=kind, from_pandas=True)
