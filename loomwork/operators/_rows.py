"""Folds of Python code over one column, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that is given back.
ROWS = 2000
#: Bytes of text that are worked on at once.
BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: str, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and ``size`` bytes in a text column; a longer text is a
    part of its own. What is made from a part is given back before the next, so a task's memory doesn't
    grow with the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        to = max(at + 1, min(at + rows, fits))
        yield batch.slice(at, to - at)
        at = to


def per_row(docs: DataFrame, column: str, fold: Callable[[str], Iterator[tuple]], schema: str, ordinal: bool = True) -> DataFrame:
    """Rows of a fold over one string column, numbered first if ``ordinal``, beside the row's other
    columns. The column itself isn't repeated."""
    names, place = [n for n in docs.columns if n != column], docs.columns.index(column)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(names)
            found: list[tuple] = []

            def out(kept: pa.RecordBatch = kept, found: list[tuple] = found) -> pa.RecordBatch:
                rows, *rest = zip(*found)
                found.clear()
                return pa.RecordBatch.from_arrays([*kept.take(pa.array(rows)).columns, *(pa.array(list(c), f.type) for c, f in zip(rest, target))], [*names, *target.names])

            for k, value in enumerate(batch.column(place)):
                if text := value.as_py():
                    for i, x in enumerate(fold(text)):
                        found.append((k, i, *x) if ordinal else (k, *x))
                        if len(found) >= ROWS:
                            yield out()
            if found:
                yield out()

    held = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != column)
    return docs.mapInArrow(work, f"{held}{schema}")
