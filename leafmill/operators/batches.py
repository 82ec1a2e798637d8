"""Groups of rows in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal numbers for equal values of a column, nulls too."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.dictionary_encode(null_encoding="encode").indices.to_numpy()


def fresh(rows: pa.Table, by: list[str]) -> np.ndarray:
    """Whether a row has another group than the one before; not so for the first."""
    out = np.zeros(rows.num_rows, bool)
    for c in by:
        out[1:] |= np.diff(codes(rows.column(c))) != 0
    return out


def whole_groups(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches whose rows are sorted by group."""
    open_: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        goes_on = bool(open_) and all(rows.column(c)[0] == open_[-1].column(c)[-1] for c in by)
        cut = np.flatnonzero(fresh(rows, by))
        at = int(cut[-1]) if len(cut) else 0
        if open_ and (at or not goes_on):
            yield pa.concat_tables([*open_, rows.slice(0, at)])
            open_ = []
        elif at:
            yield rows.slice(0, at)
        open_.append(rows.slice(at))
    if open_:
        yield pa.concat_tables(open_)
