"""Groups of rows inside tasks, from rows that Spark has dealt out and sorted by their key."""

from __future__ import annotations

import numpy as np


def sorted_groups(batches, keys: list[str]):
    """Tables of equal ``keys`` (integers without nulls) from batches sorted by them. Only one
    group and one batch are held at a time."""
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        columns = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(table.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        borders = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(borders, borders[1:]):
            yield table.slice(a, b - a)
        held = table.slice(borders[-1])
    if held is not None:
        yield held


def matrix(column, kind: str, width: int) -> np.ndarray:
    """Binary values of equal length as the rows of an array."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)
