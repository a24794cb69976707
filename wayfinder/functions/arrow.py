"""Arrow batches of a sorted partition as groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches, keys: tuple[str, ...]) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """(key, table) for each run of rows with equal long `keys`, in a partition sorted by them."""
    now, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        values = np.stack([t.column(c).to_numpy() for c in keys])
        cut = np.concatenate([[0], np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1, [t.num_rows]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            key = tuple(values[:, a].tolist())
            if key != now:
                if parts:
                    yield now, pa.concat_tables(parts)
                now, parts = key, []
            parts.append(t.slice(a, b - a))
    if parts:
        yield now, pa.concat_tables(parts)
