"""Arrow batches in bounded parts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

ROWS, BYTES = 512, 1 << 22


def parts(batches: Iterable[pa.RecordBatch], rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in parts of at most ``rows`` rows and about
    ``most`` bytes, so that what a task makes of a part stays small; one row is
    never cut."""
    for b in batches:
        size = max(1, min(rows, b.num_rows * most // max(1, b.nbytes)))
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)
