"""Arrow batches in small slices, for tasks that make far more of a row than they read.

A batch has up to 10,000 rows whatever their size; what a task makes of a slice is given on before the next is taken up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of text of a slice; a longer row is a slice of its own.
ROWS, BYTES = 256, 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices that hold up to ROWS rows and BYTES bytes of a text column."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for k, n in enumerate(sizes):
            if k > start and (k - start == ROWS or held + n > BYTES):
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
