"""Tables in the shared folder, and Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

from lintlake.sources.stored import BATCH_BYTES, dropped, shared_dir, written

__all__ = ["dropped", "in_small_batches", "shared_dir", "written"]


def in_small_batches(batches: Iterator[pa.RecordBatch], column: str = "_raw", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in batches whose `column` has about `most` bytes, or one row, at most."""
    for batch in batches:
        low, held = 0, 0
        for k, size in enumerate(pc.binary_length(batch[column]).to_pylist()):
            if held and held + size > most:
                yield batch.slice(low, k - low)
                low, held = k, 0
            held += size
        if low < batch.num_rows:
            yield batch.slice(low)
