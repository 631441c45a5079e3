"""Raw UTF-8 bytes of an Arrow string column, and offsets in them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text handled at once; a batch of long texts is cut into slices of about this size.
SLICE_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that ``column`` holds about SLICE_BYTES; a longer text stays whole."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right")))
            yield batch.slice(start, end - start)
            start = end


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as bytes; null as empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in col]


def joined(batch: pa.RecordBatch, column: str) -> tuple[bytes, np.ndarray]:
    """All texts of the column end to end, and the n + 1 places where they start and end."""
    parts = texts(batch, column)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    return b"".join(parts), np.concatenate((np.zeros(1, np.int64), ends))


def code_points(text: bytes) -> np.ndarray:
    """For each byte offset (0 to the length), the code points before it."""
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(lead)))


def map_rows(df: DataFrame, column: str, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """``df.mapInArrow`` over slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            if (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)
