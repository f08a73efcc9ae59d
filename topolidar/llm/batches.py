"""Text columns of Arrow batches as flat byte buffers, and pieces of batches bounded by bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of text that one vectorised step holds at most, unless a single text is longer.
SLICE_BYTES = 4 << 20


def text_table(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only the two columns that an operator reads, as doc_id and text: columns of other names can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; a null counts as empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"" if kind == pa.large_binary() else "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def texts(column: pa.Array) -> list[bytes]:
    offsets, data = buffers(column)
    whole, ends = data.tobytes(), offsets.tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in pieces of at most ``most`` bytes of text or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, before = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


def map_texts(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], pa.RecordBatch], id_col: str, text_col: str, keep: Sequence[str] = (), most: int = SLICE_BYTES) -> DataFrame:
    """``step`` over bounded pieces (doc_id, text) of every Arrow batch: one pass, no shuffle, memory bounded by a piece. It
    gives ``schema``, a row for each of the piece's; the columns in ``keep`` follow, as they are."""
    carried = [F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)]
    rows = text_table(df, id_col, text_col, *carried)
    made = _parse_datatype_string(schema).fields
    out = StructType([*made, *(f for f in rows.schema.fields if f.name.startswith("keep_"))])

    names, n = out.names, len(carried)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for piece in slices(batch, "text", most):
                own = step(piece)
                yield pa.RecordBatch.from_arrays([*own.columns, *(piece.column(f"keep_{i}") for i in range(n))], names=names)

    return rows.mapInArrow(run, out).select(*(f.name for f in made), *(F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)))
