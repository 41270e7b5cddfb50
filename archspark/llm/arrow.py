"""Row functions over Arrow batches, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Input bytes after which a batch of results is handed over.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES each, a longer row by itself."""
    step = max(1, int(SLICE_BYTES * batch.num_rows / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterator[tuple]]]) -> DataFrame:
    """make() runs once a task and gives a function from a row's values to result tuples."""
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            for part in slices(batch):
                out = [x for values in zip(*(c.to_pylist() for c in part.columns), strict=True) for x in row(*values)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)
