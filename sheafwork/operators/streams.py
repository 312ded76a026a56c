"""Folds over sorted rows whose state is carried from row to row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

Step = Callable[[dict], dict | None]


def fold_sorted(frame: DataFrame, by: Sequence[str], order: Sequence[str], begin: Callable[[], Step], schema: StructType) -> DataFrame:
    """The rows that each group's step gives for the group's rows in order.

    ``begin`` makes a group's step, which keeps the state; a row for which it
    gives None goes.  Rows are sorted by Spark, which spills, and come in
    batches, so a worker holds a batch and one state, however large a group.
    ``by`` and the columns of ``schema`` must be in what ``step`` returns.
    """
    schema = StructType([StructField(f.name, f.dataType, True) for f in schema])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = tuple(row[c] for c in by)
                if step is None or own != key:
                    key, step = own, begin()
                made = step(row)
                if made is not None:
                    out.append(made)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return frame.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
