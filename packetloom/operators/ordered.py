"""Running a recurrence over each key's rows in order, as a stream through sorted partitions.

Rows are partitioned by key and sorted within partitions, so a task holds one key's state at a time and never a
key's rows, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def plain(column: pa.Array) -> list:
    """A column's values as Python objects, at once where their kind allows it."""
    if column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_boolean(column.type) or pa.types.is_string(column.type)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def walk(rows: DataFrame, key: list[str], order: list[str], make: Callable[[], object], schema: T.StructType, partitions: int | None = None) -> DataFrame:
    """make() gives a key's fresh state: an object with add(row) and finish(), which return lists of output tuples
    (without the key) for the row just added and for the end of the key. schema: the key's columns, then theirs. partitions: how many tasks, where their rows have to stay few."""
    sorted_rows = (rows.repartition(partitions, *key) if partitions else rows.repartition(*key)).sortWithinPartitions(*key, *order)
    names = rows.columns
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def pack(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []
        for batch in batches:
            for values in zip(*map(plain, batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                k = tuple([row[c] for c in key])
                if state is None or k != current:
                    if state is not None:
                        out += [current + x for x in state.finish()]
                    current, state = k, make()
                out += [k + x for x in state.add(row)]
                if len(out) >= 4096:
                    yield pack(out)
                    out = []
        if state is not None:
            out += [current + x for x in state.finish()]
        if out:
            yield pack(out)

    assert set(key) <= set(names)
    return sorted_rows.mapInArrow(run, schema)
