"""Order-dependent jobs as sweeps: a group's rows stream through a small state.

For steps whose outcome depends on what earlier rows led to, and which no window
or join expresses. A group's rows come in order to one task; what is held is the
state of the sweep (the rows still open), never the group. Groups are dealt out
by their key like those of any grouping.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def swept(df: DataFrame, keys: list[str], order: list[str], start: Callable, out: str) -> DataFrame:
    """Rows (keys, out) that a sweep gives for each group of `df`.

    `start()` makes the state of a group. Its add(*values) gets the columns
    behind the keys of one row after the other, its end() comes after the last;
    both give tuples of the columns of `out`.
    """
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    schema, n = f"{kept}, {out}", len(keys)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    picked = ordered.select(*keys, *[c for c in df.columns if c not in keys])

    def run(batches):
        import pyarrow as pa

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        state = key = None
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or row[:n] != key:
                    if state is not None:
                        rows += [(*key, *x) for x in state.end()]
                    state, key = start(), row[:n]
                rows += [(*key, *x) for x in state.add(*row[n:])]
            if rows:
                yield packed(rows)
        if state is not None and (rows := [(*key, *x) for x in state.end()]):
            yield packed(rows)

    return picked.mapInArrow(run, schema)
