"""Sequential state along each key, without ever holding a key's rows together."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def scan(df: DataFrame, keys: list[str], order: list[str], reads: list[str], begin: Callable[[], object], step: Callable, added: T.StructType) -> DataFrame:
    """Adds ``added`` columns by running ``step(state, *reads) -> (state, values)`` along each key.

    Rows are dealt by key and sorted; batches stream through, and only the current key's state is
    held, so keys of any length fit. ``step`` may return no values to drop a row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = T.StructType([*df.schema.fields, *added.fields])
    arrow = to_arrow_schema(added)

    def run(batches):
        current, state = None, None
        for batch in batches:
            key_rows = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys)))
            read_rows = zip(*(batch.column(batch.schema.get_field_index(r)).to_pylist() for r in reads))
            keep, made = [], []
            for key, row in zip(key_rows, read_rows):
                if key != current:
                    current, state = key, begin()
                state, values = step(state, *row)
                keep.append(values is not None)
                if values is not None:
                    made.append(values)
            rows = batch if all(keep) else batch.filter(pa.array(keep))
            columns = list(zip(*made)) or [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c, f.type) for c, f in zip(columns, arrow))], names=shape.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, shape)


def emit(df: DataFrame, keys: list[str], order: list[str], reads: list[str], begin: Callable[[], object], step: Callable, finish: Callable, added: T.StructType) -> DataFrame:
    """Rows of ``keys`` and ``added`` that ``step(state, *reads) -> (state, rows)`` makes along each key.

    ``finish(state)`` gives the rows left at a key's end. Held at a time is one key's state.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = T.StructType([*[df.schema[k] for k in keys], *added.fields])
    schema = to_arrow_schema(shape)

    def run(batches):
        current, state, started = None, None, False

        def table(rows):
            columns = list(zip(*rows)) or [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            key_rows = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys)))
            out = []
            for key, row in zip(key_rows, zip(*(batch.column(batch.schema.get_field_index(r)).to_pylist() for r in reads))):
                if not started or key != current:
                    if started:
                        out += [(*current, *r) for r in finish(state)]
                    current, state, started = key, begin(), True
                state, rows = step(state, *row)
                out += [(*key, *r) for r in rows]
            yield table(out)
        if started:
            yield table([(*current, *r) for r in finish(state)])

    wanted = list(dict.fromkeys([*keys, *order, *reads]))
    return df.select(*wanted).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, shape)
