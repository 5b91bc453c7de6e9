"""Findings of a Python function as rows: texts pass one at a time, results leave as columns in bounded batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

#: Findings after which a batch leaves the task.
FINDINGS = 20_000


def found_rows(rows: DataFrame, keys: list[str], inputs: list[Column], columns: str, find: Callable) -> DataFrame:
    """``keys`` of every row with each of the tuples that ``find`` gives for the row's ``inputs``, under the names of ``columns``.

    Neither Python texts nor results of a whole Arrow batch are held at once.
    """
    own = rows.select(*keys).schema
    schema = StructType(own.fields + StructType.fromDDL(columns).fields)
    n, names = len(keys), schema.fieldNames()

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema.fields[n:]]

        def made(batch, at, out):
            held = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(n)]
            return pa.RecordBatch.from_arrays([*held, *[pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types)]], names)

        for batch in batches:
            at, out = [], []
            for i, row in enumerate(zip(*[batch.column(j) for j in range(n, batch.num_columns)])):
                hits = find(*[x.as_py() for x in row])
                if hits:
                    out += hits
                    at += [i] * len(hits)
                    if len(at) >= FINDINGS:
                        yield made(batch, at, out)
                        at, out = [], []
            yield made(batch, at, out)

    return rows.select(*keys, *[c.alias(f"_input{i}") for i, c in enumerate(inputs)]).mapInArrow(run, schema)
