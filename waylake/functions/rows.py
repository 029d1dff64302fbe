"""Small programs per row over nested values, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows that are Python objects at once.
BLOCK = 256


def with_program(df: DataFrame, name: str, kind: str, program: Callable, *inputs: str) -> DataFrame:
    """``df`` with a column ``name`` of SQL type ``kind``: the program's result for the row's inputs as plain Python values
    (lists, dictionaries, None). For lists of lists of any lengths, which pandas functions can't take."""
    field = StructType.fromDDL(f"{name} {kind}")[0]
    schema = StructType([*df.schema.fields, field])
    arrow = to_arrow_type(field.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, BLOCK):
                b = big.slice(at, BLOCK)
                values = [program(*row) for row in zip(*[b.column(c).to_pylist() for c in inputs])]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, arrow)], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)
