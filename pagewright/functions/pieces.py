"""Python functions of a row's values as column functions that hold few rows' results at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Rows and characters of text of which results are held as Python objects before they become Arrow arrays.
ROWS, SIZE = 256, 1 << 18


def _values(columns: tuple[pa.Array, ...]) -> Iterator[tuple]:
    for lo in range(0, len(columns[0]), ROWS):
        yield from zip(*(c.slice(lo, ROWS).to_pylist() for c in columns), strict=True)


def pieces(one: Callable, columns: tuple[pa.Array, ...], kind: pa.DataType) -> Iterator[pa.Array]:
    """What one makes of each row of the columns, in arrays of at most ROWS rows, each ended by the row with which its texts reach SIZE characters."""
    made, size = [], 0
    for values in _values(columns):
        made.append(one(*values))
        size += sum(len(x) for x in values if isinstance(x, str))
        if len(made) == ROWS or size >= SIZE:
            yield pa.array(made, kind)
            made, size = [], 0
    if made:
        yield pa.array(made, kind)


def by_pieces(one: Callable, kind: str) -> Callable[..., Column]:
    """one, from the values of a row to a value of the kind (dicts for structs, pairs for maps), as a function of columns.

    An Arrow batch has 10000 rows, and nested results as Python objects take some hundred times their texts; here only a
    piece of a batch is held as such, and goes on as an array of its own.
    """

    def of(*columns: str | Column) -> Column:
        arrow = to_arrow_type(DataType.fromDDL(kind))

        def work(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                yield from pieces(one, batch if isinstance(batch, tuple) else (batch,), arrow)

        return F.arrow_udf(work, kind)(*columns)

    return of
