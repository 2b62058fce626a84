"""Row-wise Arrow maps over a text column, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fathomix.llm.textbytes import SLICE_BYTES, slices

#: Gets the texts of a slice and returns one list or array for each new field.
TextFunction = Callable[[pa.Array], list]


def map_text(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], TextFunction], keep: list[str], max_bytes: int = SLICE_BYTES) -> DataFrame:
    """The columns ``keep`` of df and the new fields, computed from the column ``text`` row by row.

    A kept column with the name of a new field gives way to it.  ``make`` runs once in each task and returns the function for its slices.  No shuffle; memory is
    bounded by ``max_bytes`` or the longest text.
    """
    kept = [f for f in df.schema.fields if f.name in keep and f.name not in {x.name for x in fields}]
    schema = T.StructType([*kept, *fields])
    arrow = to_arrow_schema(T.StructType(fields))
    names = [f.name for f in kept]

    def run(batches):
        np.seterr(over="ignore")
        f = make()
        for batch in batches:
            for part in slices(batch, text, max_bytes):
                new = [x if isinstance(x, pa.Array) else pa.array(x, type=t.type) for x, t in zip(f(part.column(text)), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *new], names=[*names, *arrow.names])

    return df.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)
