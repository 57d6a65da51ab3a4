"""Rules that need the rows of one case in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def by_case(rows: DataFrame, case: list[str], order: list[Column], rule: Callable[[list[tuple]], list[tuple]], schema: T.StructType | str) -> DataFrame:
    """What ``rule`` makes of the rows of each case, given as tuples in order; its results are rows of ``schema``.

    Values are plain Python ones: whole numbers are exact whatever their size, and null is None. A row with null in a column of the case
    belongs to no case and is left out, as a join on the case leaves it out.

    The engine deals cases out and sorts them; a task streams over its rows and holds one case at a
    time, so many small cases cost no call each and a task's memory is one case.
    """
    at = [rows.columns.index(c) for c in case]
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(schema)
        key, held = None, []

        def made(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * len(shape)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = tuple(v if v == v else "nan" for v in (row[i] for i in at))
                if own != key:
                    if held:
                        out += rule(held)
                    key, held = own, []
                held.append(row)
            if out:
                yield made(out)
        if held and (out := rule(held)):
            yield made(out)

    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in case])
    # by a hash of the case: an exchange by the case itself would be left out where the input seems to be dealt
    # so already, and adaptive execution may then read that input in pieces that split a case
    return rows.filter(whole).repartition(F.xxhash64(*case)).sortWithinPartitions(*case, *order).mapInArrow(run, schema)
