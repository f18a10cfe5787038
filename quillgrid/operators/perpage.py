"""Walks over the rows of one page (or another small group) at a time, many pages a task."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def with_field(rows: DataFrame, name: str, kind: str) -> StructType:
    """The schema of rows and one more column."""
    return StructType([*rows.schema.fields, StructField(name, _parse_datatype_string(kind))])


def per_page(rows: DataFrame, page: list[str], order: list[str], schema: StructType, work: Callable[[dict[str, list]], list[tuple]]) -> DataFrame:
    """What `work` makes of each page's columns (lists, in the order given): rows of `schema`.

    One shuffle by the page's columns; a task reads its pages one after the other from sorted batches and holds one page besides a batch.
    """
    out_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def finish(made: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) if made else [()] * len(out_schema)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

        def one() -> list[tuple]:
            return work(pa.Table.from_batches(held).to_pydict())

        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in page), strict=True))
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            made: list[tuple] = []
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and keys[a] != last:
                    made += one()
                    held = []
                held.append(batch.slice(a, b - a))
                last = keys[a]
            if made:
                yield finish(made)
        if held:
            yield finish(one())

    return rows.repartition(*page).sortWithinPartitions(*page, *order).mapInArrow(run, schema)
