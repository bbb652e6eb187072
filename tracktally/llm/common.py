"""Pieces that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracktally.session import shared_path

#: Characters of text that a vectorised step takes at once, whatever the Arrow batch holds.
CHUNK_CHARS = 2_000_000
#: Bytes of an Arrow batch that are made Python objects at once.
SLICE_BYTES = 4_000_000


def exact(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def add_columns(
    df: DataFrame, inputs: Sequence[str], fields: str, make: Callable[[], Callable[..., list]]
) -> DataFrame:
    """``df`` with the columns of the DDL string ``fields``, computed batch by batch.

    ``make()`` runs once in a task and gives a function from the Arrow arrays of
    ``inputs`` to one array or list for each new column. Nothing is shuffled. A column
    of ``df`` whose name (in any case) is that of a new one is replaced by it.
    """
    new = T.StructType.fromDDL(fields)
    taken = {f.name.lower() for f in new}
    kept = [c for c in df.columns if c.lower() not in taken]
    sent = [*kept, *(c for c in inputs if c not in kept)]
    at = [sent.index(c) for c in inputs]
    # plain names on the way: names with dots can't be sent
    carried = df.select(*[exact(c).alias(f"c{i}") for i, c in enumerate(sent)])
    types = [f.type for f in to_arrow_schema(new)]
    n_kept = len(kept)
    names = [f"c{i}" for i in range(n_kept + len(new))]
    out = [*carried.schema.fields[:n_kept], *new.fields]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, out, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in slices(batches):
            made = step(*[batch.column(i) for i in at])
            made = [x if isinstance(x, pa.Array) and x.type == t else pa.array(x, t) for x, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n_kept)] + made, names=names)

    return carried.mapInArrow(run, schema).toDF(*kept, *(f.name for f in new))


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes, so that few texts are Python objects at once."""
    for batch in batches:
        rows = max(1, min(batch.num_rows, batch.num_rows * most // max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts_of(array: pa.Array) -> list[str]:
    """Python strings; NULL is the empty text."""
    return [t or "" for t in array.to_pylist()]


def chunks(lengths: Sequence[int], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` characters; a longer text is a range of its own."""
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
