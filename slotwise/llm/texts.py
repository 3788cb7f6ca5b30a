"""Running a per-text function inside Spark tasks, in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: UTF-8 bytes of text handed to a work function at once (a longer text goes alone).
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` whose texts sum to ``limit`` bytes at most, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def annotate(df: DataFrame, text: str, keep: list[str], found: str, make: Callable[[], Callable], limit: int = SLICE_BYTES) -> DataFrame:
    """Columns ``row`` (struct of the ``keep`` columns) and those of the DDL ``found``.

    ``make()`` is called once per task and returns ``work(texts) -> {name: list}``
    with one value per text; a null text reaches it as None.  The kept columns
    stay in Arrow, so any column type and any column name passes through.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    fields = T.StructType.fromDDL(found).fields
    schema = T.StructType([packed.schema["row"], *fields])
    names = ["row", *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        types = [to_arrow_type(f.dataType, timestamp_utc=True) for f in fields]
        for batch in batches:
            for part in slices(batch, 1, limit):
                out = work(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(out[f.name], t) for f, t in zip(fields, types)]], names=names)

    return packed.mapInArrow(run, schema)


def share(*columns) -> F.Column:
    """A reproducible number in [0, 1) from the hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def crc_of(column: str) -> F.Column:
    return F.crc32(F.col(f"`{column}`").cast("string"))
