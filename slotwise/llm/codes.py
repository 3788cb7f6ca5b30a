"""Vector code compression: product codes by Lloyd rounds that look again only at entries that moved.

A vector is cut into ``PARTS`` equal parts, each with a codebook of its own.
The first assignment compares every part with every entry and stores the exact
squared distance of the nearest.  After a round's update, a part whose assigned
entry stayed fixed keeps that distance as true, and since the other fixed
entries lost against it before, only moved entries are compared with it; a part
whose entry moved is compared with all entries again.  Ties go to the lower
index in both cases, so codes equal those of full comparisons.

Sums and counts of the parts of an entry are formed in the tasks and added by a
grouped sum; the codebooks (``PARTS`` times ``ENTRIES`` entries) are updated on the
driver and sent to the tasks.  Assignments are written after each round.

Cases: vectors that are null or hold null or non-finite components are dropped;
shorter vectors, and lengths that do not divide, count as if followed by zeros;
of equal ids the smaller vector comes first among the first entries, null ids
come last; fewer vectors than ``ENTRIES`` make smaller codebooks, none give no
rows; components beyond ``sqrt(2^60 / length)`` are held there, so that errors fit
64 bits; null labels are one label; label sums beyond 64 bits are held at the limit.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.stored import Folder

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Rows compared at once within a batch.
STRIP = 4096
_LIMIT = 2 ** 63 - 1


def prepared(vectors: DataFrame, keep: list[str], vector: str) -> DataFrame:
    """``row`` (the kept columns) and the integer components ``v`` of the vectors that take part."""
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))), F.lit(False)))
    return (vectors.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{vector}`").alias("x")).filter(F.col("x").isNotNull() & finite)
            .select("row", F.transform("x", lambda c: F.floor(c.cast("double") * SCALE)).alias("v")))


def parts_of(column: pa.ListArray, width: int, limit: int) -> np.ndarray:
    """The vectors of a list column as (row, part, component)."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes, whole = np.diff(offsets), PARTS * width
    out = np.zeros((len(sizes), whole), dtype=np.int64)
    if len(sizes) and (sizes == whole).all():
        out[:] = values[offsets[0]:offsets[-1]].reshape(-1, whole)
    elif len(sizes):
        at = np.repeat(np.arange(len(sizes)), sizes)
        out[at, np.arange(offsets[0], offsets[-1]) - offsets[:-1][at]] = values[offsets[0]:offsets[-1]]
    return np.clip(out, -limit, limit).reshape(-1, PARTS, width)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (row, entry) of the rows of ``x`` to the rows of ``entries``."""
    out = np.zeros((len(x), len(entries)), dtype=np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - entries[None, :, j]) ** 2
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lowest index of equal ones, and its squared distance."""
    if not len(x):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    d = distances(x, entries)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(x)), code]


def reassigned(x: np.ndarray, code: np.ndarray, error: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The assignment of rows that had ``code`` and ``error`` before the entries marked ``moved`` took their new values."""
    active = np.flatnonzero(moved)
    if not len(active):
        return code, error
    stale = moved[code]
    fixed, rest = np.flatnonzero(~stale), np.flatnonzero(stale)
    code, error = code.copy(), error.copy()
    at, d = nearest(x[fixed], entries[active])
    rival = active[at]
    better = (d < error[fixed]) | ((d == error[fixed]) & (rival < code[fixed]))
    code[fixed[better]], error[fixed[better]] = rival[better], d[better]
    code[rest], error[rest] = nearest(x[rest], entries)
    return code, error


def _assign(table: DataFrame, books: np.ndarray, moved: np.ndarray | None, limit: int) -> DataFrame:
    """``table`` with ``code`` and ``errors`` for the codebooks; those of the round before are used where ``moved`` tells what changed."""
    shared = table.sparkSession.sparkContext.broadcast((books, moved))
    schema = T.StructType([table.schema["row"], table.schema["v"], *T.StructType.fromDDL("code binary, errors array<bigint>").fields])

    def run(batches):
        entries, changed = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, STRIP):
                rows = batch.slice(start, STRIP)
                x = parts_of(rows.column(1), entries.shape[2], limit)
                code, error = np.zeros((len(x), PARTS), dtype=np.int64), np.zeros((len(x), PARTS), dtype=np.int64)
                if changed is not None:
                    code[:] = np.frombuffer(b"".join(rows.column(2).to_pylist()), dtype=np.uint8).reshape(-1, PARTS)
                    error[:] = rows.column(3).flatten().to_numpy().reshape(-1, PARTS)
                for p in range(PARTS):
                    code[:, p], error[:, p] = nearest(x[:, p], entries[p]) if changed is None else reassigned(x[:, p], code[:, p], error[:, p], entries[p], changed[p])
                packed = code.astype(np.uint8)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([r.tobytes() for r in packed], pa.binary()),
                                                  pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * PARTS), pa.array(error.ravel()))], names=schema.names)

    return table.mapInArrow(run, schema)


def _updated(assigned: DataFrame, books: np.ndarray, limit: int) -> np.ndarray:
    """Each entry as the floor of its parts' mean; an entry without parts stays."""
    parts, entries, width = books.shape

    def run(batches):
        n, sums = np.zeros(parts * entries, dtype=np.int64), np.zeros((parts * entries, width), dtype=np.int64)
        for batch in batches:
            x = parts_of(batch.column(0), width, limit).reshape(-1, width)
            at = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).astype(np.int64) + np.tile(np.arange(parts) * entries, batch.num_rows)
            n += np.bincount(at, minlength=len(n))
            # A batch's sums stay far below 2^53.
            for j in range(width):
                sums[:, j] += np.bincount(at, weights=x[:, j], minlength=len(n)).astype(np.int64)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["entry", "n", "sums"])

    partial = assigned.select("v", "code").mapInArrow(run, "entry bigint, n bigint, sums array<bigint>")
    total = partial.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)])
    new = books.reshape(-1, width).copy()
    # One row per entry of the codebooks.
    for entry, n, *sums in total.collect():
        new[entry] = [int(s) // n for s in sums]
    return new.reshape(books.shape)


def encode(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``row`` (the kept columns), ``code`` (one byte per part) and ``errors`` (squared distance per part), and the codebooks (part, entry, component).

    The codebooks start as the parts of the vectors with the smallest ids.
    """
    keep = list(dict.fromkeys([*(keep or vectors.columns), key]))
    table = prepared(vectors, keep, vector)
    longest = table.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return table.select("row", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("array<bigint>").alias("errors")), np.zeros((PARTS, 0, 1), dtype=np.int64)
    width = max(1, -(-longest // PARTS))
    limit = isqrt(2 ** 60 // (PARTS * width))
    first = table.orderBy(F.col(f"row.`{key}`").asc_nulls_last(), "v").limit(ENTRIES).select("v").toArrow()
    books = parts_of(pa.concat_arrays(first.column("v").chunks), width, limit).transpose(1, 0, 2)
    folder = Folder(vectors.sparkSession, "codes")
    state = folder.write(_assign(table, books, None, limit))
    for _ in range(rounds):
        new = _updated(state, books, limit)
        moved = (new != books).any(axis=2)
        before, books = state, new
        state = folder.write(_assign(before, books, moved, limit))
        folder.discard(before)
    return state.drop("v"), books


def with_label_sums(errors: DataFrame, label: str, error: str, name: str) -> DataFrame:
    """``errors`` with the sum of ``error`` over equal labels, nulls together."""
    sums = errors.groupBy(F.col(label).alias("_label")).agg(F.least(F.sum(F.col(error).cast("decimal(38,0)")), F.lit(_LIMIT)).cast("bigint").alias(name))
    return errors.join(sums, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
