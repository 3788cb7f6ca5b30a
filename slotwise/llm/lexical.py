"""Ranked lexical search by NRA (no random access): impact-sorted lists are read in sequence under score intervals.

One pass counts, for every document, the terms that the items ask for, and
writes them.  From the corpus-wide counts each (document, term) has its integer
impact.  A shard is a run of consecutive stored documents of one task; it keeps
one list per asked term, sorted by impact.  For an item the lists are read from
the top in growing steps.  A document's lower bound is what has been read for
it; its upper bound adds, for every list it has not been met in, the last value
read there.  Reading goes on until no unread document can reach the k-th lower
bound and every document whose upper bound reaches it is fully known; lists that
none of those still needs are read no further.  Scores and ties are then exact.
The k best of the shards meet in two rankings.  The k-th score of a task's
earlier shards is the floor of its later ones.

A term's weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``; its impact in a
document is ``10^9 tf div (1000 tf + 8 m)`` with ``m = 25 + 75 n N div L``; a
score sums weight times impact over the item's terms, repeats included.

Cases: null and empty texts have no terms and count in neither N nor L; items
without terms, or whose terms no document holds, give no rows; repeated items
rank each on their own; repeated documents each take a rank, ties go to the
smaller id, null ids last; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.texts import slices
from slotwise.session import materialise

#: UTF-8 bytes of items whose terms are sent to every task at once; more items are searched in blocks.
BLOCK_BYTES = 2 << 20
#: Postings of one shard, a document's postings at least.
SHARD_POSTINGS = 2 << 20
#: Postings read first from each list; every further step reads twice as many.
FIRST_READ = 256
#: Rows of one item are ranked in so many parts before they meet.
PARTS = 32

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_FOLD).split() if text else []


def counted(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """``key``, ``n``, ``terms`` and ``tfs`` of the documents with a term: how often each asked term occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["key", "n", "terms", "tfs"]

    def run(batches):
        number, high = shared.value.get, max(1, len(shared.value))
        for batch in batches:
            for part in slices(batch, 1):
                words = [terms(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                n = np.array([len(w) for w in words], dtype=np.int64)
                ids = np.fromiter((number(w, -1) for ws in words for w in ws), dtype=np.int64, count=int(n.sum()))
                asked = ids >= 0
                found, tfs = np.unique(np.repeat(np.arange(len(n)), n)[asked] * high + ids[asked], return_counts=True)
                ends = pa.array(np.searchsorted(found, np.arange(len(n) + 1) * high).astype(np.int32))
                rows = pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.ListArray.from_arrays(ends, pa.array((found % high).astype(np.int32))),
                                                   pa.ListArray.from_arrays(ends, pa.array(tfs.astype(np.int32)))], names=names)
                yield rows.filter(pa.array(n > 0))

    plain = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return plain.mapInArrow(run, "key bigint, n bigint, terms array<int>, tfs array<int>")


def corpus_counts(stored: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L, and the documents that hold each of ``size`` terms."""
    def run(batches):
        held, n, total = np.zeros(size, dtype=np.int64), 0, 0
        for batch in batches:
            n, total = n + batch.num_rows, total + int(np.sum(batch.column(0).to_numpy()))
            held += np.bincount(batch.column(1).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1, -2]), pa.array([*held[some].tolist(), n, total])], names=["term", "n"])

    found = stored.select("n", "terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    df, sums = np.zeros(size, dtype=np.int64), {-1: 0, -2: 0}
    # One row per asked term at most: bounded by the block.
    for term, n in found.collect():
        if term < 0:
            sums[term] = n
        else:
            df[term] = n
    return sums[-1], sums[-2], df


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([floor(1000 * log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """The impact of terms that occur ``tf`` times in documents of ``n`` terms."""
    if 75 * int(n.max(initial=0)) * n_docs < 2 ** 63:
        m = 25 + 75 * n * n_docs // total
    else:
        m = np.array([25 + 75 * x * n_docs // total for x in n.tolist()], dtype=np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def resolve(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Documents (of 0 to ``size`` - 1) that may be among the ``k`` best at ``least`` points or more, ties included, with exact scores.

    Each list holds documents and their points, most points first.
    """
    lists = [(docs, points) for docs, points in lists if len(docs) and points[0] > 0]
    if not lists:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    lower = np.zeros(size, dtype=np.int64)
    at, last = [0] * len(lists), np.zeros(len(lists), dtype=np.int64)
    read_docs, read_lists = [], []
    wanted, step = list(range(len(lists))), FIRST_READ
    while True:
        for t in wanted:
            docs, points = lists[t]
            a, b = at[t], min(at[t] + step, len(docs))
            lower[docs[a:b]] += points[a:b]
            read_docs.append(docs[a:b])
            read_lists.append(np.full(b - a, t))
            at[t], last[t] = b, points[b - 1] if b < len(docs) else 0
        met, where = np.concatenate(read_docs), np.concatenate(read_lists)
        unread = int(last.sum())
        known = np.zeros(size, dtype=np.int64)
        np.add.at(known, met, last[where])
        upper = lower + (unread - known)
        if size >= k:
            least = max(least, int(np.partition(lower, size - k)[size - k]))
        rivals = (lower > 0) & (upper >= least)
        unsure = rivals & (upper > lower)
        if unread >= least:
            wanted = [t for t in range(len(lists)) if at[t] < len(lists[t][0])]
        elif unsure.any():
            seen = np.bincount(where[unsure[met]], minlength=len(lists))
            wanted = [t for t in range(len(lists)) if at[t] < len(lists[t][0]) and seen[t] < np.count_nonzero(unsure)]
        else:
            best = np.flatnonzero(rivals)
            return best, lower[best]
        # Only documents that may still get in are followed.
        if unread < least:
            read_docs, read_lists = [met[rivals[met]]], [where[rivals[met]]]
        else:
            read_docs, read_lists = [met], [where]
        step *= 2


class Best:
    """The k best documents of one item so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.nulls, self.keys = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)

    @property
    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, nulls: np.ndarray, keys: np.ndarray) -> None:
        scores, nulls, keys = np.concatenate([self.scores, scores]), np.concatenate([self.nulls, nulls]), np.concatenate([self.keys, keys])
        order = np.lexsort((keys, nulls, -scores))[:self.k]
        self.scores, self.nulls, self.keys = scores[order], nulls[order], keys[order]


def shards(batches, limit: int):
    """Consecutive rows as tables of about ``limit`` postings."""
    held, n = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            held.append(part)
            n += len(part.column(2).flatten())
            if n >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def search_shard(shard: pa.Table, items, weight: np.ndarray, n_docs: int, total: int, best: list[Best]) -> None:
    """Ranks the shard's documents for every item; ``best`` is carried from shard to shard."""
    keys, n, held, tfs = (shard.column(i).combine_chunks() for i in range(4))
    if isinstance(held, pa.ChunkedArray):
        held, tfs = pa.concat_arrays(held.chunks), pa.concat_arrays(tfs.chunks)
    term, tf = held.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
    if not len(term):
        return
    doc = np.repeat(np.arange(shard.num_rows), np.diff(held.offsets.to_numpy()))
    impact = impacts(tf, n.to_numpy()[doc], n_docs, total)
    order = np.lexsort((-impact, term))
    term, doc, impact = term[order], doc[order], impact[order]
    heads = np.searchsorted(term, np.arange(len(weight) + 1))
    nulls = keys.is_null().to_numpy(zero_copy_only=False)
    keys = keys.fill_null(0).to_numpy()
    for (ids, times), mine in zip(items, best):
        lists = [(doc[heads[t]:heads[t + 1]], impact[heads[t]:heads[t + 1]] * (weight[t] * c)) for t, c in zip(ids, times) if heads[t] < heads[t + 1]]
        found, scores = resolve(lists, shard.num_rows, mine.k, mine.least)
        mine.add(scores, nulls[found], keys[found])


def _ranked(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, rows: list, item_type: str, k: int, key: str, text: str, item: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    items = []
    for r in rows:
        times = Counter(vocabulary.setdefault(w, len(vocabulary)) for w in terms(None if r.text is None else r.text.encode("utf-8", "surrogatepass")))
        items.append((list(times), list(times.values())))
    names = spark.createDataFrame([(i, r.item) for i, r in enumerate(rows)], f"number int, item {item_type}")
    stored = materialise(counted(docs, vocabulary, key, text), "postings")
    n_docs, total, df = corpus_counts(stored, len(vocabulary))
    shared = spark.sparkContext.broadcast((items, weights(n_docs, df), n_docs, total))

    def run(batches):
        asked, weight, n, length = shared.value
        best = [Best(k) for _ in asked]
        for shard in shards(batches, SHARD_POSTINGS):
            search_shard(shard, asked, weight, n, length, best)
        for i, b in enumerate(best):
            if len(b.keys):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.keys), i, dtype=np.int32)), pa.array(b.keys, mask=b.nulls), pa.array(b.scores)], names=["number", "key", "score"])

    found = stored.mapInArrow(run, "number int, key bigint, score bigint").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
    top = _ranked(_ranked(found, k, "number", "part"), k, "number")
    return top.join(F.broadcast(names), "number").select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The item's id, ``rank`` (from 1), the document's id and ``score`` of the ``k`` best documents of every item.

    The terms of a block of items go to every task.  A block holds about
    ``BLOCK_BYTES`` of text, one item at least; each block reads the documents once.
    """
    asked = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
    n = int((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES) + 1
    kind = asked.schema["item"].dataType.simpleString()
    out = None
    for b in range(n):
        rows = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect()
        found = _search_block(docs, rows, kind, k, key, text, item)
        out = found if out is None else out.unionByName(found)
    return out
