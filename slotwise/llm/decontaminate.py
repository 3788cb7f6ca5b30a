"""Benchmark decontamination: an FM-index per training shard, searched backwards with every test phrase.

A shard is a batch of whole documents.  Its words become symbols of the phrases'
vocabulary; a stretch of other words is one separator, and separators never
match.  Stretches with fewer symbols than the shortest phrase cannot hold one
and are not indexed.  The index is the Burrows-Wheeler transform in a wavelet
matrix; ranks narrow the suffix interval of all phrases at once, positions come
from sampled suffixes, and the words of all occurrences merge into spans.

A phrase is a window of ``width`` consecutive words of an item; a shorter item
with words is one phrase.  Words are runs of a-z, digits and non-ASCII
characters after lower-casing A-Z.

Cases: null and empty texts have no words; items without words have no phrase;
repeated items and repeated windows count once per item id; a null item id is
ignored; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.texts import annotate
from slotwise.session import materialise

WIDTH = 10
#: Every so many positions of a shard keep their suffix position.
SAMPLE = 8
#: UTF-8 bytes of text in one shard.
SHARD_BYTES = 4 << 20
#: UTF-8 bytes of test items searched (and broadcast) at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 16 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WaveletMatrix:
    """Rank of any symbol before any position, for whole arrays of (symbol, position) at once."""

    def __init__(self, symbols: np.ndarray, high: int):
        self.levels = list(range(max(1, int(high).bit_length()) - 1, -1, -1))
        self.ones, self.zeros = [], []
        rest = symbols
        for level in self.levels:
            bit = (rest >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(rest) - int(self.ones[-1][-1]))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(before), before
        for level, ones, zeros in zip(self.levels, self.ones, self.zeros):
            bit = (symbol >> level) & 1 == 1
            a, b = ones[low], ones[high]
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return high - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each separator (0) is a symbol of its own, ordered by position."""
    n = len(symbols)
    is_gap = symbols == 0
    gaps = int(is_gap.sum())
    rank = symbols.astype(np.int64) + gaps
    rank[is_gap] = np.arange(gaps)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        sorted_rank = rank[order]
        new = np.empty(n, dtype=np.int64)
        first = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
        heads = np.flatnonzero(first)
        new[order] = heads[np.cumsum(first) - 1]
        rank = new
        sizes = np.diff(np.append(heads, n))
        open_rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(open_rows):
            return order
        at = order[open_rows]
        after = at + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        inner = np.lexsort((second, rank[at]))
        order[open_rows] = at[inner]
        # Rows that differ in the second half get their own rank: the pair becomes the key.
        pair = rank.astype(np.int64) * (n + 1)
        pair[at] += second + 1
        rank = pair
        step *= 2


class FMIndex:
    """Full-text index of one symbol array whose separators are 0 and that ends with one."""

    def __init__(self, symbols: np.ndarray, high: int):
        order = suffix_order(symbols)
        self.bwt = symbols[order - 1].astype(np.int64)
        counts = np.bincount(symbols, minlength=high + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.matrix = WaveletMatrix(self.bwt, high)
        # Starts of stretches are sampled too, so that a walk never has to cross a separator.
        keep = (order % SAMPLE == 0) | (self.bwt == 0)
        self.sampled = keep
        self.slot = np.cumsum(keep) - 1
        self.positions = order[keep]

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.matrix.rank(symbol, row)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval of each phrase (rows of symbols, left-aligned); empty where it does not occur."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), len(self.bwt), dtype=np.int64)
        for back in range(phrases.shape[1]):
            alive = np.flatnonzero((lengths > back) & (low < high))
            if not len(alive):
                continue
            c = phrases[alive, lengths[alive] - 1 - back]
            low[alive], high[alive] = self.step(c, low[alive]), self.step(c, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, moved = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            c = self.bwt[rows[walking]]
            rows[walking] = self.step(c, rows[walking])
            moved[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.positions[self.slot[rows]] + moved


@dataclass(frozen=True)
class Phrases:
    """Distinct windows of a block of items, and the items that own each."""

    vocabulary: dict[bytes, int]
    symbols: np.ndarray
    lengths: np.ndarray
    owners: list[list[str]]


def phrases_of(items: list[tuple[str, str | None]], width: int = WIDTH) -> Phrases:
    vocabulary: dict[bytes, int] = {}
    owned: dict[tuple, set[str]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        for i in range(max(1, len(ids) - width + 1) if ids else 0):
            owned.setdefault(tuple(ids[i:i + width]), set()).add(item)
    symbols = np.zeros((len(owned), width), dtype=np.int64)
    lengths = np.array([len(p) for p in owned], dtype=np.int64)
    for row, p in enumerate(owned):
        symbols[row, :len(p)] = p
    return Phrases(vocabulary, symbols, lengths, [sorted(v) for v in owned.values()])


def search_shard(texts: list[str | None], phrases: Phrases) -> dict[str, list]:
    """Per text: number of words, hit words, the ids of items found, and the merged spans (code points)."""
    counts, parts = [], []
    known = phrases.vocabulary
    for t in texts:
        w = words(t)
        counts.append(len(w))
        parts.append(np.fromiter(map(known.get, w, repeat(0)), dtype=np.int64, count=len(w)))
        parts.append(np.zeros(1, dtype=np.int64))
    n = np.array(counts, dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(n + 1)])
    out = {"n_words": counts, "n_hit": [0] * len(texts), "items": [[] for _ in texts], "spans": [[] for _ in texts]}
    if not len(phrases.lengths):
        return out
    shard = np.concatenate([np.zeros(1, dtype=np.int64), *parts])
    # Keep the stretches of known words that are long enough for the shortest phrase, one separator after each.
    gap = np.flatnonzero(shard == 0)
    size = np.diff(np.append(gap, len(shard))) - 1
    long = size >= phrases.lengths.min()
    if not long.any():
        return out
    kept = np.repeat(gap[long], size[long] + 1) + (np.arange((size[long] + 1).sum()) - np.repeat(np.cumsum(size[long] + 1) - (size[long] + 1), size[long] + 1))
    text_at = np.append(kept, len(shard)) - 1
    symbols = np.append(shard[kept], 0)
    index = FMIndex(symbols, len(known))
    low, high = index.search(phrases.symbols, phrases.lengths)
    found = np.flatnonzero(high > low)
    if not len(found):
        return out
    times = (high - low)[found]
    phrase = np.repeat(found, times)
    rows = np.repeat(low[found], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    at = text_at[index.locate(rows)]
    edge = np.zeros(starts[-1] + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + phrases.lengths[phrase], -1)
    hit = np.cumsum(edge) > 0
    doc = np.searchsorted(starts, at, side="right") - 1
    pairs = np.unique(np.stack([doc, phrase]), axis=1)
    cuts = np.flatnonzero(np.diff(pairs[0], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], pairs.shape[1])):
        d = int(pairs[0, a])
        out["items"][d] = sorted(set().union(*(phrases.owners[p] for p in pairs[1, a:b])))
        mine = hit[starts[d]:starts[d] + n[d]]
        out["n_hit"][d] = int(mine.sum())
        places = [m.span() for m in _WORD.finditer(texts[d])]
        turn = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
        out["spans"][d] = [{"start": places[i][0], "end": places[j - 1][1]} for i, j in turn.reshape(-1, 2).tolist()]
    return out


FOUND = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"


def _blocks(benchmark: DataFrame, item: str, text: str) -> list[DataFrame]:
    """The items as strings, dealt by hash into blocks of about ``BLOCK_BYTES``."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    return [rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) for b in range(n)]


def _search(docs: DataFrame, block: DataFrame, text: str, keep: list[str], width: int) -> DataFrame:
    phrases = phrases_of([(r.item, r.text) for r in block.toLocalIterator()], width)
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def make():
        mine = shared.value
        return lambda texts: search_shard(texts, mine)

    return annotate(docs, text, keep, FOUND, make, SHARD_BYTES)


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
           keep: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """``row`` (the kept columns), ``n_words``, ``n_hit``, ``items`` (ids as sorted strings) and ``spans`` for every document.

    A benchmark of one block is searched in one pass without a shuffle.  A larger
    one is searched block by block; the findings of each document then meet by a
    row number that a stored copy of the documents carries.
    """
    keep = keep or docs.columns
    blocks = _blocks(benchmark, item, item_text)
    if len(blocks) == 1:
        return _search(docs, blocks[0], text, keep, width)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"),
                         F.monotonically_increasing_id().alias("id"))
    packed = materialise(packed, "decontaminate")
    parts = None
    for block in blocks:
        found = _search(packed.select("id", "text"), block, "text", ["id"], width).filter("n_hit > 0")
        parts = found if parts is None else parts.unionByName(found)
    hits = parts.select("row.id", "items", "spans").groupBy("id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    # A pass of its own counts words and re-reads merged spans as words.
    both = packed.join(hits, "id", "left")
    return annotate_merged(both)


def annotate_merged(both: DataFrame) -> DataFrame:
    """Counts and merged spans of documents whose findings came from several blocks."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    fields = T.StructType.fromDDL(FOUND).fields
    schema = T.StructType([both.schema["row"], *fields])
    types = [to_arrow_type(f.dataType, timestamp_utc=True) for f in fields]
    names = ["row", *[f.name for f in fields]]

    def run(batches):
        for batch in batches:
            cols = {k: batch.column(batch.schema.get_field_index(k)) for k in ("row", "text", "items", "spans")}
            out = {k: [] for k in names[1:]}
            for t, items, spans in zip(*(cols[k].to_pylist() for k in ("text", "items", "spans"))):
                places = [m.span() for m in _WORD.finditer(t or "")]
                inside = np.zeros(len(places) + 1, dtype=np.int64)
                if spans:
                    first, last = (np.array([p[i] for p in places]) for i in (0, 1))
                    np.add.at(inside, np.searchsorted(first, [s["start"] for s in spans]), 1)
                    np.add.at(inside, np.searchsorted(last, [s["end"] for s in spans]) + 1, -1)
                hit = (np.cumsum(inside)[:-1] > 0).astype(np.int8)
                turn = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
                out["n_words"].append(len(places))
                out["n_hit"].append(int(hit.sum()))
                out["items"].append(items or [])
                out["spans"].append([{"start": places[i][0], "end": places[j - 1][1]} for i, j in turn.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays([cols["row"], *[pa.array(out[k], t) for k, t in zip(names[1:], types)]], names=names)

    return both.select("row", "text", "items", "spans").mapInArrow(run, schema)


def removed(text: F.Column, spans: F.Column) -> F.Column:
    """The text without its spans; a line break stands where one was."""
    n = F.size(spans)
    bounds = F.sequence(F.lit(0), n)
    piece = F.transform(bounds, lambda i: F.substring(
        text,
        F.when(i == 0, F.lit(1)).otherwise(F.element_at(spans.end, F.greatest(i, F.lit(1))) + 1),
        F.when(i < n, F.get(spans.start, i)).otherwise(F.length(text)) - F.when(i == 0, F.lit(0)).otherwise(F.element_at(spans.end, F.greatest(i, F.lit(1))))))
    return F.when(n > 0, F.array_join(piece, "\n")).otherwise(text)
