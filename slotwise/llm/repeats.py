"""Removal of repeated byte strings by longest-previous-factor arrays.

Every byte covered by a ``LENGTH``-byte string that also starts earlier goes; the
first copy stays.  Earlier means a smaller document id, or an earlier start in
the same document; rows with one id count as one document.

A window (a ``LENGTH``-byte string) is represented by its minimiser: the
``GRAM``-byte string in it with the least hash, the leftmost of equal ones.  Equal
windows have equal minimisers, so the windows of one minimiser, and only those,
have to meet.  Neighbouring windows with the same minimiser travel as one segment.

1. Each task cuts its texts into segments; of equal segments it sends on only the
   earliest, the later ones are repeats already.  Segments of one minimiser meet,
   again later equal ones are repeats.  Segments whose minimiser is found nowhere
   else are done.
2. The bytes of the segments left, the differing ones of a common minimiser, are
   fetched.  Over those of each minimiser a suffix array gives, for every window,
   the previous and the next window in suffix order that starts earlier in the
   corpus; the longer common prefix with these two is the longest previous
   factor, and the window is a repeat if it reaches ``LENGTH``.
3. The repeated windows of each document merge into runs that are cut out.

Prefixes are compared up to ``LENGTH`` bytes, as nothing longer is asked for.

Cases: null text is empty; texts shorter than ``LENGTH`` stay; a null id sorts
first; rows repeated with id and text keep what the first of them keeps; matches
never cross documents; texts of any length are read whole, in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.texts import slices
from slotwise.session import materialise

LENGTH, GRAM = 100, 20
SPAN = LENGTH - GRAM + 1
#: Bytes hashed at once, and the bits of a position among them.
PIECE, PLACE_BITS = 1 << 23, 24
#: Segments a task gathers before it drops later equal ones.
GATHER = 1 << 20
#: Bytes of segments whose suffixes are sorted together; one minimiser's segments are never parted.
SORT_BYTES = 2 << 20


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at every position, by doubling."""
    h, base, size = data.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
    done, length, rest = None, 0, GRAM
    power = base
    while rest:
        if rest & 1:
            if done is None:
                done, length = h, size
            else:
                n = len(data) - length - size + 1
                done = done[:n] * power + h[length:length + n]
                length += size
        rest >>= 1
        if rest:
            h = h[:len(h) - size] * power + h[size:]
            power, size = np.uint64(int(power) ** 2 % (1 << 64)), size * 2
    done ^= done >> np.uint64(32)
    done *= np.uint64(0xD6E8FEB86659FD93)
    done ^= done >> np.uint64(29)
    done *= np.uint64(0xC2B2AE3D27D4EB4F)
    done ^= done >> np.uint64(32)
    return done


def minimisers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``data`` the position of its minimiser, and all gram hashes."""
    hashes = gram_hashes(data)
    least = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:len(least) - (SPAN - size)], least[SPAN - size:]) if size < SPAN else least
    return (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64), hashes


def segments(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of windows with one minimiser: text number, first start, number of windows, hash of minimiser, digest of the bytes."""
    parts = []
    group, total = [], 0
    for i, t in enumerate(texts):
        # A long text goes in pieces that share LENGTH - 1 bytes, so that every window is in exactly one.
        for at in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            piece = t[at:at + PIECE + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            if total + len(piece) > PIECE and group:
                parts.append(_segments(group))
                group, total = [], 0
            group.append((i, at, piece))
            total += len(piece)
    if group:
        parts.append(_segments(group))
    names = ("text", "start", "n", "gram", "digest")
    types = (np.int64, np.int64, np.int64, np.int64, np.int64)
    return {k: np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, t) for j, (k, t) in enumerate(zip(names, types))}


def _segments(group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    joined = b"".join(p for *_, p in group)
    sizes = np.array([len(p) for *_, p in group])
    ends = np.cumsum(sizes)
    place, hashes = minimisers(np.frombuffer(joined, dtype=np.uint8))
    count = len(place)
    owner = np.repeat(np.arange(len(group)), sizes)[:count]
    inside = np.arange(count) + LENGTH <= ends[owner]
    new = np.ones(count, dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new & inside)
    # Windows that cross an end break a run too, so a run ends where the next begins or its piece has no more windows.
    stops = np.minimum(np.append(heads[1:], count), ends[owner[heads]] - LENGTH + 1)
    digest = xxhash.xxh64_intdigest
    digests = np.array([digest(joined[a:b + LENGTH - 1]) for a, b in zip(heads.tolist(), stops.tolist())], dtype=np.uint64).view(np.int64)
    first = ends - sizes
    text = np.array([i for i, *_ in group])[owner[heads]]
    start = heads - first[owner[heads]] + np.array([at for _, at, _ in group])[owner[heads]]
    return text, start, stops - heads, hashes[place[heads]].view(np.int64), digests


FOUND = "gram bigint, digest bigint, id bigint, mark int, start bigint, n int, known boolean"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of (id, mark, text) rows; of equal ones gathered together only the earliest is still open."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        for part in slices(batch, 2):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(2).to_pylist()]
            got = segments(texts)
            text = got.pop("text")
            got["id"], got["mark"] = part.column(0).to_numpy()[text], part.column(1).to_numpy()[text]
            held.append(got)
            if sum(len(h["id"]) for h in held) >= GATHER:
                yield _open(held)
                held = []
    if held:
        yield _open(held)


def _open(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
    order = np.lexsort((c["start"], c["id"], c["digest"], c["gram"]))
    c = {k: v[order] for k, v in c.items()}
    known = _later(c)
    repeats = {k: v[known] for k, v in c.items()}
    # Neighbouring repeats of a text become one row, spread over the partitions by where they are.
    order = np.lexsort((repeats["start"], repeats["mark"], repeats["id"]))
    repeats = {k: v[order] for k, v in repeats.items()}
    joins = np.zeros(len(order), dtype=bool)
    joins[1:] = ((repeats["id"][1:] == repeats["id"][:-1]) & (repeats["mark"][1:] == repeats["mark"][:-1])
                 & (repeats["start"][:-1] + repeats["n"][:-1] == repeats["start"][1:]))
    heads = np.flatnonzero(~joins)
    long = np.add.reduceat(repeats["n"], heads) if len(heads) else repeats["n"]
    repeats = {k: v[heads] for k, v in repeats.items()}
    repeats["n"], repeats["digest"] = long, np.zeros(len(heads), dtype=np.int64)
    out = {k: np.concatenate([c[k][~known], repeats[k]]) for k in c}
    flag = np.repeat([False, True], [int((~known).sum()), len(heads)])
    return pa.RecordBatch.from_arrays([pa.array(out["gram"]), pa.array(out["digest"]), pa.array(out["id"]), pa.array(out["mark"], pa.int32()),
                                       pa.array(out["start"]), pa.array(out["n"], pa.int32()), pa.array(flag)], names=["gram", "digest", "id", "mark", "start", "n", "known"])


def _later(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rows, sorted by gram, digest, id and start, before which an equal segment starts."""
    n = len(c["gram"])
    if not n:
        return np.zeros(0, dtype=bool)
    new = np.ones(n, dtype=bool)
    new[1:] = (c["gram"][1:] != c["gram"][:-1]) | (c["digest"][1:] != c["digest"][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return (c["id"] != c["id"][head]) | (c["start"] != c["start"][head])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segments in: out come repeats (known), and the earliest of each differing segment of a common gram (not known)."""
    names = ["gram", "digest", "id", "mark", "start", "n", "known"]
    carry: dict[str, np.ndarray] | None = None
    first: dict[str, int] | None = None

    def done(c: dict[str, np.ndarray], several_before: bool, last: bool):
        """Rows of ``c`` but for the very last gram's only segment so far, which waits unless ``last``."""
        known = c["known"] | _later(c)
        head = np.ones(len(known), dtype=bool)
        head[1:] = c["gram"][1:] != c["gram"][:-1]
        group = np.cumsum(head) - 1
        differs = np.zeros(len(known), dtype=bool)
        differs[1:] = ~head[1:] & (c["digest"][1:] != c["digest"][:-1])
        several = np.bincount(group, weights=differs, minlength=group[-1] + 1) > 0
        if several_before:
            several[0] = True
        return known, several[group], group

    for batch in batches:
        c = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}
        if not len(c["gram"]):
            continue
        if carry is not None:
            c = {k: np.concatenate([carry[k], c[k]]) for k in names}
        # The rows of the last gram that are needed further on: its first row, and the first row of its last digest.
        known, several, group = done(c, bool(first), False)
        wait = group == group[-1]
        go = ~wait | several
        skip = np.zeros(len(known), dtype=bool)
        if first:
            skip[:first["sent"]] = True
        emit = go & (known | several) & ~skip
        if not several[-1]:
            emit |= wait & known & ~skip
        yield _rows(c, emit, known)
        tail = np.flatnonzero(wait)
        last_digest = tail[c["digest"][tail] == c["digest"][tail[-1]]][0]
        keep = [tail[0]] if last_digest == tail[0] else [tail[0], last_digest]
        # Rows kept for comparison that are out already are not sent again.
        sent = bool(several[-1])
        carry = {k: v[keep] for k, v in c.items()}
        first = {"sent": len(keep)} if sent else None
        if not sent:
            # All rows of the waiting gram are equal segments; ties of the first position wait with it.
            ties = tail[~known[tail]]
            carry = {k: v[ties] for k, v in c.items()}


def _rows(c: dict[str, np.ndarray], at: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c["gram"][at]), pa.array(c["id"][at]), pa.array(c["mark"][at], pa.int32()), pa.array(c["start"][at]),
                                       pa.array(c["n"][at], pa.int32()), pa.array(known[at])], names=["gram", "id", "mark", "start", "n", "known"])


def words_of(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at every position as one number, zeros past the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.zeros(len(data), dtype=np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i:i + len(data)]
    return words


def suffix_ranks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks of the ``LENGTH``-byte strings at ``at`` in suffix order (equal strings, equal ranks), by prefix doubling from 8 bytes."""
    words = words_of(data)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    size = 8
    while size * 2 <= LENGTH:
        # Past the end nothing is asked for: every window lies inside its segment.
        rank = np.unique(rank * (len(data) + 1) + np.append(rank[size:], np.zeros(min(size, len(rank)), dtype=np.int64))[:len(rank)], return_inverse=True)[1].astype(np.int64)
        size *= 2
    return np.unique(rank[at] * (len(data) + 1) + rank[at + LENGTH - size], return_inverse=True)[1]


def common_prefixes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes, ``LENGTH`` at most, that each string of ``at`` shares with the next one."""
    words = words_of(data)
    shared = np.zeros(max(len(at) - 1, 0), dtype=np.int16)
    alike = np.arange(len(shared))
    for done in range(0, LENGTH, 8):
        differs = words[at[alike] + done] ^ words[at[alike + 1] + done]
        # Leading zero bytes of the difference are shared.
        shared[alike] += sum((differs < np.uint64(1 << (64 - 8 * k))).astype(np.int16) for k in range(1, 8)) + (differs == 0)
        alike = alike[differs == 0]
    return np.minimum(shared, LENGTH)


def previous_smaller(place: np.ndarray, common: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of the order the nearest one before it with a smaller place, and the prefix both share.

    Blocks of 2^k entries that hold no smaller place are skipped, the largest first, up to 2^levels - 1 entries;
    where these hold none, the entry just before them is given, whose shared prefix bounds all further ones.
    """
    least, shared = [place], [common]
    for k in range(levels - 1):
        least.append(np.minimum(least[-1][:-(1 << k)], least[-1][1 << k:]))
        shared.append(np.minimum(shared[-1][:-(1 << k)], shared[-1][1 << k:]))
    at, prefix = np.arange(len(place)), np.full(len(place), LENGTH, dtype=np.int16)
    for k in reversed(range(levels)):
        rows = np.flatnonzero(at >= 1 << k)
        to = at[rows] - (1 << k)
        skip = least[k][to] >= place[rows]
        rows, to = rows[skip], to[skip]
        prefix[rows] = np.minimum(prefix[rows], shared[k][to])
        at[rows] = to
    some = at > 0
    prefix[some] = np.minimum(prefix[some], common[at[some] - 1])
    prefix[~some] = 0
    return at - 1, prefix


def previous_factors(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factors in suffix order: the longer of the prefixes shared with the previous and the next smaller place.

    Exact where ``LENGTH`` is reached; below it an upper bound, as the search goes no further than strings that share ``LENGTH``.
    """
    n = len(place)
    if n < 2:
        return np.zeros(n, dtype=np.int16)
    breaks = np.flatnonzero(np.concatenate([[True], common < LENGTH, [True]]))
    levels = min(int(np.diff(breaks).max()), n - 1).bit_length()
    before = previous_smaller(place, common, levels)[1]
    after = previous_smaller(place[::-1], common[::-1], levels)[1][::-1]
    return np.maximum(before, after)


def repeated_windows(ranks: np.ndarray, place: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
    """Windows whose longest previous factor reaches ``LENGTH``.

    ``common`` holds the prefixes that neighbours in suffix order (a stable sort of
    ``ranks``) share; without it, equal ranks share ``LENGTH`` and others nothing.
    """
    order = np.argsort(ranks, kind="stable")
    if common is None:
        common = np.where(np.diff(ranks[order]) == 0, LENGTH, 0).astype(np.int16)
    out = np.zeros(len(ranks), dtype=bool)
    out[order] = previous_factors(place[order], common) >= LENGTH
    return out


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with bytes, sorted by gram, in: out come the repeated windows as (id, mark, start, n)."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        held.append(batch)
        total += batch.column(5).nbytes
        if total < SORT_BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        grams = table.column(0).to_numpy()
        whole = int(np.searchsorted(grams, grams[-1]))
        if whole:
            yield from _repeats_of(table.slice(0, whole))
            rest = table.slice(whole).combine_chunks()
            held = rest.to_batches()
            total = sum(b.column(5).nbytes for b in held)
    if held:
        yield from _repeats_of(pa.Table.from_batches(held).combine_chunks())


def _repeats_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """In parts of about ``SORT_BYTES`` that end with a gram."""
    grams, sizes = table.column(0).to_numpy(), np.array([len(b) for b in table.column(5).to_pylist()])
    cuts, ends = [0], np.cumsum(sizes)
    while cuts[-1] < len(grams):
        at = int(np.searchsorted(ends, (ends[cuts[-1] - 1] if cuts[-1] else 0) + SORT_BYTES))
        at = min(max(at, cuts[-1] + 1), len(grams))
        cuts.append(int(np.searchsorted(grams, grams[at - 1], side="right")))
    for a, b in zip(cuts, cuts[1:]):
        part = table.slice(a, b - a)
        gram, ids, marks, starts, counts = (part.column(i).to_numpy() for i in range(5))
        data = np.frombuffer(b"".join(part.column(5).to_pylist()), dtype=np.uint8)
        first = np.cumsum(sizes[a:b]) - sizes[a:b]
        owner = np.repeat(np.arange(b - a), counts)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        windows = first[owner] + step
        ranks = suffix_ranks(data, windows)
        # Only windows of one gram can be equal, so places compare within a rank as (id, start).
        start = starts[owner] + step
        order = np.lexsort((start, ids[owner]))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (ids[owner][order][1:] != ids[owner][order][:-1]) | (start[order][1:] != start[order][:-1])
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(fresh)
        hit = repeated_windows(ranks, place.astype(np.int32), common_prefixes(data, windows[np.argsort(ranks, kind="stable")]))
        edge = np.ones(len(hit), dtype=bool)
        edge[1:] = (owner[1:] != owner[:-1]) | ~hit[:-1]
        heads = np.flatnonzero(hit & edge)
        runs = np.add.reduceat(hit.astype(np.int64) * 1, heads) if len(heads) else heads
        yield pa.RecordBatch.from_arrays([pa.array(ids[owner[heads]]), pa.array(marks[owner[heads]], pa.int32()), pa.array(start[heads]),
                                          pa.array(runs, pa.int32())], names=["id", "mark", "start", "n"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their open segments in, one row per segment with its bytes out."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("gram", "id", "mark", "start", "n", "data")}
        for i in range(batch.num_rows):
            data = (batch.column(2)[i].as_py() or "").encode("utf-8", "surrogatepass")
            for s in batch.column(3)[i].as_py():
                for k in ("gram", "start", "n"):
                    out[k].append(s[k])
                out["data"].append(data[s["start"]:s["start"] + s["n"] + LENGTH - 1])
            more = len(out["gram"]) - len(out["id"])
            out["id"] += [batch.column(0)[i].as_py()] * more
            out["mark"] += [batch.column(1)[i].as_py()] * more
        yield pa.RecordBatch.from_arrays([pa.array(out["gram"], pa.int64()), pa.array(out["id"], pa.int64()), pa.array(out["mark"], pa.int32()),
                                          pa.array(out["start"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["data"], pa.binary())], names=list(out))


def kept_text(text: str | None, starts: list[int], counts: list[int]) -> tuple[bytes, int, int, int]:
    """The bytes that stay, the number of all bytes, of removed bytes and of removed runs."""
    data = (text or "").encode("utf-8", "surrogatepass")
    spans: list[list[int]] = []
    for a, n in sorted(zip(starts, counts)):
        b = a + n + LENGTH - 1
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    kept = b"".join([*parts, data[at:]])
    return kept, len(data), len(data) - len(kept), len(spans)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            kept, size, gone, runs = kept_text(text, [s["start"] for s in spans or ()], [s["n"] for s in spans or ()])
            for k, v in zip(out, (size, gone, runs, hashlib.sha256(kept).hexdigest(), kept)):
                out[k].append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(out.values(), types)]], names=["id", *out])


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The documents as (id, mark, text) and the starts of their repeated windows as (id, mark, start, n).

    ``mark`` tells rows of one id with different texts apart; a null id is the
    smallest long.
    """
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(-(1 << 63))).alias("id"),
                       F.hash(F.xxhash64(F.col(f"`{text}`").cast("string"))).alias("mark"), F.col(f"`{text}`").cast("string").alias("text"))
    cut = rows.mapInArrow(_cut, FOUND)
    met = (cut.repartition("gram").sortWithinPartitions("gram", "digest", "id", "start")
           .mapInArrow(_meet, "gram bigint, id bigint, mark int, start bigint, n int, known boolean"))
    met = materialise(met, "met")
    open_ = met.filter("NOT known").distinct().groupBy("id", "mark").agg(F.collect_list(F.struct("gram", "start", "n")).alias("open"))
    bytes_of = (rows.join(open_, ["id", "mark"]).select("id", "mark", "text", "open")
                .mapInArrow(_fetch, "gram bigint, id bigint, mark int, start bigint, n int, data binary"))
    found = (bytes_of.repartition("gram").sortWithinPartitions("gram").mapInArrow(_factors, "id bigint, mark int, start bigint, n int"))
    return rows, met.filter("known").select("id", "mark", "start", "n").unionByName(found)


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and the bytes ``kept`` of every document."""
    rows, windows = repeats(docs, text, key)
    spans = windows.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    cut = rows.join(spans, ["id", "mark"], "left").select("id", "text", "spans").mapInArrow(
        _cut_out, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return cut.withColumn("id", F.when(F.col("id") != -(1 << 63), F.col("id")))
