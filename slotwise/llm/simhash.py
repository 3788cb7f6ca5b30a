"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: words are the runs between blanks after lower-casing A-Z; each
4-word shingle (a shorter text is one shingle) is hashed to 64 bits; a bit is set
if it is set in over half of the hashes.  Two fingerprints link if they differ in
``reach`` bits at most.

Search: the bits are cut into partitions of correlated bits.  With thresholds
t_1 .. t_m that sum to ``reach - m + 1``, linked fingerprints agree up to t_i bits
on at least one partition i.  The number of partitions and the thresholds come
from dynamic programming over the estimated cost of rows and candidates, so the
plan moves to wider keys as the corpus grows.  A fingerprint is filed under its
partition's value with every choice of t_i bits blanked; fingerprints that share
a file are candidates and verified.

For a similarity instead of a number of bits (:func:`one_of_similar`), fingerprints
of 512 bits, cut into 32 parts, propose most near copies cheaply, and the sets of
shingles confirm them.  What they miss is found without loss: two sets of shingles whose Jaccard similarity is s or more share
one of the first n - ceil(s n) + 1 shingles of either in any common order.  Shingles
that are frequent in a sample come last in that order.  Pairs of different groups
that share such a shingle, and whose outlines allow the similarity, are candidates:
first a spanning forest of them, the most alike ones, is compared by sets, then all
candidates between groups that this leaves apart.  An outline has a bit for each remainder of a hash, set if an odd number
of shingles has it, so two sets differ in at least as many shingles as their outlines in bits.

Equal fingerprints are one entry.  A file with many entries is walked breadth
first over what is not yet reached, so it yields one link per entry, not all
pairs; connected components of the links give the groups.

Cases: null and blank texts have fingerprint zero and group with each other;
a null id is the smallest of no group with another id; repeated rows share a
group; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

from itertools import combinations
from math import acos, ceil, comb, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.components import roots
from slotwise.llm.stored import Folder
from slotwise.llm.texts import annotate, share
from slotwise.session import materialise

SHINGLE, SEED, REACH, BITS = 4, 42, 4, 64
#: Fingerprints from which the bits' statistics are estimated (they choose the plan, never the result).
SAMPLE = 4096
#: Relative cost of filing one fingerprint once and of comparing one pair.
ROW_COST, PAIR_COST = 300.0, 1.0
#: Files of up to so many entries are compared all against all in one sweep.
SMALL = 64
# Fingerprints for a similarity: words of a shingle, blocks of 64 bits, bits in all, bits of a part that is looked up.
WIDE_SHINGLE, BLOCKS, PART = 5, 8, 16
WIDE = BLOCKS * BITS
#: Bits of an outline; a power of two.
OUTLINE = 1024
#: Shingles counted together in a task, the most frequent ones it reports, and those sent to every task (they choose the order, never the result).
COUNTED, REPORTED, KNOWN = 4 << 20, 1 << 15, 1 << 20


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of ``size`` words, repeats included; none for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    whole = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts, (ends[size - 1:] - 1).tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the hashes, as bytes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little")


def fingerprint(text: str | None) -> int:
    return int(majority(shingle_hashes(text)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns) and ``fp`` (the 64 bits as a signed long)."""
    def make():
        return lambda texts: {"fp": np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)}

    return annotate(docs, text, keep or docs.columns, "fp bigint", make)


def bit_groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of the bit positions; each takes the unused bit most correlated with those it has."""
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred ** 2).sum(axis=0)) + 1e-12
    tie = np.abs(centred.T @ centred) / np.outer(spread, spread)
    free, groups = set(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        group = [min(free)]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: tie[group, b].mean())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def match_chances(bits: np.ndarray, group: list[int], most: int) -> list[float]:
    """Chance that two fingerprints differ in at most t of the group's bits, for t = 0 .. most."""
    ways = np.zeros(most + 1)
    ways[0] = 1.0
    for p in bits[:, group].mean(axis=0):
        differ = 2 * p * (1 - p)
        ways = ways * (1 - differ) + np.concatenate([[0.0], ways[:-1]]) * differ
    return np.cumsum(ways).tolist()


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (from -1, which files nothing) that sum to ``total`` at least cost; ``costs[i][t]`` for t = 0, 1, ..."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, len(row)):
                here = (cost + (row[t] if t >= 0 else 0.0), [*chosen, t])
                if used + t not in step or here < step[used + t]:
                    step[used + t] = here
        best = step
    return best[total]


def plan(sample: np.ndarray, n: int, reach: int = REACH) -> list[tuple[list[int], int]]:
    """Partitions (bit positions) and thresholds for ``n`` fingerprints."""
    n = max(n, 1)
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(float) if len(sample) else np.full((1, BITS), 0.5)
    choices = []
    for m in range(2, reach + 2):
        groups = bit_groups(bits, m)
        costs = []
        for g in groups:
            chance = match_chances(bits, g, reach)
            costs.append([ROW_COST * n * comb(len(g), t) + PAIR_COST * n * n / 2 * chance[t] for t in range(reach + 1)])
        cost, chosen = allocate(costs, reach - m + 1)
        choices.append((cost, [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


def masks(partitions: list[tuple[list[int], int]]) -> list[int]:
    """One mask per file: a partition's bits without a choice of t of them (as signed longs)."""
    out = []
    for group, t in partitions:
        for blank in combinations(group, t):
            value = sum(1 << b for b in group if b not in blank)
            out.append(value - (1 << 64) if value >> 63 else value)
    return out


def links_of_file(prints: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among distinct fingerprints, one per entry at most."""
    left = prints
    a, b = [], []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        front = left[:0]
        near = np.bitwise_count(left ^ seed) <= reach
        front, left = left[near], left[~near]
        while len(front):
            a.append(front)
            b.append(np.full(len(front), seed))
            reached = np.zeros(len(left), dtype=bool)
            for x in front:
                rest = np.flatnonzero(~reached)
                if not len(rest):
                    break
                reached[rest[np.bitwise_count(left[rest] ^ x) <= reach]] = True
            front, left = left[reached], left[~reached]
    none = prints[:0]
    return np.concatenate(a) if a else none, np.concatenate(b) if b else none


def links_of_files(files: np.ndarray, prints: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal ``files`` (sorted).  A link may stand for a path inside its file."""
    heads = np.flatnonzero(np.diff(files, prepend=files[0] - 1)) if len(files) else np.zeros(0, dtype=int)
    sizes = np.diff(np.append(heads, len(files)))
    a, b = [prints[:0]], [prints[:0]]
    for h, s in zip(heads[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        x, y = links_of_file(prints[h:h + s], reach)
        a.append(x)
        b.append(y)
    small = np.repeat(sizes <= SMALL, sizes)
    end = np.repeat(heads + sizes, sizes)
    rows = np.flatnonzero(small)
    for d in range(1, SMALL):
        rows = rows[rows + d < end[rows]]
        if not len(rows):
            break
        near = np.bitwise_count(prints[rows] ^ prints[rows + d]) <= reach
        a.append(prints[rows[near]])
        b.append(prints[rows[near] + d])
    return np.concatenate(a), np.concatenate(b)


def links(prints: DataFrame, reach: int = REACH) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links."""
    n = prints.count()
    taken = prints.filter(share(F.col("fp"), F.lit(3)) < SAMPLE / max(n, 1)).select("fp").toArrow()["fp"].to_numpy()
    every = masks(plan(taken.astype(np.int64).view(np.uint64), n, reach))
    filed = (prints.select("fp", F.posexplode(F.array(*[F.lit(m) for m in every])).alias("file", "mask"))
             .select(F.xxhash64("file", F.col("fp").bitwiseAND(F.col("mask"))).alias("file"), "fp"))

    def run(batches):
        files, fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

        def out(upto):
            x, y = links_of_files(files[:upto], fps[:upto], reach)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        for batch in batches:
            files = np.concatenate([files, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            # The last file may go on in the next batch.
            whole = int(np.searchsorted(files, files[-1])) if len(files) else 0
            if whole:
                yield out(whole)
                files, fps = files[whole:], fps[whole:]
        yield out(len(files))

    return filed.repartition("file").sortWithinPartitions("file").mapInArrow(run, "a bigint, b bigint")


def grouped(prints: DataFrame, reach: int = REACH) -> DataFrame:
    """``fp`` and ``component_id`` (smallest id of its component) from the rows (fp, id)."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("id")), "prints")
    near = roots(links(distinct, reach)).withColumnRenamed("node", "fp")
    member = distinct.join(near, "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    member = materialise(member, "members")
    smallest = member.groupBy("root").agg(F.min("id").alias("component_id"))
    return member.join(smallest, "root").select("fp", "component_id")


def group(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """``row`` (the kept columns), ``id``, ``fp``, ``component_id`` and ``uid`` (a number of the row) for every document."""
    columns = keep or docs.columns
    marked = fingerprints(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, text, key])]), text, list(dict.fromkeys([*columns, key])))
    stored = materialise(marked.select(F.struct(*[F.col(f"row.`{c}`") for c in columns]).alias("row"), F.col(f"row.`{key}`").alias("id"), "fp",
                                       F.monotonically_increasing_id().alias("uid")), "fingerprints")
    return stored.join(grouped(stored.select("fp", "id"), reach), "fp")


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """A fingerprint of ``BLOCKS`` times 64 bits over distinct hashes of shingles; each block remixes them."""
    out = []
    for i in range(BLOCKS):
        h = (hashes ^ np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        out.append(majority(h ^ h >> np.uint64(29)))
    return np.concatenate(out).tobytes()


def reach_of(similarity: float) -> int:
    """Bits of a wide fingerprint in which texts of that Jaccard similarity differ, with one standard deviation of room."""
    share_of_bits = acos(2 * similarity / (1 + similarity)) / pi
    return int(WIDE * share_of_bits + sqrt(WIDE * share_of_bits * (1 - share_of_bits)))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One edge from each node but the smallest of its component to that smallest, for the edges (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[one], label[other])
        new = label.copy()
        np.minimum.at(new, one, least)
        np.minimum.at(new, other, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]


def wide_links_of_file(prints: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """As :func:`links_of_file` for rows of 64-bit words; pairs of row numbers."""
    left, out = np.arange(len(prints)), []
    while len(left) > 1:
        seed, left = int(left[0]), left[1:]
        front = [seed]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(prints[left] ^ prints[x]).sum(axis=1) <= reach
            found = left[near].tolist()
            out += [(i, seed) for i in found]
            front += found
            left = left[~near]
    return out


def whole_files(batches):
    """The rows of sorted batches as tables that end where the first column changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        first, last = held[0].column(0)[0].as_py(), batch.column(0)[-1].as_py()
        if first != last:
            table = pa.Table.from_batches(held).combine_chunks()
            whole = int(np.searchsorted(table.column(0).to_numpy(), last))
            yield table.slice(0, whole)
            held = table.slice(whole).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def similar_links(prints: DataFrame, reach: int) -> DataFrame:
    """Edges (a, b) between the nodes of rows (node, wide) that share a ``PART`` of their bits and differ in ``reach`` at most.

    The parts are partitions with threshold zero: any two fingerprints that
    differ in fewer bits than there are parts share one; :func:`all_pairs`
    finds the others.
    """
    def file(batches):
        for batch in batches:
            wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, WIDE // PART)
            parts = wide.shape[1]
            files = wide.astype(np.int64) | np.arange(parts, dtype=np.int64) << PART
            rows = pa.array(np.repeat(np.arange(batch.num_rows), parts))
            yield pa.RecordBatch.from_arrays([pa.array(files.ravel()), batch.column(0).take(rows), batch.column(1).take(rows)], names=["file", "node", "wide"])

    def compare(batches):
        for table in whole_files(batches):
            files, nodes = table.column(0).to_numpy(), table.column(1).to_numpy()
            words = np.frombuffer(b"".join(table.column(2).to_pylist()), dtype=np.uint64).reshape(len(files), BLOCKS)
            heads = np.flatnonzero(np.diff(files, prepend=files[0] - 1))
            ends = np.append(heads[1:], len(files))
            pairs = [(h + i, h + j) for h, e in zip(heads.tolist(), ends.tolist()) if e - h > SMALL for i, j in wide_links_of_file(words[h:e], reach)]
            a, b = [np.array([p[0] for p in pairs], dtype=np.int64)], [np.array([p[1] for p in pairs], dtype=np.int64)]
            end = np.repeat(ends, ends - heads)
            rows = np.flatnonzero(np.repeat(ends - heads <= SMALL, ends - heads))
            for d in range(1, SMALL):
                rows = rows[rows + d < end[rows]]
                if not len(rows):
                    break
                near = np.bitwise_count(words[rows] ^ words[rows + d]).sum(axis=1) <= reach
                a.append(rows[near])
                b.append(rows[near] + d)
            # Stars to the smallest node: files that hold the same group yield the same few edges.
            x, y = stars(nodes[np.concatenate(a)], nodes[np.concatenate(b)])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    filed = prints.select("node", "wide").mapInArrow(file, "file bigint, node bigint, wide binary")
    return filed.repartition("file").sortWithinPartitions("file").mapInArrow(compare, "a bigint, b bigint").distinct()


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of the shingles of ``WIDE_SHINGLE`` words, ascending."""
    return np.unique(shingle_hashes(text, WIDE_SHINGLE))


def frequent_shingles(thin: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ``KNOWN`` shingles that most texts hold, ascending, and in about how many (``thin`` has ``mark`` and ``text``).

    Every text is counted, copies within a stretch of a task once; each stretch
    reports the shingles that several of its texts hold.
    """
    def count(batches):
        sets, marks, held = [], set(), 0
        for batch in batches:
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if mark in marks:
                    continue
                marks.add(mark)
                sets.append(shingle_set(text.as_py()))
                held += len(sets[-1])
                if held >= COUNTED:
                    yield reported(sets)
                    sets, marks, held = [], set(), 0
        if sets:
            yield reported(sets)

    def reported(sets):
        shingles, n = np.unique(np.concatenate(sets), return_counts=True)
        top = np.flatnonzero(n > 1)
        if len(top) > REPORTED:
            top = top[np.argpartition(n[top], len(top) - REPORTED)[len(top) - REPORTED:]]
        return pa.RecordBatch.from_arrays([pa.array(shingles[top].view(np.int64)), pa.array(n[top])], names=["shingle", "n"])

    found = thin.select("mark", "text").mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = found.orderBy(F.desc("n"), "shingle").limit(KNOWN).toArrow()
    shingles = counts["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], counts["n"].to_numpy()[order]


def outline(shingles: np.ndarray) -> bytes:
    """For each remainder of the hashes a bit, set if an odd number of the shingles has it."""
    return np.packbits(np.bincount((shingles % np.uint64(OUTLINE)).astype(np.int64), minlength=OUTLINE) & 1 == 1).tobytes()


def outlines_allow(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets with the outlines (rows of words) ``x`` and ``y`` and ``sizes`` shingles together can have the similarity."""
    return np.bitwise_count(x ^ y).sum(axis=1) <= (1 - similarity) / (1 + similarity) * sizes + 1e-6


def prefix(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles in the common order, one of which any set of that similarity holds among its own first."""
    n = len(shingles)
    if not n:
        return shingles
    rank = np.zeros(n, dtype=np.int64)
    known, counts = frequent
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        rank = np.where(known[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, rank))[:n - ceil(similarity * n - 1e-9) + 1]]


def pairs_of_files(files, groups, sizes, places, shared, similarity: float):
    """Pairs of row numbers of different groups in runs of equal ``files``, ascending in ``sizes``, whose sizes, places and shared shingles allow the similarity.

    ``shared``: how many of a text's first shingles any other group has.
    """
    heads = np.flatnonzero(np.diff(files, prepend=files[0] - 1))
    ends = np.append(heads[1:], len(files))
    long = ends - heads > SMALL

    def allowed(x, y):
        least = similarity / (1 + similarity) * (sizes[x] + sizes[y]) - 1e-6
        most = 1 + np.minimum(places[x], places[y]) + np.minimum(sizes[x] - places[x], sizes[y] - places[y]) - 1
        held = np.minimum(shared[x], shared[y]) + np.ceil(np.maximum(sizes[x], sizes[y]) * similarity - 1e-9) - 1
        return (groups[x] != groups[y]) & (np.minimum(most, held) >= least)

    def near(x, y):
        return sizes[x] >= similarity * sizes[y] - 1e-6

    end = np.repeat(ends, ends - heads)
    rows = np.flatnonzero(np.repeat(~long, ends - heads))
    for d in range(1, SMALL):
        rows = rows[rows + d < end[rows]]
        rows = rows[near(rows, rows + d)]
        if not len(rows):
            break
        fit = rows[allowed(rows, rows + d)]
        yield fit, fit + d
    for h, e in zip(heads[long].tolist(), ends[long].tolist()):
        # Members of the largest group need no comparison with each other.
        names, which, count = np.unique(groups[h:e], return_inverse=True, return_counts=True)
        for x in (h + np.flatnonzero(which != count.argmax())).tolist():
            y = np.arange(h + int(np.searchsorted(sizes[h:e], similarity * sizes[x] - 1e-6)), h + int(np.searchsorted(sizes[h:e], (sizes[x] + 1e-6) / similarity, "right")))
            # Of two members of other groups the one that comes first compares.
            y = y[(y > x) | (which[y - h] == count.argmax())]
            y = y[allowed(np.full(len(y), x), y)]
            yield np.full(len(y), x), y


def with_company(files: np.ndarray, groups: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Whether a row, in runs of equal ``files`` ascending in ``sizes``, has one of another group and a size that allows the similarity in its run."""
    heads = np.flatnonzero(np.diff(files, prepend=files[0] - 1))
    counts = np.diff(np.append(heads, len(files)))
    # Runs apart on one axis, so that one search serves all of them.
    width = float(sizes.max(initial=0)) * 2 / similarity + 2
    base = np.repeat(np.arange(len(heads)), counts) * width
    axis = base + sizes
    low = np.searchsorted(axis, base + similarity * sizes - 1e-3)
    high = np.searchsorted(axis, base + sizes / similarity + 1e-3, "right") - 1
    changes = np.cumsum(np.diff(groups, prepend=groups[0]) != 0)
    return changes[high] > changes[low]


def spanning(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers of the edges (a, b) of a spanning forest that takes those that come first in ``order``."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = at[:len(a)][order], at[len(a):][order]
    label, live, chosen = np.arange(len(nodes)), np.arange(len(order)), []
    while True:
        x, y = label[one[live]], label[other[live]]
        live, x, y = live[x != y], x[x != y], y[x != y]
        if not len(live):
            return order[np.concatenate(chosen)] if chosen else order[:0]
        # Each tree takes the first edge that leaves it.
        first = np.full(len(nodes), len(order))
        np.minimum.at(first, x, live)
        np.minimum.at(first, y, live)
        taken = np.unique(first[first < len(order)])
        chosen.append(taken)
        node, root = stars(label[one[taken]], label[other[taken]])
        step = np.arange(len(nodes))
        step[node] = root
        label = step[label]


def shared_entries(filed: DataFrame, similarity: float, folder: Folder) -> DataFrame:
    """Of the rows (node, grp, size, first) the entries, written, (file, node, grp, measure) whose shingle a text of another group and a fitting size holds among its first too.

    Most shingles are one text's own; what is left is small.
    """
    rows = filed.select(F.posexplode("first").alias("place", "file"), "node", "grp", "size")
    rows = rows.select("file", "node", "grp", (F.shiftleft(F.col("size").cast("bigint"), 32) + F.col("place")).alias("measure"))

    def several(batches):
        for table in whole_files(batches):
            files, groups, measure = (table.column(i).to_numpy() for i in (0, 2, 3))
            yield from table.filter(pa.array(with_company(files, groups, measure >> 32, similarity))).to_batches()

    return folder.write(rows.repartition("file").sortWithinPartitions("file", "measure").mapInArrow(several, rows.schema))


def in_files(entries: DataFrame, outlines: DataFrame) -> DataFrame:
    """The entries with their nodes' ``outlines`` (node, outline) and ``shared``, the number of a node's entries, file by file."""
    of_node = entries.groupBy("node").agg(F.count(F.lit(1)).alias("shared")).join(outlines, "node")
    entries = entries.join(of_node, "node").select("file", "node", "grp", "measure", "shared", "outline")
    return entries.repartition("file").sortWithinPartitions("file", "measure")


def candidates(table: pa.Table, similarity: float):
    """Row numbers (a, b), the smaller node first, of pairs in the files of :func:`in_files`'s rows that may be similar, and the share of their shingles in which they differ by their outlines."""
    files, nodes, groups, measure, shared = (table.column(i).to_numpy() for i in range(5))
    words, sizes = np.frombuffer(b"".join(table.column(5).to_pylist()), dtype=np.uint64).reshape(len(files), -1), measure >> 32
    for a, b in pairs_of_files(files, groups, sizes, measure & (1 << 32) - 1, shared, similarity):
        fit = outlines_allow(words[a], words[b], sizes[a] + sizes[b], similarity)
        a, b = a[fit], b[fit]
        if len(a):
            a, b = np.where(nodes[a] < nodes[b], a, b), np.where(nodes[a] < nodes[b], b, a)
            yield a, b, np.bitwise_count(words[a] ^ words[b]).sum(axis=1) / np.maximum(sizes[a] + sizes[b], 1)


def first_pairs(filed: DataFrame, similarity: float) -> DataFrame:
    """Of the candidates in the rows of :func:`in_files` those (a, b, ga, gb) that connect what all of them connect, groups being one node each: fewer in a stretch of files than it has groups, the most alike ones."""
    def run(batches):
        for table in whole_files(batches):
            groups, nodes = table.column(2).to_numpy(), table.column(1).to_numpy()
            held: list[tuple] = []
            more = 0

            def forest():
                a, b, apart = (np.concatenate(x) for x in zip(*held))
                kept = spanning(groups[a], groups[b], np.lexsort((nodes[b], nodes[a], apart)))
                return a[kept], b[kept], apart[kept]

            for found in candidates(table, similarity):
                held.append(found)
                more += len(found[0])
                if len(held) > 1 << 12 or more > 1 << 20:
                    held, more = [forest()], 0
            if held:
                a, b, apart = forest()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes[a], nodes[b], groups[a], groups[b], apart)], names=["a", "b", "ga", "gb", "apart"])

    found = filed.mapInArrow(run, "a bigint, b bigint, ga bigint, gb bigint, apart double")
    best = F.min_by(F.struct("a", "b", "ga", "gb"), F.struct("apart", "a", "b")).alias("p")
    return found.groupBy(F.least("ga", "gb").alias("g"), F.greatest("ga", "gb").alias("h")).agg(best).select("p.*")


def all_pairs(filed: DataFrame, similarity: float) -> DataFrame:
    """All candidates (a, b) in the rows of :func:`in_files` whose number of shared shingles allows the similarity."""
    names = ["a", "b", "x", "y"]

    def run(batches):
        for table in whole_files(batches):
            nodes, sizes = table.column(1).to_numpy(), table.column(3).to_numpy() >> 32

            def batch_of():
                one, other = (np.concatenate(x) for x in zip(*seen))
                pairs = pa.table([nodes[one], nodes[other], sizes[one], sizes[other]], names=names)
                return pairs.group_by(names).aggregate([([], "count_all")]).rename_columns([*names, "n"]).to_batches()

            seen, held = [], 0
            for a, b, _ in candidates(table, similarity):
                seen.append((a, b))
                held += len(a)
                if held > 1 << 20 or len(seen) > 1 << 14:
                    yield from batch_of()
                    seen, held = [], 0
            if seen:
                yield from batch_of()

    schema = ", ".join(f"{c} bigint" for c in [*names, "n"])
    found = filed.mapInArrow(run, schema).groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("x").alias("x"), F.first("y").alias("y"))
    # Shared shingles beyond the shorter prefix are the rest of one set at most.
    rest = F.ceil(F.greatest("x", "y") * similarity - 1e-9) - 1
    return found.filter(F.col("n") + rest >= similarity / (1 + similarity) * (F.col("x") + F.col("y")) - 1e-6).select("a", "b")


def still_apart(first: DataFrame, joined: DataFrame) -> DataFrame:
    """The groups that candidates connect but links do not: ``grp`` and ``now``, its group by the links ``joined`` (node, root), for the pairs (ga, gb) of :func:`first_pairs`."""
    asked = first.select(F.explode(F.array("ga", "gb")).alias("grp")).distinct()
    within = roots(first.select(F.col("ga").alias("a"), F.col("gb").alias("b"))).select(F.col("node").alias("grp"), F.col("root").alias("part"))
    now = joined.select(F.col("node").alias("grp"), F.col("root").alias("now"))
    of_group = asked.join(within, "grp", "left").join(now, "grp", "left").select("grp", F.coalesce("part", "grp").alias("part"), F.coalesce("now", "grp").alias("now"))
    of_group = materialise(of_group, "asked")
    parts = of_group.groupBy("part").agg(F.min("now").alias("low"), F.max("now").alias("high")).filter("low <> high").select("part")
    return of_group.join(parts, "part").select("grp", "now")


def verified(pairs: DataFrame, alike: DataFrame, thin: DataFrame, similarity: float, folder: Folder) -> DataFrame:
    """The pairs (a, b), written, whose sets of shingles have the Jaccard similarity; ``alike`` names a document (id, mark) of each node."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    text = alike.join(asked, "node").select("node", F.coalesce(F.col("first.id").cast("string"), F.lit("")).alias("id"), "first.mark")
    text = thin.withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit(""))).join(text, ["id", "mark"]).select("node", "text")
    sets = annotate(text, "text", ["node"], "shingles binary", lambda: lambda texts: {"shingles": [shingle_set(t).tobytes() for t in texts]})
    # Repeated rows have the same set.
    sets = folder.write(sets.select("row.node", "shingles").dropDuplicates(["node"]))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and both / (len(x) + len(y) - both) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    found = folder.write(pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"))
    folder.discard(sets)
    return found


def one_of_similar(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = 0.8) -> DataFrame:
    """One document of each group of similar texts stays, the one with the smallest id, in the documents' own columns.

    Texts link at a Jaccard similarity of ``similarity`` or more over their sets
    of shingles of ``WIDE_SHINGLE`` words.
    """
    mark = F.xxhash64(F.col(f"`{text}`").cast("string"))
    thin = docs.select(F.col(f"`{key}`").alias("id"), mark.alias("mark"), F.col(f"`{text}`").cast("string").alias("text"))
    frequent = frequent_shingles(thin)

    def work(texts):
        sets = [shingle_set(t) for t in texts]
        return {"wide": [wide_fingerprint(s) for s in sets], "node": [xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets],
                "size": [len(s) for s in sets], "outline": [outline(s) for s in sets], "first": [prefix(s, frequent, similarity).view(np.int64) for s in sets]}

    prints = annotate(thin, "text", ["id", "mark"], "wide binary, node bigint, size int, outline binary, first array<bigint>", lambda: work)
    folder = Folder(docs.sparkSession, "similar")
    prints = folder.write(prints.select("row.id", "row.mark", "wide", "node", "size", "outline", F.col("first").alias("start")))
    alike = prints.groupBy("node").agg(F.any_value("wide").alias("wide"), F.any_value("size").alias("size"), F.any_value("outline").alias("outline"), F.any_value("start").alias("start"),
                                       F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first"))
    alike = folder.write(alike)
    names = folder.write(prints.select("id", "mark", "node"))
    folder.discard(prints)
    links = folder.write(similar_links(alike, reach_of(similarity)))
    close = verified(links, alike, thin, similarity, folder)
    groups = materialise(roots(close), "groups")
    filed = alike.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("grp"), "size", F.col("start").alias("first"))
    entries, outlines = shared_entries(filed, similarity, folder), alike.select("node", "outline")
    # One link joins two groups: first what connects all that candidates connect, then all pairs of groups that this leaves apart.
    first_of = folder.write(first_pairs(in_files(entries, outlines), similarity))
    first = verified(first_of.select("a", "b"), alike, thin, similarity, folder)
    joined = materialise(roots(close.unionByName(first)), "joined")
    again = entries.join(still_apart(first_of, joined), "grp").select("file", "node", F.col("now").alias("grp"), "measure")
    pairs = folder.write(all_pairs(in_files(again, outlines), similarity).join(first_of.select("a", "b"), ["a", "b"], "left_anti"))
    folder.discard(entries)
    others = verified(pairs, alike, thin, similarity, folder)
    near = materialise(roots(close.unionByName(first).unionByName(others)), "roots")
    folder.discard(alike)
    member = names.join(near, "node", "left").select("id", "mark", F.coalesce("root", "node").alias("root"))
    first = member.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first")).select("first.id", "first.mark")
    # Repeated rows of the one that stays: the join has brought them together by id and text.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"), mark.alias("mark"))
    first = first.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "mark")
    one = Window.partitionBy("id", "mark").orderBy(F.lit(1))
    return keyed.join(first, ["id", "mark"]).withColumn("n", F.row_number().over(one)).filter("n = 1").select("row.*")


def one_of_each(found: DataFrame) -> DataFrame:
    """Of :func:`group`'s rows one per component, the one with the smallest id, in the documents' own columns."""
    first = found.groupBy("component_id").agg(F.min_by("uid", F.struct(F.col("id").isNull(), "id", "uid")).alias("uid")).select("uid")
    return found.join(first, "uid", "left_semi").select("row.*")


def hexadecimal(fp: F.Column) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
