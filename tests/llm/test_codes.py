import hashlib
import math
import random

import numpy as np

from slotwise.llm import codes
from slotwise.llm.queries import op11_vector_codes

VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain(rows):
    """Lloyd rounds with full comparisons, in Python integers."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not good:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in good) // 16))
    limit = math.isqrt(2 ** 60 // (16 * width))
    parts = [[[max(-limit, min(limit, x)) for x in (v + [0] * 16 * width)[p * width:(p + 1) * width]] for p in range(16)] for _, v, _ in good]
    first = sorted(range(len(good)), key=lambda r: (good[r][0] is None, good[r][0] or 0, good[r][1]))[:64]
    books = [[list(parts[r][p]) for r in first] for p in range(16)]
    for step in range(3):
        found = [[min((sum((a - b) ** 2 for a, b in zip(x[p], e)), i) for i, e in enumerate(books[p])) for p in range(16)] for x in parts]
        if step < 2:
            for p in range(16):
                for i in range(len(books[p])):
                    mine = [x[p] for x, f in zip(parts, found) if f[p][1] == i]
                    if mine:
                        books[p][i] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for (_, _, g), e in zip(good, errors):
        sums[g] = sums.get(g, 0) + e
    return sorted(((i, "".join(f"{c:02x}" for _, c in f), e, min(sums[g], 2 ** 63 - 1), digest) for (i, _, g), f, e in zip(good, found, errors)), key=str)


def run(spark, path):
    return sorted((tuple(r) for r in op11_vector_codes(spark, path).collect()), key=str)


def samples(n=300, dims=32):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 0.4) for _ in range(dims)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(n)]
    # Coarse values make equal distances; copies make equal entries.
    rows += [(1000 + i, [rng.choice([0.0, 0.25]) for _ in range(dims)], 2) for i in range(80)]
    rows += [(5, rows[5][1], 7), (6, rows[9][1], None), (None, rows[3][1], 1), (2000, None, 1), (2001, [1.0, None], 1), (2002, [float("nan")] * dims, 1), (2003, [float("-inf")] * dims, 1)]
    return rows


def test_query_equals_full_rounds(spark, folder):
    rows = samples()
    path = folder(embeddings=(VECTORS + ", v string, row int, code string, errors int", [(*r, "x", 1, "c", 2) for r in rows]))
    assert run(spark, path) == plain(rows)


def test_odd_tables(spark, folder):
    assert run(spark, folder(embeddings=(VECTORS, []))) == []
    assert run(spark, folder(embeddings=(VECTORS, [(1, None, 1)]))) == []
    few = [(3, [0.5] * 20, 1), (1, [], None), (2, [0.25, -0.5], None), (2, [-1e30] * 7, 3), (9, [1e30] * 7, 3)]
    assert run(spark, folder(embeddings=(VECTORS, few))) == plain(few)
    empty = [(1, [], 1), (2, [], None)]
    assert run(spark, folder(embeddings=(VECTORS, empty))) == plain(empty)


def test_only_moved_entries_are_compared(monkeypatch):
    rng = np.random.default_rng(3)
    x, old = rng.integers(-4, 5, (500, 3)), rng.integers(-4, 5, (16, 3))
    code, error = codes.nearest(x, old)
    asked = []
    whole = codes.distances
    monkeypatch.setattr(codes, "distances", lambda rows, entries: asked.append(len(rows) * len(entries)) or whole(rows, entries))
    for moved_entries in ([], [3], [0, 5, 15], range(16)):
        new = old.copy()
        new[list(moved_entries)] += rng.integers(-2, 3, (len(moved_entries), 3))
        moved = (new != old).any(axis=1)
        asked.clear()
        got = codes.reassigned(x, code, error, new, moved)
        stale = int(moved[code].sum())
        assert sum(asked) == (stale * 16 + (500 - stale) * int(moved.sum()) if moved.any() else 0)
        want = whole(x, new)
        assert (got[0] == want.argmin(axis=1)).all() and (got[1] == want.min(axis=1)).all()


def test_tables_of_earlier_rounds_are_dropped(spark, folder):
    path = folder(embeddings=(VECTORS, samples(70)))
    found, _ = codes.encode(spark.read.parquet(f"{path}/embeddings.parquet"), keep=["vec_id"])
    files = found.inputFiles()
    assert files and all(f.split("/")[-2] == "2" for f in files)
    import os
    assert sorted(os.listdir(os.path.dirname(os.path.dirname(files[0].removeprefix("file:"))))) == ["2"]
