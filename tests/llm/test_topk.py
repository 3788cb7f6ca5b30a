import math
import random

import numpy as np

from slotwise.llm import topk
from slotwise.llm.queries import op10_top_k

VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain(rows, k=5):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i is None or i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), j is None, j or 0, b) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q))
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j, _) in enumerate(scored[:k])]
    return sorted(out, key=str)


def run(spark, path):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in op10_top_k(spark, path).collect()), key=str)


def samples(n=260, dims=24):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(dims)]) for i in range(n)]
    rows += [(300, rows[7][1]), (301, rows[7][1]), (350, None), (400, [1.0, None]), (450, [float("nan")] * dims), (452, [float("inf")] * dims), (500, []), (501, []), (550, [1.0, 2.0]), (None, rows[3][1]),
             (50, rows[50][1]), (600, [1e6] * dims)]
    return rows


def test_query_equals_brute_force(spark, folder):
    rows = samples()
    path = folder(embeddings=(VECTORS + ", uid int, v string, score int", [(i, v, 0, 1, "x", 2) for i, v in rows]))
    assert run(spark, path) == plain(rows)
    assert run(spark, folder(embeddings=(VECTORS, []))) == []
    assert run(spark, folder(embeddings=(VECTORS, [(0, [1.0], 0)]))) == []


def test_many_blocks(spark, folder, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    rows = samples()
    assert run(spark, folder(embeddings=(VECTORS, [(i, v, 0) for i, v in rows]))) == plain(rows)


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(2)
    for dims in (1, 3, 24, 64):
        x = rng.integers(-300, 300, (50, dims)).astype(float)
        last = None
        for s in topk.LEVELS:
            f = topk.segment_features(x, s)
            bound = f @ f.T
            assert (bound + 1e-6 >= x @ x.T).all()
            assert last is None or (bound <= last + 1e-6).all()
            last = bound
