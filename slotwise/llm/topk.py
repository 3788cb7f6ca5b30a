"""Exact top-k inner products: segment means and deviations bound each score, coarse to fine.

A vector is cut into segments.  For one segment of length l, with means m and
deviations d of query and candidate, the product is at most ``l * (m m' + d d')``
(and the distance at least what that leaves).  The sums over 1, 4 and 16 segments
bound the score ever closer; a candidate whose bound is below the query's k-th
exact score so far is dropped, the survivors are computed exactly.

Queries and candidates are dealt into blocks; each pair of blocks is one task
group, and each query's best of all blocks are merged.

Cases: vectors that are null or hold null or non-finite components take no part;
only vectors of the same length meet (a length of zero scores 0); ties go to the
smaller id, null ids last; repeated rows are candidates of each other; scores
beyond 64 bits are held at the limit; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.session import materialise

SCALE = 256
LEVELS = (1, 4, 16)
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 16384
#: Rows of a query block that are bounded at once.
STRIP = 128
_LIMIT = 2 ** 63 - 1


def prepared(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``uid``, ``key`` and the integer components ``v`` of the vectors that take part."""
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))), F.lit(False)))
    return (vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{vector}`").alias("x"))
            .filter(F.col("x").isNotNull() & finite)
            .select("uid", "key", F.transform("x", lambda c: F.floor(c.cast("double") * SCALE)).alias("v")))


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled so that a dot product of two rows bounds their score."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        part = x[:, a:b]
        parts += [part.mean(axis=1) * np.sqrt(b - a), part.std(axis=1) * np.sqrt(b - a)]
    return np.stack(parts, axis=1)


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``x`` with ``q``."""
    top = (int(np.abs(x).max(initial=0)) or 1) * (int(np.abs(q).max(initial=0)) or 1) * max(1, len(q))
    if top < 2 ** 52:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    wide = (x.astype(object) * q.astype(object)).sum(axis=1) if len(q) else np.zeros(len(x), dtype=object)
    return np.array([max(-_LIMIT, min(_LIMIT, int(s))) for s in wide], dtype=np.int64)


def best_of_block(queries: np.ndarray, query_uid: np.ndarray, x: np.ndarray, uid: np.ndarray, ids: np.ndarray, k: int):
    """For each query: positions and scores of its k best rows of ``x`` (its own row apart)."""
    if not x.shape[1]:
        for u in query_uid:
            rows = np.flatnonzero(uid != u)
            rows = rows[np.lexsort((uid[rows], ids[rows]))][:k]
            yield rows, np.zeros(len(rows), dtype=np.int64)
        return
    xf, qf = x.astype(np.float64), queries.astype(np.float64)
    levels = [(segment_features(qf, s), segment_features(xf, s)) for s in LEVELS]
    # Rounding of the bounds stays below this share of the largest possible product.
    slack = 1e-9 * (np.abs(qf).max(initial=0) * np.abs(xf).max(initial=0) * x.shape[1] + 1)
    for strip in range(0, len(queries), STRIP):
        rough = levels[0][0][strip:strip + STRIP] @ levels[0][1].T + slack
        for i, bound in enumerate(rough, start=strip):
            own = uid == query_uid[i]
            bound[own] = -np.inf
            alive = np.flatnonzero(~own)
            if not len(alive):
                yield alive, np.zeros(0, dtype=np.int64)
                continue
            floor = -np.inf
            for level in range(1, len(LEVELS) + 1):
                if len(alive) > 4 * k:
                    lead = alive[np.argpartition(-bound[alive], 4 * k)[:4 * k]]
                    floor = max(floor, np.sort(exact_scores(x[lead], queries[i]))[-k]) if len(lead) >= k else floor
                alive = alive[bound[alive] >= floor]
                if level < len(LEVELS):
                    bound[alive] = levels[level][1][alive] @ levels[level][0][i] + slack
            scores = exact_scores(x[alive], queries[i])
            order = np.lexsort((uid[alive], ids[alive], -scores))[:k]
            yield alive[order], scores[order]


def search(vectors: DataFrame, is_query: F.Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), the candidate's id and ``score`` for the rows where ``is_query`` holds (over ``key``)."""
    ready = materialise(prepared(vectors, key, vector).withColumn("q", F.coalesce(is_query, F.lit(False))), "vectors")
    n, nq = ready.agg(F.count(F.lit(1)), F.count_if("q")).first()
    blocks, query_blocks = -(-n // CANDIDATE_BLOCK) or 1, -(-nq // QUERY_BLOCK) or 1
    spread = F.xxhash64("uid")
    dim = F.size("v").alias("dim")
    queries = ready.filter("q").select("uid", "key", "v", dim, F.pmod(spread, F.lit(query_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"))
    rows = ready.select("uid", "key", "v", dim, F.pmod(spread, F.lit(blocks)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {"quid": [], "query_id": [], "uid": [], "id": [], "score": []}
        if len(q) and len(c):
            x, qs = np.array(c["v"].tolist(), dtype=np.int64).reshape(len(c), -1), np.array(q["v"].tolist(), dtype=np.int64).reshape(len(q), -1)
            # Null ids sort last.
            ids = c["key"].to_numpy(dtype=np.float64, na_value=np.nan) if c["key"].isna().any() else c["key"].to_numpy()
            uid = c["uid"].to_numpy()
            for quid, qid, (at, scores) in zip(q["uid"], q["key"], best_of_block(qs, q["uid"].to_numpy(), x, uid, ids, k)):
                out["quid"] += [quid] * len(at)
                out["query_id"] += [qid] * len(at)
                out["uid"] += uid[at].tolist()
                out["id"] += [None if pd.isna(v) else int(v) for v in c["key"].to_numpy()[at]]
                out["score"] += scores.tolist()
        return pd.DataFrame({"quid": pd.array(out["quid"], dtype="Int64"), "query_id": pd.array(out["query_id"], dtype="Int64"), "uid": pd.array(out["uid"], dtype="Int64"),
                             "id": pd.array(out["id"], dtype="Int64"), "score": pd.array(out["score"], dtype="Int64")})

    pair = ["dim", "qb", "cb"]
    near = (queries.withColumn("qb", F.col("qb").cast("int")).groupBy(*pair).cogroup(rows.groupBy(*pair))
            .applyInPandas(meet, "quid bigint, query_id bigint, uid bigint, id bigint, score bigint"))
    w = Window.partitionBy("quid").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
