import random
import re
from collections import defaultdict

from slotwise.llm import mixing
from slotwise.llm.queries import op5_mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    pool, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if pool * weight[s] / total > 2 * sizes[s]]
        if not above:
            return target | {s: pool * weight[s] / total for s in open_}
        for s in above:
            target[s] = 2 * sizes[s]
            pool -= target[s]
            open_.discard(s)
    return target


def samples(seed):
    rng = random.Random(seed)
    sources = ["b", "a", "Z", "é", "𝒳", "\uffff", None, "empty", "hot"]
    texts, names = [], []
    for _ in range(500):
        s = rng.choice(sources + ["hot"] * 4)
        texts.append("" if s == "empty" else rng.choice([" ", "\n\t", "\u00a0 "]).join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 40))))
        names.append(s)
    return texts + [None, "one " * 3000], names + ["a", "b"]


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, texts, names):
    sizes = defaultdict(int)
    for t, s in zip(texts, names):
        sizes[s] += size(t)
    target = plain_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for i, r in rows.items():
        s = names[i]
        assert (r["size"], r.source_size) == (size(texts[i]), sizes[s])
        assert abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.taken in (0, r["size"], 2 * r["size"]) and r.taken >= r["size"] * int(target[s] / sizes[s] if sizes[s] else 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 or s == "b"


def test_targets_and_taken_words(spark, folder, documents):
    for seed in (1, 2):
        texts, names = samples(seed)
        path = folder(documents=documents(texts, sources=names, extra=("size", "bucket", "row")))
        rows = {r.doc_id: r for r in op5_mixing(spark, path).collect()}
        assert len(rows) == len(texts)
        check(rows, texts, names)
        again = {r.doc_id: r for r in op5_mixing(spark, path).collect()}
        assert rows == again


def test_edges(spark, folder, documents):
    assert op5_mixing(spark, folder(documents=documents([]))).count() == 0
    rows = op5_mixing(spark, folder(documents=documents(["", None], sources=["a", None]))).collect()
    assert [(r["size"], r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2
    same = folder(documents=documents(["w w w"] * 200, sources=["a"] * 100 + ["b"] * 100, ids=[1] * 200))
    rows = op5_mixing(spark, same).collect()
    assert len(rows) == 200 and abs(sum(r.taken for r in rows) - 900) <= 6


def test_quality_weights_favour_plain_words(spark):
    from pyspark.sql import functions as F
    rows = [(i, ("words of plain text here " if i % 2 else "x ") * 20) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("size", mixing.size_of(F.col("text")))
    k = mixing.exponential_key(F.col("text"), F.col("id"), mixing.quality(F.col("text"), F.col("size")))
    first = df.withColumn("k", k).orderBy("k").limit(1000).select((F.col("id") % 2).alias("plain")).groupBy("plain").count().collect()
    count = {r.plain: r["count"] for r in first}
    assert count[1] > 1.3 * count[0]
