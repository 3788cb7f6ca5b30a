import hashlib
import random
import re

import numpy as np

from slotwise.llm import decontaminate as dec
from slotwise.llm.queries import op3_decontamination

ITEMS = "item_id bigint, text string"


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(texts, items):
    out = []
    for t in texts:
        w = plain_words(t)
        hit, ids = set(), set()
        for item, it in items:
            q = plain_words(it)
            for i in range(max(1, len(q) - 9) if q else 0):
                p = q[i:i + 10]
                for j in range(len(w) - len(p) + 1):
                    if w[j:j + len(p)] == p:
                        hit.update(range(j, j + len(p)))
                        ids.add(str(item))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def samples(seed, n_docs=40, n_items=12):
    rng = random.Random(seed)
    vocab = ["a", "b", "É", "c1", "ß", "Dd"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 2, 5, 10, 11, 14])))) for i in range(n_items)] + [(3, "a b"), (99, None), (98, "!!")]
    texts = []
    for _ in range(n_docs):
        w = rng.choices([*vocab, "x", "y"], k=rng.choice([0, 1, 5, 30, 120]))
        if rng.random() < 0.5:
            w[len(w) // 2:len(w) // 2] = (rng.choice(items)[1] or "").split()
        texts.append(rng.choice([" ", ", ", "\n"]).join(w))
    return [*texts, texts[0], "", None], items


def test_index_counts_and_locates():
    rng = np.random.default_rng(0)
    symbols = np.append(rng.integers(0, 4, 400), 0)
    index = dec.FMIndex(symbols, 3)
    phrases = [p for n in (1, 2, 3, 4) for p in np.stack(np.meshgrid(*[[1, 2, 3]] * n), -1).reshape(-1, n).tolist()]
    table = np.zeros((len(phrases), 4), dtype=np.int64)
    for i, p in enumerate(phrases):
        table[i, :len(p)] = p
    low, high = index.search(table, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(symbols)) if symbols[i:i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_shards_equal_brute_force():
    for seed in range(25):
        texts, items = samples(seed)
        got = dec.search_shard(texts, dec.phrases_of([(str(i), t) for i, t in items]))
        assert list(zip(got["n_words"], got["n_hit"], got["items"])) == brute(texts, items)


def check(spark, path, texts, items):
    got = {r.doc_id: r for r in op3_decontamination(spark, path).collect()}
    for i, (n, hit, ids) in enumerate(brute(texts, items)):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(ids), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


def test_query_rows(spark, folder, documents):
    texts, items = samples(100)
    check(spark, folder(documents=documents(texts, extra=("spans", "items", "id")), benchmark=(ITEMS, items)), texts, items)
    check(spark, folder(documents=documents(texts), benchmark=(ITEMS, [])), texts, [])
    assert op3_decontamination(spark, folder(documents=documents([]), benchmark=(ITEMS, items))).count() == 0


def test_blocks_of_a_large_benchmark(spark, folder, documents, monkeypatch):
    monkeypatch.setattr(dec, "BLOCK_BYTES", 60)
    texts, items = samples(7)
    check(spark, folder(documents=documents(texts), benchmark=(ITEMS, items)), texts, items)


def test_removed_spans(spark):
    df = spark.createDataFrame([("ab cd 𝒳 ef", [(3, 5), (8, 10)]), ("abc", [(0, 3)]), ("abc", []), (None, [])], "text string, spans array<struct<start:int,end:int>>")
    from pyspark.sql import functions as F
    assert [r[0] for r in df.select(dec.removed(F.col("text"), F.col("spans"))).collect()] == ["ab \n 𝒳 \n", "\n", "abc", None]
