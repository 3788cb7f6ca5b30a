import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slotwise.llm import lexical
from slotwise.llm.queries import op13_lexical_search

BENCH = "item_id bigint, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """Scores of all documents for all items, row by row."""
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for at, (doc, c) in enumerate(counted):
            n = sum(c.values())
            m = 25 + 75 * n * n_docs // total
            score = sum(times * floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in Counter(terms(text)).items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, at))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc, _) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, path):
    return sorted((tuple(r) for r in op13_lexical_search(spark, path).collect()), key=str)


def samples(n=400):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["Straße", "élan", "x1", "THE"]
    texts = ["the " + " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randrange(1, 40))) for _ in range(n)]
    texts += [None, "", "... --- !!", texts[0], texts[0], texts[1] + "!", "the the the", " ".join(rng.choices(words, k=60000))]
    ids = [*range(n + 6), 3, None]
    items = [(1, "the"), (2, "w1 w2 w3 w1"), (3, "w55 w40, W3; the x1"), (3, "STRASSE straße Straße"), (4, None), (5, ""), (6, "unknown words"), (None, "w7 the"), (8, " ".join(words)), (9, "élan-w0_w9"), (9, "élan-w0_w9")]
    return list(zip(ids, texts)), items


def table(documents, docs, extra=()):
    return documents([t for _, t in docs], ids=[i for i, _ in docs], extra=extra)


def test_query_equals_brute_force(spark, folder, documents):
    docs, items = samples()
    path = folder(documents=table(documents, docs, ("key", "item_id", "terms", "rank")), benchmark=(BENCH + ", number int, key string, score int", [(*r, 1, "k", 2) for r in items]))
    assert run(spark, path) == plain(docs, items)


@pytest.mark.parametrize("postings, read, block", [(1, 1, 1 << 20), (300, 3, 1 << 20), (1 << 20, 1, 40)])
def test_any_shards_reads_and_blocks(spark, folder, documents, monkeypatch, postings, read, block):
    for name, value in (("SHARD_POSTINGS", postings), ("FIRST_READ", read), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = samples(90)
    assert run(spark, folder(documents=table(documents, docs), benchmark=(BENCH, items))) == plain(docs, items)


def test_empty_tables(spark, folder, documents):
    docs, items = samples(20)
    assert run(spark, folder(documents=documents([]), benchmark=(BENCH, items))) == []
    assert run(spark, folder(documents=table(documents, docs), benchmark=(BENCH, []))) == []
    assert run(spark, folder(documents=table(documents, [(1, None), (2, "?")]), benchmark=(BENCH, items))) == []


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 30), st.integers(1, 6), st.integers(1, 12), st.integers(0, 2 ** 32 - 1), st.sampled_from([1, 2, 256]))
def test_intervals_resolve_membership_ties_and_scores(size, n_lists, k, seed, read):
    rng = np.random.default_rng(seed)
    lists, total = [], np.zeros(size, dtype=np.int64)
    for _ in range(n_lists):
        docs = rng.permutation(size)[:rng.integers(0, size + 1)]
        points = np.sort(rng.integers(0, 6, len(docs)))[::-1].astype(np.int64)
        lists.append((docs, points))
        total[docs] += points
    before, lexical.FIRST_READ = lexical.FIRST_READ, read
    try:
        found, scores = lexical.resolve(lists, size, k, least := int(rng.integers(1, 5)))
    finally:
        lexical.FIRST_READ = before
    want = sorted(((-s, d) for d, s in enumerate(total.tolist()) if s >= least))[:k]
    assert sorted((-s, d) for s, d in zip(scores.tolist(), found.tolist()))[:k] == want


def test_reading_stops_early():
    n = 100_000
    points = np.arange(n, 0, -1, dtype=np.int64) ** 2
    found, _ = lexical.resolve([(np.arange(n), points)], n, 3)
    assert 3 <= len(found) <= lexical.FIRST_READ
