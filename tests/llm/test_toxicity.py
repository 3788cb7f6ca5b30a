import itertools
import math
import random

import numpy as np

from slotwise.llm import toxicity as tox
from slotwise.llm.queries import op2_toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    emission, moves, start = rng.normal(size=(3, 6)), rng.normal(size=(2, 2)), 0.3
    sizes = [6, 4, 1]
    alive = np.arange(6) < np.array(sizes)[:, None]
    one, pairs, log_sum = tox.chain(emission, alive, start, moves)
    for i, n in enumerate(sizes):
        total, marginal, both = 0.0, np.zeros(n), 0.0
        for path in itertools.product((0, 1), repeat=n):
            score = path[0] * start + sum(p * e for p, e in zip(path, emission[i])) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            total += math.exp(score)
            marginal += math.exp(score) * np.array(path)
            both += math.exp(score) * sum(a * b for a, b in zip(path, path[1:]))
        assert np.allclose(one[i, :n], marginal / total) and np.isclose(pairs[0, i].sum(), both / total) and np.isclose(log_sum[i], math.log(total))


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    field = tox.ToxicField(rng.normal(size=1 << tox.BITS), -1.0, -1.0, rng.normal(size=(2, 2)))
    texts = ["a bad day", "", None, "one", "bad bad " * 50, "a bad day"]
    together = field.scorer().score(texts)
    for i, t in enumerate(texts):
        alone = field.scorer().score([t])
        assert np.isclose(alone["score"][0], together["score"][i]) and [s["start"] for s in alone["toxic_spans"][0]] == [s["start"] for s in together["toxic_spans"][i]]


def corpus(n):
    rng = random.Random(3)
    plain = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    bad = ["zqvile", "zqnasty", "xxhorrid"]
    texts, toxic = [], []
    for _ in range(n):
        words, y = rng.choices(plain, k=rng.randint(20, 80)), int(rng.random() < 0.3)
        if y:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        toxic.append(y)
    return texts, toxic


def test_held_out_documents(spark, folder, documents):
    texts, toxic = corpus(900)
    rows = [(i, 1, y) for i, y in enumerate(toxic)] + [(0, 1, None), (None, 0, 1), (5, 1, toxic[5])]
    odd = [None, "", "!!", "word " * 30000]
    path = folder(documents=documents(texts + odd, extra=("score", "row", "key")), labels=(LABELS, rows))
    got = {r.doc_id: r for r in op2_toxicity(spark, path).collect()}
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [i for i in range(900) if got[i].held_out]
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.97
    assert [got[i].predicted for i in range(900, 904)] == [0] * 4


def test_spans_point_at_the_words(spark):
    texts, toxic = corpus(500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    field = tox.fit(docs, spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], LABELS))
    found = tox.score(docs, field, keep=["doc_id", "text"]).select("row.*", "toxic_spans").collect()
    words = {r.text[s.start:s.end] for r in found for s in r.toxic_spans}
    assert words & {"zqvile", "zqnasty", "xxhorrid"} and sum(w.split()[0][:2] in ("zq", "xx") for w in words) >= 0.8 * len(words)


def test_nothing_to_learn_from(spark, folder, documents):
    path = folder(documents=documents(["a", None]), labels=(LABELS, [(0, 1, 0)]))
    assert [(r.score, r.predicted) for r in op2_toxicity(spark, path).collect()] == [(0.0, 0)] * 2
    assert op2_toxicity(spark, folder(documents=documents([]), labels=(LABELS, []))).count() == 0
