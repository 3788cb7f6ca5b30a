import random

import numpy as np

from slotwise.llm import language
from slotwise.llm.queries import op7_language_id


def prose(rng, alphabet, n):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 7))) for _ in range(n))


def test_grams_by_definition():
    texts = ["Ab c!", "", "é1x"]
    buckets, starts = language.gram_buckets(texts)
    assert starts.tolist() == [0, 8, 11]
    alone, _ = language.gram_buckets(["ab C?"])
    assert np.array_equal(alone[:, :4], buckets[:, :4])
    blank = 1 << language.BITS
    assert buckets[0, 2] == blank and buckets[0, 0] != blank


def test_held_out_accuracy_and_rows(spark, folder, documents):
    rng = random.Random(5)
    kinds = {"aa": "etaoinshr", "bb": "qwxzjkvy", "cc": "éèàùç eau"}
    texts, langs = [], []
    for _ in range(300):
        lang = rng.choice(list(kinds))
        texts.append(prose(rng, kinds[lang], rng.randint(3, 40)))
        langs.append(lang)
    odd = [None, "", "123 !?", "x" * 100000, "漢字"]
    path = folder(documents=documents(texts + odd, langs=langs + [None] * 5, extra=("lang_pred", "row", "u")))
    got = {r.doc_id: r for r in op7_language_id(spark, path).collect()}
    assert len(got) == 305
    held = [i for i in range(300) if got[i].held_out]
    assert 40 < len(held) < 120
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.97
    assert [(got[i].lang_pred, got[i].score) for i in (300, 301, 302)] == [("und", 0.0)] * 3
    assert got[303].lang_pred == "bb" and got[304].lang_pred in kinds
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn_from(spark, folder, documents):
    rows = op7_language_id(spark, folder(documents=documents(["some text", None]))).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)] * 2
    assert op7_language_id(spark, folder(documents=documents([]))).count() == 0
