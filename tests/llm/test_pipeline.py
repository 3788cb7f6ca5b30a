import random
import re

import corpus_pipeline as cp
from slotwise.llm import pii
from .test_decontaminate import ITEMS, brute, plain_words
from .test_simhash import jaccard


def prose(rng, n, alphabet):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 7))) for _ in range(n))


def fixture_rows():
    rng = random.Random(11)
    alphabets = {"en": "etaoinsh", "de": "xzqwäöük"}
    items = [(i, prose(rng, 14, "etaoinsh")) for i in range(3)]
    texts, langs = [], []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        texts.append(prose(rng, rng.randint(40, 120), alphabets[lang]))
        langs.append(lang)
    texts[7] += " mail x@y.zw or 10.0.0.1 now"
    texts[8] = texts[8][:100] + " " + items[2][1] + " " + texts[8][100:]
    texts += [texts[1], texts[1].upper(), texts[2] + " tail", texts[4] + " " + items[0][1], items[1][1], texts[5] + " mail a@b.cd or 10.0.0.1",
              None, "", "123 456", "4111111111111111"]
    langs += ["en"] * 10
    return texts, langs, items


def test_stages_against_brute_force(spark, folder, documents):
    texts, langs, items = fixture_rows()
    sources = [["a", "b", None][i % 3] for i in range(len(texts))]
    path = folder(documents=documents(texts, langs=langs, sources=sources, extra=("row", "spans", "taken")), benchmark=(ITEMS, items))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontamination", "pii", "mixing"]

    def step(k, docs):
        out = cp.STAGES[k][1](spark, docs, path)
        assert k == 4 or out.columns == columns
        where = f"{path}/stage{k}"
        out.write.parquet(where)
        return spark.read.parquet(where)

    kept = step(0, docs)
    have = {r.doc_id: r.text for r in kept.collect()}
    assert set(have) == {i for i, t in enumerate(texts) if re.search("[^\\W\\d]", t or "")}

    one = step(1, kept)
    ids = sorted(have)
    left = {r.doc_id: r.text for r in one.collect()}
    assert set(left) == {i for i in ids if all(jaccard(have[i], have[j]) < 0.8 for j in ids if j < i)}

    clean = step(2, one)
    ids = sorted(left)
    found = brute([left[i] for i in ids], items)
    got = {r.doc_id: r for r in clean.collect()}
    assert set(got) == {i for i, (n, hit, _) in zip(ids, found) if hit < n}
    assert any(0 < hit < n for n, hit, _ in found)
    for i, (n, hit, _) in zip(ids, found):
        if i in got:
            assert len(plain_words(got[i].text)) == n - hit and got[i].n_chars == len(got[i].text)
            assert hit or got[i].text == left[i]

    masked = step(3, clean)
    for r in masked.collect():
        assert r.text == pii.masked(got[r.doc_id].text, pii.find(got[r.doc_id].text))
    assert any("[EMAIL]" in r.text for r in masked.collect())

    mixed = step(4, masked).collect()
    assert {r.doc_id for r in mixed} <= set(got)
    for s in ("a", "b", None):
        rows = [r for r in mixed if r.source == s]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows) and all(r.taken in (r.size, 2 * r.size) for r in rows)


def test_run_and_empty_table(spark, folder, documents):
    texts, langs, items = fixture_rows()
    path = folder(documents=documents(texts, langs=langs), benchmark=(ITEMS, items))
    first = sorted(map(tuple, cp.run(spark, path).collect()))
    assert first and first == sorted(map(tuple, cp.run(spark, path).collect()))
    empty = folder(documents=documents([]), benchmark=(ITEMS, []))
    assert cp.run(spark, empty).count() == 0
