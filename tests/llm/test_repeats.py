import hashlib
import random

import numpy as np
import pyarrow as pa

from slotwise.llm import repeats
from slotwise.llm.queries import op6_repeats


def brute(rows):
    """(id, text) rows in any order -> per row (n_bytes, n_removed, n_spans, digest)."""
    seen = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - 99):
            w = b[p:p + 100]
            at = (-1 if i is None else i, p)
            seen[w] = min(seen.get(w, at), at)
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - 99):
            if seen[b[p:p + 100]] < (-1 if i is None else i, p):
                gone[p:p + 100] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def samples(seed, n=40):
    rng = random.Random(seed)

    def prose(k):
        return " ".join(rng.choice(["ab", "é", "xyz", "q", "lorem"]) + str(rng.randint(0, 30)) for _ in range(k))

    passages = [prose(rng.choice([10, 25, 30, 60])) for _ in range(4)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and texts:
            t = rng.choice(texts)
        elif kind < 0.5 and texts:
            t = rng.choice(texts)
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(["Z", "", "insert "]) + t[at + rng.randint(0, 3):]
        elif kind < 0.7:
            t = prose(rng.randint(0, 30)) + rng.choice(passages) + prose(rng.randint(0, 30))
        elif kind < 0.8:
            t = rng.choice(["a", "ab", "line of text. ", "é"]) * rng.randint(1, 200)
        else:
            t = prose(rng.randint(0, 80))
        texts.append(t)
    return texts


def test_longest_previous_factors_by_definition():
    rng = np.random.default_rng(1)
    for _ in range(20):
        data = np.tile(rng.integers(0, 2, 150), 4).astype(np.uint8)
        data[rng.integers(0, len(data), 2)] ^= 1
        at = np.arange(len(data) - 99)
        place = rng.permutation(len(at))
        got = repeats.repeated_windows(repeats.suffix_ranks(data, at), place)
        text = data.tobytes()
        first = {}
        for i in at:
            w = text[i:i + 100]
            first[w] = min(first.get(w, place[i]), place[i])
        assert got.tolist() == [bool(first[text[i:i + 100]] < place[i]) for i in at]


def test_equal_windows_share_a_segment_gram():
    texts = [t.encode() for t in samples(3)]
    got = repeats.segments(texts)
    gram_of = {}
    windows = 0
    for i, s, n, g in zip(got["text"], got["start"], got["n"], got["gram"]):
        windows += n
        for p in range(s, s + n):
            assert gram_of.setdefault(texts[i][p:p + 100], g) == g
    assert windows == sum(max(0, len(t) - 99) for t in texts)


def test_meeting_is_the_same_in_any_batches():
    rng = random.Random(4)
    rows = sorted((rng.randint(0, 6), rng.randint(0, 2), rng.randint(0, 3), 0, rng.randint(0, 4), 5, False) for _ in range(60))
    names = ["gram", "digest", "id", "mark", "start", "n", "known"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]

    def run(size):
        parts = [rows[i:i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*p), types)], names=names) for p in parts]
        return sorted(tuple(r.values()) for b in repeats._meet(iter(batches)) for r in b.to_pylist())

    want = []
    for g, d, i, m, s, n, _ in rows:
        same = [r for r in rows if r[0] == g]
        later = any(r[1] == d and (r[2], r[4]) < (i, s) for r in same)
        if later or len({r[1] for r in same}) > 1:
            want.append((g, i, m, s, n, later))
    for size in (1, 2, 3, 7, 60):
        assert run(size) == sorted(want)


def check(spark, path, rows):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op6_repeats(spark, path).collect())
    assert got == sorted((str(i), *b) for (i, _), b in zip(rows, brute(rows)))


def test_query_equals_brute_force(spark, folder, documents):
    for seed in (1, 2):
        texts = samples(seed)
        ids = list(range(len(texts)))
        random.Random(seed).shuffle(ids)
        check(spark, folder(documents=documents(texts, ids=ids, extra=("id", "mark", "gram"))), list(zip(ids, texts)))


def test_edge_cases(spark, folder, documents):
    long = "".join(random.Random(0).choices("abcdefghij ", k=40000))
    texts = [None, "", "x" * 99, "x" * 100, "x" * 101, "short", long, long[5000:] + "é" * 80, long]
    check(spark, folder(documents=documents(texts)), list(enumerate(texts)))
    ids = [5, None, 5, 5]
    texts = [long[:300], long[:300], long[:300], long[200:500]]
    check(spark, folder(documents=documents(texts, ids=ids)), list(zip(ids, texts)))
    assert op6_repeats(spark, folder(documents=documents([]))).count() == 0


def test_small_pieces_and_batches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 300)
    texts = [t.encode() for t in samples(8)]
    got = repeats.segments(texts)
    assert int(got["n"].sum()) == sum(max(0, len(t) - 99) for t in texts)
    starts = sorted((int(i), int(p)) for i, s, n in zip(got["text"], got["start"], got["n"]) for p in range(s, s + n))
    assert starts == [(i, p) for i, t in enumerate(texts) for p in range(max(0, len(t) - 99))]


def shared(a, b):
    n = 0
    while n < 100 and a[n] == b[n]:
        n += 1
    return n


def test_neighbours_and_their_prefixes_by_definition():
    rng = np.random.default_rng(2)
    for round_ in range(15):
        data = np.tile(rng.integers(0, 2, 70 + 20 * (round_ % 3)), 5).astype(np.uint8)
        data[rng.integers(0, len(data), round_ % 4)] ^= 1
        at = np.arange(len(data) - 99)
        text = [data[i:i + 100].tobytes() for i in at]
        ranks = repeats.suffix_ranks(data, at)
        order = np.argsort(ranks, kind="stable")
        assert [text[i] for i in order] == sorted(text)
        common = repeats.common_prefixes(data, at[order])
        assert common.tolist() == [shared(text[i], text[j]) for i, j in zip(order, order[1:])]
        # Ties: some windows stand at one place.
        place = rng.integers(0, len(at), len(at)).astype(np.int32)[order]
        factors = repeats.previous_factors(place, common)
        found, prefix = repeats.previous_smaller(place, common, len(at).bit_length())
        for i in range(len(order)):
            smaller = [j for j in range(len(order)) if place[j] < place[i]]
            before = [j for j in smaller if j < i]
            assert found[i] == (before[-1] if before else -1)
            assert prefix[i] == (shared(text[order[before[-1]]], text[order[i]]) if before else 0)
            want = max([shared(text[order[j]], text[order[i]]) for j in smaller], default=0)
            assert factors[i] == 100 if want == 100 else want <= factors[i] < 100


def test_factors_of_one_window_and_of_none():
    assert repeats.previous_factors(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int16)).tolist() == []
    assert repeats.previous_factors(np.ones(1, dtype=np.int32), np.zeros(0, dtype=np.int16)).tolist() == [0]
    same = np.full(4, 100, dtype=np.int16)
    assert repeats.previous_factors(np.array([3, 1, 1, 5, 2], dtype=np.int32), same).tolist() == [100, 0, 0, 100, 100]
