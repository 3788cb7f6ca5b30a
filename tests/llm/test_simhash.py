import random

import numpy as np
import xxhash

from slotwise.llm import simhash
from slotwise.llm.queries import op8_simhash
from slotwise.llm.stored import Folder


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints, reach=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= reach:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprint():
    rng = random.Random(1)
    for n in [0, 1, 3, 4, 5, 50, 400]:
        t = rng.choice([" ", "\n", " \t "]).join(rng.choice(["Ab", "é", "x1", "ÀB", " z", "q"]) for _ in range(n))
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def planted(n, seed):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5])):
                base ^= 1 << b
            out.append(base)
    return list(dict.fromkeys(out))


def test_plan_covers_every_link():
    rng = random.Random(3)
    sample = np.array([rng.getrandbits(64) for _ in range(500)], dtype=np.uint64)
    widths = []
    for n in (10, 10 ** 4, 10 ** 6, 10 ** 9, 10 ** 11):
        parts = simhash.plan(sample, n)
        widths.append(len(parts))
        ms = [m & (2 ** 64 - 1) for m in simhash.masks(parts)]
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in ms)
    assert widths[0] >= widths[-1]


def test_links_within_files():
    prints = planted(300, 5)
    x, y = simhash.links_of_file(np.array(prints, dtype=np.uint64), 4)
    assert len(x) < len(prints)
    want = plain_components(prints)
    at = {p: i for i, p in enumerate(prints)}
    root = {i: i for i in range(len(prints))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(x.tolist(), y.tolist()):
        root[find(at[a])] = find(at[b])
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), set()).add(i)
    plain = {}
    for i, r in enumerate(want):
        plain.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_components_of_many_prints(spark):
    prints = planted(1500, 9)
    rows = [(int(np.uint64(p).astype(np.int64)), i) for i, p in enumerate(prints)]
    got = {r.fp: r.component_id for r in simhash.grouped(spark.createDataFrame(rows, "fp bigint, id bigint")).collect()}
    assert [got[f] for f, _ in rows] == plain_components(prints)


def test_query_rows(spark, folder, documents):
    rng = random.Random(2)
    base = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(400))
    texts = [base, base + " tail", base.upper(), "one two", "One  Two", "", None, " ", "a b c d e f", "long " * 20000, base.replace(" ", "\n")]
    got = {r.doc_id: r for r in op8_simhash(spark, folder(documents=documents(texts, extra=("fp", "component_id", "root")))).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == plain_components(prints)
    assert op8_simhash(spark, folder(documents=documents([]))).count() == 0
    twice = folder(documents=documents(["a b", "a b", "c d"], ids=[4, 4, None]))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in op8_simhash(spark, twice).collect()) == [("4", "4"), ("4", "4"), ("None", "None")]


def test_one_document_of_each_group_stays(spark, folder, documents):
    path = folder(documents=documents(["a b", "a  b", "A B", "c d", None], ids=[7, 3, 3, None, 1]))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = simhash.one_of_each(simhash.group(docs))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_texts(spark, folder, documents):
    rng = random.Random(6)
    texts = []
    for _ in range(60):
        words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(rng.randint(80, 300))]
        texts.append(" ".join(words))
        for edits in ([], [0, 2, 40, 80], [1])[rng.randint(0, 2)]:
            other = list(words)
            for _ in range(edits):
                other[rng.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
    texts += [texts[0], None, "", "a b", "a b c"]
    path = folder(documents=documents(texts, extra=("id", "mark", "wide", "n")))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = simhash.one_of_similar(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    n = len(texts) - 5
    missed = near = 0
    for i in range(n):
        best = max((jaccard(texts[i], texts[j]) for j in range(i)), default=0)
        if best >= 0.8:
            near += 1
            missed += i in ids
        elif best < 0.6:
            assert i in ids
    assert near > 20 and missed <= 0.1 * near
    assert not {n, n + 2} & ids and {n + 1, n + 3, n + 4} <= ids
    twice = folder(documents=documents(["a b", "a b", "c d", "c d"], ids=[4, 4, None, None]))
    got = simhash.one_of_similar(spark.read.parquet(f"{twice}/documents.parquet")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["4", "None"]
    assert simhash.one_of_similar(spark.read.parquet(f"{folder(documents=documents([]))}/documents.parquet")).count() == 0


def edited_pairs(seed, n, low, high):
    """Pairs of texts whose five-word similarity lies in [low, high)."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(rng.randint(150, 300))]
        other = list(words)
        for _ in range(rng.randint(2, 12)):
            other[rng.randrange(len(other))] = "".join(rng.choices("klmnop", k=6))
        x, y = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (words, other))
        if low <= len(x & y) / len(x | y) < high:
            out.append((" ".join(words), " ".join(other)))
    return out


def kept_ids(spark, folder, documents, texts):
    path = folder(documents=documents(texts))
    return {r.doc_id for r in simhash.one_of_similar(spark.read.parquet(f"{path}/documents.parquet")).collect()}


def test_every_pair_at_the_similarity_is_found(spark, folder, documents):
    texts = [t for p in edited_pairs(21, 120, 0.8, 0.82) for t in p]
    assert kept_ids(spark, folder, documents, texts) == set(range(0, len(texts), 2))


def test_pairs_of_files_are_those_of_brute_force():
    rng = random.Random(8)
    sizes = [20, 22, 24, 25, 30]
    for n in (5, 40, 200):
        rows = sorted((f, rng.choice(sizes), rng.randint(0, 5), rng.choice([1, 1, 1, 2, 3, 4]), rng.randint(1, 6)) for f in (1, 2) for _ in range(n))
        files, size, place, group, shared = (np.array(c) for c in zip(*rows))
        got = set()
        for a, b in simhash.pairs_of_files(files, group, size, place, shared, 0.8):
            new = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
            assert len(new) == len(a) and not new & got
            got |= new
        want = {(i, j) for j in range(len(rows)) for i in range(j) if files[i] == files[j] and group[i] != group[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j])
                and 9 * (1 + min(place[i], place[j]) + min(size[i] - place[i], size[j] - place[j]) - 1) >= 4 * (size[i] + size[j])
                # What two texts share: at most the first shingles that others hold too, and the rest of the larger one.
                and 9 * (min(shared[i], shared[j]) + -(-4 * max(size[i], size[j]) // 5) - 1) >= 4 * (size[i] + size[j])}
        assert got == want


def test_company_of_a_row_is_that_of_brute_force():
    rng = random.Random(13)
    for n in (1, 6, 60):
        rows = sorted((f, rng.choice([0, 1, 4, 5, 20, 22, 25, 30, 100]), rng.choice([1, 1, 1, 2, 3])) for f in (-7, 3, 9, 10) for _ in range(n))
        files, sizes, groups = (np.array(c) for c in zip(*rows))
        want = [any(f == files[i] and g != groups[i] and min(s, sizes[i]) >= 0.8 * max(s, sizes[i]) for f, s, g in rows) for i in range(len(rows))]
        assert simhash.with_company(files, groups, sizes, 0.8).tolist() == want


def test_outlines_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(12)
    dropped = 0
    for _ in range(300):
        n, edits = int(rng.integers(1, 2000)), int(rng.integers(0, 400))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[min(edits, len(x) - 1):], rng.integers(0, 1 << 63, edits // 2, dtype=np.uint64)]))
        bits = [np.frombuffer(simhash.outline(s), dtype=np.uint64)[None] for s in (x, y)]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(x, y))
        allowed = simhash.outlines_allow(*bits, np.array([len(x) + len(y)]), 0.8)[0]
        both = len(np.intersect1d(x, y))
        assert allowed or both / (len(x) + len(y) - both) < 0.8
        dropped += not allowed
    assert dropped > 100
    empty = np.zeros(0, dtype=np.uint64)
    assert simhash.outline(empty) == bytes(simhash.OUTLINE // 8)


def test_texts_below_the_similarity_stay(spark, folder, documents):
    texts = [t for p in edited_pairs(22, 40, 0.72, 0.799) for t in p]
    rng = random.Random(23)
    words = lambda n: ["".join(rng.choices("qrstuvwxyz", k=6)) for _ in range(n)]
    # A repeated line in two texts that are else unlike, and short texts that differ in the last word.
    line = words(16)
    texts += [" ".join(line * 30 + words(104)) for _ in range(2)]
    short = words(9)
    texts += [" ".join([*short, w]) for w in words(2)]
    assert kept_ids(spark, folder, documents, texts) == set(range(len(texts)))


def test_frequent_shingles_count_every_text(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 40)
    texts = [f"a b c d e f{i % 3} g h" for i in range(60)] + ["one of its own with no copy"] + ["a b c d e f0 g h"] * 9
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "mark long, text string").coalesce(1)
    shingles, n = simhash.frequent_shingles(df)
    known = dict(zip(shingles.tolist(), n.tolist()))
    assert known[int(simhash.shingle_hashes("a b c d e", 5)[0])] == 69
    assert int(simhash.shingle_hashes("one of its own with", 5)[0]) not in known
    assert (np.diff(shingles.astype(object)) > 0).all()


def test_a_text_outside_a_large_group_joins_it(spark, folder, documents):
    """A chain of near copies whose ends are unlike, and texts that are near to one member only."""
    rng = random.Random(31)
    base = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(120)]
    texts = []
    for i in range(0, 100, 2):
        base[i], base[i + 1] = f"x{i}", f"y{i}"
        texts.append(" ".join(base))
    alone = [" ".join(["".join(rng.choices("ijklmn", k=7)) for _ in range(120)]) for _ in range(5)]
    order = texts + alone
    rng.shuffle(order)
    kept = kept_ids(spark, folder, documents, order)
    assert kept == {order.index(t) for t in alone} | {min(order.index(t) for t in texts)}


def test_candidates_grow_with_the_entries_not_their_pairs(spark):
    """A large group and many near copies outside of it: one pair for each copy, where all pairs were proposed before."""
    rng = random.Random(11)
    base = [rng.getrandbits(63) for _ in range(100)]
    rows = []
    for node in range(400):
        held = np.unique(np.array([*base[:97], *[rng.getrandbits(63) for _ in range(3)]], dtype=np.uint64))
        rows.append((node, 0 if node < 340 else node, len(held), bytearray(simhash.outline(held)), simhash.prefix(held, (held[:0], held[:0]), 0.8).view(np.int64).tolist()))
    filed = spark.createDataFrame(rows, "node bigint, grp bigint, size int, outline binary, first array<bigint>")
    entries = simhash.shared_entries(filed, 0.8, Folder(spark, "similar"))
    table = simhash.in_files(entries, filed.select("node", "outline")).coalesce(1)
    pairs = simhash.first_pairs(table, 0.8)
    got = pairs.collect()
    assert len(got) <= 3 * 60
    edges = spark.createDataFrame([(r.ga, r.gb) for r in got], "a bigint, b bigint")
    assert {(r.node, r.root) for r in simhash.roots(edges).collect()} == {(n, 0) for n in range(340, 400)}


def test_spanning_forest_takes_the_first_edges():
    rng = np.random.default_rng(5)
    for n, m in [(2, 1), (6, 9), (40, 300), (40, 15)]:
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        a, b = a[a != b], b[a != b]
        order = rng.permutation(len(a))
        label, want = list(range(n)), set()
        for e in order.tolist():
            x, y = label[a[e]], label[b[e]]
            if x != y:
                want.add(e)
                label = [x if v == y else v for v in label]
        assert set(simhash.spanning(a, b, order).tolist()) == want


def test_groups_that_the_first_pairs_leave_apart(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21), (21, 22)], "ga bigint, gb bigint")
    joined = spark.createDataFrame([(2, 1), (11, 10), (21, 20), (22, 20), (30, 1)], "node bigint, root bigint")
    assert sorted(map(tuple, simhash.still_apart(pairs, joined).collect())) == [(1, 1), (2, 1), (3, 3)]
