import hashlib
import math
import random
import re
import time

import pytest

from slotwise.llm import secrets
from slotwise.llm.queries import op1_secrets

PATTERNS = (
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20),
    ("hex", re.compile(r"[0-9a-f]+"), 24),
)


def base(text):
    out = []
    for rank, (kind, p, least) in enumerate(PATTERNS):
        for m in p.finditer(text or ""):
            if len(m.group(2) if kind == "assign" else m.group()) >= least:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def samples():
    rng = random.Random(1)
    pieces = ["password=", "token: \"", "SECRET ='", "api_key=", "apikey:", "passwd", "=", ":", "AKIA", "akia", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "abc", "\n", " ", "𝒳", "é", "\"",
              "'", "token=secret:abcdefgh", "K", "ſecret=", "...", "a" * 30]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(200)] + [None, "", "password", "token=" + "x" * 50000, "word " * 20000 + "token=abcdef1"]


def test_base_spans_and_digest(spark, folder, documents):
    texts = samples()
    got = {r.doc_id: r for r in op1_secrets(spark, folder(documents=documents(texts, extra=("base", "tokens", "least")))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base(t)
        digest = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert got[i].base_sha256 == hashlib.sha256(digest.encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(w[3] == k for w in want) for k in ("assign", "access", "hex"))
        assert set(digest.split(",")) <= set(got[i].spans.split(","))
    assert op1_secrets(spark, folder(documents=documents([]))).count() == 0


def test_battery_tells_random_tokens_from_written_ones(spark):
    rng = random.Random(2)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]
    random_ones = ["".join(rng.choices(a, k=n)) for a in alphabets for n in (40, 64) for _ in range(30)]
    written = ["some_module_name_v2_final_release", "2024-01-15-meeting-notes-draft", "path/to/the/component/file2", "AbstractFactoryBuilder2000", "chapter12-introduction-to-things",
               "customer-account-number-123456"] * 10
    rows = [(i, f"see {t} here") for i, t in enumerate(random_ones + written)]
    found = secrets.scan(spark.createDataFrame(rows, "id int, text string"), keep=["id"]).select("row.id", secrets.joined("spans").alias("s")).collect()
    flagged = {r.id for r in found if "random" in r.s}
    n = len(random_ones)
    assert len([i for i in flagged if i < n]) >= 0.9 * n
    assert not [i for i in flagged if i >= n]
    assert all(f"random:4:{4 + len(random_ones[r.id])}" in r.s for r in found if r.id in flagged)


def flagged_spans(spark, tokens):
    rows = [(i, f"see {t} here") for i, t in enumerate(tokens)]
    found = secrets.scan(spark.createDataFrame(rows, "id int, text string"), keep=["id"]).select("row.id", secrets.joined("spans").alias("s")).collect()
    return {r.id: [tuple(map(int, x.split(":")[1:])) for x in r.s.split(",") if x.startswith("random")] for r in found}


def test_tokens_with_separators_and_without_digits(spark):
    rng = random.Random(3)
    draw = lambda a, n: "".join(rng.choices(a, k=n))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    shapes = {
        "uuid": lambda: "-".join(draw("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
        "prefix": lambda: "prefix_" + draw("0123456789abcdef", 40),
        "key id": lambda: "key-id-" + draw(lower + digits, 40),
        "licence": lambda: "-".join(draw(upper + digits, 5) for _ in range(6)),
        "letters": lambda: draw(upper + lower, 32),
    }
    names = [n for n in shapes for _ in range(30)]
    tokens = [shapes[n]() for n in names]
    got = flagged_spans(spark, tokens)
    for n in shapes:
        hit = [i for i, m in enumerate(names) if m == n and got[i]]
        assert len(hit) >= 0.8 * 30, (n, len(hit))


def test_long_random_tokens(spark):
    rng = random.Random(4)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(rng.choices(a, k=n)) for a in (base62, base62 + "+/", base62 + "_-") for n in (2000, 10000) for _ in range(5)]
    got = flagged_spans(spark, tokens)
    assert all(got[i] == [(4, 4 + len(t))] for i, t in enumerate(tokens))


@pytest.mark.parametrize("z,p", [(0.0, 0.5), (1.0, 0.158655), (-1.0, 0.841345), (3.0, 0.00134990), (6.0, 9.8659e-10)])
def test_upper_tail(spark, z, p):
    from pyspark.sql import functions as F
    got = spark.range(1).select(secrets.upper_tail(F.lit(z))).first()[0]
    assert abs(got / p - 1) < 2e-3


def plain_battery(token):
    """Statistics of one token by their definitions; none where no encoding fits."""
    order = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-"
    encoding = lambda t: next((a for shape, a in secrets.ENCODINGS if re.search(shape, t)), None)
    core = token if encoding(token) else re.sub("[+/_-]", "", token)
    alphabet = encoding(core)
    if alphabet is None:
        return None
    n, k = len(core), len(alphabet)
    kind = lambda c: "0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "-"
    chi = sum((core.count(c) - n / k) ** 2 / (n / k) for c in alphabet)
    runs = sum(kind(a) != kind(b) for a, b in zip(core, core[1:]))
    codes = [order.index(c) for c in core]
    mean = sum(codes) / n
    spread = sum((c - mean) ** 2 for c in codes)
    serial = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / spread if spread > 1e-9 else 1.0
    z = ((k - 1 + 0.8 * n - chi) / math.sqrt(2 * (k - 1 + 1.6 * n)) + (runs - 0.2 * (n - 1)) / math.sqrt(0.16 * (n - 1)) + (0.4 - serial) * math.sqrt(n) / 0.84) / math.sqrt(3)
    same = sum((sum(kind(c) == x for c in alphabet) / k) ** 2 for x in "0Aa-")
    runs_random = (runs - (n - 1) * (1 - same)) / math.sqrt(max((n - 1) * same * (1 - same), 1e-9))
    random_too = abs(chi - k + 1) <= 4 * math.sqrt(2 * (k - 1)) and abs(runs_random) <= 4 and abs(serial) * math.sqrt(n) <= 4
    return n, math.erfc(z / math.sqrt(2)) / 2, random_too


def mixed_tokens():
    rng = random.Random(5)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGH234567", "abcdefghij01", "abc-def_1", "aB1+/", "aB1-_xyz", "aaaaab1", "abcdefgh", "aB", "0123456789", "+/_-a1"]
    return ["".join(rng.choices(a, k=n)) for a in alphabets for n in (16, 23, 40, 300) for _ in range(4)] + ["a" * 15 + "1", "1" + "a" * 15, "-" * 16, "A" * 8 + "b" * 8]


def test_battery_equals_plain_statistics(spark):
    from pyspark.sql import functions as F
    tokens = mixed_tokens()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "id int, t string").select("id", secrets.battery(F.col("t")).alias("b")).collect()
    tested = 0
    for r in rows:
        want = plain_battery(tokens[r.id])
        assert (r.b is None) == (want is None), tokens[r.id]
        if want:
            tested += 1
            assert (r.b.size, r.b.random) == (want[0], want[2]), tokens[r.id]
            assert abs(r.b.p - want[1]) <= 2e-3 * min(want[1], 1 - want[1]) + 1e-6, tokens[r.id]
    assert tested > 100


def test_thresholds_are_the_step_up_procedure(spark):
    rng = random.Random(6)
    tokens = [(o, min(15000, int(rng.expovariate(1 / 20) + (400 if rng.random() < 0.1 * o else 0)))) for o in range(4, 9) for _ in range(200)]
    found = spark.createDataFrame([([{"octave": o, "bin": b}],) for o, b in tokens], "tokens array<struct<octave:int,bin:int>>")
    got = {r.octave: r.least for r in secrets.thresholds(found).collect()}
    want = {}
    for octave in range(4, 9):
        p = sorted(10 ** (-b / 50) for o, b in tokens if o == octave)
        passed = [v for i, v in enumerate(p, 1) if v <= 0.01 * len([x for x in p if x <= v]) / len(p)]
        if passed:
            want[octave] = round(-50 * math.log10(max(passed)))
    assert got == want and want


def test_positions_of_many_matches(spark):
    from pyspark.sql import functions as F
    rng = random.Random(7)
    texts = ["".join(rng.choices(["é", " ", "ab", "abab", "𝒳"], k=n)) for n in (0, 1, 2, 63, 200, 5000) for _ in range(3)] + ["ab" * 64, "ab " * 64, "ab " * 65, " ab" * 128, None, "x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", secrets.located(F.col("t"), "(?:ab)+").alias("m")).collect()
    for r in rows:
        assert [tuple(m) for m in r.m] == [(m.start(), m.end(), m.group()) for m in re.finditer("(?:ab)+", texts[r.id] or "")], texts[r.id]


def test_a_dump_of_keys_takes_linear_time(spark):
    rng = random.Random(8)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    dump = lambda n: " ".join("".join(rng.choices(base62, k=24)) for _ in range(n))
    took = []
    for n in (100, 100_000):
        table = spark.createDataFrame([(1, dump(n))], "id int, text string")
        begun = time.time()
        flagged = secrets.scan(table, keep=["id"]).selectExpr("size(spans)").first()[0]
        took.append(time.time() - begun)
        assert flagged >= 0.95 * n
    # At four milliseconds a token this was seven minutes.
    assert took[1] - took[0] < 60
