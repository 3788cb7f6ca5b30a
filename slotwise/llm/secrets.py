"""Secret scan: fixed shapes, and tokens that pass a battery of randomness tests.

The base kinds are regular expressions.  The method then looks at every token of
``[A-Za-z0-9+/_-]``, infers its encoding from the symbols used (tokens that no encoding
fits: without ``+/_-``; tokens with these: their pieces of 16 or more as well), and
measures how far it is from written text towards random symbols:

* chi-squared: how uniform the symbols are over the encoding's alphabet;
* runs: how often the class of symbol (digit, upper, lower, other) changes;
* serial correlation of neighbouring symbol values.

Each test gives a z value under the model of written text (``TEXT_*``), the three
are combined by Stouffer's sum, and the p values are held to a false discovery
rate by Benjamini and Hochberg within each octave of token length, so that short
tokens, whose tests say little, never ride on long ones.  A token that is flagged
must also be compatible with a random one in each test.  All of it is DataFrame
expressions; the step-up thresholds come from counts per (octave, p bin).

Cases: null text counts as empty; empty text has no spans; tokens of one symbol
class besides ``+/_-`` are words or numbers and are not tested; ties in p share their fate;
repeated rows and an empty table need no special care; positions are code points.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.session import materialise

# The shapes of the base kinds, in the order of reports.
SHAPES = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
METHOD = "random"
KINDS = (*SHAPES, METHOD)

TOKEN = r"[A-Za-z0-9+/_-]{16,}"
#: Share of false ones among the flagged tokens of an octave.
RATE = 0.01
#: Standard deviations by which a flagged token may differ from a random one in any test.
REACH = 4.0
# Written text: excess of the chi-squared statistic per symbol, share of neighbours of different class, serial correlation.
TEXT_EXCESS, TEXT_CHANGES, TEXT_SERIAL = 0.8, 0.2, 0.4
BINS_PER_DECADE, TOP_BIN = 50, 15000
#: Matches whose positions are added up at a time.
BLOCK = 64

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHER = "+/_-"
_ORDER = _DIGITS + _UPPER + _LOWER + _OTHER
CLASSES = (_DIGITS, _UPPER, _LOWER, _OTHER)
# Alphabets by what their symbols must match, tried in this order.
ENCODINGS = (
    ("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGITS + _LOWER[:6]),
    ("^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + _UPPER[:6]),
    ("^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UPPER + _DIGITS[2:8]),
    ("^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", _DIGITS + _LOWER),
    ("^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", _DIGITS + _UPPER),
    ("^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("^(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+$", _UPPER + _LOWER),
    ("^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[0-9A-Za-z+/]+$", _DIGITS + _UPPER + _LOWER + "+/"),
    ("^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[0-9A-Za-z_-]+$", _DIGITS + _UPPER + _LOWER + "_-"),
)
# A token that is neither base64 nor base64url is tested without these, and so is each of its long pieces between them.
SEPARATORS, PIECE = "+/_-", "[A-Za-z0-9]{16,}"


def bound(value, use):
    """``use(value)`` with a value that is computed once however often it is used, in lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def located(text: F.Column, pattern: str) -> F.Column:
    """Array of (start, end, hit) of all matches, left to right, in code points.

    The pieces between the matches give the positions: running sums inside blocks of
    ``BLOCK`` matches, then over the blocks, so that many matches cost no more each than few.
    """
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    steps = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda h, p: F.struct(h.alias("hit"), F.length(p).alias("before")))

    def grow(acc, s):
        at = F.coalesce(F.try_element_at(acc, F.lit(-1)).end, F.lit(0)) + s.before
        return F.concat(acc, F.array(F.struct(at.alias("start"), (at + F.length(s.hit)).alias("end"), s.hit.alias("hit"))))

    def blocks(steps):
        # The last step is the text after the last match.
        of = lambda b: F.slice(steps, b * BLOCK + 1, F.least(F.lit(BLOCK), F.size(steps) - 1 - b * BLOCK))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 2) / BLOCK).cast("int")), lambda b: F.aggregate(of(b), none, grow))

    def offsets(parts):
        return F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(p, -1).end)))

    def shifted(parts):
        moved = F.zip_with(parts, F.slice(offsets(parts), 1, F.size(parts)), lambda p, at: F.transform(p, lambda m: F.struct((m.start + at).alias("start"), (m.end + at).alias("end"), m.hit.alias("hit"))))
        return F.flatten(moved)

    return F.when(F.rlike(text, F.lit(pattern)), bound(steps, lambda s: bound(blocks(s), shifted))).otherwise(none)


def base_spans(text: F.Column) -> F.Column:
    """Array of (start, order, end, kind) of the base kinds, in report order."""
    parts = []
    for order, (kind, shape) in enumerate(SHAPES.items()):
        # A shorter run than asked for can never be part of a longer one, so two kinds ask for the length at once.
        pattern = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}.get(kind, shape)
        found = located(text, pattern)
        if kind == "assign":
            found = F.filter(found, lambda s: F.length(F.regexp_extract(s.hit, SHAPES["assign"], 1)) >= LEAST["assign"])
        parts.append(_tagged(found, order, kind))
    return F.array_sort(F.concat(*parts))


def _tagged(found: F.Column, order: int, kind: str) -> F.Column:
    return F.transform(found, lambda s: F.struct(s.start.alias("start"), F.lit(order).alias("rank"), s.end.alias("end"), F.lit(kind).alias("kind")))


def upper_tail(z: F.Column) -> F.Column:
    """P(N(0, 1) > z) by a rational approximation of the error function (absolute error under 2e-7, relative under 1e-3 in the tail)."""
    # Coefficients of the complementary error function's Chebyshev fit, constant term first.
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)

    def half(v):
        power = F.lit(terms[-1])
        for c in reversed(terms[:-1]):
            power = power * v.t + c
        return v.t * F.exp(-v.x * v.x + power) / 2

    def tail(z):
        x = F.abs(z) / math.sqrt(2)
        return bound(bound(F.struct(x.alias("x"), (1 / (1 + x / 2)).alias("t")), half), lambda h: F.when(z >= 0, h).otherwise(1 - h))

    return bound(z, tail)


def _encoding(token: F.Column) -> F.Column:
    """Struct of the inferred alphabet: its size, and the chance that two random symbols are of one class; null where none fits."""
    found = F.lit(None).cast("struct<k:int,same:double>")
    for shape, symbols in reversed(ENCODINGS):
        classes = [sum(c in group for c in symbols) for group in CLASSES]
        same = sum(x * x for x in classes) / len(symbols) ** 2
        found = F.when(F.rlike(token, F.lit(shape)), F.struct(F.lit(len(symbols)).alias("k"), F.lit(same).alias("same"))).otherwise(found)
    return found


def battery(token: F.Column) -> F.Column:
    """Struct (size, p, random): the combined p value against written text, and whether all tests allow a random token.

    Null where no encoding is inferred, with the separators or without.
    """
    def infer(core):
        codes = F.transform(F.split(core, "(?!^|$)"), lambda c: F.instr(F.lit(_ORDER), c))
        return bound(_encoding(core), lambda e: F.when(e.isNotNull(), bound(codes, lambda c: _tests(c, e))))

    return bound(F.when(_encoding(token).isNotNull(), token).otherwise(F.translate(token, SEPARATORS, "")), infer)


def _moments(codes: F.Column) -> F.Column:
    """All sums of the tests in two passes: along the token, and over its symbols in order."""
    kind = lambda c: F.when(c <= 10, 0).when(c <= 36, 1).when(c <= 62, 2).otherwise(3)
    start = F.struct(F.lit(0).alias("last"), F.lit(-1).alias("kind"), F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("square"),
                     F.lit(0).cast("bigint").alias("product"), F.lit(-1).alias("runs"))
    along = F.aggregate(codes, start, lambda a, c: F.struct(
        c.alias("last"), kind(c).alias("kind"), (a.total + c).alias("total"), (a.square + c * c).alias("square"), (a.product + a["last"] * c).alias("product"),
        (a.runs + F.when(a.kind == kind(c), 0).otherwise(1)).alias("runs")))
    # The r-th copy of a symbol adds 2 r - 1 to the sum of squared counts.
    start = F.struct(F.lit(0).alias("last"), F.lit(0).cast("bigint").alias("copies"), F.lit(0).cast("bigint").alias("squares"))
    counted = F.aggregate(F.sort_array(codes), start, lambda a, c: F.struct(
        c.alias("last"), F.when(a["last"] == c, a.copies + 1).otherwise(F.lit(1).cast("bigint")).alias("copies"),
        (a.squares + F.when(a["last"] == c, 2 * a.copies + 1).otherwise(F.lit(1).cast("bigint"))).alias("squares")))
    return F.struct(F.size(codes).alias("n"), F.element_at(codes, 1).alias("first"), along.alias("along"), counted.squares.alias("squares"))


def _tests(codes: F.Column, encoding: F.Column) -> F.Column:
    k, same = encoding.k, encoding.same

    def statistics(m):
        n, a = m.n, m.along
        mean = a.total.cast("double") / n
        spread = a.square - a.total * mean
        lagged = a.product - mean * (2 * a.total - m.first - a["last"]) + (n - 1) * mean * mean
        return F.struct(n.alias("n"), a.runs.alias("runs"), (m.squares.cast("double") * k / n - n).alias("chi"), F.when(spread > 0, lagged / spread).otherwise(1.0).alias("serial"))

    def judged(s):
        n, root = s.n, F.sqrt(s.n.cast("double"))
        z_chi = ((k - 1) + n * TEXT_EXCESS - s.chi) / F.sqrt(2 * ((k - 1) + 2 * n * TEXT_EXCESS))
        z_runs = (s.runs - (n - 1) * TEXT_CHANGES) / F.sqrt((n - 1) * (TEXT_CHANGES * (1 - TEXT_CHANGES)))
        z_serial = (TEXT_SERIAL - s.serial) * root / (1 - TEXT_SERIAL ** 2)
        z_runs_random = (s.runs - (n - 1) * (1 - same)) / F.sqrt(F.greatest((n - 1) * same * (1 - same), F.lit(1e-9)))
        fits = (F.abs(s.chi - (k - 1)) <= REACH * F.sqrt(2.0 * (k - 1))) & (F.abs(z_runs_random) <= REACH) & (F.abs(s.serial) * root <= REACH)
        return F.struct(n.alias("size"), upper_tail((z_chi + z_runs + z_serial) / math.sqrt(3)).alias("p"), fits.alias("random"))

    return bound(bound(_moments(codes), statistics), judged)


def _octave(size: F.Column) -> F.Column:
    return F.floor(F.log2(size)).cast("int")


def tested(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``row``, ``base`` spans and the tested ``tokens`` (start, end, octave, p bin, random, piece) of each text."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    def with_pieces(found):
        pieces = F.transform(F.filter(found, lambda t: F.rlike(t.hit, F.lit("[+/_-]"))), lambda t: F.transform(located(t.hit, PIECE), lambda x: F.struct(
            (t.start + x.start).alias("start"), (t.start + x.end).alias("end"), x.hit.alias("hit"), F.lit(True).alias("piece"))))
        whole = F.transform(found, lambda t: F.struct(t.start.alias("start"), t.end.alias("end"), t.hit.alias("hit"), F.lit(False).alias("piece")))
        return F.concat(whole, F.flatten(pieces))

    tokens = F.transform(bound(located(F.col("text"), TOKEN), with_pieces), lambda t: F.struct(t.start.alias("start"), t.end.alias("end"), t.piece.alias("piece"), battery(t.hit).alias("b")))
    tokens = F.transform(F.filter(tokens, lambda t: t.b.isNotNull()), lambda t: F.struct(
        t.start.alias("start"), t.end.alias("end"), _octave(t.b.size).alias("octave"),
        F.least(F.floor(-F.log10(F.greatest(t.b.p, F.lit(1e-299))) * BINS_PER_DECADE), F.lit(TOP_BIN)).cast("int").alias("bin"), t.b.random.alias("random"), t.piece.alias("piece")))
    return packed.select("row", base_spans(F.col("text")).alias("base"), tokens.alias("tokens"))


def thresholds(found: DataFrame) -> DataFrame:
    """Per octave the lowest p bin that the step-up procedure rejects (rows: octaves; bins are a bounded number)."""
    counts = found.select(F.explode("tokens").alias("t")).groupBy("t.octave", "t.bin").agg(F.count(F.lit(1)).alias("n"))
    per = Window.partitionBy("octave")
    steps = counts.withColumn("above", F.sum("n").over(per.orderBy(F.desc("bin")))).withColumn("total", F.sum("n").over(per))
    # A bin's p value is rounded up to its edge, which keeps the rate.
    passed = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) <= RATE * F.col("above") / F.col("total")
    return steps.filter(passed).groupBy("octave").agg(F.min("bin").alias("least"))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns), ``base`` and ``spans``: arrays of (start, rank, end, kind) in report order."""
    found = materialise(tested(docs, text, keep or docs.columns), "secrets")
    # At most one entry per octave of length: a map that every row can hold.
    least = thresholds(found).agg(F.map_from_entries(F.collect_list(F.struct("octave", "least"))).alias("least")).scalar()
    random = F.filter("tokens", lambda t: t.random & (t.bin >= F.coalesce(F.try_element_at(F.col("least"), t.octave), F.lit(TOP_BIN + 1))))
    # A piece of a token that is flagged as a whole is not named again.
    random = F.transform(F.array(random), lambda r: F.filter(r, lambda t: ~t.piece | ~F.exists(r, lambda w: ~w.piece & (w.start <= t.start) & (w.end >= t.end))))[0]
    added = _tagged(random, KINDS.index(METHOD), METHOD)
    return found.withColumn("least", least).select("row", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
