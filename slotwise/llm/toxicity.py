"""Toxicity: a linear-chain conditional random field tags toxic spans.

Learning has three steps over a bounded sample of labelled documents
(``PER_CLASS`` of each label, thinned by hash):

1. cues: words and word beginnings that mark toxic documents, by a binomial test
   on document counts; near copies among the toxic documents count once (equal
   minimum hashes), so that a copied text cannot make its rare words cues;
2. labelled tokens: in toxic documents the tokens that carry a cue, and windows
   of tokens around them (``CUE_WINDOWS`` a document) and from one other place; where no
   cue is found, every token of a toxic document is labelled;
3. the field: weights of hashed features of a token and its neighbours and of
   label transitions, fitted by AdaGrad on the exact likelihood.

Scoring runs the forward-backward recursions over all tokens of a text.  Tokens
whose marginal is at least a half form the offending spans; the document's score
is the noisy-or over the spans (or the highest marginal where there is none),
calibrated by a logistic curve on the sample.

Cases: null, empty and word-less texts get the score of a text without evidence;
texts are scored whole; without labels of both kinds on texts with words every score is 0; repeated
label rows count once, the higher label wins; null labels are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.texts import annotate, share
from slotwise.session import materialise

#: Labelled documents of each label used for learning.
PER_CLASS = 2000
BITS = 20
SIGNATURES = 3
#: Lengths of word beginnings that are features, and the features of a token itself.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
END = 4
N_OWN = 2 + len(BEGINNINGS)
#: A cue must be this unlikely (decimal digits) if it had nothing to do with the label, and seen in this share of toxic documents.
DIGITS, LEAST_SHARE, LEAST_DOCS = 8.0, 0.002, 5
#: So many toxic documents without any such cue make one of what they share.
LEAST_LEFT = 3
#: Share of toxic documents among those with a cue, after balancing the labels.
PURITY = 0.97
WINDOW = 16
#: Windows around cues that a sampled document gives to training, spread over its cues; one more lies anywhere.
CUE_WINDOWS = 3
ROUNDS, RATE, DECAY = 80, 0.3, 1e-4
_WORD = re.compile(r"\w+")
#: Word types kept per task before the table of known words starts anew.
TYPES = 400_000


def cue_features(word: str) -> list[int]:
    """Digests of what can be a cue: the word, and its beginnings."""
    w = word.lower()
    return [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1 for x in (w, *(w[:n] + "*" for n in BEGINNINGS if n < len(w)))]


def _mixed(h: np.ndarray, slot: int) -> np.ndarray:
    """Hashes of a feature slot as bucket numbers."""
    h = (h ^ np.uint32(slot * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return ((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)).astype(np.int32)


def _points(parts: list[str], width: int) -> np.ndarray:
    return np.array(parts, dtype=f"U{width}").view(np.uint32).reshape(len(parts), width)


def word_features(words: list[str]) -> np.ndarray:
    """Feature buckets of each word: the word, its end, its beginnings, and what it is to the token after and before it."""
    lows = [w.lower() for w in words]
    whole = np.array([xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) for w in lows], dtype=np.uint32)
    sizes = np.array([len(w) for w in lows])
    out = np.empty((len(words), N_OWN + 2), dtype=np.int32)
    out[:, 0] = _mixed(whole, 0)
    for part, slots in ((_points([w[-END:] for w in lows], END), {END: 1}), (_points([w[:BEGINNINGS[-1]] for w in lows], BEGINNINGS[-1]), {n: 2 + i for i, n in enumerate(BEGINNINGS)})):
        h = np.zeros(len(words), dtype=np.uint32)
        for i in range(part.shape[1]):
            h = (h ^ part[:, i]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            if i + 1 in slots:
                slot = slots[i + 1]
                out[:, slot] = _mixed(np.where((slot == 1) | (sizes > i + 1), h, np.uint32(0)), slot)
    out[:, -2], out[:, -1] = _mixed(whole, 100), _mixed(whole, 101)
    return out


def token_features(words: list[str]) -> np.ndarray:
    """One row per token: its own features and the words before and after."""
    rows = word_features(["", *words, ""])
    return np.concatenate([rows[1:-1, :N_OWN], rows[:-2, -2:-1], rows[2:, -1:]], axis=1)


def chain(emission: np.ndarray, alive: np.ndarray, start: float, moves: np.ndarray, moved: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward for a batch of two-label chains.

    ``emission`` (n, T) is the score of label 1 against 0, ``alive`` marks the
    tokens of each chain, ``moves[a, b]`` scores label b after a.  Returns the
    marginals of label 1, those of (1 after 1, 1 after 0, 0 after 1), and the
    logarithm of each chain's partition sum.
    """
    n, length = emission.shape
    e = np.exp(np.clip(emission, -30, 30))
    m = np.exp(np.clip(moves, -30, 30))
    fwd, scale = np.empty((length, 2, n)), np.empty((length, n))
    for t in range(length):
        if t == 0:
            a0, a1 = np.ones(n), np.exp(np.clip(start, -30, 30)) * e[:, 0]
        else:
            p0, p1 = fwd[t - 1]
            a0, a1 = p0 * m[0, 0] + p1 * m[1, 0], (p0 * m[0, 1] + p1 * m[1, 1]) * e[:, t]
            a0, a1 = np.where(alive[:, t], a0, p0), np.where(alive[:, t], a1, p1)
        total = a0 + a1
        fwd[t, 0], fwd[t, 1], scale[t] = a0 / total, a1 / total, np.where(alive[:, t], total, 1.0)
    one, pairs = np.empty((n, length)), np.zeros((3, n, length if moved else 0))
    b0, b1 = np.ones(n), np.ones(n)
    for t in range(length - 1, -1, -1):
        norm = fwd[t, 0] * b0 + fwd[t, 1] * b1
        one[:, t] = fwd[t, 1] * b1 / norm
        if t:
            p0, p1 = fwd[t - 1]
            live = alive[:, t]
            if moved:
                joint = norm * scale[t]
                pairs[0, :, t] = np.where(live, p1 * m[1, 1] * e[:, t] * b1 / joint, 0)
                pairs[1, :, t] = np.where(live, p0 * m[0, 1] * e[:, t] * b1 / joint, 0)
                pairs[2, :, t] = np.where(live, p1 * m[1, 0] * b0 / joint, 0)
            n0, n1 = (m[0, 0] * b0 + m[0, 1] * e[:, t] * b1) / scale[t], (m[1, 0] * b0 + m[1, 1] * e[:, t] * b1) / scale[t]
            b0, b1 = np.where(live, n0, b0), np.where(live, n1, b1)
            top = np.maximum(b0, b1)
            b0, b1 = b0 / top, b1 / top
    return np.where(alive, one, 0.0), pairs, np.log(scale).sum(axis=0)


@dataclass(frozen=True)
class ToxicField:
    weights: np.ndarray
    bias: float
    start: float
    moves: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def scorer(self):
        return Scorer(self)


class Scorer:
    """Emission parts of the word types met so far: of the word itself, and what it adds after and before it."""

    def __init__(self, field: ToxicField):
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {"": 0}
        self.parts = self.parts_of([""])

    def parts_of(self, words: list[str]) -> np.ndarray:
        w = self.field.weights[word_features(words)]
        return np.stack([w[:, :N_OWN].sum(axis=1) + self.field.bias, w[:, -2], w[:, -1]], axis=1)

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.numbers) > TYPES:
            self.forget()
        new = sorted(set().union(*texts) - self.numbers.keys())
        if new:
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
            self.parts = np.concatenate([self.parts, self.parts_of(new)])

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Marginal of the toxic label of every token, per text; texts of like length run together."""
        self.learn(texts)
        edge = self.parts[0, 1:]
        ids = [np.fromiter(map(self.numbers.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts]
        out: list[np.ndarray] = [np.zeros(0)] * len(texts)
        order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: len(texts[i]))
        while order:
            longest = len(texts[order[-1]])
            count = max(1, 200_000 // longest)
            group, order = order[-count:], order[:-count]
            sizes = np.array([len(texts[i]) for i in group])
            alive = np.arange(longest) < sizes[:, None]
            emission = np.zeros(alive.shape)
            flat = np.concatenate([ids[i] for i in group])
            mine, before, after = self.parts[flat].T
            last = np.cumsum(sizes) - 1
            first = last - sizes + 1
            total = mine.copy()
            total[1:] += before[:-1]
            total[:-1] += after[1:]
            total[first] += edge[0] - np.where(first > 0, before[first - 1], 0)
            total[last] += edge[1] - np.where(last + 1 < len(after), after[np.minimum(last + 1, len(after) - 1)], 0)
            emission[alive] = total
            one = chain(emission, alive, self.field.start, self.field.moves, moved=False)[0]
            for k, i in enumerate(group):
                out[i] = one[k, :sizes[k]]
        return out

    def score(self, texts: list[str | None]) -> dict[str, list]:
        """Per text the evidence (a log odds), the score, and the offending spans in code points."""
        tokens = [_WORD.findall(t) if t else [] for t in texts]
        evidence, spans = [], []
        for t, p in zip(texts, self.marginals(tokens)):
            found = []
            hot = p >= 0.5
            if hot.any():
                turn = np.flatnonzero(np.diff(np.concatenate([[0], hot.view(np.int8), [0]]))).reshape(-1, 2)
                places = [m.span() for m in _WORD.finditer(t)]
                found = [{"start": places[a][0], "end": places[b - 1][1], "p": float(p[a:b].max())} for a, b in turn.tolist()]
                clean = float(np.log1p(-np.minimum([f["p"] for f in found], 1 - 1e-9)).sum())
            else:
                clean = float(np.log1p(-min(p.max(initial=0.0), 1 - 1e-9)))
            evidence.append(float(np.log(max(-np.expm1(clean), 1e-9)) - clean))
            spans.append(found)
        score = 1 / (1 + np.exp(-np.clip(self.field.slope * np.array(evidence) + self.field.offset, -500, 500)))
        return {"evidence": evidence, "score": score.tolist(), "toxic_spans": spans}


def signatures(words: list[str]) -> list[int]:
    """Minimum hashes of the text's three-word shingles, one per order; near copies share them, other texts do not."""
    shingles = {" ".join(words[i:i + 3]).lower().encode("utf-8", "surrogatepass") for i in range(max(1, len(words) - 2))}
    return [min(xxhash.xxh64_intdigest(s, i) >> 1 for s in shingles) for i in range(SIGNATURES)]


def cues(toxic: list[tuple[list[int], np.ndarray]], clean: np.ndarray, n_clean: int) -> set[int]:
    """Numbers of the features that mark toxic documents.

    ``toxic`` holds each document's signatures and distinct features, ``clean`` the number of clean documents with each feature.
    """
    for i in range(SIGNATURES):
        toxic = list({s[i]: (s, d) for s, d in toxic}.values())
    docs = [d for _, d in toxic if len(d)]
    if not docs or not n_clean:
        return set()
    floor = max(LEAST_DOCS, LEAST_SHARE * len(docs))
    with_it = np.bincount(np.concatenate(docs), minlength=len(clean)).astype(float)
    base = len(docs) / (len(docs) + n_clean)
    pure = with_it / len(docs) >= PURITY / (1 - PURITY) * (clean + 0.5) / n_clean
    # Chance that all of them are toxic by luck, loosened by the clean ones seen.
    digits = with_it * -log10(base) - clean * 2
    found = set(np.flatnonzero((digits >= DIGITS) & pure & (with_it >= floor)).tolist())
    # What toxic documents are left without a cue get the one that the most of them share and no clean document has.
    left = [d for d in docs if found.isdisjoint(d.tolist())]
    while left:
        shared = np.bincount(np.concatenate(left), minlength=len(clean)) * (clean == 0)
        best = int(shared.argmax())
        if shared[best] < max(LEAST_LEFT, LEAST_SHARE * len(docs)):
            break
        found.add(best)
        left = [d for d in left if best not in d]
    return found


def train(windows: pa.Table) -> ToxicField:
    """Fits the field to windows of ``features`` (tokens by feature slots), ``labels`` and ``y``, the label of the document."""
    slots = N_OWN + 2
    columns = {c: windows[c].combine_chunks() for c in ("features", "labels", "y")}
    sizes = pc.list_value_length(columns["labels"]).to_numpy()
    n, longest = len(sizes), int(sizes.max())
    alive = np.arange(longest) < sizes[:, None]
    features = np.zeros((n, longest, slots), dtype=np.int32)
    features[alive] = columns["features"].flatten().to_numpy().reshape(-1, slots)
    labels = np.zeros((n, longest))
    labels[alive] = columns["labels"].flatten().to_numpy()
    labels *= columns["y"].to_numpy()[:, None]
    flat = features[alive].ravel()
    weights, bias, start, moves = np.zeros(1 << BITS), -2.0, -2.0, np.zeros((2, 2))
    g_w, g_s = np.full(1 << BITS, 1e-8), np.full(5, 1e-8)
    later = alive.copy()
    later[:, 0] = False
    prior = np.zeros_like(labels)
    prior[:, 1:] = labels[:, :-1]
    seen = np.array([(later * prior * labels).sum(), (later * (1 - prior) * labels).sum(), (later * prior * (1 - labels)).sum()])
    count = alive.sum()
    for _ in range(ROUNDS):
        emission = sum(weights[features[:, :, k]] for k in range(slots)) + bias
        one, pairs, _ = chain(emission, alive, start, moves)
        gap = np.where(alive, labels - one, 0.0)
        grad = np.bincount(flat, weights=np.repeat(gap[alive], slots), minlength=1 << BITS) / n - DECAY * weights
        turns = (seen - pairs.sum(axis=(1, 2))) / n
        small = np.array([gap.sum() / count * 10, gap[:, 0].sum() / n, *turns])
        g_w += grad * grad
        g_s += small * small
        weights += RATE * grad / np.sqrt(g_w)
        step = RATE * small / np.sqrt(g_s)
        bias, start = bias + step[0], start + step[1]
        moves[1, 1] += step[2]
        moves[0, 1] += step[3]
        moves[1, 0] += step[4]
    return ToxicField(weights, bias, start, moves)


def calibrated(field: ToxicField, evidence: np.ndarray, label: np.ndarray) -> ToxicField:
    """A logistic curve from evidence to label, both labels weighing the same, slightly pulled to slope 1."""
    slope, offset = 1.0, 0.0
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * evidence + offset, -500, 500)))
        g = np.array([(weight * (label - p) * evidence).sum() - 0.01 * (slope - 1), (weight * (label - p)).sum() - 1e-4 * offset])
        v = weight * p * (1 - p)
        h = np.array([[(v * evidence * evidence).sum() + 0.01, (v * evidence).sum()], [(v * evidence).sum(), v.sum() + 1e-4]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, offset = slope + step[0], offset + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return ToxicField(field.weights, field.bias, field.start, field.moves, max(slope, 1e-3), offset)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", per_class: int = PER_CLASS, cue_windows: int = CUE_WINDOWS) -> ToxicField | None:
    """The field, or None where the labelled documents with words are not of both kinds."""
    known = (labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("y")).filter("key IS NOT NULL AND y IN (0, 1)")
             .groupBy("key").agg(F.max("y").alias("y")))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    part = F.when(F.col("y") == 1, per_class / sizes[1]).otherwise(per_class / sizes[0])
    # About two times per_class ids at most: small enough for every task.
    chosen = F.broadcast(known.filter(share(F.col("key"), F.lit(11)) < part))
    sample = materialise(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).join(chosen, "key"), "labelled")

    def listed():
        def work(texts):
            words = [_WORD.findall(t or "") for t in texts]
            return {"f": [sorted({x for w in set(ws) for x in cue_features(w)}) for ws in words], "s": [signatures(ws) for ws in words]}
        return work

    per_doc = materialise(annotate(sample, "text", ["key", "y"], "f array<bigint>, s array<bigint>", listed).select("row.key", "row.y", "f", "s"), "features")
    # Only what three toxic documents share can become a cue; these features are numbered.
    counts = (per_doc.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
              .filter(F.col("toxic") >= LEAST_LEFT).orderBy("f").toArrow())
    names = counts["f"].to_numpy()
    n_clean = per_doc.filter("y = 0").count()
    toxic = per_doc.filter("y = 1").orderBy("key").select("s", "f").toArrow()
    docs_of = []
    for signs, f in zip(toxic["s"].to_pylist(), toxic["f"]):
        own = f.values.to_numpy()
        at = np.searchsorted(names, own)
        docs_of.append((signs, at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == own)] if len(names) else at[:0]))
    marks = set(names[sorted(cues(docs_of, counts["clean"].to_numpy(), n_clean))].tolist()) if len(names) else set()
    del toxic, docs_of

    def cut():
        def work(texts):
            # The label is not known here; a clean document has no cue but by accident, and then is a hard example.
            out = []
            for t in texts:
                words = _WORD.findall(t or "")
                found = []
                if words:
                    y = np.array([any(x in marks for x in cue_features(w)) for w in words])
                    at = np.flatnonzero(y)
                    centres = at[np.linspace(0, len(at) - 1, min(cue_windows, len(at))).astype(int)].tolist() if len(at) else []
                    for c in {*centres, xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass")) % len(words)}:
                        a, b = max(0, c - WINDOW), c + WINDOW
                        near = words[max(0, a - 1):b + 1]
                        rows = token_features(near)[a - max(0, a - 1):][:len(words[a:b])]
                        found.append({"features": rows.ravel().tolist(), "labels": y[a:b].astype(int).tolist()})
                out.append(found)
            return {"w": out}
        return work

    cuts = annotate(sample, "text", ["y"], "w array<struct<features:array<int>,labels:array<int>>>", cut).select("row.y", F.explode("w").alias("w"))
    # Without any cue every token of a toxic document counts as toxic.
    tokens = F.col("w.labels") if marks else F.transform("w.labels", lambda _: F.col("y").cast("int"))
    windows = cuts.select("y", "w.features", tokens.alias("labels")).orderBy(F.xxhash64("features"), "y").toArrow()
    if not marks and len(pc.unique(windows["y"])) < 2:
        return None
    field = train(windows)
    judged = score(sample, field, keep=["y"]).select("row.y", "evidence").toArrow()
    return calibrated(field, judged["evidence"].to_numpy(), judged["y"].to_numpy().astype(float))


def score(docs: DataFrame, field: ToxicField | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns), ``evidence``, ``score`` and ``toxic_spans`` (start, end, p) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        mine = shared.value
        if mine is None:
            return lambda texts: {"evidence": [0.0] * len(texts), "score": [0.0] * len(texts), "toxic_spans": [[] for _ in texts]}
        return mine.scorer().score

    return annotate(docs, text, keep or docs.columns, "evidence double, score double, toxic_spans array<struct<start:int,end:int,p:double>>", make)
