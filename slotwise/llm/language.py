"""Language identification: multinomial naive Bayes over hashed character n-grams.

Cases: null text or text without a letter gives ``und`` with score 0; an empty
training set gives ``und`` for every row; a tie goes to the language that sorts
first; repeated rows are scored alike; texts are scored whole, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.texts import annotate, share

BITS = 15
ORDERS = (1, 2, 3)
#: Training documents expected per language; more are thinned by hash.
PER_LANGUAGE = 2000
SMOOTH = 0.5
UNKNOWN = "und"
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of every n-gram of each text (non-letters count as one blank), and each text's first position.

    Row n of the result holds the n-grams of the n-th order by start; grams made
    of blanks alone point at the extra bucket ``1 << BITS``.
    """
    pad = " " * max(ORDERS)
    lowered = [t.lower() + pad for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in lowered])])[:-1]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    points = np.where(letter, points, 0).astype(np.uint32)
    out = np.full((len(ORDERS), len(points)), 1 << BITS, dtype=np.int32)
    for row, n in enumerate(ORDERS):
        size = len(points) - n + 1
        h = np.full(size, n, dtype=np.uint32)
        some = np.zeros(size, dtype=bool)
        for i in range(n):
            h = (h ^ points[i:i + size]) * _MIX[i]
            h ^= h >> np.uint32(15)
            some |= letter[i:i + size]
        out[row, :size] = np.where(some, (h * _MIX[3]) >> np.uint32(32 - BITS), 1 << BITS)
    return out, starts


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: One row per bucket (the last, for blanks, is zero), one column per language.
    logs: np.ndarray
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not rows or not self.languages:
            return names, scores
        buckets, starts = gram_buckets([texts[i] for i in rows])
        total = np.tile(self.prior, (len(rows), 1))
        for order in buckets:
            for k in range(len(self.languages)):
                total[:, k] += np.add.reduceat(self.logs[order, k], starts, dtype=np.float64)
        best = total.argmax(axis=1)
        top = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b, s in zip(rows, best.tolist(), top.tolist()):
            names[i], scores[i] = self.languages[b], s
        return names, scores


def fit(docs: DataFrame, text: str, label: str, key: str, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Counts per language and bucket over the labelled rows, thinned to about ``per_language`` rows each.

    The counting runs in tasks; the driver receives at most one row per language
    and bucket.
    """
    lang = F.col(f"`{label}`").cast("string")
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), lang.alias("lang"), share(F.col(f"`{key}`"), F.lit(7)).alias("u"))
    rows = rows.filter("lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # The model holds a column per language anyway, so a row per language is small enough to send everywhere.
    chosen = rows.join(F.broadcast(sizes), "lang").filter(F.col("u") * F.col("n") < per_language).filter("text IS NOT NULL")

    def make():
        def work(texts):
            buckets, starts = gram_buckets(texts)
            ends = np.append(starts[1:], buckets.shape[1])
            found, counts = [], []
            for a, b in zip(starts, ends):
                f, c = np.unique(buckets[:, a:b], return_counts=True)
                found.append(f.tolist())
                counts.append(c.tolist())
            return {"bucket": found, "n": counts}
        return work

    counted = (annotate(chosen, "text", ["lang"], "bucket array<int>, n array<int>", make)
               .select(F.col("row.lang").alias("lang"), F.explode(F.arrays_zip("bucket", "n")).alias("g"))
               .groupBy("lang", "g.bucket").agg(F.sum("g.n").alias("n")))
    found = counted.toArrow().to_pydict()
    priors = {r.lang: r.n for r in sizes.collect()}
    languages = sorted(set(found["lang"]))
    at = {v: i for i, v in enumerate(languages)}
    counts = np.zeros(((1 << BITS) + 1, len(languages)))
    counts[found["bucket"], [at[v] for v in found["lang"]]] = found["n"]
    counts[-1] = 0
    logs = np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * (1 << BITS))) if languages else counts
    logs[-1] = 0
    prior = np.log(np.array([priors[v] for v in languages], dtype=float))
    return LanguageModel(languages, np.asfortranarray(logs.astype(np.float32)), prior)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns), ``lang_pred`` and ``score`` (posterior of the prediction) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(texts):
            names, scores = m.predict(texts)
            return {"lang_pred": names, "score": scores}
        return work

    return annotate(docs, text, keep or docs.columns, "lang_pred string, score double", make)


def confident(found: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of :func:`identify` that carry a language with enough certainty, in their own columns."""
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


__all__ = ["LanguageModel", "confident", "fit", "identify"]
