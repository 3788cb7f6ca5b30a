"""URL filter: a sorted array of 64-bit xxhash keys, memory-mapped and probed by binary search.

Every entry keeps its full string, which confirms a hit against collisions.  The
array holds the rules (host and path prefix), the hosts that have rules, and the
blocked words that settle urls without a rule.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the
end, with A-Z lower-cased; the path follows up to ``?``, ``#`` or the end.  A
rule fits its host and all subdomains if the path starts with the rule's; the
longest rule wins, and of two equal ones the blocking one.  A url without a rule
is blocked if a word of its host is on the list, else allowed.

Cases: null urls and urls without ``://`` have empty host and path and are
allowed; no rules at all leave the words to decide; rules with a null host are
ignored, a null path counts as empty; repeated pages get a row each; a url of
any length costs one probe per rule length and label.
"""

from __future__ import annotations

import mmap
import re
import tempfile

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.texts import annotate

ALLOW, BLOCK, HOST, WORD = 0, 1, 2, 3
RULE_OF, HOST_OF, WORD_OF = b"r", b"h", b"w"
#: Bytes of rule strings that are sent to every task; a longer list is joined by shuffle instead.
SEND_BYTES = 64 << 20
FOUND = "host string, path string, rule string, verdict string"

_LOWER = {c: c + 32 for c in range(65, 91)}
_PARTS = re.compile(r"([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host, path = _PARTS.match(rest).groups()
    return host.translate(_LOWER), path


def _key(role: bytes, text: str) -> bytes:
    return role + text.encode("utf-8", "surrogatepass")


def packed(rules: list[tuple[str, str, str]], words: tuple[str, ...]) -> tuple[bytes, list[int], int]:
    """The array as bytes, the lengths of the rules' paths, and the most labels of a rule's host."""
    verdicts: dict[str, int] = {}
    for host, path, verdict in rules:
        verdicts[host + path] = max(verdicts.get(host + path, ALLOW), BLOCK if verdict == "block" else ALLOW)
    entries = [(_key(RULE_OF, s), v) for s, v in verdicts.items()]
    entries += [(_key(HOST_OF, h), HOST) for h in {h for h, _, _ in rules}] + [(_key(WORD_OF, w), WORD) for w in set(words)]
    entries = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in entries)
    blob = b"".join(k for _, k, _ in entries)
    ends = np.cumsum([0, *(len(k) for _, k, _ in entries)], dtype=np.int64)
    head = np.array([len(entries), len(blob)], dtype=np.int64)
    keys = np.array([h for h, _, _ in entries], dtype=np.uint64)
    flags = np.array([v for *_, v in entries], dtype=np.uint8)
    data = head.tobytes() + keys.tobytes() + ends.tobytes() + flags.tobytes() + blob
    return data, sorted({len(p) for _, p, _ in rules}), max((h.count(".") + 1 for h, _, _ in rules), default=0)


class DigestArray:
    """Read-only view of a packed array in a memory map that has no name and leaves no file."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, size = np.frombuffer(self.map, dtype=np.int64, count=2).tolist()
        self.keys = np.frombuffer(self.map, dtype=np.uint64, count=n, offset=16)
        self.ends = np.frombuffer(self.map, dtype=np.int64, count=n + 1, offset=16 + 8 * n)
        self.flags = np.frombuffer(self.map, dtype=np.uint8, count=n, offset=24 + 16 * n)
        self.base = 24 + 17 * n

    def probe(self, texts: list[bytes]) -> list[int]:
        """The flag of each string's entry, -1 where it has none."""
        out = [-1] * len(texts)
        if not texts or not len(self.keys):
            return out
        wanted = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype=np.uint64)
        at = np.searchsorted(self.keys, wanted)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == wanted[i]:
                if self.map[self.base + int(self.ends[j]):self.base + int(self.ends[j + 1])] == texts[i]:
                    out[i] = int(self.flags[j])
                j += 1
        return out


def suffixes(host: str, most: int) -> list[str]:
    """The host and its parent domains of up to ``most`` labels, longest first; the host itself only if it fits."""
    labels = host.split(".")
    return [".".join(labels[-n:]) for n in range(min(most, len(labels)), 0, -1)]


def word_list(host: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split("[.-]", host) if w))


def judge_batch(urls: list[str | None], table: DigestArray, lengths: list[int], most: int) -> dict[str, list]:
    parts = [split_url(u) for u in urls]
    probes = [(i, s, _key(HOST_OF, s)) for i, (h, _) in enumerate(parts) if h for s in suffixes(h, most)]
    hosts = [(i, s) for (i, s, _), flag in zip(probes, table.probe([k for *_, k in probes])) if flag == HOST]
    tries = [(i, s + parts[i][1][:n]) for i, s in hosts for n in lengths if n <= len(parts[i][1])]
    rule: list[str | None] = [None] * len(urls)
    verdict = [ALLOW] * len(urls)
    for (i, r), flag in zip(tries, table.probe([_key(RULE_OF, r) for _, r in tries])):
        if flag in (ALLOW, BLOCK) and (rule[i] is None or len(r) > len(rule[i])):
            rule[i], verdict[i] = r, flag
    said = [(i, w) for i, (h, _) in enumerate(parts) if rule[i] is None for w in word_list(h)]
    for (i, _), flag in zip(said, table.probe([_key(WORD_OF, w) for _, w in said])):
        if flag == WORD:
            verdict[i] = BLOCK
    return {"host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": rule, "verdict": ["block" if v == BLOCK else "allow" for v in verdict]}


def judge(pages: DataFrame, rules: DataFrame, words: tuple[str, ...] = (), url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns), ``host``, ``path``, ``rule`` and ``verdict`` for every page.

    ``rules`` has host, path and verdict (allow or block).  Lists of up to
    ``SEND_BYTES`` go to every task; a longer one is met by a join on the
    digests of all strings that a url could match.
    """
    spark = pages.sparkSession
    clean = rules.select(F.col("host").cast("string").alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
                         F.col("verdict").cast("string").alias("verdict")).filter("host IS NOT NULL").distinct()
    size = clean.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 32)).first()[0] or 0
    if size > SEND_BYTES:
        return _judge_joined(pages, clean, words, url, keep or pages.columns)
    shared = spark.sparkContext.broadcast(packed([tuple(r) for r in clean.collect()], words))

    def make():
        data, lengths, most = shared.value
        table = DigestArray(data)
        return lambda urls: judge_batch(urls, table, lengths, most)

    return annotate(pages, url, keep or pages.columns, FOUND, make)


def _judge_joined(pages: DataFrame, rules: DataFrame, words: tuple[str, ...], url: str, keep: list[str]) -> DataFrame:
    """The same result for a list of any length: distinct (host, path) meet the rules by digest and full string."""
    shape = rules.agg(F.collect_set(F.length("path")).alias("lengths"), F.max(F.size(F.split("host", r"\."))).alias("most")).first()
    shared = pages.sparkSession.sparkContext.broadcast((packed([], words)[0], sorted(shape.lengths), shape.most))

    def make():
        data, lengths, most = shared.value
        table = DigestArray(data)

        def work(urls):
            out = judge_batch(urls, table, [], 0)
            out["tries"] = [[s + p[:n] for s in suffixes(h, most) for n in lengths if n <= len(p)] if h else [] for h, p in zip(out["host"], out["path"])]
            return out
        return work

    found = annotate(pages, url, keep, FOUND + ", tries array<string>", make)
    places = found.select("host", "path", F.explode("tries").alias("try")).distinct()
    entries = rules.groupBy(F.concat("host", "path").alias("entry")).agg(F.max("verdict").alias("said")).withColumn("digest", F.xxhash64("entry"))
    best = (places.withColumn("digest", F.xxhash64("try")).join(entries, "digest").filter(F.col("try") == F.col("entry"))
            .groupBy("host", "path").agg(F.max_by(F.struct("entry", "said"), F.length("entry")).alias("best")))
    return found.join(best, ["host", "path"], "left").select(
        "row", "host", "path", F.col("best.entry").alias("rule"), F.coalesce("best.said", "verdict").alias("verdict"))
