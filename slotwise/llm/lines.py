"""Line-first cleaning: rules judge every line, failing lines go, and a document that loses too much text is rejected.

A line with a word fails by the first of these rules that fits:

* ``navigation``: at least two words are separators and these are a quarter of the words or more, or all words are menu words or marks, the first a menu word;
* ``boilerplate``: it holds a phrase of notices, cookie banners, forms or licences;
* ``punctuation``: no word ends a sentence, or symbols are over a tenth of the characters, or over a fifth of the words end in doubled marks.

Words are runs without white space (space and the controls 9 to 13); lines are
what ``\\n`` separates.  ``n_repeat_words`` counts the words that lie in a window of
``WINDOW`` words found twice or more in the text, the first occurrence included.

Cases: a null text counts as empty; an empty text has no words and no failing
line; blank lines never fail and are kept; repeated rows get a row each; a text
of any length is judged whole.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.texts import annotate

WINDOW = 8
#: A document that loses more than this share of its words is rejected.
MOST_LOST = 0.5

# Word separators of menus, words that make up menus, phrases of boilerplate, the counted symbols.
SEPARATORS = ("|", ">", ">>", "»", "›", "•", "·", "/")
MENU = ("about", "account", "archive", "back", "blog", "categories", "contact", "faq", "forum", "help", "home", "login", "logout", "menu", "news", "next", "page", "previous",
        "products", "register", "search", "services", "share", "shop", "sitemap", "support", "tags", "top")
BOILERPLATE = ("all rights reserved", "copyright ©", "copyright (c)", "© copyright", "privacy policy", "terms of use", "terms of service", "terms and conditions", "uses cookies", "use cookies",
               "accept cookies", "enable javascript", "subscribe to our", "sign up for our", "newsletter", "click here", "read more", "powered by", "page not found", "licensed under", "released under the")
SYMBOLS = "#*$%&|<>"

_SPACE = r"\x20\x09-\x0D"
WORD = f"[^{_SPACE}]+"
#: What ends a sentence, with closing quotes and brackets, at the end of a word; and doubled marks there.
SENTENCE_END = "[.!?…][\"')\\]»”’]*"
DOUBLED = "[!?]{2,}"
#: Marks around the words of a menu.
MENU_TRIM = ".,:;|"

FOUND = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lost bigint, failed array<struct<start:int,end:int,rule:string>>, clean string"

_ENDED = re.compile(rf"{SENTENCE_END}(?:[{_SPACE}]|\Z)")
_DOUBLED = re.compile(rf"{DOUBLED}(?:[{_SPACE}]|\Z)")
_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]")
_WORD = re.compile(WORD)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SEPARATORS, _MENU = frozenset(SEPARATORS), frozenset(MENU)


def rule_of(line: str, words: list[str]) -> str | None:
    """The rule by which a line with these words fails."""
    apart = sum(map(_SEPARATORS.__contains__, words))
    if apart >= 2 and 4 * apart >= len(words):
        return "navigation"
    low = line.translate(_LOWER)
    if words[0].translate(_LOWER).strip(MENU_TRIM) in _MENU and all(w in _MENU or not w for w in (w.translate(_LOWER).strip(MENU_TRIM) for w in words)):
        return "navigation"
    if _BOILERPLATE.search(low):
        return "boilerplate"
    if not _ENDED.search(line):
        return "punctuation"
    if len(_SYMBOL.findall(line)) * 10 > sum(map(len, words)):
        return "punctuation"
    if ("!" in line or "?" in line) and len(_DOUBLED.findall(line)) * 5 > len(words):
        return "punctuation"
    return None


def marks(doc: np.ndarray, ids: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A hash of each window and its text's number."""
    mark = doc.astype(np.uint64)
    for i in range(window):
        mark = (mark ^ ids[starts + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mark ^= mark >> np.uint64(29)
    return mark


def repeated_words(counts: np.ndarray, ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For texts of ``counts`` words, numbered ``ids`` one text after the other: words in windows that occur twice in their text."""
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    starts = np.flatnonzero(np.arange(len(ids)) + window <= ends)
    if not len(starts):
        return np.zeros(len(counts), dtype=np.int64)
    # Equal windows have equal marks; windows whose mark is not alone are compared word by word.
    mark = marks(doc[starts], ids, starts, window)
    ordered = np.sort(mark)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(counts), dtype=np.int64)
    at = np.minimum(np.searchsorted(twice, mark), len(twice) - 1)
    starts = starts[twice[at] == mark]
    rows = np.column_stack([doc[starts], *[ids[starts + i] for i in range(window)]])
    order = np.lexsort(rows.T)
    same = (rows[order][1:] == rows[order][:-1]).all(axis=1)
    starts = starts[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
    inside = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + window, -1)
    return np.bincount(doc[np.cumsum(inside)[:-1] > 0], minlength=len(counts))


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def judge(texts: list[str | None], with_text: bool = True) -> dict[str, list]:
    out: dict[str, list] = {name.split()[0]: [] for name in FOUND.split(", ") if ":" not in name}
    out["failed"] = []
    number, ids, counts = Numbers(), [], []
    for text in texts:
        text = text or ""
        n = chars = lost = repeated = start = 0
        earlier, failed, kept = set(), [], []
        for line in text.split("\n"):
            words = _WORD.findall(line)
            if words:
                n += len(words)
                chars += sum(map(len, words))
                ids += [number[w] for w in words]
                repeated += line in earlier
                earlier.add(line)
                rule = rule_of(line, words)
                if rule:
                    lost += len(words)
                    failed.append({"start": start, "end": start + len(line), "rule": rule})
            if with_text and not (words and rule):
                kept.append(line)
            start += len(line) + 1
        counts.append(n)
        for name, value in (("n_words", n), ("word_chars", chars), ("n_symbols", len(_SYMBOL.findall(text))), ("n_dup_lines", repeated), ("n_lost", lost), ("failed", failed), ("clean", "\n".join(kept) if with_text else None)):
            out[name].append(value)
    out["n_repeat_words"] = repeated_words(np.array(counts, dtype=np.int64), np.array(ids, dtype=np.int64)).tolist()
    return out


def clean(docs: DataFrame, text: str = "text", keep: list[str] | None = None, most_lost: float = MOST_LOST, with_text: bool = True) -> DataFrame:
    """``row`` (the kept columns), the counts of ``FOUND``, the ``failed`` lines (code points, end exclusive), the ``clean`` text, and ``rejected``.

    ``rejected`` holds for a document that loses more than ``most_lost`` of its words.
    """
    found = annotate(docs, text, keep or docs.columns, FOUND, lambda: lambda texts: judge(texts, with_text))
    return found.withColumn("rejected", F.col("n_lost") > most_lost * F.col("n_words"))
