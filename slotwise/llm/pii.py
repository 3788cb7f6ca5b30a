"""Personal data: an Aho-Corasick scan finds anchors, small parsers expand and check each one.

Anchors are at-signs, digit pairs (also across one separator), a plus before a
digit, schemes and identifier cues.  A parser looks only at the surroundings of
its anchor, so the cost follows the anchors, not the text length squared.

Kinds, in the order of reports: ``email``, ``ip``, ``card``, ``phone`` (the base
kinds; matches are leftmost and do not overlap within a kind), then the added
``address`` (what follows a scheme), ``account`` (IBAN, or the identifier after a
cue; a card-like group at the edge of a longer run of digits).

Cases: null text counts as empty; empty text has no spans; long texts are read
whole; repeated rows give the same spans; offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
import string
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.texts import annotate

BASE = ("email", "ip", "card", "phone")
ADDED = ("address", "account")
KINDS = BASE + ADDED
SPANS = "array<struct<kind:string,start:int,end:int>>"

# Schemes and cues that announce an identifier (matched in lower case).
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "ssh://")
CUES = ("account", "acct", "iban", "konto", "compte", "cuenta", "passport", "ssn", "customer id", "member id")

# Words that may stand between a cue and its identifier.
LINKS = ("number", "num", "no", "nr", "nummer", "numero", "número", "numéro", "n°", "id", "is", "ist", "est", "es")
_SEPARATORS = r"[ :#=.\t]{0,4}"
#: At most two of these words, with the separators around them.
_LINK = re.compile(rf"(?:nummer|nr)?{_SEPARATORS}(?:(?:{'|'.join(LINKS)})(?![A-Za-z0-9]){_SEPARATORS}){{0,2}}", re.IGNORECASE)
_LETTERED = re.compile("[A-Z]{1,3}[0-9]{6,17}(?![A-Za-z0-9])")

_DIGITS = frozenset(string.digits)
_LABEL = frozenset(string.ascii_letters + string.digits + "-")
_LOCAL = _LABEL | frozenset("._%+")
_PHONE = _DIGITS | frozenset(" ().-")
_UPPER_ALNUM = frozenset(string.ascii_uppercase + string.digits)
_URL_STOP = frozenset(string.whitespace + "<>\"'`{}|\\^")
_GAP = " -"


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    for x in string.digits:
        a.add_word("+" + x, ("plus", 2))
        for y in string.digits:
            a.add_word(x + y, ("digits", 2))
            a.add_word(f"{x} {y}", ("digits", 3))
            a.add_word(f"{x}-{y}", ("digits", 3))
            a.add_word(f"{x}.{y}", ("dotted", 3))
    for words, kind in ((SCHEMES, "scheme"), (CUES, "cue")):
        for w in words:
            for form in {w, w.upper(), w.capitalize(), w.title()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def run_right(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def run_left(text: str, at: int, allowed: frozenset, floor: int = 0) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def digit_run(text: str, at: int, floor: int, gaps: str) -> tuple[int, int]:
    """The widest run around the digit at ``at`` in which single ``gaps`` stand between digits only."""
    start = at
    while True:
        if start > floor and text[start - 1] in _DIGITS:
            start -= 1
        elif start - 1 > floor and text[start - 1] in gaps and text[start - 2] in _DIGITS:
            start -= 2
        else:
            break
    end, n = at + 1, len(text)
    while True:
        if end < n and text[end] in _DIGITS:
            end += 1
        elif end + 1 < n and text[end] in gaps and text[end + 1] in _DIGITS:
            end += 2
        else:
            return start, end


def parse_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = run_left(text, at, _LOCAL, floor)
    end = run_right(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == ".":
        more = run_right(text, end + 1, _LABEL)
        if more == end + 1:
            break
        end, labels = more, labels + 1
    return (start, end) if labels else None


def parse_dotted(text: str, at: int, floor: int) -> tuple[int, list[tuple[int, int]]]:
    """End of the run of dot-joined numbers around ``at``, and its valid groups of four."""
    start, end = digit_run(text, at, floor, ".")
    parts, pos = [], start
    for p in text[start:end].split("."):
        parts.append((pos, pos + len(p)))
        pos += len(p) + 1
    found = []
    for i in range(0, len(parts) - 3, 4):
        four = parts[i:i + 4]
        if all(len(v := text[a:b].lstrip("0")) < 4 and int(v or "0") <= 255 for a, b in four):
            found.append((four[0][0], four[3][1]))
    return end, found


def parse_digits(text: str, at: int, floor: int) -> tuple[int, tuple[int, int] | None, tuple[int, int] | None]:
    """End of the digit run around ``at``; the card it is; else the card-like group at one of its edges."""
    start, end = digit_run(text, at, floor, _GAP)
    digits = re.sub("[ -]", "", text[start:end])
    if 16 <= len(digits) <= 19 and luhn(digits):
        return end, (start, end), None
    groups = [m.span() for m in re.finditer("[0-9]+", text[start:end])]
    for a, b in (groups[-1], groups[0]):
        if len(groups) > 1 and 16 <= b - a <= 19 and luhn(text[start + a:start + b]):
            return end, None, (start + a, start + b)
    return end, None, None


def parse_phone(text: str, at: int) -> tuple[int, bool] | None:
    """End of the number after the plus at ``at`` and whether it has 8 to 15 digits."""
    end = run_right(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end <= at + 3:
        return None
    return end, 8 <= sum(c in _DIGITS for c in text[at:end]) <= 15


def iban_valid(code: str) -> bool:
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", code):
        return False
    number = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
    return int(number) % 97 == 1


def parse_account(text: str, end_of_cue: int) -> tuple[int, int] | None:
    """The identifier after a cue and words like "number is": an IBAN with a valid check number,
    6 to 17 digits after up to three capitals, or 6 to 20 digits in groups."""
    at = _LINK.match(text, end_of_cue).end()
    if text[at:at + 2].isalpha():
        end, code = at, ""
        while end < len(text) and len(code) < 34:
            if text[end] in _UPPER_ALNUM:
                code += text[end]
            elif text[end] != " ":
                break
            end += 1
            if len(code) >= 15 and iban_valid(code) and (end == len(text) or text[end] not in _UPPER_ALNUM):
                return at, end
    if (m := _LETTERED.match(text, at)):
        return m.span()
    if at < len(text) and text[at] in _DIGITS:
        start, end = digit_run(text, at, at, _GAP)
        if 6 <= sum(c in _DIGITS for c in text[start:end]) <= 20:
            return start, end
    return None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of one text as (kind, start, end), by kind in the order of ``KINDS``, then by start."""
    if not text:
        return []
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = {"email": 0, "ip": 0, "card": 0, "phone": 0, "address": 0, "account": 0}
    for last, (kind, size) in automaton().iter(text):
        first = last - size + 1
        if kind == "at":
            if first >= done["email"] and (m := parse_email(text, first, done["email"])):
                spans["email"].append(m)
                done["email"] = m[1]
        elif kind == "plus":
            if first >= done["phone"] and (m := parse_phone(text, first)):
                done["phone"] = m[0]
                if m[1]:
                    spans["phone"].append((first, m[0]))
        elif kind == "dotted":
            if first >= done["ip"]:
                done["ip"], found = parse_dotted(text, first, done["ip"])
                spans["ip"] += found
        elif kind == "digits":
            if first >= done["card"]:
                done["card"], card, group = parse_digits(text, first, done["card"])
                if card:
                    spans["card"].append(card)
                if group:
                    spans["account"].append(group)
        elif first >= done["address" if kind == "scheme" else "account"]:
            if kind == "scheme":
                end = run_right_until(text, last + 1)
                if end > last + 1:
                    spans["address"].append((first, end))
                    done["address"] = end
            elif (m := parse_account(text, last + 1)):
                spans["account"].append(m)
                done["account"] = m[1]
    return [(k, a, b) for k in KINDS for a, b in sorted(set(spans[k]))]


def run_right_until(text: str, at: int) -> int:
    """End of an address: up to a blank or quote, without closing punctuation."""
    end, n = at, len(text)
    while end < n and text[end] not in _URL_STOP:
        end += 1
    while end > at and text[end - 1] in ".,;:!?)]":
        end -= 1
    return end


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Overlapping spans as one, under the kind that comes first in ``KINDS`` order at its widest."""
    out: list[list] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if out and a < out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([k, a, b])
    return [tuple(x) for x in out]


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for k, a, b in merged(spans):
        parts += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns), ``spans`` and ``clean`` (the text with every span replaced by its kind)."""
    def make():
        def work(texts):
            spans = [find(t) for t in texts]
            return {"spans": [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans],
                    "clean": [masked(t, s) for t, s in zip(texts, spans)]}
        return work

    return annotate(docs, text, keep or docs.columns, f"spans {SPANS}, clean string", make)


def joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
