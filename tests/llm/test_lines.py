import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from slotwise.llm import lines
from slotwise.llm.queries import op12_line_cleaning

WORD = r"[^\x20\x09-\x0D]+"
PROSE = "The river ran past the old mill, and nobody could say who had built it. It was quiet there."


def plain(text):
    """The base columns and the verdict, word by word."""
    text = text or ""
    words = re.findall(WORD, text)
    found = [ln for ln in text.split("\n") if re.search(WORD, ln)]
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i:i + 8]), []).append(i)
    hit = {i + o for at in places.values() if len(at) > 1 for i in at for o in range(8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    lost = sum(len(re.findall(WORD, ln)) for ln in found if lines.rule_of(ln, re.findall(WORD, ln)))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(ln in found[:i] for i, ln in enumerate(found)), len(hit), failed, not failed and 2 * lost <= len(words))


TEXTS = [None, "", "   \n\t\n", PROSE, PROSE + "\n" + PROSE, (PROSE + "\n") * 9, "a b c d e f g h " * 30, "Home | About | Contact\n" + PROSE + " " + PROSE.upper(), "buy%%% now### free$$$ win&&& " * 9 + ".",
         "THE!! SALE!! IS!! ON.!! " * 9, "word " * 19, "word " * 20, "x y z é\x1cb. " * 12, "one two three four five six seven eight.\n\nhome\n\nNext.\n" + PROSE, PROSE + "\r\n" + "All rights reserved.\r\n" + PROSE,
         " ".join(f"w{i % 997}." for i in range(120000)), "\n".join(f"line {i % 70} goes on and on." for i in range(9000)), "a\x0bb\x0cc " * 30, "😀 ok… “Yes.” (no!) " * 9]


def test_query_equals_brute_force(spark, folder, documents):
    ddl, rows = documents([*TEXTS, *TEXTS[:9]], ids=[*range(len(TEXTS)), *range(8), None], extra=("row", "clean", "n_words", "failed"))
    got = op12_line_cleaning(spark, folder(documents=(ddl, rows))).collect()
    want = [(r[0], *plain(r[1])) for r in rows]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert op12_line_cleaning(spark, folder(documents=documents([]))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n.|", max_size=120), min_size=1, max_size=4))
def test_any_text_equals_brute_force(texts):
    out = lines.judge(texts)
    for i, t in enumerate(texts):
        n, chars, symbols, repeats, hit, failed, kept = plain(t)
        assert (out["n_words"][i], out["word_chars"][i], out["n_symbols"][i], out["n_dup_lines"][i], out["n_repeat_words"][i]) == (n, chars, symbols, repeats, hit)
        assert kept == (not failed and 2 * out["n_lost"][i] <= n)


def test_each_rule():
    def rule(line):
        return lines.rule_of(line, re.findall(WORD, line))

    assert rule(PROSE) is None and rule("Yes.") is None and rule("He said: “go home.” Then left") is None
    assert rule("Home | Shop | Blog") == rule("Previous, Next") == rule("HOME") == rule("a > b > c.") == "navigation"
    assert rule("Home is where we live.") is None
    assert rule("This site uses cookies to work.") == rule("Released under the MIT License.") == "boilerplate"
    assert rule("no end of any sentence") == rule("a%%% b### c$$$ d.") == rule("WIN!! NOW!! TODAY.") == "punctuation"
    assert rule("What?! Really? He was there. I saw him come, and I saw him go.") is None


def test_spans_and_clean_text(spark):
    text = "Home | News | Shop\n" + PROSE + "\n\nno end here\n" + PROSE
    row = lines.clean(spark.createDataFrame([(1, text, "x")], "id int, text string, clean string"), keep=["id", "clean"]).first()
    assert row["row"].clean == "x" and row["clean"] == PROSE + "\n\n" + PROSE and not row.rejected
    assert [(text[s.start:s.end], s.rule) for s in row.failed] == [("Home | News | Shop", "navigation"), ("no end here", "punctuation")]


def test_colliding_marks_are_compared_word_by_word(monkeypatch):
    rng = random.Random(5)
    counts = np.array([0, 300, 7, 8, 200])
    ids = np.array([rng.randrange(2) for _ in range(counts.sum())])
    monkeypatch.setattr(lines, "marks", lambda doc, ids, starts, window: np.zeros(len(starts), dtype=np.uint64))
    got, ends = lines.repeated_words(counts, ids), np.cumsum(counts)
    for d, n in enumerate(counts):
        own = ids[ends[d] - n:ends[d]].tolist()
        places = {}
        for i in range(n - 7):
            places.setdefault(tuple(own[i:i + 8]), []).append(i)
        assert got[d] == len({i + o for at in places.values() if len(at) > 1 for i in at for o in range(8)})
