import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slotwise.llm import pii
from slotwise.llm.queries import op4_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_pattern(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            s = m.group()
            digits = re.sub("[^0-9]", "", s)
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")),
                    "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def base(text):
    return [s for s in pii.find(text) if s[0] in pii.BASE]


PIECES = ["a@b.c", "x.y+z@mail-1.example.com", "@", ".", "-", " ", "+", "1", "12", "255", "256", "4111111111111111", "4111 1111 1111 1111", "+1 (269) 555-3296",
          "10.0.0.1", "1.2.3.4.5.6.7.8", "é", "𝒳", "(", ")", "word", "a@b", "..", "--", "0000.1.2.3", "_"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_anchored_parsers_equal_patterns(text):
    assert base(text) == base_by_pattern(text)


def test_added_kinds():
    text = "see https://host.example.com/a?b=c. IBAN DE89 3704 0044 0532 0130 00, account no 12; Account: 12345678 and 555-3296 4524132264652876"
    got = [(k, text[a:b]) for k, a, b in pii.find(text) if k in pii.ADDED]
    assert ("address", "https://host.example.com/a?b=c") in got
    assert ("account", "DE89 3704 0044 0532 0130 00") in got
    assert ("account", "12345678") in got
    assert all(t != "12" for _, t in got)


def test_masked_text_keeps_the_rest():
    text = "mail a@b.cd or +1 (269) 555-3296 now"
    assert pii.masked(text, pii.find(text)) == "mail [EMAIL] or [PHONE] now"


def test_query_rows(spark, folder, documents):
    texts = ["mail a@b.cd, 10.0.0.1 and 4111 1111 1111 1111", "", None, "𝒳 +1 (269) 555-3296", "𝒳 +1 (269) 555-3296", "1 " * 30000 + "a@b.c"]
    path = folder(documents=documents(texts, extra=("spans", "row", "n_email")))
    got = {r.doc_id: r for r in op4_pii(spark, path).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base_by_pattern(t)
        digest = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == w[0] for w in want) for k in pii.BASE)
        assert got[i].spans.startswith(digest)
    empty = folder(documents=documents([]))
    assert op4_pii(spark, empty).count() == 0


@pytest.mark.parametrize("text,want", [
    ("account number: 12345678", "12345678"), ("Account No. 12345678.", "12345678"), ("acct # 12345678", "12345678"), ("my account number is 1234-5678-90, thanks", "1234-5678-90"),
    ("SSN is 123-45-6789", "123-45-6789"), ("ssn no 123 45 6789", "123 45 6789"), ("passport no. X1234567", "X1234567"), ("Passport: AB1234567;", "AB1234567"),
    ("Kontonummer: 12345678", "12345678"), ("numéro de compte n° 12345678", "12345678"), ("member id is 00123456", "00123456"),
    ("iban is DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00"),
])
def test_identifiers_after_words(text, want):
    assert [text[a:b] for k, a, b in pii.find(text) if k == "account"] == [want]


@pytest.mark.parametrize("text", ["account of 12345678 people", "account number", "accountable 12345678", "passport no. X123", "account no 12", "passport X1234567890123456789",
                                  "account nothing 12345678", "account is is is 12345678", "ssn" + " " * 9 + "123456789"])
def test_no_identifier_after_other_words(text):
    assert not [s for s in pii.find(text) if s[0] == "account"]
