import re

import numpy as np

from slotwise.llm import urls
from slotwise.llm.queries import BLOCKED_WORDS, URL_RULES, op9_url_filter

PAGES = "page_id bigint, url string, html string"
URLS = ["http://www.Example.COM/en/1?x=/fr/", "https://example.com/en", "http://a.b.example.com/en/", "https://x.net/es/a#b", "http://net/fr/", "http://notnet/fr/", "http://badexample.com/en/x",
        "http://EXAMPLE.com", "ftp://x.org?y", "http://casino-win.example.net/en/", "http://casino-win.example.com/x", None, "", "no scheme", "a://b://c/d", "http://", "http:///en/",
        "http://x.net/es/", "http://É.com/\n/z", "http://bets.com", "http://" + "a." * 3000 + "com/" + "p" * 50000, "HTTP://X.NET/es/"]


def plain(url, rules, words):
    rest = (url or "").partition("://")[2]
    host = re.split("[/?#]", rest)[0] if rest else ""
    path = re.split("[?#]", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    verdict = best[2] if best else "block" if set(re.split("[.-]", host)) & set(words) else "allow"
    return host, path, best[1] if best else None, verdict


def test_query_rows(spark, folder):
    rows = [(i, u, "x") for i, u in enumerate(URLS)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op9_url_filter(spark, folder(pages=(PAGES + ", host string, row string", [(*r, "h", "r") for r in rows]))).collect()}
    assert [got[i] for i in range(len(URLS))] == [plain(u, URL_RULES, BLOCKED_WORDS) for u in URLS]
    assert op9_url_filter(spark, folder(pages=(PAGES, []))).count() == 0


def test_long_lists_are_joined(spark, monkeypatch):
    monkeypatch.setattr(urls, "SEND_BYTES", 10)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string")
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules, BLOCKED_WORDS, keep=["page_id"]).select("row.page_id", "host", "path", "rule", "verdict").collect()}
    assert [got[i] for i in range(len(URLS))] == [plain(u, URL_RULES, BLOCKED_WORDS) for u in URLS]


def test_full_strings_settle_collisions(monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda data: len(data) % 3)
    rules = [(f"h{i}.org", "/", "block" if i % 2 else "allow") for i in range(20)]
    table = urls.DigestArray(urls.packed(rules, ("w",))[0])
    out = urls.judge_batch([f"http://h{i}.org/x" for i in range(25)], table, [1], 2)
    assert out["rule"] == [f"h{i}.org/" if i < 20 else None for i in range(25)]
    assert out["verdict"][:4] == ["allow", "block", "allow", "block"]
    assert np.all(np.diff(table.keys.astype(np.int64)) >= 0)
