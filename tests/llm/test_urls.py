from __future__ import annotations

import pytest
import xxhash

from tapeloom.llm import urls
from tapeloom.llm.queries import URL_RULES

URLS = [
    "https://a.Example.NET/en/1?x", "http://example.net/de", "http://b.net", "http://net/", "https://xexample.com/de/1", "http://m.example.com/de/1#t", "http://example.com/DE/",
    "http://x.org/fr/a", "http://org/fr/", "http://x.org/en/", None, "", "no scheme", "://", "a://b://c.net/", "http://É.NET/", "http://a.net?q=/", "http://a.net#/", "HTTP://A.B.C.net//x\ny", "http://a.net/" + "x" * 9000,
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
        rest = rest[k:]
        path = rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


@pytest.mark.parametrize("limit", [urls.INDEX_BYTES, 0])
def test_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "INDEX_BYTES", limit)
    rows = [(k if k % 5 else None, u, "x", "y") for k, u in enumerate(URLS + URLS[:3])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = urls.judge(df, URL_RULES).collect()
    assert sorted(map(str, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got])) == sorted(map(str, [(i, *plain(u)) for i, u, *_ in rows]))
    assert urls.judge(df.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in urls.judge(df, []).collect()} == {"allow"}


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s: len(s) % 2)
    rules = [("a.com", "/", "block"), ("b.com", "/", "allow"), ("cc.com", "/x", "block")]
    urls.write_index(rules, str(tmp_path / "index"))
    index = urls.DigestIndex(str(tmp_path / "index"))
    found = index.find([b"a.com/", b"b.com/", b"cc.com/x", b"d.com/", b"zz.com/y"])
    assert [index.verdicts[int(index.verdict_of[k])] if k >= 0 else None for k in found] == ["block", "allow", "block", None, None]


@pytest.mark.parametrize("rules", [
    [("net", "/", "block"), ("net", "/", "allow")], [("net", "/", "allow"), ("net", "/", "block")],
    [("a.net", "/x", "allow"), ("net", "/x/yz", "block"), ("a.net", "/x", "block")], [("b.net", "/longer", "allow"), ("b.net", "/longer", "allow")],
])
def test_equal_rules_have_one_verdict_by_either_way(spark, monkeypatch, rules):
    """Whatever the order of the rules and the size of the list: the greatest verdict of equal strings."""
    df = spark.createDataFrame([(1, "http://a.net/x/yz"), (2, "http://net/"), (3, "http://b.net/longer/")], "page_id long, url string")
    found = []
    for limit in (urls.INDEX_BYTES, 0):
        monkeypatch.setattr(urls, "INDEX_BYTES", limit)
        found.append(sorted((r.page_id, r.rule, r.verdict) for r in urls.judge(df, rules).collect()))
    assert found[0] == found[1] and len(found[0]) == 3
    assert rules[0][0] != "net" or {v for _, _, v in found[0]} == {"block"}
