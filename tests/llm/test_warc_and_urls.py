"""WARC round trips and url rules against brute force."""

import base64
import gzip
import hashlib
import re
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from findmill.llm import queries, url_rules, warc


@pytest.mark.parametrize("chunk_bytes,min_bytes", [(1 << 16, 0), (7, 3)])
def without_redundant(rules):
    """Rules that hold no shorter one of at least their confidence, each compared with all."""
    return [r for r in rules if not any(set(k[0]) < set(r[0]) and k[1] >= r[1] for k in rules)]


def test_archives_come_back(spark, tmp_path, chunk_bytes, min_bytes):
    rows = [
        (1, "http://a/\r\nX: y", "WARC/1.0\r\n\r\nWARC/1.0\r\n" * 3, "r"), (2, None, None, "r"), (3, "http://c", "", "r"), (4, "http://d", "é日🙂" * 9, "r"),
        (5, "http://e", "é日🙂" * 9, "r"), (5, "http://e", "é日🙂" * 9, "r"), (None, "http://f", "é日🙂" * 9, "r"), (None, None, "alone", "r"), (9, "u", "ab", "r"), (8, "u", "ab", "r"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record string").repartition(3)
    path = str(tmp_path / "warc")
    got = warc.archive(df, path, chunk_bytes=chunk_bytes, min_bytes=min_bytes).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    key = lambda name: int(name.split(":")[0]) if name and name.split(":")[0] else None
    seen = sorted(((key(r.record), r.payload_bytes, r.payload_digest, r.record_type, key(r.refers_to)) for r in got), key=str)
    expected, top = [], {}
    for i, _, html, _ in rows:
        body = (html or "").encode()
        top[body] = max(top.get(body, -1), -1 if i is None else i)
    used = set()
    for i, _, html, _ in rows:
        body = (html or "").encode()
        own = len(body) < min_bytes or (top[body] in (i, -1) and body not in used)
        if own and len(body) >= min_bytes:
            used.add(body)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        expected.append((i, len(body), digest, "response" if own else "revisit", None if own else top[body]))
    assert seen == sorted(expected, key=str)
    raw = b"".join(gzip.open(p).read() for p in Path(path).glob("part-*"))
    assert raw.count(b"WARC-Type: revisit") == sum(r.record_type == "revisit" for r in got)
    assert (raw.count(b"WARC-Type: continuation") > 0) == (chunk_bytes < 10)


def test_missing_segment_is_noticed(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "abcdefghij"), (2, "u", "xy")], "page_id long, url string, html string")
    chunks = warc.chunk_table(df, chunk_bytes=4)
    warc.write_archives(chunks.where("chunk_no <> 2"), str(tmp_path / "w"))
    got = {r.record.split(":")[0]: r.intact for r in warc.read_records(warc.read_chunks(spark, str(tmp_path / "w"))).collect()}
    assert got == {"1": False, "2": True}


def test_empty_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(df, str(tmp_path / "w")).count() == 0


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x", "http://example.org/en/12?x=1", "https://org/", "http://org", "http://xorg/",
    "http://m.b.com/fr/1#top", "http://b.com:80/de/", "http://com/de/x?y#z", "a://b://c/d", "http://É.com/fr/", "http://x.org?q=/es/", "http://example.org/en/2",
    "http://a.org/\nx?y",
]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_hosts_paths_and_fixed_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, by string")
    rules = [(("query:x",), 0.9, 0.1), (("host:b", "host:com"), 0.8, 0.1)]
    for r in url_rules.judge_urls(df, rules, queries.URL_RULES).collect():
        host, path, rule, said = brute_rule(r.url)
        tokens = set(url_rules.tokens_of(r.url))
        fired = any(set(t) <= tokens for t, _, _ in rules)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, said or ("block" if fired else "allow"))


def test_fixed_rules_are_those_agreed(spark):
    """Written out, not read from the query."""
    assert sorted(queries.URL_RULES) == sorted([
        ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
    ])
    urls = {
        "http://example.org/en/1": "block", "http://a.example.org/en/17?x=1": "block", "http://example.org/en/2": "allow",
        "http://example.org/es/1": "block", "http://b.org/es/1": "allow", "http://b.com/fr/1": "allow", "http://b.com/de/1": "block",
    }
    df = spark.createDataFrame(list(urls.items()), "url string, expected string")
    assert url_rules.judge_urls(df, [], queries.URL_RULES).where("verdict <> expected").count() == 0


def test_mined_rules_are_those_of_counting(spark):
    urls = [f"http://{h}.example.{s}/{p}/{i}{q}" for i, (h, s, p, q) in enumerate(
        (h, s, p, q) for h in ("spam-bets", "good", "m.good") for s in ("com", "org") for p in ("en", "de") for q in ("", "?ref=1") for _ in range(3))]
    bad = [("spam" in u and "com" in u) or ("/de/" in u and "ref" in u and i % 3 > 0) for i, u in enumerate(urls)]
    df = spark.createDataFrame(list(zip(range(len(urls)), urls, bad)), "id long, url string, bad boolean")
    got = url_rules.mine_rules(df, "url", F.col("bad"), F.col("id"), min_support=0.05, min_confidence=0.6)
    baskets = [set(url_rules.tokens_of(u)) for u in urls]
    counted = []
    for size in range(1, 12):
        for tokens in combinations(sorted(set().union(*baskets)), size):
            having = [b for basket, b in zip(baskets, bad) if set(tokens) <= basket]
            if having and sum(having) / len(urls) >= 0.05 and sum(having) / len(having) >= 0.6:
                counted.append((tokens, sum(having) / len(having), 0.0))
    assert got and {(t, round(c, 9)) for t, c, _ in got} == {(t, round(c, 9)) for t, c, _ in without_redundant(counted)}
    index = url_rules.RuleIndex(got)
    for basket in baskets:
        fired = [c for t, c, _ in got if set(t) <= basket]
        assert index.confidence(sorted(basket)) == (max(fired) if fired else None)


def test_no_labels_give_no_rules(spark):
    df = spark.createDataFrame([], "id long, url string, bad boolean")
    assert url_rules.mine_rules(df, "url", F.col("bad"), F.col("id")) == []
    assert url_rules.judge_urls(df, [], queries.URL_RULES).count() == 0
    assert url_rules.mine_rules(spark.createDataFrame([(1, "http://a/b", None)], "id long, url string, bad boolean"), "url", F.col("bad"), F.col("id")) == []
