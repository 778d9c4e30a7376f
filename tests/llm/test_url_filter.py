import random

import pytest

from quillspark.llm import url_filter
from quillspark.llm.queries import URL_RULES
from quillspark.llm.url_filter import Rule, judge_urls

HOSTS = ["a.net", "example.net", "www.example.net", "EXAMPLE.net", "notexample.net", "net", "x.org", "deep.er.org", "example.com", "b.example.com:80", "user@example.com", "", ".net", "net."]
PATHS = ["", "/", "/en/", "/en", "/de/x", "/fr/y?q=/en/", "/EN/", "/en/a#b", "?x=/en/", "#/en/", "//en/"]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:cut]


def brute(url, rules):
    host, path = split(url)
    fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


URLS = [f"{s}://{h}{p}" for s in ("http", "https") for h in HOSTS for p in PATHS] + [None, "", "no scheme", "://", "http://", "http://É.net/en/", "ftp://a://b.net/", "http://" + "a." * 2000 + "net/" + "x" * 9000]


@pytest.mark.parametrize("shard_bytes", [1, 1 << 20])
def test_equals_trying_every_rule(spark, shard_bytes):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS[:3])] + [(None, "http://a.net/", "c")], "page_id long, url string, verdict string")
    found = judge_urls(df, URL_RULES, keep=["page_id"], shard_bytes=shard_bytes).collect()
    assert len(found) == len(URLS) + 4
    every = [*URLS, *URLS[:3]]
    for r in found:
        url = "http://a.net/" if r.page_id is None else every[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == brute(url, URL_RULES)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "http://a.net/", "c", 2, 3, 4)], "page_id long, url string, `Verdict` string, `a.b` int, `a``b` int, `__url` int")
    found = judge_urls(df, URL_RULES)
    assert found.columns == ["page_id", "url", "a.b", "a`b", "__url", "host", "path", "rule", "verdict"]
    assert tuple(found.first()) == (1, "http://a.net/", 2, 3, 4, "a.net", "/", "net/", "block")


def test_many_rules_and_later_verdict(spark):
    rng = random.Random(0)
    part = lambda: rng.choice(["a", "b", "c", "é"])
    rules = [Rule(rng.choice(["block", "allow", "watch"]), ".".join(part() for _ in range(rng.randint(1, 3))), "/" + "".join(part() for _ in range(rng.randint(0, 3)))) for _ in range(300)]
    latest = list({(r.host, r.path): r for r in rules}.values())
    urls = [f"http://{'.'.join(part() for _ in range(rng.randint(1, 4)))}/{''.join(part() for _ in range(rng.randint(0, 5)))}" for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in judge_urls(df, rules).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, latest)
    assert [c for c in judge_urls(df, rules).columns] == ["page_id", "url", "host", "path", "rule", "verdict"]


def test_collisions_are_told_apart(monkeypatch, tmp_path):
    monkeypatch.setattr(url_filter, "key_of", lambda text: len(text) % 2)
    (tmp_path / "f").write_bytes(url_filter.DigestFile.content([(t, i) for i, t in enumerate(["aa", "bb", "c", "dd", ""])]))
    found = url_filter.DigestFile(str(tmp_path / "f")).find(["dd", "aa", "zz", "c", "d", "", "bb"])
    assert found.tolist() == [3, 0, -1, 2, -1, 4, 1]


def test_no_rules_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [r.verdict for r in judge_urls(df, []).collect()] == ["allow"]
    assert judge_urls(df.limit(0), URL_RULES).collect() == []


def test_equal_rules_are_shared_once(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    judge_urls(df, URL_RULES).collect()
    before = list(spark.sparkContext.listFiles)
    assert judge_urls(df, URL_RULES).count() == 1 and list(spark.sparkContext.listFiles) == before
