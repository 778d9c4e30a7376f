import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import warc_revisit
from quillspark.llm.warc_revisit import PERMITTED, attach_payload, canonical, header_text, resolve_revisits

SCHEMA = "record_id long, url string, captured long, kind string, headers map<string,string>, digest string, length long, status string"


def records(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        url = rng.choice(["http://hot.example/a", "https://www.hot.example/a/", "http://b.example/?x=1&utm_source=y", f"http://c{rng.randint(0, 20)}.example/", None])
        headers = {}
        for name, values in (("ETag", ['"1"', 'W/"1"', '"2"']), ("last-modified", ["m1", "m2"]), ("Cache-Control", ["c1", "c2"]), ("Content-Type", ["t1", "t2"]), ("X", [None])):
            if rng.random() < 0.5:
                headers[name] = rng.choice(values)
        kind = rng.choice(["response", "revisit", "revisit", "metadata"])
        out.append((i, url, rng.choice([None, *range(60)]), kind, rng.choice([headers, headers, headers, None]), rng.choice(["d1", "d2", None]), i, "clash"))
    return out + out[:20]


def canon(url):
    return {None: "", "http://hot.example/a": "hot.example/a", "https://www.hot.example/a/": "hot.example/a", "http://b.example/?x=1&utm_source=y": "b.example?x=1"}.get(url) if url is None or "c" != url[7] else url[7:-1]


def brute(rows):
    out = []
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    strip = lambda v: v[2:] if v and v.startswith("W/") else v
    for r in rows:
        if r[3] != "revisit":
            continue
        mine = low(r[4])
        earlier = [x for x in rows if x[3] == "response" and r[2] is not None and x[2] is not None and canon(x[1]) == canon(r[1]) and x[2] < r[2]]
        if not earlier:
            out.append((r[0], canon(r[1]), r[2], "no earlier response", None, None, None, mine, r[5], None))
            continue
        x = max(earlier, key=lambda x: (x[2], x[0]))
        theirs = low(x[4])
        checks = [("etag", strip(mine.get("etag")), strip(theirs.get("etag"))), ("last-modified", mine.get("last-modified"), theirs.get("last-modified")), ("digest", r[5], x[5])]
        name, a, b = next((c for c in checks if c[1] is not None and c[2] is not None), ("nothing", 1, 1))
        if a != b:
            out.append((r[0], canon(r[1]), r[2], "validators differ", name, None, x[2], mine, r[5], None))
        else:
            out.append((r[0], canon(r[1]), r[2], "resolved", name, x[0], x[2], theirs | {k: v for k, v in mine.items() if k in PERMITTED}, x[5], x[6]))
    return out


@pytest.mark.parametrize("slices", [1, 7, 1024])
def test_equals_looking_through_all_records(spark, slices):
    rows = records(slices)
    found = [tuple(r) for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA), slices=slices).collect()]
    key = lambda r: (r[0], str(r))
    text = lambda rs: sorted(((*r[:7], tuple(sorted(r[7].items())), *r[8:]) for r in rs), key=key)
    assert text(found) == text(brute(rows))


def test_a_url_with_a_third_of_all_rows(spark, monkeypatch):
    """One stray time must not put all others in one slice, nor many records at one time in one window."""
    rng = random.Random(5)
    rows = [(i, "http://hot.example/a", rng.choice([rng.randint(0, 3000), 50]), rng.choice(["response", "revisit"]), {"date": "x"}, "d1", i, "s") for i in range(1200)]
    rows += [(5000 + i, f"http://c{i % 20}.example/", rng.randint(0, 3000), rng.choice(["response", "revisit"]), None, "d2", i, "s") for i in range(600)]
    rows += [(9000, "http://hot.example/a", 10**15, "revisit", None, None, 1, "s"), (9001, "http://hot.example/a", -(10**15), "response", None, None, 1, "s")]
    seen = []
    real = warc_revisit.rung

    def rung(column, edges):
        seen.append(edges)
        return real(column, edges)

    monkeypatch.setattr(warc_revisit, "rung", rung)
    df = spark.createDataFrame(rows, SCHEMA)
    found = [tuple(r) for r in resolve_revisits(df, slices=64).collect()]
    key = lambda r: (r[0], str(r))
    text = lambda rs: sorted(((*r[:7], tuple(sorted(r[7].items())), *r[8:]) for r in rs), key=key)
    times = {x[2] for x in rows if x[0] < 5000 or x[0] >= 9000}
    assert max(sum(a <= t < b for t in times) for a, b in zip([-(10**18), *seen[0]], [*seen[0], 10**18])) < len(times) / 10
    assert text(found) == text(brute([(*r[:1], r[1], *r[2:]) for r in rows]))


def test_empty_table_and_payload(spark):
    df = spark.createDataFrame(records(1), SCHEMA)
    assert resolve_revisits(df.limit(0)).collect() == []
    two = spark.createDataFrame([(1, "http://a/", 1, "response", {"ETag": "x", "etag": "y"}, "d", 3, "s"), (2, "http://a", 2, "revisit", {"date": "t"}, "d", 0, "s")], SCHEMA)
    resolved = resolve_revisits(two)
    bodies = spark.createDataFrame([(1, "<p>")], "record_id long, html string")
    got = attach_payload(resolved, bodies, "record_id", "html").select("refers_to", "payload", header_text(F.col("headers")).alias("h")).first()
    assert tuple(got) == (1, "<p>", "date: t\netag: x")


def test_canonical_urls(spark):
    cases = {
        "HTTP://User@WWW.Example.com:80/A/b//?z=1&a=2&&utm_x=3&ref=q#frag": "example.com/A/b?a=2&z=1",
        "https://example.com:443": "example.com",
        "http://example.com:8080/?ref=a": "example.com:8080",
        "mailto:x#y": "mailto:x",
        "": "",
        None: "",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r[0]: r[1] for r in df.select("url", canonical(F.col("url"))).collect()} == cases
