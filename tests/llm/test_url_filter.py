import datetime as dt

from pyspark.sql import functions as F

from stridelake.llm.url_filter import filter_urls, intervals, keys_of, plain_key, plain_url

ENTRY = "list string, kind string, key string, day string, action string"


def entries(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


def test_intervals_from_dated_entries(spark):
    got = intervals(entries(spark, [("a", "domain", "x.org", "2024-01-01", "add"), ("a", "domain", "x.org", "2024-02-01", "remove"), ("a", "domain", "x.org", "2024-03-01", "add"), ("a", "domain", "x.org", "2024-03-05", "add"), ("a", "domain", "y.org", "2024-01-01", "remove"), ("a", "domain", None, "2024-01-01", "add"), ("a", "domain", "z.org", "2024-01-01", "other"), ("a", "domain", "t.org", "2024-01-01", "add"), ("a", "domain", "t.org", "2024-01-01", "remove")])).collect()
    d = dt.date
    assert sorted((r.key, r.since, r.until) for r in got if r.key != "t.org") == [("x.org", d(2024, 1, 1), d(2024, 2, 1)), ("x.org", d(2024, 3, 1), None)]
    assert [(r.since, r.until) for r in got if r.key == "t.org"] == [(d(2024, 1, 1), None)]


def test_keys(spark):
    nums = lambda *n: F.array(*map(F.lit, n))
    got = spark.sql("select 'https://u@A.B.org:80/p//q?x#y' as url").select(keys_of(F.col("url"), nums(1, 2, 3, 9), nums(1, 2, 7))).first()[0]
    assert [(k.kind, k.key) for k in got] == [("url", "https://a.b.org:80/p//q?x"), ("domain", "org"), ("domain", "b.org"), ("domain", "a.b.org"), ("path", "a.b.org/p"), ("path", "a.b.org/p/q")]
    few = spark.sql("select concat('http://h.org/', repeat('z/', 100000)) as url").select(keys_of(F.col("url"), nums(2), nums(1))).first()[0]
    assert [k.key for k in few][1:] == ["h.org", "h.org/z"]


def test_plain_forms(spark):
    urls = {"HTTP://Ex.ORG": "http://ex.org/", "https://u:p@ex.org:443/A?b#c": "https://ex.org/A?b", "http://ex.org:8080/": "http://ex.org:8080/", "http://[2001:DB8::1]:80/x": "http://[2001:db8::1]/x", "no url": "no url", "": ""}
    df = spark.createDataFrame(list(urls.items()), "url string, want string")
    assert [r for r in df.select(plain_url(F.col("url")).alias("got"), "want").collect() if r.got != r.want] == []
    keys = {("domain", "Example.ORG."): "example.org", ("path", "A.com:80/x/"): "a.com/x", ("path", "https://a.com//x/Y?q"): "a.com/x/Y", ("domain", "[2001:DB8::1]"): "[2001:db8::1]", ("url", "HTTP://A.com"): "http://a.com/"}
    df = spark.createDataFrame([(*k, v) for k, v in keys.items()], "kind string, key string, want string")
    assert [r for r in df.select(plain_key(F.col("kind"), F.col("key")).alias("got"), "want").collect() if r.got != r.want] == []


def test_keys_of_another_form_match(spark):
    rows = [("l", "domain", "Example.ORG", "2024-01-01", "add"), ("l", "path", "A.com/x/", "2024-01-01", "add"), ("l", "url", "HTTPS://B.com:443", "2024-01-01", "add"), ("l", "domain", "[2001:DB8::1]", "2024-01-01", "add")]
    day = dt.date(2024, 1, 15)
    pages = [(i, u, day, None, None, None, None) for i, u in enumerate(["http://www.example.org/", "http://a.com/x/y", "http://a.com/xy", "https://b.com/", "http://[2001:db8::1]:8080/z", "http://[2001:db8::2]/z", "http://EXAMPLE.org:80"])]
    assert sorted(k[0] for k, v in run(spark, pages, rows).items() if v[2]) == [0, 1, 3, 4, 6]
    twice = [*rows, ("l", "domain", "example.org", "2024-01-01", "add")]
    assert run(spark, pages, twice) == run(spark, pages, rows) == run(spark, pages, twice, broadcast_bytes=0)


def run(spark, pages, rows, **kw):
    p = spark.createDataFrame(pages, "page_id long, url string, day date, key string, kind int, list string, until string")
    return {(r.page_id, r.url): (r.n_entries, r.lists, r.blocked) for r in filter_urls(p, entries(spark, rows), fetched=F.col("day"), **kw).collect()}


PAGES = [
    (1, "http://sub.bad.org/a/b", dt.date(2024, 1, 15), "k", 1, "l", "u"),
    (2, "http://sub.bad.org/a/b", dt.date(2024, 2, 1), None, None, None, None),
    (3, "http://notbad.org/", dt.date(2024, 1, 15), None, None, None, None),
    (4, None, dt.date(2024, 1, 15), None, None, None, None),
    (5, "no url at all", None, None, None, None, None),
    (6, "", dt.date(2024, 1, 15), None, None, None, None),
    (None, "http://ok.net/spam/x", dt.date(2024, 1, 15), None, None, None, None),
    (None, "http://ok.net/spam/x", dt.date(2024, 1, 15), None, None, None, None),
    (7, "http://ok.net/spammer", dt.date(2024, 1, 15), None, None, None, None),
    (8, "http://sub.bad.org/" + "z/" * 3000, dt.date(2024, 1, 15), None, None, None, None),
]
LIST = [("l1", "domain", "bad.org", "2024-01-01", "add"), ("l1", "domain", "bad.org", "2024-02-01", "remove"), ("l2", "path", "ok.net/spam", "2023-01-01", "add"), ("l3", "domain", "sub.bad.org", "2023-01-01", "add"), ("l3", "domain", "sub.bad.org", "2023-01-01", "add")]


def test_entries_in_force_at_the_fetch(spark):
    got = run(spark, PAGES, LIST)
    assert got[1, PAGES[0][1]] == (2, "l1,l3", True)
    assert got[2, PAGES[0][1]] == (1, "l3", True)
    assert [got[i, PAGES[i - 1][1]] for i in (3, 4, 5, 6)] == [(0, "", False)] * 4
    assert got[None, "http://ok.net/spam/x"] == (1, "l2", True)
    assert got[7, "http://ok.net/spammer"] == (0, "", False)
    assert got[8, PAGES[9][1]] == (2, "l1,l3", True)
    assert len(got) == 9


def test_long_lists_are_joined_with_salts(spark):
    assert run(spark, PAGES, LIST, broadcast_bytes=0) == run(spark, PAGES, LIST)


def test_empty(spark):
    assert run(spark, [], LIST) == {}
    assert all(v == (0, "", False) for v in run(spark, PAGES, []).values())
