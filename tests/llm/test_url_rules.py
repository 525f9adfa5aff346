import random
import re
from collections import Counter

from pyspark.sql import functions as F

from storelens.llm import url_rules as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def verdict(host, path, rules, default="allow"):
    fits = [(len(h) + len(p), len(h), h + p, a) for h, p, a in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, default)


def check(spark, ws, urls, rules, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("<p>")).withColumn("rule", F.lit(1)).withColumn("key", F.lit(2))
    got = U.filter_urls(pages, U.rules_table(spark, rules), workspace=ws, **options).collect()
    want = Counter()
    for k, u in enumerate(urls):
        host, path = parts(u)
        want[(k, host, path, *verdict(host, path, rules, **options))] += 1
    assert Counter(tuple(r) for r in got) == want


URLS = [
    None, "", "no scheme.example.org/x", "http://", "https://EXAMPLE.org", "https://example.org/", "https://a.B.example.org/es/1?x=/en/1", "http://example.org/en/1#x", "http://example.org/en/2",
    "http://badexample.org/es/", "ftp://x.com/fr/9", "http://x.com/de/", "http://com/fr/", "http://x.net:80/fr/", "http://x.org?q", "http://x.org#f", "a://b://c.org/", "http://É.Org/ÀB", "http://.org/x", "http://x..org/", "http://org/",
    "http://" + "a." * 300 + "com/de/" + "y" * 5000,
]


def test_registered_rules(spark, ws):
    check(spark, ws, [*URLS, URLS[6], URLS[6]], U.RULES)


def test_nested_rules(spark, ws):
    rng = random.Random(4)
    hosts = ["org", "a.org", "b.a.org", "aa.org", "com", "x.com", "b.org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/b/c", "/ab", "/b", "/é"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts for p in paths if rng.random() < 0.6]
    rules += [("", "/a", "block"), ("org", None, "block")]
    urls = [f"http://{rng.choice(['', 'www.', 'z.y.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'x', '/zz', '?q', '#f'])}" for _ in range(400)]
    check(spark, ws, urls, rules)
    check(spark, ws, urls, rules, default="block")


def test_a_hot_host_and_no_rules(spark, ws):
    check(spark, ws, ["http://hot.example.org/es/1"] * 300 + ["http://other.example.org/x"], U.RULES)
    check(spark, ws, URLS[:6], [])
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(none, U.rules_table(spark), workspace=ws).count() == 0


def test_equal_rules_count_once(spark, ws):
    pages = spark.createDataFrame([(1, "http://x.org/"), (1, "http://x.org/"), (None, "http://x.org/")], "page_id long, url string")
    rules = U.rules_table(spark, [("org", "/", "block"), ("org", "/", "allow"), ("org", "/", "allow")])
    got = Counter(tuple(r) for r in U.filter_urls(pages, rules, workspace=ws).collect())
    assert got == {(1, "x.org", "/", "org/", "allow"): 2, (None, "x.org", "/", "org/", "allow"): 1}


def test_paths_that_go_on_with_the_last_character(spark, ws):
    last = "\U0010ffff"
    check(spark, ws, [f"http://x.com/de/{last}", f"http://x.com/de/{last}{last}a", f"http://x.com/d{last}", f"http://{last}.com/de/", f"http://x.com/de{last}/", "http://x.com/de/퟿"], U.RULES)
    check(spark, ws, [f"http://a.b/{last}/{last}", f"http://a.b/{last}", "http://a.b/x"], [("b", "/", "block"), ("a.b", f"/{last}", "allow"), ("a.b", f"/{last}/{last}", "block")])
