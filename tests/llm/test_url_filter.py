import random
import re

import pytest

from popspark.llm import url_filter as U


def brute(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(U.UPPER, U.LOWER)), m[2]) if m else ("", "")
    fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "block"), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


@pytest.mark.parametrize("ranges", [1, 5])
def test_against_brute_force(spark, ranges):
    rng = random.Random(ranges)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "a.b.a.com", "org", "A.Com", "com.", "", "c-d.com", "a.com:80"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/X"]
    urls = [None, "", "no scheme", "http:/a.com", "https://", "x://y://a.com/x", "ftp://a.com?x=://b", "http://a.com#/x", "http://a.com/x\ny?z"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/x', '#f', 'z'])}" for _ in range(400)]
    rules = list({U.Rule(rng.choice(["block", "allow"]), h, p) for h in ("com", "a.com", "b.a.com", "org") for p in rng.sample(paths, 3)})
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[30], "y")] * 3, "page_id long, url string, host string")
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], U.RULES)
    got = U.judged(pages, table, ranges=ranges)
    expect = [(i, *brute(u, rules)) for i, u in enumerate(urls)] + [(None, *brute(urls[30], rules))] * 3
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expect))


def test_empty_tables_and_no_rules(spark):
    none = spark.createDataFrame([], U.RULES)
    assert U.judged(spark.createDataFrame([], "page_id long, url string"), none).count() == 0
    assert U.judged(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), none).first().verdict == "allow"


def test_query_matches_its_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    rows = U.op1_url_filter(spark, d).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, rows)) == sorted(c.sql(U.OP1_SQL).fetchall()) and len(rows) == 50
