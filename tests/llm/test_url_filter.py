import random

import numpy as np
import pytest

from deedscope.llm import blocked_bloom as bloom
from deedscope.llm import url_filter as uf
from deedscope.llm.queries import ORACLE_SQL
from tests.llm.fixtures import clashing

SCHEMA = "page_id long, url string, html string"
HOSTS = ["a.com", "com", "xcom", "example.com", "www.example.com", "m.www.example.com", "EXAMPLE.com", "b.net", "net", "ads-x.org", "spam.net"]
PATHS = ["", "/", "/en/", "/en/1", "/en", "/es/2/", "/fr/3#top", "/de/4?x=://b.com/en/", "?q", "//x//", "/" + "long" * 5_000]


def rows():
    rng = random.Random(3)
    out = [(i, f"{rng.choice(['http', 'https'])}://{h}{p}", "x") for i, (h, p) in enumerate((h, p) for h in HOSTS for p in PATHS)]
    odd = [None, "", "no scheme", "://", "://.com/en/", "a://b://c.com/", "http://a.com./en/", "HTTP://Ü.com/en/\n", "http://[::1]:80/x"]
    out += [(1_000 + i, url, None) for i, url in enumerate(odd)]
    return out + [(None, "http://b.net/es/1", "x"), (None, "http://b.net/es/1", "x"), (7, "http://q.org/", "x"), (7, "http://q.org/", "x")]


def plainly(url, rules, listed):
    """One URL by the contract's words, rule by rule."""
    if url is None or "://" not in url:
        return "", "", None, "allow", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for entry, verdict in rules:
        at = entry.find("/")
        name, begin = (entry, "") if at < 0 else (entry[:at], entry[at:])
        if (host == name or host.endswith("." + name)) and path.startswith(begin):
            fits.append((len(entry), entry, verdict))
    if fits:
        _, entry, verdict = max(fits)
        return host, path, entry, verdict, None
    canonical = host.removeprefix("www.") + path.rstrip("/")
    hit = canonical in listed and host != ""
    return host, path, None, "block" if hit else "allow", canonical if hit else None


@pytest.mark.parametrize("filter_bytes, broadcast_bytes", [(32 << 20, 8 << 20), (32, 8 << 20), (32 << 20, 0)])
def test_judging_equals_the_plain_form(spark, filter_bytes, broadcast_bytes):
    rules = [*uf.RULES, ("b.net", "block"), ("b.net/en", "allow"), ("net/en/1", "block")]
    singles = ["q.org", "ads-x.org/en/1", "spam.net//x", "nobody.org/x"]
    entries = [(e, v, "rule") for e, v in rules] + [(e, "block", "url") for e in singles] + [(None, "block", "rule")]
    listed = spark.createDataFrame(entries, "entry string, verdict string, kind string")
    pages = clashing(spark.createDataFrame(rows(), SCHEMA).repartition(3), "keys", "host", "best")
    found = uf.judge(pages, listed, max_filter_bytes=filter_bytes, max_broadcast_bytes=broadcast_bytes).collect()
    want = [(page_id, *plainly(url, rules, singles)) for page_id, url, _ in rows()]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, r.listed_url) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_the_query_equals_its_sql_on_odd_urls(spark):
    import duckdb

    pages = spark.createDataFrame(rows(), SCHEMA)
    found = uf.filter_pages(pages).collect()
    con = duckdb.connect()
    given = pages.toArrow()  # noqa: F841
    con.sql("CREATE VIEW pages AS SELECT * FROM given")
    want = con.sql(f"SELECT page_id, host, path, rule, verdict, listed_url FROM ({ORACLE_SQL['op13_url_filter']})").fetchall()
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, r.listed_url) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_lists_and_empty_tables(spark):
    none = spark.createDataFrame([], "entry string, verdict string, kind string")
    pages = spark.createDataFrame(rows()[:5], SCHEMA)
    assert {r.verdict for r in uf.judge(pages, none).collect()} == {"allow"}
    assert uf.filter_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_filter_holds_every_key_and_few_others(spark):
    rng = np.random.default_rng(5)
    keys = rng.integers(-(2**62), 2**62, 20_000)
    table = spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "h long").repartition(5)
    words = bloom.build(table, "h", len(keys))
    assert bloom.passes(words, keys).all()
    others = np.setdiff1d(np.arange(200_000), keys)
    assert bloom.passes(words, others).mean() < 0.005
    small = bloom.build(table, "h", len(keys), max_bytes=64)
    assert small.shape == (2, 8) and bloom.passes(small, keys).all()
