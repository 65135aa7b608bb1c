import math
import struct
import zlib

import numpy as np
import pytest
import xxhash
from tests.llm.conftest import SMALL, rows_of
from pyspark.sql import functions as F

from formbook.llm import urls
from formbook.llm.common import table

URLS = [
    "http://a.com/x", "http://A.COM/x", "http://com/", "http://acom/x", "http://a.com", "http://a.com?x=/en/", "https://example.com/en/1",
    "https://b.example.com/en/1", "https://www.example.com/en/1", "https://x.www.example.com/en/", "https://wwwexample.com/en/", "https://example.com/EN/",
    "ftp://k.net/es/1", "ftp://k.net/fr/", "ftp://k.net/fr", "ftp://k.net/de/", "a://b://c/d", "no scheme/at/all", "", None, "://", "x://h#f/en/", "x://h/p?q#f",
    "x://user@a.com:80/en/", "x://Éa.com/ü/\U0001f642\n/z", "x://h/\na?b", "http://a.com/x",
]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fits = [r for r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def buckets(host, path):
    out = []
    for part, text in enumerate((host, path)):
        seed, text = xxhash.xxh64_intdigest(struct.pack("<i", part), 42), f"^{text}$"
        for n in urls.SIZES:
            out += [xxhash.xxh64_intdigest(text[k:k + n].encode(), seed) for k in range(len(text) - n + 1)]
    return sorted(int(np.int64(np.uint64(h))) % urls.BUCKETS for h in out)


def plain_fit(rows, steps=urls.STEPS):
    """The same gradient steps with numpy."""
    x, y = np.zeros((len(rows), urls.BUCKETS + 1)), np.array([float(v == urls.BLOCK) for _, _, v in rows])
    for k, (host, path, _) in enumerate(rows):
        b = buckets(host, path)
        np.add.at(x[k], b, 1 / math.sqrt(max(1, len(b))))
        x[k, -1] = 1.0
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, squares, used = np.zeros(urls.BUCKETS + 1), np.full(urls.BUCKETS + 1, urls.FLOOR), (x != 0).any(axis=0)
    ridge = np.append(np.full(urls.BUCKETS, urls.RIDGE), 0.0)
    for _ in range(steps):
        d = np.where(used, x.T @ (share * (1 / (1 + np.exp(-x @ w)) - y)) + ridge * w, 0.0)
        squares += d * d
        w -= urls.RATE * d / np.sqrt(squares)
    return w


def test_parts_rules_and_buckets_equal_plain_code(llm):
    df = llm.createDataFrame([(k, u) for k, u in enumerate(URLS)], "k int, url string")
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    got = df.select("k", host.alias("h"), path.alias("p")).select("*", urls.rule_of(F.col("h"), F.col("p"), list(urls.RULES)).alias("r"), urls.grams(F.col("h"), F.col("p")).alias("g")).orderBy("k").collect()
    for r, u in zip(got, URLS):
        assert (r["h"], r["p"]) == parts(u), u
        assert r["r"] == ruled(r["h"], r["p"]), u
        assert sorted(r["g"]) == buckets(r["h"], r["p"]), u


def test_every_page_equals_a_plain_fit(llm):
    """Host, path, rule, score and verdict of the registered query against a model fitted without Spark."""
    pages = table(llm, SMALL, "pages").select("page_id", "url").collect()
    labelled = {}
    for p in pages:
        h = parts(p["url"])
        if ruled(*h):
            labelled[h] = urls.RULES[ruled(*h)]
    w = plain_fit([(*h, v) for h, v in labelled.items()])
    got = {r["page_id"]: r for r in urls.op12(llm, SMALL).collect()}
    assert len(got) == len(pages)
    for p in pages:
        host, path = parts(p["url"])
        b, r = buckets(host, path), got[p["page_id"]]
        score = 1 / (1 + math.exp(-(w[-1] + w[b].sum() / math.sqrt(max(1, len(b))))))
        rule = ruled(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["score"] == pytest.approx(score, abs=1e-6)
        assert r["verdict"] == (urls.RULES[rule] if rule else urls.BLOCK if score > 0.5 else urls.ALLOW)


def test_the_model_finds_rules_again_on_urls_it_has_not_seen(llm):
    pages = table(llm, SMALL.replace("0.001", "0.1"), "pages").select("page_id", "url")
    seen = F.crc32(F.col("url").cast("binary")) % 2 == 0
    known = urls.judge(pages.where(seen), urls.RULES, urls.Model((0.0,) * urls.BUCKETS, 0.0))
    model = urls.fit(urls.labelled_by_rules(known.select("host", "path", "rule"), urls.RULES))
    right = [(r["score"] > 0.5) == (r["verdict"] == urls.BLOCK) for r in urls.judge(pages.where(~seen), urls.RULES, model).where("rule is not null").collect()]
    assert len(right) > 100 and np.mean(right) >= 0.95


def test_odd_tables(llm):
    spec = "page_id long, url string, host string, Score int, `verdict` string"
    rows = [(k, u, "x", 1, None) for k, u in enumerate(URLS)] + [(None, None, None, None, None)]
    got = urls.judge(llm.createDataFrame(rows, spec), urls.RULES)
    assert got.columns == ["page_id", "url", "host", "Score", "verdict", "host_", "path", "rule", "score_", "verdict_"]
    assert len(got.collect()) == len(rows) and not got.where("verdict_ is null or score_ is null").head(1)
    assert urls.judge(llm.createDataFrame([], spec), urls.RULES).collect() == []
    only = llm.createDataFrame([(1, "http://q.net/es/1"), (2, "http://other.org/")], "page_id long, url string")
    assert rows_of(urls.judge(only, urls.RULES).select("verdict")) == [("block",), ("block",)]
    none = llm.createDataFrame([(2, "http://other.org/")], "page_id long, url string")
    assert rows_of(urls.judge(none, urls.RULES).select("verdict")) == [("allow",)]


def test_very_long_urls_take_linear_time(llm):
    long = "http://h.org/" + "ab/" * 200_000
    model = urls.Model((0.001,) * urls.BUCKETS, 0.0)
    got = urls.judge(llm.createDataFrame([(long,)], "url string"), urls.RULES, model).first()
    assert zlib.crc32(got["path"].encode()) == zlib.crc32(long[len("http://h.org"):].encode()) and got["score"] > 0.5
