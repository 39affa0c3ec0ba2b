"""URL filter: parts and rules against plain Python, splits against all splits, weights by hand."""

import itertools
import math
import re

import numpy as np
import pandas as pd
import pytest

from codeloom.llm import url_filter as uf

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected_parts(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1", "https://example.net/de/", "http://x.net", "http://x.net?/a", "http://net/",
    "http://notexample.com/de/x", "http://a.example.com/de/x#y", "http://a.example.org/fr/", "http://u:p@casino-win.example.org:80/Ä/b?c://d",
    "x://y://z/p", "http://ÀB.org/fr/é", "http://www.freecasino.example.org/en/1", "http://a.b.c.d.org/fr", "http://" + "ab" * 5000 + ".org/" + "c/" * 3000,
    "http://line\nbreak.net/a\nb?c",
]


def test_parts_rules_and_hard_urls(spark):
    rows = [(i, u, "h", 1, "w") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, label int, words string")
    docs = spark.createDataFrame([(1, "free win the the free home"), (2, None), (3, "")], "doc_id long, text string")
    got = uf.filter_urls(pages, docs).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = expected_parts(rows[r["page_id"]][1])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    by_url = {rows[r["page_id"]][1]: r["verdict"] for r in got}
    assert by_url["http://www.freecasino.example.org/en/1"] == "block" and by_url[None] == "allow"
    assert uf.filter_urls(pages.limit(0), docs).count() == 0 and uf.filter_urls(pages, docs.limit(0)).count() == len(rows)


def test_query_rows_and_unwanted_hosts(spark):
    pages = pd.read_parquet(f"{DATA}/pages.parquet")
    got = uf.op13_url_filter(spark, DATA).toPandas().set_index("page_id")
    assert len(got) == len(pages)
    for page_id, url in zip(pages.page_id, pages.url):
        row = got.loc[page_id]
        host, path, rule, verdict = expected_parts(url)
        assert (row.host, row.path, row["rule"] or None) == (host, path, rule)
        unwanted = bool(set(re.split("[^a-z]+", host)) & set(uf.UNWANTED))
        assert row.verdict == (verdict or ("block" if unwanted else "allow"))


@pytest.mark.parametrize("label", ["freecasinowin", "xq", "aab", "casinoq", "homefreex9", "a"])
def test_split_is_the_best_of_all_splits(label):
    known = {w: math.log(p) for w, p in {"free": 1e-3, "casino": 1e-5, "win": 1e-4, "home": 1e-3, "a": 1e-2, "aa": 1e-5, "in": 1e-3, "casinow": 1e-9}.items()}
    total = 1e6

    def cost(words):
        return sum(known[w] if w in known else math.log(10 / total) + len(w) * math.log(0.1) for w in words)

    every = []
    for cuts in itertools.product((0, 1), repeat=len(label) - 1):
        words, word = [], label[0]
        for cut, c in zip(cuts, label[1:]):
            words, word = (words + [word], c) if cut else (words, word + c)
        every.append([*words, word])
    assert cost(uf.split_label(label, known, total)) == pytest.approx(max(map(cost, every)))


def test_weights_are_those_of_multinomial_bayes(spark):
    rows = [([1, 2, 2], 1, 3), ([2], 0, 5), ([], 0, 1)]
    model = uf.train(spark.createDataFrame(rows, "buckets array<int>, label int, pages long"))
    assert model.prior == pytest.approx(math.log(4 / 7))
    assert model.weights[1] == pytest.approx(math.log(3.1 / 9.2) - math.log(0.1 / 5.2))
    assert model.weights[2] == pytest.approx(math.log(6.1 / 9.2) - math.log(5.1 / 5.2))
    assert np.isfinite(model.weights).all() and np.count_nonzero(model.weights) == 2


def test_labelled_pages_take_the_place_of_weak_labels(spark):
    pages = spark.createDataFrame([(i, f"http://{'goodname' if i % 2 else 'badname'}.example.org/en/{i}") for i in range(40)], "page_id long, url string")
    docs = spark.createDataFrame([("good bad name name",)] * 9, "text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(20)], "page_id long, label int")
    got = uf.filter_urls(pages, docs, labels=labels).collect()
    assert all(r["verdict"] == ("allow" if r["page_id"] % 2 else "block") for r in got)
