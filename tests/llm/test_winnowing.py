"""Benchmark hits for items of every length, and how often the documents are read for them."""

import random
import re

from codeloom.llm import winnowing
from codeloom.llm.base import Scratch

BREAK = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return [w for w in BREAK.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def expected(texts, items):
    out = []
    for doc_id, text in texts:
        ws, hit, found = cut(text), set(), set()
        for item_id, item in items:
            bs = cut(item)
            n = min(len(bs), 10)
            windows = {tuple(bs[i : i + n]) for i in range(len(bs) - n + 1)} if n else set()
            for i in range(len(ws) - n + 1):
                if n and tuple(ws[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(item_id)
        out.append((doc_id, len(ws), len(hit), len(found), bool(hit)))
    return sorted(out, key=str)


def tables(spark, bits=None):
    rng = random.Random(8)
    items = [(f"i{n}", " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(n))) for n in range(0, 13) for _ in range(2)]
    items = [(f"{i}-{k}", t) for k, (i, t) in enumerate(items)]
    texts = []
    for k in range(60):
        words = [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(40))]
        at = rng.randrange(len(words) + 1)
        texts.append((k, " ".join(words[:at] + [rng.choice(items)[1].upper()] + words[at:])))
    texts += [(None, None), (None, "z " + items[-1][1]), (7, ""), texts[3]]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, _hit_id long").repartition(3)
    return texts, items, docs, spark.createDataFrame(items, "item_id string, text string")


def test_items_of_all_lengths_against_brute_force(spark, monkeypatch):
    texts, items, docs, benchmark = tables(spark)
    for bits in (1 << 22, 64):
        monkeypatch.setattr(winnowing, "MOST_BITS", bits)
        got = winnowing.contamination(docs.drop("_hit_id"), benchmark).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got), key=str) == expected(texts, items)


def test_documents_are_scanned_once_for_all_lengths(spark):
    _, _, docs, benchmark = tables(spark)
    scratch = Scratch(spark, "test-winnowing")
    docs = scratch.settle("docs", docs.drop("_hit_id"))
    plan = winnowing.published(docs, winnowing.Benchmark(benchmark, scratch))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan and "Exchange" not in plan and "Python" not in plan
