"""Spelling variants against all pairs, and their rows against a count in plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeloom.llm import spelling_variants as sv

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def deletions(word):
    return {(i, word[:i] + word[i + 1 :]) for i in range(len(word))}


def expected(counts):
    """Near words by shared deletions: another way than letter counts."""
    by = {}
    for w in counts:
        for i, cut in deletions(w):
            by.setdefault((i, cut), []).append(w)
    near = {w: set() for w in counts}
    for same in by.values():
        for a in same:
            near[a].update(b for b in same if b != a)
    for w in counts:
        for _, cut in deletions(w):
            if cut in counts:
                near[w].add(cut)
                near[cut].add(w)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


def result(rows):
    return {tuple(r) for r in rows.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_query_equals_brute_force(spark, sf_dir=DATA):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    got = sv.op11_spelling_variants(spark, sf_dir)
    assert got.columns[:3] == ["word", "form", "root"]
    want = expected(counted(zip(docs.doc_id, docs.text)))
    assert got.count() == len(want) and result(got) == want


@pytest.mark.parametrize("tile, slice_", [(4096, 16), (5, 1), (3, 2)])
def test_hot_cells_in_tiles_and_slices_lose_nothing(spark, tile, slice_):
    rng = np.random.default_rng(5)
    words = {"".join(rng.permutation(list("aabbccd"))) for _ in range(150)}
    words |= {w + c for w in list(words)[:40] for c in "abz"} | {"q" + w for w in list(words)[:30]}
    counts = {w: int(n) for w, n in zip(sorted(words), rng.choice([2, 3, 40, 900], len(words)))}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert result(sv.group(rows, groups=3, tile=tile, slice_=slice_)) == expected(counts)


def test_words_longer_than_a_packed_cell(spark):
    counts = {}
    for size in (sv.PACKED - 1, sv.PACKED, sv.PACKED + 1, sv.PACKED + 2, 5000):
        word = ("abcde" * 1200)[:size]
        counts |= {word: 50, word[:3] + "z" + word[4:]: 3, word[:9] + word[10:]: 2, word[:30] + "ÿ" + word[30:]: 4}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert result(sv.group(rows)) == expected(counts)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    texts = [(1, "Abcdefgh abcdefgi abcdefgi"), (1, "Abcdefgh abcdefgi abcdefgi"), (None, "abcdefgX abcdefgX"), (3, None), (4, " "), (5, "ÀBCDEFG àbcdefg ÀBCDEFG àbcdefg")]
    rows = spark.createDataFrame([(a, b, "w", 9) for a, b in texts], "doc_id long, text string, word string, n long")
    got = sv.group(sv.word_counts(rows))
    assert result(got) == expected(counted(texts))
    assert sv.group(sv.word_counts(rows.limit(0))).count() == 0


def test_chain_of_forms_ends_at_its_root(spark):
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "xbcdefghij": 20, "zzzzzzz": 2}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert result(sv.group(rows)) == expected(counts)
    assert sv.group(rows).where(F.col("root") == "abcdefghij").count() == 5
