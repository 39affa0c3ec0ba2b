"""Token alignment against every shared byte offset and every overlap, without windows."""

import functools
import hashlib
import random
from collections import Counter

import pandas as pd
import pytest

from codeloom.llm import token_alignment as ta

DATA = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@functools.cache
def tokenizers():
    return ta.Tokenizers(ta.BYTE_LEVEL, ta.PIECES)


def spans(ids, vocabulary):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(vocabulary.entries[i])))
        at = out[-1][2]
    return out


def links_of(a, b):
    out, j = [], 0
    for i, low, high in a:
        while b[j][2] <= low:
            j += 1
        k = j
        while k < len(b) and b[k][1] < high:
            out.append((i, b[k][0]))
            k += 1
    return out


def expected(rows):
    of, docs = tokenizers(), []
    for doc_id, text in rows:
        a = of.tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids
        b = of.pieces.encode(text or "")
        whole = b" " + (text or "").encode()
        if not text or b"".join(of.a.entries[i] for i in a) != whole or b"".join(of.b.entries[i] for i in b) != whole:
            docs.append((doc_id, [], [], [], ""))
            continue
        a, b = spans(a, of.a), spans(b, of.b)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, _ in side if low <= s < end) for side in (a, b)) if len(a) < 3000 else None)
            low = end
        docs.append((doc_id, a, b, links_of(a, b), groups))
    n = Counter(p for *_, links, _ in docs for p in set(links))
    top = {}
    for (a, _), k in n.items():
        top[a] = max(top.get(a, 0), k)
    out = []
    for doc_id, a, b, links, groups in docs:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups and None not in groups else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(n[p] == top[p[0]] for p in links), sum(n[p] for p in links), digest))
    return out


def compare(got, rows):
    key = lambda r: tuple(str(x) for x in r)
    assert got.columns == list(COLUMNS)
    got, want = sorted(map(tuple, got.collect()), key=key), sorted(expected(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:7] == w[:7]
        assert not w[7] or g[7] == w[7]


def test_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    compare(ta.op12_token_alignment(spark, DATA), list(zip(docs.doc_id, docs.text)))


@pytest.mark.parametrize("memo", [100_000, 0])
def test_hard_texts(spark, monkeypatch, memo):
    monkeypatch.setattr(ta, "MEMO_LINKS", memo)
    texts = [
        None, "", " ", "   two  spaces ", "\n\n\tdef f(x):\n    return  x\n", "x", "naïve café 漢字漢字 \U0001f600\U0001f469‍\U0001f680 é",
        "<|endoftext|> <s> </s> <unk> <0x0A> [INST]", "with ▁ mark", "w" * 3000, "ab " * 900, " nbsp　wide sep\x00nul", "ﬁ ligature ① ½ Å",
        "same text here", "same text here", "same text here",
    ]
    rows = [(i % 13 if i % 5 else None, t, "en", 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, n_a long").repartition(3)
    compare(ta.align_corpus(docs), [r[:2] for r in rows])
    assert ta.align_corpus(docs.limit(0)).count() == 0


def test_windows_are_cut_at_anchors_and_remembered():
    memo = ta.Memo(tokenizers())
    of = memo.of.encode(["the cat and the cat and the dog", "", "the dog"])
    windows = memo.windows(of, *ta.anchors(of, memo.of)[1:])
    assert len(windows) == 10 and windows[1] == windows[4] and windows[8:] == [windows[0], windows[7]] and len(memo.known) == 4
    memo.windows(of, *ta.anchors(of, memo.of)[1:])
    assert len(memo.known) == len(memo.texts) == 4


def test_ranks_give_the_ids_of_the_tokenizers_own_library():
    of, rng = tokenizers(), random.Random(2)
    near, some = [chr(c) for c in range(1, 0x250)], "ab cd'st  \n\t 12.,!\r\x85\xa0ÀéßŁ"
    texts = ["".join(rng.choice(near if k % 2 else some) for _ in range(rng.randrange(80))) for k in range(4000)]
    assert [of.encode_a(t) for t in texts] == [e.ids for e in of.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_pairs_in_many_files(spark, monkeypatch):
    monkeypatch.setattr(ta, "PAIRS_A_FILE", 5)
    monkeypatch.setattr(ta, "OPEN_FILES", 2)
    rows = [(i, f"token number {i} of the {i * 7} tokens") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(ta.align_corpus(docs), rows)
