import random
import time

import pytest
from pyspark.sql import functions as F

from codeloom.operators import keyed, merging
from codeloom.operators.overlap import overlap_join

HIT = "file_path string, chunk_id string, start_line int, end_line int, score double, ordinal int"


def merge(spark, rows, cap=60):
    hits = [(f, f"c{i}", s, e, sc, i) for i, (f, s, e, sc) in enumerate(rows)]
    return merging.merge_neighbours(spark.createDataFrame(hits, HIT), cap)


def ranges(frame):
    return sorted((r.file_path, r.start_line, r.end_line) for r in frame.collect())


@pytest.mark.parametrize(
    "given, expected",
    [
        ([(1, 20), (21, 40)], [(1, 40)]),
        ([(1, 30), (25, 50)], [(1, 50)]),
        ([(1, 10), (15, 25)], [(1, 10), (15, 25)]),
        ([(1, 80), (81, 130)], [(1, 80), (81, 130)]),
        ([(1, 50), (51, 100)], [(1, 50), (51, 100)]),
        ([(1, 200), (10, 20)], [(1, 200)]),
        ([(1, 50), (40, 90), (45, 48)], [(1, 50), (40, 90)]),
    ],
)
def test_merge_cases(spark, given, expected):
    merged = merge(spark, [("a.py", s, e, 0.5) for s, e in given])
    assert ranges(merged) == [("a.py", *r) for r in expected]


def test_files_stay_apart_and_best_score_is_kept(spark):
    merged = merge(spark, [("a.py", 1, 20, 0.3), ("b.py", 21, 30, 0.9), ("a.py", 15, 30, 0.7)])
    assert sorted((r.file_path, r.score, r.part_ids) for r in merged.collect()) == [
        ("a.py", 0.7, ["c0", "c2"]), ("b.py", 0.9, ["c1"]),
    ]


def plain_merge(rows, cap):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1] + 1 and e - out[-1][0] + 1 <= cap:
            out[-1] = (min(out[-1][0], s), max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def plain_drop(rows):
    kept = []
    for s, e in sorted(rows, key=lambda r: r[0] - r[1]):
        if not any(a <= s and e <= b for a, b in kept):
            kept.append((s, e))
    return kept


def test_merge_and_drop_match_brute_force(spark):
    rng = random.Random(7)
    rows, expected_merge, expected_drop = [], [], []
    for f in range(40):
        spans = set()
        while len(spans) < rng.randint(1, 25):
            start = rng.randint(1, 150)
            spans.add((start, start + rng.randint(0, 40)))
        spans = sorted(spans)
        rows += [(f"f{f}", s, e, 0.5) for s, e in spans]
        expected_merge += [(f"f{f}", *r) for r in plain_merge(spans, 60)]
        expected_drop += [(f"f{f}", *r) for r in plain_drop(spans)]
    assert ranges(merge(spark, rows)) == sorted(expected_merge)
    frame = spark.createDataFrame([(f, f"c{i}", s, e, sc, i) for i, (f, s, e, sc) in enumerate(rows)], HIT)
    assert ranges(merging.drop_covered(frame)) == sorted(expected_drop)


def test_a_file_of_one_long_island_folds_in_linear_time(spark):
    rng = random.Random(4)
    spans = sorted((s, s + rng.randint(0, 30)) for s in range(1, 100_001))
    rows = spark.createDataFrame([(str(i), s, e) for i, (s, e) in enumerate(spans)], "chunk_id string, start_line int, end_line int")
    hits = rows.selectExpr("'f' AS file_path", "*", "0.5D AS score", "CAST(chunk_id AS int) AS ordinal")
    began = time.monotonic()
    merged = merging.merge_neighbours(hits, 60).select("start_line", "end_line", F.size("part_ids").alias("n")).collect()
    assert time.monotonic() - began < 30
    assert sorted((r.start_line, r.end_line) for r in merged) == plain_merge(spans, 60)
    assert sum(r.n for r in merged) == len(spans)


def test_equal_ranges_keep_the_higher_score(spark):
    frame = spark.createDataFrame(
        [("f", "a", 1, 9, 0.2, 0), ("f", "b", 1, 9, 0.8, 1), ("f", "c", 1, 9, 0.8, 2)], HIT
    )
    assert [r.chunk_id for r in merging.drop_covered(frame).collect()] == ["b"]


@pytest.mark.parametrize(
    "rest, graph, k, expected",
    [(20, 20, 10, (7, 3)), (20, 1, 10, (9, 1)), (4, 20, 10, (4, 3)), (3, 5, 10, (3, 5)), (20, 0, 10, (10, 0)), (0, 12, 10, (0, 3))],
)
def test_quota(spark, rest, graph, k, expected):
    rows = [(1.0 - i / 100, i, False) for i in range(rest)] + [(0.3 - i / 100, 100 + i, True) for i in range(graph)]
    frame = spark.createDataFrame(rows, "score double, ordinal int, graph_only boolean")
    kept = merging.quota_topk(frame, k).collect()
    assert (sum(not r.graph_only for r in kept), sum(r.graph_only for r in kept)) == expected


def test_keep_best_takes_max_and_earlier_on_ties(spark):
    rows = [("c1", 0.5, 1, "x"), ("c1", 0.9, 2, "y"), ("c1", 0.9, 3, "z"), ("c2", 0.1, 4, "w")]
    frame = spark.createDataFrame(rows, "chunk_id string, score double, ordinal int, tag string")
    best = keyed.keep_best(frame, ["chunk_id"], "score", "ordinal").collect()
    assert sorted((r.chunk_id, r.tag) for r in best) == [("c1", "y"), ("c2", "w")]


def test_overlap_join_matches_brute_force(spark):
    rng = random.Random(1)

    def make(n):
        return [(f"f{rng.randint(0, 3)}", i, s := rng.randint(1, 500), s + rng.randint(0, 200)) for i in range(n)]

    left, right = make(120), make(120)
    a = spark.createDataFrame(left, "file_path string, l int, start_line int, end_line int")
    b = spark.createDataFrame(right, "file_path string, r int, line_start int, line_end int")
    found = sorted((x.l, x.r) for x in overlap_join(a, b, ["file_path"]).collect())
    assert found == sorted(
        (l[1], r[1]) for l in left for r in right if l[0] == r[0] and r[3] >= l[2] and r[2] <= l[3]
    )
