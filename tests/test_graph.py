import itertools
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import calls, exports, expansion, graph

EDGE = "source_id string, target_id string, kind string, metadata map<string,string>"
METHOD = (
    "method_id string, service_id string, file_path string, name string, line_start int, line_end int"
)


def edges_of(spark, pairs, kind="method_call"):
    return spark.createDataFrame([(a, b, kind, {}) for a, b in pairs], EDGE)


def methods_of(spark, names):
    return spark.createDataFrame([(n, "svc", f"{n}.py", n, 1, 5) for n in names], METHOD)


def spread(spark, seeds, pairs, names, **kw):
    frame = spark.createDataFrame(seeds, "method_id string, score double")
    rows = expansion.spread_scores(frame, edges_of(spark, pairs), methods_of(spark, names), **kw)
    return {r.method_id: round(r.score, 6) for r in rows.collect()}


def test_caller_and_callee_weights(spark):
    assert spread(spark, [("m", 0.8)], [("c", "m"), ("m", "d")], "mcd", depth=1) == {"c": 0.48, "d": 0.4}


def test_floor_stops_weak_chains(spark):
    assert spread(spark, [("m", 0.2)], [("c", "m")], "mc") == {}


def test_cycles_end_and_seeds_stay_out(spark):
    assert spread(spark, [("a", 1.0)], [("a", "b"), ("b", "a")], "ab", depth=5) == {"b": 0.6}


def test_best_path_wins_and_unknown_methods_carry_nothing(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "x"), ("x", "y")]
    assert spread(spark, [("a", 1.0)], pairs, "abcy") == {"b": 0.5, "c": 0.6}


def test_expand_hits_caps_and_reads_text(spark):
    names = [f"c{i:02d}" for i in range(50)]
    hits = spark.createDataFrame(
        [("h", 0.9, "svc", "m.py", 2, 3)],
        "chunk_id string, score double, repo_id string, file_path string, start_line int, end_line int",
    )
    methods = methods_of(spark, ["m", *names])
    edges = edges_of(spark, [(n, "m") for n in names])
    files = spark.createDataFrame(
        [("svc", f"{n}.py", "l1\nl2\nl3\n") for n in ["m", *names[1:]]],
        "repo_id string, file_path string, content string",
    )
    ghost = edges.union(edges_of(spark, [("m", "ghost"), ("nobody", "m")]))
    found = expansion.expand_hits(hits, methods, ghost, files, 1, 5)
    bonus = found.bonus.collect()
    assert len(bonus) == 5
    assert {r.content for r in bonus} == {"l1\nl2\nl3"}
    assert all(r.score == pytest.approx(0.54) for r in bonus)
    assert tuple(found.gaps.head()) == (1, 1)


def test_call_paths_match_brute_force(spark):
    rng = random.Random(5)
    nodes = [f"n{i}" for i in range(9)]
    pairs = sorted({(a, b) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(30)) if a != b})
    links = set(pairs)
    expected = set()
    for length in range(2, 6):
        for middle in itertools.permutations([n for n in nodes if n not in ("n0", "n1")], length - 2):
            path = ("n0", *middle, "n1")
            if all(step in links for step in zip(path, path[1:])):
                expected.add(path)
    found = graph.call_paths(edges_of(spark, pairs), "n0", "n1", 5).collect()
    assert sorted(tuple(r.path) for r in found) == sorted(expected)
    assert [r.path for r in graph.call_paths(edges_of(spark, pairs), "n0", "n0").collect()] == [["n0"]]


def test_callers_come_from_method_calls_only(spark):
    edges = edges_of(spark, [("m1", "m2"), ("m3", "m2"), ("gone", "m2")]).union(
        edges_of(spark, [("m1", "m4")], "http_call")
    )
    rows = graph.callers(edges, methods_of(spark, ["m1", "m2", "m3", "m4"])).collect()
    assert sorted((r.callee_id, r.method_id) for r in rows) == [("m2", "m1"), ("m2", "m3")]


def test_flows_of_methods(spark):
    edges = spark.createDataFrame([("flow1", "m2", "flow_step", {"step": "2"})], EDGE)
    flows = spark.createDataFrame(
        [("flow1", "LoginFlow", "svc", "m1", 3)],
        "flow_id string, name string, service_id string, entry_method_id string, step_count int",
    )
    row = graph.flows_of_methods(edges, flows).head()
    assert (row.method_id, row.flow_name, row.step, row.entry_method_id) == ("m2", "LoginFlow", 2, "m1")


def test_annotation_sums_over_overlapped_methods(spark):
    hits = spark.createDataFrame(
        [("h1", "svc", "a.py", 1, 9), ("h2", "svc", "zzz.py", 1, 9)],
        "chunk_id string, repo_id string, file_path string, start_line int, end_line int",
    )
    methods = spark.createDataFrame(
        [("a", "svc", "a.py", "a", 1, 3), ("b", "svc", "a.py", "b", 5, 20), ("c", "svc", "c.py", "c", 1, 2)], METHOD
    )
    notes = graph.annotate_hits(hits, methods, edges_of(spark, [("a", "b"), ("c", "b"), ("b", "c"), ("x", "a")])).collect()
    assert [(r.chunk_id, r.callers, r.callees, r.flow) for r in notes] == [("h1", 2, 2, None)]


def test_resolution_uses_full_names_and_skips_self(spark):
    sites = spark.createDataFrame(
        [("s", "A.m", "helper", 9), ("s", "A.m", "helper", 4), ("s", "helper", "A.m", 7), ("s", "helper", "helper", 8),
         ("s", "A.m", "if", 1), ("t", "other", "helper", 1)],
        "service_id string, caller_id string, callee_name string, line int",
    )
    methods = spark.createDataFrame(
        [("s", "A.m", "m", "A.m"), ("s", "helper", "helper", "helper")],
        "service_id string, method_id string, name string, full_name string",
    )
    found = calls.resolve_calls(sites, methods).collect()
    assert sorted((r.source_id, r.target_id, r.line) for r in found) == [("A.m", "helper", 4), ("helper", "A.m", 7)]


def test_mermaid_without_queues_has_no_queue_section(spark):
    nodes = spark.createDataFrame(
        [("auth-svc", "service", 'Auth "x"'), ("datastore:redis:c", "datastore", "c")], "node_id string, node_type string, name string"
    )
    edges = spark.createDataFrame([("auth-svc", "datastore:redis:c", "db_read", {})] * 2, EDGE)
    lines = exports.mermaid_lines(nodes, edges).orderBy("section", "sort_key").collect()
    text = [r.line for r in lines]
    assert text[0] == "graph LR"
    assert "  %% Queues" not in text
    assert text.count("  auth_svc -- Reads --> datastore_redis_c") == 1
    assert "  auth_svc[\"Auth 'x'\"]" in text


def test_summary_counts(spark):
    rows = graph.node_summary(method=methods_of(spark, "abc"), edge=edges_of(spark, [("a", "b")])).collect()
    assert {r.node_type: r["count"] for r in rows} == {"method": 3, "edge": 1}
    per = graph.methods_per_service(
        spark.createDataFrame([("svc",), ("empty",)], "service_id string"), methods_of(spark, "abc")
    )
    assert {r.service_id: r.method_count for r in per.select("*", F.lit(1)).collect()} == {"svc": 3, "empty": 0}
