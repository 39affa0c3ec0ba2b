import re
import time

import pytest

from codeloom.operators import containment, keyed, services
from codeloom.operators.containment import containing, contains_join
from codeloom.sources import ignore_rules


def detect(spark, files, languages):
    frame = spark.createDataFrame(files, "repo_id string, file_path string, content string")
    owners = spark.createDataFrame(list(languages.items()), "service_id string, language string")
    resources, edges = services.detect_dependencies(frame, owners)
    return {r.node_id for r in resources.collect()}, {
        (e.source_id, e.target_id, e.kind): e.metadata for e in edges.collect()
    }


def test_service_graph(spark):
    files = [
        ("auth-service", "auth.py", 'import requests, redis\nr = redis.Redis("h")\nr.save(); r.create()\nrequests.get("http://billing-service:80/x")\n'),
        ("auth-service", "jobs.py", "os.getenv('BILLING_SERVICE_URL'); os.getenv('OTHER_HOST'); os.getenv('PLAIN')\nsb.functions.invoke('sync_users')\n"),
        ("auth-service", "requirements.txt", "flask==1\nx billing-service==2\n"),
        ("billing-service", "db.py", 'c = psycopg2.connect("dbname=bill")\nc.find()\n'),
        ("billing-service", "functions/sync_users/index.py", "from auth_service import x\n"),
        ("billing-service", "q.py", "p = KafkaProducer(queue_name='topic/orders')\np.send(1)\n"),
        ("billing-service", "quoted.py", "'''redis.Redis('''\n"),
        ("web", "app.ts", "const kit = require('@org/auth-service')\nfetch(process.env.API_URL)\n"),
    ]
    nodes, edges = detect(spark, files, {"auth-service": "python", "billing-service": "python", "web": "typescript"})
    assert nodes == {"datastore:redis:shared_redis_db", "datastore:postgres:bill", "queue:kafka:orders"}
    assert set(edges) == {
        ("auth-service", "datastore:redis:shared_redis_db", "db_write"),
        ("auth-service", "billing-service", "http_call"),
        ("auth-service", "external:env_url", "http_call"),
        ("auth-service", "billing-service", "rpc_call"),
        ("auth-service", "billing-service", "library_dependency"),
        ("billing-service", "datastore:postgres:bill", "db_read"),
        ("billing-service", "queue:kafka:orders", "queue_publish"),
        ("billing-service", "auth-service", "library_dependency"),
        ("web", "auth-service", "library_dependency"),
        ("web", "external:env_url", "http_call"),
    }
    assert edges[("auth-service", "external:env_url", "http_call")]["env_var"] == "OTHER_HOST"


def test_empty_variable_fits_the_smallest_other_service(spark):
    reads = spark.createDataFrame([("a", "_API_URL"), ("b", "_API_URL"), ("c", "ZZZ_HOST")], "repo_id string, variable string")
    owners = spark.createDataFrame([("a",), ("b",), ("c",)], "service_id string")
    found = {(r.repo_id, r.variable): r.target_id for r in services.env_targets(reads, owners).collect()}
    assert found == {("a", "_API_URL"): "b", ("b", "_API_URL"): "a", ("c", "ZZZ_HOST"): "external:env_url"}


def test_contains_join_matches_brute_force(spark):
    import random

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts = sorted({word(rng.randint(1, 25)) for _ in range(60)})
    needles = sorted({word(rng.randint(1, 7)) for _ in range(60)})
    a = spark.createDataFrame([(t,) for t in texts], "t string")
    b = spark.createDataFrame([(n,) for n in needles], "n string")
    assert sorted((r.t, r.n) for r in contains_join(a, b, "t", "n").collect()) == sorted(
        (t, n) for t in texts for n in needles if n in t
    )
    assert sorted((r.t, r.n) for r in contains_join(a, b, "t", "n", prefix_only=True).collect()) == sorted(
        (t, n) for t in texts for n in needles if t.startswith(n)
    )


@pytest.mark.parametrize(
    "pattern, hits, misses",
    [
        ("*.log", ["a.log", "x/y.log", "d.log/in"], ["a.logs"]),
        ("build/", ["build/a", "x/build/b"], ["build", "rebuild/a"]),
        ("/top", ["top", "top/a"], ["x/top"]),
        ("a/b", ["a/b", "a/b/c"], ["x/a/b"]),
        ("**/gen", ["gen", "x/gen", "x/y/gen/z"], ["generated"]),
        ("a/**", ["a/b", "a/b/c"], ["a", "b/a/c"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["ab", "a/xb"]),
        ("f?o[0-9].t", ["fxo1.t"], ["fo1.t", "fxoa.t", "f/o1.t"]),
        ("[!a]b", ["cb"], ["ab"]),
        ("\\!x", ["!x"], ["x"]),
    ],
)
def test_ignore_patterns(pattern, hits, misses):
    compiled = re.compile(ignore_rules.glob_regex(pattern))
    assert [bool(compiled.match(p)) for p in hits + misses] == [True] * len(hits) + [False] * len(misses)


def test_nested_rules_and_negation(spark):
    rules = spark.createDataFrame(
        [
            ("r", ".gitignore", "# c\n*.tmp\n!keep.tmp\n"), ("r", "sub/.gitignore", "/only\nany\n"),
            ("r", ".git/info/exclude", "secret\n"), ("r", "node_modules/.gitignore", "*\n"), ("q", ".gitignore", "\n"),
        ],
        "repo_id string, file_path string, content string",
    )
    paths = ["a.tmp", "keep.tmp", "x/keep.tmp", "only", "sub/only", "sub/deep/only", "sub/deep/any", "any", "secret", "a.py"]
    listing = spark.createDataFrame([("r", p) for p in paths] + [("other", "a.tmp")], "repo_id string, file_path string")
    kept = {(r.repo_id, r.file_path) for r in ignore_rules.drop_ignored(listing, ignore_rules.ignore_rules(rules)).collect()}
    assert kept == {("r", p) for p in ["keep.tmp", "x/keep.tmp", "only", "sub/deep/only", "any", "a.py"]} | {("other", "a.tmp")}


def test_a_line_of_a_mebibyte_meets_thousands_of_names(spark):
    names = [f"svc-{i}" for i in range(2000)] + ["shared-prefix", "shared-prefix-long", "zz"]
    line = ("x" * 500 + " svc-7, ") * 2100 + "shared-prefix-long"
    assert len(line) > 2**20
    rows = spark.createDataFrame([(1, line), (2, "svc-19 "), (3, None), (4, "")], "k long, t string")
    needles = spark.createDataFrame([(n,) for n in [*names, "", None, "zz"]], "n string")
    started = time.monotonic()
    got = sorted((r.k, r.n) for r in containing(rows, "t", needles, "n").collect())
    assert time.monotonic() - started < 30
    assert got == [(1, "shared-prefix"), (1, "shared-prefix-long"), (1, "svc-7"), (2, "svc-1"), (2, "svc-19")]
    starts = containing(rows, "t", needles, "n", prefix_only=True).collect()
    assert sorted((r.k, r.n) for r in starts) == [(2, "svc-1"), (2, "svc-19")]


def test_needles_beyond_one_automaton_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(containment, "SHARD_CHARS", 7)
    texts = spark.createDataFrame([("abcdef",), ("cdx",)], "t string")
    needles = spark.createDataFrame([(n,) for n in ("abc", "cd", "def", "bcde", "x", "q", "longer than a shard")], "n string")
    got = {tuple(r) for r in containment.contains_join(texts, needles, "t", "n").collect()}
    assert got == {("abcdef", "abc"), ("abcdef", "cd"), ("abcdef", "def"), ("abcdef", "bcde"), ("cdx", "cd"), ("cdx", "x")}


def test_largest_text_of_each_key_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(keyed, "COMBINED_ROWS", 3)
    rows = [("a", "x", "b"), ("a", "x", "é"), ("a", "x", "z"), (None, "x", "1"), (None, "x", None), ("b", "x", None), ("a", "y", "")] * 4
    best = keyed.largest_text(spark.createDataFrame(rows, "k string, l string, note string"), ["k", "l"], "note")
    assert {tuple(r) for r in best.collect()} == {("a", "x", "é"), (None, "x", "1"), ("b", "x", None), ("a", "y", "")}
    assert best.count() == 4


def test_edges_are_combined_before_they_are_sorted(spark):
    files = spark.createDataFrame(
        [("a", f"f{i}.ts", "await sb.functions.invoke('job', {}); fetch(process.env.X)", "typescript") for i in range(3)],
        "repo_id string, file_path string, content string, service_language string",
    )
    paths = spark.createDataFrame([("b", "src/job.py")], "repo_id string, file_path string")
    edges = services.link(services.file_facts(files), spark.createDataFrame([("a",), ("b",)], "service_id string"), paths)[1]
    assert [(e.source_id, e.target_id, e.metadata["file"]) for e in edges.collect()] == [("a", "b", "f2.ts")]
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "combine" in plan
