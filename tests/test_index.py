"""Source tree to index to answer, on small trees."""

import dataclasses
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from codeloom import cli
from codeloom.operators import changes, encoding
from codeloom.plans import index_build, retrieval
from codeloom.settings import Repo, Settings
from codeloom.sources import source_tree, tables, workspace

MODEL = encoding.HashModel(32)
TREE = {
    "__init__.py": "",
    "auth.py": "class AuthClient:\n    def get_token(self, u):\n        return sign(u)\n\n    def check(self, t):\n        return self.get_token(t)\n",
    "lib/sign.py": "def sign(u):\n    return u\n",
    "lib/.gitignore": "*.gen.py\n",
    "lib/x.gen.py": "def generated():\n    pass\n",
    "node_modules/a.js": "function no() {}\n",
    ".hidden/b.py": "def no():\n    pass\n",
    "notes.md": "\n".join(f"note {i}" for i in range(70)),
    "big.json": "x" * 2000,
    "data.csv": "1,2",
}


@pytest.fixture()
def place(tree, tmp_path):
    root = tree(TREE, "shop")
    settings = Settings(
        repos=(Repo("shop", root),), index_buckets=3, fresh_seconds=0.0, max_file_bytes=1500
    )
    return root, settings, str(tmp_path / "index")


def test_source_tree_sees_all_names_and_prunes(spark, place):
    root, settings, _ = place
    rows = source_tree.list_files(spark, settings.repos, ("lib",), partitions=3).collect()
    assert sorted(r.file_path for r in rows) == [
        "__init__.py", "auth.py", "big.json", "data.csv", "notes.md",
    ]
    assert {r.size for r in rows if r.file_path == "big.json"} == {2000}


def test_contents_drop_bad_bytes_and_missing_files(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = '\xff\xc3\xa9'\r\ny")
    frame = spark.createDataFrame(
        [("r", "a.py", str(tmp_path / "a.py")), ("r", "gone.py", str(tmp_path / "gone.py"))],
        "repo_id string, file_path string, abs_path string",
    )
    assert [r.content for r in source_tree.read_contents(frame).collect()] == ["x = 'é'\ny"]


def test_build_update_and_search(spark, place):
    root, settings, path = place
    first = index_build.build(spark, path, settings, MODEL, rebuild=True)
    index = index_build.Index(spark, path, settings)
    assert (first["status"], first["repos_rebuilt"]) == ("full_build", 1)
    tracked = {r.file_path for r in index.tracked.read().collect()}
    assert tracked == {"__init__.py", "auth.py", "lib/sign.py", "notes.md"}
    ids = {r.chunk_id for r in index.chunks.read().select("chunk_id").collect()}
    assert ids == {
        "shop::auth.py::AuthClient", "shop::auth.py::AuthClient.get_token", "shop::auth.py::AuthClient.check",
        "shop::lib/sign.py::sign", "shop::notes.md::block_0", "shop::notes.md::block_24", "shop::notes.md::block_48",
    }
    assert first["chunks_added"] == len(ids) == first["encoding"]["api_total_texts"]
    calls = {(r.source_id, r.target_id) for r in index.call_edges().where(F.col("kind") == "method_call").collect()}
    assert calls == {
        ("shop::auth.py::AuthClient.get_token", "shop::lib/sign.py::sign"),
        ("shop::auth.py::AuthClient.check", "shop::auth.py::AuthClient.get_token"),
    }
    assert index_build.build(spark, path, settings, MODEL)["status"] == "clean"

    # one file changed, one new, one gone
    with open(os.path.join(root, "lib/sign.py"), "w") as out:
        out.write("def sign(u):\n    return seal(u)\n\ndef seal(u):\n    return u\n")
    os.utime(os.path.join(root, "lib/sign.py"), (1000.0, 1000.0))
    os.remove(os.path.join(root, "notes.md"))
    with open(os.path.join(root, "new.go"), "w") as out:
        out.write("package x\n\nfunc Start() {\n  seal()\n}\n")
    second = index_build.build(spark, path, settings, MODEL)
    assert {k: second[k] for k in ("status", "files_added", "files_modified", "files_deleted", "chunks_added")} == {
        "status": "incremental", "files_added": 1, "files_modified": 1, "files_deleted": 1, "chunks_added": 3,
    }
    paths = {r.file_path for r in index.chunks.read().select("file_path").distinct().collect()}
    assert paths == {"auth.py", "lib/sign.py", "new.go"}
    calls = {(r.source_id, r.target_id) for r in index.call_edges().collect()}
    assert ("shop::lib/sign.py::sign", "shop::lib/sign.py::seal") in calls
    assert ("shop::auth.py::AuthClient.get_token", "shop::lib/sign.py::sign") in calls

    question = "def sign(u):\n    return seal(u)"
    debug = retrieval.retrieve_debug(
        spark, path, settings, MODEL, question, 3, ask=lambda system, user: "<ranked_indices>[0]</ranked_indices>"
    )
    assert debug.error is None
    assert debug.output.startswith(f"{root}/lib/sign.py#L1-2\n1: def sign(u):")
    assert set(debug.diagnostics.timing) == {"embedding_search", "graph_expansion", "merge_dedup", "rerank", "format"}
    assert re.search(r"callers \d+, callees \d+", debug.diagnostics.ranking.user_prompt) and f"{root}/lib/sign.py:1-2" in debug.diagnostics.ranking.user_prompt
    assert len(debug.diagnostics.blocks) <= 3
    plain = retrieval.retrieve(spark, path, settings, MODEL, question, 3)
    assert "#L" in plain and not plain.startswith("Error")

    with pytest.raises(index_build.ModelChanged):
        index_build.build(spark, path, settings, encoding.HashModel(32, "other"))
    with pytest.raises(ValueError, match="not part"):
        index_build.build(spark, path, settings, MODEL, repo="nope")
    os.remove(os.path.join(root, "new.go"))
    again = index_build.build(spark, path, settings, MODEL, rebuild=True, repo="shop")
    assert again["status"] == "full_build" and again["chunks_added"] == 5
    assert index.chunks.read().count() == 5
    assert {r.file_path for r in index.methods.read().collect()} == {"auth.py", "lib/sign.py"}

    copy = path + "-branch"
    os.makedirs(copy)
    os.rename(path, f"{copy}/branch=main")
    target = f"{copy}/branch=dev"
    assert index_build.seed_from_sibling(spark, copy, target, settings).endswith("branch=main")
    assert index_build.Index(spark, target, settings).chunks.read().count() == 5
    assert index_build.build(spark, target, settings, MODEL)["status"] == "clean"
    assert index_build.seed_from_sibling(spark, copy, target, settings) is None


def test_search_reads_texts_and_methods_from_the_buckets_of_its_hits(spark, place, monkeypatch):
    _, settings, path = place
    index_build.build(spark, path, settings, MODEL, rebuild=True)
    pruned, rows_of = {}, tables.Table.rows_of

    def recorded(table, keys):
        rows = rows_of(table, keys)
        pruned.setdefault(os.path.basename(table.path), []).append(rows._jdf.queryExecution().executedPlan().toString())
        return rows

    monkeypatch.setattr(tables.Table, "rows_of", recorded)
    settings = dataclasses.replace(settings, fresh_seconds=1e9)
    found = retrieval.retrieve_debug(spark, path, settings, MODEL, "get token", 3)
    monkeypatch.setattr(tables.Table, "rows_of", lambda table, keys: table.read().join(keys, keys.columns, "left_semi"))
    unpruned = retrieval.retrieve_debug(spark, path, settings, MODEL, "get token", 3)
    assert found.error is unpruned.error is None and found.output == unpruned.output != ""
    assert set(pruned) == {"chunks", "methods", "files"} and len(pruned["files"]) == 2
    for plans in pruned.values():
        assert all(re.search(r"PartitionFilters: \[[^\]]*bucket", plan) or "LocalTableScan" in plan for plan in plans)


def test_fresh_build_is_not_repeated(spark, place):
    _, settings, path = place
    index = index_build.Index(spark, path, settings)
    index.write_meta(last_build_at=time.time(), embedding_model=MODEL.name)
    lazy = Settings(**{**settings.__dict__, "fresh_seconds": 30.0})
    assert index_build.build(spark, path, lazy, MODEL, rebuild=True)["status"] == "already_built"


def test_table_replace_empties_buckets(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    table = tables.Table(spark, str(tmp_path / "t"), rows.schema, ["k"], 4)
    table.overwrite(rows)
    gone = spark.createDataFrame([("a",), ("b",)], "k string")
    table.replace(gone, spark.createDataFrame([("b", 9)], rows.schema))
    assert sorted(map(tuple, table.read().collect())) == [("b", 9), ("c", 3)]
    table.replace(spark.createDataFrame([("b",), ("c",)], "k string"), spark.createDataFrame([], rows.schema))
    assert table.read().count() == 0


def test_lock_is_exclusive_and_old_ones_expire(spark, tmp_path):
    path = str(tmp_path / "x.lock")
    with tables.IndexLock(spark, path):
        with pytest.raises(TimeoutError):
            with tables.IndexLock(spark, path, timeout=0.3, poll=0.05):
                pass
        with tables.IndexLock(spark, path, timeout=5, poll=0.05, expires=0.0):
            pass
    assert not os.path.exists(path)
    with tables.IndexLock(spark, path, renew=0.05):
        os.utime(path, (1000.0, 1000.0))
        time.sleep(0.5)
        assert time.time() - os.path.getmtime(path) < 60


def test_holder_leaves_a_lock_that_was_taken_over(spark, tmp_path):
    path = str(tmp_path / "x.lock")
    first, second = tables.IndexLock(spark, path), tables.IndexLock(spark, path, timeout=5, poll=0.05, expires=0.0)
    with first:
        time.sleep(0.05)
        second.__enter__()
    assert os.path.exists(path)
    second.__exit__()
    assert os.listdir(tmp_path) == []


def test_change_kinds(spark):
    schema = "file_path string, repo_id string, mtime double"
    before = spark.createDataFrame([("same", "r", 5.0), ("near", "r", 5.0), ("new time", "r", 5.0), ("gone", "r", 5.0), ("x", "q", 1.0)], schema)
    after = spark.createDataFrame([("same", "r", 5.0), ("near", "r", 5.0005), ("new time", "r", 5.1), ("fresh", "r", 1.0), ("x", "q", 1.0)], schema)
    found = {(r.repo_id, r.file_path): r.change_type for r in changes.file_changes(before, after).collect()}
    assert found == {("r", "new time"): "modified", ("r", "gone"): "deleted", ("r", "fresh"): "added"}
    assert [r.repo_id for r in changes.changed_repos(changes.file_changes(before, after)).collect()] == ["r"]


@pytest.mark.parametrize(
    "files, branch",
    [
        ({".git/HEAD": "ref: refs/heads/feature/x\n"}, "feature/x"),
        ({".git/HEAD": "0123456789abcdef\n"}, "detached-0123456"),
        ({".git": "gitdir: elsewhere\n", "elsewhere/HEAD": "ref: refs/heads/wt\n"}, "wt"),
        ({"a.py": ""}, "_no_git"),
    ],
)
def test_git_branch(tree, files, branch):
    assert workspace.git_branch(tree(files)) == branch


def test_agent_tool_builds_and_answers(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setenv("CODELOOM_HOME", str(tmp_path / "home"))
    monkeypatch.setenv("CODELOOM_EMBEDDING_DIM", "16")
    root = tree({"a.py": "def hello():\n    return 1\n"}, "proj")
    answer = cli.codebase_retrieval(spark, "def hello():\n    return 1", root)
    assert answer == f"{root}/a.py#L1-2\n1: def hello():\n2:     return 1"
    assert cli.codebase_retrieval(spark, "x", root + "/none").startswith("Error: workspace folder not found")


def test_stream_applies_late_and_repeated_versions(spark, tmp_path):
    from codeloom.streaming.change_feed import upsert_stream

    schema = "k string, version int, v string"
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "a1"), ("a", 3, "a3"), ("b", 1, "b1")], schema).write.parquet(source)
    table = tables.Table(spark, str(tmp_path / "t"), spark.read.parquet(source).schema, ["k"], 2)

    def drain():
        stream = spark.readStream.schema(table.schema).parquet(source)
        upsert_stream(stream, table, ["k"], ["version"], str(tmp_path / "cp")).awaitTermination()
        return sorted((r.k, r.v) for r in table.read().collect())

    assert drain() == [("a", "a3"), ("b", "b1")]
    spark.createDataFrame([("a", 2, "late"), ("b", 2, "b2"), ("c", 1, "c1")], schema).write.mode("append").parquet(source)
    assert drain() == [("a", "a3"), ("b", "b2"), ("c", "c1")]


def _write(root, files):
    for name, content in files.items():
        at = os.path.join(root, name)
        if content is None:
            os.remove(at)
            continue
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w") as out:
            out.write(content)
        _write.clock += 10
        os.utime(at, (_write.clock, _write.clock))


_write.clock = 2000.0


def test_incremental_edges_equal_those_of_a_full_build(spark, tree, tmp_path):
    shop = tree({"a.py": "import os\nos.getenv('PAY_URL')\nsb.functions.invoke('sync')\ndef f():\n    return g()\ndef g():\n    return 1\n"}, "shop")
    pay = tree({"b.py": "import requests\nrequests.get('http://shop:80/x')\n"}, "pay")
    late = tree({"c.py": "import redis\nredis.Redis('h')\n"}, "late")
    two = (Repo("shop", shop), Repo("pay", pay))
    three = (*two, Repo("late", late))
    steps = [
        (two, {f"{shop}/d.py": "from late import y\n"}),
        # shop itself stays as it is: its RPC call finds a target, its import finds a service
        (three, {f"{pay}/functions/sync/index.py": "from shop import x\n", f"{late}/sync/z.py": "x = 1\n"}),
        (three, {f"{pay}/functions/sync/index.py": None, f"{late}/sync/z.py": None}),
    ]

    def edges(path, settings):
        rows = index_build.Index(spark, path, settings).edges.read().collect()
        return {(r.repo_id, r.source_id, r.target_id, r.kind, tuple(sorted((r.metadata or {}).items()))) for r in rows}

    seen = []
    for number, (repos, files) in enumerate(steps):
        _write("/", files)
        settings = Settings(repos=repos, index_buckets=2, fresh_seconds=0.0)
        index_build.build(spark, str(tmp_path / "kept"), settings, MODEL, rebuild=number == 0)
        seen.append(edges(str(tmp_path / "kept"), settings))
        if number:
            index_build.build(spark, str(tmp_path / f"full-{number}"), settings, MODEL, rebuild=True)
            assert seen[-1] == edges(str(tmp_path / f"full-{number}"), settings)
    kinds = [{(a, c, d) for _, a, c, d, _ in step} for step in seen]
    assert not kinds[0] & {("shop", "late", "rpc_call"), ("shop", "late", "library_dependency")}
    assert kinds[1] >= {("shop", "late", "rpc_call"), ("shop", "late", "library_dependency"), ("pay", "shop", "library_dependency")}
    assert ("shop", "late", "library_dependency") in kinds[2] and not any(k == "rpc_call" for *_, k in kinds[2])
