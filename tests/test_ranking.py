import pytest

from codeloom.operators import encoding, formatting, ranking
from codeloom.settings import Settings, index_location, model_dimension, sanitize_path, settings_from_env
from codeloom.plans.retrieval import Diagnostics

BLOCK = (
    "rank int, score double, file_path string, start_line int, end_line int, chunk_type string, "
    "symbol string, content string, callers bigint, callees bigint, flow string"
)


@pytest.mark.parametrize(
    "answer, order, fallback",
    [
        ("<ranked_indices>[2, 0, 1]</ranked_indices>", [2, 0, 1], False),
        ("```json\n[1, 0]\n```", [1, 0], False),
        ("[2, 0]", [2, 0], False),
        ("[0, 99, 1]", [0, 1], False),
        ("[1, 1, 0]", [1, 0], False),
        ("not json", [0, 1, 2], True),
        ("[]", [0, 1, 2], True),
        ('{"a": 1}', [0, 1, 2], True),
    ],
)
def test_answers(answer, order, fallback):
    result = ranking.rank_entries("q", ["a", "b", "c"], lambda system, user: answer)
    assert (result.order, result.fallback) == (order, fallback)


def test_no_model_and_failing_model():
    assert ranking.rank_entries("q", ["a", "b"], None).user_prompt == ""

    def broken(system, user):
        raise RuntimeError("down")

    result = ranking.rank_entries("q", ["a", "b"], broken)
    assert (result.order, result.fallback) == ([0, 1], True)
    assert ranking.rank_entries("q", [], broken).order == []


def test_prompt_entries_and_reorder(spark):
    blocks = spark.createDataFrame(
        [
            (1, 0.914, "/r/a.py", 1, 2, "method", "f", "x\ny", 3, 1, "Login"),
            (2, 0.5, "/r/b.py", 5, 9, "block", None, "z", None, None, None),
        ],
        BLOCK,
    )
    entries = [r.entry for r in ranking.prompt_entries(blocks).orderBy("rank").collect()]
    assert entries[0] == "[0] /r/a.py:1-2 method f\nscore 0.91, callers 3, callees 1, flow Login\nx\ny\n"
    assert entries[1].startswith("[1] /r/b.py:5-9 block\nscore 0.50\n")
    moved = ranking.reorder(blocks, [1]).collect()
    assert [(r.rank, r.file_path) for r in moved] == [(1, "/r/b.py")]
    assert ranking.reorder(blocks, []).count() == 0


def test_expand_query():
    assert ranking.expand_query("q", None) == ["q"]
    assert ranking.expand_query("q", lambda s, u: "a\n\n b \nc\nd") == ["a", "b", "c"]
    assert ranking.expand_query("q", lambda s, u: " ") == ["q"]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "rank int, path string, start_line int, end_line int, content string")


def test_format_all_and_cut_lines(spark):
    frame = ranked(spark, [(1, "/r/a.py", 3, 4, "x\n" + "y" * 12), (2, "/r/b.py", 1, 1, "é")])
    out = formatting.format_results(formatting.render_blocks(frame, 80_000, 10)).head().output
    assert out == "/r/a.py#L3-4\n3: x\n4: " + "y" * 10 + " [truncated — use Read tool for full content]\n\n/r/b.py#L1-1\n1: é"


def test_format_stops_at_first_overflow(spark):
    rows = [(1, "/a", 1, 1, "aa"), (2, "/b", 1, 1, "b" * 100), (3, "/c", 1, 1, "c")]
    first = len("/a#L1-1\n1: aa")
    out = formatting.format_results(formatting.render_blocks(ranked(spark, rows), first + 2 + 50)).head().output
    assert out == (
        "/a#L1-1\n1: aa\n\n[Showing 1/3 results. Remaining (use Read tool):\n/b#L1-1\n/c#L1-1]"
    )
    none = formatting.format_results(formatting.render_blocks(ranked(spark, rows), 5)).head().output
    assert none.startswith("\n\n[Showing 0/3 results.")
    exact = formatting.render_blocks(ranked(spark, rows[:1]), first)
    assert "Showing" not in formatting.format_results(exact).head().output


def test_key_ring_rotates_and_waits():
    waits, seen = [], []

    def limited_twice(texts, kind, state={"left": 2}):
        seen.append("a")
        if state["left"]:
            state["left"] -= 1
            raise encoding.RateLimited
        return [[1.0]]

    def always_limited(texts, kind):
        seen.append("b")
        raise encoding.RateLimited

    ring = encoding.KeyRing([limited_twice, always_limited], 1, "m", waits.append)
    assert ring.encode(["x"]) == [[1.0]]
    assert seen == ["a", "b", "a", "b", "a"] and waits == [2.0, 4.0]
    with pytest.raises(ValueError):
        encoding.KeyRing([], 1, "m")


class Refused(Exception):
    def __init__(self, status, text=""):
        super().__init__(text)
        self.code = status


def test_key_ring_passes_over_bad_keys_and_gives_up():
    def refuse(status, text=""):
        def client(texts, kind):
            raise Refused(status, text)

        return client

    good = lambda texts, kind: [[2.0]]
    ring = encoding.KeyRing([refuse(401), refuse(400, "API key expired"), good], 1, "m", lambda s: None)
    assert ring.encode(["x"]) == [[2.0]]
    with pytest.raises(RuntimeError, match="no key works"):
        encoding.KeyRing([refuse(429), refuse(403, "no")], 1, "m", lambda s: None).encode(["x"])
    with pytest.raises(Refused):
        encoding.KeyRing([refuse(400, "bad request"), good], 1, "m", lambda s: None).encode(["x"])


def test_prompts_by_model():
    assert [encoding.takes_prompts(m) for m in ("gemini-embedding-001", "gemini-embedding-2", "voyage-code-3")] == [
        False, True, False,
    ]
    assert encoding.query_prompt("gemini-embedding-3", "q") == "task: code retrieval | query: q"
    assert encoding.query_prompt("hash", "q") == "q"


def test_transient_errors_are_retried():
    class Flaky:
        name, dimension, tries = "f", 1, 0

        def encode(self, texts, kind="document"):
            self.tries += 1
            if self.tries < 3:
                raise TimeoutError
            return [[0.0] for _ in texts]

    assert encoding.encode_with_retry(Flaky(), ["a"], lambda s: None) == ([[0.0]], 2)

    class Broken(Flaky):
        def encode(self, texts, kind="document"):
            raise ValueError("bad key")

    with pytest.raises(ValueError):
        encoding.encode_with_retry(Broken(), ["a"], lambda s: None)


def test_hash_model_is_deterministic():
    a, b = encoding.HashModel(8).encode(["x", "x"])
    assert a == b and sum(v * v for v in a) == pytest.approx(1.0)


def test_settings_defaults_and_environment():
    base = settings_from_env(env={})
    assert (base.top_k, base.chunk_size, base.chunk_overlap, base.expand_depth, base.expand_max_chunks) == (24, 32, 8, 2, 30)
    assert (base.rerank, base.embedding_model, base.max_file_bytes) == (True, "voyage-code-3", 1_048_576)
    changed = settings_from_env(env={"CODELOOM_RERANK": "No", "CODELOOM_SKIP_DIRS": "a, b,", "CODELOOM_TOP_K": "7"})
    assert (changed.rerank, changed.skip_dirs, changed.top_k) == (False, ("a", "b"), 7)
    assert [model_dimension(m) for m in ("voyage-4-lite", "gemini-x", "other")] == [1024, 768, 1024]
    assert Settings(dimension_override=5).dimension == 5


def test_index_location():
    assert sanitize_path("/home/u/my-app/") == "home-u-my-app"
    assert index_location("/b/", "/w/x", Settings(embedding_model="a/b"), "feat/1") == "/b/w-x/model=a_b/dim=1024/branch=feat_1"


def test_warnings():
    assert Diagnostics(skipped_files=2, skipped_methods=4).warning() is None
    both = Diagnostics(skipped_files=3, skipped_methods=5).warning()
    assert both == "3 files missing (index may be stale); 5 methods skipped"
