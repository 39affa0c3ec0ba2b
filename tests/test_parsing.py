import pytest

from pyspark.sql import functions as F

from codeloom.operators import calls, chunking, definitions

FILES = "repo_id string, file_path string, content string"

SCRIPTS = {
    "p.cs": (
        "public class PaymentProcessor\n{\n    public bool ProcessPayment(string id)\n    {\n"
        "        return Validate(id);\n    }\n    private bool Validate(string id)\n    {\n        return true;\n    }\n}\n",
        {("ProcessPayment", 3, 6), ("Validate", 7, 10)},
    ),
    "h.rs": (
        "pub fn process(req: &R) -> X {\n    a()\n}\n\npub async fn build(u: U) -> X {\n    X::ok(u)\n}\nfn test_it() {\n}\n",
        {("process", 1, 3), ("build", 5, 7)},
    ),
    "auth.rb": (
        "class A\n  def authenticate(u)\n    if u\n      go(u)\n    end\n  end\n\n  def self.timeout\n    30\n  end\nend\n",
        {("authenticate", 2, 6), ("timeout", 8, 10)},
    ),
    "x.ts": (
        "export class S extends B {\n  async load(id: string): Promise<X> {\n    if (id) {\n      return '}' // }\n    }\n  }\n}\n"
        "export default function(a) {\n}\nexport const f = async (a) => {\n  return a\n}\nfunction test_q() {\n}\nconst g = (a: number): number => a;\n",
        {("S.load", 2, 6), ("x", 8, 9), ("f", 10, 12), ("g", 15, 15)},
    ),
    "m.go": (
        "func (s *Srv) Login(w http.W) {\n\tvalidate(w)\n}\nfunc validate(w int)\n{\n  x()\n}\nfunc mockIt() {\n}\n",
        {("Login", 1, 3), ("validate", 4, 7)},
    ),
    "J.java": (
        "public class J {\n  public void run(int a) {\n    foo(a);\n  }\n  private static List<String> names(String b)\n  {\n    return null;\n  }\n}\n",
        {("run", 2, 4), ("names", 5, 8)},
    ),
    "e.php": ("<?php\nclass E {\n  public function run($a) {\n    return 1;\n  }\n  function testFoo() { }\n}\n", {("run", 3, 5)}),
    "w.cpp": (
        "class W {\n public:\n  int size() const {\n    return helper(1); // call(3)\n  }\n};\nint Foo::bar(int a)\n{\n  if (a) { size(); }\n  return helper(a);\n}\n"
        "template <typename T> T helper(T x) {\n  return x;\n}\n",
        {("W.size", 3, 5), ("Foo.bar", 7, 11), ("W.helper", 12, 14)},
    ),
    "open.go": ("func Never(a int) {\n  x()\n", {("Never", 1, 1)}),
}


@pytest.fixture(scope="module")
def scripted(spark):
    rows = [("svc", path, text) for path, (text, _) in SCRIPTS.items()]
    methods, sites = definitions.extract_methods(spark.createDataFrame(rows, FILES))
    return methods.collect(), sites.collect(), methods, sites


@pytest.mark.parametrize("path", SCRIPTS)
def test_methods_and_bodies(scripted, path):
    found = {(m.full_name, m.line_start, m.line_end) for m in scripted[0] if m.file_path == path}
    assert found == SCRIPTS[path][1]


def test_cpp_calls_resolve(scripted):
    sites = {(s.caller_id.split("::", 2)[2], s.callee_name, s.line) for s in scripted[1]}
    assert ("W.size", "helper", 4) in sites and ("Foo.bar", "size", 9) in sites
    assert not any(name in ("if", "call") for _, name, _ in sites)
    edges = {(r.source_id, r.target_id) for r in calls.resolve_calls(scripted[3], scripted[2]).collect()}
    assert ("svc::w.cpp::Foo.bar", "svc::w.cpp::W.helper") in edges
    assert all(a != b for a, b in edges)


CALLING = {
    "a.ts": (
        "import { z } from 'q'\nexport function outer(a) {\n  const inner = (b) => {\n    return deep(b) + inner.size()\n  }\n"
        "  // gone(1)\n  return new Box<string>(a).open?.(inner(a), 'text(2)')\n}\nfree(1)\nfunction test_a() {\n  lost()\n}\n",
        {("inner", "deep", 4), ("inner", "size", 4), ("outer", "Box", 7), ("outer", "open", 7), ("outer", "inner", 7)},
    ),
    "b.go": (
        "func (s *S) Run(a int) {\n\tgo func() {\n\t\ts.store.Put(Key[int](a))\n\t}()\n\tif ok(a) { }\n}\n",
        {("Run", "Put", 3), ("Run", "Key", 3), ("Run", "ok", 5)},
    ),
    "C.java": (
        "class C {\n  public int run(int a) {\n    @Named(\"x\") List<A> b = new ArrayList<>(a);\n    /* no(1) */ b.add(fill(a));\n"
        "     * stale(2)\n    synchronized (b) { }\n    return b.size();\n  }\n}\n",
        {("run", "ArrayList", 3), ("run", "add", 4), ("run", "fill", 4), ("run", "size", 7)},
    ),
    "d.cs": (
        "class D\n{\n  public int Run(int a)\n  {\n    lock (x) { }\n    return Find<int>(a, '(');\n  }\n}\n",
        {("Run", "Find", 6)},
    ),
    "e.rs": (
        "pub fn run<'a>(x: &'a str) -> X {\n}\npub fn go(x: &'static str, y: &'static str) -> X {\n    log!(\"f(1)\");\n"
        "    X::of(x).iter().map(f).collect::<Vec<_>>()\n}\n",
        {("go", "log", 4), ("go", "X::of", 5), ("go", "iter", 5), ("go", "map", 5), ("go", "collect", 5)},
    ),
    "f.rb": (
        "class F\n  def run(u)\n    check u\n    save(u) if u.valid? # note(1)\n    x = 5\n    return u\n  end\nend\n",
        {("run", "check", 3), ("run", "save", 4), ("run", "valid?", 4)},
    ),
    "g.php": (
        "<?php\nclass G {\n  public function run($a) {\n    if (is_ok($a)) { }\n    return $this->load(Store::make($a), new Box('b(1)'));\n  }\n}\n",
        {("run", "is_ok", 4), ("run", "load", 5), ("run", "make", 5), ("run", "Box", 5)},
    ),
}


@pytest.fixture(scope="module")
def calling(spark):
    files = spark.createDataFrame([("svc", path, text) for path, (text, _) in CALLING.items()], FILES)
    return files, definitions.extract_methods(files)[1].collect()


@pytest.mark.parametrize("path", CALLING)
def test_script_calls_belong_to_the_innermost_method(calling, path):
    sites = {(s.caller_id.split("::", 2)[2], s.callee_name, s.line) for s in calling[1] if s.file_path == path}
    assert sites == CALLING[path][1]


def test_builtin_names_are_no_calls(spark, calling):
    builtins = spark.createDataFrame([("java", "add"), ("go", "size")], "parser string, callee_name string")
    sites = definitions.extract_methods(calling[0], builtins=builtins)[1].collect()
    assert {(s.file_path, s.callee_name) for s in calling[1]} - {(s.file_path, s.callee_name) for s in sites} == {("C.java", "add")}


def test_script_calls_of_empty_and_very_long_lines(spark):
    rows = [("s", "a.go", ""), ("s", "b.go", None), ("s", "c.js", "function a() {\n" + "'" * 99_999 + "f(" * 100_000 + "\n}\n")]
    files = spark.createDataFrame(rows, FILES)
    assert [(s.callee_name, s.line) for s in definitions.extract_methods(files)[1].collect()] == [("f", 2)]
    assert definitions.extract_methods(files.where("false"))[1].collect() == []


def test_long_body_is_given_up(spark):
    rows = [("s", "a.go", "func A() {\n" + "x\n" * 499 + "}\n"), ("s", "b.go", "func B() {\n" + "x\n" * 498 + "}\n")]
    methods, _ = definitions.extract_methods(spark.createDataFrame(rows, FILES))
    assert sorted((m.name, m.line_end) for m in methods.collect()) == [("A", 1), ("B", 500)]
    methods, _ = definitions.extract_methods(spark.createDataFrame(rows, FILES), body_limit=None)
    assert sorted((m.name, m.line_end) for m in methods.collect()) == [("A", 501), ("B", 500)]


PYTHON = '''import x

class A:
    """doc"""
    async def m(self, token):
        """Check it."""
        def inner():
            return deep()
        return check(token).strip()

    def test_skip(self):
        hidden()

def f(a, b=1):
    return A().m(a)
'''


def test_python_methods_and_calls(spark):
    methods, sites = definitions.extract_methods(spark.createDataFrame([("svc", "pkg/a.py", PYTHON)], FILES))
    rows = {m.full_name: m for m in methods.collect()}
    assert set(rows) == {"A.m", "A.inner", "f"}
    assert (rows["A.m"].signature, rows["A.m"].docstring, rows["A.m"].line_start, rows["A.m"].line_end) == (
        "def m(self, token)", "Check it.", 5, 9)
    assert rows["f"].method_id == "svc::pkg/a.py::f" and rows["f"].legacy_id == "svc::a.py::f"
    found = {(s.caller_id.rsplit("::", 1)[1], s.callee_name) for s in sites.collect()}
    assert found == {("A.inner", "deep"), ("A.m", "check"), ("A.m", "strip"), ("f", "A"), ("f", "m")}


def test_redefined_method_keeps_the_last(spark):
    text = "def f():\n    return 1\n\ndef f(a):\n    return 2\n"
    methods, _ = definitions.extract_methods(spark.createDataFrame([("svc", "a.py", text)], FILES))
    assert [(m.signature, m.line_start) for m in methods.collect()] == [("def f(a)", 4)]


def chunks_of(spark, path, language, text, size=32, overlap=8):
    frame = spark.createDataFrame([("r", path, language, text)], "repo_id string, file_path string, language string, content string")
    rows = chunking.extract_chunks(frame, size, overlap).collect()
    return [(c.chunk_id, c.chunk_type, c.start_line, c.end_line) for c in rows]


def test_python_chunks(spark):
    assert chunks_of(spark, "a.py", "python", PYTHON) == [
        ("r::a.py::A", "class", 3, 12), ("r::a.py::A.m", "method", 5, 9),
        ("r::a.py::A.test_skip", "method", 11, 12), ("r::a.py::f", "function", 14, 15),
    ]


@pytest.mark.parametrize("text", ["x = 1\ny = 2\n", "def (:\n  pass\n"])
def test_python_without_definitions_is_cut_by_lines(spark, text):
    assert chunks_of(spark, "a.py", "python", text) == [("r::a.py::block_0", "block", 1, 2)]


def test_window_chunks(spark):
    text = "\n".join(f"line {i}" for i in range(50))
    assert [c[2:] for c in chunks_of(spark, "a.md", "markdown", text)] == [(1, 32), (25, 50), (49, 50)]
    assert chunks_of(spark, "e.md", "markdown", "") == []
    assert [c[2:] for c in chunks_of(spark, "b.md", "markdown", "\n \n\t\n\nx\n", 2, 0)] == [(5, 5)]
    assert len(chunks_of(spark, "o.md", "markdown", "a\nb\nc", 2, 5)) == 3


def test_a_grammar_replaces_line_matching(spark):
    def grammar(parser, source):
        method = {"name": parser, "full_name": parser, "class_name": None, "signature": source,
                  "docstring": None, "line_start": 1, "line_end": 2}
        return {"methods": [method], "calls": [{"caller": parser, "callee_name": "x", "line": 1}]}

    files = spark.createDataFrame([("s", "a.go", "func Z() {\n}\n"), ("s", "b.py", "def f():\n    g()\n")], FILES)
    methods, sites = definitions.extract_methods(files, grammar, ["go"])
    assert sorted(m.full_name for m in methods.collect()) == ["f", "go"]
    assert sorted(c.callee_name for c in sites.collect()) == ["g", "x"]


def test_long_blank_lines_do_not_overflow(spark):
    blank = "x" + " " * 100_000 + "y"
    frame = spark.createDataFrame([("r", lang, f"/a.{lang}", blank) for lang in ("java", "csharp")], "repo_id string, language string, file_path string, content string")
    for pattern in (head[1] for head in definitions.HEADS if {"java", "csharp"} & set(head[0])):
        assert frame.where(F.col("content").rlike(pattern)).count() == 0


def test_bodies_are_matched_within_their_files(spark):
    rows = [("s", "a.go", "func A() {\n}\n"), ("s", "a.go", "func A() {\n}\n"), (None, "b.go", "func B()\n{\n  if x { }\n}\n"), ("s", "c.go", None)]
    files = definitions.with_parser(spark.createDataFrame(rows, FILES))
    found = definitions.scripted_methods(files)
    assert sorted((m.name, m.line_start, m.line_end) for m in found.collect()) == [("A", 1, 2), ("A", 1, 2), ("B", 1, 4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_sites_meet_methods_file_by_file(spark):
    text = "func A() {\n  B(1)\n  f := func() { C() }\n}\nfunc B() { A(); B() }\nD()\n"
    files = definitions.with_parser(spark.createDataFrame([("s", "a.go", text), ("s", "a.go", text), (None, "a.go", text)], FILES))
    spans = [("s", "a.go", "outer", 1, 4, "A"), ("s", "a.go", "inner", 3, 3, "f"), ("s", "a.go", "b", 5, 5, "B"), ("s", "z.go", "z", 1, 9, "z")]
    methods = spark.createDataFrame(spans, "service_id string, file_path string, method_id string, line_start int, line_end int, name string")
    found = definitions.script_calls(files, methods)
    # The head's own name isn't a call, copies count once, a null key meets nothing.
    assert sorted((s.caller_id, s.callee_name, s.line) for s in found.collect()) == [("b", "A", 5), ("inner", "C", 3), ("outer", "B", 2)]
    assert "_bin" not in found._jdf.queryExecution().optimizedPlan().toString()
