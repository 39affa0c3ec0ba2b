import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.functions.keywords import keywords

TEXTS = ["", "\n", "a", "a\n", "a\n\n", "\n\na", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "a\n\n\nb\n"]


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(build(F.col("c")).alias("r")).head().r


def test_lines_match_splitlines(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for row in frame.select("t", tx.split_lines(F.col("t")).alias("lines")).collect():
        assert row.lines == row.t.splitlines()


@pytest.mark.parametrize("first, last, expected", [(1, 2, "a\nb"), (0, 1, "a"), (3, 9, "c"), (7, 9, "")])
def test_text_range_is_clamped(spark, first, last, expected):
    assert one(spark, "a\nb\nc\n", lambda c: tx.text_range(c, F.lit(first), F.lit(last))) == expected


@pytest.mark.parametrize(
    "code, expected",
    [
        ('x = "a # b" # c', 'x = "" '),
        ("x = 'it\\'s // fine' // gone", "x = '' "),
        ("a /* b\nc */ d", "a  d"),
        ("y = `t ${x}`;", "y = ``;"),
        ('\\"kept', '\\"kept'),
    ],
)
def test_blank_code(spark, code, expected):
    assert one(spark, code, tx.blank_code) == expected


def test_blank_code_survives_long_open_literal(spark):
    assert one(spark, '"' + "a" * 200_000, tx.blank_code).startswith('"aaa')


@pytest.mark.parametrize(
    "kind, text, name",
    [
        ("postgres", 'connect("dbname=shop user=u")', "shop"),
        ("postgres", "dbname='my db'", None),
        ("postgres", "dsn(database=\"x1\")", "x1"),
        ("sqlite", "sqlite3.connect('/var/data/o.db')", "o.db"),
        ("chromadb", "PersistentClient(path='x/vec')", "vec"),
        ("mongodb", "mongodb://h/shop?w=1", "shop"),
        ("redis", "redis.Redis()", None),
    ],
)
def test_database_names(spark, kind, text, name):
    assert one(spark, text, lambda c: tx.database_name(c, F.lit(kind))) == name


@pytest.mark.parametrize(
    "text, name",
    [
        ("QueueUrl = 'https://sqs/1/jobs'", "jobs"),
        ("send(queue_name='a/b/c')", "c"),
        ("queue='plain'", "plain"),
        ("https://sqs.eu-1.amazonaws.com/123/orders-q", "orders-q"),
        ("nothing", None),
    ],
)
def test_queue_names(spark, text, name):
    assert one(spark, text, tx.queue_name) == name


def test_direction_counts_in_its_window(spark):
    far = "connect()" + "x" * 2000 + " insert insert insert"
    assert one(spark, far, lambda c: tx.io_direction(c, F.lit(1))) == "read"
    assert one(spark, "connect() UPDATE t; .save()", lambda c: tx.io_direction(c, F.lit(1))) == "write"


@pytest.mark.parametrize(
    "path, base, stem, suffix",
    [("a/b.py", "b.py", "b", ".py"), ("x/.env", ".env", ".env", ""), ("m.tar.gz", "m.tar.gz", "m.tar", ".gz"), ("d/Makefile", "Makefile", "Makefile", "")],
)
def test_path_parts(spark, path, base, stem, suffix):
    parts = lambda c: F.array(tx.base_name(c), tx.stem(c), tx.suffix(c))
    assert one(spark, path, parts) == [base, stem, suffix]


def test_keywords_keep_order_and_first_spelling(spark):
    text = "How does the AuthClient get_token for authclient, a Token? " + " ".join(f"w{i}x" for i in range(30))
    words = one(spark, text, keywords)
    assert words[:3] == ["AuthClient", "get_token", "Token"]
    assert len(words) == 20


def test_elide_middle(spark):
    text = "\n".join(str(i) for i in range(120))
    lines = one(spark, text, tx.elide_middle).split("\n")
    assert len(lines) == 101 and lines[50] == "... (20 lines truncated) ..." and lines[-1] == "119"
    assert one(spark, "a\nb", tx.elide_middle) == "a\nb"
