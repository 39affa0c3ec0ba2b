"""Secret scan: candidate strings judged by a random forest, in DataFrame functions only.

A candidate is a run of at least ``MIN_LENGTH`` characters of ``[A-Za-z0-9_+/=-]`` with a digit or
a capital inside, or any value of at least ``SHORT_LENGTH`` characters that a name for a secret assigns.
Its features are its length, the shares of character kinds, the transitions
between kinds and the distinct characters; how much of its letters is covered by dictionary
words; whether it looks like a path; and whether the words before it name a secret or assign a value.

The forest is trained on labelled findings, a table of (feature columns, label). ``weak_labels``
makes one where nobody has labelled any: published key formats and values assigned to a name for secrets
are findings; paths, placeholders and values of dictionary words are false alarms under any name, as are all other
candidates. The two features that make a weak label are then left out, so the forest judges the value itself,
and ``SEEDS`` paths and as many placeholders made of dictionary words join the sample as false alarms. At most ``SAMPLE``
findings of each label are used, those of smallest hash; the dictionary is the ``DICTIONARY`` most frequent
lower-case words of all texts and the words of placeholders. Candidates are found in every whole text and
measured whole, whatever their length.

Defined results: null and blank texts have no candidate; repeated rows are scanned each; with
findings of one label only, every candidate gets that label's probability; an empty table gives
no rows. Other columns are left out.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import exploded
from codeloom.llm.base import Scratch, query, table

MIN_LENGTH = 16
SHORT_LENGTH = 8
SAMPLE = 5_000
SEEDS = 200
DICTIONARY = 1_000
TREES, DEPTH, SEED = 20, 6, 11

# Names that announce a secret, and formats that key issuers publish.
SECRET_NAMES = ("token", "password", "passwd", "pwd", "secret", "key", "apikey", "api_key", "auth", "bearer", "credential")
KEY_FORMATS = (r"^AKIA[0-9A-Z]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36,}$", r"^xox[abp]-[A-Za-z0-9-]{10,}$", r"^sk_live_[A-Za-z0-9]{16,}$")
PLACEHOLDER_WORDS = (
    "your", "here", "password", "secret", "token", "key", "example", "sample", "dummy", "change", "changeme", "placeholder",
    "insert", "replace", "test", "value", "none", "null", "todo",
)
_NAMES = "|".join(SECRET_NAMES)
_ASSIGNED = rf"(?i)(?:^|[^a-z])(?:{_NAMES})[\"']?\s*[=:]\s*[\"']?([^\s\"'<>;,()\[\]{{}}]{{{SHORT_LENGTH},}})"
FEATURES = (
    "length", "digit_share", "upper_share", "lower_share", "mark_share", "transition_share", "distinct_share",
    "dictionary_share", "path_like", "named_secret", "assigned",
)
VALUE_FEATURES = tuple(f for f in FEATURES if f not in ("named_secret", "assigned"))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, place, candidate, before): candidates of each text in order, and the words before them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    run = rf"[A-Za-z0-9_+/=-]{{{MIN_LENGTH},}}"
    rows = docs.where(text.rlike(run) | text.rlike(_ASSIGNED)).select("doc_id", text.alias("text"))
    split = rows.select("doc_id", F.split("text", r"[\x20\x09-\x0D]+").alias("w"))
    marked = F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    before = lambda i: F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1))
    # A value assigned by the words before it ends in its own word.
    given = lambda x: F.regexp_extract(F.concat_ws(" ", before(x["i"]), x["w"]), _ASSIGNED + r"[^\s]*$", 1)
    long_run = lambda x: x["w"].rlike(run) & x["w"].rlike("[0-9A-Z]")
    near = F.filter(marked, lambda x: long_run(x) | ((F.length(x["w"]) >= SHORT_LENGTH) & (given(x) != "")))
    told = F.transform(
        near,
        lambda x: F.struct(
            x["i"].alias("place"), x["w"].alias("word"), F.lower(before(x["i"])).alias("before"), given(x).alias("given")
        ),
    )
    each = exploded(split, ["doc_id"], told, "x").select("doc_id", "x.*")
    given_here = F.when(F.contains("word", "given"), F.col("given")).otherwise("")
    runs = F.filter(F.regexp_extract_all("word", F.lit(run), 0), lambda c: c.rlike("[0-9A-Z]"))
    apart = F.filter(runs, lambda c: ~F.contains(c, F.col("given")) & ~F.startswith(F.col("given"), c))
    parts = F.when(F.col("given") == "", runs).otherwise(F.concat(apart, F.array("given")))
    found = each.withColumn("given", given_here).withColumn("parts", parts)
    return exploded(found, ["doc_id", "place", "word", "before"], F.col("parts"), "candidate")


def measured(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """``found`` with the feature columns."""
    value = F.substring_index(F.regexp_replace("candidate", "^=+|=+$", ""), "=", -1)
    rows = found.withColumn("value", F.when(F.length(value) >= MIN_LENGTH, value).otherwise(F.col("candidate")))
    size = F.char_length("value")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / size
    turns = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[_+/=-])(?=[A-Za-z0-9])"
    letters = F.filter(F.split(F.lower("value"), "[^a-z]+"), lambda w: F.length(w) >= 3)
    known = F.lit([*dictionary, *PLACEHOLDER_WORDS])
    covered = F.aggregate(F.filter(letters, lambda w: F.array_contains(known, w)), F.lit(0), lambda n, w: n + F.length(w))
    head = F.lower(F.concat_ws(" ", "before", F.expr("substring(word, 1, greatest(instr(word, value) - 1, 0))")))
    return rows.select(
        *found.columns,
        "value",
        F.char_length("value").cast("double").alias("length"),
        share("[0-9]").alias("digit_share"),
        share("[A-Z]").alias("upper_share"),
        share("[a-z]").alias("lower_share"),
        share("[_+/=-]").alias("mark_share"),
        share(turns).alias("transition_share"),
        (F.size(F.array_distinct(F.split("value", ""))) / size).alias("distinct_share"),
        (covered / size).alias("dictionary_share"),
        (F.col("word").contains("/") | F.col("word").rlike(r"\.[a-z]{2,4}$|@")).cast("double").alias("path_like"),
        head.rlike(rf"(^|[^a-z])({_NAMES})([^a-z]|$)").cast("double").alias("named_secret"),
        head.rlike(r"[=:]\W*$").cast("double").alias("assigned"),
    )


def common_words(docs: DataFrame) -> list[str]:
    """The DICTIONARY most frequent lower-case words of all texts, equal counts by the word."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("w"))
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(DICTIONARY).collect()]


def false_alarm() -> Column:
    """Paths, placeholders, and values of letters and separators of which dictionary words cover more than half."""
    value = F.col("value")
    holder = value.rlike(r"(?i)^[$%]|x{4,}|\*{3,}|(^|[^a-z])(your|example|sample|dummy|placeholder|changeme|insert|replace)([^a-z]|$)")
    path = value.rlike(r"^(\.{0,2}|~|[A-Za-z]:)/[A-Za-z0-9_.-]+(/|$)|^[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)*\.[a-z]{2,4}$")
    wordy = value.rlike(r"^[A-Za-z_/-]+$") & (F.col("dictionary_share") > 0.5)
    return holder | path | wordy


def weak_labels(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label``: 1 for a published key format or a value assigned to a secret's name, unless a false alarm."""
    known = F.lit(False)
    for pattern in KEY_FORMATS:
        known = known | F.col("value").rlike(pattern)
    named = (F.col("named_secret") > 0) & (F.col("assigned") > 0) & ~false_alarm()
    return rows.withColumn("label", (known | named).cast("double"))


def seeds(spark: SparkSession, dictionary: list[str]) -> DataFrame:
    """Paths and placeholders of dictionary words as labelled false alarms, a secret's name assigning each."""
    pick = lambda words, salt: F.element_at(F.lit(words), (F.pmod(F.hash("id", F.lit(salt)), len(words)) + 1).cast("int"))
    plain = dictionary or list(PLACEHOLDER_WORDS)
    number = F.pmod(F.hash("id"), 10_000).cast("string")
    path = F.concat(
        F.lit("/"), F.concat_ws("/", pick(plain, 1), pick(plain, 2), F.initcap(pick(plain, 3)), pick(plain, 4)), number
    )
    holder = F.upper(F.concat_ws("_", *[pick(list(PLACEHOLDER_WORDS), salt) for salt in (5, 6, 7)], number))
    made = spark.range(2 * SEEDS).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("place"),
        F.when(F.col("id") < SEEDS, path).otherwise(holder).alias("candidate"), F.lit("key =").alias("before"),
    )
    return measured(made.withColumn("word", F.col("candidate")), dictionary).withColumn("label", F.lit(0.0))


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(doc_id, place, candidate, length, probability, secret); place: number of the word."""
    scratch = Scratch(docs.sparkSession, "secret-scan")
    dictionary = common_words(docs)
    rows = scratch.settle("candidates", measured(candidates(docs), dictionary))
    labelled = weak_labels(rows) if findings is None else findings
    used = VALUE_FEATURES if findings is None else FEATURES
    order = F.xxhash64("value", "place")
    kinds = [labelled.where(F.col("label") == kind).orderBy(order).limit(SAMPLE) for kind in (0.0, 1.0)]
    chosen = kinds[0].unionByName(kinds[1])
    if findings is None:
        chosen = chosen.unionByName(seeds(docs.sparkSession, dictionary), allowMissingColumns=True)
    sample = scratch.settle("sample", chosen)
    labels = {r["label"] for r in sample.select("label").distinct().collect()}
    if len(labels) < 2:
        return _told(rows.withColumn("probability", F.lit(labels.pop() if labels else 0.0)))
    vector = VectorAssembler(inputCols=list(used), outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    model = forest.fit(vector.transform(sample.repartition(1, "label").sortWithinPartitions(order)))
    judged = model.transform(vector.transform(rows))
    return _told(judged.withColumn("probability", vector_to_array(F.col("probability")).getItem(1)))


def _told(rows: DataFrame) -> DataFrame:
    length: Column = F.col("length").cast("long")
    return rows.select("doc_id", "place", F.col("value").alias("candidate"), length.alias("length"), "probability", (F.col("probability") >= 0.5).alias("secret"))


@query()
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
