"""Toxicity by misspelling-tolerant lexicon matches, weighed by their surroundings.

1. The lexicon is learned from labelled training rows: words, and stems that open many toxic words,
   that occur in toxic texts far more often than in others, each weighted by its log-odds. A stem
   counts without its most toxic word; a strong word is a term of its own also below a stem.
2. Terms form a trie. The Levenshtein automaton of a word (one edit: replaced, extra, missing or
   swapped letters) is run together with the trie; the pairs of both are turned into a
   deterministic automaton state by state as words need them, so a usual word fails after a few
   letters. Stems match letter by letter. Words of clean sample rows that are only an edit away
   from a term do not match. Look-alike characters are read as letters; punctuation at the ends of
   a word does not count.
3. A match counts by the words around it: quotation marks and words of report lower it, direct
   address raises it.
4. A logistic regression over a document's sums gives the score.

Labels are read for training rows only. At most ``SAMPLE`` labelled rows of each class, those of
smallest hash, are used; the lexicon holds at most ``LEXICON`` terms, the strongest, and at most
``NEAR_WORDS`` clean words are known as near to a term, the most frequent. Scoring is one pass without
a shuffle over every whole text.

Defined results: a null or blank text has no match and gets the score of a text without any;
without labels of both classes every score is the share of toxic labels, 0 without labels;
repeated rows are scored each; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.base import Scratch, query, table

SAMPLE = 10_000
LEXICON, NEAR_WORDS = 2_000, 50_000
#: A term stands in this many toxic sample rows at least, and its log-odds are at least these.
MIN_ROWS, MIN_ODDS = 4, 3.0
STEM_LETTERS, STEM_WORDS = range(4, 9), 5
#: Shorter terms must match letter by letter.
EDIT_LETTERS = 4
WINDOW = 6
MEMO_WORDS = 300_000

# Marks of quotation, of report and of direct address.
QUOTES = "\"'«»“”„‘’`"
REPORT = (
    "said", "says", "wrote", "writes", "quote", "quoted", "called", "word", "term", "dit", "mot", "sagte", "wort", "dijo", "palabra",
)
ADDRESS = ("you", "your", "you're", "u", "du", "dich", "ihr", "tu", "toi", "vous", "tú", "eres", "usted")
LOOK_ALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EDGES = ".,;:!?()[]{}<>*_~-" + QUOTES


def bare(word: str) -> str:
    """A word without punctuation and symbols at its ends."""
    if word.isalnum():
        return word
    first, last = 0, len(word)
    while first < last and unicodedata.category(word[first])[0] in "PSCZ":
        first += 1
    while first < last and unicodedata.category(word[last - 1])[0] in "PSCZ":
        last -= 1
    return word[first:last]


class Matcher:
    """Terms as a trie; ``match`` gives (term number, edits) of the best term for a word, or None."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.word_end: dict[int, int] = {}
        self.stem_end: dict[int, int] = {}
        for number, (term, stem) in enumerate(terms):
            node = 0
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                node = self.children[node][letter]
            (self.stem_end if stem else self.word_end)[node] = number
        self.edits_allowed = [int(len(term) >= EDIT_LETTERS and not stem) for term, stem in terms]
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self._state({(0, 0, "")})

    def _state(self, places: set) -> int:
        """Number of a set of (node, edits, letter still owed by a swap), closed under missing letters."""
        whole = set(places)
        for node, edits, owed in places:
            if not edits and not owed:
                whole.update((child, 1, "") for child in self.children[node].values())
        exact = {node for node, edits, owed in whole if not edits}
        key = frozenset(p for p in whole if not p[1] or p[2] or p[0] not in exact)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        after = set()
        for node, edits, owed in self.sets[state]:
            below = self.children[node]
            if owed:
                if owed == letter:
                    after.add((node, edits, ""))
                continue
            if letter in below:
                after.add((below[letter], edits, ""))
            if not edits:
                after.add((node, 1, ""))
                for first, child in below.items():
                    after.add((child, 1, ""))
                    if letter in self.children[child]:
                        after.add((self.children[child][letter], 1, first))
        return self._state(after) if after else -1

    def match(self, word: str) -> tuple[int, int] | None:
        state, best = self.start, None
        for letter in word:
            key = (state, letter)
            if key not in self.steps:
                if len(self.steps) > 500_000:
                    self.states, self.sets, self.steps = {}, [], {}
                    return self.match_fresh(word)
                self.steps[key] = self._step(state, letter)
            state = self.steps[key]
            if state < 0:
                return best
            if self.stem_end:
                for node, edits, owed in self.sets[state]:
                    if not edits and not owed and node in self.stem_end:
                        best = (self.stem_end[node], 0)
        ends = [
            (edits, self.word_end[node])
            for node, edits, owed in self.sets[state]
            if not owed and node in self.word_end and edits <= self.edits_allowed[self.word_end[node]]
        ]
        if ends:
            edits, number = min(ends)
            return (number, edits) if best is None or not edits else best
        return best

    def match_fresh(self, word: str) -> tuple[int, int] | None:
        self.start = self._state({(0, 0, "")})
        return self.match(word)


def _word_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic rows, clean rows) of a task's rows."""
    seen: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        words = list(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([seen[w][1] for w in words], pa.int64()), pa.array([seen[w][0] for w in words], pa.int64())],
            ["word", "toxic", "clean"],
        )

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for word in {bare(w) for w in set((text or "").lower().split())}:
                if 2 < len(word) <= 40:
                    seen.setdefault(word, [0, 0])[toxic] += 1
        if len(seen) > MEMO_WORDS:
            yield flush()
            seen.clear()
    yield flush()


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> list[tuple[str, bool, float]]:
    """(term, is a stem, weight) from sample rows (text, toxic); at most LEXICON terms reach the driver."""
    counted = sample.select("text", "toxic").mapInArrow(_word_classes, "word string, toxic long, clean long")
    words = counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    stems = (
        words.select("toxic", "clean", F.explode(F.array(*(F.when(F.char_length("word") >= n, F.substring("word", 1, n)) for n in STEM_LETTERS))).alias("word"))
        .where(F.col("word").isNotNull())
        .groupBy("word")
        .agg(
            F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count(F.when(odds > 0, 1)).alias("words"),
            F.max(F.struct("toxic", (-F.col("clean")).alias("less"))).alias("top"),
        )
        .where(F.col("words") >= STEM_WORDS)
        .select("word", (F.col("toxic") - F.col("top.toxic")).alias("toxic"), (F.col("clean") + F.col("top.less")).alias("clean"))
    )

    def best(rows: DataFrame) -> list:
        strong = rows.withColumn("odds", odds).where((F.col("toxic") >= MIN_ROWS) & (F.col("odds") >= MIN_ODDS))
        return strong.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "word").limit(LEXICON).collect()

    support = {r["word"]: r for r in best(stems)}
    longer = Counter()
    for stem, row in support.items():
        longer[stem[:-1]] = max(longer[stem[:-1]], row["toxic"])
    kept: list[str] = []
    for stem in sorted(support, key=len):
        branches = longer[stem] < 0.9 * support[stem]["toxic"]
        if branches and not any(stem.startswith(k) for k in kept):
            kept.append(stem)
    found = [(row, False) for row in best(words)] + [(support[stem], True) for stem in kept]
    found.sort(key=lambda f: (-f[0]["odds"] * math.sqrt(f[0]["toxic"]), f[0]["word"], f[1]))
    return [(row["word"], stem, row["odds"]) for row, stem in found[:LEXICON]]


def features(text: str, memo: dict, weights: list[float]) -> list[float]:
    """Sums of a text's matches: exact, misspelled, spoken of; and matches per hundred words."""
    words = text.lower().split()
    exact = edited = quoted = hits = 0.0
    matches = [(at, found) for at, found in enumerate(map(memo.__getitem__, words)) if found]
    for at, found in matches:
        word = words[at]
        around = words[max(at - WINDOW, 0) : at + WINDOW + 1]
        report = word[0] in QUOTES and word[-1] in QUOTES + EDGES and len(word) > 1 or any(w in REPORT for w in map(bare, around))
        value = weights[found[0]] * (1.25 if any(w in ADDRESS for w in around) else 1.0)
        hits += 1
        if report:
            quoted += value
        elif found[1]:
            edited += value
        else:
            exact += value
    return [math.log1p(exact), math.log1p(edited), math.log1p(quoted), 100 * hits / max(len(words), 1)]


class _Memo(dict):
    def __init__(self, terms: list[tuple[str, bool, float]], harmless: frozenset[str]):
        super().__init__()
        self.matcher, self.harmless = Matcher([(t, s) for t, s, _ in terms]), harmless

    def __missing__(self, word: str):
        if len(self) >= MEMO_WORDS:
            self.clear()
        plain = bare(word)[:60]
        found = self.matcher.match(plain)
        if found is None and not word.isalpha():
            read = (w.translate(LOOK_ALIKES) for w in dict.fromkeys((plain, word.strip(EDGES)[:60])) if not w.isalpha())
            found = next(filter(None, map(self.matcher.match, read)), None)
            found = found and (found[0], 1)
        if found and found[1] and plain in self.harmless:
            found = None
        self[word] = found
        return found


class Toxicity:
    """What was learned: terms, words that only look like terms, and the regression."""

    def __init__(self, terms, harmless=frozenset(), beta=(0.0, 0.0, 0.0, 0.0, 0.0)):
        self.terms, self.harmless, self.beta = terms, frozenset(harmless), np.asarray(beta, float)

    def measured(self, rows: DataFrame, keep: str) -> DataFrame:
        """Column ``keep`` of ``rows``, the four feature sums and the score."""
        terms, harmless, beta = self.terms, self.harmless, self.beta
        weights = [w for _, _, w in terms]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = _Memo(terms, harmless)
            for batch in batches:
                x = np.array([features(t.as_py() or "", memo, weights) for t in batch.column("text")], float).reshape(-1, 4)
                z = np.clip(beta[0] + x @ beta[1:], -30, 30)
                columns = [batch.column(keep), *(pa.array(c, pa.float64()) for c in (*x.T, 1 / (1 + np.exp(-z))))]
                yield pa.RecordBatch.from_arrays(columns, [keep, "exact", "edited", "quoted", "density", "score"])

        kind = rows.schema[keep].dataType.simpleString()
        return rows.select(keep, "text").mapInArrow(run, f"{keep} {kind}, exact double, edited double, quoted double, density double, score double")


def fit(x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression with a small ridge by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        beta = beta - np.linalg.solve(hessian, gradient)
    return beta


def train(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """Learn from rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) covers.

    Repeated labels of an id count as toxic if one of them does.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = None
    for toxic in (0, 1):
        part = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = scratch.settle("chosen", chosen)
    sample = scratch.settle("sample", docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"))
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_clean, n_toxic = counts.get(0, 0), counts.get(1, 0)
    if not n_clean or not n_toxic:
        share = min(max(n_toxic / max(n_clean + n_toxic, 1), 1e-9), 1 - 1e-9)
        return Toxicity([], beta=(math.log(share / (1 - share)), 0, 0, 0, 0))
    terms = learn_lexicon(sample, n_toxic, n_clean)
    harmless = _near_words(sample.where(F.col("toxic") == 0), terms)
    model = Toxicity(terms, harmless)
    spread = sample.repartition(docs.sparkSession.sparkContext.defaultParallelism)
    rows = model.measured(spread.withColumn("label", F.col("toxic")), "label").drop("score").collect()
    x = np.array([r[1:] for r in rows], float)
    y = np.array([r[0] for r in rows], float)
    return Toxicity(terms, harmless, fit(x, y))


def _near_words(clean: DataFrame, terms: list[tuple[str, bool, float]]) -> list[str]:
    """Words of clean sample rows that match a term only with an edit; the most frequent NEAR_WORDS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, near = _Memo(terms, frozenset()), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                near.update(bare(w) for w in set((text or "").lower().split()) if (f := memo[w]) and f[1])
        yield pa.RecordBatch.from_arrays([pa.array(list(near), pa.string()), pa.array(list(near.values()), pa.int64())], ["word", "n"])

    found = clean.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in found.orderBy(F.desc("n"), "word").limit(NEAR_WORDS).collect()]


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~hidden), table(spark, sf_dir, "labels").where(~hidden))
    scored = model.measured(docs, "doc_id")
    return scored.select("doc_id", hidden.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
