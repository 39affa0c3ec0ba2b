"""URL filter: a rule list first, then naive Bayes over the words of host and path.

Host names run words together, so each host label is split by a unigram model: the split of highest
probability, found by Viterbi. Only a label's own substrings are looked up: distinct labels are cut into
them and joined to the word counts of the corpus, so neither the dictionary nor the hosts go to one task. A
substring outside the dictionary costs a tenth per letter, as unknown words do.

Naive Bayes is multinomial over the segmented host words and the path's tokens (digits become one
token), hashed into ``BUCKETS`` counts a class: a model of fixed size, which goes to every task. It is
trained on labels. Without a table of labelled pages, ``weak_labels`` takes pages whose host or
path has a word of ``UNWANTED`` for the class to block and all other pages for the class to allow; words that
keep such company are learned with them. Languages and registries, on which the rules decide,
teach nothing about a name: words of the rules' own hosts and paths are no tokens.

Pages meet their host's words by a join on the host. Hosts with more than a ``HOT``-th of all pages,
at most HOT of them, are joined by broadcast, all others by shuffle, so no host fills a task.

Defined results: a null url or one without "://" has an empty host and path, fits no rule and has the
verdict of the class that is more frequent; ties of the score allow; equal rules count once, of two
verdicts for one rule allow wins; repeated rows are judged each; an empty table gives no rows. Other columns are
left out. ``SUBSTRING`` bounds dictionary words, not labels: longer labels are split, whatever their length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import exploded
from codeloom.llm.base import Scratch, ascii_lower, query, table

#: Longest dictionary word; a part of its definition.
SUBSTRING = 20
BUCKETS = 1 << 18
HOT = 1000
#: Smoothing of the counts; little, as most names are rare.
ADDED = 0.1
#: Share of all words that a labelled word of the list below is taken to have.
LISTED_SHARE = 1e-5
#: Factor of an unknown part, and of each of its letters.
UNKNOWN, LETTER = 10.0, 0.1

# The rules of the query's contract, as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# Words in names of sites for gambling, drugs, sex, advertising and fraud.
UNWANTED = (
    "casino", "poker", "bet", "bets", "betting", "gambling", "jackpot", "slots", "lottery", "roulette",
    "pills", "pharmacy", "viagra", "cialis", "meds", "porn", "sex", "xxx", "adult", "escort", "ads", "adserver", "banner", "popup",
    "tracker", "spam", "phishing", "malware", "warez", "torrent", "crack", "loans", "payday",
)


def parts(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url) with host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"(?s)^[^?#]*", 0)
    return pages.select("page_id", ascii_lower(host).alias("host"), path.alias("path"))


def host_labels(host: Column, skipped: Sequence[str]) -> Column:
    """Parts of a host between dots and marks, without those that the rules name."""
    return F.filter(F.split(host, r"[^a-z0-9\u0080-\uffff]+"), lambda w: (w != "") & ~w.isin(list(skipped)))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the lower-case letter runs of all texts, none longer than SUBSTRING."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    found = exploded(docs, [], F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), "word")
    return found.where(F.char_length("word") <= SUBSTRING).groupBy("word").agg(F.count("*").alias("n"))


def split_label(label: str, known: dict[str, float], total: float) -> list[str]:
    """The most probable split of ``label``: of equal ones that with the longest last word."""
    best, back = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    # The best start of an unknown part costs the same per letter from anywhere on, so one is carried along.
    start, unknown = 0, math.log(UNKNOWN / total)
    letter = math.log(LETTER)
    for end in range(1, len(label) + 1):
        if best[end - 1] - (end - 1) * letter > best[start] - start * letter:
            start = end - 1
        best[end], back[end] = best[start] + unknown + (end - start) * letter, start
        for begin in range(max(0, end - SUBSTRING), end):
            p = known.get(label[begin:end])
            if p is not None and best[begin] + p > best[end]:
                best[end], back[end] = best[begin] + p, begin
    out, end = [], len(label)
    while end:
        out.append(label[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented(labels: DataFrame, counts: DataFrame, listed: Sequence[str] = UNWANTED) -> DataFrame:
    """(label, words) of distinct ``labels`` (label), split by ``counts`` (word, n) and the listed words."""
    total = float(max(counts.agg(F.sum("n")).first()[0] or 0, 1))
    share = F.greatest(F.lit(1.0), F.lit(LISTED_SHARE * total))
    extra = labels.sparkSession.createDataFrame([(w,) for w in listed], "word string").select("word", share.alias("n"))
    words = counts.select("word", F.col("n").cast("double").alias("n")).unionByName(extra).groupBy("word").agg(F.max("n").alias("n"))
    size = F.char_length("label")
    starts = exploded(labels.select("label", size.alias("size")), ["label", "size"], F.sequence(F.lit(1), F.col("size")), "begin")
    ends = F.sequence(F.lit(1), F.least(F.lit(SUBSTRING), F.col("size") - F.col("begin") + 1))
    each = exploded(starts, ["label"], F.transform(ends, lambda n: F.substring("label", F.col("begin"), n)), "word").distinct()
    known = each.join(words, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [{k["word"]: math.log(k["n"] / total) for k in row or ()} for row in batch.column("known").to_pylist()]
            words = [split_label(label, k, total) for label, k in zip(batch.column("label").to_pylist(), known)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(words, pa.list_(pa.string()))], ["label", "words"])

    return labels.join(known, "label", "left").mapInArrow(split, "label string, words array<string>")


def path_tokens(path: Column, skipped: Sequence[str]) -> Column:
    """Lower-case words of a path, numbers as one token, without the words that the rules name."""
    words = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(list(skipped)))
    return F.transform(words, lambda w: F.when(w.rlike("^[0-9]+$"), "0").otherwise(w))


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


@dataclass
class Bayes:
    """Log odds of block against allow, per bucket and of no token at all."""

    weights: np.ndarray
    prior: float

    @classmethod
    def of(cls, counts: np.ndarray, pages: np.ndarray) -> Bayes:
        """``counts``: BUCKETS rows of (allow, block); ``pages``: numbers of both.

        ADDED is added to the counts of every token that was seen; others weigh nothing.
        """
        seen = counts.any(1)
        share = (counts + ADDED) / np.maximum(counts.sum(0) + ADDED * seen.sum(), ADDED)
        weights = np.where(seen, np.log(share[:, 1]) - np.log(share[:, 0]), 0.0)
        return cls(weights, math.log((pages[1] + 1) / (pages[0] + 1)))


def train(tokens: DataFrame) -> Bayes:
    """The model of ``tokens`` (buckets, label, pages): rows with equal buckets come once with their number."""
    rows = exploded(tokens, ["label", "pages"], F.col("buckets"), "bucket").groupBy("bucket", "label").agg(F.sum("pages").alias("n"))
    counts, pages = np.zeros((BUCKETS, 2)), np.zeros(2)
    for row in rows.collect():
        counts[row["bucket"], row["label"]] = row["n"]
    for row in tokens.groupBy("label").agg(F.sum("pages").alias("n")).collect():
        pages[row["label"]] = row["n"]
    return Bayes.of(counts, pages)


def rule_table(rules: Sequence[tuple[str, str, str]]) -> dict[str, list[tuple[str, str]]]:
    """Per host its (path, verdict), longest path first."""
    out: dict[str, dict[str, str]] = {}
    for host, path, verdict in sorted(rules, key=lambda r: r[2], reverse=True):
        out.setdefault(host, {})[path] = verdict
    return {host: sorted(paths.items(), key=lambda p: (-len(p[0]), p[0])) for host, paths in out.items()}


def fitting_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule whose host is ``host`` or above it and whose path begins ``path``."""
    best = None
    at = 0
    while host:
        name = host[at:]
        for begin, verdict in rules.get(name, ()):
            if path.startswith(begin):
                if best is None or len(name) + len(begin) > len(best[0]):
                    best = name + begin, verdict
                break
        at = host.find(".", at) + 1
        if not at:
            break
    return best


def skipped_words(rules: Sequence[tuple[str, str, str]]) -> list[str]:
    return sorted({w for host, path, _ in rules for w in re.split(r"[^a-z0-9]+", f"{host}/{path}".lower()) if w})


def tokens_of(pages: DataFrame, docs: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, words, path_words) of every row of ``pages``, a settled table."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    skipped = skipped_words(rules)
    rows = scratch.settle("pages", parts(pages))
    hosts = scratch.settle("hosts", rows.groupBy("host").agg(F.count("*").alias("pages")))
    marked = hosts.select("host", F.posexplode(host_labels(F.col("host"), skipped)).alias("place", "label"))
    split = segmented(marked.select("label").distinct(), scratch.settle("counts", word_counts(docs)))
    named = marked.join(split, "label").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("w"))
    named = named.select("host", F.flatten(F.col("w.words")).alias("words"))
    named = scratch.settle("named", hosts.join(named, "host", "left").select("host", "pages", F.coalesce("words", F.array().cast("array<string>")).alias("words")))
    least = max(hosts.agg(F.sum("pages")).first()[0] or 0, 1) / HOT
    hot, rest = (named.where(c).select("host", "words") for c in (F.col("pages") > least, F.col("pages") <= least))
    joined = rows.join(F.broadcast(hot), "host").unionByName(rows.join(F.broadcast(hot.select("host")), "host", "left_anti").join(rest, "host"))
    return scratch.settle("tokens", joined.select("page_id", "host", "path", "words", path_tokens(F.col("path"), skipped).alias("path_words")))


def weak_labels(tokens: DataFrame, listed: Sequence[str] = UNWANTED) -> DataFrame:
    """``tokens`` with label: 1 if a word of host or path is listed."""
    return tokens.withColumn("label", F.arrays_overlap(F.concat("words", "path_words"), F.lit(list(listed))).cast("int"))


def _buckets() -> Column:
    return F.transform(F.concat("words", "path_words"), bucket)


def judge(tokens: DataFrame, model: Bayes, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``tokens``; score: log odds to block."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast((model, rule_table(rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rules = shared.value
        for batch in batches:
            buckets = batch.column("buckets")
            sizes = pa.compute.list_value_length(buckets).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(sizes)), sizes)
            score = model.prior + np.bincount(of, model.weights[buckets.flatten().to_numpy(zero_copy_only=False)], len(sizes))
            fits = [fitting_rule(h, p, rules) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            verdicts = [fit[1] if fit else "block" if s > 0 else "allow" for fit, s in zip(fits, score)]
            columns = [batch.column(c) for c in ("page_id", "host", "path")]
            told = [pa.array([f and f[0] for f in fits], pa.string()), pa.array(verdicts, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, *told], ["page_id", "host", "path", "rule", "verdict", "score"])

    kind = tokens.schema["page_id"].dataType.simpleString()
    rows = tokens.select("page_id", "host", "path", _buckets().alias("buckets"))
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def filter_urls(pages: DataFrame, docs: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages`` (page_id, url).

    docs (text): where word counts come from. labels (page_id, label 0 or 1): labelled pages; without them
    ``weak_labels`` labels every page.
    """
    tokens = tokens_of(pages, docs, rules)
    known = weak_labels(tokens) if labels is None else tokens.join(labels.select("page_id", "label"), "page_id")
    counted = known.select(F.sort_array(_buckets()).alias("buckets"), "label").groupBy("buckets", "label").agg(F.count("*").alias("pages"))
    return judge(tokens, train(counted), rules)


@query()
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
