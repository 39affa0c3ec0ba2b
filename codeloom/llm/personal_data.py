"""Personal data by patterns and a skip-chain conditional random field.

The patterns (email, ip, card, phone) decide the base spans, by linear scans over the whole text.
The field adds what they miss. Its nodes are the words with a digit or an at sign, all other
words are fixed to "no entity"; a node's label is one of the four kinds or none.

* Node potentials: log-linear in the shape of the word and its neighbours.
* Chain potentials: between words next to each other, as the parts of a phone number are.
* Skip potentials: between a word and the next one in the document with equal letters and digits,
  or the same long run of digits, however far away; each word has one such edge per
  key, so edges grow with words, not with pairs.

Loopy belief propagation passes messages over all edges of a batch of documents at once, for a
fixed number of rounds with damping. A node whose belief in a kind passes ``BELIEF`` and that
touches no base span becomes a span; adjoining nodes of one kind are one span.

The weights are the maximum pseudo-likelihood on base spans of at most ``SAMPLE`` documents with
nodes, those of smallest text hash. In training the tell-tale signs (at sign, leading plus) of
half of the words are hidden, so that the shapes and neighbours carry weight.

Defined results: a null text is empty and has no span; repeated rows are searched each; without
training spans nothing is added; an empty table gives no rows. ``redact`` keeps all columns of
its input; other functions leave them out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.base import Scratch, query, table

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 4_000
ROUNDS, DAMPING, BELIEF = 12, 0.3, 0.9
FIT_STEPS, RIDGE = 300, 1e-3
#: Texts of a batch that one message passing takes together, in characters.
PIECE_CHARS = 4_000_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+")
_SIGN = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EDGE = ".,;:!?\"'()[]{}<>"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        end = at
        if begin < at and (domain := _DOMAIN.match(text, at + 1)):
            end = free = domain.end()
            yield begin, end
        at = text.find("@", max(end, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else sum(divmod(2 * digit, 10))
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for run in _DIGITS.finditer(text):
        if run.end() - run.start() >= 13:
            digits = run.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield run.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        end = at + 1
        if run := _PHONE.match(text, at):
            whole = run.group().rstrip(" ().-")
            if len(whole) >= 4 or (len(whole) == 3 and whole[1].isdigit()):
                end = at + len(whole)
                if len(whole) > 3 and 9 <= sum(c.isdigit() for c in whole) <= 15:
                    yield at, end
        at = text.find("+", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the patterns, by kind and start."""
    spans = []
    if "@" in text:
        spans += [(0, *s) for s in _emails(text)]
    if _SIGN.search(text):
        spans += [(1, *s) for s in _ips(text)] + [(2, *s) for s in _cards(text)]
        if "+" in text:
            spans += [(3, *s) for s in _phones(text)]
    return spans


# Shapes: each is a feature of one word; those of hidden signs are left out for some words in training.
_SHAPES = (
    "bias", "digits", "few_digits", "phone_digits", "card_digits", "many_digits", "letters", "long_letters", "dotted",
    "three_dots", "hyphen", "bracket", "hex", "capital", "equals", "slash", "domain", "after_node", "before_node",
    "after_phone_part", "before_phone_part", "after_at_word",
    "at_sign", "plus",
)
_HIDDEN = ("at_sign", "plus", "domain")
_PART = re.compile(r"\+?[0-9]{1,3}$|\(?[0-9]{2,5}\)?$|[0-9]{2,4}(?:[-.][0-9]{2,4})+$")


@dataclass
class Nodes:
    """Words with a digit or an at sign of several texts, and the edges between them."""

    text: list[int]
    start: list[int]
    end: list[int]
    x: np.ndarray
    edges: np.ndarray  # rows (node, later node, 0 chain or 1 skip)


def find_nodes(texts: list[str]) -> Nodes:
    owner, starts, ends, rows, edges = [], [], [], [], []
    for number, text in enumerate(texts):
        if not _SIGN.search(text):
            continue
        words = [m.span() for m in _WORD.finditer(text)]
        last_key: dict[str, int] = {}
        before, before_at = -1, -2
        marked = [bool(_SIGN.search(text, a, b)) for a, b in words]
        for at, (a, b) in enumerate(words):
            if not marked[at]:
                continue
            while a < b and text[a] in _EDGE and not (text[a] == "(" and ")" in text[a:b]):
                a += 1
            while a < b and text[b - 1] in _EDGE and not (text[b - 1] == ")" and "(" in text[a:b]):
                b -= 1
            if a == b:
                continue
            word, node = text[a : min(b, a + 200)], len(owner)
            digits = sum(c.isdigit() for c in word)
            letters = sum(c.isalpha() for c in word)
            bare = _PART.match(word) is not None
            near = lambda k: text[words[k][0] : words[k][1]][:40].strip(_EDGE) if 0 <= k < len(words) else ""  # noqa: E731, B023
            left, right = near(at - 1), near(at + 1)
            row = (
                1, digits > 0, digits <= 3, 7 <= digits <= 12 or bare, 13 <= digits <= 19 and not letters, digits > 19,
                letters > 0, letters > 10, "." in word, word.count(".") == 3 and not letters, "-" in word, "(" in word,
                letters > 0 and digits > 3 and not set(word.lower()) - set("0123456789abcdef"), word.isupper(), "=" in word,
                "/" in word, bool(letters) and "." in word and "@" not in word,
                at > 0 and marked[at - 1], at + 1 < len(words) and marked[at + 1],
                bool(bare and _PART.match(left)), bool(bare and _PART.match(right)), left.lower() in ("at", "@"),
                "@" in word, word.startswith("+"),
            )
            owner.append(number), starts.append(a), ends.append(b), rows.append(row)
            if before_at == at - 1:
                edges.append((before, node, 0))
            before, before_at = node, at
            plain = "".join(c for c in word.lower() if c.isalnum())
            run = "".join(c for c in word if c.isdigit())
            for key in {f"w{plain}"} | ({f"d{run[-7:]}"} if len(run) >= 7 and not letters else set()):
                if key in last_key and len(plain) > 3:
                    edges.append((last_key[key], node, 1))
                last_key[key] = node
    x = np.array(rows, float).reshape(-1, len(_SHAPES))
    return Nodes(owner, starts, ends, x, np.array(edges, np.int64).reshape(-1, 3))


@dataclass
class Field:
    """Weights: node (features x labels), chain and skip (labels x labels); label 0 is none."""

    node: np.ndarray
    pair: np.ndarray

    @classmethod
    def empty(cls) -> Field:
        return cls(np.zeros((len(_SHAPES), len(KINDS) + 1)), np.zeros((2, len(KINDS) + 1, len(KINDS) + 1)))

    def beliefs(self, nodes: Nodes) -> np.ndarray:
        """Approximate marginals of the labels of every node by loopy sum-product messages."""
        unary = nodes.x @ self.node
        if not len(nodes.edges):
            return _softmax(unary)
        a, b, kind = nodes.edges.T
        source, target = np.concatenate((a, b)), np.concatenate((b, a))
        factor = np.concatenate((self.pair[kind], self.pair[kind].transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
        message = np.zeros((len(source), unary.shape[1]))
        for _ in range(ROUNDS):
            total = unary.copy()
            np.add.at(total, target, message)
            out = total[source] - message[back]
            fresh = _log_sum(out[:, :, None] + factor, 1)
            fresh -= fresh.max(1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * fresh
        total = unary
        np.add.at(total, target, message)
        return _softmax(total)


def _log_sum(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis, keepdims=True)
    return np.log(np.exp(z - top).sum(axis)) + top.squeeze(axis)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    return z / z.sum(1, keepdims=True) if len(z) else z


def fit(nodes: Nodes, labels: np.ndarray) -> Field:
    """Maximum pseudo-likelihood by Adam steps: each node given its features and its neighbours' labels."""
    field = Field.empty()
    n, k = len(labels), len(KINDS) + 1
    if not n or not labels.any():
        return field
    x = nodes.x.copy()
    hide = np.random.Generator(np.random.PCG64(7)).random(n) < 0.5
    x[np.ix_(hide, [_SHAPES.index(s) for s in _HIDDEN])] = 0
    truth = np.eye(k)[labels]
    a, b, kind = nodes.edges.T if len(nodes.edges) else (np.zeros(0, np.int64),) * 3
    around = np.zeros((2, 2, n, k))  # direction, edge kind: labels of the neighbours
    np.add.at(around[0], (kind, b), truth[a])
    np.add.at(around[1], (kind, a), truth[b])
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (field.node, field.pair)]
    for step in range(1, FIT_STEPS + 1):
        z = x @ field.node
        for e in range(2):
            z = z + around[0, e] @ field.pair[e] + around[1, e] @ field.pair[e].T
        error = (_softmax(z) - truth) / n
        pair = np.stack([around[0, e].T @ error + error.T @ around[1, e] for e in range(2)])
        for w, grad, (mean, square) in zip((field.node, field.pair), (x.T @ error, pair), state):
            grad = grad + RIDGE * w
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad * grad - square)
            w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    # Copies of a word support a label; they never argue against one.
    field.pair[1] = np.diag(np.clip(np.diag(field.pair[1]), 0.0, 3.0))
    return field


def node_labels(nodes: Nodes, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Label of each node: one more than the kind of the first listed base span it touches."""
    labels = np.zeros(len(nodes.text), np.int64)
    for i, (t, a, b) in enumerate(zip(nodes.text, nodes.start, nodes.end)):
        labels[i] = next((kind + 1 for kind, s, e in spans[t] if s < b and a < e), 0)
    return labels


def added_spans(texts: list[str], spans: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds to the base spans of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not field.node.any():
        return out
    nodes = find_nodes(texts)
    belief = field.beliefs(nodes)
    base = node_labels(nodes, spans)
    chained = {(int(a), int(b)) for a, b, kind in nodes.edges if kind == 0}
    last = -1
    for i in np.flatnonzero((belief[:, 1:].max(1, initial=0) >= BELIEF) & (base == 0)):
        kind, own = int(belief[i, 1:].argmax()), out[nodes.text[i]]
        if own and last == i - 1 and (last, int(i)) in chained and own[-1][0] == kind:
            own[-1] = (kind, own[-1][1], nodes.end[i])
        else:
            own.append((kind, nodes.start[i], nodes.end[i]))
        last = int(i)
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > PIECE_CHARS:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def train(docs: DataFrame) -> Field:
    """Fit the field on the base spans of a bounded sample of texts with nodes."""
    scratch = Scratch(docs.sparkSession, "personal-data")
    some = docs.select("text").where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("h"))
    picked = scratch.settle("picked", some.select("h").distinct().orderBy("h").limit(SAMPLE))
    width = len(_SHAPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            nodes = find_nodes(texts)
            labels = node_labels(nodes, [base_spans(t) for t in texts])
            edges = [[] for _ in texts]
            first = np.searchsorted(nodes.text, np.arange(len(texts) + 1))
            for a, b, kind in nodes.edges.tolist():
                t = nodes.text[a]
                edges[t] += [a - int(first[t]), b - int(first[t]), kind]
            per = [slice(first[t], first[t + 1]) for t in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([nodes.x[p].astype(np.int8).tobytes() for p in per], pa.binary()),
                    pa.array([labels[p].astype(np.int8).tobytes() for p in per], pa.binary()),
                    pa.array([np.array(e, np.int64).tobytes() for e in edges], pa.binary()),
                    batch.column("h"),
                ],
                ["x", "labels", "edges", "h"],
            )

    sample = some.join(F.broadcast(picked), "h").dropDuplicates(["h"])
    rows = sample.select("text", "h").mapInArrow(run, "x binary, labels binary, edges binary, h long").orderBy("h").collect()
    x, labels, edges, at = [], [], [], 0
    for row in rows:
        own = np.frombuffer(row["labels"], np.int8)
        e = np.frombuffer(row["edges"], np.int64).reshape(-1, 3).copy()
        e[:, :2] += at
        at += len(own)
        x.append(np.frombuffer(row["x"], np.int8).reshape(-1, width)), labels.append(own), edges.append(e)
    if not at:
        return Field.empty()
    nodes = Nodes([], [], [], np.concatenate(x).astype(float), np.concatenate(edges))
    return fit(nodes, np.concatenate(labels).astype(np.int64))


def _found(texts: list[str], field: Field) -> Iterator[tuple[list, list]]:
    for first, last in _pieces(texts):
        part = texts[first:last]
        base = [base_spans(t) for t in part]
        signs = [i for i, t in enumerate(part) if _SIGN.search(t)]
        more = dict(zip(signs, added_spans([part[i] for i in signs], [base[i] for i in signs], field)))
        for i in range(len(part)):
            yield base[i], more.get(i, [])


def find(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, added = [], [], [], []
            for base, more in _found([t or "" for t in batch.column("text").to_pylist()], field):
                counts.append([sum(s[0] == k for s in base) for k in range(len(KINDS))])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(sorted(base + more)))
                added.append(len(more))
            by_kind = np.array(counts, np.int64).reshape(-1, len(KINDS)).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in by_kind), pa.array(digests), pa.array(spans), pa.array(added, pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``<kind>``; a text without spans stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = []
            for text, (base, more) in zip(texts, _found([t or "" for t in texts], field)):
                parts, free = [], 0
                for start, end, kind in sorted((s, e, k) for k, s, e in base + more):
                    if end > free:
                        parts += [text[free:start], f"<{KINDS[kind]}>"] if start >= free else []
                        free = end
                out.append("".join([*parts, text[free:]]) if free else text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


@query()
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
