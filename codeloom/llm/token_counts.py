"""Token counts by greedy longest match in linear time, without building pieces.

The vocabulary is a trie over bytes. A node's failure link names the node where matching goes on
when no child fits, and its popped count says how many tokens are settled by following it; both
are computed once, breadth first. A byte that no token covers counts as one token of its own, and
matching goes on behind it like behind any token. Counting a word then takes one step per byte plus the links
it follows, and every link settles a token, so long words cost no more per byte than short ones.

The vocabulary is a byte-level one, in which a leading blank belongs to the word; a word is
matched with one blank before it. The automaton's size is that of the vocabulary file, which
``MAX_NODES`` bounds before it is sent to the workers.

Defined results: a null or blank text has 0 words and 0 tokens; a byte that no token covers is
one token; repeated rows are counted each; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.base import query, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
MAX_NODES = 4_000_000
#: Distinct words a worker remembers before it starts anew.
MEMO_WORDS = 200_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files, by its public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The tokens of a byte-level vocabulary file as bytes; entries with other letters are left out."""
    with open(path, encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    letters = byte_letters()
    return [bytes(letters[c] for c in token) for token in entries if token and all(c in letters for c in token)]


@dataclass
class Automaton:
    """children: (node << 8 | byte) -> node; fail: node, -1 at the root; popped: tokens settled by failing."""

    children: dict[int, int]
    fail: list[int]
    popped: list[int]

    @classmethod
    def build(cls, tokens: Iterable[bytes]) -> Automaton:
        children: dict[int, int] = {}
        ends, below = {}, [[]]
        for token in tokens:
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in children:
                    children[key] = len(below)
                    below[node].append(byte)
                    below.append([])
                node = children[key]
            ends[node] = True
        if len(below) > MAX_NODES:
            raise ValueError(f"a vocabulary of {len(below)} nodes is too large to send to every worker")
        fail, popped = [-1] * len(below), [0] * len(below)
        queue = deque([0])
        while queue:
            above = queue.popleft()
            for byte in below[above]:
                node = children[above << 8 | byte]
                if node in ends or above == 0:
                    fail[node], popped[node] = 0, 1
                else:
                    at, settled = fail[above], popped[above]
                    while at >= 0 and at << 8 | byte not in children:
                        settled += popped[at]
                        at = fail[at]
                    if at >= 0:
                        fail[node], popped[node] = children[at << 8 | byte], settled
                    else:
                        fail[node], popped[node] = 0, settled + 1
                queue.append(node)
        return cls(children, fail, popped)

    def count(self, text: bytes) -> int:
        """Tokens of the greedy longest-match split of ``text``."""
        children, fail, popped = self.children, self.fail, self.popped
        node = total = 0
        for byte in text:
            while (after := children.get(node << 8 | byte, -1)) < 0:
                if node == 0:
                    total, after = total + 1, 0
                    break
                total += popped[node]
                node = fail[node]
            node = after
        while node:
            total += popped[node]
            node = fail[node]
        return total


def count_tokens(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value

        class Memo(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= MEMO_WORDS:
                    self.clear()
                n = of.count(b" " + word)
                if len(word) <= 64:
                    self[word] = n
                return n

        memo = Memo()
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                n_tokens.append(sum(map(memo.__getitem__, words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")


@query()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), Automaton.build(vocabulary()))
