"""Greedy word-piece lengths by a linear longest-match automaton.

A word's greedy (longest match first) piece count is found in one pass over its characters, without building
pieces. The vocabulary is a trie; a node that cannot be continued has a failure link and the number of pieces
that are popped on the way, both computed in advance:

* of a node whose string is a piece: the root of word continuations, one piece popped;
* of any other node ``parent + c``: follow the parent's failure links, popping what they pop, until a node
  has a child under ``c``; none if the word cannot be cut greedily there, which makes the word unknown.

The pieces come from a public piece model: those with a leading ``▁`` begin words, the others continue
them. Words are runs of letters, digits and marks, or single other characters, of the lower-cased text.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct words that a task remembers; it forgets them all when there are more.
MEMORY = 200_000
_WORDS = re.compile(r"[^\W_]+|[^\w\s]|_")


class Automaton:
    """Longest-match automaton of pieces that begin words and pieces that continue them."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]) -> None:
        self.child: list[dict[str, int]] = [{}, {}]
        piece = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for p in pieces:
                node = root
                for c in p:
                    node = self.child[node].setdefault(c, len(self.child))
                    if node == len(self.child):
                        self.child.append({})
                        piece.append(False)
                if p:
                    piece[node] = True
        self.link = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, below in self.child[node].items():
                queue.append(below)
                if piece[below]:
                    self.link[below], self.popped[below] = 1, 1
                    continue
                at, pops = self.link[node], self.popped[node]
                while at >= 0 and c not in self.child[at]:
                    pops += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[below], self.popped[below] = self.child[at][c], pops

    def count(self, word: str) -> int:
        """The number of pieces of a word, 0 if it is unknown."""
        node = total = 0
        child, link, popped = self.child, self.link, self.popped
        for c in word:
            while c not in child[node]:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 0
            node = child[node][c]
        while node != 1:  # the end of the word: everything left is popped
            if node < 1:
                return 0
            total += popped[node]
            node = link[node]
        return total


class _Memory(dict):
    """Piece counts of words, negative for unknown ones (which count as one token)."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word)
        self[word] = n
        return n


@lru_cache(maxsize=2)
def load(model: bytes) -> Automaton:
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    own = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    initial = {p[1:] for p in own if p[0] == "▁" and "▁" not in p[1:]} - {""}
    return Automaton(initial, {p for p in own if "▁" not in p})


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """``key, n_words, n_tokens, n_unknown`` of each row; an unknown word counts as one token.

    Null and empty text: zeros. Long words are cut like any other. Repeated rows count each for themselves;
    an empty table gives an empty result; other columns are ignored.
    """
    data = Path(model).read_bytes()  # travels with the function; workers need no file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(load(data))
        for batch in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for value in batch.column(text):
                own = words(value.as_py() or "")
                counts = list(map(memory.__getitem__, own))
                unknown = counts.count(0)
                n_words.append(len(own))
                n_tokens.append(sum(counts) + unknown)
                n_unknown.append(unknown)
                if len(memory) > MEMORY:
                    memory.clear()
            numbers = [pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *numbers], [key, "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, n_tokens long, n_unknown long")
