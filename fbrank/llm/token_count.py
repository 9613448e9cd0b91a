"""Token counts by a linear longest-match automaton.

Greedy longest-match-first segmentation of a word needs no back-tracking if every node of the
vocabulary's trie knows where to go on when it has no child for the next character: a failure link
to the node of what is left after the greedy pieces, and how many pieces those are.  Counting
walks each character once and adds the precomputed numbers; no piece is built.

Words are counted once per worker while they fit its memory of recent words.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fbrank.llm.frames import column

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END = "</w>"
#: word lengths that a Python worker remembers; beyond, it forgets and counts again
WORDS_KEPT = 300_000
_PRE = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class LongestMatch:
    """Automaton over a vocabulary of pieces; pieces that continue a word begin with ``continuing``
    and pieces that end one close with ``end`` (either may be empty).  Symbols are characters, and
    the end mark is one symbol."""

    def __init__(self, pieces: Iterable[str], continuing: str = "", end: str = "") -> None:
        self.end = end
        self.child: list[dict[str, int]] = [{}, {}]
        whole: list[bool] = [False, False]
        self.first, self.inner = 0, 1 if continuing else 0
        for piece in pieces:
            at = self.first
            if continuing and piece.startswith(continuing) and len(piece) > len(continuing):
                at, piece = self.inner, piece[len(continuing):]
            symbols = self._symbols(piece)
            if not symbols or symbols == [end]:
                continue
            for s in symbols:
                if s not in self.child[at]:
                    self.child[at][s] = len(self.child)
                    self.child.append({})
                    whole.append(False)
                at = self.child[at][s]
            whole[at] = True
        n = len(self.child)
        self.link, self.popped = [-1] * n, [0] * n
        queue = deque((root, s, v) for root in {self.first, self.inner} for s, v in self.child[root].items())
        while queue:
            u, s, v = queue.popleft()
            if whole[v]:
                self.link[v], self.popped[v] = self.inner, 1
            else:
                z, count = self.link[u], self.popped[u]
                while z >= 0 and s not in self.child[z]:
                    count += self.popped[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.popped[v] = self.child[z][s], count
            queue.extend((v, t, w) for t, w in self.child[v].items())

    def _symbols(self, piece: str) -> list[str]:
        if self.end and piece.endswith(self.end):
            return [*piece[: -len(self.end)], self.end]
        return list(piece)

    def count(self, word: str) -> int:
        """Pieces of the greedy segmentation; 1, the unknown token, if there is none; 0 for the empty word."""
        if not word:
            return 0
        at, n = self.first, 0
        for s in [*word, self.end] if self.end else word:
            while s not in self.child[at]:
                if self.link[at] < 0:
                    return 1
                n += self.popped[at]
                at = self.link[at]
            at = self.child[at][s]
        while at != self.inner:
            if self.link[at] < 0:
                return 1
            n += self.popped[at]
            at = self.link[at]
        return n


def byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level vocabularies: visible Latin-1 characters stand
    for themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """Pieces of a tokenizer file with ``model.vocab``, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return [p for p in spec["model"]["vocab"] if p not in special]


class _Lengths(dict):
    def __init__(self, automaton: LongestMatch) -> None:
        super().__init__()
        self.automaton, self.letters = automaton, byte_letters()

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = n = self.automaton.count("".join([self.letters[b] for b in word.encode("utf-8", "replace")]))
        return n


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, single digits and runs of other visible characters."""
    return _PRE.findall((text or "").lower())


def counts(text: Column, pieces: list[str]) -> Column:
    """``struct<n_words, n_tokens>`` of a text column."""
    shared = _shared(pieces)

    @F.pandas_udf("n_words long, n_tokens long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lengths = _Lengths(LongestMatch(shared.value, end=END))
        for texts in batches:
            words = [words_of(t) for t in texts]
            yield pd.DataFrame({"n_words": [len(w) for w in words], "n_tokens": [sum(map(lengths.__getitem__, w)) for w in words]}, dtype="int64")

    return counted(text)


def _shared(pieces: list[str]):
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(pieces)  # a vocabulary: fixed size


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_tokens`` of the whole text.

    Null and empty texts have none; a word that the vocabulary cannot spell is one token.
    Repeated rows count alike; other columns are not read.  The file is read on the driver."""
    c = counts(column(docs, text_col).cast("string"), load_pieces(vocabulary))
    return docs.select(column(docs, id_col).alias("doc_id"), c.alias("c")).select("doc_id", "c.n_words", "c.n_tokens")
