"""Benchmark decontamination with one Aho-Corasick automaton over normalised item windows.

Texts are lower-cased (A-Z) and cut into words of digits, a-z and characters from U+0080 on.  The
automaton's alphabet is the items' words, its patterns are the items' windows of ``WINDOW``
consecutive words (a shorter item is one window).  Every document is scanned once; hits are merged
word spans, mapped back to character offsets of the original text.

The items of one automaton are bounded: they are dealt into blocks of at most ``BLOCK_CHARS``
characters (about 150 bytes of automaton per character), one block for any usual benchmark.
Further blocks are further scans, each over all documents and each adding its spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fbrank.llm.frames import column, fresh, settled

WINDOW = 10
BLOCK_CHARS = 2_000_000

#: in UTF-8: A-Z to a-z, every byte below 0x80 that is no digit or letter to a space
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")

SPAN = "array<struct<w0:int,w1:int,c0:int,c1:int>>"
FOUND = f"struct<n_words:bigint,spans:{SPAN},items:array<string>>"
_SPAN = pa.list_(pa.struct([("w0", pa.int32()), ("w1", pa.int32()), ("c0", pa.int32()), ("c1", pa.int32())]))


def words_of(text: bytes | str | None) -> list[bytes]:
    """Normalised words in UTF-8; null has none."""
    text = text.encode() if isinstance(text, str) else text or b""
    return text.translate(_NORMAL).split()


def word_offsets(text: bytes) -> list[tuple[int, int]]:
    """Character offsets of the words in the original text."""
    starts = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80  # bytes that begin a character
    chars = np.concatenate([[0], np.cumsum(starts)])
    return [(int(chars[m.start()]), int(chars[m.end()])) for m in _WORD.finditer(text.translate(_NORMAL))]


class Windows:
    """Automaton over the word windows of ``(item_id, text)`` pairs."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).update([] if item is None else [item])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, who in owners.items():
            self.automaton.add_word(key, (len(key), tuple(who)))
        if owners:
            self.automaton.make_automaton()
        # neighbours in some window, and words that are a window: outside of these the automaton stays at its root
        self.base = len(self.vocabulary) + 1
        self.pairs = np.array(sorted({a * self.base + b for key in owners for a, b in pairwise(key)}), np.int64)
        self.single = np.array(sorted(key[0] for key in owners if len(key) == 1), np.int64)
        self.shortest = min(map(len, owners), default=0)

    def _stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words, long enough for a window, whose neighbours all occur as neighbours in a window."""
        keys = ids[:-1] * self.base + ids[1:]
        known = np.zeros(len(ids) + 1, bool)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            known[1:-1] = self.pairs[at] == keys
        starts, ends = np.nonzero(~known[:-1])[0], np.nonzero(~known[1:])[0] + 1
        fit = ends - starts >= max(self.shortest, 2)
        if len(self.single):
            fit |= np.isin(ids[starts], self.single)
        yield from zip(starts[fit].tolist(), ends[fit].tolist(), strict=True)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans ``[first, end)`` inside any window, and the items hit."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.shortest or len(words) < self.shortest:
            return spans, items
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        for start, stop in self._stretches(ids):
            for end, (n, who) in self.automaton.iter(tuple(ids[start:stop].tolist())):
                items.update(who)
                spans.append((start + end - n + 1, start + end + 1))
        return merge_spans(spans), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans; spans that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanner(items: list[tuple[str | None, str | None]], window: int):
    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        patterns = Windows(items, window)
        for texts, before in batches:
            n_words, all_spans, all_items = [], [], []
            for text, old in zip(texts.to_pylist(), before.to_pylist(), strict=True):
                words = words_of(text)
                spans, who = patterns.scan(words)
                if old:
                    spans = merge_spans(spans + [(s["w0"], s["w1"]) for s in old["spans"]])
                    who.update(old["items"])
                at = word_offsets(text) if spans else []
                n_words.append(len(words))
                all_items.append(sorted(who))
                all_spans.append([(a, b, at[a][0], at[b - 1][1]) for a, b in spans])
            yield pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(all_spans, _SPAN), pa.array(all_items, pa.list_(pa.string()))],
                                             names=["n_words", "spans", "items"])

    return scan


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> list[list[tuple[str | None, str | None]]]:
    """The items, in blocks whose size is measured before they are read."""
    items = benchmark.select(column(benchmark, id_col).cast("string").alias("id"), column(benchmark, text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    if n == 1:
        return [[tuple(r) for r in items.collect()]]
    of = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    return [[tuple(r) for r in items.filter(of == k).collect()] for k in range(n)]


def scan_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                   item_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All rows and columns of ``docs`` plus one column ``found`` (longer if taken), the last:
    ``struct<n_words, spans, items>``.

    ``spans`` are merged hits: words ``[w0, w1)``, characters ``[c0, c1)`` of the original text;
    ``items`` the ids (as strings, sorted, distinct) of items with an occurring window.  A null or
    empty text has no words and no hits.  An item without words has no window; an item without an
    id still hits, but is not listed.  Repeated rows are scanned as they come."""
    text, extra = column(docs, text_col).cast("string").cast("binary"), fresh(docs, "found")
    out = docs.withColumn(extra, F.lit(None).cast(FOUND))
    blocks = _item_blocks(benchmark, item_id_col, item_text_col, block_chars)
    for k, items in enumerate(blocks):
        out = out.withColumn(extra, _scanner(items, window)(text if k == 0 else column(out, text_col).cast("string").cast("binary"), column(out, extra)))
        if k + 1 < len(blocks):
            out = settled(out)
    return out


def _n_hit(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0), lambda n, s: n + s["w1"] - s["w0"]).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items, spans``; only id and text are read."""
    slim = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("its_text"))
    found = scan_documents(slim, benchmark, text_col="its_text", **options)
    return found.select("doc_id", "found.n_words", _n_hit(F.col("found")).alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
                        "found.items", "found.spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_hit: int = 1, **options) -> DataFrame:
    """The rows of ``docs`` (all columns, as they are) with fewer than ``min_hit`` words in windows."""
    found = scan_documents(docs, benchmark, **options)
    extra = found.columns[-1]
    return found.filter(_n_hit(column(found, extra)) < min_hit).drop(extra)
