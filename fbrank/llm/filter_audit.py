"""Operator 13, filter interaction audit: what each filter of a chain removes, in every order.

Five filters fail a text (null: empty; words: maximal ``[^\\x20\\x09-\\x0D]+``, case-sensitive):

* A: fewer than 200 words;  B: 100 * distinct words < 50 * words;  C: 100 * characters A-Z > 2 * code points;
* D: any of ``#$%&*|``;  E: equal to the text of a smaller id, anywhere in the table.

A to D are bits of a mask, found in the scan.  E comes from radix tries:

1. Each task that scans keeps a compressed trie of the texts it has seen, whose terminals hold the smallest id;
   traversing it gives each distinct text once with its ids, so copies meet before anything is shuffled.
   A trie is emptied when its texts reach ``TRIE_BYTES``; a text in two tries is just two rows.
2. Texts are dealt by ranges between adaptive prefixes (``prefixes``): the boundaries are the shortest prefixes that
   tell neighbours of an ordered set of texts apart, so shared openings (of up to ``LEAD`` characters) are still split.
   Boundaries only set the layout; there are at most ``SLOTS`` of them, which bounds what travels with a task.
3. A task reads its ranges in the order of texts and ids and inserts the full texts of a batch into a trie.  The first row
   of a text brings the smallest id of all; every id above it is a duplicate.  Then the trie is cut back to the last
   text, as no other will come again: a task holds a batch and one path, whatever the size of a group of copies.

Masks are then counted by (source, mask, labels); orders are evaluated on these counts alone.

Defined results: a null source counts as the empty string; a null id is larger than every other, and rows with the same id and
text don't make each other duplicates; of labels repeated for an id the largest counts; an empty table has no parts.
Extra columns are not looked at.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fbrank.llm.frames import column

FILTERS = "ABCDE"
MARKS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SLOTS = 4096            # ranges of texts at most
SAMPLED = 8             # texts looked at per range when boundaries are chosen, about
LEAD = 1024             # characters of them: 134 MB at most, and four times that only if hashes were uneven
TRIE_BYTES = 16 << 20   # texts of a scanning task's trie
DUPLICATE = 1 << FILTERS.index("E")


def mask_of(text: bytes) -> int:
    """Bits of the failed filters A to D."""
    words = text.split()  # of bytes, this splits at the same six characters
    n = len(words)
    points = len(text.decode("utf-8", "surrogatepass"))
    failed = (n < 200, 100 * len(set(words)) < 50 * n, 100 * (len(text) - len(text.translate(None, CAPITALS))) > 2 * points,
              len(text.translate(None, MARKS)) < len(text))
    return sum(1 << i for i, f in enumerate(failed) if f)


class Node:
    """An edge's label and what lies below it; ``terminal`` is set where a text ends."""

    __slots__ = ("label", "below", "terminal")

    def __init__(self, label: bytes, terminal=None):
        self.label, self.below, self.terminal = label, {}, terminal


class RadixTrie:
    """A compressed trie of byte strings: no node but the root and terminals has a single child."""

    def __init__(self):
        self.root = Node(b"")
        self.held = 0  # bytes of labels

    def terminal(self, text: bytes, make):
        """The terminal of ``text``, which is inserted with ``make()`` if it is new."""
        node, at = self.root, 0
        while at < len(text):
            child = node.below.get(text[at])
            if child is None:
                child = node.below[text[at]] = Node(text[at:], make())
                self.held += len(text) - at
                return child.terminal
            n = len(child.label)
            if text[at:at + n] != child.label:
                n = _common(text, at, child.label)
                upper = Node(child.label[:n])
                child.label = child.label[n:]
                upper.below[child.label[0]] = child
                node.below[text[at]] = child = upper
            node, at = child, at + n
        if node.terminal is None:
            node.terminal = make()
        return node.terminal

    def texts(self) -> Iterator[tuple[bytes, object]]:
        """All texts in order, with their terminals."""
        open_nodes = [(self.root, b"")]
        while open_nodes:
            node, before = open_nodes.pop()
            text = before + node.label
            if node.terminal is not None:
                yield text, node.terminal
            open_nodes.extend((node.below[c], text) for c in sorted(node.below, reverse=True))

    def keep_path(self, text: bytes) -> None:
        """Drops every branch that ``text`` doesn't run through."""
        node, at = self.root, 0
        self.held = 0
        while at < len(text):
            child = node.below[text[at]]
            node.below = {text[at]: child}
            self.held += len(child.label)
            node, at = child, at + len(child.label)
        node.below = {}


def _common(text: bytes, at: int, label: bytes) -> int:
    """Length of the common beginning of ``text[at:]`` and ``label``, which differ."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if text[at + low:at + mid] == label[low:mid] else (low, mid - 1)
    return low


def prefixes(texts: list[str], n: int) -> list[str]:
    """At most ``n - 1`` boundaries between ``n`` ranges of about equal numbers of the given texts: each the
    shortest beginning of a text that its neighbour before it doesn't share."""
    texts = sorted(set(texts), key=lambda t: t.encode("utf-8", "surrogatepass"))
    found = []
    for i in range(1, n):
        k = i * len(texts) // n
        if k == 0:
            continue
        before, this = texts[k - 1], texts[k]
        shared = next((j for j, (a, b) in enumerate(zip(before, this)) if a != b), min(len(before), len(this)))
        found.append(this[:shared + 1])
    return list(dict.fromkeys(found))


def _boundaries(docs: DataFrame, text: Column) -> list[str]:
    """Adaptive prefixes for about four ranges per shuffle partition; only the layout depends on them.

    They are chosen from the texts whose hash falls into a share of all hashes, at most four times as many as asked for."""
    ranges = min(SLOTS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = ranges * SAMPLED
    share = max(1, docs.count() // wanted)
    some = docs.filter(F.pmod(F.xxhash64(text), F.lit(share)) == 0).select(F.substring(text, 1, LEAD).alias("t"))
    return prefixes([r[0] for r in some.distinct().limit(4 * wanted).collect()], ranges)


def _scan(bounds: list[bytes], out: pa.Schema):
    """Per scanned text the mask, per distinct text of a trie one row with its ids and their parts."""
    def rows(trie: RadixTrie) -> pa.RecordBatch:
        found = list(trie.texts())
        cols = [[bisect_right(bounds, t) for t, _ in found], [t for t, _ in found], [m[0] for _, m in found], [mask_of(t) for t, _ in found],
                [m[1] for _, m in found], [m[2] for _, m in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie()
        for batch in batches:
            ids, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2)):
                member = trie.terminal(text.as_py(), lambda: [None, [], []])
                member[0] = _least(member[0], ids[i])
                member[1].append(ids[i])
                member[2].append(parts[i])
                if trie.held > TRIE_BYTES:
                    yield rows(trie)
                    trie = RadixTrie()
        if trie.root.below or trie.root.terminal is not None:
            yield rows(trie)

    return scan


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _flag(out: pa.Schema):
    """Rows in the order of (text, smallest id) to one row per document, E added to its mask."""

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = RadixTrie(), b""
        for batch in batches:
            cols = [[], [], []]
            mins, masks, ids, parts = (batch.column(i).to_pylist() for i in range(1, 5))
            for i, text in enumerate(batch.column(0)):
                last = text.as_py()
                first = trie.terminal(last, lambda: [mins[i]])[0]  # noqa: B023
                for doc, part in zip(ids[i], parts[i], strict=True):
                    copy = first is not None and (doc is None or doc > first)
                    for c, v in zip(cols, (doc, part, masks[i] | (DUPLICATE if copy else 0)), strict=True):
                        c.append(v)
            trie.keep_path(last)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return flag


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def masks(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row (id, part, mask) per row of ``docs``: the bits of the filters that its text fails."""
    t = F.coalesce(column(docs, text).cast("string"), F.lit(""))
    given = docs.select(column(docs, id_col).alias("id"), F.coalesce(column(docs, part).cast("string"), F.lit("")).alias("part"), t.cast("binary").alias("text"))
    bounds = sorted(b.encode("utf-8", "surrogatepass") for b in _boundaries(docs, t))
    kind = given.schema["id"].dataType
    pre = _schema(slot=T.IntegerType(), text=T.BinaryType(), least=kind, mask=T.IntegerType(), ids=T.ArrayType(kind), parts=T.ArrayType(T.StringType()))
    post = _schema(id=kind, part=T.StringType(), mask=T.IntegerType())
    texts = given.mapInArrow(_scan(bounds, to_arrow_schema(pre)), pre)
    dealt = texts.repartition("slot").sortWithinPartitions("text", F.col("least").asc_nulls_last())
    return dealt.select("text", "least", "mask", "ids", "parts").mapInArrow(_flag(to_arrow_schema(post)), post)


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed, failing but gone before, failing this
    filter alone, the good and the toxic documents removed here, and the filter's removals over all orders."""
    found = masks(docs, id_col=id_col, text=text, part=part)
    marked = labels.groupBy(column(labels, id_col).alias("id")).agg(F.max((column(labels, "quality") == 1).cast("int")).alias("good"),
                                                                    F.max((column(labels, "toxic") == 1).cast("int")).alias("toxic"))
    one = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    counts = (found.join(marked, "id", "left").groupBy("part", "mask")
              .agg(F.count(F.lit(1)).alias("n"), F.sum(one(F.col("good"))).alias("good"), F.sum(one(F.col("toxic"))).alias("toxic")))
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 masks at most
    steps = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for i, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(before).alias("before"), F.lit(bit).alias("bit")))
            before |= bit

    def total(what: str, test) -> Column:
        return F.aggregate(F.filter(F.col("cells"), test), F.lit(0).cast("long"), lambda a, c: a + c[what])

    before, bit = F.col("s.before"), F.col("s.bit")
    hit = lambda c: c["mask"].bitwiseAND(bit) != 0
    gone = lambda c: c["mask"].bitwiseAND(before) != 0
    here = lambda c: hit(c) & ~gone(c)
    each = cells.withColumn("s", F.explode(F.array(*steps))).select(
        "part", "s.filter_order", "s.step", "s.bit", total("n", lambda c: c["mask"].bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total("n", here).alias("removed"), total("n", lambda c: hit(c) & gone(c)).alias("redundant"), total("n", lambda c: c["mask"] == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"))
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return each.withColumn("shapley", shapley).drop("bit")
