"""Operator 11, quality rules [native]: a ledger of rule bits.

Every rule is evaluated once: ``ledger`` stores what was measured and one bit per failed rule.
Policies are versioned sets of rules, that is masks; applying one is ``failed & mask``, and another
version never looks at a text again.  ``ablations`` says what each rule of a policy does, from the
counts of documents by bit pattern (``failed`` alone is grouped; there are at most 2^rules patterns).

Measurements of a text (null: none), whose words are ``[^\\x20\\x09-\\x0D]+``:

* ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters ``#*$%&|<>``),
  ``n_upper`` (characters A-Z);
* ``n_lines`` (\\n-split lines with a word), ``n_dup_lines`` (those equal to an earlier one);
* ``n_repeat_words``: words in windows of eight words that occur at least twice in the text, the
  first occurrence included.

Repeated windows are found within the row: a 64-bit hash per window (of two hashes of half its
length), and only where a hash occurs twice are hashes and places sorted together.  Work is n log n in the words of a text,
nothing is shuffled, and every row, repeated ones too, has its own ledger.  Empty texts and null
texts measure zero everywhere.  Extra columns stay, whatever their names: the ledger goes by a name
that no column has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fbrank.llm.frames import column, fresh

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8

#: bit i of ``failed`` belongs to the i-th rule; rules are added at the end only, so that old ledgers stay valid
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 10 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "shouting": "100 * n_upper > 30 * word_chars",
}
#: versions of the policy: the rules whose failure rejects a document
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "short_words", "long_words", "symbols"),
    "v2": tuple(RULES),
}
CURRENT = "v2"


def mask(rules: Sequence[str]) -> int:
    """The bits of these rules; an unknown one is an error."""
    places = list(RULES)
    unknown = [r for r in rules if r not in places]
    if unknown:
        raise ValueError(f"unknown rules {unknown}")
    return sum(1 << places.index(r) for r in set(rules))


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one more column, a struct of the measurements, named ``ledger`` or, where a column
    is called so, that with underscores."""
    out = fresh(docs, "ledger")
    t = F.coalesce(column(docs, text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    words = F.filter(F.split(t, f"[{SPACE}]+", -1), lambda x: F.length(x) > 0)
    # each array that is read more than once is a column of the step before, so that it is made once
    frame = docs.withColumn(out, F.struct(words.alias("words"), lines.alias("lines"), _count(t, f"[{SYMBOLS}]").alias("n_symbols"),
                                          _count(t, "[A-Z]").alias("n_upper")))
    s = column(frame, out)
    done = [F.size(s["words"]).alias("n_words"), F.length(F.concat_ws("", s["words"])).alias("word_chars"), s["n_symbols"].alias("n_symbols"),
            s["n_upper"].alias("n_upper"), F.size(s["lines"]).alias("n_lines"), (F.size(s["lines"]) - F.size(F.array_distinct(s["lines"]))).alias("n_dup_lines")]
    frame = frame.withColumn(out, F.struct(*done, F.transform(s["words"], lambda w: F.xxhash64(w)).alias("hashes")))
    half = 1
    while half < WINDOW:  # hashes of twice the length, from each place that leaves room for them
        s = column(frame, out)
        n = F.greatest(F.size(s["hashes"]) - half, F.lit(0))
        twice = F.zip_with(F.slice(s["hashes"], 1, n), F.slice(s["hashes"], half + 1, n), lambda a, b: F.xxhash64(a, b))
        frame = frame.withColumn(out, s.withField("hashes", twice))
        half *= 2
    s = column(frame, out)
    placed = F.transform(s["hashes"], lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    some = F.size(F.array_distinct(s["hashes"])) < F.size(s["hashes"])
    frame = frame.withColumn(out, s.withField("hashes", F.when(some, F.sort_array(placed))))
    s = column(frame, out)
    near = lambda j: F.get(s["hashes"], j)["h"]
    twins = F.filter(s["hashes"], lambda x, j: near(j - 1).eqNullSafe(x["h"]) | near(j + 1).eqNullSafe(x["h"]))
    frame = frame.withColumn(out, s.withField("hashes", F.sort_array(F.transform(twins, lambda x: x["i"]))))
    s = column(frame, out)
    new = F.transform(s["hashes"], lambda p, j: F.least(F.coalesce(F.get(s["hashes"], j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    repeated = F.coalesce(F.aggregate(new, F.lit(0), lambda a, x: a + x), F.lit(0))
    return frame.withColumn(out, s.withField("n_repeat_words", repeated).dropFields("hashes"))


def _count(text: Column, chars: str) -> Column:
    """Characters of that class: what is missing without them."""
    return F.length(text) - F.length(F.regexp_replace(text, chars, ""))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``measure`` with the failure bits of every rule, ``failed`` (long), beside the measurements."""
    frame = measure(docs, text)
    name = frame.columns[-1]
    s = column(frame, name)
    quoted = "`" + name.replace("`", "``") + "`"
    bits = [F.when(F.expr(_within(rule, quoted)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES.values())]
    return frame.withColumn(name, s.withField("failed", reduce(lambda a, b: a.bitwiseOR(b), bits)))


def _within(rule: str, struct: str) -> str:
    """A rule reads the measurements, as longs, from the struct of that name."""
    names = {"n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words"}
    return " ".join(f"cast({struct}.{w} AS BIGINT)" if w in names else w for w in rule.split())


def passes(failed: Column, policy: str = CURRENT, policies: Mapping[str, Sequence[str]] = POLICIES) -> Column:
    """Whether the policy of that version keeps a document with these failure bits."""
    return failed.bitwiseAND(F.lit(mask(policies[policy])).cast("long")) == 0


def ablations(ledgers: DataFrame, name: str = "ledger", policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """Per policy and rule of it: documents in all, kept, failing the rule, failing it and no other rule
    of the policy (kept if the rule went), and documents that the other rules of the policy keep.

    Rows: (version, rule, n_docs, n_kept, n_failed, n_only, n_kept_without), a row per rule, zeros included."""
    spark = ledgers.sparkSession
    patterns = ledgers.groupBy(column(ledgers, name)["failed"].alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    cells = [(v, r, mask(rules), mask([r])) for v, rules in policies.items() for r in rules]  # configuration
    grid = spark.createDataFrame(cells, "version string, rule string, policy long, bit long")
    hit = lambda m: F.col("failed").bitwiseAND(m)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    each = patterns.withColumn("cell", F.explode(F.lit([c[0] + "\n" + c[1] for c in cells])))
    of = grid.withColumn("cell", F.concat_ws("\n", "version", "rule"))
    return (of.join(each, "cell", "left").groupBy("version", "rule")
            .agg(total(F.col("n").isNotNull()).alias("n_docs"), total(hit(F.col("policy")) == 0).alias("n_kept"), total(hit(F.col("bit")) != 0).alias("n_failed"),
                 total(hit(F.col("policy")) == F.col("bit")).alias("n_only"),
                 total(hit(F.col("policy").bitwiseAND(F.bitwise_not("bit"))) == 0).alias("n_kept_without")))
