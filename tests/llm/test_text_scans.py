"""Operators 1, 4 and 10: scans of whole texts."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fbrank.llm import decontaminate, quality, token_count

SF = "/root/testdata/sf0.001"
LONG = "word " * 60_000 + "alpha beta gamma"


def slow_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow_contamination(docs, items, window=10):
    out = []
    for d, text in docs:
        w, hit, who = slow_words(text), set(), set()
        for item, t in items:
            v = slow_words(t)
            n = min(len(v), window)
            wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    who |= set() if item is None else {str(item)}
        out.append((d, len(w), len(hit), len(who), ",".join(sorted(who))))
    return out


def test_contamination_equals_brute_force_with_one_block_and_many(spark):
    rng = random.Random(3)
    vocab = "ab cd EF gh ij 12 é ñandú x".split()
    items = [(i, " ".join(rng.choices(vocab, k=k))) for i, k in enumerate([1, 2, 3, 12, 25, 10, 11, 40])] + [(None, "lonely item words"), (99, None), (98, "--- ..."), (7, "ab")]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 80)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "xx " + items[4][1].upper().replace(" ", ", ") + "!"), (102, "Lonely  ITEM\nwords"), (None, "ab"), (103, LONG), (104, items[7][1]), (104, items[7][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("found", F.lit(1)).withColumn("its_text", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(slow_contamination(docs, items), key=str)
    for block in (decontaminate.BLOCK_CHARS, 60):
        got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"])) for r in decontaminate.contamination(d, b, block_chars=block).collect()]
        assert sorted(got, key=str) == want
    kept = decontaminate.decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[2]), key=str)


def test_offsets_point_into_the_original_text(spark):
    text = "Ünï – Été: ONE  two\tThree; end é"
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    row = decontaminate.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), b).first()
    assert [text[s.c0 : s.c1] for s in row.spans] == ["ONE  two\tThree"]


def test_contamination_of_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(d, b).count() == 0
    assert decontaminate.contamination(spark.createDataFrame([(1, "a")], d.schema), b).first().n_hit == 0


def test_query_1_digest(spark):
    from fbrank.llm.queries import op1_decontamination

    rows = op1_decontamination(spark, SF).collect()
    assert {r.items_sha256 for r in rows if not r.n_items} == {hashlib.sha256(b"").hexdigest()}
    assert all(r.contaminated == (r.n_hit > 0) for r in rows) and any(r.contaminated for r in rows)


def greedy(word, vocab, end, continuing=""):
    symbols, at, n = [*word, end] if end else [*word], 0, 0
    while at < len(symbols):
        for k in range(len(symbols), at, -1):
            piece = "".join(symbols[at:k])
            if (continuing + piece if at else piece) in vocab:
                at, n = k, n + 1
                break
        else:
            return 1
    return n


@pytest.mark.parametrize("continuing,end", [("", ""), ("##", ""), ("", "</w>")])
def test_longest_match_equals_greedy(continuing, end):
    rng = random.Random(5)
    for _ in range(60):
        pieces = {"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 14))}
        vocab = {p if rng.random() < 0.5 else (continuing + p if continuing else p + end) for p in pieces}
        m = token_count.LongestMatch(sorted(vocab), continuing, end)
        for _ in range(40):
            w = "".join(rng.choices("abcd" if rng.random() < 0.1 else "abc", k=rng.randint(1, 12)))
            assert m.count(w) == greedy(w, vocab, end, continuing), (w, vocab)
        assert m.count("") == 0


def test_token_counts_equal_greedy_over_the_real_vocabulary(spark):
    docs = [(1, None), (1, ""), (2, "The cat's 42 mats"), (2, "The cat's 42 mats"), (3, "é…漢字 x_y\x00"), (None, LONG)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("c", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    vocab, letters = set(token_count.load_pieces()), token_count.byte_letters()
    spell = lambda w: "".join(letters[b] for b in w.encode())
    got = sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in token_count.token_counts(df).collect())
    want = sorted((str(d), len(token_count.words_of(t)), sum(greedy(spell(w), vocab, token_count.END) for w in token_count.words_of(t))) for d, t in docs)
    assert got == want
    assert token_count.token_counts(df.limit(0)).count() == 0


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_quality_learns_only_training_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.training_rows(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality.classify(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_quality_learns_repeated_rows_once(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    again = docs.unionByName(docs.filter("doc_id % 3 = 0")).unionByName(docs.filter("doc_id % 3 = 0"))
    a, b = quality.learn(docs, labels), quality.learn(again, labels.unionByName(labels))
    assert np.array_equal(a.weights, b.weights) and a.cut == b.cut


def test_quality_of_odd_rows(spark):
    schema = "doc_id long, text string, score string, predicted int"
    docs = spark.createDataFrame([(1, None, "a", 1), (None, "", "b", 2), (3, "x" * 100_000, "c", 3), (3, LONG, "c", 3), (3, LONG, "c", 3)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (3, None), (None, 0), (3, 1)], "doc_id long, quality int")
    for labels in (none, one):
        rows = quality.classify(docs, labels).collect()
        assert len(rows) == 5 and all(r.predicted == 1 for r in rows)
        assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.classify(docs.limit(0), one).count() == 0


def test_bradley_terry_orders_by_strength():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    w = quality.bradley_terry(np.abs(rng.normal(size=(400, 1))) * np.array([1.0, 0.5, 0.0]) + 0.1 * x)
    assert w[0] > w[1] > abs(w[2]) - 1e-3
