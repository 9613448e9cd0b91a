"""Operators 11, 12 and 13 against plain Python."""
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fbrank.llm import filter_audit, rule_ledger, vector_codes

SPACE = re.compile("[\x20\x09-\x0d]+")


def slow_measures(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    return dict(n_words=len(words), word_chars=sum(map(len, words)), n_symbols=sum(c in "#*$%&|<>" for c in text), n_upper=sum("A" <= c <= "Z" for c in text),
                n_lines=len(lines), n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(hit))


def odd_texts(rng):
    line = " ".join(f"w{i}" for i in range(9))
    many = [" ".join(rng.choice("ab") for _ in range(n)) for n in (1, 7, 8, 9, 16, 40, 90)]
    return [None, "", " \t\r\n\x0b\x0c", "one", "é  x\U0001f600 y", line, line + "\n" + line, f"{line}\n{line} \n\n {line}", "a#b*$ %&|<>", "TOO LOUD " * 30,
            "x" * 100_000, " ".join(str(i) for i in range(30_000)) + " " + " ".join(str(i) for i in range(25)), *many, line, line]


def test_ledger_measures_like_plain_python(spark):
    texts = odd_texts(random.Random(3))
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, Ledger string, n_words long")
    got = {r.doc_id: r["ledger_"].asDict() for r in rule_ledger.ledger(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = slow_measures(t) if not t or len(t) < 60_000 else None
        if want is None:
            words = t.split()
            want = dict(n_words=len(words), n_repeat_words=50 if len(words) > 1 else 0)
        assert {k: got[i][k] for k in want} == want, (i, t)
        failed = {r for j, r in enumerate(rule_ledger.RULES) if got[i]["failed"] >> j & 1}
        assert failed == {r for r, rule in rule_ledger.RULES.items() if eval(rule, {}, got[i])}


def test_policies_are_masks_and_ablations_add_up(spark):
    rng = random.Random(5)
    bits = [rng.randrange(1 << len(rule_ledger.RULES)) for _ in range(300)] + [0] * 20
    rows = spark.createDataFrame([(b,) for b in bits], "failed long").select(F.struct("failed").alias("ledger"))
    got = {(r.version, r.rule): r for r in rule_ledger.ablations(rows).collect()}
    for version, rules in rule_ledger.POLICIES.items():
        m = rule_ledger.mask(rules)
        assert rows.filter(rule_ledger.passes(F.col("ledger.failed"), version)).count() == sum(b & m == 0 for b in bits)
        for rule in rules:
            b = rule_ledger.mask([rule])
            r = got[version, rule]
            assert (r.n_docs, r.n_kept, r.n_failed) == (len(bits), sum(x & m == 0 for x in bits), sum(x & b != 0 for x in bits))
            assert (r.n_only, r.n_kept_without) == (sum(x & m == b for x in bits), sum(x & (m & ~b) == 0 for x in bits))
    assert all(r.n_docs == r.n_failed == 0 for r in rule_ledger.ablations(rows.limit(0)).collect())
    with pytest.raises(ValueError):
        rule_ledger.mask(["no such rule"])


def slow_codes(vectors, parts=4, entries=256, rounds=4):
    """Brute force over (id, vector) rows that are kept; vectors are padded."""
    width = max((len(v) for _, v in vectors), default=0)
    width = -(-width // parts) * parts
    rows = sorted(((i is None, i, v) for i, v in vectors), key=lambda r: (r[0], r[1] or 0, r[2]))
    x = np.zeros((len(rows), width), np.int64)
    for k, (_, _, v) in enumerate(rows):
        x[k, :len(v)] = np.floor(np.array(v, np.float64) * 1024)
    out, books = [[] for _ in rows], []
    total = np.zeros(len(rows), np.int64)
    for p in np.split(x, parts, axis=1):
        book = p[:entries].copy()
        for turn in range(rounds + 1):
            d = ((p[:, None, :] - book[None]) ** 2).sum(axis=2)
            code = d.argmin(axis=1)
            if turn < rounds:
                for c in np.unique(code):
                    book[c] = p[code == c].sum(axis=0) // (code == c).sum()
        books.append(book)
        total += d.min(axis=1)
        for o, c in zip(out, code):
            o.append(int(c))
    return [(r[1], o, int(t)) for r, o, t in zip(rows, out, total)], books


def test_codes_equal_brute_force_on_odd_vectors(spark):
    rng = np.random.default_rng(2)
    clumps = rng.normal(size=(30, 12))
    rows = [(int(i), [float(v) for v in clumps[i % 30] + 0.1 * rng.normal(size=12)]) for i in range(500)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(7, rows[9][1]), (7, rows[8][1]), (None, rows[3][1])]
    rows += [(2000, []), (2001, [1.0]), (2002, [0.0] * 12), (2003, [-3.5] * 10), (2004, [0.5] * 12), (2004, [0.5] * 12)]
    bad = [(3000, None), (3001, [1.0, None]), (3002, [float("nan")] * 12), (3003, [float("inf")]), (-5, [float("-inf")] * 12)]
    df = spark.createDataFrame([(i, v, i, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, id long, vec string").repartition(5)
    got = vector_codes.compress(df, keep=("id", "vec"))
    want, books = slow_codes(rows)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.vec_id, list(r.code), r.error) for r in got.rows.collect()], key=order) == sorted(want, key=order)
    assert got.digest() == hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    some = vector_codes.decompress(got.rows.filter("vec_id = 3"), got.codebooks).first()
    assert list(some.decoded) == [int(v) for p, c in enumerate(some.code) for v in books[p][c]]


def test_codes_of_empty_tables_and_huge_components(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    codes = vector_codes.compress(none, keep=("label",))
    assert vector_codes.error_by(codes.rows, "label").count() == 0 and len(codes.digest()) == 64
    only = spark.createDataFrame([(1, []), (2, [])], "vec_id long, embedding array<float>")
    assert [(r.code, r.error) for r in vector_codes.compress(only).rows.collect()] == [([0, 0, 0, 0], 0)] * 2
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"))


def test_orchard_sees_what_brute_force_sees_at_ties():
    rng = np.random.default_rng(9)
    for dim, span in ((1, 5), (2, 3), (4, 2), (8, 400)):
        entries = rng.integers(-span, span + 1, size=(256, dim))  # many equal entries and distances
        x = rng.integers(-2 * span, 2 * span + 1, size=(700, dim))
        d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        codes, dist = vector_codes.Codebook(entries).nearest(x)
        assert (codes == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()


def test_errors_by_label_join_nulls(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, 0, 1), (4, 1, 2), (5, 1, 2)], "vec_id long, label int, error long")
    assert {r.vec_id: r.label_error for r in vector_codes.error_by(rows, "label").collect()} == {1: 11, 2: 11, 3: 1, 4: 4, 5: 4}


def slow_audit(docs, labels):
    def fails(i, text):
        text = text or ""
        words = [w for w in SPACE.split(text) if w]
        return {c for c, f in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
                                            any(c in "#$%&*|" for c in text), any((t or "") == text and j is not None and (i is None or j < i) for j, t, _ in docs)))
                if f}

    found = [(p or "", fails(i, t), *(any(l[0] == i and l[k] == 1 for l in labels) and i is not None for k in (1, 2))) for i, t, p in docs]
    out = {}
    for part in {f[0] for f in found}:
        own = [f for f in found if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                before = set(order[:step - 1])
                here = [f for f in own if c in f[1] and not f[1] & before]
                shapley[c] += len(here)
                out[part, "".join(order), step] = [sum(not f[1] & (before | {c}) for f in own), len(here), sum(c in f[1] and bool(f[1] & before) for f in own),
                                                   sum(f[1] == {c} for f in own), sum(f[2] for f in here), sum(f[3] for f in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_audit_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "TRIE_BYTES", 3000)  # several tries a task
    rng = random.Random(11)
    opening = "shared opening of many documents " * 60
    pool = [None, "", " ", "A", "AB", "ABC", "a b " * 150, "Ünï\U0001f600 cödé", "x$y", "Word " * 10, "long " * 30_000, " ".join(f"w{i}" for i in range(250))]
    pool += [opening + str(i) for i in range(12)] + ["".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(40)]
    docs = [(rng.randrange(300), rng.choice(pool), rng.choice([None, "", "s1", "s2"])) for _ in range(350)]
    docs += [(1000 + i, "copy", "s1") for i in range(120)] + [(None, "copy", "s2"), (None, "alone", "s2"), (None, "alone", "s2"), docs[0], docs[0]]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 1100, 3)] + [(0, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, part string, mask int").repartition(6)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
           for r in filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == slow_audit(docs, labels)
    empty = df.limit(0)
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_trie_holds_every_text_and_its_smallest_id():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(12))).encode() for _ in range(3000)] + [b"z" * 200_000, b"z" * 199_999 + b"y", b""]
    trie = filter_audit.RadixTrie()
    for i, t in enumerate(texts):
        m = trie.terminal(t, lambda: [i])
        m[0] = min(m[0], i)
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(t, i)
    assert [(t, m[0]) for t, m in trie.texts()] == sorted(want.items())
    todo = [trie.root]
    while todo:
        n = todo.pop()
        assert n is trie.root or n.terminal is not None or len(n.below) > 1
        todo.extend(n.below.values())
    trie.keep_path(b"z" * 200_000)
    assert [t for t, _ in trie.texts()] == [b"", b"z" * 200_000]


def test_prefixes_split_long_shared_openings():
    texts = ["same beginning " * 20 + f"{i:03d}" for i in range(100)] + ["other"]
    bounds = filter_audit.prefixes(texts, 10)
    assert 7 <= len(bounds) <= 9 and bounds == sorted(bounds)
    sizes = [sum(b <= t and (i + 1 == len(bounds) or t < bounds[i + 1]) for t in texts) for i, b in enumerate(bounds)]
    assert max(sizes) <= 30
    assert filter_audit.prefixes([], 5) == [] and filter_audit.prefixes(["a"], 5) == []
