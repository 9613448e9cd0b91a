"""Operators 5 and 8, and components."""
import random

import numpy as np
from pyspark.sql import functions as F

from fbrank.llm import embedding_dedup, setsketch
from fbrank.llm.components import connected_components


def slow_components(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 70)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (7, 6)]
    links += [(2000 + rng.randrange(200), 2000 + rng.randrange(200)) for _ in range(180)]
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = slow_components({x for p in links for x in p}, links)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert connected_components(df.limit(0)).count() == 0


def slow_set(text, k=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in " ".join(w)).split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_texts(rng, n, edits):
    base = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(120)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = "z" + str(rng.randrange(10**6))
        yield " ".join(w)


def slow_near(docs, percent):
    sets = {d: slow_set(t) for d, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in slow_components(sets, links).items()}


def test_near_duplicates_equal_brute_force_also_over_tiles(spark):
    rng = random.Random(7)
    docs = [(i, t) for i, t in enumerate([*near_texts(rng, 70, 6), *near_texts(rng, 20, 3), "a b c", "A  b\tc", "a b c d e", "a b c d e", "a b c d e f"])]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("rep", F.lit(1))
    for percent, tile in ((85, setsketch.TILE), (85, 8), (80, 1024)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(df, percent=percent, tile=tile).collect()}
        assert got == slow_near(docs, percent)


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"w{i % 9000}" for i in range(60_000))
    rows = [(5, None), (4, ""), (4, " \n"), (None, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"), (8, "a b c d e f"), (2, long), (1, long + " end"), (3, "A B C D E F\x0b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(3)).withColumn("__kept_id", F.lit(3))
    got = sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in setsketch.near_duplicates(df).collect()], key=str)
    assert got == sorted([(5, 0, 5, True), (4, 0, 4, True), (4, 0, 4, True), (None, 2, None, True), (9, 2, 3, False), (9, 2, 3, False), (8, 2, 3, False),
                          (2, 9000, 1, False), (1, 9001, 1, True), (3, 2, 3, True)], key=str)
    kept = setsketch.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, 4, 5, None]  # the two blank texts of id 4 differ
    assert setsketch.near_duplicates(df.limit(0)).count() == 0


def test_ids_repeated_over_different_texts_keep_their_buckets(spark):
    rng = random.Random(9)
    families = [list(near_texts(rng, 2, 2)) for _ in range(12)]
    rows = [(i % 4, t) for i, two in enumerate(families) for t in two] + [(100 + i, two[0] + " z") for i, two in enumerate(families)]
    got = {(r.doc_id, r.component_id) for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i % 4, i % 4) for i in range(12)} | {(100 + i, i % 4) for i in range(12)}


def test_each_pair_belongs_to_its_first_shared_band():
    rng = np.random.default_rng(4)
    for percent in (80, 20):  # the second has a register a band, 144 bands
        rows = setsketch.band_rows(percent)
        keys = np.array([setsketch.band_keys(r, rows) for r in rng.integers(0, 3, (12, setsketch.M)).astype(np.uint8)])
        home = np.zeros((12, 12), int)
        for band in {int(x) for x in keys.ravel()}:
            held = (keys == band).any(axis=1)
            home += setsketch.belongs(keys, keys, band) & held[:, None] & held[None, :]
        assert (home == (keys[:, None] == keys[None]).any(axis=2)).all()


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**64, size=3000, dtype=np.uint64)
    a, b = h[:2000], h[1000:]
    ra, rb = setsketch.registers(a), setsketch.registers(b)
    assert (setsketch.merge_registers(ra, rb) == setsketch.registers(h)).all()
    above, below = (ra > rb).sum(), (ra < rb).sum()
    grid = np.linspace(0.01, 0.99, 99)
    best = grid[np.argmax([setsketch.log_likelihood(j, above, below, 2000.0, 2000.0) for j in grid])]
    assert abs(best - 1 / 3) < 0.15
    assert (np.sort(setsketch.unpack(setsketch.pack(np.sort(h)))) == np.sort(h) >> np.uint64(16)).all()


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    for percent in (80, 85):
        rows, missed = setsketch.band_rows(percent), 0
        for _ in range(300):
            h = rng.integers(0, 2**64, size=400, dtype=np.uint64)
            extra = int(400 * (1 - percent / 100) / 2)
            a, b = h[extra:], h[: 400 - extra]
            ka, kb = (setsketch.band_keys(setsketch.registers(x), rows) for x in (a, b))
            missed += not (ka == kb).any()
        assert missed == 0


def test_tile_links_are_exact_near_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    t = rng.normal(size=a.shape)
    t -= (t * a).sum(axis=1)[:, None] * a
    t /= np.linalg.norm(t, axis=1)[:, None]
    cos = 0.95 + rng.uniform(-0.01, 0.01, size=300) * rng.choice([1, 1e-4, 1e-7], size=300)
    b = cos[:, None] * a + np.sqrt(1 - cos**2)[:, None] * t
    want = np.einsum("id,jd->ij", a, b) >= 0.95
    assert (embedding_dedup.tile_links(a, b, 0.95) == want).all()


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 16))
    v = np.concatenate([b + rng.normal(size=(9, 16)) * s for b, s in zip(base, np.linspace(0.05, 0.4, 12), strict=True)])
    v[5] = v[4]
    rows = [(int(i), [float(x) for x in r]) for i, r in zip(rng.permutation(len(v)), v, strict=True)]
    unit = {i: np.array(r) / np.linalg.norm(r) for i, r in rows}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.95]
    want = slow_components(unit, links)
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [1.0] * 3), (906, [2.0] * 3), (None, [1.0] * 3),
           (907, [1e-200, 0.0]), (908, [1e200, 0.0]), (909, [float("inf"), 0.0]), (910, [-0.0, 1.0]), (911, [0.0, 1.0]), (911, [0.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("dim", F.lit("x")).withColumn("rep", F.lit(0))
    for tile in (embedding_dedup.TILE, 16):
        got = embedding_dedup.near_vectors(df, tile=tile).collect()
        by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
        assert len(got) == len(rows) + len(odd)
        for i, c in want.items():
            assert by[i] == (sum(i in p for p in links), c, i == c)
        for i in (900, 901, 902, 903, 904, 909):
            assert by[i] == (0, i, True)
        assert by[905] == (1, 905, True) and by[906] == (1, 905, False) and by[None] == (0, None, True)
        assert by[907] == (1, 907, True) and by[908] == (1, 907, False) and by[910] == (2, 910, True) and by[911] == (2, 910, False)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
