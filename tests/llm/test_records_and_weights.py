"""Operators 2, 3, 6, 7 and 9."""
import io
import itertools
import random
import struct

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from fbrank.llm import chat_repair, html_extract, mixing, queries, url_filter, warc
from tools.oracle_check import digest

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[key](spark, SF)
    want = con.sql(queries.ORACLE[key])
    assert sorted(df.columns) == sorted(want.columns)
    assert digest([tuple(r) for r in df.collect()], df.columns)[0] == digest(want.fetchall(), want.columns)[0]


# 2: mixing

def test_raking_meets_the_margins(spark):
    rng = random.Random(2)
    cells = [(a, b, float(rng.randint(1, 100))) for a in ("x", "y", mixing.OTHER) for b in ("u", "v", "w")]
    df = spark.createDataFrame(cells, "m0 string, m1 string, tokens double")
    got = mixing.rake(df, {"m0": {"x": 1.0, "y": 3.0, "absent": 9.0}, "m1": {"u": 2.0, "v": 1.0, "w": 1.0}}, rounds=40).collect()
    mass = {(r.m0, r.m1): r.tokens * r.probability for r in got}
    total, natural = sum(mass.values()), {a: sum(t for x, _, t in cells if x == a) / sum(t for *_, t in cells) for a in ("x", "y", mixing.OTHER)}
    of = lambda i, k: sum(v for c, v in mass.items() if c[i] == k) / total
    rest = 1 - natural[mixing.OTHER]
    assert of(0, "x") == pytest.approx(rest / 4, abs=1e-6) and of(0, "y") == pytest.approx(rest * 3 / 4, abs=1e-6)
    assert of(1, "u") == pytest.approx(0.5, abs=1e-6) and of(1, "v") == pytest.approx(0.25, abs=1e-6)
    assert max(r.probability for r in got) == pytest.approx(1.0)


def test_a_stray_document_does_not_set_the_sample(spark):
    cells = [(f"src{i}", lang, "prose", 1000.0 + 10 * i) for i in range(4) for lang in ("en", "de")]
    margins = {"m0": {f"src{i}": 1.0 for i in range(4)}, "m1": {"en": 2.0, "de": 1.0}, "m2": {"prose": 97.0, "speech": 3.0}}
    stray = ("src3", "de", "speech", 3.0)
    df = spark.createDataFrame([*cells, stray], "m0 string, m1 string, m2 string, tokens double")
    got = mixing.rake(df, margins, rounds=200, share=0.25).collect()
    total, sampled = sum(r.tokens for r in got), sum(r.tokens * r.probability for r in got)
    assert sampled / total == pytest.approx(0.25, rel=1e-6)
    assert all(0 < r.probability <= 1 for r in got) and [r.probability for r in got if r.m2 == "speech"] == [1.0]
    for m, name in (("m0", "src0"), ("m0", "src3"), ("m1", "en"), ("m1", "de")):
        weight = margins[m][name] / sum(margins[m].values())
        assert sum(r.tokens * r.probability for r in got if r[m] == name) / sampled == pytest.approx(weight, rel=1e-6)
    _, unmet = mixing.fit([*cells, stray], margins, 200, 0.25)
    assert {u[:2] for u in unmet} == {("m2", "speech"), ("m2", "prose")}
    docs = [(k, "word " * 60, ("en", "de", "fr", "es")[k % 4], f"src{k % 20}") for k in range(4000)] + [(9999, "what? " * 60, "es", "src3")]
    mixed = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), queries.TARGETS)
    assert mixed.filter("mixed.sampled").count() > 0.1 * len(docs)


def test_raking_converges_on_sparse_cells(spark):
    rng = random.Random(5)
    cells = [(f"src{i}", lang, "prose", float(rng.randint(100, 5000))) for i in range(20) for lang in queries.LANGUAGES if rng.random() < 0.5]
    cells += [("src3", "es", "speech", 30.0), ("src3", "es", "prose", 900.0), ("src7", "de", "speech", 40.0), ("src7", "de", "markup", 5.0)]
    cells = list({c[:3]: c for c in cells}.values())
    margins = {"m0": queries.SOURCES, "m1": queries.LANGUAGES, "m2": queries.TOPICS}
    df = spark.createDataFrame(cells, "m0 string, m1 string, m2 string, tokens double")
    got = mixing.rake(df, margins).collect()  # as mix() calls it, but for the share
    total = sum(r.tokens * r.probability for r in got)
    worst = 0.0
    for m, targets in margins.items():
        there = {r[m] for r in got}
        for k in there:
            want = targets[k] / sum(targets[x] for x in there)
            worst = max(worst, abs(sum(r.tokens * r.probability for r in got if r[m] == k) / total / want - 1))
    assert worst < 1e-6
    _, unmet = mixing.fit([("a", "x", 1.0), ("b", "y", 1.0)], {"p": {"a": 1.0, "b": 3.0}, "q": {"x": 1.0, "y": 1.0}})
    assert {u[0] for u in unmet} == {"p"}  # contradicting targets end, and are reported


def test_mixing_of_odd_rows(spark):
    rows = [(1, "a b", "en", "src1", 1), (1, "a b", "en", "src1", 1), (2, None, None, None, 2), (3, "", "en", "src1", 3), (None, "x 1 2", "xx", "src2", 4), (4, "w " * 100_000, "de", "src0", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mixed int").withColumn("cell", F.lit(1)).withColumn("mix_cell", F.lit(1))
    out = mixing.mix(df, queries.TARGETS)
    assert out.columns[:-1] == df.columns
    got = out.select("doc_id", F.col(out.columns[-1]).alias("m")).collect()
    assert len(got) == 6 and all(0 < r.m.probability <= 1 for r in got)
    assert len({r.m.sampled for r in got if r.doc_id == 1}) == 1
    assert {r.doc_id: r.m.n_tokens for r in got} == {1: 2, 2: 0, 3: 0, None: 3, 4: 100_000}
    assert mixing.mix(df.limit(0), queries.TARGETS).count() == 0


def test_mixing_plan_is_native(spark):
    plan = queries.op2_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 3: extraction

def slow_cover(streams, run):
    grams = {}
    for s in {s.tobytes(): s for s in streams}.values():
        for g in {tuple(s[i : i + run]) for i in range(len(s) - run + 1)}:
            grams[g] = grams.get(g, 0) + 1
    out = []
    for s in streams:
        c = [0] * len(s)
        for i in range(len(s) - run + 1):
            for k in range(i, i + run):
                c[k] = max(c[k], grams[tuple(s[i : i + run])])
        out.append(c)
    return out


def test_cover_equals_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(25):
        phrase = rng.integers(0, 6, 14)
        streams = [np.concatenate([rng.integers(0, 6, rng.integers(0, 20)), phrase[: rng.integers(0, 15)], rng.integers(0, 6, rng.integers(0, 9))]).astype(np.int64) for _ in range(7)]
        streams.append(streams[0].copy())
        assert [c.tolist() for c in html_extract.repeated_cover(streams, 8)] == slow_cover(streams, 8)
    assert html_extract.repeated_cover([]) == [] and [len(c) for c in html_extract.repeated_cover([np.empty(0, np.int64)])] == [0]


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header><nav><a href=x>Menu</a></nav>Site</header>
<div id="cookieNotice">We use cookies</div>%s<div class="sidebar">Side</div><section class="comments"><article>A reader says hi</article></section>
<form>Mail <input name=q></form><script>var a = "<p>no</p>";</script><!-- <p>no</p> --><footer>&copy; Foot</footer></body></html>"""


def test_markup_roles():
    got = html_extract.blocks_of(PAGE % "<article><h1>Head &amp; tail</h1><p>One <b>t</b>wo&nbsp;\n three<br>four<p>fi&#118;e</p><div class=ad>Buy</div><aside>x</aside></article>")
    assert [b for b, _ in got] == ["Head & tail", "One two three", "four", "five"] and {r for _, r in got} == {html_extract.ARTICLE}
    got = html_extract.blocks_of(PAGE % "<div class=post><h1>H</h1><ul><li>a<li>b</ul>1 < 2 & 3</div>")
    assert [b for b, _ in got] == ["H", "a", "b", "1 < 2 & 3"] and {r for _, r in got} == {html_extract.OPEN}
    for odd in (None, "", " ", "<", "<p", "<!--", "<script>x", "</div></p>", "<article>"):
        assert html_extract.blocks_of(odd) in ([], [(str(odd), 0)])


def test_extraction_removes_what_a_host_repeats(spark):
    rng = random.Random(4)
    text = lambda n: " ".join("w" + str(rng.randrange(10**6)) for _ in range(n))
    line = "all the stories that are fit to print in this paper every day"
    bodies = [text(30) for _ in range(150)]
    rows = [(i, f"https://A.example/{i}", f"<body><div>{line}</div><p>{b}</p></body>", 1) for i, b in enumerate(bodies)]
    rows += [(1000 + i, f"https://b.example/{i}", f"<article><p>{b}</p><p>{line}</p></article>", 1) for i, b in enumerate(bodies[:40])]
    shared = text(60)  # a passage that some articles share stays
    rows += [(2000 + i, f"https://c.example/{i}", f"<article><p>{text(20)}</p><p>{shared if i % 3 == 0 else text(60)}</p></article>", 1) for i in range(60)]
    rows += [(3000, None, None, 1), (3001, "no host", "", 1), (None, "x://", "<p>alone</p>", 1), (None, "x://", "<p>alone</p>", 1), (3002, "https://l.example", "<p>" + "long " * 50_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int").withColumn("blocks", F.lit(1))
    got = html_extract.extract(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [by[i] for i in range(150)] == bodies and [by[1000 + i] for i in range(40)] == bodies[:40]
    assert all(shared in by[2000 + i] for i in range(0, 60, 3))
    assert by[3000] == by[3001] == "" and by[None] == "alone" and by[3002] == ("long " * 50_000).strip()
    assert html_extract.extract(df.limit(0)).count() == 0


def test_large_hosts_are_judged_as_a_whole(spark):
    rng = random.Random(11)
    text = lambda n: " ".join("w" + str(rng.randrange(10**6)) for _ in range(n))
    lines = {k: f"line {k} " + text(12) for k in (8, 12, 50)}  # on so many pages in a hundred
    for host, n in (("a", 60), ("b", 400)):
        places = {k: set(rng.sample(range(n), n * k // 100)) for k in lines}
        pages = [[(text(20), html_extract.OPEN), *((lines[k], html_extract.OPEN) for k in lines if i in places[k])] for i in range(n)]
        rows = [(i, f"https://{host}.example/{i}", "".join(f"<p>{b}</p>" for b, _ in p)) for i, p in enumerate(pages)]
        rows += [(n + i, f"https://{host}.example/{n + i}", rows[0][2] + f"<!-- {i} -->") for i in range(n)]  # equal streams count once
        got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        want = html_extract.unique_text(pages)
        assert [got[i] for i in range(n)] == want and {got[n + i] for i in range(n)} == {want[0]}
        assert {k: sum(lines[k] in t for t in want) for k in lines} == {8: n * 8 // 100, 12: 0, 50: 0}


# 6: roles

def slow_cost(roles):
    best = {chat_repair.START: 0}
    for r in roles:
        best = {t: min(c + chat_repair.step(r, s, t)[0] for s, c in best.items()) for t in range(1, chat_repair.STATES)}
    return min(best.values())


def legal(rows):
    roles = list(itertools.chain.from_iterable([*r.inserted, r.new_role] if "merge" not in r.action else [] for r in rows))
    states = [0, *(1 + chat_repair.ROLES.index(x) for x in roles)]
    return all(p in chat_repair._LEGAL for p in itertools.pairwise(states))


def test_repair_is_legal_and_cheapest(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", None]), f"{c}-{t}") for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(1000, t % 700, rng.choice(["user", "assistant"]), "x") for t in range(3000)]  # over many partitions, with ties
    rows += [(None, None, "user", None), (None, None, "user", None), (None, 2, "assistant", "<|end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x")).withColumn("row", F.lit("x"))
    out = chat_repair.repair(df)
    assert out.count() == len(rows)
    ordered = out.orderBy(F.col("conv_id").asc_nulls_last(), F.col("place")).collect()
    for conv, run in itertools.groupby(ordered, key=lambda r: r.conv_id):
        run = list(run)
        assert sum(r.cost for r in run) == slow_cost([r.role for r in run])
        assert [r.place for r in run] == list(range(len(run))) and legal(run)
        known = lambda r: (r.turn is None, r.turn or 0, r.role is None, r.role or "")
        assert [known(r) for r in run] == sorted(map(known, run))
        # every text that isn't the start of a merged part follows its own mark
        assert all(r.rendered.startswith("\n") == (r.action.startswith("merge") or r.place > 0) for r in run)
    by = {c: "".join(r.rendered for r in ordered if r.conv_id == c) for c in (0, None)}
    assert by[None].count("< |end|>") == 1 and by[None].count("<|end|>") == sum(by[None].count(f"<|{r}|>") for r in chat_repair.ROLES)
    assert chat_repair.render("user", "a", 0, 2, False)[3] + chat_repair.render("user", "b", 2, 2, False)[3] + chat_repair.render("assistant", "c", 2, 3, True)[3] == (
        "<|user|>\na\nb\n<|end|>\n<|assistant|>\nc\n<|end|>\n")
    assert chat_repair.repair(df.limit(0)).count() == 0


def test_parts_of_tied_turns_go_together_in_their_places(spark):
    for pair in itertools.product(("ax", "bx", "cx", "dx"), repeat=2):
        df = spark.createDataFrame([(1, 1, "user", pair[0]), (1, 1, "user", pair[1]), (1, 2, "assistant", "ok")], "conv_id long, turn long, role string, text string")
        whole = "".join(r.rendered for r in sorted(chat_repair.repair(df).collect(), key=lambda r: r.place))
        assert whole in {f"<|user|>\n{x}\n{y}\n<|end|>\n<|assistant|>\nok\n<|end|>\n" for x, y in (pair, pair[::-1])}


def test_repair_cut_anywhere_gives_the_same_cost():
    rng = random.Random(10)
    for _ in range(50):
        roles = [rng.choice(["system", "user", "assistant", None]) for _ in range(rng.randint(2, 12))]
        k = rng.randrange(1, len(roles))
        whole = chat_repair._matrix(roles[0])
        for r in roles[1:]:
            whole = chat_repair.min_plus(whole, chat_repair._matrix(r))
        assert whole[chat_repair.START].min() == slow_cost(roles)
        path = chat_repair.best_path(roles, 0, None)
        left = chat_repair.best_path(roles[:k], 0, path[k - 1])
        right = chat_repair.best_path(roles[k:], path[k - 1], path[-1])
        states = [0, *left, *right]
        assert sum(chat_repair.step(r, s, t)[0] for r, s, t in zip(roles, states, states[1:], strict=False)) == slow_cost(roles)


def test_given_conversations_stay_as_they_are(spark):
    got = queries.op6_chat_repair(spark, SF)
    assert got.filter("cost < 0 or rendered is null").count() == 0
    assert got.filter("action = 'keep'").count() > 0.8 * got.count()


# 7: archives

def test_archive_round_trip_and_validation():
    rng = random.Random(1)
    pages = [(i, f"http://h/{i} x\r\n", ("<p>" + " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(0, 300)))).encode(), None) for i in range(400)]
    pages += [(400, None, b"", None), (None, "u", bytes(300_000), None), (401, "u", b"y", 5)]
    out = io.BytesIO()
    out.close = lambda: None
    w = warc.ArchiveWriter(out)
    for p in pages:
        w.add(warc.build_record(*p))
    w.close()
    data = out.getvalue()
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC
    got = list(warc.read_records(io.BytesIO(data)))
    assert got == [warc.build_record(*p) for p in pages]
    for raw, (_, _, payload, refers) in zip(got, pages, strict=True):
        headers, block = warc.parse_record(raw)
        length, body = warc.parse_http(block)
        assert length == len(payload) and body == (b"" if refers else payload)
        assert headers["warc-payload-digest"] == "sha1:" + warc.digest_of(payload)
    for bad in (data[:-3], data[:6], b"nonsense", data[: len(data) // 2]):
        with pytest.raises((warc.WarcError, zstandard.ZstdError)):
            list(warc.read_records(io.BytesIO(bad)))
    for bad in (got[0][:-1], got[0] + b"x", got[0].replace(b"WARC/1.1", b"WARC/9.9", 1), got[0].replace(b"Content-Length", b"Content Length", 1), got[0].replace(b"<p>", b"<q>", 1)):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    assert list(warc.read_records(io.BytesIO(b""))) == []


def test_archives_of_odd_rows(spark):
    rows = [(3, "u", "same", 1), (2, None, "same", 1), (2, None, "same", 1), (9, "u", None, 1), (8, "u", "", 1), (None, "u", "same", 1), (7, "u\n", "é" * 200_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").withColumn("sha", F.lit(1))
    got = sorted([(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()], key=str)
    assert got == sorted([(3, 4, "revisit", 2), (2, 4, "response", None), (2, 4, "response", None), (9, 0, "revisit", 8), (8, 0, "response", None),
                          (None, 4, "response", None), (7, 400_000, "response", None)], key=str)
    assert {r.record_type for r in warc.round_trip(df, min_bytes=5).collect()} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0


# 9: URLs

def test_url_rules(spark):
    urls = ["http://a.net/x", "http://net/", "http://a.NET", "http://xnet/", "https://b.example.net/en/1?q", "https://example.net/fr/", "ftp://example.com/de/x#y",
            "http://EXAMPLE.com/DE/x", "http://q.org/fr/", None, "", "no scheme/net/", "://?a", "http://a.net/x", "http://h/" + "p" * 50_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("text", F.lit(1))
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert len(got) == len(urls)
    want = {0: ("net/", "block"), 1: ("net/", "block"), 4: ("example.net/en/", "allow"), 5: ("net/", "block"), 6: ("example.com/de/", "block"), 8: ("org/fr/", "allow"), 13: ("net/", "block")}
    for i, r in got.items():
        assert (r.rule, r.verdict) == want[i] if i in want else r.rule is None and r.verdict in ("allow", "block")
    assert (got[2].host, got[2].path) == ("a.net", "") and (got[7].host, got[7].path) == ("example.com", "/DE/x")
    assert all((got[i].host, got[i].path) == ("", "") for i in (9, 10, 11, 12))
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    plan = queries.op9_url_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert {r.verdict for r in url_filter.filter_urls(df.filter("page_id in (8, 9)")).collect()} == {"allow"}
