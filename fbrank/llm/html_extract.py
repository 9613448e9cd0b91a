"""Main text of web pages: markup roles, and a suffix array per host for what markup leaves open.

A page's html becomes blocks of text.  Markup decides what it can: blocks in menus, headers,
footers, sidebars, forms, scripts, notices, adverts or reader comments are out; the others are
``article`` blocks (inside ``<article>`` or ``<main>``) or ``open`` ones.

The blocks of a host's pages, as streams of words, are concatenated and their suffixes sorted by
prefix doubling.  Runs of ``RUN`` or more words that occur on several distinct pages are
boilerplate; words they cover go and unique runs stay.  Open words go if a run is on a tenth of the
pages (three at least).  Inside an article only whole blocks that most pages of the host share go,
so that passages which some pages have in common, quotes and near copies stay.  Pages with equal
streams count as one.  Sorting by the first ``RUN`` words is enough: a longer repeat is a chain of
repeats of that length, and covers the same words.

A host of up to ``PAGES`` pages is one group.  The distinct streams of a larger one are dealt into
groups of about ``PAGES`` to find its runs: a run on a tenth of the host's streams is on a tenth of
the streams of some group, so groups name every candidate.  Candidates are then counted over all
distinct streams of the host, and each page is cut by the host's counts alone.  Runs and streams are
known by 64-bit hashes there.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fbrank.llm.frames import ascii_lower, column, settled

RUN = 8
PAGES = 64
#: hosts with more than PAGES pages: up to so many, which is counted first, are broadcast (some 50 MB); more are joined by a shuffle
BIG_HOSTS = 500_000
#: runs of all hosts together, counted first, that are broadcast (some 80 MB); more are joined by a shuffle
BIG_RUNS = 5_000_000
OPEN_PAGES, OPEN_SHARE = 3, 0.1
ARTICLE_PAGES, ARTICLE_SHARE = 8, 0.5

#: every alternative takes what it has looked at, also where nothing closes it, so a page is read once; a tag without its
#: ``>`` (the last group is empty or a quotation mark that nothing closes) is text
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|math|iframe|object|select|title)\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>?)", re.S | re.I)
_CDATA = "<![CDATA["
_ZEROS, _LONG_NUMBER = re.compile(r"&#0{7,}"), re.compile(r"&#0*+[0-9]{8,}")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT_TAGS = frozenset("nav footer aside form button dialog menu head".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
OUT_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets related recommended "
    "recommendations ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup share sharing social comment comments commentlist "
    "disqus reply replies respond login search toolbar pagination pager skip disclaimer outbrain taboola".split())
#: words whose elements hold articles of their own that are out
OUT_ARTICLES = frozenset("comment comments commentlist disqus reply replies related recommended recommendations ad ads advert adverts sponsored promo outbrain taboola".split())
#: what may stand beside such a word in one class or id; with any other word, as in has-sidebar or share-price, it says nothing about the element
PLAIN_WORDS = frozenset(
    "site page main global body primary secondary top bottom left right upper lower inner outer center middle first last small large big sticky fixed floating "
    "mobile desktop box block bar wrap wrapper container area section region module panel row column col slot unit holder group list item items entry "
    "entries link links button buttons btn icon icons form field input title heading label text content body post posts article articles story stories "
    "blog user users author reader count counter thread tree toggle nested level children child parent meta info tools tool "
    "google media image img video email mail alert accept message more".split())
#: an open element of the left kind ends where one of the right kinds begins
_ENDS = {"p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article main header footer nav aside form blockquote pre hr figure address fieldset".split()),
         "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
         "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"])}

#: an article inside an element that is out by its class or id is ``WRAPPED``
WRAPPED, ARTICLE, OPEN = 2, 1, 0


def _named(value: str, words: frozenset[str]) -> bool:
    """Whether a class or id names one of the words: alone or beside plain ones (``site-footer``, not ``has-sidebar``)."""
    for name in value.split():
        parts = _PARTS.findall(_CAMEL.sub(" ", name).lower())
        if not words.isdisjoint(parts) and all(p in words or p in OUT_WORDS or p in PLAIN_WORDS or p.isdigit() for p in parts):
            return True
    return False


IN, SOFT, HARD = 0, 1, 2


def _is_out(tag: str, attributes: str, in_article: bool) -> int:
    """``HARD`` if the element is out for good; ``SOFT`` for forms and by class or id, which an article inside may outweigh."""
    if len(attributes) <= 200:
        return _out_kept(tag, attributes, in_article)
    return _out(tag, attributes, in_article)


def _out(tag: str, attributes: str, in_article: bool) -> int:
    if tag in OUT_TAGS or tag == "header" and not in_article:
        return SOFT if tag == "form" else HARD
    if not attributes.strip(" /"):
        return IN
    found = IN
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            if tag == "article":
                if _named(value, OUT_ARTICLES):
                    return HARD
            elif tag not in ("body", "html", "main") and not (in_article and tag in ("header", "h1", "h2")) and _named(value, OUT_WORDS):
                if _named(value, OUT_ARTICLES):
                    return HARD
                found = SOFT
        elif name == "role":
            if value.lower() in OUT_ROLES:
                return HARD
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return HARD
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HARD
    return found


_out_kept = lru_cache(maxsize=20_000)(_out)  # templates repeat their tags; at most 200 characters each


def _text(pieces: list[str]) -> str:
    text = "".join(pieces)
    if "&" in text:
        # a number that no character has, however long, is the replacement character
        text = entities.unescape(_LONG_NUMBER.sub("&#1114112", _ZEROS.sub("&#0", text)) if "&#" in text else text)
    return " ".join(text.split())


def blocks_of(page: str | None) -> list[tuple[str, int]]:
    """Text blocks in page order that markup doesn't rule out, each with ``ARTICLE`` or ``OPEN``.

    If the page has article blocks, its open ones are not part of the article and are left out.  An article inside
    an element that is out by its class or id, or inside a form, counts where the page has no other: then the class
    was that of a wrapper around the whole page.  Time and memory are linear in the page, well formed or not."""
    page = page or ""
    closed = page.rfind("]]>") + 1
    if page.find(_CDATA, closed) >= 0:  # nothing closes these: comments up to the next ``>``, as browsers read them
        page = page[:closed] + page[closed:].replace(_CDATA, "<!-CDATA[")
    stack: list[tuple[str, int, int]] = []  # tag, text is out, role of text
    standing: dict[str, int] = {}  # open elements by tag
    out, role = IN, OPEN
    found: list[tuple[str, int]] = []
    piece: list[str] = []
    at = 0

    def flush() -> None:
        if piece:
            text = _text(piece)
            if text:
                found.append((text, role))
            piece.clear()

    def pop(k: int) -> None:
        for name, _, _ in stack[k:]:
            standing[name] -= 1
        del stack[k:]

    for m in _TOKEN.finditer(page):
        if not out and m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        if not m[5]:
            at = m.start()
            continue
        tag = tag.lower()
        if tag not in INLINE and not out:
            flush()
        if m[2]:
            if standing.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop(k)
                out, role = (stack[-1][1], stack[-1][2]) if stack else (IN, OPEN)
            continue
        if tag in VOID:
            continue
        while stack and tag in _ENDS.get(stack[-1][0], ()):
            pop(len(stack) - 1)
        out, role = (stack[-1][1], stack[-1][2]) if stack else (IN, OPEN)
        if m[4].endswith("/") and tag not in INLINE and tag not in OUT_TAGS:
            continue
        was, here = role, max(out, _is_out(tag, m[4], role != OPEN))
        now = role
        if (tag in ("article", "main") or 'role="main"' in m[4]) and here != HARD:
            if out == SOFT:
                now, here = WRAPPED, IN
            elif not here and role == OPEN:
                now = ARTICLE
        if here or now != was:
            flush()
        out, role = here, now
        stack.append((tag, out, role))
        standing[tag] = standing.get(tag, 0) + 1
    if not out and at < len(page):
        piece.append(page[at:])
    flush()
    return [b for b in found if b[1] == ARTICLE] or [(t, ARTICLE) for t, r in found if r == WRAPPED] or found


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` tokens, by prefix doubling (``depth`` a power of two)."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    h, n = 1, len(tokens)
    while h < depth:
        after = np.zeros(n, np.int64)
        after[: max(n - h, 0)] = rank[h:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        h *= 2
    return rank


def _spread(streams: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the concatenated ``streams``, each ended by a separator: the tokens, the suffixes' ranks, whether a
    whole run starts there, and per rank on how many streams it occurs."""
    top = 1 + max((int(s.max()) for s in streams if len(s)), default=0)
    # one separator of its own ends each stream, so no run that counts goes over a border
    text = np.concatenate([np.append(s, top + i) for i, s in enumerate(streams)]) if streams else np.empty(0, np.int64)
    page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    rank = suffix_ranks(text, run)
    whole = np.zeros(len(text), bool)
    ends = np.cumsum([len(s) + 1 for s in streams]) - 1
    if len(text):
        whole = np.arange(len(text)) + run <= ends[page]
    pairs = np.unique(rank[whole] * (len(streams) + 1) + page[whole])
    return text, rank, whole, np.bincount(pairs // (len(streams) + 1), minlength=int(rank.max()) + 1 if len(rank) else 0)


def _covered(here: np.ndarray, run: int) -> np.ndarray:
    """Per token the largest of ``here`` at the starts of the runs through it."""
    cover = here.copy()
    for shift in range(1, run):
        cover[shift:] = np.maximum(cover[shift:], here[:-shift])
    return cover


def repeated_cover(streams: list[np.ndarray], run: int = RUN) -> list[np.ndarray]:
    """Per token of each stream, on how many distinct streams the most wide-spread run of ``run`` tokens through it occurs.

    Equal streams count as one.  0 where no run reaches over the token (streams shorter than a run)."""
    seen: dict[bytes, int] = {}
    which = [seen.setdefault(s.tobytes(), k) for k, s in enumerate(streams)]
    kept = [k for k in range(len(streams)) if which[k] == k]
    _, rank, whole, spread = _spread([streams[k] for k in kept], run)
    cover = _covered(np.where(whole, spread[rank] if len(rank) else 0, 0), run)
    at, by = 0, {}
    for k in kept:
        by[k] = cover[at : at + len(streams[k])]
        at += len(streams[k]) + 1
    return [by[w] for w in which]


def _cut(page: list[tuple[str, int]], words: list[list[str]], cover: np.ndarray, distinct: int) -> str:
    """The page's text without what ``cover`` shows to be boilerplate on a host of ``distinct`` streams."""
    wide = max(OPEN_PAGES, OPEN_SHARE * distinct)
    site = max(ARTICLE_PAGES, ARTICLE_SHARE * distinct)
    at, kept = 0, []
    for (text, role), block in zip(page, words, strict=True):
        c = cover[at : at + len(block)]
        at += len(block)
        if role == ARTICLE:
            if c.min() < site:
                kept.append(text)
        elif (c < wide).all():
            kept.append(text)
        elif (c < wide).any():
            kept.append(" ".join(w for w, n in zip(block, c, strict=True) if n < wide))
    return " ".join(kept)


def unique_text(pages: list[list[tuple[str, int]]]) -> list[str]:
    """The pages' texts without what is boilerplate among them."""
    ids: dict[str, int] = {}
    words = [[b.split(" ") for b, _ in p] for p in pages]
    streams = [np.array([ids.setdefault(w, len(ids)) for b in p for w in b], np.int64) for p in words]
    distinct = len({s.tobytes() for s in streams})
    return [_cut(p, w, c, distinct) for p, w, c in zip(pages, words, repeated_cover(streams), strict=True)]


def _hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False) if words else np.empty(0, np.uint64)


def run_hashes(hashes: np.ndarray, run: int = RUN) -> np.ndarray:
    """A hash of the ``run`` words from each place on where so many are left, from the words' hashes."""
    n = max(len(hashes) - run + 1, 0)
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(run):
        out = (out ^ hashes[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _stream(page: str | None) -> tuple[str, int]:
    """The page's words joined by spaces, and their hash."""
    text = " ".join(b for b, _ in blocks_of(page))
    return text, int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("role", pa.int8())]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            blocks = [[{"text": t, "role": r} for t, r in blocks_of(h)] for h in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(blocks, _BLOCKS)], names=["page_id", "url", "host", "blocks"])


def _extract(table: pa.Table) -> pa.Table:
    pages = [[(b["text"], b["role"]) for b in p] for p in table.column("blocks").to_pylist()]
    return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(unique_text(pages), pa.string())})


_STREAMS = "host string, part long, stream long, words string"
_RUNS = "host string, run long, n long"
_FOUND = "host string, stream long, runs array<long>"


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, str, str, int]]]]:
    """Per piece of a batch of ``host, html, ...`` the rows whose stream is new to the task: place, host, words, hash."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            new = []
            for k, (host, page) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                words, stream = _stream(page)
                if (host, stream) not in seen:
                    seen.add((host, stream))
                    new.append((k, host, words, stream))
            yield part, new


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, new in _once(batches):
        parts = part.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([h for _, h, _, _ in new], pa.string()), pa.array([s % parts[k] for k, _, _, s in new], pa.int64()),
                                          pa.array([s for *_, s in new], pa.int64()), pa.array([w for _, _, w, _ in new], pa.string())], names=["host", "part", "stream", "words"])


def _candidates(table: pa.Table) -> pa.Table:
    """Runs on ``OPEN_SHARE`` of the group's distinct streams, and a row without run for the number of these."""
    texts = dict(zip(table.column("stream").to_pylist(), table.column("words").to_pylist(), strict=True))
    ids: dict[str, int] = {}
    streams = [np.array([ids.setdefault(w, len(ids)) for w in t.split(" ")] if t else [], np.int64) for t in texts.values()]
    text, rank, whole, spread = _spread(streams, RUN)
    ranks, first = np.unique(rank[whole], return_index=True)
    often = spread[ranks] >= OPEN_SHARE * len(streams)
    starts = np.flatnonzero(whole)[first[often]]
    words = _hashes(list(ids))
    runs = run_hashes(words[text[starts[:, None] + np.arange(RUN)]].ravel())[::RUN] if len(starts) else np.empty(0, np.int64)
    host = table.column("host")[0].as_py()
    return pa.table({"host": pa.array([host] * (len(runs) + 1), pa.string()), "run": pa.array([None, *runs.tolist()], pa.int64()),
                     "n": pa.array([len(streams), *spread[ranks[often]].tolist()], pa.int64())})


def _per_host(part: pa.RecordBatch, *names: str) -> dict[str, tuple]:
    """The values of columns that are the same on all rows of a host."""
    first: dict[str, int] = {}
    for k, host in enumerate(part.column("host").to_pylist()):
        first.setdefault(host, k)
    return {h: tuple(part.column(n)[k].as_py() for n in names) for h, k in first.items()}


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, new in _once(batches):
        runs = {h: np.array(r, np.int64) for h, (r,) in _per_host(part, "runs").items()}
        out = []
        for _, host, words, stream in new:
            here = np.unique(run_hashes(_hashes(words.split(" ") if words else [])))
            if len(here := here[np.isin(here, runs[host])]):
                out.append((host, stream, here.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in out], pa.string()), pa.array([s for _, s, _ in out], pa.int64()),
                                          pa.array([r for *_, r in out], pa.list_(pa.int64()))], names=["host", "stream", "runs"])


def _cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            known = {}
            for host, (often, distinct) in _per_host(part, "often", "streams").items():
                pairs = np.array(sorted((x["run"], x["n"]) for x in often or ()), np.int64).reshape(-1, 2)
                known[host] = pairs[:, 0], pairs[:, 1], distinct
            out = []
            for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                page = blocks_of(html)
                runs, counts, distinct = known[host]
                words = [b.split(" ") for b, _ in page]
                here = np.zeros(sum(map(len, words)), np.int64)
                if len(runs):
                    own = run_hashes(_hashes([w for b in words for w in b]))
                    at = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
                    here[: len(own)] = np.where(runs[at] == own, counts[at], 0)
                out.append(_cut(page, words, _covered(here, RUN), distinct))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def _with_runs(rows: DataFrame, table: DataFrame, total: int, how: str) -> DataFrame:
    return rows.join(F.broadcast(table) if total <= BIG_RUNS else table, "host", how)


def _extract_large(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """``page_id, url, text`` of the pages of large hosts (``parts``: the number of a host's groups)."""
    dealt = rows.select("host", "html", "parts").mapInArrow(_streams, _STREAMS)
    named = settled(dealt.groupBy("host", "part").applyInArrow(_candidates, _RUNS))
    streams = named.filter("run is null").groupBy("host").agg(F.sum("n").alias("streams"))
    asked = named.filter("run is not null").groupBy("host").agg(F.collect_set("run").alias("runs"))
    total = named.filter("run is not null").select("host", "run").distinct().count()
    found = _with_runs(rows.select("host", "html"), asked, total, "inner").mapInArrow(_found, _FOUND)
    counts = (found.groupBy("host", "stream").agg(F.first("runs").alias("runs")).select("host", F.explode("runs").alias("run"))
              .groupBy("host", "run").agg(F.count("*").alias("n")).join(streams, "host")
              .filter(F.col("n") >= F.greatest(F.lit(float(OPEN_PAGES)), F.lit(OPEN_SHARE) * F.col("streams"))))
    often = counts.groupBy("host").agg(F.collect_list(F.struct("run", "n")).alias("often"))
    known = streams.join(often, "host", "left")
    return _with_runs(rows.select("page_id", "url", "host", "html"), known, total, "left").select("page_id", "url", "host", "html", "often", "streams").mapInArrow(
        _cut_all, f"page_id {kinds[0]}, url {kinds[1]}, text string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars``.

    Character references are decoded, white space inside a block is one space, blocks are joined
    by one space.  A null or empty page, or one without main text, has the empty text.  Pages
    whose url is null or has no host count as pages of one host.  Repeated rows give equal texts.
    Other columns are not read."""
    url, body = column(pages, url_col), column(pages, html_col).cast("string")
    host = ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))
    rows = pages.select(column(pages, id_col).alias("page_id"), url.alias("url"), host.alias("host"), body.alias("html"))
    each = rows.groupBy("host", F.xxhash64("html").alias("copy")).agg(F.count("*").alias("n"))
    big = settled(each.groupBy("host").agg(F.sum("n").alias("n"), F.count("*").alias("copies")).filter(F.col("n") > PAGES)
                  .select("host", F.ceil(F.col("copies") / F.lit(PAGES)).alias("parts")))
    kinds = [f.dataType.simpleString() for f in rows.schema.fields]
    n_big = big.count()
    if n_big <= BIG_HOSTS:
        big = F.broadcast(big)
    parsed = rows.join(big, "host", "left_anti").select("page_id", "url", "host", "html").mapInArrow(_parse, f"page_id {kinds[0]}, url {kinds[1]}, host string, blocks array<struct<text:string,role:tinyint>>")
    out = parsed.groupBy("host").applyInArrow(_extract, f"page_id {kinds[0]}, url {kinds[1]}, text string")
    if n_big:
        out = out.unionByName(_extract_large(rows.join(big, "host"), kinds))
    return out.withColumn("n_chars", F.length("text").cast("long"))
