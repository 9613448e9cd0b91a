"""URL filter: rules, and for the rest a ratio of two character language models.

URLs that a rule allows train the model of accepted URLs, URLs that a rule blocks that of rejected
ones.  Each is a Markov model of variable order: the estimate after two characters is smoothed
with that after one, and that with the plain frequency.  A URL's score is the difference of its
log-likelihoods per character.  The cut between the classes is where both are equally many
standard deviations from their means over the rule-matched URLs.

DataFrame operations only.  Characters are folded to an alphabet of 34, so the table of trigrams
has at most 34**3 rows whatever the input; it is broadcast under that bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fbrank.llm.frames import ascii_lower, column, settled

#: (rule, verdict): host and path from the first slash on
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
WEIGHT = 5.0
ALPHABET = 34
NATS = 1_000_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty if the url is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``struct<length, rule, verdict>`` of the longest rule that fits, null if none does."""
    fits = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        here = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        fits.append(F.when(here, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def folded(host: Column, path: Column) -> Column:
    """Host and path in the models' alphabet, with two marks before and one behind."""
    text = F.regexp_replace(F.regexp_replace(ascii_lower(F.concat(host, path)), "[0-9]", "0"), r"[^a-z0./_\-]", "?")
    return F.concat(F.lit("^^"), text, F.lit("$"))


def _trigrams(text: Column) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))


def trigram_model(urls: DataFrame) -> DataFrame:
    """``gram, llr`` (millionths of a nat) from rows ``text, good, bad`` (1 where a rule allowed or blocked)."""
    grams = urls.select("good", "bad", _trigrams(F.col("text")).alias("gram")).groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    grams = settled(grams)  # at most ALPHABET ** 3 rows

    def sums(key: Column, tag: str) -> DataFrame:
        return grams.groupBy(key.alias(tag)).agg(F.sum("good").alias("good_" + tag), F.sum("bad").alias("bad_" + tag))

    out = grams.select("*", F.substring("gram", 1, 2).alias("ab"), F.substring("gram", 2, 1).alias("b"),
                       F.substring("gram", 2, 2).alias("bc"), F.substring("gram", 3, 1).alias("c"))
    for key, tag in ((F.substring("gram", 1, 2), "ab"), (F.substring("gram", 2, 1), "b"), (F.substring("gram", 2, 2), "bc"), (F.substring("gram", 3, 1), "c")):
        out = out.join(F.broadcast(sums(key, tag)), tag)  # fewer rows than the bounded table
    total = grams.agg(F.sum("good").alias("good_all"), F.sum("bad").alias("bad_all"))
    out = out.withColumn("good_all", total.select("good_all").scalar()).withColumn("bad_all", total.select("bad_all").scalar())

    def p(kind: str) -> Column:
        one = (F.col(kind + "_c") + 1.0) / (F.col(kind + "_all") + float(ALPHABET))
        two = (F.col(kind + "_bc") + WEIGHT * one) / (F.col(kind + "_b") + WEIGHT)
        return (F.col(kind) + WEIGHT * two) / (F.col(kind + "_ab") + WEIGHT)

    return out.select("gram", F.round(F.log(p("good") / p("bad")) * NATS).cast("long").alias("llr"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, score``.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins
    and its verdict stands.  Other URLs are allowed if their score reaches the cut; without rule-matched
    URLs of both kinds there is no cut and they are allowed.  A null URL or one without ``://`` has
    empty host and path and is scored as an empty text.  Repeated URLs are judged alike and count
    once in the models.  ``rules`` is a short configured list."""
    host, path = host_path(column(pages, url_col))
    rows = pages.select(column(pages, id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).withColumn("text", folded(F.col("host"), F.col("path")))
    rows = rows.select("page_id", "host", "path", "text", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("by_rule"))
    urls = rows.groupBy("text").agg(F.max(F.when(F.col("by_rule") == "allow", 1).otherwise(0)).alias("good"),
                                    F.max(F.when(F.col("by_rule") == "block", 1).otherwise(0)).alias("bad"))
    urls = settled(urls)
    model = trigram_model(urls)
    scored = settled(urls.select("text", "good", "bad", _trigrams(F.col("text")).alias("gram")).join(F.broadcast(model), "gram")
                     .groupBy("text", "good", "bad").agg((F.sum("llr") / F.count("*") / float(NATS)).alias("score")))

    def stat(kind: str) -> tuple[Column, Column]:
        of = F.when(F.col(kind) == 1, F.col("score"))
        return F.avg(of), F.coalesce(F.stddev_pop(of), F.lit(0.0)) + 1e-9

    (mg, sg), (mb, sb) = stat("good"), stat("bad")
    cut = scored.agg(((mg * sb + mb * sg) / (sg + sb)).alias("cut"))
    marked = scored.select("text", "score", F.coalesce(F.col("score") >= cut.scalar(), F.lit(True)).alias("fine"))
    return rows.join(marked, "text").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("fine"), "allow").otherwise("block")).alias("verdict"), "score")
