"""The queries ``opN_<name>`` over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fbrank.llm import (chat_repair, decontaminate, embedding_dedup, filter_audit, html_extract, mixing, quality, rule_ledger,
                        setsketch, token_count, url_filter, vector_codes, warc)

from fbrank.llm.frames import LOWER, UPPER

#: target weights of the mixture; categories that are not listed keep their natural share
SOURCES = {f"src{i}": 1.5 if i == 0 else 1.0 for i in range(20)}
LANGUAGES = {"en": 50.0, "de": 18.0, "fr": 18.0, "es": 14.0}
TOPICS = {"prose": 92.0, "markup": 4.0, "speech": 3.0, "numeric": 1.0}
TARGETS = {"source": SOURCES, "lang": LANGUAGES, "topic": TOPICS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), TARGETS)
    return mixed.select("doc_id", "mixed.topic", "mixed.n_tokens", F.round("mixed.probability", 6).alias("probability"), "mixed.sampled")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rule_ledger.ledger(table(spark, sf_dir, "documents"))
    measured = [F.col(f"ledger.{c}").cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    base, kept = (rule_ledger.passes(F.col("ledger.failed"), v) for v in ("base", rule_ledger.CURRENT))
    return found.select("doc_id", *measured, (~base).alias("base_failed"), (base & kept).alias("kept"), F.col("ledger.failed").alias("failed"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.compress(table(spark, sf_dir, "embeddings"), keep=("label",))
    rows = codes.rows.withColumn("code", F.concat_ws("", F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))))
    return vector_codes.error_by(rows, "label").select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_mixing, op3_html_extraction, op4_token_counts, op5_embedding_dedup,
                                   op6_chat_repair, op7_warc, op8_minhash_dedup, op9_url_filter, op10_quality, op11_quality_rules, op12_vector_codes,
                                   op13_filter_audit)}

_AZ = f"'{UPPER}', '{LOWER}'"

_OP1 = rf"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id,
                   coalesce(regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), {decontaminate.WINDOW}) - 1], ' ') AS k, least(len(w), {decontaminate.WINDOW}) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {decontaminate.WINDOW} + 1, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT rid, i, g.n, item_id FROM dg g JOIN win USING (k, n)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""


def _mixing_sql() -> str:
    def count(chars: str) -> str:
        return f"len(regexp_extract_all(text, '{chars}'))"

    def values(targets: dict[str, float]) -> str:
        return ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in targets.items())

    def listed(c: str, targets: dict[str, float]) -> str:
        return f"CASE WHEN {c} IN ({', '.join(repr(k) for k in targets)}) THEN {c} ELSE 'other' END"

    names = list(TARGETS)
    sql = [rf"""WITH d AS (SELECT doc_id, text, source, lang, CASE WHEN {count(mixing.DIGITS)} * 50 > length(text) THEN 'numeric'
        WHEN {count(mixing.SYMBOLS)} * 50 > length(text) THEN 'markup' WHEN {count(mixing.SPEECH)} * 200 > length(text) THEN 'speech' ELSE 'prose' END AS topic,
        coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0)::BIGINT AS n_tokens FROM documents)""",
           "c AS MATERIALIZED (SELECT *, " + ", ".join(f"{listed(n, t)} AS c_{n}" for n, t in TARGETS.items()) + " FROM d)"]
    cells = ", ".join(f"c_{n}" for n in names)
    sql.append(f"cells AS MATERIALIZED (SELECT {cells}, sum(n_tokens)::DOUBLE AS tokens FROM c GROUP BY ALL)")
    sql.append("n0 AS (SELECT *, tokens / (SELECT sum(tokens) FROM cells) AS w_nat FROM cells)")
    for n, t in TARGETS.items():
        sql.append(f"s_{n} AS (SELECT c_{n}, sum(w_nat) AS share FROM n0 GROUP BY 1 HAVING sum(w_nat) > 0)")
        sql.append(f"""t_{n} AS (SELECT s.c_{n}, CASE WHEN s.c_{n} = 'other' THEN share ELSE v.w / (SELECT sum(w) FROM (VALUES {values(t)}) q(k, w)
            WHERE k IN (SELECT c_{n} FROM s_{n})) * (1 - coalesce((SELECT share FROM s_{n} WHERE c_{n} = 'other'), 0)) END AS target
            FROM s_{n} s LEFT JOIN (VALUES {values(t)}) v(k, w) ON v.k = s.c_{n})""")
    sql.append("w0 AS MATERIALIZED (SELECT *, w_nat AS w FROM n0 WHERE w_nat > 0)")
    k = 0
    for _ in range(mixing.ROUNDS):
        for n in names:
            sql.append(f"w{k + 1} AS MATERIALIZED (SELECT x.* REPLACE (w * target / sum(w) OVER (PARTITION BY x.c_{n}) AS w) FROM w{k} x JOIN t_{n} t ON x.c_{n} = t.c_{n})")
            k += 1
    sql.append(f"p AS (SELECT {cells}, (w / w_nat) / max(w / w_nat) OVER () AS probability FROM w{k})")
    on = " AND ".join(f"c.c_{n} = p.c_{n}" for n in names)
    return ",\n".join(sql) + f"""
SELECT doc_id, topic, n_tokens, round(coalesce(probability, 1.0), 6) AS probability,
       ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 < coalesce(probability, 1.0) AS sampled
FROM c LEFT JOIN p ON {on}"""


def _component_sql(node: str) -> str:
    """Smallest node reachable over ``links(a, b)``, for all ``nodes(id)``."""
    return f"""
reach(id, r) AS (SELECT id, id FROM nodes UNION SELECT reach.id, l.b FROM reach JOIN links l ON l.a = reach.r),
comp AS (SELECT id AS {node}, min(r) AS component_id FROM reach GROUP BY id)"""


_OP5 = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
nodes AS (SELECT id FROM v),
links AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM ok p JOIN ok q ON p.id <> q.id AND len(p.e) = len(q.e)
          WHERE list_inner_product(p.e, q.e) / sqrt(list_inner_product(p.e, p.e)) / sqrt(list_inner_product(q.e, q.e)) >= 0.95),
{_component_sql('vec_id')},
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
"""

_OP7 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM s),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
         4 * (strpos('0123456789abcdef', substr(h, i::INT, 1)) - 1) + 1, 4)), '') AS z FROM f)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(z, (5 * i + 1)::INT, 1)::INT + 8 * substr(z, (5 * i + 2)::INT, 1)::INT
         + 4 * substr(z, (5 * i + 3)::INT, 1)::INT + 2 * substr(z, (5 * i + 4)::INT, 1)::INT + substr(z, (5 * i + 5)::INT, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM bits
"""

_OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id AS id, coalesce(regexp_extract_all(translate(text, {_AZ}), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT id, count(*) AS n FROM s GROUP BY id),
shared AS (SELECT p.id AS a, q.id AS b, count(*) AS c FROM s p JOIN s q ON p.k = q.k AND p.id <> q.id GROUP BY 1, 2),
nodes AS (SELECT id FROM w),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
{_component_sql('doc_id')}
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n ON n.id = doc_id
"""


def _url_sql() -> str:
    rules = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND path LIKE '/{r.partition('/')[2]}%' THEN '{r}'"
                     for r, _ in sorted(url_filter.RULES, key=lambda r: -len(r[0])))
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in url_filter.RULES)
    k, a = url_filter.WEIGHT, float(url_filter.ALPHABET)

    def p(x: str) -> str:
        one = f"({x}_c + 1.0::DOUBLE) / ({x}_all + {a}::DOUBLE)"
        return f"({x} + {k}::DOUBLE * (({x}_bc + {k}::DOUBLE * ({one})) / ({x}_b + {k}::DOUBLE))) / ({x}_ab + {k}::DOUBLE)"

    return rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE {rules} END AS rule FROM h),
v AS (SELECT *, CASE rule {verdict} END AS by_rule,
      '^^' || regexp_replace(regexp_replace(translate(host || path, {_AZ}), '[0-9]', '0', 'g'), '[^a-z0./_\-]', '?', 'g') || '$' AS text FROM r),
urls AS MATERIALIZED (SELECT text, max((coalesce(by_rule, '') = 'allow')::INT) AS good, max((coalesce(by_rule, '') = 'block')::INT) AS bad FROM v GROUP BY text),
g AS MATERIALIZED (SELECT text, good, bad, substr(text, i::INT, 3) AS gram FROM (SELECT *, unnest(range(1, length(text) - 1)) AS i FROM urls)),
m AS MATERIALIZED (SELECT gram, sum(good) AS good, sum(bad) AS bad FROM g GROUP BY gram),
x AS (SELECT gram, good, bad, sum(good) OVER () AS good_all, sum(bad) OVER () AS bad_all,
  sum(good) OVER (PARTITION BY gram[1:2]) AS good_ab, sum(bad) OVER (PARTITION BY gram[1:2]) AS bad_ab,
  sum(good) OVER (PARTITION BY gram[2]) AS good_b, sum(bad) OVER (PARTITION BY gram[2]) AS bad_b,
  sum(good) OVER (PARTITION BY gram[2:3]) AS good_bc, sum(bad) OVER (PARTITION BY gram[2:3]) AS bad_bc,
  sum(good) OVER (PARTITION BY gram[3]) AS good_c, sum(bad) OVER (PARTITION BY gram[3]) AS bad_c FROM m),
l AS (SELECT gram, round(ln(({p('good')}) / ({p('bad')})) * {url_filter.NATS})::BIGINT AS llr FROM x),
s AS MATERIALIZED (SELECT text, good, bad, sum(llr)::DOUBLE / count(*) / {url_filter.NATS}.0::DOUBLE AS score FROM g JOIN l USING (gram) GROUP BY ALL),
t AS (SELECT avg(score) FILTER (good = 1) AS mg, coalesce(stddev_pop(score) FILTER (good = 1), 0) + 1e-9 AS sg,
             avg(score) FILTER (bad = 1) AS mb, coalesce(stddev_pop(score) FILTER (bad = 1), 0) + 1e-9 AS sb FROM s)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN coalesce(score >= (mg * sb + mb * sg) / (sg + sb), true) THEN 'allow' ELSE 'block' END) AS verdict,
       round(score, 6) AS score FROM v JOIN s USING (text), t
"""


def _rules_sql() -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(rule_ledger.RULES.values()))
    w = rule_ledger.WINDOW
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + {w - 1}], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - {w - 2})) AS i FROM w WHERE len(w) >= {w})),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {w})) AS p FROM rep) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_upper,
      len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, ({bits})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {rule_ledger.mask(rule_ledger.POLICIES['base'])} <> 0 AS base_failed,
       failed & {rule_ledger.mask(rule_ledger.POLICIES['base'] + rule_ledger.POLICIES[rule_ledger.CURRENT])} = 0 AS kept, failed FROM f
"""


def _codes_sql() -> str:
    parts, k = vector_codes.PARTS, vector_codes.ENTRIES
    square = lambda x, y: f"list_inner_product(list_transform(list_zip({x}, {y}), lambda z: (z[1] - z[2])::DOUBLE), list_transform(list_zip({x}, {y}), lambda z: (z[1] - z[2])::DOUBLE))"
    sql = [f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
        list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
           f"x AS MATERIALIZED (SELECT rid, p, e[p * len(e) // {parts} + 1:(p + 1) * len(e) // {parts}] AS x FROM v, range({parts}) r(p))",
           f"b0 AS MATERIALIZED (SELECT p, (rid - 1)::INT AS i, x AS y FROM x WHERE rid <= {k})"]
    for r in range(vector_codes.ROUNDS + 1):
        sql.append(f"d{r} AS (SELECT rid, x.p, i, x, {square('x', 'y')}::BIGINT AS d FROM x JOIN b{r} b ON x.p = b.p)")
        sql.append(f"a{r} AS MATERIALIZED (SELECT rid, p, min(i) FILTER (d = m) AS i, any_value(x) AS x, any_value(m) AS d FROM "
                   f"(SELECT *, min(d) OVER (PARTITION BY rid, p) AS m FROM d{r}) GROUP BY rid, p)")
        if r < vector_codes.ROUNDS:
            sql.append(f"s{r} AS (SELECT p, i, j, floor(sum(c)::DOUBLE / count(*))::BIGINT AS y FROM (SELECT p, i, unnest(x) AS c, unnest(range(1, len(x) + 1)) AS j FROM a{r}) GROUP BY p, i, j)")
            sql.append(f"n{r} AS (SELECT p, i, list(y ORDER BY j) AS y FROM s{r} GROUP BY p, i)")
            sql.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.i, coalesce(n.y, b.y) AS y FROM b{r} b LEFT JOIN n{r} n ON n.p = b.p AND n.i = b.i)")
    last = vector_codes.ROUNDS
    sql.append(f"c AS (SELECT rid, string_agg(printf('%02x', i::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY rid)")
    sql.append(f"h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, i)) AS h FROM b{last})")
    return "WITH " + ",\n".join(sql) + """
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM v JOIN c USING (rid), h"""


_OP13 = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
d AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
      'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': doc_id > min(doc_id) OVER (PARTITION BY t)} AS f
      FROM t LEFT JOIN labels USING (doc_id)),
m AS MATERIALIZED (SELECT part, f.A::INT + 2 * f.B::INT + 4 * f.C::INT + 8 * f.D::INT + 16 * f.E::INT AS mask, count(*) AS n, count(*) FILTER (good) AS good,
      count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM l a, l b, l c, l d, l e
      WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
      sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
      sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
      sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM m, s GROUP BY ALL)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM x
"""

ORACLE = {"op1_decontamination": _OP1, "op2_mixing": _mixing_sql(), "op5_embedding_dedup": _OP5, "op7_warc": _OP7,
          "op8_minhash_dedup": _OP8, "op9_url_filter": _url_sql(),
          "op11_quality_rules": _rules_sql(), "op12_vector_codes": _codes_sql(), "op13_filter_audit": _OP13}
