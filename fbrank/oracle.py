"""Oracle SQL (DuckDB dialect) for every registered query, over the same parquet tables.

Built from shared CTE fragments so each definition is written once.  Settings mirror
``fbrank.catalog``; seeded positions are computed with the same standard-library rule and
inlined as literals (the SQL engine has no equivalent generator).
"""

from __future__ import annotations

from fbrank import catalog as cat
from fbrank.functions.positions import sample_positions
from fbrank.plans.sweep import DEFAULT_SEEDS, DEFAULT_SLICES

TOKEN = r"'([\p{L}\p{N}]+)'"


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(c for c in ctes if c)


def _k(keys: tuple[str, ...], alias: str = "") -> str:
    """Comma-terminated key list ('' when no keys)."""
    pre = f"{alias}." if alias else ""
    return "".join(f"{pre}{k}, " for k in keys)


# ---------------------------------------------------------------- dense fragments

QV = ("qv AS (SELECT b.item_id AS qid, e.embedding::DOUBLE[] AS qv FROM benchmark b "
      "JOIN embeddings e ON e.vec_id = b.item_id)")
CORPUS = "corpus AS (SELECT vec_id AS docid, embedding::DOUBLE[] AS vec FROM embeddings)"
LABELS = "labs AS (SELECT vec_id AS docid, label FROM embeddings)"


def topk(name: str, src: str, k: int, keys: tuple[str, ...] = ("qid",), score: str | None = None,
         corpus: str = "corpus", exclude_self: bool = True) -> str:
    """Exact top-k by inner product; by default a topic never retrieves itself."""
    score = score or "list_dot_product(q.qv, c.vec)"
    sel = ", ".join(f"q.{x}" for x in keys)
    part = ", ".join(keys)
    on = "c.docid <> q.qid" if exclude_self else "true"
    return (f"{name}_s AS (SELECT {sel}, c.docid, {score} AS score FROM {src} q JOIN {corpus} c ON {on}),\n"
            f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} "
            f"ORDER BY round(score, 9) DESC, docid) AS rank FROM {name}_s) WHERE rank <= {k})")


def positions_fb(name: str, run: str, positions: list[int], keys: tuple[str, ...] = ()) -> str:
    ranks = ", ".join(str(p + 1) for p in positions) or "NULL"
    kk = _k(keys)
    return (f"{name} AS (SELECT {kk}qid, (row_number() OVER (PARTITION BY {kk}qid ORDER BY rank) - 1)::INTEGER "
            f"AS fb_pos, docid, score, rank FROM {run} WHERE rank IN ({ranks}))")


def dense_pos(s=cat.DENSE) -> list[int]:
    return sample_positions(s.seed, s.prf_depth, s.total_prf_docs, s.split_num, s.nsplit)


def rocchio(name: str, fb: str, alpha: float, beta: float, topk_n: int, gamma: float = 0.0,
            bottomk: int = 0, src: str = "qv") -> str:
    """alpha*q + beta*mean(first topk) - gamma*mean(last bottomk), element-wise."""
    neg_cte = ""
    neg_term = ""
    if bottomk > 0:
        neg_cte = (f"{name}_nb AS (SELECT qid, max(fb_pos) + 1 AS n FROM {fb} GROUP BY qid),\n"
                   f"{name}_ne AS (SELECT f.qid, unnest(c.vec) AS x, generate_subscripts(c.vec, 1) AS i FROM {fb} f "
                   f"JOIN corpus c USING (docid) JOIN {name}_nb nb USING (qid) WHERE f.fb_pos >= nb.n - {bottomk}),\n"
                   f"{name}_nm AS (SELECT qid, i, avg(x) AS m FROM {name}_ne GROUP BY qid, i),\n")
        neg_term = f" - {gamma} * coalesce(nm.m, 0)"
    neg_join = f" LEFT JOIN {name}_nm nm ON nm.qid = qe.qid AND nm.i = qe.i" if bottomk > 0 else ""
    return (f"{name}_fe AS (SELECT f.qid, unnest(c.vec) AS x, generate_subscripts(c.vec, 1) AS i FROM {fb} f "
            f"JOIN corpus c USING (docid) WHERE f.fb_pos < {topk_n}),\n"
            f"{name}_fm AS (SELECT qid, i, avg(x) AS m FROM {name}_fe GROUP BY qid, i),\n"
            f"{neg_cte}"
            f"{name}_qe AS (SELECT qid, unnest(qv) AS x, generate_subscripts(qv, 1) AS i FROM {src}),\n"
            f"{name} AS (SELECT qe.qid, list({alpha} * qe.x + {beta} * coalesce(fm.m, 0){neg_term} ORDER BY qe.i) AS qv "
            f"FROM {name}_qe qe LEFT JOIN {name}_fm fm ON fm.qid = qe.qid AND fm.i = qe.i{neg_join} GROUP BY qe.qid)")


def average(name: str, fb: str, src: str = "qv") -> str:
    return (f"{name}_all AS (SELECT qid, qv AS v FROM {src} UNION ALL "
            f"SELECT f.qid, c.vec FROM {fb} f JOIN corpus c USING (docid)),\n"
            f"{name}_e AS (SELECT qid, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {name}_all),\n"
            f"{name} AS (SELECT qid, list(m ORDER BY i) AS qv FROM "
            f"(SELECT qid, i, avg(x) AS m FROM {name}_e GROUP BY qid, i) GROUP BY qid)")


def dense_prf(name: str = "prf", method: str = "rocchio", hits: int = cat.DENSE.hits) -> list[str]:
    s = cat.DENSE
    ctes = [QV, CORPUS, topk("first", "qv", s.total_prf_docs), positions_fb("fb", "first", dense_pos())]
    if method == "rocchio":
        ctes.append(rocchio("ref", "fb", s.alpha, s.beta, s.topk))
    else:
        ctes.append(average("ref", "fb"))
    ctes.append(topk(name, "ref", hits))
    return ctes


def dense_qrels(name: str = "qrels") -> list[str]:
    return [LABELS, topk("pool", "qv", cat.POOL),
            f"{name} AS (SELECT p.qid, p.docid, CASE WHEN lq.label = ld.label THEN 1 + p.docid % 3 ELSE 0 END::INTEGER "
            f"AS rel FROM pool p JOIN labs lq ON lq.docid = p.qid JOIN labs ld ON ld.docid = p.docid)"]


# ---------------------------------------------------------------- sparse fragments

SPARSE_BASE = [
    "topics AS (SELECT item_id AS qid, text AS title FROM benchmark)",
    f"toks AS (SELECT doc_id AS docid, unnest(regexp_extract_all(lower(text), {TOKEN}, 1)) AS term FROM documents)",
    "raw AS (SELECT docid, term, count(*)::INTEGER AS tf FROM toks GROUP BY docid, term)",
    "ndocs AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM documents)",
    "dfs AS (SELECT term, count(*) AS df FROM raw GROUP BY term)",
    "stop AS (SELECT term FROM dfs WHERE df > (SELECT n FROM ndocs) * 0.5)",
    "idf AS (SELECT term, df, ln(1 + ((SELECT n FROM ndocs) - df + 0.5) / (df::DOUBLE + 0.5)) AS idf FROM dfs "
    "WHERE df <= (SELECT n FROM ndocs) * 0.5)",
    "post AS (SELECT r.* FROM raw r ANTI JOIN stop s USING (term))",
    "dl AS (SELECT d.doc_id AS docid, coalesce(sum(p.tf), 0)::BIGINT AS dl FROM documents d "
    "LEFT JOIN post p ON p.docid = d.doc_id GROUP BY d.doc_id)",
    "avgdl AS (SELECT avg(dl) AS avgdl, count(*) AS n_docs FROM dl)",
    "w AS (SELECT p.term, p.docid, i.idf * (p.tf / (p.tf + 0.9 * (0.6 + 0.4::DOUBLE * dl.dl / (SELECT avgdl FROM avgdl)))) "
    "AS w FROM post p JOIN idf i USING (term) JOIN dl USING (docid))",
    f"qtok AS (SELECT qid, unnest(regexp_extract_all(lower(title), {TOKEN}, 1)) AS term FROM topics)",
    "bow AS (SELECT qid, term, count(*)::DOUBLE AS weight FROM qtok ANTI JOIN stop USING (term) GROUP BY qid, term)",
]


def bm25(name: str, terms: str, k: int = 1000, keys: tuple[str, ...] = ("qid",)) -> str:
    kk = _k(keys, "t")
    part = ", ".join(keys)
    return (f"{name}_s AS (SELECT {kk}w.docid, sum(t.weight * w.w) AS score FROM {terms} t JOIN w USING (term) "
            f"WHERE t.weight > 0 AND length(t.term) > 0 GROUP BY {kk}w.docid),\n"
            f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY round(score, 9) DESC, "
            f"docid) AS rank FROM {name}_s) WHERE rank <= {k})")


def sparse_pos() -> list[int]:
    s = cat.SPARSE
    return sample_positions(s.seed, s.prf_depth, s.total_prf_docs, s.split_num, s.nsplit)


def mean_fb(name: str, fb: str, mode: str = "tf", keys: tuple[str, ...] = ("qid",)) -> str:
    src = "(SELECT term, docid, tf::DOUBLE AS w FROM post)" if mode == "tf" else "w"
    kk = _k(keys, "f")
    k2 = _k(keys)
    on = " AND ".join(f"s.{x} = n.{x}" for x in keys)
    return (f"{name}_n AS (SELECT {k2}count(*) AS n FROM {fb} GROUP BY {', '.join(keys)}),\n"
            f"{name}_s AS (SELECT {kk}v.term, sum(v.w) AS s FROM {fb} f JOIN {src} v USING (docid) "
            f"GROUP BY {kk}v.term),\n"
            f"{name} AS (SELECT {_k(keys, 's')}s.term, s.s / n.n AS weight FROM {name}_s s JOIN {name}_n n ON {on} "
            f"WHERE s.s / n.n > 0)")


def sparse_prf(name: str = "prf", first: tuple[str, ...] = ()) -> list[str]:
    s = cat.SPARSE
    return SPARSE_BASE + [
        *(first or (bm25("first", "bow", s.k),)), positions_fb("fb", "first", sparse_pos()), mean_fb("fbv", "fb"),
        f"terms AS (SELECT qid, term, sum(weight) AS weight FROM (SELECT qid, term, weight * {s.alpha} AS weight "
        f"FROM bow WHERE weight * {s.alpha} > 0 UNION ALL SELECT qid, term, weight * {s.beta} FROM fbv "
        f"WHERE weight * {s.beta} > 0) GROUP BY qid, term HAVING sum(weight) > 0)",
        bm25(name, "terms", s.k),
    ]


SPARSE_QRELS = ("qrels AS (SELECT b.item_id AS qid, d.doc_id AS docid, (1 + coalesce(l.quality, 0))::INTEGER AS rel "
                "FROM benchmark b JOIN documents d ON contains(d.text, b.text) "
                "LEFT JOIN labels l ON l.doc_id = d.doc_id)")


# ---------------------------------------------------------------- evaluation fragments

def evaluation(p: str, run: str, qrels: str, level: int = 2, keys: tuple[str, ...] = ()) -> list[str]:
    """Per-topic measures ``{p}_pt`` (keys, qid, map, ndcg_cut_10, recall_1000)."""
    kk = _k(keys)
    on_k = "".join(f"AND t.{x} = {{a}}.{x} " for x in keys)
    return [
        f"{p}_er AS (SELECT {kk}qid, docid, score, row_number() OVER (PARTITION BY {kk}qid ORDER BY round(score, 6) "
        f"DESC, CAST(docid AS VARCHAR) DESC) AS erank FROM {run})",
        f"{p}_h AS (SELECT r.*, j.rel FROM {p}_er r JOIN {qrels} j ON j.qid = r.qid AND j.docid = r.docid "
        f"WHERE j.rel > 0)",
        f"{p}_rh AS (SELECT {kk}qid, sum(n::DOUBLE / erank) AS prec_sum, sum(CASE WHEN erank <= 1000 THEN 1 ELSE 0 END) "
        f"AS ret FROM (SELECT *, row_number() OVER (PARTITION BY {kk}qid ORDER BY erank) AS n FROM {p}_h "
        f"WHERE rel >= {level}) GROUP BY {kk}qid)",
        f"{p}_dcg AS (SELECT {kk}qid, sum(rel / log2(erank + 1)) AS dcg FROM {p}_h WHERE erank <= 10 GROUP BY {kk}qid)",
        f"{p}_st AS (SELECT qid, sum(CASE WHEN rel >= {level} THEN 1 ELSE 0 END) AS R FROM {qrels} GROUP BY qid)",
        f"{p}_id AS (SELECT qid, sum(rel / log2(i + 1)) AS idcg FROM (SELECT qid, rel, row_number() OVER "
        f"(PARTITION BY qid ORDER BY rel DESC, docid) AS i FROM {qrels} WHERE rel > 0) WHERE i <= 10 GROUP BY qid)",
        f"{p}_pt AS (SELECT {_k(keys, 't')}t.qid, "
        f"CASE WHEN st.R > 0 THEN coalesce(rh.prec_sum, 0) / st.R ELSE 0 END AS map, "
        f"CASE WHEN coalesce(id.idcg, 0) > 0 THEN coalesce(dcg.dcg, 0) / id.idcg ELSE 0 END AS ndcg_cut_10, "
        f"CASE WHEN st.R > 0 THEN coalesce(rh.ret, 0) / st.R ELSE 0 END AS recall_1000 "
        f"FROM (SELECT DISTINCT {kk}qid FROM {run}) t JOIN {p}_st st ON st.qid = t.qid "
        f"LEFT JOIN {p}_id id ON id.qid = t.qid "
        f"LEFT JOIN {p}_rh rh ON rh.qid = t.qid {on_k.format(a='rh')}"
        f"LEFT JOIN {p}_dcg dcg ON dcg.qid = t.qid {on_k.format(a='dcg')})",
    ]


def summary_select(p: str, qrels: str, keys: tuple[str, ...] = (), key_src: str | None = None) -> str:
    n = f"(SELECT count(DISTINCT qid) FROM {qrels})"
    ms = ", ".join(f"round(coalesce(sum(pt.{m}), 0) / {n}, 6) AS {m}" for m in ("map", "ndcg_cut_10", "recall_1000"))
    if not keys:
        return f"SELECT {ms} FROM {p}_pt pt"
    kk = ", ".join(f"k.{x}" for x in keys)
    on = " AND ".join(f"pt.{x} = k.{x}" for x in keys)
    return (f"SELECT {kk}, {ms} FROM (SELECT DISTINCT {', '.join(keys)} FROM {key_src}) k "
            f"LEFT JOIN {p}_pt pt ON {on} GROUP BY {kk}")


def run_out(run: str, keys: str = "qid") -> str:
    return f"SELECT {keys}, docid, rank::INTEGER AS rank, round(score, 6) AS score FROM {run}"


def vec_round(expr: str) -> str:
    return f"list_transform({expr}, lambda x: round(x::DOUBLE, 6))"


def vec_out(col: str) -> str:
    return f"{vec_round(col)} AS {col}"


# ---------------------------------------------------------------- sweeps

def trials_values(seeds, slices, total, split, depth, topics=("benchmark",)) -> str:
    """Trial grid in grid order (seed-major, as ``trial_grid``) with literal positions."""
    rows = []
    tid = 0
    for seed in seeds:
        for ns in slices:
            for tot in total if isinstance(total, tuple) else (total,):
                arr = "[" + ", ".join(str(p) for p in sample_positions(seed, depth, tot, split, ns)) + "]"
                for name in topics:
                    rows.append(f"({tid}, {seed}, {ns}, {tot}, {split}, {depth}, {arr}, '{name}')")
                    tid += 1
    return ("trials AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(trial_id, seed, nsplit, total_prf_docs, "
            "split_num, prf_depth, positions, topics))")


def trial_fb(name: str, run: str) -> str:
    return (f"{name}_p AS (SELECT trial_id, unnest(positions) + 1 AS rank FROM trials),\n"
            f"{name} AS (SELECT p.trial_id, r.qid, (row_number() OVER (PARTITION BY p.trial_id, r.qid ORDER BY r.rank) - 1)"
            f"::INTEGER AS fb_pos, r.docid, r.score FROM {run} r JOIN {name}_p p USING (rank))")


def trial_rocchio(name: str, fb: str, alpha: float, beta: float, given_only: bool = False) -> str:
    return (f"{name}_fe AS (SELECT f.trial_id, f.qid, unnest(c.vec) AS x, generate_subscripts(c.vec, 1) AS i "
            f"FROM {fb} f JOIN corpus c USING (docid)),\n"
            f"{name}_fm AS (SELECT trial_id, qid, i, avg(x) AS m FROM {name}_fe GROUP BY trial_id, qid, i),\n"
            f"{name}_qe AS (SELECT qid, unnest(qv) AS x, generate_subscripts(qv, 1) AS i FROM qv),\n"
            f"{name}_tq AS (SELECT t.trial_id, e.qid, e.i, e.x FROM trials t CROSS JOIN {name}_qe e"
            + (f" WHERE (t.trial_id, e.qid) IN (SELECT trial_id, qid FROM {fb})" if given_only else "") + "),\n"
            f"{name} AS (SELECT q.trial_id, q.qid, list({alpha} * q.x + {beta} * coalesce(m.m, 0) ORDER BY q.i) AS qv "
            f"FROM {name}_tq q LEFT JOIN {name}_fm m ON m.trial_id = q.trial_id AND m.qid = q.qid AND m.i = q.i "
            f"GROUP BY q.trial_id, q.qid)")


def run_name_sql() -> str:
    return ("'run.' || total_prf_docs || '.' || split_num || '.' || prf_depth || '.' || nsplit || '.' || seed "
            "|| '.trec'")


def dense_sweep_ctes(seeds=DEFAULT_SEEDS, slices=DEFAULT_SLICES) -> list[str]:
    s = cat.DENSE
    return ([QV, CORPUS, trials_values(seeds, slices, cat.VECTOR_TOTAL, 10, 3), topk("first", "qv", cat.VECTOR_TOTAL), trial_fb("fb", "first"),
             trial_rocchio("ref", "fb", 0.4, 0.6), topk("runs", "ref", s.hits, keys=("trial_id", "qid"))]
            + dense_qrels() + evaluation("e", "runs", "qrels", 2, ("trial_id",)))


def covered_sweep_select(fb: str) -> str:
    """As ``dense_sweep_select``, with the number of topics that ``fb`` covers and no metrics where there are none."""
    metrics = ", ".join(f"CASE WHEN coalesce(n, 0) > 0 THEN {m} END AS {m}" for m in ("map", "ndcg_cut_10", "recall_1000"))
    return (f"SELECT x.trial_id, seed, nsplit, total_prf_docs, split_num, prf_depth, run_name, {metrics}, coalesce(n, 0) AS n_topics "
            f"FROM ({dense_sweep_select()}) x LEFT JOIN (SELECT trial_id, count(DISTINCT qid) AS n FROM {fb} GROUP BY trial_id) n "
            f"ON n.trial_id = x.trial_id")


def dense_sweep_select() -> str:
    return (f"SELECT t.trial_id, t.seed, t.nsplit, t.total_prf_docs, t.split_num, t.prf_depth, "
            f"{run_name_sql()} AS run_name, m.map, m.ndcg_cut_10, m.recall_1000 FROM trials t JOIN "
            f"({summary_select('e', 'qrels', ('trial_id',), 'trials')}) m USING (trial_id)")


# ---------------------------------------------------------------- the registry

def build() -> dict[str, str]:
    q: dict[str, str] = {}
    s = cat.DENSE
    q["topics_scan"] = "SELECT item_id AS qid, text AS title FROM benchmark"
    q["vectors_scan"] = f"SELECT vec_id AS docid, {vec_round('embedding')} AS vec FROM embeddings"
    q["encoded_query_lookup"] = _w(QV) + f" SELECT qid, {vec_out('qv')} FROM qv"
    q["documents_scan"] = "SELECT doc_id AS docid, text FROM documents"
    q["qrels_scan"] = _w(SPARSE_QRELS) + " SELECT CAST(qid AS VARCHAR) AS qid, CAST(docid AS VARCHAR) AS docid, rel FROM qrels"
    dense_first = [QV, CORPUS, topk("first", "qv", cat.DENSE_K)]
    q["run_roundtrip"] = _w(*dense_first) + (
        " SELECT CAST(qid AS VARCHAR) AS qid, 'Q0' AS q0, CAST(docid AS VARCHAR) AS docid, rank::INTEGER AS rank, "
        "round(score, 6) AS score, 'Faiss' AS tag FROM first")
    q["run_lines"] = _w(*dense_first) + " SELECT printf('%d Q0 %d %d %.6f Faiss', qid, docid, rank, score) AS line FROM first"
    q["run_lines_msmarco"] = _w(*dense_first) + " SELECT qid || chr(9) || docid || chr(9) || rank AS line FROM first"
    pos = dense_pos()
    q["selection_log"] = _w(QV, CORPUS, topk("first", "qv", s.total_prf_docs), positions_fb("fb", "first", pos)) + (
        f" SELECT 0 AS trial_id, {s.seed} AS seed, qid, list(docid ORDER BY fb_pos) AS docids, "
        f"[{', '.join(map(str, pos))}]::INTEGER[] AS positions, false AS rand_prf FROM fb GROUP BY qid")
    q["metrics_long"] = _w(*dense_prf(), *dense_qrels(), *evaluation("e", "prf", "qrels")) + (
        f" SELECT 'vector_position_prf_benchmark_{s.total_prf_docs}' AS project, metric, round(value, 6) AS value "
        f"FROM ({summary_select('e', 'qrels')}) UNPIVOT (value FOR metric IN (map, ndcg_cut_10, recall_1000))")

    sh = cat.SHORT
    spos = sample_positions(sh["seed"], sh["depth"], sh["total"], sh["split_num"], sh["nsplit"])
    q["feedback_short_list"] = _w(QV, CORPUS, topk("first", "qv", sh["total"]), positions_fb("fb", "first", spos)) + (
        " SELECT qid, fb_pos, docid, round(score, 6) AS score FROM fb")
    q["topics_prefixed"] = "SELECT item_id AS qid, 'query: ' || text AS title FROM benchmark"
    q["dim_check"] = "SELECT vec_id AS docid, len(embedding)::INTEGER AS dim FROM embeddings"
    q["mean_pool_l2"] = (
        "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), "
        "m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY label, i), "
        "v AS (SELECT label, list(x ORDER BY i) AS vec, sqrt(sum(x * x)) AS n FROM m GROUP BY label) "
        "SELECT label, list_transform(vec, lambda x: round(CASE WHEN n > 0 THEN x / n ELSE x END, 6)) AS vec FROM v")

    q["dense_topk"] = _w(*dense_first) + " " + run_out("first")
    q["feedback_vectors"] = _w(QV, CORPUS, topk("first", "qv", s.total_prf_docs), positions_fb("fb", "first", pos)) + (
        f" SELECT f.qid, f.fb_pos, f.docid, {vec_round('c.vec')} AS vec FROM fb f JOIN corpus c USING (docid)")
    q["prf_dense_rocchio_run"] = _w(*dense_prf()) + " " + run_out("prf")
    q["prf_dense_average_run"] = _w(*dense_prf(method="avg")) + " " + run_out("prf")
    ham = "-len(list_filter(list_zip(q.qv, c.vec), lambda z: (z[1] > 0) <> (z[2] > 0)))::DOUBLE"
    q["binary_topk"] = _w(QV, CORPUS, topk("bin", "qv", cat.BINARY_K, score=ham)) + " " + run_out("bin")
    q["binary_topk_rerank"] = _w(QV, CORPUS, topk("bin", "qv", cat.BINARY_K, score=ham),
                                 "rr_s AS (SELECT b.qid, b.docid, list_dot_product(q.qv, list_transform(c.vec, "
                                 "lambda x: CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END)::DOUBLE[]) AS score FROM bin b "
                                 "JOIN qv q USING (qid) JOIN corpus c USING (docid))",
                                 "rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY "
                                 "round(score, 9) DESC, docid) AS rank FROM rr_s) WHERE rank <= 10)") + " " + run_out("rr")
    q["bm25_topk"] = _w(*SPARSE_BASE, bm25("first", "bow", cat.SPARSE.k)) + " " + run_out("first")
    q["prf_sparse_rocchio_run"] = _w(*sparse_prf()) + " " + run_out("prf")
    q["max_passage"] = _w(*dense_first,
                          "mp AS (SELECT qid, (docid // 5) || '#' || (docid % 5) AS pid, score, rank FROM first)",
                          "mp1 AS (SELECT qid, split_part(pid, '#', 1) AS docid, score, rank FROM (SELECT *, row_number() "
                          "OVER (PARTITION BY qid, split_part(pid, '#', 1) ORDER BY rank) AS r FROM mp) WHERE r = 1)",
                          "mp2 AS (SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank "
                          "FROM mp1)") + " SELECT qid, docid, rank::INTEGER AS rank, round(score, 6) AS score FROM mp2 WHERE rank <= 100"
    q["tie_break"] = _w(*SPARSE_BASE, bm25("first", "bow", cat.SPARSE.k),
                        "tb0 AS (SELECT qid, docid, rank, round(score, 6) + rank * 0.000001 AS up FROM first)",
                        "tb AS (SELECT qid, docid, round(min(up) OVER (PARTITION BY qid ORDER BY rank) - rank * 0.000001, 6) AS score FROM tb0)",
                        "tb2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM tb)"
                        ) + " " + run_out("tb2")
    q["topic_batches"] = ("SELECT qid, ((rn - 1) // 5)::INTEGER AS batch, ((rn - 1) % 5)::INTEGER AS batch_pos FROM "
                          "(SELECT item_id AS qid, row_number() OVER (ORDER BY item_id) AS rn FROM benchmark)")

    q["feedback_natural"] = _w(*dense_first) + (
        f" SELECT qid, (rank - 1)::INTEGER AS fb_pos, docid, round(score, 6) AS score FROM first WHERE rank <= {s.prf_depth}")
    q["feedback_random_split"] = _w(QV, CORPUS, topk("first", "qv", s.total_prf_docs), positions_fb("fb", "first", pos)) + (
        " SELECT qid, fb_pos, docid, round(score, 6) AS score FROM fb")
    q["feedback_swapped"] = swapped_sql()
    q["feedback_unsatisfied"] = f"SELECT 0 AS trial_id, item_id AS qid FROM benchmark WHERE item_id NOT IN (SELECT qid FROM ({swapped_sql()}))"
    q["feedback_donor"] = donor_sql()
    q["ranking_overlap"] = _w(*dense_prf(), topk("first", "qv", cat.DENSE_K).replace("first", "f100")) + (
        " SELECT f.qid, f.docid, f.rank::INTEGER AS rank FROM f100 f SEMI JOIN (SELECT qid, docid FROM prf WHERE rank <= 10) p "
        "ON p.qid = f.qid AND p.docid = f.docid")
    q["prf_depth_zero"] = _w(QV, CORPUS, topk("plain", "qv", s.hits)) + " " + run_out("plain")

    fbc = [QV, CORPUS, topk("first", "qv", s.total_prf_docs), positions_fb("fb", "first", pos)]
    q["dense_average_vec"] = _w(*fbc, average("ref", "fb")) + f" SELECT qid, {vec_out('qv')} FROM ref"
    q["dense_rocchio_vec"] = _w(*fbc, rocchio("ref", "fb", s.alpha, s.beta, s.topk)) + f" SELECT qid, {vec_out('qv')} FROM ref"
    q["dense_rocchio_neg_vec"] = _w(*fbc, rocchio("ref", "fb", 0.9, 0.1, 2, gamma=0.1, bottomk=1)) + (
        f" SELECT qid, {vec_out('qv')} FROM ref")
    spos_s = sparse_pos()
    sfb = SPARSE_BASE + [bm25("first", "bow", cat.SPARSE.k), positions_fb("fb", "first", spos_s)]
    q["feedback_text"] = _w(*sfb) + (
        " SELECT t.qid, concat_ws(' ', t.title, coalesce(array_to_string(x.texts, ' '), '')) AS title FROM topics t "
        "LEFT JOIN (SELECT f.qid, list(d.text ORDER BY f.fb_pos) AS texts FROM fb f JOIN documents d ON d.doc_id = f.docid "
        "GROUP BY f.qid) x USING (qid)")
    dim = cat.HASH_DIM
    q["encode_hashed"] = (
        f"WITH t AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), {TOKEN}, 1)) AS tok FROM benchmark), "
        f"c AS (SELECT qid, (('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim})::INTEGER AS b, "
        f"sum(CASE WHEN ('0x' || substr(md5(tok), 9, 1))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x "
        f"FROM t GROUP BY qid, b), "
        f"g AS (SELECT b.item_id AS qid, r.i FROM benchmark b, range(0, {dim}) r(i)), "
        f"v AS (SELECT g.qid, list(coalesce(c.x, 0.0)::DOUBLE ORDER BY g.i) AS vec FROM g LEFT JOIN c "
        f"ON c.qid = g.qid AND c.b = g.i GROUP BY g.qid), "
        f"n AS (SELECT qid, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS nrm FROM v) "
        f"SELECT qid, list_transform(vec, lambda x: round(CASE WHEN nrm > 0 THEN x / nrm ELSE x END, 6)) AS qv FROM n")
    q["prf_text_dense_run"] = _w(
        *sfb,
        "rtext AS (SELECT t.qid, concat_ws(' ', t.title, coalesce(array_to_string(x.texts, ' '), '')) AS title "
        "FROM topics t LEFT JOIN (SELECT f.qid, list(d.text ORDER BY f.fb_pos) AS texts FROM fb f JOIN documents d "
        "ON d.doc_id = f.docid GROUP BY f.qid) x USING (qid))",
        *hashed("qenc", "rtext", "qid", "title", dim, "qv"),
        *hashed("denc", "(SELECT doc_id AS docid, text FROM documents)", "docid", "text", dim, "vec"),
        topk("tdr", "qenc", cat.DENSE_K, corpus="denc", exclude_self=False)) + " " + run_out("tdr")
    q["query_bow"] = _w(*SPARSE_BASE) + " SELECT qid, term, weight FROM bow"
    q["doc_tf"] = _w(*SPARSE_BASE) + " SELECT term, docid, tf FROM post"
    q["doc_bm25_weights"] = _w(*SPARSE_BASE) + " SELECT term, docid, round(w, 6) AS w FROM w"
    q["feedback_mean_tf"] = _w(*sfb, mean_fb("fbv", "fb")) + " SELECT qid, term, round(weight, 6) AS weight FROM fbv"
    q["feedback_mean_bm25"] = _w(*sfb, mean_fb("fbv", "fb", "bm25")) + (
        " SELECT qid, term, round(weight, 6) AS weight FROM fbv")
    q["sparse_rocchio_terms"] = _w(*sparse_prf()) + " SELECT qid, term, round(weight, 6) AS weight FROM terms"
    q["collection_stats"] = _w(*SPARSE_BASE) + (
        " SELECT n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM idf) AS n_terms, "
        "(SELECT count(*) FROM post) AS n_postings, (SELECT count(*) FROM stop) AS n_stop FROM avgdl")

    q["eval_map"] = _w(*dense_prf(), *dense_qrels(), *evaluation("e", "prf", "qrels", 2)) + (
        " SELECT qid, round(map, 6) AS map FROM e_pt")
    q["eval_ndcg10"] = _w(*sparse_prf(), SPARSE_QRELS, *evaluation("e", "prf", "qrels", 2)) + (
        " SELECT qid, round(ndcg_cut_10, 6) AS ndcg_cut_10 FROM e_pt")
    q["eval_recall1000"] = _w(*SPARSE_BASE, bm25("first", "bow", cat.SPARSE.k), SPARSE_QRELS,
                              *evaluation("e", "first", "qrels", 1)) + (
        " SELECT qid, round(recall_1000, 6) AS recall_1000 FROM e_pt")
    q["eval_level"] = _w(*dense_prf(), *dense_qrels(), *evaluation("e1", "prf", "qrels", 1),
                         *evaluation("e2", "prf", "qrels", 2)) + (
        f" SELECT *, 1 AS level FROM ({summary_select('e1', 'qrels')}) UNION ALL "
        f"SELECT *, 2 AS level FROM ({summary_select('e2', 'qrels')})")
    q["eval_complete"] = _w(*sparse_prf(), SPARSE_QRELS, *evaluation("e", "prf", "qrels", 2)) + (
        f" SELECT (SELECT count(DISTINCT qid) FROM qrels) AS n_judged, * FROM ({summary_select('e', 'qrels')})")
    q["eval_summary"] = _w(*dense_prf(), *dense_qrels(), *evaluation("e", "prf", "qrels", 2)) + " " + summary_select(
        "e", "qrels")

    q["sweep_dense"] = _w(*dense_sweep_ctes()) + " " + dense_sweep_select()
    q["sweep_with_baseline"] = _w(*dense_sweep_ctes(), topk("base", "qv", s.hits), *evaluation("b", "base", "qrels")) + (
        f" SELECT nsplit, seed, map, ndcg_cut_10, recall_1000 FROM ({dense_sweep_select()}) UNION ALL "
        f"SELECT 999 AS nsplit, NULL AS seed, * FROM ({summary_select('b', 'qrels')})")
    aggs = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(min({m}), 6) AS {m}_min, round(max({m}), 6) AS {m}_max, "
                     f"round(stddev_samp({m}), 6) AS {m}_std" for m in ("map", "ndcg_cut_10", "recall_1000"))
    gains = ", ".join(f"round(round(avg(sw.{m}), 6) - (SELECT {m} FROM bs), 6) AS {m}_gain"
                      for m in ("map", "ndcg_cut_10", "recall_1000"))
    q["compare_positions"] = _w(*dense_sweep_ctes(), topk("base", "qv", s.hits), *evaluation("b", "base", "qrels"),
                                f"bs AS ({summary_select('b', 'qrels')})", f"sw AS ({dense_sweep_select()})") + (
        f" SELECT nsplit, count(*) AS n_trials, {aggs}, {gains} FROM sw GROUP BY nsplit")
    q["evaluate_runs"] = _w(*dense_sweep_ctes()) + (
        " SELECT run_name, total_prf_docs, split_num, prf_depth, nsplit, seed, map, ndcg_cut_10, recall_1000 "
        f"FROM ({dense_sweep_select()})")
    q["prf_sparse_from_run"] = _w(*sparse_prf(first=(QV, CORPUS, topk("first", "qv", cat.SPARSE.total_prf_docs)))) + (
        " SELECT qid, docid, rank::INTEGER AS rank, round(score, 6) AS score, 'Faiss+rocchio' AS tag FROM prf")
    q["pca_topk"] = _w(
        "e AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)",
        "mu AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i)",
        "mat AS (SELECT label, list(m ORDER BY i) AS r FROM mu GROUP BY label)",
        "qv AS (SELECT b.item_id AS qid, (SELECT list(list_dot_product(v.embedding::DOUBLE[], r) ORDER BY label) FROM mat) AS qv "
        "FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id)",
        "corpus AS (SELECT vec_id AS docid, (SELECT list(list_dot_product(v.embedding::DOUBLE[], r) ORDER BY label) FROM mat) AS vec "
        "FROM embeddings v)", topk("first", "qv", 10)) + " " + run_out("first")
    q["dense_topk_single"] = _w(QV, CORPUS, "one AS (SELECT * FROM qv WHERE qid = (SELECT min(qid) FROM qv))",
                                topk("first", "one", cat.DENSE_K)) + " " + run_out("first")
    q["sweep_sparse"] = sparse_sweep_sql()
    q["sweep_dense_swapped"] = _w(*small_swapped_ctes()) + " " + covered_sweep_select("sfb")
    q["sweep_metrics_log"], q["sweep_selection_log"] = sweep_log_sql("metrics"), sweep_log_sql("selections")
    q["sweep_dense_text"] = text_sweep_sql()
    q["prf_dense_text_run"] = _w(*text_ctes(positions_fb("fb", "first", pos), ("qid",), s.hits)) + " " + run_out("tdr")
    q["encode_matrix"] = matrix_sql()
    q["sweep_dense_swapped_grid"] = dense_swapped_grid_sql()
    q["sweep_dense_swapped_unsatisfied"] = _w(*swapped_grid_ctes()) + (
        f" SELECT t.trial_id, b.item_id AS qid FROM trials t JOIN benchmark b ON {IN_SET} WHERE (t.trial_id, b.item_id) NOT IN (SELECT trial_id, qid FROM sfb)")
    q["sweep_sparse_donor"] = sparse_sweep_sql(donor=True)
    return q


def hashed(name: str, src: str, id_col: str, text_col: str, dim: int, out: str) -> list[str]:
    """Signed feature hashing of the tokens of ``text_col`` (same fixed rule as the engine)."""
    return [
        f"{name}_t AS (SELECT {id_col} AS id, unnest(regexp_extract_all(lower({text_col}), {TOKEN}, 1)) AS tok FROM {src})",
        f"{name}_c AS (SELECT id, (('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim})::INTEGER AS b, "
        f"sum(CASE WHEN ('0x' || substr(md5(tok), 9, 1))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x "
        f"FROM {name}_t GROUP BY id, b)",
        f"{name}_g AS (SELECT s.{id_col} AS id, r.i FROM {src} s, range(0, {dim}) r(i))",
        f"{name}_v AS (SELECT g.id, list(coalesce(c.x, 0.0)::DOUBLE ORDER BY g.i) AS v FROM {name}_g g LEFT JOIN {name}_c c "
        f"ON c.id = g.id AND c.b = g.i GROUP BY g.id)",
        f"{name} AS (SELECT id AS {id_col}, CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS {out} "
        f"FROM (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM {name}_v))",
    ]


#: a topic (b.item_id) is in the trial's topic set
IN_SET = "(t.topics = 'benchmark' OR t.topics = CASE WHEN b.item_id % 2 = 0 THEN 'even' ELSE 'odd' END)"


def swap_ctes(first: str, fb: str, out: str, total: int | str, batch: int) -> list[str]:
    """F4 per trial: smallest whole-batch shift whose donors avoid every recipient's top-total."""
    return [
        f"mem0 AS (SELECT t.trial_id, b.item_id AS qid, (row_number() OVER (PARTITION BY t.trial_id ORDER BY b.item_id) "
        f"- 1) // {batch} AS batch, md5(t.seed || ':' || b.item_id) AS k FROM trials t JOIN benchmark b ON {IN_SET})",
        "mem AS (SELECT trial_id, qid, batch, row_number() OVER (PARTITION BY trial_id, batch ORDER BY k) - 1 AS i, "
        "count(*) OVER (PARTITION BY trial_id, batch) AS n FROM mem0)",
        "shifts AS (SELECT trial_id, qid, batch, i, n, unnest(range(1, n)) AS shift FROM mem)",
        "cand AS (SELECT m.trial_id, m.qid, m.batch, m.shift, d.qid AS donor FROM shifts m JOIN mem d "
        "ON d.trial_id = m.trial_id AND d.batch = m.batch AND d.i = (m.i + m.shift) % m.n)",
        f"bad AS (SELECT DISTINCT c.trial_id, c.batch, c.shift FROM cand c JOIN {fb} f ON f.trial_id = c.trial_id "
        f"AND f.qid = c.donor JOIN {first} o ON o.qid = c.qid AND o.docid = f.docid AND o.rank <= {total})",
        "ok AS (SELECT c.trial_id, c.batch, min(c.shift) AS shift FROM (SELECT DISTINCT trial_id, batch, shift FROM cand) c "
        "ANTI JOIN bad b ON b.trial_id = c.trial_id AND b.batch = c.batch AND b.shift = c.shift GROUP BY c.trial_id, c.batch)",
        "asg AS (SELECT c.trial_id, c.qid, c.donor FROM cand c JOIN ok USING (trial_id, batch, shift))",
        f"{out} AS (SELECT a.trial_id, a.qid, f.fb_pos, f.docid, f.score FROM asg a JOIN {fb} f "
        f"ON f.trial_id = a.trial_id AND f.qid = a.donor)",
    ]


def donor_ctes(first: str, fb: str, out: str) -> list[str]:
    """F5 per trial: first donor, stepping back cyclically from a seeded start, disjoint from top-total."""
    return [
        f"idx AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS i, count(*) OVER () AS n FROM "
        f"(SELECT DISTINCT qid FROM {first}))",
        f"rcp AS (SELECT DISTINCT f.trial_id, f.qid, t.seed FROM {fb} f JOIN trials t USING (trial_id))",
        "base AS (SELECT r.trial_id, r.qid, x.i, x.n, ((x.i - 1 - (('0x' || substr(md5(r.seed || ':' || r.qid), 1, 8))"
        "::BIGINT % (x.n - 1))) % x.n + x.n) % x.n AS start FROM rcp r JOIN idx x USING (qid))",
        "steps AS (SELECT trial_id, qid, i, n, start, unnest(range(0, n)) AS step FROM base)",
        f"cand AS (SELECT b.trial_id, b.qid, b.step, d.qid AS donor FROM steps b JOIN idx d "
        f"ON d.i = ((b.start - b.step) % b.n + b.n) % b.n WHERE d.i <> b.i AND EXISTS (SELECT 1 FROM {fb} h "
        f"WHERE h.trial_id = b.trial_id AND h.qid = d.qid))",
        f"bad AS (SELECT DISTINCT c.trial_id, c.qid, c.step FROM cand c JOIN {fb} f ON f.trial_id = c.trial_id "
        f"AND f.qid = c.donor JOIN trials t ON t.trial_id = c.trial_id JOIN {first} o ON o.qid = c.qid AND o.docid = f.docid "
        f"AND o.rank <= t.total_prf_docs)",
        "asg AS (SELECT trial_id, qid, arg_min(donor, step) AS donor FROM (SELECT * FROM cand ANTI JOIN bad "
        "USING (trial_id, qid, step)) GROUP BY trial_id, qid)",
        f"{out} AS (SELECT a.trial_id, a.qid, f.fb_pos, f.docid, f.score FROM asg a JOIN {fb} f "
        f"ON f.trial_id = a.trial_id AND f.qid = a.donor)",
    ]


def small_swapped_ctes() -> list[str]:
    s = cat.DENSE
    sw_ = cat.SWAP
    return ([QV, CORPUS, trials_values(DEFAULT_SEEDS, (0, 1), sw_["total"], sw_["split_num"], sw_["depth"]),
             topk("first", "qv", sw_["total"]), trial_fb("fb", "first")]
            + swap_ctes("first", "fb", "sfb", sw_["total"], sw_["batch"])
            + [trial_rocchio("ref", "sfb", 0.4, 0.6, given_only=True), topk("runs", "ref", s.hits, keys=("trial_id", "qid"))]
            + dense_qrels() + evaluation("e", "runs", "qrels", 2, ("trial_id",)))


def sweep_log_sql(what: str) -> str:
    project = "'vector_position_prf_benchmark_' || t.total_prf_docs || '_swap' AS project"
    if what == "selections":
        return _w(*small_swapped_ctes()) + (
            f" SELECT {project}, {run_name_sql()} AS run_name, t.seed, f.qid, list(f.docid ORDER BY f.fb_pos) AS docids, any_value(t.positions) AS positions, "
            f"true AS rand_prf FROM sfb f JOIN trials t USING (trial_id) GROUP BY t.trial_id, t.seed, t.total_prf_docs, t.split_num, t.prf_depth, t.nsplit, f.qid")
    return _w(*small_swapped_ctes(), f"m AS ({covered_sweep_select('sfb')})") + "".join(
        f"{' UNION ALL' if i else ''} SELECT {project}, run_name, seed, nsplit, total_prf_docs, split_num, prf_depth, 0.4::DOUBLE AS alpha, 0.6::DOUBLE AS beta, "
        f"'swap' AS mode, 'benchmark' AS topics, '{x}' AS metric, round({x}, 6) AS value FROM m t" for i, x in enumerate(("map", "ndcg_cut_10", "recall_1000")))


def swapped_grid_ctes() -> list[str]:
    g = cat.SWAP_GRID
    return ([QV, CORPUS, trials_values(DEFAULT_SEEDS, DEFAULT_SLICES, g["totals"], g["split_num"], g["depth"], g["topics"]),
             topk("first", "qv", max(g["totals"])), trial_fb("fb", "first"),
             "fbt AS (SELECT fb.*, t.total_prf_docs AS total FROM fb JOIN trials t USING (trial_id))"]
            + swap_ctes("first", "fbt", "sfb", "f.total", g["batch"]))


def dense_swapped_grid_sql() -> str:
    ctes = (swapped_grid_ctes()
            + [trial_rocchio("ref", "sfb", 0.4, 0.6, given_only=True), topk("runs", "ref", cat.DENSE.hits, keys=("trial_id", "qid"))]
            + dense_qrels() + evaluation("e", "runs", "qrels", 2, ("trial_id",)))
    return _w(*ctes) + f" SELECT x.*, t.topics FROM ({covered_sweep_select('sfb')}) x JOIN trials t USING (trial_id)"


def text_ctes(positions: str, keys: tuple[str, ...], hits: int) -> list[str]:
    """Topics and documents as hashed vectors, feedback texts appended to the topic's, encoded anew and searched (``tdr``)."""
    dim, s = cat.HASH_DIM, cat.DENSE
    kk, part = _k(keys, "f"), ", ".join(keys)
    given = "topics t" if keys == ("qid",) else "(SELECT r.trial_id, x.* FROM trials r CROSS JOIN topics x) t"
    ident = "qid" if keys == ("qid",) else "key"
    split = "qid" if keys == ("qid",) else "key.trial_id AS trial_id, key.qid AS qid"
    key = "t.qid" if keys == ("qid",) else "{'trial_id': t.trial_id, 'qid': t.qid}"
    return ["topics AS (SELECT item_id AS qid, text AS title FROM benchmark)",
            *hashed("qenc", "topics", "qid", "title", dim, "qv"),
            *hashed("denc", "(SELECT doc_id AS docid, text FROM documents)", "docid", "text", dim, "vec"),
            topk("first", "qenc", s.total_prf_docs, corpus="denc", exclude_self=False), positions,
            f"fbx AS (SELECT {kk}list(d.text ORDER BY f.fb_pos) AS texts FROM fb f JOIN documents d ON d.doc_id = f.docid GROUP BY {part})",
            f"rtext AS (SELECT {key} AS {ident}, concat_ws(' ', t.title, coalesce(array_to_string(x.texts, ' '), '')) AS title "
            f"FROM {given} LEFT JOIN fbx x USING ({part}))",
            *hashed("renc", "rtext", ident, "title", dim, "qv"), f"rq AS (SELECT {split}, qv FROM renc)",
            topk("tdr", "rq", hits, keys=keys, corpus="denc", exclude_self=False)]


def text_sweep_sql() -> str:
    ctes = ([trials_values(DEFAULT_SEEDS, DEFAULT_SLICES, cat.TEXT_TOTAL, 10, 3)]
            + text_ctes(trial_fb("fb", "first"), ("trial_id", "qid"), cat.DENSE.hits) + [SPARSE_QRELS]
            + evaluation("e", "tdr", "qrels", 2, ("trial_id",)))
    return _w(*ctes) + " " + dense_sweep_select()


def matrix_sql() -> str:
    """Hashed, signed token counts times the labels' mean vectors, L2-normalised."""
    return _w(
        "e AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)",
        "mu AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i)",
        "mat AS (SELECT i, m, dense_rank() OVER (ORDER BY label) - 1 AS b, (SELECT count(DISTINCT label) FROM mu) AS n FROM mu)",
        f"t AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower('query: ' || text), {TOKEN}, 1)) AS tok FROM benchmark)",
        "c AS (SELECT qid, ('0x' || substr(md5(tok), 1, 8))::BIGINT % (SELECT any_value(n) FROM mat) AS b, "
        "sum(CASE WHEN ('0x' || substr(md5(tok), 9, 1))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM t GROUP BY ALL)",
        "p AS (SELECT qid, i, sum(x * m) AS y FROM c JOIN mat USING (b) GROUP BY qid, i)",
        "v AS (SELECT qid, list(y ORDER BY i) AS v, sqrt(sum(y * y)) AS n FROM p GROUP BY qid)") + (
        " SELECT qid, list_transform(v, lambda y: round(CASE WHEN n > 0 THEN y / n ELSE y END, 6)) AS qv FROM v")


def swapped_sql() -> str:
    sw_ = cat.SWAP
    pos = sample_positions(sw_["seed"], sw_["depth"], sw_["total"], sw_["split_num"], sw_["nsplit"])
    n_b = sw_["batch"]
    return _w(QV, CORPUS, topk("first", "qv", cat.DENSE_K), positions_fb("fb", "first", pos),
              f"mem0 AS (SELECT item_id AS qid, ((row_number() OVER (ORDER BY item_id) - 1) // {n_b}) AS batch, "
              f"md5('{sw_['seed']}:' || item_id) AS k FROM benchmark)",
              "mem AS (SELECT qid, batch, (row_number() OVER (PARTITION BY batch ORDER BY k) - 1) AS i, "
              "count(*) OVER (PARTITION BY batch) AS n FROM mem0)",
              "shifts AS (SELECT qid, batch, i, n, unnest(range(1, n)) AS shift FROM mem)",
              "cand AS (SELECT m.qid, m.batch, m.shift, d.qid AS donor FROM shifts m "
              "JOIN mem d ON d.batch = m.batch AND d.i = (m.i + m.shift) % m.n)",
              f"bad AS (SELECT DISTINCT c.batch, c.shift FROM cand c JOIN fb f ON f.qid = c.donor JOIN first o "
              f"ON o.qid = c.qid AND o.docid = f.docid AND o.rank <= {sw_['total']})",
              "ok AS (SELECT c.batch, min(c.shift) AS shift FROM (SELECT DISTINCT batch, shift FROM cand) c "
              "ANTI JOIN bad b ON b.batch = c.batch AND b.shift = c.shift GROUP BY c.batch)",
              "asg AS (SELECT c.qid, c.donor FROM cand c JOIN ok USING (batch, shift))") + (
        " SELECT 0 AS trial_id, a.qid, f.fb_pos, f.docid, round(f.score, 6) AS score FROM asg a JOIN fb f ON f.qid = a.donor")


def donor_sql() -> str:
    pos = sample_positions(42, 3, 100, 10, 0)
    return _w(QV, CORPUS, topk("first", "qv", cat.DENSE_K), positions_fb("fb", "first", pos),
              "idx AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS i, count(*) OVER () AS n FROM "
              "(SELECT DISTINCT qid FROM first))",
              "base AS (SELECT x.qid, x.i, x.n, ((x.i - 1 - (('0x' || substr(md5('42:' || x.qid), 1, 8))::BIGINT % (x.n - 1))) "
              "% x.n + x.n) % x.n AS start FROM idx x WHERE x.qid IN (SELECT qid FROM fb))",
              "steps AS (SELECT qid, i, n, start, unnest(range(0, n)) AS step FROM base)",
              "cand AS (SELECT b.qid, b.step, d.qid AS donor FROM steps b JOIN idx d "
              "ON d.i = ((b.start - b.step) % b.n + b.n) % b.n WHERE d.i <> b.i AND d.qid IN (SELECT qid FROM fb))",
              "bad AS (SELECT DISTINCT c.qid, c.step FROM cand c JOIN fb f ON f.qid = c.donor JOIN first o "
              "ON o.qid = c.qid AND o.docid = f.docid AND o.rank <= 100)",
              "asg AS (SELECT qid, arg_min(donor, step) AS donor FROM (SELECT * FROM cand ANTI JOIN bad USING (qid, step)) "
              "GROUP BY qid)") + (
        " SELECT 0 AS trial_id, a.qid, f.fb_pos, f.docid, round(f.score, 6) AS score FROM asg a JOIN fb f ON f.qid = a.donor")


def sparse_sweep_sql(donor: bool = False) -> str:
    s = cat.SPARSE
    sel = donor_ctes("first", "fb0", "fb") if donor else []
    given = ("SELECT DISTINCT trial_id, qid FROM fb" if donor else
             "SELECT t.trial_id, x.item_id AS qid FROM trials t CROSS JOIN benchmark x")
    ctes = SPARSE_BASE + [
        trials_values(DEFAULT_SEEDS, DEFAULT_SLICES, cat.SPARSE_TOTALS, 10, 3), bm25("first", "bow", s.k),
        trial_fb("fb0" if donor else "fb", "first"), *sel,
        mean_fb("fbv", "fb", keys=("trial_id", "qid")),
        f"terms AS (SELECT trial_id, qid, term, sum(weight) AS weight FROM (SELECT t.trial_id, b.qid, b.term, "
        f"b.weight * {s.alpha} AS weight FROM ({given}) t JOIN bow b USING (qid) "
        f"UNION ALL SELECT trial_id, qid, term, weight * {s.beta} FROM fbv) WHERE weight > 0 GROUP BY trial_id, qid, term)",
        bm25("runs", "terms", s.k, keys=("trial_id", "qid")), SPARSE_QRELS,
    ] + evaluation("e", "runs", "qrels", 2, ("trial_id",))
    return _w(*ctes) + " " + (covered_sweep_select("fb") if donor else dense_sweep_select())


ORACLE = build()
