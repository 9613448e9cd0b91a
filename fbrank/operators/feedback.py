"""Feedback selection F1-F7, P1, P6, S8.

A ranking ``run`` is ``(keys..., qid, docid, rank)`` with 1-based ranks.  Feedback output is
``(keys..., qid, fb_pos INT, docid, score)`` where ``fb_pos`` is the dense 0-based order of
the surviving feedback documents (T15: absent ranks simply produce no row, P1).

Trials are rows ``(trial_id, seed, depth, total, split_num, nsplit, ...)``; the sampled
positions of every trial come with the grid (F2) and are joined to the run by rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fbrank.functions.positions import sample_positions, seeded_offset, seeded_order_key
from fbrank.operators.search import index_in_order


def _dense_fb_pos(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "qid").orderBy("rank")
    return df.withColumn("fb_pos", (F.row_number().over(w) - 1).cast("int"))


def select_natural(run: DataFrame, depth: int, *, keys: Sequence[str] = ()) -> DataFrame:
    """the first ``depth`` documents of each topic."""
    out = run.filter(F.col("rank") <= depth)
    return out.select(*keys, "qid", (F.col("rank") - 1).cast("int").alias("fb_pos"), "docid", "score")


def select_positions(run: DataFrame, positions: Sequence[int], *, keys: Sequence[str] = ()) -> DataFrame:
    """F3 for one literal setting: the same 0-based positions for every topic."""
    ranks = [int(p) + 1 for p in positions]
    if not ranks:
        return run.limit(0).select(*keys, "qid", F.lit(0).alias("fb_pos"), "docid", "score")
    out = run.filter(F.col("rank").isin(ranks))
    return _dense_fb_pos(out, keys).select(*keys, "qid", "fb_pos", "docid", "score")


def select_random_split(run: DataFrame, *, seed: int, depth: int, total: int, split_num: int, nsplit: int,
                        keys: Sequence[str] = ()) -> DataFrame:
    """positions sampled from slice ``nsplit`` of the first ``total`` ranks."""
    return select_positions(run, sample_positions(seed, depth, total, split_num, nsplit), keys=keys)


def validate_trials(trials: DataFrame) -> DataFrame:
    """The trials that cannot run, with a reason (empty frame = all valid)."""
    width = F.floor(F.col("total_prf_docs") / F.col("split_num"))
    reason = (F.when(F.col("split_num") <= 0, F.lit("split_num must be positive"))
              .when(F.col("nsplit") < 0, F.lit("negative nsplit"))
              .when(F.col("nsplit") >= F.col("split_num"), F.lit("slice beyond the last one"))
              .when(F.col("prf_depth") > width, F.lit("sample larger than slice")))
    return trials.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def select_for_trials(run: DataFrame, trials: DataFrame, *, run_keys: Sequence[str] = ()) -> DataFrame:
    """F3 for many trials at once: run ranks joined to each trial's positions.

    ``trials`` must carry ``trial_id`` and ``positions``; it is a configuration table (one row
    per grid cell, size known when the grid is built), so it is broadcast.
    """
    pos = (trials.select("trial_id", *run_keys, F.posexplode("positions").alias("_i", "pos"))
           .select("trial_id", *run_keys, (F.col("pos") + 1).alias("rank")))
    out = run.join(F.broadcast(pos), [*run_keys, "rank"])
    return _dense_fb_pos(out, ["trial_id"]).select("trial_id", "qid", "fb_pos", "docid", "score")


def overlaps(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows of ``a`` that share a document with ``b`` on the same keys (semi join)."""
    return a.join(b.select(*on).distinct(), list(on), "left_semi")


def _first_gap(taken: DataFrame, keys: Sequence[str], value: str, out: str, start: int) -> DataFrame:
    """Per ``keys`` the smallest integer from ``start`` on that isn't among the distinct ``value``s: in sorted
    order the first value ahead of its place, else the one after the last."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(value)) + F.lit(start - 1)
    gap = F.min(F.when(F.col(value) > F.col("_place"), F.col("_place")))
    return (taken.withColumn("_place", place).groupBy(*keys)
            .agg(F.coalesce(gap, F.max("_place") + 1).cast("int").alias(out)))


def select_swapped(run: DataFrame, trials: DataFrame, topics_batched: DataFrame) -> DataFrame:
    """swap feedback sets within each batch so no topic gets a document of its own top-``total``.

    Within a batch of n topics ordered by md5(seed:qid), topic i receives the feedback of topic
    (i+s) mod n for the smallest shift s in 1..n-1 valid for the whole batch; donors keep their
    documents and scores (T5).  A batch with no valid shift (or n = 1) gets no rows.

    Shifts are not tried: a donor's document among a recipient's own forbids the one shift
    (i_donor - i_recipient) mod n, and the answer is the smallest number that nothing forbids.
    Conflicts come from one join on (batch, document) for all trials of a seed, and are reduced to
    one row per (seed, batch, position, shift) with the best rank at which the shift is forbidden, which
    any total then reads.  The plan has no rounds and does not grow with the batch.

    ``run``: (qid, docid, rank, score) first ranking; ``trials``: trial_id, seed, total_prf_docs,
    positions, batch_size; ``topics_batched``: (batch_size, qid, batch) from R11.  If both have a column
    ``topics``, a trial covers the batches of its own topic set.
    """
    if not ("topics" in trials.columns and "topics" in topics_batched.columns):
        trials, topics_batched = trials.withColumn("topics", F.lit("")), topics_batched.withColumn("topics", F.lit(""))
    cell = ["seed", "batch_size", "topics"]
    at = F.broadcast(trials.select("trial_id", *cell, "total_prf_docs", F.explode("positions").alias("pos")))  # configuration
    slots = at.select(*cell, "pos").distinct()
    seeds = F.broadcast(trials.select(*cell).distinct())
    batch = [*cell, "batch"]
    wb = Window.partitionBy(*batch)
    order = (topics_batched.join(seeds, ["batch_size", "topics"])
             .withColumn("i", (F.row_number().over(wb.orderBy(seeded_order_key("seed", "qid"))) - 1).cast("int"))
             .withColumn("n", F.count(F.lit(1)).over(wb).cast("int")).select(*batch, "qid", "i", "n"))
    ranked = run.select("qid", "docid", "rank")
    given = (ranked.join(F.broadcast(slots.select(*cell, (F.col("pos") + 1).alias("rank"))), "rank")
             .join(order, [*cell, "qid"])
             .select(*batch, "docid", (F.col("rank") - 1).alias("pos"), F.col("qid").alias("donor"), F.col("i").alias("di")))
    most = trials.agg(F.max("total_prf_docs")).scalar()
    own = (ranked.filter(F.col("rank") <= most).join(topics_batched, "qid")
           .select("batch_size", "topics", "batch", "docid", "qid", "rank"))
    met = given.join(own, ["batch_size", "topics", "batch", "docid"]).filter(F.col("donor") != F.col("qid"))
    forbidden = (met.join(order, [*batch, "qid"])
                 .groupBy(*batch, "pos", F.pmod(F.col("di") - F.col("i"), F.col("n")).alias("shift"))
                 .agg(F.min("rank").alias("rank")))
    taken = (forbidden.join(at, [*cell, "pos"]).filter(F.col("rank") <= F.col("total_prf_docs"))
             .select("trial_id", "batch", "shift").distinct())
    gaps = _first_gap(taken, ["trial_id", "batch"], "shift", "shift", 1)
    # one row per member and trial; batches that nothing is forbidden in take shift 1
    members = order.join(F.broadcast(trials.select("trial_id", *cell)), cell)
    assign = (members.join(gaps, ["trial_id", "batch"], "left").withColumn("shift", F.coalesce("shift", F.lit(1)))
              .filter(F.col("shift") < F.col("n")).withColumn("di", F.pmod(F.col("i") + F.col("shift"), F.col("n"))))
    donors = order.select(*batch, F.col("i").alias("di"), F.col("qid").alias("donor"))
    return (assign.join(donors, [*batch, "di"]).select("trial_id", "qid", "donor")
            .join(select_for_trials(run, trials).withColumnRenamed("qid", "donor"), ["trial_id", "donor"])
            .select("trial_id", "qid", "fb_pos", "docid", "score"))


RING_CHUNK = 1 << 16  # topics that are numbered together in a ring


def select_donor(run: DataFrame, trials: DataFrame) -> DataFrame:
    """each topic takes the feedback of a donor topic whose chosen documents are disjoint
    from its own top-``total``; search backwards cyclically from a seeded start, skipping self.

    With the n topics of the run in qid order at index i, the start is
    (i - 1 - h mod (n-1)) mod n, h = first 8 hex digits of md5(seed:qid); step s tries
    (start - s) mod n.  Topics without documents at the trial's positions neither give nor
    receive; topics with no valid donor get no rows.  Donors may repeat.

    Steps are not tried: the topics that can give form a ring, a conflict forbids one step back from the
    start in it, and so does the topic itself; the answer is the smallest step that nothing forbids.
    """
    rank1 = run.groupBy("qid").agg(F.max("rank").alias("len"))
    idx = index_in_order(rank1, "qid", "i").withColumn("i", F.col("i").cast("int"))
    n = idx.agg(F.count(F.lit(1)).cast("int")).scalar()
    least = F.broadcast(trials.filter(F.size("positions") > 0).select("trial_id", "seed", "total_prf_docs", F.array_min("positions").alias("least")))
    # per least position the ring of the topics whose ranking reaches it, with the count of them up to each topic
    leasts = sorted({r[0] for r in least.select("least").distinct().collect()})  # the grid is configuration
    rings = (idx.withColumn("least", F.explode(F.lit(leasts).cast("array<int>"))).withColumn("in", (F.col("len") > F.col("least")).cast("int"))
             .withColumn("chunk", F.floor(F.col("i") / RING_CHUNK).cast("int")))
    sums = rings.groupBy("least", "chunk").agg(F.sum("in").alias("n_in"))
    upto = sums.select("least", "chunk", (F.sum("n_in").over(Window.partitionBy("least").orderBy("chunk")) - F.col("n_in")).alias("before"),
                       F.sum("n_in").over(Window.partitionBy("least")).alias("ring"))
    within = F.sum("in").over(Window.partitionBy("least", "chunk").orderBy("i"))
    rings = (rings.withColumn("cum", within).join(upto, ["least", "chunk"])
             .select("least", "i", "qid", "in", (F.col("before") + F.col("cum")).cast("int").alias("cum"), F.col("ring").cast("int").alias("ring")))
    members = rings.filter("in = 1").select("least", "qid", "i", (F.col("cum") - 1).alias("j"), "ring")
    offset = F.pmod(seeded_offset("seed", "qid"), F.greatest(n - 1, F.lit(1)))
    starts = (members.join(F.broadcast(least.select("least", "seed").distinct()), "least")
              .withColumn("start", F.pmod(F.col("i") - 1 - offset, n).cast("int"))
              .join(rings.select("least", F.col("i").alias("start"), "cum"), ["least", "start"])
              .select("least", "seed", "qid", "j", "ring", F.pmod(F.col("cum") - 1, F.col("ring")).alias("j0")))
    # conflicts, once for all trials: a document at a position of the donor's among the recipient's own
    at = F.broadcast(trials.select("trial_id", "seed", "total_prf_docs", F.array_min("positions").alias("least"), F.explode("positions").alias("pos")))
    ranked = run.select("qid", "docid", "rank")
    used = F.broadcast(at.select((F.col("pos") + 1).alias("rank")).distinct())
    most = trials.agg(F.max("total_prf_docs")).scalar()
    given = ranked.join(used, "rank").select("docid", (F.col("rank") - 1).alias("pos"), F.col("qid").alias("donor"))
    met = (given.join(ranked.filter(F.col("rank") <= most), "docid").filter(F.col("donor") != F.col("qid"))
           .groupBy("pos", "donor", "qid").agg(F.min("rank").alias("rank")))
    pairs = (met.join(at, "pos").filter(F.col("rank") <= F.col("total_prf_docs"))
             .select("trial_id", "seed", "least", "qid", "donor").distinct())
    back = F.pmod(F.col("j0") - F.col("dj"), F.col("ring"))
    barred = (pairs.join(starts, ["least", "seed", "qid"]).join(members.select("least", F.col("qid").alias("donor"), F.col("j").alias("dj")), ["least", "donor"])
              .select("trial_id", "qid", back.alias("step")))
    entered = starts.join(least.select("trial_id", "seed", "least"), ["least", "seed"])
    itself = entered.select("trial_id", "qid", F.pmod(F.col("j0") - F.col("j"), F.col("ring")).alias("step"))
    steps = _first_gap(barred.unionByName(itself), ["trial_id", "qid"], "step", "step", 0)
    taken = (entered.join(steps, ["trial_id", "qid"]).filter(F.col("step") < F.col("ring"))
             .select("trial_id", "qid", "least", F.pmod(F.col("j0") - F.col("step"), F.col("ring")).alias("dj")))
    donors = members.select("least", F.col("j").alias("dj"), F.col("qid").alias("donor"))
    return (taken.join(donors, ["least", "dj"]).select("trial_id", "qid", "donor")
            .join(select_for_trials(run, trials).withColumnRenamed("qid", "donor"), ["trial_id", "donor"])
            .select("trial_id", "qid", "fb_pos", "docid", "score"))


def selection_log(feedback: DataFrame, trials: DataFrame, *, rand_prf: bool = False) -> DataFrame:
    """One log row per (trial, topic): seed, chosen docids and positions in order."""
    g = (feedback.groupBy("trial_id", "qid")
         .agg(F.array_sort(F.collect_list(F.struct("fb_pos", "docid"))).alias("_fb")))
    return (g.join(trials.select("trial_id", "seed", "positions"), "trial_id")
            .select("trial_id", "seed", "qid",
                    F.transform("_fb", lambda x: x["docid"]).alias("docids"),
                    F.col("positions"),
                    F.lit(rand_prf).alias("rand_prf")))
