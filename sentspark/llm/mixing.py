"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within their source.  Each source takes
all its documents as often as its target holds them whole; what then remains
of the target is a budget below the source's size.  Lengths first give their
proportional share of documents, then a bounded knapsack over the remaining
budget finds how many more documents of each length bring the sum closest to
it.  Which documents of a length those are is a seeded choice.

Nothing but one row per (source, length) reaches a single task.  The seeded
choice numbers documents in two levels, hash slots and then rows of the one
slot in which a length's count ends, so a length that holds a third of all
rows is never sorted in one task.

Defined cases: null text has size 0; a null source is a source of its own,
last in order; documents of size 0 are taken as often as their source is taken
whole, and count nothing; a source without words has target 0; repeated rows
are documents of their own (which of two alike is taken can't be told apart);
an empty table gives an empty result.  Words are counted over whole texts,
however long.  Ties between documents of one length are settled by the seeded
hash, then by the row.  Only the id, source and text are read, and ``mix``
carries all columns in one struct, so no names clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .tables import SPACE_WORD, land, pick, row_key, text_or_empty

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SLOTS = 256
#: Words of budget that the knapsack solves exactly; a larger rest is first
#: brought below it by whole documents.
KNAPSACK = 1 << 16


def weigh(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, stop: int = MAX_COPIES) -> DataFrame:
    """``source, source_size`` -> plus ``target``: one row per source.

    Targets share all words by weight.  A source is full at ``stop`` times its
    size; filling goes on in the order of ``stop * size / weight``, so the full
    sources are a prefix of that order and the rest share what is left.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    whole = Window.partitionBy()
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    t = (sizes.withColumn("_w", weight)
         .withColumn("_cap", F.col("source_size") * F.lit(float(stop)))
         .withColumn("_ratio", F.col("_cap") / F.col("_w"))
         .withColumn("_all", F.sum("source_size").over(whole).cast("double"))
         .withColumn("_w_all", F.sum("_w").over(whole))
         .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
         .withColumn("_w_before", F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # the share of one weight if all earlier in the order are full and no later one is
    t = t.withColumn("_left", F.col("_all") - F.col("_cap_before")) \
         .withColumn("_w_left", F.col("_w_all") - F.col("_w_before")) \
         .withColumn("_full", F.col("_cap") * F.col("_w_left") <= F.col("_left") * F.col("_w"))
    first = F.min(F.when(~F.col("_full"), F.struct("_ratio", F.col("source").isNull().alias("n"), "source",
                                                   "_left", "_w_left"))).over(whole)
    t = t.withColumn("_open", first)
    share = F.col("_open._left") * F.col("_w") / F.col("_open._w_left")
    return t.select("source", "source_size",
                    F.when(F.col("_full") | F.col("_open").isNull(), F.col("_cap"))
                    .otherwise(share).alias("target"))


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length, at most its count, bring the sum closest to
    ``budget`` (a tie takes the smaller sum)."""
    taken = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0 or not len(lengths):
        return taken
    reach = 2 * int(budget) + 1                  # a larger sum is no closer than 0
    by = np.full(reach, -1, dtype=np.int64)     # the part that first made a sum
    made = np.zeros(reach, dtype=bool)
    made[0] = True
    parts: list[tuple[int, int]] = []
    for k in range(len(lengths)):
        if made[budget]:
            break
        length, left, piece = int(lengths[k]), int(counts[k]), 1
        left = min(left, (reach - 1) // length)
        while left > 0:                          # binary splitting of the count
            n = min(piece, left)
            w = n * length
            new = np.zeros(reach, dtype=bool)
            if w < reach:
                new[w:] = made[:reach - w]
                new &= ~made
                by[new] = len(parts)
                made |= new
            parts.append((k, n))
            left -= n
            piece *= 2
    sums = np.flatnonzero(made)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        k, n = parts[by[at]]
        taken[k] += n
        at -= n * int(lengths[k])
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, knapsack_words: int = KNAPSACK) -> np.ndarray:
    """Documents of each length whose words sum to nearly ``budget``."""
    taken = np.zeros(len(lengths), dtype=np.int64)
    words = int((lengths * counts).sum())
    if budget <= 0 or words == 0:
        return taken
    if budget >= words:
        return counts.astype(np.int64)
    share = [int(c) * int(budget) for c in counts]
    taken = np.array([s // words for s in share], dtype=np.int64)
    spare = np.array([s % words for s in share], dtype=np.float64)
    rest = int(budget) - int((taken * lengths).sum())
    left = counts - taken
    order = np.lexsort((lengths, -spare))        # those cut off most come first
    for k in order:
        if rest <= knapsack_words:
            break
        n = min(int(left[k]), rest // int(lengths[k]), 1 + (rest - knapsack_words) // int(lengths[k]))
        taken[k] += n
        left[k] -= n
        rest -= n * int(lengths[k])
    use = order[(left[order] > 0) & (lengths[order] <= 2 * rest)]
    taken[use] += knapsack(lengths[use], left[use], rest)
    return taken


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    own, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    times = min(int(target // own), MAX_COPIES) if own else 0
    budget = round(target - times * own) if times < MAX_COPIES else 0
    some = lengths > 0
    more = np.zeros(len(lengths), dtype=np.int64)
    more[some] = fit(lengths[some], counts[some], budget)
    return pd.DataFrame({"source": pdf["source"], "size": lengths, "source_size": own, "target": target,
                         "times": times, "more": more})


def annotate(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken, row_key, source`` for every row."""
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                       F.regexp_count(text_or_empty(f"`{text_col}`"), F.lit(SPACE_WORD)).cast("long").alias("size"),
                       row_key(f"`{text_col}`").alias("row_key"))
    base = base.withColumn("rank", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("row_key"))) \
               .withColumn("slot", F.pmod("rank", F.lit(SLOTS)))
    base = land(base, "mix-sizes")
    slots = land(base.groupBy("source", "size", "slot").agg(F.count(F.lit(1)).alias("n")), "mix-slots")
    lengths = slots.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = weigh(sizes)
    t, h = targets.alias("t"), lengths.alias("h")
    rows = (h.join(t, F.col("h.source").eqNullSafe(F.col("t.source")))
            .select("h.source", "h.size", "h.n", "t.source_size", "t.target"))
    plan = land(rows.groupBy("source").applyInPandas(
        _fit_source, "source string, size long, source_size long, target double, times long, more long"),
        "mix-plan")
    # slots before the one in which a length's count ends are taken whole
    upto = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    s = slots.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).alias("s")
    p = plan.alias("p")
    cut = (s.join(p, F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.size") == F.col("p.size")))
           .select("s.source", "s.size", "s.slot", "p.source_size", "p.target", "p.times",
                   F.greatest(F.lit(0), F.least(F.col("s.n"), F.col("p.more") - F.col("s.before"))).alias("here"),
                   F.col("s.n").alias("n")))
    b, c = base.alias("b"), cut.alias("c")
    placed = (b.join(c, F.col("b.source").eqNullSafe(F.col("c.source")) & (F.col("b.size") == F.col("c.size"))
                     & (F.col("b.slot") == F.col("c.slot")))
              .select("b.*", "c.source_size", "c.target", "c.times", "c.here", "c.n"))
    placed = land(placed, "mix-placed")
    whole = placed.where("here = 0 OR here = n").withColumn("extra", (F.col("here") > 0).cast("long"))
    nth = F.row_number().over(Window.partitionBy("source", "size", "slot").orderBy("rank", "doc_id"))
    part = (placed.where("here > 0 AND here < n")
            .withColumn("extra", (nth <= F.col("here")).cast("long")))
    out = whole.unionByName(part).withColumn("copies", F.col("times") + F.col("extra"))
    return out.select("doc_id", "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"), "row_key", "source")


def mix(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """The mix: rows of ``docs``, each as often as it is taken."""
    taken = annotate(docs, seed, id_col, text_col, source_col)
    own = taken.select(F.col("doc_id").alias(id_col), "row_key", "copies", F.col("source").alias(source_col))
    return pick(docs, own, "copies", id_col, text_col, also=(source_col,))
