"""Mixing sources to target weights by subset-sum budget fitting (operator 6).

Every source gets a target number of words by weight. Documents are counted by
exact length; a bounded knapsack over these counts picks how many documents of each
length to take so that the words come out at the target; seeded documents of each
length fill the counts.

Targets: sources sorted by code point, null last, weigh 1, 2, 3, 1, 2, 3, ... and
share the words of all documents. No target exceeds `MOST` times its source's
words; the excess goes to the other sources by weight until none is above.

Fit of one source with s words and target t: every document is taken t // s times;
of the rest r = t - s * (t // s) each length gets its proportional share, rounded
down; then documents are added from the longest length down while more than
`KNAPSACK` words are open, and dynamic programming over the remaining counts meets
the last words exactly, or as nearly as their lengths allow. The knapsack sees one
row per length, never the documents.

Defined cases: a null text or one without words has size 0 and is never taken;
repeated rows are documents of their own; ties in the seeded order go to the
smaller id, then anyhow between equal rows; an empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspan.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
KNAPSACK = 4096  #: words that dynamic programming decides on
SEED = 20
_PARTS = 1024  #: parts of a length's documents that are ranked on their own


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> target words, one row per source.

    A source is full if the common level, words per unit of weight, reaches its
    limit. In ascending order of limit per weight the full ones are a prefix; the
    level is what is left over for the weights of the rest. The windows run over
    one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weighed = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    weighed = weighed.withColumn("limit", F.lit(MOST) * F.col("source_size"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    through = by_limit.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, weights = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    before = F.sum("limit").over(through) - F.col("limit")
    weights_before = F.sum("weight").over(through) - F.col("weight")
    level = (total - before) / (weights - weights_before)
    found = weighed.withColumn("_level", level).withColumn("_full", F.col("limit") < F.col("_level") * F.col("weight"))
    # the first source that is not full sets the level of all that follow it
    common = F.min(F.when(~F.col("_full"), F.struct(F.col("limit") / F.col("weight"), "_level"))).over(everything)
    return found.withColumn(
        "target",
        F.when(F.col("_full"), F.col("limit").cast("double")).otherwise(common["_level"] * F.col("weight")),
    ).select("source", "source_size", "target")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, knapsack: int = KNAPSACK) -> np.ndarray:
    """How many documents of each length to take, none above its count, to fill budget."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0 or not total:
        return np.zeros_like(counts)
    # whole-number arithmetic: a share may be rounded down, never up
    taken = np.array([c * budget // total for c in counts.tolist()], np.int64)
    left = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= knapsack:
            break
        more = min(int(counts[i] - taken[i]), (left - knapsack) // int(lengths[i]) + 1, left // int(lengths[i]))
        taken[i] += more
        left -= more * int(lengths[i])
    return taken + bounded_knapsack(lengths, counts - taken, min(left, knapsack))


def bounded_knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Counts whose words come nearest to budget from below (dynamic programming)."""
    chosen = np.zeros_like(counts)
    reached = np.full(budget + 1, -1, np.int64)  # the item that first reached a sum
    used = np.zeros(budget + 1, np.int64)  # how many of that item it takes
    reached[0] = len(lengths)
    for i in np.flatnonzero((lengths <= budget) & (counts > 0)):
        length, most = int(lengths[i]), int(counts[i])
        for count in range(1, min(most, budget // length) + 1):
            # from sums that hold count - 1 of this item to sums that hold count
            before = (reached == i) & (used == count - 1) if count > 1 else (reached >= 0) & (reached != i)
            to = np.flatnonzero(before[: budget + 1 - length]) + length
            to = to[reached[to] < 0]
            if not len(to):
                break
            reached[to] = i
            used[to] = count
        if reached[budget] >= 0:
            break
    at = int(np.flatnonzero(reached >= 0)[-1])
    while at:
        i = reached[at]
        chosen[i] += used[at]
        at -= int(used[at] * lengths[i])
    return chosen


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    times = min(int(target // size), MOST)
    rest = int(np.floor(target - times * size + 0.5)) if times < MOST else 0
    extra = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), rest)
    return pd.DataFrame({"group": pdf["group"], "size": pdf["size"], "times": times, "extra": extra})


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source and size of every document with its source's size and target,
    and `times`: how often the mix takes it (0 to MOST)."""
    rows = docs.select("doc_id", "source", word_count().alias("size"))
    rows = rows.withColumn("group", F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit(""))))
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), "doc_id"))
    rows = stored(rows.withColumn("part", F.pmod(F.shiftright("order", 53), F.lit(_PARTS))), "mix-sizes")
    lengths = stored(rows.groupBy("group", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    sizes = lengths.groupBy("group", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = stored(targets(sizes.drop("group")).join(sizes.select("group", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source"), "mix-targets")
    plan = (
        lengths.where("size > 0").join(wanted, "group").groupBy("group")
        .applyInPandas(_fit_source, "group string, size long, times long, extra long")
    )
    # rank documents of one length in the seeded order: parts of the order are
    # counted, and only documents of one part are sorted together
    parts = rows.groupBy("group", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy("group", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0)))
    parts = parts.join(plan, ["group", "size"], "left").join(wanted, "group")
    parts = parts.select("group", "size", "part", "before", "times", "extra", "source_size", "target")
    within = Window.partitionBy("group", "size", "part").orderBy("order", "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(within)).join(parts, ["group", "size", "part"])
    extra = (F.col("before") + F.col("rank") <= F.col("extra")).cast("long")
    times = F.coalesce(F.col("times") + extra, F.lit(0)).cast("long")
    return ranked.select("doc_id", "source", "size", "source_size", "target", times.alias("times"))


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    return mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


def draw(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed documents: each as often as the mix takes it, columns unchanged.

    Rows that share id, source and size differ by one time at most; the smaller texts
    by hash are taken once more.
    """
    docs_key = F.xxhash64("doc_id", "source", word_count()).alias("_key")
    taken = mix(docs, seed).select(F.xxhash64("doc_id", "source", "size").alias("_key"), "times").groupBy("_key").agg(
        F.min("times").alias("_low"),
        (F.sum("times") - F.count("times") * F.min("times")).alias("_more"),  # rows taken once more
    )
    kept = docs.select("*", docs_key).join(taken.where("_low + _more > 0"), "_key")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64("text"), "text"))
    kept = kept.withColumn("_times", F.col("_low") + (nth <= F.col("_more")).cast("long")).where("_times > 0")
    return kept.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*docs.columns)
