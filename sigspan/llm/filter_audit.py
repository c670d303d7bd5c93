"""Interaction audit of document filters by relations of failing ids (operator 13).

Each filter has one stored table of the ids of the rows that fail it. A prefix of
filters and the filter that follows it give one relation: the ids that fail the
latter, less (left-anti join) those that fail any filter of the prefix, which are
the rows that this step removes. What a prefix removes depends on the set of its
filters, not on their order, so k filters have k * 2^(k-1) such relations, found by
k anti-joins that carry the set as a column; all k! orders are read from their counts:

* survivors of a step are the rows of the part less all removals up to it;
* redundant rows fail the filter but went earlier: all failing ones less the removals;
* the removals after all other filters are the rows that fail this filter only;
* label losses count removed rows whose id is labelled good or toxic, which a join
  with the labels has marked once in the id tables;
* a filter's Shapley sum weighs each of its removals by the orders that contain it.

Plan: the facts of all rows are computed in one pass over the texts and stored with
a row number; what fails nothing is only counted. Failing rows are exchanged once by
row number for all joins. A row stays with each of its at most 2^(k-1) sets in
generated code, and only counts per (set, filter, part) are shuffled after that.

Defined cases: a null text is an empty one; a null part is the empty string; rows
without an id never are copies of a smaller id and have no labels; of rows with the
same id and text none is a copy of another; an id labelled several times counts as
good or toxic if any of its labels says so; an empty table gives an empty report; a
part where no row fails has zeros; other columns are not read.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspan.llm.common import stored
from sigspan.session import shared_dir

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MIN_DISTINCT = 65  #: per cent of words that must be distinct
MAX_CAPITALS = 5  #: per cent of code points that may be A-Z
SYMBOLS = "[#$%&*|]"


def text_facts(docs: DataFrame, part: str = "source") -> DataFrame:
    """row, doc_id, part, digest of the text, and whether it fails filters A, B, C and D."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        (100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS * F.length(text)).alias("C"),
        text.rlike(SYMBOLS).alias("D"),
        words.alias("words"),
    )
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    return rows.select(
        "row", "doc_id", "part", "digest",
        (n < MIN_WORDS).alias("A"), (100 * distinct < MIN_DISTINCT * n).alias("B"), "C", "D",
    )


def copies(facts: DataFrame) -> DataFrame:
    """The rows whose text also stands under a smaller id.

    All rows but those that are the first of their text: an anti-join on digest and
    id, which spreads over the cluster however often one text occurs.
    """
    named = facts.where(F.col("doc_id").isNotNull())
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return named.join(firsts, ["digest", "doc_id"], "left_anti")


def failing(facts: DataFrame) -> dict[str, DataFrame]:
    """filter -> the rows (row, doc_id, part) that fail it."""
    found = {name: facts.where(name) for name in "ABCD"} | {"E": copies(facts)}
    return {name: rows.select("row", "doc_id", "part") for name, rows in found.items()}


def _marked(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with `good` and `toxic`; rows without an id move nowhere."""
    by_id = labels.where("doc_id is not null").groupBy("doc_id")
    by_id = by_id.agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    named = rows.where("doc_id is not null").join(by_id, "doc_id", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    none = [F.lit(False).alias(c) for c in ("good", "toxic")]
    keys = ["filter", "row", "part"]
    return named.select(*keys, *flags).unionByName(rows.where("doc_id is null").select(*keys, *none))


def id_tables(fails: dict[str, DataFrame], labels: DataFrame) -> dict[str, DataFrame]:
    """filter -> its stored table (row, part, good, toxic)."""
    tagged = [rows.select(F.lit(name).alias("filter"), "row", "doc_id", "part") for name, rows in fails.items()]
    marked = _marked(reduce(DataFrame.unionByName, tagged), labels)
    spark, path = marked.sparkSession, shared_dir(marked.sparkSession, "failing-ids")
    marked.write.partitionBy("filter").parquet(path)
    every = spark.read.schema(marked.schema).parquet(path)
    return {f: every.where(F.col("filter") == f).drop("filter") for f in fails}


def removals(tables: dict[str, DataFrame]) -> DataFrame:
    """(key, part) -> n, good, toxic: what each filter removes after each set of others.

    key: the set's bits times the number of filters, plus the filter's place. A row
    that fails a filter starts with the empty set. Each filter in turn offers every
    set without it also with it, and an anti-join drops the rows that it would have
    removed by then. So k joins on one partitioning serve all k * 2^(k-1) relations.
    """
    k = len(tables)
    starts = [rows.select(F.lit(i).alias("place"), "*") for i, rows in enumerate(tables.values())]
    left = reduce(DataFrame.unionByName, starts).withColumn("set", F.lit(0)).repartition("row")
    for i, rows in enumerate(tables.values()):
        both = F.array(F.lit(False), F.lit(True))
        choices = F.explode(F.when(F.col("place") == i, F.array(F.lit(False))).otherwise(both))
        left = left.select("row", "part", "good", "toxic", "place", "set", choices.alias("after"))
        gone = rows.select(F.col("row").alias("gone")).hint("merge")
        left = left.join(gone, F.col("after") & (F.col("row") == F.col("gone")), "left_anti")
        left = left.withColumn("set", F.col("set") + F.when(F.col("after"), 1 << i).otherwise(0)).drop("after")
    return left.groupBy((F.col("set") * k + F.col("place")).alias("key"), "part").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )


def _mask(names: str, filters: str) -> int:
    return sum(1 << names.index(f) for f in filters)


def _steps(names: str) -> str:
    """All steps of all orders as JSON; keys: those of the removals up to the step."""
    every, k = [], len(names)
    for order in permutations(names):
        keys: list[int] = []
        for i, f in enumerate(order):
            place = names.index(f)
            keys = [*keys, _mask(names, order[:i]) * k + place]
            alone = ((1 << k) - 1 - (1 << place)) * k + place
            step = {"filter_order": "".join(order), "step": i + 1, "keys": keys, "place": place, "alone": alone}
            every.append(step)
    return json.dumps(every)


_STEP = "array<struct<filter_order: string, step: int, keys: array<int>, place: int, alone: int>>"


def orders_report(totals: DataFrame, removals: DataFrame, names: str) -> DataFrame:
    """One row per part, order of filters and step, from the counts of all removals.

    totals: (part, n_rows). A part has at most k * 2^(k-1) counts, in one map.
    """
    k = len(names)
    # the filter stands behind a set of s others in s! * (k - 1 - s)! orders
    weight = F.get(
        F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k)]),
        F.bit_count(F.floor(F.col("key") / k)),
    )
    place = F.col("key") % k
    sums = F.array(*[F.coalesce(F.sum(F.when(place == i, F.col("n") * weight)), F.lit(0)) for i in range(k)])
    cells = F.map_from_entries(F.collect_list(F.struct("key", F.struct("n", "good", "toxic"))))
    by_part = removals.groupBy("part").agg(cells.alias("cells"), sums.alias("sums"))

    def count(key: Column, field: str = "n") -> Column:
        return F.coalesce(F.try_element_at("cells", key)[field], F.lit(0).cast("long"))

    last = F.element_at("keys", -1)
    gone = F.aggregate("keys", F.lit(0).cast("long"), lambda total, key: total + count(key))
    steps = F.from_json(F.lit(_steps(names)), _STEP)
    wide = totals.join(by_part, "part", "left").select("part", "n_rows", "cells", "sums", F.inline(steps))
    return wide.select(
        "part",
        "filter_order",
        "step",
        (F.col("n_rows") - gone).alias("kept"),
        count(last).alias("removed"),
        (count(F.col("place")) - count(last)).alias("redundant"),
        count(F.col("alone")).alias("unique_fails"),
        count(last, "good").alias("good_lost"),
        count(last, "toxic").alias("toxic_lost"),
        F.coalesce(F.get("sums", F.col("place")), F.lit(0)).cast("long").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over documents, for all orders and every source."""
    facts = stored(text_facts(docs), "audit-facts")
    tables = id_tables(failing(facts), labels)
    counts = stored(removals(tables), "audit-removals")
    totals = facts.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"))
    return orders_report(totals, counts, "".join(tables))
