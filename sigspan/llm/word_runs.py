"""Periodic runs of words by the branching-tandem test on an enhanced suffix array (operator 11).

A slice of texts becomes one sequence of word numbers, where no number is shared
by two texts, so that suffixes of different texts never agree. Its suffix array
comes from prefix doubling (only suffixes that are still tied are sorted again),
the LCP array from its irreducible values, and the LCP intervals from the
positions of the next smaller values on both sides; no tree is built.

In an interval of depth d all suffixes share d words. For every suffix i of all
but the largest child of the interval, i + d and i - d are looked up in the
inverse array: if one lies in the interval, but in another child, then two equal
blocks of d words stand side by side and differ in the word that follows: a
branching tandem, the last square of a run of period d. Since each suffix is in a
smaller child at most log n times, all tandems take O(n log n) steps. The square
is rotated to the left as far as words agree, which gives the run; tandems with
the same end whose period is a multiple of a run's are that run again and are
merged into it.

Bounds: texts are taken whole, in slices of about `SLICE_BYTES`; a longer text is
a slice of its own, with about 100 bytes for each of its words. Nothing is
shuffled.

Defined cases: null and empty texts have no runs and collapse to an empty text;
ties between runs are for the caller, who gets all of them, ordered by start and
period; repeated rows are treated alike; an empty table gives an empty result;
columns named `runs` or `collapsed` are replaced, all others pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspan.llm.common import batches, release, schema_of, small_batches

MIN_WORDS = 6
MIN_PERIODS = 4
SPACE = r"[\x20\x09-\x0D]+"
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_STEPS = 16  #: words compared in step before long matches are followed one by one


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column and the number of words of each row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    lists = pc.split_pattern_regex(column, pattern=SPACE)
    row, words = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), lists.flatten()
    real = pc.not_equal(words, "")  # a text may begin or end with space
    counts = np.bincount(row[real.to_numpy(zero_copy_only=False)], minlength=len(column))
    return words.filter(real), counts


def suffix_array(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, its inverse); a text's end sorts before any word.

    codes tell words apart within and between texts; ends: where each word's text ends.
    """
    n = len(codes)
    place = np.arange(n)
    order = np.argsort(codes, kind="stable")
    fresh = np.r_[True, codes[order[1:]] != codes[order[:-1]]]
    rank = np.empty(n, np.int64)  # the first place of a suffix's group of ties
    rank[order] = np.maximum.accumulate(np.where(fresh, place, 0))
    tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    width = 1
    while len(tied):
        after = tied + width
        inside = after < ends[tied]
        second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        by = np.argsort(rank[tied] * (n + 1) + second)
        first, second, tied = rank[tied][by], second[by], tied[by]
        group = np.r_[True, first[1:] != first[:-1]]
        fresh = group | np.r_[True, second[1:] != second[:-1]]
        at = place[: len(tied)]
        begins = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[tied] = first + begins - np.maximum.accumulate(np.where(group, at, 0))
        tied = tied[np.bincount(begins, minlength=len(tied))[begins] > 1]
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = place
    return order, rank


def _agree(codes: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """How many words agree from a and b on, at most `most`; step -1 looks to the left."""
    done, size = 0, 64
    while done < most:
        size = min(size, most - done)
        one, other = (x + step * (done + np.arange(size)) for x in (a, b))
        wrong = np.flatnonzero(codes[one] != codes[other])
        if len(wrong):
            return done + int(wrong[0])
        done, size = done + size, min(2 * size, 1 << 16)
    return done


def lcp_array(codes: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in the suffix array.

    Where the words before both suffixes agree as well, the value is one less than
    that of the suffix one place to the left (it is reducible). The others are
    counted; their sum is O(n log n).
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    begins = np.r_[True, ends[1:] != ends[:-1]]
    at = np.arange(n)
    irreducible = begins | (before < 1)
    irreducible |= begins[before] | (codes[at - 1] != codes[np.maximum(before, 1) - 1])
    counted = np.flatnonzero(irreducible)
    shared = np.zeros(n, np.int64)
    active = counted[before[counted] >= 0]
    for done in range(_STEPS):
        one, other = active + done, before[active] + done
        inside = (one < ends[active]) & (other < ends[before[active]])
        active, one, other = active[inside], one[inside], other[inside]
        active = active[codes[one] == codes[other]]
        shared[active] = done + 1
    for i in active.tolist():
        j = int(before[i])
        most = int(min(ends[i] - i, ends[j] - j)) - _STEPS
        shared[i] = _STEPS + _agree(codes, i + _STEPS, j + _STEPS, most, 1)
    last = np.maximum.accumulate(np.where(irreducible, at, 0))
    return np.maximum(shared[last] - (at - last), 0)[order]


def _bounds(lcp: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """The next place left (-1) or right (1) of each of `at` with a smaller value.

    Pointers jump over what they point at has jumped over, all in step. lcp ends
    with a zero on both sides.
    """
    to = np.arange(len(lcp)) + step
    active = at[lcp[to[at]] >= lcp[at]]
    while len(active):
        to[active] = to[to[active]]
        active = active[lcp[to[active]] >= lcp[active]]
    return to[at]


def tandems(codes: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the branching tandems that may end a run of MIN_PERIODS periods.

    sizes: the number of words of each word's text.
    """
    order, rank = suffix_array(codes, ends)
    n = len(order)
    lcp = np.r_[lcp_array(codes, ends, order), 0]
    at = np.flatnonzero(lcp > 0)
    left, right = _bounds(lcp, at, -1), _bounds(lcp, at, 1) - 1
    short = MIN_PERIODS * lcp[at] <= sizes[order[at]]  # a longer period has no run in this text
    at, left, right = at[short], left[short], right[short]
    by = np.lexsort((at, right, left))
    at, left, right = at[by], left[by], right[by]
    first = np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])][: len(at)]
    last = np.r_[first[1:], True][: len(at)]
    # children: one before the first cut of an interval, one from each cut to the next
    begin = np.concatenate([left[first], at])
    end = np.concatenate([at[first] - 1, np.where(last, right, np.r_[at[1:], 0][: len(at)] - 1)])
    interval = np.concatenate([np.cumsum(first)[first], np.cumsum(first)]) - 1
    left, right, depth = left[first], right[first], lcp[at[first]]
    width = end - begin + 1
    by = np.lexsort((-width, interval))
    small = by[np.r_[False, interval[by][1:] == interval[by][:-1]][: len(by)]]  # all but the largest
    begin, end, interval, width = begin[small], end[small], interval[small], width[small]
    child = np.repeat(np.arange(len(small)), width)
    i = order[begin[child] + np.arange(len(child)) - np.repeat(np.cumsum(width) - width, width)]
    d = depth[interval[child]]
    found = []
    for other, start in ((i + d, i), (i - d, i - d)):
        inside = (other >= 0) & (other < n)
        where = rank[np.where(inside, other, 0)]
        inside &= (where >= left[interval[child]]) & (where <= right[interval[child]])
        inside &= (where < begin[child]) | (where > end[child])
        found.append((start[inside], d[inside]))
    start, period = (np.concatenate(x) for x in zip(*found))
    # a run has two more periods before its last square
    far = start - (MIN_PERIODS - 2) * period
    fits = far >= 0
    start, period, far = start[fits], period[fits], far[fits]
    fits = (codes[far] == codes[far + period]) & (codes[start - 1] == codes[start - 1 + period])
    return start[fits], period[fits]


def runs_in(codes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of texts, in order.

    codes: the words' numbers, none shared by two texts; counts: words of each text.
    """
    if not len(codes):
        return []
    stops = np.cumsum(counts)
    ends, sizes = np.repeat(stops, counts), np.repeat(counts, counts)
    start, period = tandems(codes, ends, sizes)
    by = np.lexsort((period, start + 2 * period))
    found, known, at_end = [], [], -1
    for s, q in zip(start[by].tolist(), period[by].tolist()):
        end = s + 2 * q
        if end != at_end:
            known, at_end = [], end
        if any(q % p == 0 and length >= 2 * q for p, length in known):
            continue  # the same run, or one inside it, by a multiple of its period
        begin = int(ends[s] - sizes[s])
        length = 2 * q + _agree(codes, s - 1, s + q - 1, s - begin, -1)
        known.append((q, length))
        if length >= max(MIN_WORDS, MIN_PERIODS * q):
            found.append((end - length, length, q))
    return sorted(set(found))


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)


def analysed(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of every row of a text column."""
    words, counts = words_of(column)
    text = np.repeat(np.arange(len(counts)), counts)
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = runs_in(text * (len(words) + 1) + numbers, counts)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    start, length, period = np.array(runs, np.int64).reshape(-1, 3).T
    row = text[start]
    fields = [pa.array(start - (np.cumsum(counts) - counts)[row]), pa.array(length), pa.array(period)]
    structs = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
    found = _lists(structs, np.bincount(row, minlength=len(counts)))
    left = _lists(words.filter(pa.array(kept)), np.bincount(text[kept], minlength=len(counts)))
    return found, pc.binary_join(left, " ")


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `runs`, the periodic runs of the words of its text, and `collapsed`.

    A run is a stretch of words with smallest period q, of at least
    max(MIN_WORDS, MIN_PERIODS * q) words, that no neighbouring word extends; start
    counts words from 0. The collapsed text holds the words that no run contains
    after its first q words, joined by one space.
    """

    def found(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for part in batches(batch, text):
                runs, collapsed = analysed(part.column(text))
                yield part.append_column("runs", runs).append_column("collapsed", collapsed)
        release()

    docs = small_batches(docs).drop("runs", "collapsed")
    return docs.mapInArrow(found, schema_of(docs, runs=RUNS, collapsed="string"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the ids repeat a stretch of their words to the end."""
    number = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    docs = docs.select("doc_id", "text", number.alias("h"), F.when(number % 10 == 0, words).alias("words"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    docs = docs.select("*", n.alias("n"), g.alias("g"), F.when(n > 0, g % n).cast("int").alias("a"))
    left = F.col("n") - F.col("a")
    period = (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int")
    docs = docs.select("*", left.alias("left"), period.alias("p"))
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    copies = F.flatten(F.array_repeat(block, F.ceil(F.col("left") / F.col("p")).cast("int")))
    planted = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(copies, F.lit(1), F.col("left")))
    text = F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(planted, " "))
    return docs.select("doc_id", F.coalesce(text, "text").alias("text"))


def _greatest(runs: Column) -> Column:
    """The run with the greatest exponent, the first one of several; null without runs."""

    def better(best: Column, run: Column) -> Column:
        return F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def run_report(docs: DataFrame) -> DataFrame:
    """The runs of documents with planted repetitions, one row of figures per document."""
    found = with_runs(with_planted_runs(docs))
    best = _greatest(F.col("runs"))
    line = lambda run: F.concat_ws(",", run["start"], run["length"], run["period"])
    lines = F.concat(F.array_join(F.transform("runs", lambda run: F.concat(line(run), F.lit("\n"))), ""))
    found = found.select("doc_id", "runs", best.alias("best"), lines.alias("lines"), "collapsed")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
