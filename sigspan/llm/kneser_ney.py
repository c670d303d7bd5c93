"""Quality by an interpolated modified Kneser-Ney model of trusted text (operator 3).

The model is over the UTF-8 bytes of whole texts, up to order `ORDER`; a text is
preceded by `ORDER` - 1 line ends. An n-gram of order k is one number: its bytes,
with k above them. Each order has three discounts from its counts of counts;
orders below the highest count distinct left neighbours; the lowest is
interpolated with the uniform distribution over bytes.

Counts are shards, never one table in memory: n-grams are counted by slice in
arrays, summed by a shuffle on the n-gram, and joined on it. Scoring goes the same
way. Documents are dealt into blocks of `BLOCK_BYTES`, in packs: a partition of the
input gives rows to few blocks, about `LANE_BYTES` to each, so that the number of packs
grows with the text and not with its square. Each block asks for its
distinct n-grams only; what all blocks ask for is resolved order by order by joins
with the counts and their contexts; the answers return to the blocks, which add
them up to one perplexity (per byte) for each document. So what is shuffled is the
text once, compressed, and the distinct n-grams of blocks.

A document stays if its perplexity is at most `MARGIN` times the `QUANTILE` of the
perplexities of its language's trusted documents, with an allowance of
1 + 1 / sqrt(bytes) for the scatter of short texts. A fold of these, one in `FOLDS`
by id, is kept out of the model and only sets the thresholds, so that they hold for
unseen text. The quantile is the language's median times its spread, quantile over
median; a small fold's spread is pooled with that over all languages, which weighs
as much as `POOL` documents, so that no odd document sets a threshold. `QUANTILE` and
`MARGIN` are chosen by the rates at which held-out trusted and labelled bad
documents are kept (README).

Defined cases: a null or empty text has no perplexity and is not kept; a language
(or null) without trusted documents in the fold takes the threshold over all
languages, and where there are none at all every document with text is kept;
repeated rows are scored alike; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspan.llm import id_filter
from sigspan.llm.common import release, schema_of, settled, slices, small_batches, text_bytes, text_key
from sigspan.session import shuffle_partitions

ORDER = 5
BLOCK_BYTES = 16 << 20
LANE_BYTES = 1 << 20  #: of text that one partition of the input gives to one block
PACK_BYTES = 8 << 20  #: of rows that wait in a task to be packed by block
SHARD_BYTES = 64 << 20  #: of text, for which the blocks ask about as many bytes
COUNT_BYTES = 512 << 10  #: of text counted at once; its arrays take some forty times that
FOLD_GRAMS = 1 << 18  #: n-grams of parts that may wait to be merged
QUANTILE = 0.95
MARGIN = 1.05
FOLDS = 5
POOL = 100
_START = 10


def packed(order: int, grams):
    """The number of an n-gram: its bytes below its order."""
    return grams | (order << 40)


def text_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram of the highest order that ends at each byte, rows one after the other."""
    n = len(data)
    grams = data.astype(np.int64)
    at = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))  # place within its row
    for back in range(1, ORDER):
        previous = np.full(n, _START, np.int64)
        previous[back:] = data[: max(0, n - back)]
        previous[at < back] = _START
        grams |= previous << (8 * back)
    return grams


def _counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the highest order with their counts; slice by slice."""
    data, offsets = text_bytes(column)
    slice_counts = (
        np.unique(
            text_grams(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]), return_counts=True
        )
        for first, end in slices(np.diff(offsets), COUNT_BYTES)
    )
    return _merged(slice_counts)


def _merged(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of all parts with their summed counts.

    Parts are merged as they come: what is held is the distinct n-grams, and about as
    many or `FOLD_GRAMS` that wait, and not the n-grams of every part.
    """
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting, held = [], 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        found, where = np.unique(np.concatenate([grams, *(g for g, _ in waiting)]), return_inverse=True)
        sizes = np.concatenate([counts, *(n for _, n in waiting)])
        return found, np.bincount(where, sizes, len(found)).astype(np.int64)

    for part in parts:
        waiting.append(part)
        held += len(part[0])
        if held > max(FOLD_GRAMS, len(grams)):
            grams, counts = fold()
            waiting, held = [], 0
    return fold() if waiting else (grams, counts)


def _count_batches(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _counts(batch.column("text"))], ["gram", "n"])
    release()


class Model:
    """Counts by order, their discounts, and the contexts' weights, as sharded tables."""

    def __init__(self, trusted: DataFrame):
        counted = trusted.select("text").where("text is not null").mapInArrow(_count_batches, "gram long, n long")
        self.counts = {ORDER: settled(counted.groupBy("gram").agg(F.sum("n").alias("n")), "kn-counts")}
        for order in range(ORDER - 1, 0, -1):
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")
            lower = self.counts[order + 1].select(suffix).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
            self.counts[order] = settled(lower, "kn-counts")
        every = None
        for order, counts in self.counts.items():
            tagged = counts.select(F.lit(order).alias("order"), "n")
            every = tagged if every is None else every.unionByName(tagged)
        # three discounts an order: 4 * ORDER numbers at most
        few = every.where("n <= 4").groupBy("order", "n").count().collect()
        few = {(r["order"], r["n"]): r["count"] for r in few}
        self.discounts = {k: discounts([few.get((k, i), 0) for i in range(1, 5)]) for k in self.counts}

    def terms(self, order: int) -> DataFrame:
        """gram -> its count less the discount."""
        n, d = F.col("n"), self.discounts[order]
        return self.counts[order].select(
            "gram", (n - F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])).alias("term")
        )

    def contexts(self, order: int) -> DataFrame:
        """context -> the sum of counts that follow it, and the mass that discounts set free."""
        n, d = F.col("n"), self.discounts[order]
        free = F.sum(F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2]))
        context = F.shiftright("gram", 8).alias("context")
        return self.counts[order].groupBy(context).agg(F.sum("n").alias("total"), free.alias("free"))

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """gram -> p of its last byte after the bytes before it; grams: distinct, of the highest order.

        Each order is stored before the next one, so that no plan holds them all.
        """
        asked = {ORDER: grams}
        for order in range(ORDER - 1, 0, -1):
            shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")
            asked[order] = settled(asked[order + 1].select(shorter).distinct(), "kn-asked")
        found = self._resolved(asked[1], 1, None)
        for order in range(2, ORDER + 1):
            found = self._resolved(asked[order], order, settled(found, "kn-lower"))
        return found

    def _resolved(self, grams: DataFrame, order: int, below: DataFrame | None) -> DataFrame:
        """gram -> p, from the probabilities of the next lower order."""
        seen = grams.join(self.terms(order), "gram", "left").withColumn("context", F.shiftright("gram", 8))
        seen = seen.join(self.contexts(order), "context", "left")
        if below is None:
            lower, base = seen, F.lit(1 / 256)
        else:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
            below = below.select(F.col("gram").alias("shorter"), F.col("p").alias("base"))
            lower, base = seen.withColumn("shorter", shorter).join(below, "shorter"), F.col("base")
        found = (F.coalesce("term", F.lit(0.0)) + F.col("free") * base) / F.col("total")
        return lower.select("gram", F.when(F.col("total").isNull(), base).otherwise(found).alias("p"))


def discounts(few: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from how many n-grams occur 1, 2, 3 and 4 times."""
    if not (few[0] and few[1]):
        return 0.5, 0.5, 0.5
    y = few[0] / (few[0] + 2 * few[1])
    found = [i + 1 - (i + 2) * y * few[i + 1] / few[i] if few[i] else 0.5 for i in range(3)]
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))


def _packed_rows(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block put together and compressed: a fraction of the text is shuffled.

    Batches wait for each other up to `PACK_BYTES`: one batch has few rows of a block, or
    only one where there are many blocks, and each pack costs a schema and several calls.
    """
    waiting, size = [], 0
    for batch in arrow:
        waiting.append(batch)
        size += batch.nbytes
        if size >= PACK_BYTES:
            yield from _packs(pa.concat_batches(waiting))
            waiting, size = [], 0
    if waiting:
        yield from _packs(pa.concat_batches(waiting))
    release()


def _packs(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    block = rows.column("block").to_numpy()
    order = np.argsort(block, kind="stable")
    blocks, first = np.unique(block[order], return_index=True)
    for number, begin, end in zip(blocks, first, [*first[1:], len(rows)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(rows.take(pa.array(order[begin:end])))
        pack = pa.array([sink.getvalue().to_pybytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pack], ["block", "pack"])


def _unpacked(packs: pa.Table) -> Iterator[pa.Table]:
    for pack in packs.column("pack"):
        yield pa.ipc.open_stream(pack.as_buffer()).read_all()


def _shard(grams, shards: int):
    """The shard of an n-gram; the same arithmetic on arrays and on columns."""
    return grams % 1_000_003 % shards


def _squeezed(grams: np.ndarray) -> bytes:
    """Sorted n-grams as compressed differences."""
    return pa.compress(np.diff(grams, prepend=0).tobytes(), "zstd", asbytes=True)


def _grams(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.int64))


def _ask(packs: pa.Table, shards: int) -> pa.Table:
    """The distinct n-grams of one block, one row per shard that has some."""
    grams, _ = _merged(_counts(rows.column("text")) for rows in _unpacked(packs))
    shard = _shard(grams, shards)
    order = np.argsort(shard, kind="stable")
    held, first = np.unique(shard[order], return_index=True)
    pieces = np.split(grams[order], first[1:]) if len(grams) else []
    block = np.full(len(pieces), packs.column("block")[0].as_py(), np.int32)
    release()
    return pa.table(
        {
            "shard": pa.array(held.astype(np.int32)),
            "block": block,
            "n": pa.array([len(x) for x in pieces], pa.int64()),
            "grams": pa.array([_squeezed(x) for x in pieces], pa.binary()),
        }
    )


def _answer(asked: pa.Table, found: pa.Table) -> pa.Table:
    """The join within a shard: what each block asks for, with probabilities."""
    grams, p = found.column("gram").to_numpy(), found.column("p").to_numpy()
    order = np.argsort(grams)
    grams, p = grams[order], p[order]
    rows = zip(asked.column("grams").to_pylist(), asked.column("n").to_pylist())
    answers = [p[np.searchsorted(grams, _grams(data, n))].tobytes() for data, n in rows]
    answers = pa.array(answers, pa.binary())
    release()
    return asked.drop(["shard"]).append_column("p", answers)


def _add_up(packs: pa.Table, answers: pa.Table) -> pa.Table:
    """Perplexity per byte of every document of one block."""
    rows = zip(answers.column("grams").to_pylist(), answers.column("n").to_pylist())
    grams = np.concatenate([_grams(data, n) for data, n in rows] or [np.zeros(0, np.int64)])
    logs = np.concatenate([np.frombuffer(p, np.float32) for p in answers.column("p").to_pylist()] or [np.zeros(0)])
    order = np.argsort(grams)
    grams, logs = grams[order], np.log2(logs[order].astype(np.float64))
    found = []
    for rows in _unpacked(packs):
        data, offsets = text_bytes(rows.column("text"))
        sizes = np.diff(offsets)
        total = np.zeros(len(sizes))
        for first, end in slices(sizes, COUNT_BYTES):
            part = text_grams(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first])
            row = np.repeat(np.arange(end - first), sizes[first:end])
            at = np.searchsorted(grams, part)
            if not np.array_equal(grams.take(at, mode="clip"), part):
                raise RuntimeError("a block has rows that it did not have when it asked")
            total[first:end] = np.bincount(row, logs[at], end - first)
        perplexity = np.where(sizes > 0, np.exp2(-total / np.maximum(sizes, 1)), np.nan)
        found.append(rows.drop(["text", "block"]).append_column("perplexity", pa.array(perplexity, from_pandas=True)))
    release()
    return pa.concat_tables(found)


def dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """Packs of docs, a partition for each block, and the bytes of text.

    A row's block follows from its partition and from what it holds, not from its place: a task
    that runs again deals alike. Rows of a partition go to `lanes` neighbouring blocks; multiples
    of the golden ratio spread these evenly, whatever the pattern of the partitions' sizes.
    """
    sizes = docs.select(F.spark_partition_id().alias("part"), F.octet_length("text").alias("n"))
    sizes = sizes.groupBy("part").agg(F.sum("n").cast("double").alias("n"))
    size, squares = (x or 0 for x in sizes.agg(F.sum("n").cast("long"), F.sum(F.col("n") * F.col("n"))).first())
    few = min(docs.sparkSession.sparkContext.defaultParallelism, size >> 20)
    blocks = max(1, few, -(-size // BLOCK_BYTES))
    # by the size of a partition as most of the text finds it
    lanes = min(blocks, math.ceil(squares / size / LANE_BYTES)) if size else 1
    rest = [c for c in docs.columns if c != "text"]
    begin = F.floor(F.spark_partition_id() * F.lit((math.sqrt(5) - 1) / 2 * blocks))
    block = F.pmod(begin + F.pmod(F.xxhash64(*rest), F.lit(lanes)), F.lit(blocks)).cast("int")
    salted = docs.select(*rest, "text", block.alias("block"))
    return salted.mapInArrow(_packed_rows, "block int, pack binary").repartition(blocks, "block"), size


def perplexities(model: Model, docs: DataFrame) -> DataFrame:
    """docs (any columns beside text) without their text but with `perplexity`.

    Probabilities are resolved once, for the distinct n-grams of all documents.
    The exchange of packed blocks is used twice, to ask and to add up; Spark
    reuses it within the plan.
    """
    packs, size = dealt(docs)
    grams = docs.select("text").where("text is not null").mapInArrow(_count_batches, "gram long, n long")
    grams = settled(grams.select("gram").distinct(), "kn-grams")
    found = settled(model.probabilities(grams).select("gram", F.col("p").cast("float").alias("p")), "kn-found")
    # a shard is one group in memory, so their number follows from what is asked, not from the cluster
    shards = max(shuffle_partitions(docs.sparkSession), -(-size // SHARD_BYTES))
    asked = packs.groupBy("block").applyInArrow(
        lambda held: _ask(held, shards), "shard int, block int, n long, grams binary"
    )
    sharded = found.withColumn("shard", _shard(F.col("gram"), shards).cast("int"))
    asked, sharded = asked.repartition(shards, "shard"), sharded.repartition(shards, "shard")
    answers = asked.groupBy("shard").cogroup(sharded.groupBy("shard"))
    answers = answers.applyInArrow(_answer, "block int, n long, grams binary, p binary")
    schema = schema_of(docs.drop("text"), perplexity="double")
    return packs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_add_up, schema)


def thresholds(held: DataFrame) -> tuple[DataFrame, float | None]:
    """(_lang, _cut) from held-out (lang, perplexity) rows, and the cut over all languages."""
    at = lambda column, part: F.percentile_approx(column, part, F.lit(10_000))
    overall = held.agg(at("perplexity", QUANTILE) * MARGIN).first()[0]
    medians = held.groupBy(F.col("lang").alias("_lang")).agg(at("perplexity", 0.5).alias("_median"))
    ratios = held.select("lang", "perplexity").join(medians, F.col("lang").eqNullSafe(F.col("_lang")))
    ratios = ratios.withColumn("_ratio", F.col("perplexity") / F.col("_median"))
    spread = F.lit(ratios.agg(at("_ratio", QUANTILE)).first()[0]).cast("double")
    n = F.count(F.lit(1))
    pooled = (n * at("_ratio", QUANTILE) + POOL * spread) / (n + POOL)
    return ratios.groupBy("_lang").agg((F.first("_median") * pooled * MARGIN).alias("_cut")), overall


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold and kept of every document.

    labels: (doc_id, quality, toxic); trusted text has quality 1 and isn't toxic.
    """
    return _rated(docs, labels).drop("_text")


def _rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`rated` with `_text`, which names the text."""
    docs = small_batches(docs)
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("_t")).distinct()
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)) == 0
    # the labels say which texts to move for training; the bitmap keeps most others in place
    texts = id_filter.thinned(docs.select("doc_id", "text").where(~fold), id_filter.bitmap(trusted, "_t"), "doc_id")
    model = Model(texts.join(trusted, F.col("doc_id") == F.col("_t"), "left_semi"))
    scored = perplexities(model, docs.select("doc_id", "lang", F.octet_length("text").alias("n_bytes"), text_key().alias("_text"), "text"))
    scored = settled(scored, "kn-scored")
    held = scored.where(fold & F.col("perplexity").isNotNull()).join(trusted, F.col("doc_id") == F.col("_t"), "left_semi")
    held = settled(held.select("lang", "perplexity"), "kn-held")
    by_language, overall = thresholds(held)
    found = scored.join(by_language, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    # the mean of few bytes scatters: the allowance for it fades with the length
    allowance = 1 + 1 / F.sqrt(F.greatest("n_bytes", F.lit(1)))
    threshold = F.coalesce("_cut", F.lit(overall).cast("double")) * allowance
    kept = F.coalesce(F.col("perplexity") <= threshold, F.col("perplexity").isNotNull())
    return found.select("doc_id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), kept.alias("kept"), "_text")


def keep_fluent(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model keeps, columns unchanged; decisions are by id, language and text."""
    kept = _rated(docs, labels).where("kept")
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("_text").alias("_kept")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("lang").eqNullSafe(F.col("_lang"))
    return docs.join(kept, same & (text_key() == F.col("_kept")), "left_semi")
