"""Toxicity by compression distance between two zstandard dictionaries (operator 12).

One dictionary is made of toxic text, one of ordinary text. A text is cut into
windows of `WINDOW` words, each window is compressed with either dictionary, and
the bytes that the toxic one saves are compared: their mean beyond `SLACK` and their
maximum over all windows of a text go into a logistic curve, which is fitted to
labelled texts that the dictionaries have not seen. The curve's value is the score,
a probability, so the threshold needs no further tuning.

Dictionaries are raw content, trained by counts of words: both begin with the words
that both kinds of text share, and end with those that their own kind uses more
often, the surest ones last, where matches are cheapest. What is counted are the
different contexts of a word, its two neighbours, and not its texts: edited copies of
one text repeat their words in the same contexts, so a family of copies that happens
to be toxic makes none of its words toxic. How sure a word is, is the signed root of
its likelihood ratio; it must be greater than chance leaves among so many words.
(Dictionaries of
the library's own trainer hold the prose that both kinds share and hardly tell them
apart: README.)

Bounds: what is learned comes from about `SAMPLE_BYTES` bytes and `SAMPLE_ROWS` rows
of each kind at most, drawn by a hash of the text among labelled rows that may be
learned from; two thirds train the dictionaries, one third fits the curve. Counts
of the sampled kinds are weighed by their true shares. Dictionaries, and the curve's
five numbers, go to every task; nothing else is shuffled but the ids of labelled rows.

Defined cases: a null or empty text has no window and scores as a text without any
evidence; an id labelled twice is toxic if one label says so; equal texts are
learned from once and scored alike; without labelled rows of both kinds every score
is the share of toxic ones (0 without any); an empty table gives an empty result;
columns `score` and `predicted` are replaced, all others pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspan.llm.common import batches, release, schema_of, small_batches, stored
from sigspan.llm.word_runs import words_of

SAMPLE_BYTES = 16 << 20
SAMPLE_ROWS = 20_000
WINDOW = 8
LEVEL = 3
SLACK = 1  #: bytes a window may save by chance
SHARED_BYTES = 64 << 10
MAX_WORDS = 2000  #: words of its own in a dictionary
MIN_CONTEXTS = 3
SHARED_Z = 1.5  #: words less sure than this are of both kinds
THRESHOLD = 0.3


def _lowered(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return words_of(pc.utf8_lower(column))


def _contexts(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of a batch with a hash of its neighbours, 0 beyond the ends of a text."""
    for batch in arrow:
        for part in batches(batch, "text"):
            words, counts = _lowered(part.column("text"))
            if not len(words):
                continue
            coded = words.dictionary_encode()
            hashed = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), dtype=object))
            code = hashed[coded.indices.to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(len(counts)), counts)
            inner = row[1:] == row[:-1]
            before, after = np.zeros_like(code), np.zeros_like(code)
            before[1:][inner], after[:-1][inner] = code[:-1][inner], code[1:][inner]
            context = (before * np.uint64(0x9E3779B97F4A7C15) ^ after).view(np.int64)
            toxic = part.column("toxic").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([words, pa.array(context), pa.array(toxic, pa.int32())], ["word", "context", "toxic"])
    release()


def word_kinds(texts: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """(shared, ordinary, toxic) words of labelled (text, toxic) rows, the best ones last.

    A word's z compares its shares of all toxic and all ordinary contexts. Collected
    are 2 * MAX_WORDS words and SHARED_BYTES of shared ones at most.
    """
    a, b = F.col("toxic"), F.col("ordinary")
    seen = texts.mapInArrow(_contexts, "word string, context long, toxic int").distinct()
    counted = seen.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("ordinary"))
    counted = stored(counted, "toxic-words")
    often = a + b >= MIN_CONTEXTS
    toxic, ordinary, n = counted.agg(F.sum(a), F.sum(b), F.count_if(often)).first()
    if not (toxic and ordinary and n):
        return [], [], []
    sure = float(np.sqrt(2 * np.log(max(n, 2))))  # chance passes it for less than one of n words
    share = toxic / (toxic + ordinary)

    def ratio(found, part: float):
        return F.when(found > 0, found * F.log(found / ((a + b) * part))).otherwise(0.0)

    z = F.signum(a - (a + b) * share) * F.sqrt(F.greatest(F.lit(0.0), 2 * (ratio(a, share) + ratio(b, 1 - share))))
    counted = counted.where(often).select("word", (a + b).alias("n"), z.alias("z"))

    def best(rows: DataFrame, order, limit: int) -> list[str]:
        return [r["word"] for r in rows.orderBy(order, "word").limit(limit).collect()][::-1]

    shared = best(counted.where(F.abs("z") < SHARED_Z), F.desc("n"), SHARED_BYTES // 4)
    kept = np.cumsum([len(w.encode()) + 1 for w in shared[::-1]]) <= SHARED_BYTES
    own = [best(counted.where(F.col("z") <= -sure), F.col("z"), MAX_WORDS)]
    own.append(best(counted.where(F.col("z") >= sure), F.desc("z"), MAX_WORDS))
    return shared[len(shared) - int(kept.sum()) :], *own


class Dictionaries:
    """The two dictionaries and the windows of texts compressed with them."""

    def __init__(self, shared: list[str], ordinary: list[str], toxic: list[str]):
        self.contents = [f" {' '.join([*shared, *own])} ".encode() for own in (ordinary, toxic)]
        self._compressors = None

    def __getstate__(self):
        return self.contents

    def __setstate__(self, contents):
        self.contents, self._compressors = contents, None

    @property
    def compressors(self) -> list:
        """One per dictionary, made where they are used; bare frames, since lengths are compared."""
        if self._compressors is None:
            self._compressors = []
            for content in self.contents:
                found = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                options = zstandard.ZstdCompressionParameters.from_level(
                    LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, dict_size=len(content),
                    write_content_size=False, write_checksum=False, write_dict_id=False,
                )
                found.precompute_compress(compression_params=options)
                self._compressors.append(zstandard.ZstdCompressor(dict_data=found, compression_params=options))
        return self._compressors

    def savings(self, text: bytes) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one in each window of a lower-case text."""
        ordinary, toxic = (c.compress for c in self.compressors)
        words = text.split()  # of bytes, at blanks and 9 to 13
        windows = [b" %b " % b" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)]
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows], np.float64)

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Per text: root of the mean saving beyond SLACK, logs of the greatest one and of the windows."""
        texts = pc.utf8_lower(column.fill_null("")).cast(pa.binary()).to_pylist()
        found = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            saved = self.savings(text)
            if not len(saved):
                continue
            mean = np.maximum(saved - SLACK, 0).mean()
            found[i] = np.sqrt(mean), np.log1p(max(saved.max(), 0)), np.log1p(len(saved))
        return found


@dataclass(frozen=True)
class Curve:
    """A logistic curve over evidence; `flat` replaces it where there is nothing to fit."""

    weights: tuple[float, ...] = ()
    flat: float = 0.0

    def __call__(self, evidence: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(evidence), self.flat)
        return 1 / (1 + np.exp(-np.clip(evidence @ self.weights[1:] + self.weights[0], -30, 30)))


def fitted(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> Curve:
    """The curve of greatest likelihood, by Newton's method with a small ridge."""
    total = weight.sum()
    if not total or not 0 < (weight * toxic).sum() < total:
        return Curve(flat=float((weight * toxic).sum() / total) if total else 0.0)
    middle, spread = evidence.mean(0), np.maximum(evidence.std(0), 1e-9)
    x = np.c_[np.ones(len(evidence)), (evidence - middle) / spread]
    weight = weight * len(weight) / total
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * evidence.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (toxic - p)) - ridge @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, gradient)
        beta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    slope = beta[1:] / spread
    return Curve((float(beta[0] - slope @ middle), *map(float, slope)))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """Distinct (text, toxic) rows of a bounded sample, and the share that was drawn of each kind.

    Ids and lengths find the sample, so that of the texts only sampled ones move.
    """
    by_id = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    pick = F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    sizes = docs.where("doc_id is not null and text is not null")
    sizes = sizes.select("doc_id", F.octet_length("text").alias("size"), pick.alias("pick"))
    sizes = stored(sizes.join(by_id.where("toxic in (0, 1)"), "doc_id"), "toxic-labelled")
    totals = sizes.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
    drawn = {r["toxic"]: min(1.0, SAMPLE_BYTES / max(r["size"], 1), SAMPLE_ROWS / r["n"]) for r in totals}  # two rows
    odds = F.when(F.col("toxic") == 1, drawn.get(1, 0.0)).otherwise(drawn.get(0, 0.0))
    chosen = sizes.where(F.col("pick") < odds).select("doc_id", "toxic").distinct()
    texts = docs.select("doc_id", "text").where("text is not null")
    # about 2 * SAMPLE_ROWS ids at most, whatever the table
    found = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic").distinct()
    return stored(found, "toxic-sample"), drawn


def train(docs: DataFrame, labels: DataFrame) -> tuple[Dictionaries, Curve]:
    """Dictionaries and curve from the labelled rows of docs, all of which may be learned from."""
    sample, drawn = labelled_sample(docs, labels)
    fold = F.pmod(F.xxhash64(F.lit("curve"), "text"), F.lit(3)) == 0
    dictionaries = Dictionaries(*word_kinds(sample.where(~fold)))

    def evident(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for part in batches(batch, "text"):
                found = dictionaries.evidence(part.column("text"))
                columns = [part.column("toxic"), *map(pa.array, found.T)]
                yield pa.RecordBatch.from_arrays(columns, ["toxic", "mean", "most", "windows"])
        release()

    schema = "toxic int, mean double, most double, windows double"
    rows = sample.where(fold).mapInArrow(evident, schema).orderBy("toxic", "mean", "most", "windows")
    rows = np.array([tuple(r) for r in rows.collect()]).reshape(-1, 4)  # a third of the sample, four numbers a row
    toxic = rows[:, 0]
    weight = np.array([1 / drawn[int(k)] for k in toxic])
    return dictionaries, fitted(rows[:, 1:], toxic, weight)


def scored(docs: DataFrame, model: tuple[Dictionaries, Curve], text: str = "text") -> DataFrame:
    """docs with `score`, the probability that a text is toxic, and `predicted`, 0 or 1."""
    dictionaries, curve = model

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for part in batches(batch, text):
                score = curve(dictionaries.evidence(part.column(text)))
                part = part.append_column("score", pa.array(score, pa.float64()))
                yield part.append_column("predicted", pa.array((score >= THRESHOLD).astype(np.int32)))
        release()

    docs = small_batches(docs).drop("score", "predicted")
    return docs.mapInArrow(run, schema_of(docs, score="double", predicted="integer"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = train(docs.where(fold != 2), labels)
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", "predicted")
