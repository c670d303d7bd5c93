"""BPE encoding and decoding with a pair occurrence index (operator 8).

The distinct words of a slice of texts lie in one array of symbols. An index maps
the rank of each adjacent pair to all positions where it occurs. Active ranks are
applied in ascending order, each at all its positions at once; only the pairs
beside a merge are looked up again and appended to the lists of their ranks.
Words do not touch each other, so this gives each word the merges it would get
alone.

The vocabulary is a `tokenizers` JSON file with word ends (lower case, white space
dropped); its path is a parameter and its content is read by every Python worker.
Text follows that library: special tokens are cut out first, then NFC, white space
to blanks, lower case by character, split by pattern, bytes as printable characters.

Defined cases: a null text is an empty one (no tokens, empty decoded text);
repeated rows are encoded alike; other columns pass through.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspan.llm.common import release, schema_of, slices, small_batches, text_bytes

CACHED_PIECES = 60_000  #: pieces whose tokens a worker remembers; then it forgets them
SLICE_BYTES = 3 << 20  #: text whose words share one pair index
_CONTROL = regex.compile(r"[\x1c-\x1f]")
_SPACE = "[\\t-\\r\\x85 \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordVocabulary:
    """Merges, symbols and text rules of one vocabulary file."""

    def __init__(self, content: bytes | str):
        spec = json.loads(content)
        model = spec["model"]
        self.ids = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        pattern = next(
            p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        )
        self.split = regex.compile(pattern.replace(r"^\s", "^" + _SPACE[1:-1]))
        self.space = regex.compile(_SPACE + "+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        chars = byte_characters()
        self.inner = np.array([self.ids[c] for c in chars], np.int64)
        self.final = np.array([self.ids[c + self.suffix] for c in chars], np.int64)
        left, right, made = [], [], []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left.append(self.ids[a])
            right.append(self.ids[b])
            made.append(self.ids[a + b])
        self.left, self.right, self.made = (np.array(x, np.int64) for x in (left, right, made))
        keys = (self.left << 32) | self.right
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
        self.pairs, self.rank_of = keys[first], order[first]
        # merges whose result enters an earlier merge: these go one position at a time
        earliest = np.full(int(max(self.ids.values(), default=0)) + 1, len(made), np.int64)
        ranks = np.arange(len(made))
        np.minimum.at(earliest, self.left, ranks)
        np.minimum.at(earliest, self.right, ranks)
        self.backward = earliest[self.made] < ranks

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbols, -1 where there is none."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.rank_of[at], -1)

    def words(self, text: str) -> list[str]:
        """The words of a text; white space only parts them, so it needs no replacing."""
        text = unicodedata.normalize("NFC", text)
        # lower case by character: no rule for a final sigma
        return self.split.findall(text.replace("Σ", "σ").lower())

    def pieces(self, text: str) -> Iterator[str]:
        """The text between white space, with special tokens as pieces of their own."""
        if self.cut is None or not any(s in text for s in self.special):
            yield from self.parted(text)
            return
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                yield part
            else:
                yield from self.parted(part)

    def parted(self, text: str) -> list[str]:
        """Python's split() takes four control characters for white space too; the pattern doesn't."""
        return self.space.split(text) if _CONTROL.search(text) else text.split()


def merge_all(vocabulary: WordVocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after the other, and their number by word.

    By the pair occurrence index over all the words, none of them empty.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    symbols = vocabulary.inner[data]
    ends = np.cumsum(sizes)
    symbols[ends - 1] = vocabulary.final[data[ends - 1]]
    total = len(symbols)
    word = np.repeat(np.arange(len(words)), sizes)
    after = np.arange(1, total + 1)  # the next symbol of the word; total: none
    after[ends - 1] = total
    before = np.arange(-1, total - 1)  # the previous one; -1: none
    before[ends - sizes] = -1
    alive = np.ones(total, bool)

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(positions: np.ndarray) -> None:
        """Put the pairs that start at these positions on the lists of their ranks."""
        positions = positions[after[positions] < total]
        ranks = vocabulary.ranks(symbols[positions], symbols[after[positions]])
        positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else ()
        for rank, some in zip(ranks[starts].tolist() if len(ranks) else (), np.split(positions, starts[1:]) if len(ranks) else ()):
            if rank not in index:
                index[rank] = []
                heapq.heappush(active, rank)
            index[rank].append(some)

    add(np.arange(total))
    while active:
        rank = heapq.heappop(active)
        at = np.concatenate(index.pop(rank))
        at = at[alive[at] & (after[at] < total)]
        # a position may have been changed since it was listed
        at = np.sort(at[(symbols[at] == vocabulary.left[rank]) & (symbols[after[at]] == vocabulary.right[rank])])
        if not len(at):
            continue
        at = at[np.r_[True, at[1:] != at[:-1]]]
        if vocabulary.backward[rank]:
            first = np.r_[True, word[at[1:]] != word[at[:-1]]]
            if not first.all():
                index[rank] = [at[~first]]
                heapq.heappush(active, rank)
            at = at[first]
        else:
            # of overlapping pairs (a a a) the left one goes first: every other of a chain
            linked = np.r_[False, after[at[:-1]] == at[1:]]
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
            at = at[run % 2 == 0]
        gone = after[at]
        symbols[at] = vocabulary.made[rank]
        alive[gone] = False
        behind = after[gone]
        after[at] = behind
        inside = behind < total
        before[behind[inside]] = at[inside]
        left = before[at]
        add(np.concatenate([at, left[left >= 0]]))
    kept = np.flatnonzero(alive)
    return symbols[kept], np.bincount(word[kept], minlength=len(words))


class Encoder:
    """Encodes texts and remembers the pieces it has met, up to CACHED_PIECES about."""

    def __init__(self, vocabulary: WordVocabulary):
        self.vocabulary = vocabulary
        self.decimal = {i: str(i) for i in vocabulary.tokens}
        self.known: dict[str, tuple[str, int, str]] = {}

    def learn(self, pieces: set[str]) -> None:
        """Token ids, their number and token strings of pieces not met before."""
        if len(self.known) > CACHED_PIECES:
            self.known = {p: self.known[p] for p in self.vocabulary.special if p in self.known}
        new = [p for p in pieces if p not in self.known]
        if not new:
            return
        special = self.vocabulary.special
        split = [[] if p in special else self.vocabulary.words(p) for p in new]
        words = list(dict.fromkeys([w for some in split for w in some]))
        of_word = {}
        if words:
            symbols, counts = merge_all(self.vocabulary, [w.encode("utf-8", "replace") for w in words])
            symbols = symbols.tolist()
            ids, tokens = list(map(self.decimal.__getitem__, symbols)), list(map(self.vocabulary.tokens.__getitem__, symbols))
            end = 0
            for word, count in zip(words, counts.tolist()):
                begin, end = end, end + count
                of_word[word] = (" ".join(ids[begin:end]), count, " ".join(tokens[begin:end]))
        for piece, some in zip(new, split):
            if len(some) == 1:
                self.known[piece] = of_word[some[0]]
            elif piece in special:
                self.known[piece] = (str(special[piece]), 1, piece)
            else:
                found = [of_word[w] for w in some]
                self.known[piece] = (" ".join([f[0] for f in found]), sum([f[1] for f in found]), " ".join([f[2] for f in found]))

    def encode(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        """(ids joined by one space, number of ids, decoded text) of every text."""
        cut = [list(self.vocabulary.pieces(t)) for t in texts]
        self.learn(set().union(*cut))
        known = self.known
        for pieces in cut:
            # a piece of nothing but dropped characters has no tokens
            ids, counts, tokens = zip(*map(known.__getitem__, pieces)) if pieces else ((), (), ())
            if 0 in counts:
                ids, tokens = filter(None, ids), filter(None, tokens)
            yield " ".join(ids), sum(counts), " ".join(tokens)

    def decode(self, ids: list[int]) -> str:
        """As the library does for a vocabulary without a decoder: tokens with blanks between."""
        return " ".join([self.vocabulary.tokens[i] for i in ids if i in self.vocabulary.tokens])


@lru_cache(maxsize=2)
def _encoder(name: str) -> Encoder:
    with open(SparkFiles.get(name), "rb") as file:
        return Encoder(WordVocabulary(file.read()))


ENCODED = T.StructType(
    [
        T.StructField("ids", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("decoded", T.StringType()),
    ]
)


def _shipped(df: DataFrame, vocabulary: str) -> str:
    """The vocabulary file sent to every executor; its name there."""
    df.sparkSession.sparkContext.addFile(vocabulary)
    return vocabulary.rstrip("/").rsplit("/", 1)[-1]


def _encoded(column: pa.Array, name: str) -> Iterator[tuple[pa.Array, list[tuple[str, int, str]]]]:
    """Pieces of a text column with what the encoder gives for them."""
    encoder = _encoder(name)
    gc.disable()  # many small tuples and no cycles: scanning them costs a third of the time
    try:
        _, offsets = text_bytes(column)
        for first, end in slices(np.diff(offsets), SLICE_BYTES):
            part = column.slice(first, end - first)
            yield part, list(encoder.encode([t or "" for t in part.to_pylist()]))
    finally:
        gc.enable()


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs with `ids` (decimal, one space between), `n_tokens` and `decoded`."""
    name = _shipped(docs, vocabulary)

    @F.pandas_udf(ENCODED)
    def encoded(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in columns:
            parts = [pd.DataFrame(rows, columns=ENCODED.names) for _, rows in _encoded(pa.array(column, pa.string()), name)]
            yield pd.concat(parts) if parts else pd.DataFrame(columns=ENCODED.names)

    names = ENCODED.names
    found = docs.drop(*names).withColumn("_e", encoded(F.col(text)))
    return found.select("*", *[f"_e.{n}" for n in names]).drop("_e")


def decode(df: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """df with `decoded`, from a column of decimal ids joined by one space."""
    name = _shipped(df, vocabulary)

    @F.pandas_udf("string")
    def decoded(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            yield pd.Series([_encoder(name).decode([int(i) for i in (t or "").split()]) for t in column])

    return df.withColumn("decoded", decoded(F.col(ids)))


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of the decoded text, of every document."""
    name = _shipped(docs, vocabulary)

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    def digests(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            at = 0
            for part, rows in _encoded(batch.column("text"), name):
                columns = [pa.array([n for _, n, _ in rows], pa.int64()), *(pa.array([sha(r[i]) for r in rows]) for i in (0, 2))]
                ids = batch.column("doc_id").slice(at, len(part))
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(part)
        _encoder.cache_clear()  # the worker process is kept for other tasks
        release()

    schema = schema_of(docs.select("doc_id"), n_tokens="long", ids_sha256="string", decoded_sha256="string")
    return small_batches(docs).select("doc_id", "text").mapInArrow(digests, schema)
