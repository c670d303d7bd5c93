"""Language identification by cross-parsing entropy (operator 7).

A suffix automaton is built of labelled text of each language. A text is parsed
greedily against each of them: a phrase is the longest run of characters that
occurs in the language's text, then the next phrase starts. With c phrases, n
characters and m characters of training text, c * log2(m) / n is the cross-parsing
entropy; the language with the smallest one wins.

Every letter of the sample has a code of its own, whatever the number of scripts. An
automaton has a dense table for the `WIDTH` - 3 letters that most of its transitions
bear, and a sorted list of transitions for its other letters; a letter that its
language's text lacks is a phrase of its own.

Bounds: each language gives at most `TRAIN_CHARS` characters (`TRAIN_TOTAL` over
all languages), drawn by a hash of the id, so the automata have a bounded size and
can be sent to every task; their tables are made there and dropped with the task. Texts are parsed whole, in blocks of `BLOCK` characters
(a phrase ends with its block), so that many blocks are walked in step.

Defined cases: a null text or one without a letter is `und` with score 0; ties go
to the language that sorts first; without any labelled text every row is `und`;
repeated rows are predicted alike; other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspan.llm.common import batches, id_order, release, schema_of, small_batches

TRAIN_CHARS = 32_768
TRAIN_TOTAL = 1 << 19
MAX_LANGUAGES = 1024
BLOCK = 2048
WIDTH = 32  #: columns of an automaton's dense table: a gap, its common letters, and two for all others
_GAP, _SPARSE, _UNSEEN = 0, WIDTH - 2, WIDTH - 1
_LETTER = regex.compile(r"\p{L}")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_COUNT_SHIFT = 28  #: table entries: next state * WIDTH, phrases ended above this bit


def folded(text: str) -> str:
    """Lower-case words of letters with one gap between them."""
    return " ".join(_WORD.findall(text.lower()))


def suffix_automaton(codes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(from, character, to) of all transitions, and the number of states."""
    links, lengths, edges = [-1], [0], [{}]
    last = 0
    for code in codes:
        new = len(edges)
        edges.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        at = last
        while at >= 0 and code not in edges[at]:
            edges[at][code] = new
            at = links[at]
        if at >= 0:
            to = edges[at][code]
            if lengths[to] == lengths[at] + 1:
                links[new] = to
            else:
                copy = len(edges)
                edges.append(dict(edges[to]))
                lengths.append(lengths[at] + 1)
                links.append(links[to])
                links[to] = links[new] = copy
                while at >= 0 and edges[at].get(code) == to:
                    edges[at][code] = copy
                    at = links[at]
        last = new
    source = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
    char = np.array([c for e in edges for c in e], np.int64)
    target = np.array([t for e in edges for t in e.values()], np.int64)
    return source.astype(np.int64), char, target, len(edges)


class Automaton:
    """A suffix automaton as tables for parsing many blocks in step."""

    def __init__(self, edges: np.ndarray, letters: int):
        """edges: (from, letter, to) by global letter codes, of which there are `letters`."""
        source, letter, target = edges
        self.letters = letters
        borne = np.bincount(letter, minlength=letters)
        borne[_GAP] = 0
        common = np.argsort(-borne, kind="stable")[: WIDTH - 3]
        common = common[borne[common] > 0]
        #: global letter -> column of the dense table
        self.column = np.where(borne > 0, _SPARSE, _UNSEEN).astype(np.uint8)
        self.column[common] = np.arange(1, len(common) + 1)
        self.column[_GAP] = _GAP
        states = int(target.max(initial=0)) + 1
        follow = np.full((states, WIDTH), -1, np.int32)
        column = self.column[letter]
        dense = column != _SPARSE
        follow[source[dense], column[dense]] = target[dense]
        fresh = follow[0].copy()  # a phrase that starts with this character
        for i in range(WIDTH):
            missing = follow[:, i] < 0
            # an unseen character is a phrase of its own, after the one that it ends
            ended = np.full(states, 1 if fresh[i] >= 0 else 2, np.int32)
            ended[0] = 1
            follow[:, i] = np.where(missing, max(int(fresh[i]), 0), follow[:, i]) * WIDTH
            follow[:, i] += np.where(missing, ended, 0) << _COUNT_SHIFT
        self.table = follow.ravel()
        keys = source[~dense].astype(np.int64) * letters + letter[~dense]
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], target[~dense][order].astype(np.int32)

    def rare(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Steps by letters of the sparse part, as the dense table has them."""
        keys = (state // WIDTH).astype(np.int64) * self.letters + letter
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        fresh = self.targets[np.searchsorted(self.keys, letter)]  # the root knows every letter of its text
        return np.where(found, self.targets[at] * WIDTH, fresh * WIDTH + (1 << _COUNT_SHIFT))


class Parser:
    """The automata of all languages, ready to parse batches of texts."""

    def __init__(self, letters: str, automata: list[tuple[str, np.ndarray, int]]):
        """automata: (language, transitions as a 3 x n array, characters of training text)."""
        self.made_of = letters, automata
        automata = sorted(automata, key=lambda a: a[0])
        self.languages = [name for name, _, _ in automata]
        self.bits = np.array([np.log2(max(size, 2)) for _, _, size in automata])
        self.edges = [e for _, e, _ in automata]
        self.unknown = len(letters) + 1  #: the code of letters that no sample has
        self.code = self.automata = None

    def open(self) -> None:
        """Make the tables."""
        if self.automata is None:
            self.code = np.full(0x110000, self.unknown, np.int32)
            self.code[ord(" ")] = _GAP
            self.code[[ord(c) for c in self.made_of[0]]] = np.arange(1, self.unknown)
            self.automata = [Automaton(e, self.unknown + 1) for e in self.edges]

    def close(self) -> None:
        """Drop them; the worker process may be kept for other tasks."""
        self.code = self.automata = None

    def __reduce__(self):
        return Parser, self.made_of  # transitions are sent, tables are made where they are used

    def codes(self, text: str) -> np.ndarray:
        self.open()
        return self.code[np.frombuffer(folded(text).encode("utf-32-le", "replace"), np.uint32)]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and the characters that were parsed."""
        parts = [self.codes(t) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(parts)), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        lengths = np.minimum(sizes[owner] - within * BLOCK, BLOCK)
        order = np.argsort(-lengths, kind="stable")
        owner, lengths = owner[order], lengths[order]
        begins = ((np.cumsum(sizes) - sizes)[np.repeat(np.arange(len(parts)), blocks)] + within * BLOCK)[order]
        steps = int(lengths.max(initial=0))
        # rows: the next character of every block; blocks that have ended read padding
        flat = np.concatenate([*parts, np.zeros(BLOCK, np.int32)])
        at = flat[begins[None, :] + np.arange(steps)[:, None]] if steps else np.zeros((0, 0), np.int32)
        active = np.searchsorted(-lengths, -np.arange(steps), "left")
        counts = np.zeros((len(parts), len(self.languages)))
        mask = (1 << _COUNT_SHIFT) - 1
        for i, automaton in enumerate(self.automata or ()):
            state = np.zeros(len(order), np.int32)
            ended = np.zeros(len(order), np.int32)
            columns = automaton.column[at]
            sparse = (columns == _SPARSE).any(1) if len(automaton.keys) else np.zeros(steps, bool)
            for row, column, n, some in zip(at, columns, active, sparse):
                step = automaton.table.take(state[:n] + column[:n])
                if some:
                    rare = np.flatnonzero(column[:n] == _SPARSE)
                    step[rare] = automaton.rare(state[rare], row[rare])
                ended[:n] += step >> _COUNT_SHIFT
                np.bitwise_and(step, mask, out=state[:n])
            ended += state != 0
            counts[:, i] = np.bincount(owner, ended, len(parts))
        return counts, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lettered = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages or not lettered:
            return names, scores
        counts, sizes = self.phrases([texts[i] for i in lettered])
        entropy = counts * self.bits / np.maximum(sizes, 1)[:, None]
        best = entropy.argmin(1)
        for i, k in zip(lettered, best):
            names[i] = self.languages[k]
        if len(self.languages) > 1:
            low = np.partition(entropy, 1, axis=1)
            scores[lettered] = 1 - low[:, 0] / np.maximum(low[:, 1], 1e-12)
        else:
            scores[lettered] = 1.0
        return names, scores


def _automaton_of(pdf: pd.DataFrame, letters: str, limit: int) -> pd.DataFrame:
    """The automaton of one language's sample, a table of at most limit characters."""
    pdf = pdf.sort_values(["pick", "doc_id", "text"], na_position="last")
    taken, size = [], 0
    for text in pdf["text"]:
        if size >= limit:
            break
        taken.append(folded(text)[: limit - size])
        size += len(taken[-1]) + 1
    text = " ".join(taken)
    number = {letter: i + 1 for i, letter in enumerate(letters)} | {" ": _GAP}
    source, char, target, _ = suffix_automaton([number[c] for c in text])
    edges = np.stack([source, char, target]).astype(np.int32)
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "edges": [edges.tobytes()], "size": [len(text)]})


def _letters_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = np.frombuffer("".join(map(folded, pdf["text"])).encode("utf-32-le", "replace"), np.uint32)
        points, counts = np.unique(found[found != ord(" ")], return_counts=True)
        yield pd.DataFrame({"point": points.astype(np.int64), "n": counts})


def train(labelled: DataFrame, train_chars: int = TRAIN_CHARS) -> Parser:
    """The automata of a bounded sample of labelled (doc_id, text, lang) rows."""
    labelled = labelled.select("doc_id", "text", "lang").where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    totals = labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
    totals = totals.limit(MAX_LANGUAGES + 1).collect()  # one row a language
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    if not totals:
        return Parser("", [])
    limit = max(1024, min(train_chars, TRAIN_TOTAL // len(totals)))
    # twice the limit is expected of each language, all of it where there is less
    share = [(r["lang"], min(1.0, 2.0 * limit / r["chars"])) for r in totals]
    odds = F.create_map(*[F.lit(x) for pair in share for x in pair])
    sample = labelled.withColumn("pick", id_order()).where(
        F.col("pick") < odds[F.col("lang")] * float(1 << 31)
    )
    # one text may be far longer than the limit; the automaton needs no more than this of it
    sample = sample.withColumn("text", F.substring("text", 1, 8 * limit)).cache()
    points = sample.mapInPandas(_letters_of, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    points = points.orderBy(F.desc("n"), "point").collect()  # distinct letters: no more than Unicode has
    letters = "".join(chr(r["point"]) for r in points)
    built = sample.groupBy("lang").applyInPandas(
        lambda pdf: _automaton_of(pdf, letters, limit), "lang string, edges binary, size long"
    )
    rows = built.collect()  # at most 36 bytes for each character of TRAIN_TOTAL
    sample.unpersist()
    return Parser.from_rows(letters, rows)


def _from_rows(letters: str, rows) -> Parser:
    automata = [(r["lang"], np.frombuffer(r["edges"], np.int32).reshape(3, -1), r["size"]) for r in rows]
    return Parser(letters, automata)


Parser.from_rows = staticmethod(_from_rows)


def identify(docs: DataFrame, labelled: DataFrame, text: str = "text") -> DataFrame:
    """docs with columns lang_pred and score; both replace columns of these names."""
    parser = train(labelled)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(parser)

    def predicted(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = shared.value
        for batch in arrow:
            for part in batches(batch, text):
                names, scores = ready.predict(part.column(text).to_pylist())
                part = part.append_column("lang_pred", pa.array(names, pa.string()))
                yield part.append_column("score", pa.array(scores))
        ready.close()
        release()

    docs = small_batches(docs).drop("lang_pred", "score")
    return docs.mapInArrow(predicted, schema_of(docs, lang_pred="string", score="double"))


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of ids that no model may learn from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    known = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    found = identify(docs.select("doc_id", "text"), docs.where(known))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is known: all but `und`, columns unchanged."""
    known = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    found = identify(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns}), docs.where(known), "in_text")
    return found.where("lang_pred <> 'und'").select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])
