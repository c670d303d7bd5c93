"""Near-duplicate documents by one-permutation hashing (operator 4).

* A document is the set of its distinct shingles of five words (`shingles.py`).
  Equal sets are one class; all that follows works on classes, so copies cost
  nothing and are never paired.
* One permutation: the range of the hash is cut into `BINS` bins and each bin keeps
  its smallest shingle. Optimal densification: an empty bin takes the value of the
  first filled bin in a random order of its own.
* `BANDS` bands of `ROWS` bins give bucket keys. Two sets with similarity 0.85
  share no bucket with a chance of about 3e-7.
* Candidates are stars: every class is tried with one hub, the best of its buckets,
  so there are never more pairs than classes. The best hub is the class whose
  buckets hold the most members, as the origin of a group of edited copies does.
* Most buckets then lie within one component. In the others every two members of
  different components are compared in place, in cells of two groups of `GROUP`
  members, or of fewer where their sets take more than `CELL_BYTES`. A cell emits no pairs but links that join components, fewer than it has
  members; so no pair of a bucket is left out and none is a row.
* A link is confirmed on the full sets: members' sets are sent to their hub, large
  stars in parts, and streamed past it; cells hold the full sets of their members.

`components.py` joins links. Nothing but a bitmap of fixed size (which classes are
to be compared) passes the driver.

Defined cases: a null text or one without words is an empty set, linked with
nothing; rows with a null id take part in links, and a component is named by its
smallest id that is not null (null if it has none); repeated rows are equal sets
and get equal answers; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspan.llm.common import batches, release, schema_of, settled, small_batches, text_bytes, text_key
from sigspan.llm.components import components
from sigspan.llm.shingles import forget, mixed, shingle_sets
from sigspan.session import shuffle_partitions

BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
SIMILARITY = 85  #: per cent of the union that two linked sets share
STAR = 128  #: members of a hub whose sets are compared in one run
GROUP = 1024  #: members of a bucket on one side of a cell
CELL_BYTES = 32 << 20  #: of their sets
FILTER_BITS = 1 << 24  #: size of the bitmap of wanted documents (2 MB)

_rng = np.random.Generator(np.random.PCG64(44))
_EDGES = np.array([-(-(b << 64) // BINS) for b in range(BINS)], np.uint64)
_DONORS = np.stack([_rng.permutation(BINS) for _ in range(BINS)]).astype(np.int64)
_MIX = _rng.integers(1, 1 << 64, BINS, np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a sorted set that isn't empty."""
    at = np.searchsorted(shingles, _EDGES)
    filled = at < np.r_[at[1:], len(shingles)]
    values = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        orders = _DONORS[empty]
        values[empty] = values[orders[np.arange(len(empty)), filled[orders].argmax(1)]]
    return values


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band; the band's number is part of it."""
    return mixed((signature * _MIX).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def set_id(shingles: np.ndarray) -> bytes | None:
    """128 bits that name a set; null for the empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _features(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int64())
    for batch in arrow:
        for part in batches(batch, "text"):
            sets = shingle_sets(*text_bytes(part.column("text")))
            keys = [band_keys(signature(s)).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_id(s) for s in sets], pa.binary()),
                    pa.array(keys, kind),
                ],
                ["doc_id", "n_shingles", "set_id", "bands"],
            )
    forget()
    release()


def _slot(column: str):
    return F.xxhash64(F.col(column)).bitwiseAND(F.lit(FILTER_BITS - 1))


def _wanted_bits(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, FILTER_BITS long whatever the number of ids."""
    slot = ids.select(_slot("rep").alias("s"))
    bit = F.expr("shiftleft(1L, cast(s & 63 as int))")
    words = slot.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy()
    return bits


def _sets_of(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(doc_id, set_id, shingles) of the documents in the bitmap, and a few others."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def sets(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            slot = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((shared.value[slot >> 6] >> (slot & 63)) & 1 == 1))
            for part in batches(batch, "text"):
                found = shingle_sets(*text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([set_id(s) for s in found], pa.binary()),
                        pa.array([s.tobytes() for s in found], pa.binary()),
                    ],
                    ["doc_id", "set_id", "shingles"],
                )
        forget()
        release()

    return docs.select("doc_id", "text", _slot("doc_id").alias("slot")).mapInArrow(
        sets, schema_of(docs.select("doc_id"), set_id="binary", shingles="binary")
    )


def _compare(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by star, hub first, past the hub's set."""
    hub, held = None, None
    for batch in arrow:
        pairs = []
        columns = [batch.column(c).to_pylist() for c in ("hub", "set_id", "shingles")]
        for a, b, shingles in zip(*columns):
            shingles = np.frombuffer(shingles, np.uint64)
            if a == b:
                hub, held = a, shingles
                continue
            assert hub == a, "a star without its hub"
            at = np.minimum(np.searchsorted(held, shingles), len(held) - 1)
            common = int((held[at] == shingles).sum())
            if 100 * common >= SIMILARITY * (len(held) + len(shingles) - common):
                pairs.append((a, b))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], ["a", "b"]
        )


def _with_sets(docs: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (stored, with set_id) with the full set of each row's class in `shingles`."""
    wanted = asked.select("set_id").distinct().join(classes.select("set_id", "rep"), "set_id")
    sets = _sets_of(docs, _wanted_bits(wanted)).withColumnRenamed("set_id", "of")
    reps = wanted.withColumnRenamed("set_id", "of")
    # a class is read from one of its documents; others come along by chance, or as repeated rows
    sets = sets.join(reps, "of").where(F.col("doc_id").eqNullSafe(F.col("rep"))).drop("doc_id", "rep")
    return asked.join(sets, F.col("set_id") == F.col("of")).drop("of")


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) of pairs whose full sets are similar enough; a is the hub."""
    stars = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    members = pairs.join(stars, "a").select(F.col("b").alias("set_id"), F.col("a").alias("hub"), part)
    hubs = stars.select(
        F.col("a").alias("set_id"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    rows = _with_sets(docs, classes, settled(members.unionByName(hubs), "near-asked"))
    rows = rows.repartition(shuffle_partitions(docs.sparkSession), "hub", "part")
    rows = rows.sortWithinPartitions("hub", "part", F.col("hub") != F.col("set_id"))
    return rows.select("hub", "set_id", "shingles").mapInArrow(_compare, "a binary, b binary")


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of some sets with others, as a matrix."""
    if len(sets) == 2:
        at = np.minimum(np.searchsorted(sets[0], sets[1]), len(sets[0]) - 1)
        return np.full((len(left), len(right)), int((sets[0][at] == sets[1]).sum()))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1  # what only one set holds is in no intersection
    owner, column = owner[shared], (np.cumsum(counts > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    found = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, GROUP):
        begin, end = np.searchsorted(column, [first, first + GROUP])
        held = np.zeros((len(sets), GROUP), np.float32)
        held[owner[begin:end], column[begin:end] - first] = 1
        found += held[left] @ held[right].T
    return found


def _joining(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
    """Links between the members of a cell that join different components.

    rows: (set_id, root, side, shingles); side 0 is compared with its own group.
    """
    side = np.array([r[2] for r in rows])
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    _, root = np.unique(np.array([r[1] for r in rows], dtype=object), return_inverse=True)
    if not len(left) or not len(right) or root.max() == 0:
        return []
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    common = _common(sets, left, right)
    union = sizes[left][:, None] + sizes[right] - common
    near = (100 * common >= SIMILARITY * union) & (root[left][:, None] != root[right])
    a, b = (x[i] for x, i in zip((left, right), np.nonzero(near)))
    _, first = np.unique(np.minimum(root[a], root[b]) * len(rows) + np.maximum(root[a], root[b]), return_index=True)
    parent, found = {}, []

    def top(r: int) -> int:
        while r in parent:
            r = parent[r]
        return r

    for i in first.tolist():
        x, y = top(int(root[a[i]])), top(int(root[b[i]]))
        if x != y:
            parent[x] = y
            found.append((rows[a[i]][0], rows[b[i]][0]))
    return found


def _cells(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells lie one after the other, over the borders of batches."""
    name, rows = None, []

    def links() -> pa.RecordBatch:
        pairs = _joining(rows) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], ["a", "b"])

    for batch in arrow:
        columns = [batch.column(c).to_pylist() for c in ("key", "i", "j", "set_id", "root", "side", "shingles")]
        for key, i, j, *row in zip(*columns):
            if (key, i, j) != name:
                found = links()
                if found.num_rows:
                    yield found
                name, rows = (key, i, j), []
            rows.append(tuple(row))
    yield links()


def compared(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) links that join the components in each bucket; members: key, set_id, n_shingles, root."""
    # buckets of the same members are one
    same = members.groupBy("key").agg(F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    once = same.groupBy("sum", "n").agg(F.min("key").alias("key"), F.max("shingles").alias("shingles"))
    groups = F.ceil(F.greatest(F.col("n") / GROUP, 8 * F.col("shingles") / CELL_BYTES)).cast("int")
    once = once.select("key", groups.alias("groups"))
    dealt = members.join(once, "key").withColumn("g", F.pmod(F.xxhash64("set_id"), F.col("groups")).cast("int"))
    dealt = dealt.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    side = F.signum(F.col("g") - F.col("h")).cast("int").alias("side")
    dealt = dealt.select("key", F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"), side, "set_id", "root")
    rows = _with_sets(docs, classes, settled(dealt, "near-cells"))
    rows = rows.repartition(shuffle_partitions(docs.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.select("key", "i", "j", "set_id", "root", "side", "shingles").mapInArrow(_cells, "a binary, b binary")


def _rooted(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with `root`, the component of their class."""
    return members.join(found, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))


def class_roots(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(set_id, root) of every class that is linked with another, as the module says."""
    buckets = classes.select("set_id", "n_shingles", F.explode("bands").alias("key"))
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = settled(buckets.join(sizes, "key"), "near-members")
    weights = members.groupBy("set_id").agg(F.struct(F.sum("n").alias("weight"), "set_id").alias("who"))
    weighed = members.select("key", "set_id").join(weights, "set_id")
    hubs = weighed.groupBy("key").agg(F.max("who").alias("hub"))
    best = weighed.select("key", "set_id").join(hubs, "key").groupBy("set_id").agg(F.max("hub").alias("hub"))
    pairs = best.select(F.col("hub.set_id").alias("a"), F.col("set_id").alias("b")).where("a <> b")
    links = confirmed(docs, classes, pairs)
    found = components(links, name="near-components").withColumnRenamed("vertex", "set_id")

    labelled = _rooted(members.drop("n"), found)
    open_keys = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    labelled = settled(labelled.join(open_keys.select("key"), "key", "left_semi"), "near-open")
    stars = found.where("set_id <> root").select(F.col("root").alias("a"), F.col("set_id").alias("b"))
    links = stars.unionByName(compared(docs, classes, labelled))
    return components(links, name="near-components").withColumnRenamed("vertex", "set_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = small_batches(docs).select("doc_id", "text")
    kinds = schema_of(docs.select("doc_id"), n_shingles="long", set_id="binary", bands=T.ArrayType(T.LongType()))
    features = settled(docs.mapInArrow(_features, kinds), "near-features")
    classes = features.where("set_id is not null").groupBy("set_id")
    classes = settled(classes.agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")), "near-classes")
    named = _rooted(classes.select("set_id", "rep"), class_roots(docs, classes))
    names = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.select("set_id", "root").join(names, "root").select("set_id", "component_id")
    found = features.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, columns unchanged.

    A row is its id and text: of rows equal in both a single one stays, while rows
    that only share an id, or have none, are documents of their own. The smallest id
    of a group is kept, null last.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), text_key().alias("text"))
    kept = near_duplicates(docs.select(row.alias("doc_id"), "text")).where("kept")
    kept = kept.select(F.col("doc_id.id").alias("_kept"), F.col("doc_id.text").alias("_kept_text")).distinct()
    found = docs.withColumn("_text", text_key())
    found = found.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("_text") == F.col("_kept_text")), "left_semi")
    return found.dropDuplicates(["doc_id", "_text"]).drop("_text")
