"""Small tables with every odd case, and brute-force versions of what the operators compute."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names the operators use themselves
CLASHING = {"shard": "7", "slot": "x", "lang_pred": "zz", "score": "2.5", "perplexity": "p", "rank": "r", "n": "1", "times": "9", "ids": "0"}


def prose(seed, n, syllables):
    rng = random.Random(seed)
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words)


ENGLISH, FRENCH = "th er on an re he in ed nd ha".split(), "é è eau oi ou ai ch que le ç".split()


def odd_documents(spark):
    """Nulls in all columns, empty and very long texts, copies, ties and repeated rows."""
    base = prose(1, 120, ENGLISH)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    half = " ".join(words[:60] + prose(2, 60, ENGLISH).split())
    rows = [
        (None, base, "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, "short", "en", "b"), (4, base, "en", "b"),
        (4, base, "en", "b"), (5, base.upper(), "en", None), (6, near, None, "a"), (7, half, "en", "a"), (8, " \t\r\n", "fr", "c"),
        (9, prose(3, 30_000, ENGLISH), "en", "a"), (10, prose(4, 80, FRENCH), "fr", "c"), (11, prose(5, 90, FRENCH), "fr", None),
        (12, "12345 !!! 678", "fr", "d"), (13, "one two three four", "en", "d"), (14, "One two three four", "en", "d"),
        (15, "été Σας <|endoftext|>'s 漢字 \U0001f600\x1c", "fr", "d"), (16, "one two three four five", "en", "\U0001f600"),
    ] + [(20 + i, prose(20 + i, 40 + i, ENGLISH if i % 2 else FRENCH), "en" if i % 2 else "fr", "ab"[i % 2]) for i in range(30)]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(v).alias(k) for k, v in CLASHING.items() if k not in df.columns])


def empty(spark, df):
    return spark.createDataFrame([], df.schema)


def read(sf_dir, name):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def tokens(text):
    return WORD.findall(text or "")


def shingles(text):
    words = tokens((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_components(docs):
    """[(doc_id, n_shingles, component_id, kept)] by comparing all pairs that share a shingle."""
    sets = [shingles(d["text"]) for d in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for h in s:
            holders[h].append(i)
    common = Counter()
    for some in holders.values():
        common.update((a, b) for k, a in enumerate(some) for b in some[k + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    least = {}
    for i, d in enumerate(docs):
        if d["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), d["doc_id"]), d["doc_id"])
    found = []
    for i, d in enumerate(docs):
        component = least.get(find(i)) if sets[i] else d["doc_id"]
        found.append((d["doc_id"], len(sets[i]), component, d["doc_id"] == component))
    return sorted(found, key=repr)


def crc(text):
    return zlib.crc32((text or "").encode())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
