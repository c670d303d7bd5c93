"""Periodic runs, toxicity and the filter audit: odd cases and brute-force versions."""

import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from fixtures import ENGLISH, clashing, crc, empty, odd_documents, prose, read, rows, sha, tokens

from sigspan.llm import filter_audit, queries, toxic_dictionaries, word_runs

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
given = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


@pytest.fixture(scope="module")
def odd(spark):
    return clashing(odd_documents(spark)).cache()


# --- 11 periodic runs


def brute_runs(words):
    """Every stretch by every period, from its definition."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(6, 4 * q) and not any(
                all(stretch[k] == stretch[k + r] for k in range(len(stretch) - r)) for r in range(1, q)
            ):
                found.add((i, len(stretch), q))
            i = max(i + 1, j)
    return sorted(found)


def brute_collapsed(words, runs):
    dropped = {k for start, length, period in runs for k in range(start + period, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in dropped)


def planted(doc_id, words):
    if doc_id is None or crc(str(doc_id)) % 10 or not words:
        return words
    n, g = len(words), crc(str(doc_id)) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_report(doc):
    words = planted(doc["doc_id"], tokens(doc["text"]))
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return doc["doc_id"], len(runs), *best, milli, sha(lines), sha(brute_collapsed(words, runs))


def test_runs_of_random_words():
    rng = random.Random(11)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(1, 6)):
            words = [rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.choice([0, 1, 5, 6, 12, 40]))]
            if rng.random() < 0.5:
                words[3:3] = [rng.choice("abx") for _ in range(rng.randint(1, 5))] * rng.randint(3, 9)
            texts.append(rng.choice(["", " \t"]) + rng.choice([" ", "\n\r"]).join(words) + rng.choice(["", "\x0b"]))
        found, collapsed = word_runs.analysed(pa.array([*texts, None], pa.string()))
        for text, runs, left in zip([*texts, ""], found.to_pylist(), collapsed.to_pylist()):
            runs = [(r["start"], r["length"], r["period"]) for r in runs]
            assert runs == brute_runs(tokens(text))
            assert left == brute_collapsed(tokens(text), runs)


def test_suffix_and_lcp_arrays():
    rng = random.Random(3)
    for _ in range(50):
        counts = np.array([rng.randint(0, 12) for _ in range(4)])
        texts = [[rng.choice("ab") for _ in range(n)] for n in counts]
        flat = [f"{k}{w}" for k, t in enumerate(texts) for w in t]
        if not flat:
            continue
        number = {w: i for i, w in enumerate(sorted(set(flat)))}
        ends = np.repeat(np.cumsum(counts), counts)
        codes = np.array([number[w] for w in flat])
        order, rank = word_runs.suffix_array(codes, ends)
        suffix = [flat[i : ends[i]] for i in range(len(flat))]
        assert order.tolist() == sorted(range(len(flat)), key=lambda i: suffix[i])
        assert (rank[order] == np.arange(len(flat))).all()
        lcp = word_runs.lcp_array(codes, ends, order)
        for k in range(1, len(flat)):
            a, b = suffix[order[k - 1]], suffix[order[k]]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_long_runs_take_no_square_time():
    for words in (["a"] * 100_000, [str(i) for i in range(20_000)] * 5):
        found, collapsed = word_runs.analysed(pa.array([" ".join(words)]))
        period = len(set(words))
        assert found.to_pylist() == [[{"start": 0, "length": len(words), "period": period}]]
        assert collapsed[0].as_py() == " ".join(words[:period])


def test_runs_of_odd_documents(spark, odd):
    docs = [r.asDict() for r in odd.collect()]
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    report = word_runs.run_report(odd)
    assert report.columns == names
    small = [d for d in docs if len(tokens(d["text"])) < 1000]
    got = [r for r in rows(report, *names) if r[0] != 9]
    assert got == sorted(map(brute_report, small), key=repr)
    found = word_runs.with_runs(odd.withColumn("runs", odd["n_chars"]))
    assert found.count() == len(docs) and {"shard", "runs", "collapsed"} <= set(found.columns)
    assert word_runs.run_report(empty(spark, odd)).count() == 0
    ties = spark.createDataFrame([(None, "a b a b a b a b c d c d c d c d e"), (None, None)], "doc_id long, text string")
    best = word_runs.run_report(ties).orderBy("n_runs").collect()
    assert (best[0]["n_runs"], best[0]["start"]) == (0, None)
    assert (best[1]["n_runs"], best[1]["start"], best[1]["exponent_milli"]) == (2, 0, 4000)


@given
def test_runs_query(spark):
    found = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, SF_DIR).collect()}
    docs = read(SF_DIR, "documents")
    assert len(found) == len(docs)
    for doc in docs:
        if len(tokens(doc["text"])) <= 1500:
            assert found[doc["doc_id"]] == brute_report(doc)
    assert sum(r[1] for r in found.values()) > 5


# --- 12 toxicity


def toxic_corpus(spark, n=400):
    """Every fourth document holds a few of ten words that no other one has."""
    rng, words = random.Random(12), [prose(900 + i, 1, ["zork", "quib", "frob"]) + "le" for i in range(10)]
    docs, labels = [], []
    for i in range(n):
        text = prose(i, 80, ENGLISH).split()
        toxic = i % 4 == 0
        for _ in range(5 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(words))
        docs.append((i, " ".join(text), "en", "a"))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_of_held_out_documents(spark):
    docs, labels = toxic_corpus(spark)
    found = toxic_dictionaries.toxicity(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    docs, labels = toxic_corpus(spark, 200)
    from pyspark.sql import functions as F

    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    shuffled = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("z").alias("source"))
    assert rows(toxic_dictionaries.toxicity(docs, labels), "*") == rows(toxic_dictionaries.toxicity(shuffled, turned), "*")


def test_a_family_of_toxic_copies_makes_no_toxic_words(spark):
    """Words that only edited copies of one text have do not tell the kinds apart; words in many contexts do."""
    draw = np.random.default_rng(5)
    plain = [" ".join(f"w{k}" for k in draw.integers(0, 80, 40)) for _ in range(120)]
    family = [f"v{i} tall green hills rest beside seven quiet lakes {t}" for i, t in enumerate(plain[:30])]
    insults = [" ".join("scum" if k % 9 == 4 else w for k, w in enumerate(t.split())) for t in plain[30:60]]
    texts = [(t, 1) for t in family + insults] + [(t, 0) for t in plain[60:]]
    shared, ordinary, toxic = toxic_dictionaries.word_kinds(spark.createDataFrame(texts, "text string, toxic int"))
    assert "scum" in toxic and not {"green", "hills", "seven", "quiet"} & {*toxic, *ordinary}


def test_toxicity_of_odd_documents(spark, odd):
    _, labels = toxic_corpus(spark, 60)
    messy = labels.unionByName(spark.createDataFrame([(None, 1, 1), (4, None, None), (5, 0, None), (6, 1, 1)], labels.schema))
    docs = odd.collect()
    found = toxic_dictionaries.toxicity(odd, messy)
    assert found.count() == len(docs)
    assert not any(np.isnan(r["score"]) for r in found.collect())
    by_text = {}
    for d, r in zip(docs, toxic_dictionaries.scored(odd, toxic_dictionaries.train(odd, messy)).collect()):
        assert by_text.setdefault(d["text"] or "", r["score"]) == r["score"]
        assert r["shard"] == "7"
    assert toxic_dictionaries.toxicity(empty(spark, odd), messy).count() == 0
    for some, score in ((messy.limit(0), 0.0), (messy.where("toxic = 0"), 0.0)):
        assert {r["score"] for r in toxic_dictionaries.toxicity(odd, some).collect()} == {score}


@given
def test_toxicity_query(spark):
    found = queries.op12_toxicity(spark, SF_DIR)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert found.count() == len(read(SF_DIR, "documents"))


# --- 13 filter audit


def brute_audit(docs, labels):
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1 and r["doc_id"] is not None}
    first = {}
    for d in docs:
        if d["doc_id"] is not None:
            first[d["text"] or ""] = min(first.get(d["text"] or "", d["doc_id"]), d["doc_id"])
    failed = []
    for d in docs:
        text, words = d["text"] or "", tokens(d["text"])
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * (d["doc_id"] is not None and d["doc_id"] > first[text])
        failed.append((d["source"] or "", fails, d["doc_id"] in good, d["doc_id"] in toxic))
    found, shapley = [], Counter()
    for part in {f[0] for f in failed}:
        mine = [f for f in failed if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                all_failing = sum(name in f[1] for f in mine)
                alone = sum(f[1] == name for f in mine)
                shapley[part, name] += len(gone)
                found.append(
                    [part, order, step, len(left), len(gone), all_failing - len(gone), alone, sum(f[2] for f in gone), sum(f[3] for f in gone)]
                )
    return sorted((*f, shapley[f[0], f[1][f[2] - 1]]) for f in found)


def audited(docs, labels):
    report = filter_audit.filter_audit(docs, labels)
    assert dict(report.dtypes)["step"] == "int" and dict(report.dtypes)["shapley"] == "bigint"
    return rows(report, *"part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split())


def test_audit_of_odd_documents(spark, odd):
    labels = [(None, 1, 1), (4, 1, None), (4, 0, 1), (5, None, 1), (1, 1, 0), (3, 1, 0), (13, 1, 1), (7, 0, 0), (777, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(odd, labels) == sorted(brute_audit([r.asDict() for r in odd.collect()], [r.asDict() for r in labels.collect()]), key=repr)
    assert audited(empty(spark, odd), labels) == []
    clean = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "s")], "doc_id long, text string, source string")
    report = audited(clean, labels)
    assert len(report) == 600 and {r[3:] for r in report} == {(1, 0, 0, 0, 0, 0, 0)}


def test_audit_of_many_copies(spark):
    """One text in most rows, under ids and without."""
    docs = [(i if i % 3 else None, "same words " * 40 if i % 5 else f"other {i}", "ab"[i % 2]) for i in range(300)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(300)], "doc_id long, quality int, toxic int")
    want = brute_audit([r.asDict() for r in docs.collect()], [r.asDict() for r in labels.collect()])
    assert audited(docs, labels) == sorted(want, key=repr)


