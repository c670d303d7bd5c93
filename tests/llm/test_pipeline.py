"""The pipeline as a whole, and on odd tables."""

import os

import pytest
from fixtures import ENGLISH, clashing, empty, near_components, odd_documents, prose, read

import corpus_pipeline
from sigspan.llm import budget_mix, cross_parse, kneser_ney, star_dedup
from sigspan.llm.common import stored, table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


def test_stages_take_effect(spark):
    """Every stage against what its operator, or a brute-force version, says of its own input."""
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF_DIR), "stage-test")
        before, after = [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]
        if name != "bpe_encoding":
            assert out.columns == columns and all(r in before for r in after)
        if name == "language_id":
            bad = {r["doc_id"] for r in cross_parse.language_id(docs).where("lang_pred = 'und'").collect()}
            assert [r["doc_id"] for r in after] == [r["doc_id"] for r in before if r["doc_id"] not in bad]
        elif name == "quality_classifier":
            kept = kneser_ney.rated(docs, table(spark, SF_DIR, "labels")).where("kept")
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in kept.collect())
        elif name == "near_dedup":
            assert sorted(r["doc_id"] for r in after) == sorted(r[0] for r in near_components(before) if r[3])
        elif name == "mixing":
            assert max(sum(r == x for r in after) for x in before[:20]) <= 3
        else:
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before)
        docs = out


def test_stages_on_odd_tables(spark, tmp_path):
    odd = clashing(odd_documents(spark))
    table(spark, SF_DIR, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (odd, empty(spark, odd)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, str(tmp_path)), "odd-test")
            assert name == "bpe_encoding" or docs.columns == odd.columns
        assert start is odd or docs.count() == 0


def test_rows_without_ids_of_their_own(spark):
    """Several null ids and one id with unlike texts: a stage decides on each row by its text."""
    texts = [prose(60 + i, 60 + i, ENGLISH) for i in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (6, texts[2]), (None, texts[3])]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = sorted(((r["doc_id"], r["text"]) for r in star_dedup.keep_one(docs).collect()), key=repr)
    assert got == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3])], key=repr)

    trusted = [(100 + i, prose(200 + i, 60, ENGLISH), "en", "a") for i in range(60)]
    junk = "#@ 9Z!" * 40
    odd = [(None, texts[0], "en", "a"), (None, junk, "en", "a"), (7, texts[1], "en", "a"), (7, junk, "en", "a")]
    docs = spark.createDataFrame([*trusted, *odd], docs.schema)
    labels = spark.createDataFrame([(t[0], 1, 0) for t in trusted], "doc_id long, quality int, toxic int")
    got = {(r["doc_id"], r["text"]) for r in kneser_ney.keep_fluent(docs, labels).collect()}
    assert {(None, texts[0]), (7, texts[1])} <= got and not any(t == junk for _, t in got)

    docs = spark.createDataFrame([(8, "", "en", "a"), (8, texts[0], "en", "a"), (8, texts[4], "en", "a"), (9, texts[5], "en", "b")], docs.schema)
    want = sum(r["taken"] for r in budget_mix.mix_sources(docs).collect())
    drawn = [r["text"] for r in budget_mix.draw(docs).collect()]
    assert "" not in drawn and sum(len(t.split()) for t in drawn) == want


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 100
    assert len(read(SF_DIR, "documents")) > 100
