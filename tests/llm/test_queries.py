"""The registered queries at the smallest scale: against their SQL, or against an independent computation."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import queries as q
from tests.oracle import assert_same, database

from .fixtures import documents as fixture_documents
from .test_cover_tree import brute as brute_vectors
from .test_minhash_dedup import brute as brute_sets

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert_same(q.queries()[name](spark, FOLDER).toPandas(), con.sql(q.oracle_sql()[name]).df())


def test_near_duplicates(spark, con):
    rows = con.sql("select doc_id, text from documents").fetchall()
    found = {r[0]: tuple(r[1:]) for r in q.op6_minhash_dedup(spark, FOLDER).collect()}
    assert found == brute_sets(rows, 4)


def test_near_vectors(spark, con):
    rows = con.sql("select vec_id, embedding from embeddings").fetchall()
    found = {r[0]: tuple(r[1:]) for r in q.op8_cover_tree(spark, FOLDER).collect()}
    assert found == brute_vectors([r[0] for r in rows], np.array([r[1] for r in rows], float), 0.9)


def test_quality(spark, con):
    truth = dict(con.sql("select doc_id, quality from labels").fetchall())
    found = q.op7_quality_nbsvm(spark, FOLDER).collect()
    assert len(found) == con.sql("select count(*) from documents").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in found)
    held = [r.predicted == truth[r.doc_id] for r in found if r.held_out and r.doc_id in truth]
    assert np.mean(held) >= 0.9


def test_losses_of_every_document(spark, con):
    found = q.op9_lm_difference(spark, FOLDER).toPandas()
    assert len(found) == con.sql("select count(*) from documents").fetchall()[0][0]
    quality = dict(con.sql("select doc_id, quality from labels").fetchall())
    by = [[x.difference for x in found.itertuples() if quality.get(x.doc_id) == y] for y in (0, 1)]
    assert np.mean(by[0]) > np.mean(by[1])


def test_packing_and_fingerprints_cover_all(spark, con):
    n = con.sql("select count(*) from documents").fetchall()[0][0]
    pieces = q.op4_packing(spark, FOLDER).toPandas()
    assert pieces.doc_id.nunique() == n and (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    assert q.op10_order_minhash(spark, FOLDER).count() == n


def test_pipeline_stage_by_stage(spark, con):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    quality = corpus_pipeline.quality(spark, docs, FOLDER)
    assert quality.columns == columns
    truth = dict(con.sql("select doc_id, quality from labels").fetchall())
    passed = {r.doc_id: r.text for r in quality.collect()}
    assert np.mean([(d in passed) == bool(y) for d, y in truth.items()]) > 0.9
    kept = corpus_pipeline.near_dedup(spark, quality, FOLDER)
    wanted = {d for d, (_, _, k) in brute_sets(list(passed.items()), 5).items() if k}
    assert kept.columns == columns and {r.doc_id for r in kept.select("doc_id").collect()} == wanted
    mixed = corpus_pipeline.mix(spark, kept, FOLDER)
    ids = [r.doc_id for r in mixed.select("doc_id").collect()]
    assert mixed.columns == columns and len(ids) == len(set(ids)) and set(ids) < wanted
    packed = corpus_pipeline.pack(spark, mixed, FOLDER).toPandas()
    assert set(packed.doc_id) == set(ids)
    whole = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert set(whole.doc_id) == set(ids)


def test_stages_on_missing_and_repeated_values_and_clashing_names(spark, con):
    helpers = ["SCORE", "score_", "__score", "a.b", "a`b", "id", "row", "key", "kept", "component_id", "copies", "taken", "length", "start"]
    rows = [(*r, *range(len(helpers))) for r in fixture_documents(5)] + [(None, t, None, None, None, *[None] * len(helpers)) for t in (None, "", "no id has this text")]
    rows += [rows[0], rows[1], (rows[2][0], "another text of an id", "en", "src1", 9, *[None] * len(helpers))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + h.replace("`", "``") + "` int" for h in helpers)
    docs = spark.createDataFrame(rows, schema)
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert after.exceptAll(docs).isEmpty() and 0 < after.count() <= before
        empty = stage(spark, docs.limit(0), FOLDER)
        assert empty.dtypes == docs.dtypes and empty.collect() == []
    packed = corpus_pipeline.pack(spark, docs, FOLDER)
    whole = packed.groupBy("doc_id").agg({"length": "sum"}).count()
    assert whole == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.pack(spark, docs.limit(0), FOLDER).collect() == []
    deduped = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert deduped.where("doc_id is null").count() == 3
    ids = deduped.where("doc_id is not null").select("doc_id")
    assert ids.count() == ids.distinct().count()
