"""Registered queries against their SQL, and the pipeline against its stages' brute force."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def connection(folder):
    db = duckdb.connect()
    for name in os.listdir(folder):
        db.execute(f"create view {name.split('.')[0]} as select * from '{folder}/{name}'")
    return db


@pytest.mark.parametrize("name", ["op4_substrings", "op5_topk", "op8_pii", "op9_mix", "op11_ballkmeans", "op12_metricjoin", "op13_hardnegatives"])
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = connection(SF).sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = lambda found: sorted((tuple(r) for r in found), key=repr)
    assert rows(got.select(columns).collect()) == rows(want.select(*columns).fetchall())


def test_every_operator_is_registered():
    numbers = collections.Counter(n.split("_")[0] for n in entry.queries() if n.startswith("op"))
    assert numbers == {f"op{i}": 1 for i in range(1, 14)} and "pipeline" in entry.queries()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns and 0.8 * docs.count() <= kept.count() <= docs.count()
    single = corpus_pipeline.keep_one_of_each(spark, kept, SF)
    texts = [r.text for r in single.collect()]
    assert single.columns == docs.columns and len(texts) == len(set(texts)) == single.select("doc_id").distinct().count()
    assert {r.text for r in kept.collect()} >= set(texts)
    masked = corpus_pipeline.mask_pii(spark, single, SF)
    assert masked.columns == docs.columns and masked.count() == single.count()
    mixed = corpus_pipeline.mix_sources(spark, masked, SF)
    assert mixed.columns == docs.columns
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(mixed.collect()) - words(masked.collect())) <= 40
    final = corpus_pipeline.tokenize(spark, mixed, SF)
    assert final.count() == mixed.count() and final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
