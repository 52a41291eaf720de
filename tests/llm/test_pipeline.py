"""The pipeline's stages on small tables."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from curbloop.llm import neardup, secret_scan
from curbloop.operators.scratch import stage
from tests.llm.conftest import ODD
from tests.llm.test_token_operators import check_packed

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, names, before = docs.columns, [], docs
    for name, function in corpus_pipeline.STAGES:
        after = stage(function(spark, before, SF), "test")
        names.append(name)
        if name == "language":
            assert {r.doc_id for r in before.select("doc_id").collect()} - {r.doc_id for r in after.select("doc_id").collect()} == \
                {r.doc_id for r in before.filter("text is null or not text rlike '\\\\p{L}'").collect()}
        if name == "near_dedup":
            sizes = {r.class_size for r in neardup.classes(after).collect()}
            assert after.count() == neardup.classes(before).select("class_id").distinct().count() and sizes == {1}
        if name == "secrets":
            assert after.count() == before.count() and not any(secret_scan.scan(r.text or "") for r in after.collect())
            assert after.filter(F.col("n_chars") != F.length("text")).count() == 0
        if name == "packing":
            check_packed(after.collect())
            assert after.groupBy("sequence_id").count().count() > 0 and after.agg(F.sum(F.col("length"))).first()[0] == \
                after.filter("start = 0").agg(F.sum("doc_tokens")).first()[0]
        else:
            assert after.columns == columns
        before = after
    assert names == ["language", "near_dedup", "secrets", "mix", "packing"]
    assert corpus_pipeline.run(spark, SF).count() == before.count()


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_documents(spark, docs, rows):
    at = docs if rows else docs.limit(0)
    for _, function in corpus_pipeline.STAGES:
        at = function(spark, at, SF)
    assert (at.count() > 0) == bool(rows)
