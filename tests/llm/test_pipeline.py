import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from transitlab.llm import quality

from test_simhash import slow_components, slow_fingerprint
from test_substring import brute


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """Each stage's rows, written and read again as the next one's input."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], small).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def test_columns_and_order(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "repeated_passages", "packing"]
    for docs in stages[1:-1]:
        assert docs.dtypes == stages[0].dtypes


def test_filters_drop_whole_rows_only(spark, small, stages):
    for before, after in zip(stages[:3], stages[1:4]):
        assert after.exceptAll(before).count() == 0
    judged = quality.judge(stages[1], public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert {r.doc_id for r in judged.where("kept").collect()} == {r.doc_id for r in stages[2].collect()}


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in stages[2].collect()]
    want = {c for c in slow_components(rows, 4)}
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(want)


def test_repeated_passages_go(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    want = {d: (text if removed else before[d]) for d, _, removed, text in brute(list(before.items()), 50)}
    after = stages[4].collect()
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after if r.text != before[r.doc_id])


def test_packing_takes_all(stages):
    totals = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("want")).collect()
    assert all(r.n == r.want for r in totals)
    assert {r.doc_id for r in totals} == {r.doc_id for r in stages[4].collect()}


def test_run_is_the_stages(spark, small, stages):
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, __spark_entry__.queries()["pipeline"](spark, small).select(*keys).collect())) == sorted(
        map(tuple, stages[5].select(*keys).collect())
    )


def test_stages_take_edges(spark, small, edge, empty, clashing):
    for docs in (empty, clashing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, small)
            assert found.columns == docs.columns
            assert found.count() <= docs.count()
