import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_turn(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
    assert seen[0] > seen[1] == seen[2] > seen[3] > seen[4] > 0
    texts = [r.text for r in docs.collect()]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(i in t for i in items for t in texts if i and t)
    pieces = pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == seen[4]
