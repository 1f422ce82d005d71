import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in p.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    counts = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
    assert counts[2] < counts[1] and counts[3] < counts[2]
    last = p.STAGES[-1][1](spark, docs, SF)
    sizes = [r["count"] for r in last.groupBy("shard").count().collect()]
    assert sum(sizes) == counts[-1] and max(sizes) - min(sizes) <= 1


def test_pipeline_on_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline as p

    for t in ("documents",):
        empty.write.parquet(f"file://{tmp_path}/{t}.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert p.run(spark, f"file://{tmp_path}").count() == 0
