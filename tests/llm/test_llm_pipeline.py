import corpus_pipeline
from tests.llm.fixtures import frame, rows, texts

import __spark_entry__


def test_stages_over_tables(spark, tmp_path):
    frame(spark, rows(n=64)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, texts(64, 5)[0]), (2, "not there at all in any text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i * 3 + 1, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[2] < sizes[0]
    mixed = corpus_pipeline.run(spark, str(tmp_path))
    assert mixed.count() > 0 and 1 not in {d for r in mixed.collect() for d in r.doc_ids}


def test_every_operator_is_registered():
    found = __spark_entry__.queries()
    assert all(any(q.startswith(f"op{n}_") for q in found) for n in range(1, 11)) and "pipeline" in found
