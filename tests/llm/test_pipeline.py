import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    from codeloom.llm import packing, pii

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    sizes = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).toPandas(), docs.schema)
        assert kept.columns == columns, name
        sizes.append(kept.count())
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[3]
    assert all(not any(k in pii.BASE for k, _, _ in pii.spans_of(r["text"])) and len(r["text"]) == r["n_chars"] for r in kept.collect())
    packed = pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in kept.collect()}
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= packing.WINDOW


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(pipeline.run(spark, SF)) == key(docs)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
