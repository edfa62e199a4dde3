import pyarrow as pa

import corpus_pipeline as pipeline
from barloom.llm._spark import BATCH

DATA = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[0] > counts[1] >= counts[2] >= counts[3] and counts[5] == counts[4]


def test_stages_on_hard_rows(spark, nasty, none, labels, tmp_path):
    """Nulls, empty texts, repeated rows and clashing columns pass every stage; texts without an id stay apart."""
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    more = spark.createDataFrame([(None, f"text {i} without an id, of its own " + "word " * i, "a", True, 1, 0.5, "z") for i in range(3)], nasty.schema)
    rows = nasty.union(more)
    for name, stage in pipeline.STAGES[1:]:  # on so few labels the classifier may reject anything
        out = stage(spark, rows, str(tmp_path))
        assert stage(spark, none, str(tmp_path)).count() == 0
        if name != "bpe":
            assert out.columns == rows.columns
        if name in ("exact_dedup", "near_dedup"):
            assert out.where("doc_id IS NULL").count() == 4
        if name == "source_mix":
            assert out.where("doc_id IS NULL").select("text").distinct().count() >= 2
    assert pipeline.STAGES[0][1](spark, rows, str(tmp_path)).columns == rows.columns
    assert pipeline.STAGES[0][1](spark, none, str(tmp_path)).count() == 0


def test_stages_bound_what_stands_beside_the_heap(spark, tmp_path, labels):
    """Exact copies are found without Arrow batches; batches of the other stages hold few bytes, and wider rows make more of them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        labels.write.parquet(f"{tmp_path}/labels.parquet")
        docs = spark.createDataFrame([(i, f"{i} " + "word " * 4000, "a") for i in range(600)], "doc_id long, text string, source string").coalesce(1)
        assert "MapInArrow" not in pipeline.drop_exact_copies(spark, docs, str(tmp_path))._jdf.queryExecution().toString()
        pipeline.drop_low_quality(spark, docs, str(tmp_path))
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
        assert len(sizes) > 2 and max(r.n for r in sizes) < 2 * BATCH
        spark.conf.set(key, "64k")
        pipeline.drop_low_quality(spark, docs, str(tmp_path))
        assert spark.conf.get(key) == "64k"  # a smaller bound stays
    finally:
        spark.conf.set(key, before)
