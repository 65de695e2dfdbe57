"""The corpus pipeline on a small fixture: what each stage must drop and keep."""

import cases
import corpus_pipeline
from test_learned import toxic_corpus

from storyloom.llm import queries

ITEM = " ".join(cases.words(24, 77).split())


def test_pipeline(spark, tmp_path):
    docs, labels = toxic_corpus(spark)
    near = docs.where("doc_id = 3").first().text.split()
    more = [(1000, docs.where("doc_id = 1").first().text, "en", "a", 0), (1001, " ".join([*near, "tail"]), "en", "a", 0), (1002, cases.words(30, 5) + " " + ITEM + " " + cases.words(30, 6), "en", "a", 0), (1003, "123 456", "en", "a", 0), (1004, None, "en", "a", 0), (1005, "", None, None, 0)]
    every = docs.unionByName(spark.createDataFrame(more, cases.SCHEMA))
    every.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert not {1000, 1001, 1002, 1003, 1004, 1005} & left
    clean = {i for i in range(240) if i % 4}
    assert {1, 3} <= left and len(clean - left) <= 4 and len(left - clean) <= 4
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "toxicity", "simhash", "decontamination", "packing"]
    current = cases.awkward(every)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == cases.awkward(every).columns, name


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stages_move_rows_in_small_batches(spark):
    """Executors and workers hold a batch each: of long texts it may not have ten thousand rows."""
    import corpus_pipeline
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    kept = {key: spark.conf.get(key) for key in corpus_pipeline.BATCHES}
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('word word ', id) as text", "'en' as lang", "'a' as source", "12 as n_chars").coalesce(1)
    try:
        corpus_pipeline.pack(spark, docs, "")
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= 1000
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
