import corpus_pipeline

from graphloom.llm import decontaminate, quality, simhash


def test_stages_on_odd_rows(spark, odd, odd_rows, labels, tmp_path, empty):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "ünï çødé")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "sharding":
                assert out.columns == docs.columns
            path = str(tmp_path / f"{name}-{docs is empty}-{len(list(tmp_path.iterdir()))}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)


def test_run(spark):
    """Each stage's decision on the small table, against the operator's own rows."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels, bench = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    good = {r.doc_id for r in quality.score(docs, labels).collect() if r.predicted}
    kept = docs.where(docs.doc_id.isin(sorted(good)))
    first = {r.doc_id for r in simhash.near_duplicates(kept).collect() if r.doc_id == r.component_id}
    bad = {r.doc_id for r in decontaminate.contamination(docs, bench).collect() if r.n_hit}
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in rows} == first - bad
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
