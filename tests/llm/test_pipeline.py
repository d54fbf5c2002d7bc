"""The pipeline's stages on odd rows, and the registered queries' SQL twins."""

import corpus_pipeline
from lodeseam.llm import queries
from lodeseam.session import persisted


def test_stages(spark, docs, rows, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, " ".join(rows[3][1].split()[20:60]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, seen = docs.select(*corpus_pipeline.COLUMNS), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in now.select("doc_id").collect()}
        now = persisted(spark, stage(spark, now, d), "test-stage")
        seen[name] = now
        assert {r["doc_id"] for r in now.collect()} <= before
        if name != "tokens":
            assert now.columns == corpus_pipeline.COLUMNS
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in seen.items()}
    assert 40 not in ids["quality_rules"] and 4 in ids["quality_rules"]
    assert 4 in ids["near_duplicates"] and 5 not in ids["near_duplicates"]
    assert rows[3][1].split()[30] not in seen["decontamination"].where("doc_id = 4").first()["text"]
    assert ids["tokens"] == ids["mixing"]
    starts = sorted((r["start"], r["n_tokens"]) for r in seen["tokens"].collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0


def test_stages_on_nothing(spark, none, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = none.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        now = persisted(spark, stage(spark, now, d), "test-none")
        assert now.count() == 0


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.ORACLE) <= set(queries.QUERIES)
