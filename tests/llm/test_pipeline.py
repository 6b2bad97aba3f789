import corpus_pipeline
from testfloor.llm import decontaminate, language, neardup, pii, queries
from testfloor.session import materialize


def test_stages_take_effect_and_match_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("source", "KEPT")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language_id" and len(corpus_pipeline.STAGES) == 5
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, before, sf), "stage")
        assert after.columns == docs.columns
        ids = {r.doc_id for r in after.collect()}
        if name == "language_id":
            judged = language.predict(before, queries.trained(before)).collect()
            assert ids == {r.doc_id for r in judged if r.lang_pred != "und" and r.score >= 0.4}
            assert len(ids) > 0.9 * len(judged)
        if name == "near_duplicates":
            rows = neardup.groups(before).collect()
            assert ids == {r.component_id for r in rows}
        if name == "decontamination":
            bad = decontaminate.overlaps(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
            assert ids == {r.doc_id for r in before.collect()} - {r.doc_id for r in bad} and bad
        if name == "personal_data":
            assert not any(pii.find(r.text or "") for r in after.collect())
            assert ids == {r.doc_id for r in before.collect()}
        before = after


def test_run_packs_what_is_left(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_tables_and_nulls(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    blank = spark.createDataFrame([tuple(None for _ in docs.columns)] * 2, docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        stage(spark, blank, sf).collect()
