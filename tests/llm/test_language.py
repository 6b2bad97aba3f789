from testfloor.llm import language
from testfloor.llm.queries import fold, op3_language_id


def test_held_out_accuracy(spark, sf):
    rows = op3_language_id(spark, sf.replace("0.001", "0.01"))
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang", "text")
    judged = rows.join(docs, "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    right = sum(r.lang == r.lang_pred for r in judged) / len(judged)
    print("held-out accuracy", right, len(judged))
    assert right > 0.95
    assert all(0 <= r.score <= 1 for r in judged)
    # The score is calibrated: its mean is near the accuracy.
    assert abs(sum(r.score for r in judged) / len(judged) - right) < 0.05


def test_nulls_and_empty(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, None, None, "x"), (2, "", "a", "x"), (3, "123 !", "a", "x"), (4, "hola", "es", "x"), (4, "hola", "es", "x")]
    docs = spark.createDataFrame(rows, schema)
    model = language.train(docs)
    out = {(r.doc_id, r.lang_pred) for r in language.predict(docs, model).collect()}
    assert out == {(1, "und"), (2, "und"), (3, "und"), (4, "es")}
    assert language.predict(docs, None).filter("lang_pred <> 'und'").count() == 0
    empty = docs.limit(0)
    assert language.train(empty) is None and language.predict(empty, model).count() == 0


def test_fold_follows_crc32(spark):
    import zlib

    rows = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", fold().alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 4 for r in rows)


def test_copies_do_not_starve_their_language(spark, monkeypatch):
    """80 distinct texts and 20,000 copies of another: all are taken, as they are fewer than 100."""
    monkeypatch.setattr(language, "fit", lambda sample, idf: sample)
    few = spark.range(80).selectExpr("concat('ein text ', conv(id, 10, 36), 'x') as text", "'de' as lang")
    copies = spark.range(20_000).selectExpr("'kopie' as text", "'de' as lang")
    others = spark.range(2_000).selectExpr("concat('some text ', conv(id, 10, 36), 'x') as text", "'en' as lang")
    sample = language.train(few.union(copies).union(others), per_language=100)
    assert sum(lang == "de" for _, lang in sample) == 81 and len(set(sample)) == len(sample)
    assert 60 <= sum(lang == "en" for _, lang in sample) <= 140
