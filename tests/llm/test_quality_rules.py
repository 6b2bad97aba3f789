import math

from pyspark.sql import functions as F

from testfloor.llm import quality_rules as q


def tail(k, n, p):
    """P(Binomial(n, p) <= k), summed plainly."""
    logs = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k + 1))
    return min(1.0, math.fsum(math.exp(x) for x in logs))


def measured(spark):
    rows = spark.range(10_000).withColumnRenamed("id", "doc_id")
    counts = "100L n_words, 500L word_chars, doc_id * 7919 % 311 n_symbols, doc_id * 31 % 41 n_dup_lines, 100L n_lines, doc_id * 17 % 73 n_repeat_words"
    return rows.selectExpr("doc_id", "if(doc_id % 2 = 0, 'a', 'b') stratum", *counts.split(", "))


def test_cutoffs_equal_exact_sums_and_repeats_count_once(spark):
    docs = measured(spark)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    rows = [r.asDict() for r in docs.select("stratum", *[v.alias(n) for n, v in q.rule_values().items()]).collect()]
    grid, allowed, delta = q.DEFAULT_GRID, 0.05, 0.05
    tests, rate = 2 * sum(map(len, grid.values())), allowed / len(grid)
    want = {}
    for s in "ab":
        own = [r for r in rows if r["stratum"] == s]
        cuts = []
        for rule, values in grid.items():
            ok = [c for c in values if (k := sum(r[rule] >= c for r in own)) < len(own) * rate and tail(k, len(own), rate) <= delta / tests]
            cuts.append(ok[0] if ok else None)
        want[s] = (len(own), *cuts)
    assert any(c is not None for row in want.values() for c in row[1:])
    for d in (docs, docs.union(docs)):
        assert {r[0]: tuple(r[1:]) for r in q.cutoffs(d, labels).collect()} == want


def test_empty_and_null_labels(spark):
    docs = measured(spark)
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert q.cutoffs(docs, none).count() == 0
    assert q.judge(docs, q.cutoffs(docs, none)).filter("size(rejected_by) > 0").count() == 0
    assert q.cutoffs(docs.limit(0), none).count() == 0
