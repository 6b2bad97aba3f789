"""Quality rules whose cutoffs come with a bound on false rejections.

Every rule rejects documents whose metric reaches a cutoff. For each stratum
and rule a fixed grid of cutoffs is tested on labelled documents: with ``n``
good documents of which ``k`` would be rejected, a cutoff is accepted if
P(Binomial(n, a) <= k) is at most delta / (number of tests), where ``a`` is the
allowed rate divided by the number of rules. By the union bounds over tests and
over rules, with probability 1 - delta every stratum loses at most the allowed
share of its good documents. The strictest accepted cutoff is used; a rule with
no accepted cutoff is off in that stratum.

The grid is a parameter and not fitted, so all labelled documents are holdouts.
Everything here is built from DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from testfloor.session import materialize

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# rule -> cutoffs from strict to lax.
DEFAULT_GRID: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4),
    "duplicate_line_share": (0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "repeated_word_share": (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45),
    "mean_word_chars": (8.0, 9.0, 10.0, 12.0, 14.0, 16.0, 20.0, 30.0),
}

# A table of cutoffs with at most so many strata (a short text and a few numbers
# each) is broadcast; a larger one is joined by Spark without a hint.
BROADCAST_STRATA = 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of characters other than space and \\t to \\r; NULL and blank texts have none."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more.

    Windows are sorted by (hash, place), so equal ones are neighbours: n log n for a text of n words.
    """

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("p")),
        )

    def places(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | (
            (i < last) & (s[F.least(i + 1, last)]["h"] == x["h"])
        )
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
        step = lambda acc, x: F.struct(
            x.alias("last"), (acc["total"] + F.least(F.lit(3), x - acc["last"])).alias("total")
        )
        return F.aggregate(p, start, step, lambda acc: acc["total"])

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    count = let(let(F.sort_array(let(hashed, windows)), places), covered)
    return F.when(F.size(words) >= 3, count).otherwise(F.lit(0).cast("long"))


def metrics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every document; NULL texts have no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), text.alias("t"))
    base = base.withColumn("w", words(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    return base.select(
        "doc_id",
        "stratum",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("own"))).alias("l"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    ).select(
        "doc_id",
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("l.all") - F.col("l.own")).cast("long").alias("n_dup_lines"),
        F.col("l.all").cast("long").alias("n_lines"),
        "n_repeat_words",
    )


def rule_values() -> dict[str, Column]:
    """The value each rule looks at; 0 where its denominator is."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "duplicate_line_share": share("n_dup_lines", "n_lines"),
        "repeated_word_share": share("n_repeat_words", "n_words"),
        "mean_word_chars": share("word_chars", "n_words"),
    }


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 8, taken back to x."""
    y = x + F.lit(8.0)
    series = (y + 0.5) * F.log(y) - y + 0.918938533204672742 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - reduce(lambda a, i: a + F.log(x + i), range(2, 9), F.log(x + 1))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k below the mean, 1 otherwise.

    Summed downwards from k until terms vanish; what is left out is added as the
    geometric series that bounds it, so the value is never too small.
    """
    k, n = k.cast("double"), n.cast("double")
    log_first = (
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    )
    odds = (1 - p) / p
    steps = F.least(k, F.ceil(F.lit(60.0) + 10 * F.sqrt(n * p))).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i + 1) / (n - k + i) * odds
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    def closed(acc: Column) -> Column:
        ratio = (k - steps) / (n - k + steps + 1) * odds
        return acc["total"] + acc["term"] * ratio / (1 - ratio)

    summed = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), start, step, closed)
    return F.when(k < n * p, F.least(F.lit(1.0), F.exp(log_first) * summed)).otherwise(F.lit(1.0))


def cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    grid: dict[str, tuple[float, ...]] = DEFAULT_GRID,
    allowed: float = 0.05,
    delta: float = 0.05,
) -> DataFrame:
    """One row per stratum with labelled documents: n_good and a cutoff (or NULL) per rule.

    ``labels`` has doc_id and quality; documents with a label of 1 are the good
    ones. Repeated rows of a document count once. Without labels the table is empty.
    """
    good = labels.filter(F.col("quality") == 1).select("doc_id").distinct()
    labelled = measured.join(good, "doc_id", "left_semi").distinct()
    values = rule_values()
    counts = labelled.groupBy("stratum").agg(
        F.count("*").alias("n_good"),
        *[F.count_if(values[r] >= c).alias(f"{r}:{j}") for r in grid for j, c in enumerate(grid[r])],
    )
    counts = materialize(counts, "label-counts")
    tests = counts.count() * sum(map(len, grid.values()))
    limit, rate = delta / max(tests, 1), allowed / len(grid)
    chosen = [
        F.coalesce(
            *[
                F.when(binomial_tail(F.col(f"`{r}:{j}`"), F.col("n_good"), rate) <= limit, F.lit(c))
                for j, c in enumerate(grid[r])
            ]
        ).alias(f"cut_{r}")
        for r in grid
    ]
    return materialize(counts.select("stratum", "n_good", *chosen), "cutoffs")


def judge(measured: DataFrame, cuts: DataFrame, grid: dict[str, tuple[float, ...]] = DEFAULT_GRID) -> DataFrame:
    """``measured`` with ``rejected_by``: the rules whose cutoff a document reaches."""
    small = cuts.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    joined = measured.join(F.broadcast(cuts) if small else cuts, "stratum", "left")
    values = rule_values()
    hit = [F.when(values[r] >= F.col(f"cut_{r}"), F.lit(r)) for r in grid]
    return joined.withColumn("rejected_by", F.array_compact(F.array(*hit)))
