"""Language ID: sparse multinomial logistic regression on character n-grams.

Features are TF-IDF weights of hashed 1- to 3-grams of lower-cased letters (runs of
other characters count as one space). The model is trained by
follow-the-regularised-leader with L1 and L2 penalties, then its scores are
calibrated with a temperature fitted on labelled texts left out of training.

Document frequencies count all labelled documents. The model itself is fitted on
a bounded sample: at most about ``per_language`` documents of each language and
``MAX_SAMPLE`` in all, distinct and chosen by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BUCKETS = 1 << 15
MAX_SAMPLE = 20_000
_U = np.uint64


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str, buckets: int = BUCKETS, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text and their counts."""
    total = np.zeros(buckets, np.int64)
    for at in range(0, max(len(text), 1), block):
        piece = text[at : at + block].lower()
        joined = " ".join("".join(c if c.isalpha() else " " for c in piece).split())
        joined = f" {joined} "
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
        value = np.zeros(len(codes), _U)
        for n in (1, 2, 3):
            if len(codes) < n:
                break
            value = value[: len(codes) - n + 1] * _U(0x9E3779B97F4A7C15) + codes[n - 1 :] + _U(n)
            spread = (value ^ (value >> _U(29))) * _U(0xBF58476D1CE4E5B9)
            total += np.bincount((spread >> _U(40)).astype(np.int64) % buckets, minlength=buckets)
    found = np.flatnonzero(total)
    return found, total[found]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            seen[grams(text.as_py() or "")[0]] += 1
            rows += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(seen[at], rows), pa.int64())], names=["bucket", "n"]
    )


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x (buckets + 1), the last for the bias
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = grams(text)
        x = (1 + np.log(n)) * self.idf[at]
        norm = float(np.sqrt(x @ x)) or 1.0
        return np.append(at, BUCKETS), np.append(x / norm, 1.0)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ x

    def predict(self, text: str) -> tuple[str, float]:
        p = softmax(self.logits(*self.features(text)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(p[best], 1.0))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(
    sample: list[tuple[str, str]],
    idf: np.ndarray,
    passes: int = 3,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 0.001,
    l2: float = 0.01,
) -> Model:
    """Follow the regularised leader over (text, language) rows; every fifth row calibrates."""
    languages = sorted({lang for _, lang in sample})
    index = {lang: i for i, lang in enumerate(languages)}
    model = Model(languages, idf, np.zeros((len(languages), BUCKETS + 1)))
    rows = [(*model.features(text), index[lang]) for text, lang in sample]
    train = [r for i, r in enumerate(rows) if i % 5] or rows
    held = rows[::5]
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for turn in range(passes):
        order = np.random.RandomState(turn).permutation(len(train))
        for i in order:
            at, x, y = train[i]
            zi, ni = z[:, at], n[:, at]
            shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1, 0)
            w = -shrunk / ((beta + np.sqrt(ni)) / alpha + l2)
            p = softmax(w @ x)
            p[y] -= 1
            g = p[:, None] * x[None, :]
            grown = ni + g * g
            z[:, at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[:, at] = grown
    shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
    model.weights = -shrunk / ((beta + np.sqrt(n)) / alpha + l2)
    logits = np.array([model.logits(at, x) for at, x, _ in held])
    wanted = np.array([y for *_, y in held])

    def loss(t: float) -> float:
        p = softmax(logits / t)[np.arange(len(wanted)), wanted]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    model.temperature = min((float(t) for t in np.geomspace(0.05, 10, 60)), key=loss)
    return model


def train(labelled: DataFrame, per_language: int = 500) -> Model | None:
    """A model from the rows of ``labelled`` (text, lang); None if none has a text and a language.

    Rows without text, letters or language are not used. Repeated rows count repeatedly in the frequencies and once
    in the sample and in the shares it is drawn by, so a large group of copies neither fills it nor starves it.
    """
    rows = labelled.select("text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count()
    # Languages with fewer texts are taken whole, others in proportion.
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count"))
    drawn = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000
    some = rows.join(counts, "lang").filter(drawn).select("text", "lang").distinct().orderBy(F.xxhash64("text"), "lang").limit(MAX_SAMPLE)
    sample = [(r["text"], r["lang"]) for r in some.select("text", "lang").toLocalIterator()]
    if not sample:
        return None
    seen = rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {r["bucket"]: r["n"] for r in seen.collect()}  # at most BUCKETS + 1 rows
    total = found.pop(-1, 0)
    idf = np.full(BUCKETS, np.log(1.0 + total) + 1.0)
    for bucket, n in found.items():
        idf[bucket] = np.log((1.0 + total) / (1.0 + n)) + 1.0
    return fit(sample, idf)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score (columns of those names are replaced).

    A NULL text, one without a letter, and every text if there is no model, is ``und`` with score 0.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x BUCKETS numbers
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    at = [c.lower() for c in kept].index("text")
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = []
            for value in batch.column(at):
                text = value.as_py()
                found.append(own.predict(text) if own is not None and has_letter(text) else ("und", 0.0))
            names, scores = [f[0] for f in found], [f[1] for f in found]
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(run, schema)
