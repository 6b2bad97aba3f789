import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from testfloor.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return [x.translate(UPPER) for x in TERM.findall(text or "")]


def brute(docs, items, k=50):
    held = [(d, Counter(words(t))) for d, t in docs if words(t)]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item_id, text in {(i, t) for i, t in items}:
        scored = []
        for doc_id, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m))
                for w in set(words(text))
                if w in c
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r + 1, None if absent else d, -s) for r, (s, absent, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n, vocabulary, longest=40):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    pick = lambda m: " ".join(names[min(int(rng.expovariate(4 / vocabulary)), vocabulary - 1)] for _ in range(m))
    docs = [(i, pick(rng.randrange(longest))) for i in range(n)]
    return docs, [(i, pick(rng.randrange(1, 15))) for i in range(12)]


DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


@pytest.mark.parametrize("seed, n, vocabulary, k, chunk", [(1, 900, 30, 5, 1 << 18), (2, 900, 400, 50, 20), (3, 60, 5, 50, 1 << 18)])
def test_equals_the_definition(spark, monkeypatch, seed, n, vocabulary, k, chunk):
    docs, items = corpus(seed, n, vocabulary)
    docs += docs[:40]  # repeated rows are documents, and tie
    found = ranked_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k, chunk)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items, k)


def test_odd_rows(spark):
    docs, items = corpus(4, 60, 20)
    docs += [(None, "w1 w2"), (None, None), (7, None), (8, ""), (9, " .,;\n"), (10, "ÄÖ w1 w2 İ W1-w2"), (11, "w3 " * 300_000 + "W1")]
    items += [(3, "w1 W2"), (3, "w1 W2"), (3, "w5"), (None, "w1"), (50, None), (51, "..."), (52, "äö ÄÖ"), (53, "nowhere")]
    tables = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as n", "2 as item_id"), spark.createDataFrame(items, ITEMS).selectExpr("*", "3 as doc_id")
    found = ranked_search.search(*tables)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items)
    assert ranked_search.search(tables[0].limit(0), tables[1]).count() == 0
    assert ranked_search.search(tables[0], tables[1].limit(0)).count() == 0


def test_blocks_give_the_same(monkeypatch):
    """Small blocks, leaves and steps in the task function itself, against the same with one block."""
    import pyarrow as pa

    docs, items = corpus(5, 700, 60)
    vocabulary = {w.encode(): i for i, w in enumerate(sorted({w for _, t in items for w in words(t)}))}
    raw = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t.encode() for _, t in docs])], names=["doc_id", "text"])
    (counted,) = ranked_search._counted(vocabulary)([raw])
    vectors = [np.array(sorted({vocabulary[w.encode()] for w in words(t)}), np.int64) for _, t in items]
    weights = np.random.RandomState(1).randint(0, 5000, len(vocabulary))
    n, length = counted.num_rows, sum(counted.column(1).to_pylist())

    def found(block, leaf, wide):
        for name, value in (("BLOCK_POSTINGS", block), ("LEAF", leaf), ("WIDE", wide)):
            monkeypatch.setattr(ranked_search, name, value)
        parts = [counted.slice(i, 90) for i in range(0, counted.num_rows, 90)]
        return [b.to_pydict() for b in ranked_search._searched(vectors, weights, n, length, 10)(iter(parts))]

    expected = found(1 << 30, 1 << 30, 1)  # one leaf: every document is scored
    assert expected and found(1 << 30, 1, 1) == expected
    assert found(200, 3, 4) == expected and found(1000, 8, 64) == expected


def test_bounds_leave_documents_unscored():
    rng = np.random.RandomState(3)
    n = 20_000
    docs, found = np.repeat(np.arange(n), 3), rng.randint(0, 50, 3 * n)
    keep = np.unique(docs * 50 + found)
    docs, found = keep // 50, keep % 50
    quotients = rng.randint(1, 1000, len(docs))
    strong = np.isin(docs, [17, 19_000]) & (found < 50)
    quotients[strong] = 900_000
    index = ranked_search.Index(docs, found, quotients, n)
    scored = []
    plain = index.scores
    index.scores = lambda w, a, b: scored.append(int((b - a).sum())) or plain(w, a, b)
    weights = np.zeros(50, np.int64)
    item = np.unique(found[np.isin(docs, [17, 19_000])])
    weights[item] = 7
    rows, _ = index.search(item, weights, 1, 0)
    exact = np.bincount(docs, weights[found] * quotients)
    assert set(np.flatnonzero(exact == exact.max())) <= set(rows) and sum(scored) < n // 10
