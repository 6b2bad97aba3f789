import hashlib
import random
import re

from testfloor.llm import substrings
from testfloor.llm.queries import op5_substring_dedup


def brute(rows, window):
    words = {d: re.findall("[^\x20\x09-\x0d]+", t or "") for d, t in rows}
    least = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            least.setdefault(tuple(words[d][i : i + window]), d)
    out = set()
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.add((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in op5_substring_dedup(spark, sf).collect()} == brute(docs, 50)


def test_shared_passages_nulls_and_copies(spark):
    rng = random.Random(8)
    pick = lambda n: [rng.choice("abcdefgh") + rng.choice("éxyz") for _ in range(n)]
    passages = [pick(n) for n in (9, 10, 11, 40)]
    rows = []
    for d in range(60):
        parts = [pick(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), pick(rng.randint(0, 5))]
        rows.append((d, "\n".join(x for p in parts for x in p)))
    rows += [(100, None), (101, ""), (102, rows[3][1]), (103, rows[3][1]), (104, "one"), (105, "q " * 60)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_words int")
    out = substrings.remove(docs, window=10, seed=5)
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()}
    assert got == brute(rows, 10)
    twice = substrings.remove(docs.union(docs), window=10, seed=5).collect()
    assert len(twice) == 2 * len(rows) and {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in twice} == got
    assert substrings.remove(docs.limit(0)).count() == 0


def test_words_that_cancel_in_linear_hashes(spark):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    shared = [f"w{i}" for i in range(49)]
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([one, *shared])), (2, " ".join([other, *shared])), (3, " ".join(one)), (4, " ".join(other))]
    out = substrings.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute(rows, 50)


def test_edited_copies_of_a_long_text_null_ids_and_clashing_columns(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(30_000)]
    rows = [(0, " ".join(base)), (1, "x " * 20_000), (2, "x " * 70)]
    for d in range(3, 12):
        at = rng.randrange(len(base) - 400)
        words = base[at : at + 400]
        for _ in range(d):
            words[rng.randrange(len(words))] = "edited"
        rows.append((d, " ".join(words)))
    data = [(d, t, 7, "h", [1]) for d, t in rows] + [(None, rows[0][1], 7, "h", [1])]
    docs = spark.createDataFrame(data, "doc_id long, text string, start int, HASH string, anchors array<int>")
    out = substrings.remove(docs).collect()
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out if r.doc_id is not None}
    assert got == brute(rows, 50)
    assert [(r.n_words, r.n_removed) for r in out if r.doc_id is None] == [(30_000, 0)]
