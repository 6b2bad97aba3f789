import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from testfloor.llm import packing
from testfloor.llm.queries import op2_packing, tokenizer_file


def test_knapsack_equals_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        n, capacity = rng.randint(1, 6), rng.randint(1, 12)
        prices = np.array([rng.choice([0, rng.random()]) for _ in range(n)])
        best = [0.0] * (capacity + 1)
        for c in range(1, capacity + 1):
            best[c] = max([best[c - 1], *[best[c - s - 1] + prices[s] for s in range(min(n, c))]])
        value, pattern = packing.knapsack(prices, capacity)
        assert abs(value - best[capacity]) < 1e-9 and abs(pattern @ prices - value) < 1e-9
        assert pattern @ np.arange(1, n + 1) <= capacity


def test_plan_places_everything_with_little_padding():
    rng = np.random.RandomState(4)
    for demand in (rng.randint(0, 400, 256), np.eye(256, dtype=int)[200] * 99, np.zeros(256, int), rng.randint(0, 3, 256)):
        out = packing.plan(demand, 256)
        assert (sum((p * t for p, t in out), np.zeros(256, int)) == demand).all()
        assert all(p @ np.arange(1, 257) <= 256 and t > 0 for p, t in out)
    demand = rng.randint(0, 400, 256)
    used = sum(t for _, t in packing.plan(demand, 256))
    patterns, times = packing.solve(demand, 256)
    assert np.allclose(patterns.T @ times, demand)
    assert demand @ np.arange(1, 257) / 256 <= times.sum() + 1e-6  # no packing is below the volume
    assert used <= 1.01 * times.sum() + 5  # nor is rounding far above the fractional optimum


def test_query_is_an_exact_round_trip(spark, sf):
    rows = op2_packing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    tokenizer = Tokenizer.from_file(tokenizer_file())
    tokenizer.encode_special_tokens = True
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(docs)
    for d in docs:
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.array(ids[at : at + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids)
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and all(r.seq_length == at for r in group)
    tokens = sum(r.length for r in rows)
    print("sequences", len(by_sequence), "padding", 1 - tokens / (2048 * len(by_sequence)))


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string, offset string, length int"
    docs = spark.createDataFrame([(1, None, "x", 9), (2, "a b", "x", 9), (2, "a b", "x", 9), (None, "c", None, None)], schema)
    cut = packing.pieces(docs, tokenizer_file(), 1)
    out = packing.assign(cut, rank_rows=2).orderBy("sequence_id", "offset").collect()
    assert [r.offset for r in out] == [0, *np.cumsum([r.length for r in out])[:-1].tolist()]
    assert sorted(map(len, (r.ids for r in out))) == sorted(r.length for r in out)
    assert len(out) == 4 and {r.sequence_id for r in out} == {0}
    assert packing.assign(packing.pieces(docs.limit(0), tokenizer_file(), 1)).count() == 0


def test_ids_equal_the_tokenizers_library(sf):
    made = packing.Encoder(tokenizer_file())
    assert made.plain
    rng = random.Random(3)
    alphabet = "aZ9'.,-!$ \t\n\r éÀß¼²ªж中 　\x1c\x85​'srevtmld<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(20_000)]
    texts += ["", "a" * 5000, " " * 5000, "<|endoftext|>"]
    texts += [t or "" for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()]
    for text in texts:
        assert made.ids(text) == made.made.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("part", [" ", "\t", " \t", "a", "7", "!", " b"])
def test_long_runs_of_one_kind(spark, part):
    """A million characters of one kind, alone and before a letter, have the ids of the library."""
    made = packing.Encoder(tokenizer_file())
    long = part * (1_000_000 // len(part))
    for text in (long, long + "x"):
        ids = made.ids(text)
        assert ids == made.made.encode(text, add_special_tokens=False).ids
    if part == " ":
        docs = spark.createDataFrame([(1, long), (2, "word" + " " * packing.LONG_SPACE + "word"), (3, None)], "doc_id long, text string")
        cut = packing.pieces(docs, tokenizer_file(), 1, 2048, with_ids=False).groupBy("doc_id").sum("length").collect()
        assert {r[0]: r[1] for r in cut}[3] == 1 and len(cut) == 3
