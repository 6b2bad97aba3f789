import numpy as np
import pytest
from tokenizers import Tokenizer

from testfloor.llm import token_files
from testfloor.llm.queries import op10_token_counts, tokenizer_file


@pytest.mark.parametrize("id_bytes", [2, 4])
def test_blocks_are_stitched(spark, tmp_path, id_bytes):
    rng, expected, files = np.random.RandomState(1), set(), []
    streams = [rng.randint(0, 5, 200), np.full(30, 4), np.zeros(50, int), np.array([4]), np.append(rng.randint(0, 4, 90), 4), np.zeros(0, int)]
    for f, ids in enumerate(streams):
        path = str(tmp_path / f"{f}.bin")
        ids.astype(f"<u{id_bytes}").tofile(path)
        files.append((path, len(ids)))
        first = ordinal = 0
        for i, x in enumerate(ids):
            if x == 4:
                expected.add((path, ordinal, first, i - first, True))
                first, ordinal = i + 1, ordinal + 1
        if first < len(ids):
            expected.add((path, ordinal, first, len(ids) - first, False))
    table = spark.createDataFrame(files + files[:1] + [(None, 3), ("x", None)], "file string, size long")
    for block in (1, 7, 64, 1000):
        rows = token_files.counts(table, 4, block, id_bytes).collect()
        assert {tuple(r) for r in rows} == expected and len(rows) == len(expected)
    assert token_files.counts(table.limit(0), 4).count() == 0


def test_query_is_an_exact_round_trip(spark, sf):
    made = Tokenizer.from_file(tokenizer_file())
    made.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    expected = sorted((d.doc_id, len(made.encode(d.text or "", add_special_tokens=False).ids)) for d in docs)
    assert sorted(map(tuple, op10_token_counts(spark, sf).collect())) == expected
