"""Texts become Python objects few at a time, however large the Arrow batch is."""

import pyarrow as pa
import pytest

from quernstone.llm import bpe, queries, simhash
from quernstone.llm.store import ROWS, sliced


class Batch:
    """An Arrow batch that can only be cut."""

    def __init__(self, values):
        self.values, self.most = pa.array(values), 0

    def __len__(self):
        return len(self.values)

    def slice(self, at, rows):
        self.most = max(self.most, rows)
        return self.values.slice(at, rows)


@pytest.fixture
def functions(monkeypatch):
    """The functions that arrow_udf is given."""
    found = []
    monkeypatch.setattr("pyspark.sql.functions.arrow_udf", lambda kind: lambda f: found.append(f) or (lambda column: column))
    return found


def test_texts_are_read_few_at_a_time(spark, functions):
    texts = [None, "", *(f"word{i} and others" for i in range(2 * ROWS))]
    simhash.fingerprint("text")
    codec = bpe.ByteBPE(spark, queries.tokenizer_path())
    codec.encode("text"), codec.round_trip("text")
    assert len(functions) == 3
    for f in functions:
        batch = Batch(texts)
        out = list(f(iter([batch, batch])))
        assert batch.most == ROWS and max(map(len, out)) <= ROWS and sum(map(len, out)) == 2 * len(texts)


def test_slices_are_the_batches():
    batch = pa.RecordBatch.from_pydict({"a": list(range(10))})
    assert [p.column(0).to_pylist() for p in sliced([batch, batch.slice(0, 0), batch.slice(8)], 4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], [8, 9]]
