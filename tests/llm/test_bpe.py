import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quernstone.llm import bpe, queries


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def vocabulary():
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def test_same_ids_as_the_library(library, vocabulary):
    rng = random.Random(1)
    letters = "abc eé  \n\t  '1٣中𝕏😀<|endoftext|>\x1c\x85​!?sdt"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["a" * 5000, "aaa" * 7 + "b", "", " ", "<|endoftext|>x <|endoftext|>", "it's we'll  x   \n\n y", "ab" * 3000]
    for text, ids, want in zip(texts, vocabulary.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert vocabulary.decode(ids) == library.decode(want.ids, skip_special_tokens=False) == text


def test_columns_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None, 1), ("a b", "x", None), ("", "", 2), ("a b", "x", None)], "text string, _f string, doc_id long")
    out = bpe.tokenize(df, queries.tokenizer_path(), decoded="again")
    rows = [(r["doc_id"], r["_f"], len(r["ids"]) // 4, r["again"]) for r in out.collect()]
    assert sorted(rows, key=str) == sorted([(1, None, 0, ""), (None, "x", 2, "a b"), (2, "", 0, ""), (None, "x", 2, "a b")], key=str)
    assert bpe.tokenize(df.limit(0), queries.tokenizer_path()).count() == 0
    assert out.select(bpe.n_tokens("ids").alias("n")).agg(F.sum("n")).first()[0] == 4


def test_query(spark, folder, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op7_bpe(spark, folder).collect():
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
