import os
import random

import pytest
import tiktoken

from tessela.llm import tokens

FILE = os.path.join(tokens.FOLDER, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary")
OWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def ranks():
    with open(FILE, "rb") as f:
        return tokens.read_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=OWN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def made(seed):
    rnd = random.Random(seed)
    parts = ["the", "Harbour", " ", "  ", "   ", "\n", "\r\n", "\n\n ", "\t", "'s", "'", "don't", "12", "3,456", "é", "é", "日本語", "😀", " ", "​", "\x1f", "\x0b", "　", "<|endoftext|>", "--", "—", "[[x|y]]", "{{a}}", "a" * 40, "...", "Q"]
    return "".join(rnd.choice(parts) for _ in range(rnd.randrange(60)))


def test_random_texts_equal_the_library(ranks, reference):
    import numpy as np

    encoder = tokens.Encoder(ranks)
    for text in ["", " ", "\n", "a b", " a", "a ", "a  b", "a \n b", *map(made, range(2500))]:
        assert np.frombuffer(encoder(text), "<i4").tolist() == reference(text), repr(text)


def test_tables(spark, ranks, reference, monkeypatch):
    monkeypatch.setattr(tokens, "_KEPT", 50)
    texts = [None, "", " ", "lol " * 5000, "x" * 20_000, *map(made, range(40)), made(3)]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = tokens.encode(df)
    assert encoded.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {i: reference(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in tokens.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.encode(df.limit(0)).count() == 0
    assert tokens.token_counts(encoded).selectExpr("sum(n)").first()[0] == sum(map(len, got.values()))


def test_small_tables_are_spread_and_large_ones_stay(spark, tmp_path):
    from tessela.llm.batches import spread

    spark.range(100).selectExpr("id AS doc_id", "cast(id AS string) AS text").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    wide = spread(df)
    assert wide.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(wide.collect()) == sorted(df.collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    try:
        assert spread(df) is df
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
