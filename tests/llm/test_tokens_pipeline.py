"""Token counts against the library, and the pipeline as a whole."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickwise.llm import mixing, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    whole = tokenizers.Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(PATH)


def _texts(n, seed=1):
    rng = random.Random(seed)
    parts = [*" \n\t'stredlmv aA1!é½中  \x1c_-<|>", "<|endoftext|>", "'ll", "the", "ing", " token"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(n)]


def test_transducer_equals_the_library(counter, library):
    texts = ["", "Hello's world  \n\n  x", "日本語テスト½²①٣", "é" * 300, "a" * 5_000, "!?'s ' s", *_texts(3_000)]
    assert [counter.tokens(t) for t in texts] == library(texts)


def test_chunk_maps_compose(counter):
    rng = random.Random(2)
    for text in _texts(1_500, 4):
        text = text.replace("<|endoftext|>", "")
        size = rng.randint(1, 9)
        chunks = [text[i : i + size] for i in range(0, len(text), size)]
        if chunks:
            assert counter.scan([counter.chunk_map(c) for c in chunks]) == counter.tokens(text)


def test_count_tokens(spark, library):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "the " * 5_000), (3, "the " * 5_000), (4, "x" * 3_000), (5, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("?"))
    got = token_counts.count_tokens(df, PATH, chunk_chars=700)
    counts = library([t or "" for _, t in rows])
    want = [(d, len((t or "").encode()), n, n > 1024) for (d, t), n in zip(rows, counts)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0


def test_pipeline_stages(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").withColumn("row", F.lit(1)).withColumn("copies", F.lit("c"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, source).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == (columns if k < 4 else [*columns, "shard", "slot"])
        if k < 3:
            assert docs.exceptAll(before).isEmpty() and docs.count() > 0
        elif name == "mix":
            words = lambda d: d.agg(F.sum(mixing.n_words(F.col("text")))).first()[0]
            assert words(docs) == pytest.approx(1.5 * words(before), rel=0.2)
        else:
            assert docs.count() == before.count()


def test_pipeline_on_empty_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0
