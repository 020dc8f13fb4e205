"""The latent basis of op 8 and the pipeline is fitted on every passage of every document."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickwise.llm import decontaminate
from tickwise.llm.words import PUNCTUATION, split_words

ITEMS = [(1, "these are the words of an item that nobody has written yet"), (2, "ka ro mi tu sel vo")]


def _documents(spark, n):
    body = F.concat(F.lit("own"), "id", F.lit(" ka ro "), F.expr("concat_ws(' ', transform(sequence(0, 60 + id % 50), i -> concat('w', (i * 7 + id * id) % 97)))"))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 != 7, body).alias("text")).repartition(5)


def _terms(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return decontaminate._terms(split_words(data, np.array([0, len(data)]), True, PUNCTUATION).hashes)


def test_every_document_and_passage_is_in_the_fit(spark, monkeypatch):
    docs = _documents(spark, 600)
    texts = [r.text for r in docs.collect() if r.text]
    fits, basis = [], decontaminate.randomised_basis
    monkeypatch.setattr(decontaminate, "randomised_basis", lambda *a: fits.append((a, basis(*a))) or fits[-1][1].copy())
    index = decontaminate.build_index(docs, ITEMS, rank=12)
    assert all((index.place[_terms(t)] >= 0).all() for t in texts)
    (_, idf, vocabulary, rank), got = fits[0]
    # The matrix written out: items, and passages that weigh CORPUS_ROWS rows together.
    passages = [t[k : k + 48] for t in map(_terms, texts) for k in range(0, len(t), 48)]
    rows = [(_terms(t), 4.0) for _, t in ITEMS] + [(p, min(1, decontaminate.CORPUS_ROWS / len(passages)) ** 0.5) for p in passages]
    assert len(passages) > decontaminate.CORPUS_ROWS
    a = np.zeros((len(rows), len(vocabulary)))
    for row, (t, weight) in zip(a, rows):
        v = idf[t].astype(float)
        np.add.at(row, np.searchsorted(vocabulary, t), v * weight / np.sqrt((v * v).sum()))
    assert np.allclose(got.T @ got, np.eye(rank), atol=1e-3)
    best = (np.linalg.svd(a, compute_uv=False)[:rank] ** 2).sum()
    assert 0.95 * best < ((a @ got) ** 2).sum() <= 1.001 * best


def test_counts_of_blocks(spark):
    docs = _documents(spark, 40)
    counts = decontaminate.frequencies(docs)
    texts = [_terms(r.text) for r in docs.collect() if r.text]
    blocks = [t[k : k + 16] for t in texts for k in range(0, len(t), 16)]
    want = np.zeros(decontaminate.TERMS, int)
    for b in blocks:
        want[np.unique(b)] += 1
    assert (counts.n == want).all() and counts.blocks == len(blocks) and counts.passages == sum(-(-len(t) // 48) for t in texts)


def test_documents_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " .. ")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.leaks(docs, bench).count() == 0 and decontaminate.without_leaks(docs, bench).count() == 3
    same = docs.unionAll(spark.createDataFrame([(4, ITEMS[0][1])], docs.schema))
    assert [r.doc_id for r in decontaminate.leaks(same, bench).collect()] == [4]


def test_matrix_is_halved_and_turned_in_its_own_memory(monkeypatch):
    monkeypatch.setattr(decontaminate, "TERM_CHUNK", 7)
    rng = np.random.default_rng(4)
    y, by = rng.normal(size=(45, 10)).astype(np.float32), rng.normal(size=(10, 6)).astype(np.float32)
    want = y @ by
    turned = decontaminate._turned(y, by)
    assert np.shares_memory(turned, y) and np.allclose(turned, want, atol=1e-5)
    rounded = turned.astype(np.float16)
    half = decontaminate._halved(turned)
    assert np.shares_memory(half, y) and half.dtype == np.float16 and (half == rounded).all()
    decontaminate._widened(half, turned)
    assert (turned == rounded.astype(np.float32)).all()


def test_a_pass_reads_the_texts_once(spark, monkeypatch):
    frame = type(spark.range(0))
    plans, summed = [], frame.toLocalIterator
    monkeypatch.setattr(frame, "toLocalIterator", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or summed(df, *a))
    assert decontaminate.build_index(_documents(spark, 40), ITEMS) is not None
    # Items and documents, one map over both.
    assert len(plans) == 2 and all(p.count("MapInArrow") == 1 for p in plans)


def test_search_answers_batches_in_order(spark):
    docs = _documents(spark, 60).coalesce(1)
    held = docs.withColumn("text", F.expr(f"CASE WHEN doc_id % 3 = 0 THEN concat(text, ' ', '{ITEMS[0][1]}') ELSE text END"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    hit = {r.doc_id for r in held.where("text IS NOT NULL AND doc_id % 3 = 0").collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        kept = [r.doc_id for r in decontaminate.without_leaks(held, bench).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(kept) == [i for i in range(60) if i not in hit]


def test_the_fit_hands_over_small_batches_and_restores_the_session(spark, monkeypatch):
    conf, sizes, basis = "spark.sql.execution.arrow.maxRecordsPerBatch", [], decontaminate.randomised_basis

    def spy(table, *rest):
        def count(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

        sizes.extend(r.n for r in table.mapInArrow(count, "n long").collect())
        return basis(table, *rest)

    monkeypatch.setattr(decontaminate, "randomised_basis", spy)
    before = spark.conf.get(conf)
    decontaminate.build_index(_documents(spark, 1_500).coalesce(1), ITEMS, rank=4)
    assert 0 < max(sizes) <= decontaminate.ROWS_AT_ONCE and sum(sizes) == 1_502
    assert spark.conf.get(conf) == before
