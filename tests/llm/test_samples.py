"""Samples for fitting are bounded in rows, however often an id occurs."""

from pyspark.sql import functions as F

from test_operators import DOC_SCHEMA, _corpus
from tickwise.llm import decontaminate, quality


def _hot(df, key, n):
    """``df`` with ``n`` further rows of one id, half of them equal."""
    same = df.sparkSession.range(n // 2).select(F.lit(key).cast("long"), F.lit("vile ka ro"), F.lit("en"), F.lit("s0"), F.lit(9).cast("long"))
    own = df.sparkSession.range(n // 2).select(F.lit(key).cast("long"), F.concat(F.lit("baka loro w"), "id"), F.lit("en"), F.lit("s0"), F.lit(9).cast("long"))
    return df.unionAll(same).unionAll(own).repartition(7)


def test_quality_sample_of_a_hot_id(spark, monkeypatch):
    docs, labels = _corpus()
    df = _hot(spark.createDataFrame(docs, DOC_SCHEMA), 5, 4_000)
    table = spark.createDataFrame([x for x in labels if x[0] != 5] + [(5, 1, 0)], "doc_id long, quality int, toxic int")
    sizes, fit = [], quality.co_train
    monkeypatch.setattr(quality, "co_train", lambda text, meta, bad, *rest: sizes.append((len(bad), int((bad >= 0).sum()))) or fit(text, meta, bad, *rest))
    model = quality.fit(df, table, labelled=450, pool=100)
    # 400 labelled ids, each of them in the sample, and 50 more rows of the hot one.
    assert sizes == [(550, 450)]
    got = {r.doc_id: r.kept for r in quality.score(df.where("doc_id <> 5"), model).collect()}
    unseen = [i for i in range(len(docs)) if i % 3 == 1]
    assert sum(got[i] == (i % 5 != 0) for i in unseen) >= 0.97 * len(unseen)


def test_decontamination_sample_of_a_hot_null_id(spark, monkeypatch):
    docs, _ = _corpus(4, 200)
    df = _hot(spark.createDataFrame(docs, DOC_SCHEMA), None, 2_000)
    seen, basis = [], decontaminate.randomised_basis

    def spy(rows, idf, vocabulary, rank):
        seen.append((rows.count(), vocabulary.tolist()))
        return basis(rows, idf, vocabulary, rank)

    monkeypatch.setattr(decontaminate, "randomised_basis", spy)
    item = [(1, "these are the words of an item that nobody has written yet")]
    for part in (df, df.repartition(3)):
        decontaminate.build_index(part, item, sample_docs=40, rank=8)
    assert seen[0][0] <= 1 + 3 * 40 and seen[0] == seen[1]


def test_benchmark_is_read_in_ranges(spark, monkeypatch):
    texts = {i: " ".join(f"i{i}w{j}" for j in range(12)) for i in range(9)}
    docs = spark.createDataFrame([(100 + i, f"before it {t} and after it") for i, t in texts.items()] + [(1, "nothing here")], "doc_id long, text string")
    rows = [*texts.items(), *texts.items(), (3, None), (None, texts[4]), (20, "")]
    bench = spark.createDataFrame(rows, "item_id long, text string").repartition(5)
    items, total = decontaminate.numbered(bench)
    want = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r))
    assert total == 11 and [(r.item_id, r.text) for r in items.orderBy("n").collect()] == want
    assert [r.n for r in items.orderBy("n").collect()] == list(range(11))
    sizes, build = [], decontaminate.build_index
    monkeypatch.setattr(decontaminate, "build_index", lambda d, own, *rest: sizes.append(len(own)) or build(d, own, *rest))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, item_rows=4).collect()}
    assert sizes == [4, 4, 3] and got == {(100 + i, i) for i in texts} | {(104, None)}
