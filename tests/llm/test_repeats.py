"""A third of the rows may be one row, or blank, without meeting in one task or one shard."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tickwise.llm import neardup, sharding

COLUMNS = "doc_id long, text string"


def test_repeated_rows_spread_over_shards(spark):
    one = spark.range(6_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    df = one.unionAll(spark.range(3_000).select(F.lit(7).cast("long"), F.lit("the same long text"))).unionAll(
        spark.range(3_000).select(F.lit(None).cast("long"), F.lit(None).cast("string"))
    )
    got = sharding.shard_documents(df, 20, slots=4096).collect()
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(got) == 12_000 and len(load) == 20
    assert max(load.values()) <= 1.06 * sum(load.values()) / 20
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    blank = Counter(r.shard for r in got if r.text is None)
    assert sum(blank.values()) == 3_000 and max(blank.values()) <= 600


def test_near_dedup_passes_blank_and_repeated_rows_through_no_single_task(spark):
    blanks = [(None, None), (None, ""), (3, " \t\n"), (3, None)] * 500
    rows = [(i, f"w{i} x{i} y{i} z{i} v{i} u{i} t{i}") for i in range(300)] + [(500, "a b c d e f g h")] * 700
    out = neardup.without_near_duplicates(spark.createDataFrame(blanks + rows, COLUMNS).repartition(6))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(blanks) + Counter(set(rows))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
