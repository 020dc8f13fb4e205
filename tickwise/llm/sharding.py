"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual`` points of a ring. The ring is cut into a fixed number of slots,
finer than its points, and a document belongs to the slot that a hash of its key falls into.
Slots are placed in a fixed order of their own hashes: a slot goes to the shard that owns the
next point clockwise, and where that shard has reached its bound, on to the next point of a
shard that has room. The bound is ``1 + slack`` times the mean, so no shard exceeds it by more
than one slot; a further shard takes over about its share of the slots and what overflowed
because of them, and leaves the rest in place.

Only the slots' byte counts reach the driver, a number that is fixed by ``slots`` and does not
grow with the data. Documents find their shard by a join with that table.

The key is the document's id with its text, so repeated ids with different texts spread. A slot
that holds more than ``HEAVY`` of a shard's share, because rows repeat, is dealt into parts that
have places of their own on the ring. A null text has no bytes. Slots with equal hashes do not
exist; rows that repeat lie next to each other within a part.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwise.session import staged

SHARDS = 40
VIRTUAL = 128
SLOTS = 1 << 16
SLACK = 0.002
ROW_BYTES = 16
HEAVY = 0.05


def _point(name: str) -> int:
    return int.from_bytes(hashlib.md5(name.encode()).digest()[:8], "big")


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[list[int], list[int]]:
    """(points in order, the shard that owns each)."""
    pairs = sorted((_point(f"shard {s} point {v}"), s) for s in range(shards) for v in range(virtual))
    return [p for p, _ in pairs], [s for _, s in pairs]


def place_slots(
    loads: Sequence[int], shards: int = SHARDS, virtual: int = VIRTUAL, slack: float = SLACK, more: Sequence[tuple[int, int]] = ()
) -> list[int]:
    """The shard of each slot. A slot's place on the ring is its number's share of the circle.

    The last loads may be those of ``more``, (slot, part) pairs with a place by hash.
    """
    slots = len(loads) - len(more)
    places = [(slot << 64) // slots for slot in range(slots)] + [_point(f"slot {slot} part {part}") for slot, part in more]
    points, owners = ring(shards, virtual)
    bound = (1 + slack) * sum(loads) / shards
    load = [0] * shards
    placed = [0] * len(loads)
    # Heavy slots first: those that come late and overflow are light, which keeps bounds tight.
    for slot in sorted(range(len(loads)), key=lambda i: (-loads[i].bit_length(), _point(f"slot {i}"))):
        at = bisect_left(points, places[slot]) % len(points)
        for step in range(len(points)):
            shard = owners[(at + step) % len(points)]
            if load[shard] + loads[slot] <= bound:
                break
        else:
            shard = min(range(shards), key=lambda s: (load[s], s))
        load[shard] += loads[slot]
        placed[slot] = shard
    return placed


def _slot(key_cols: Sequence[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in key_cols]), F.lit(slots)).cast("int")


def _parts(found: Sequence, shards: int) -> list[tuple[int, int]]:
    """(slot, parts) of the slots of several rows that hold more than ``HEAVY`` of a shard's bytes or rows."""
    most = [max(1.0, HEAVY * sum(r[c] for r in found) / shards) for c in ("b", "n")]
    parts = [(r["_slot"], min(r["n"], max(ceil(r["b"] / most[0]), ceil(r["n"] / most[1])))) for r in found]
    return [(slot, k) for slot, k in parts if k > 1]


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, text_col: str = "text", key_cols: Sequence[str] = ("doc_id", "text"),
    virtual: int = VIRTUAL, slots: int = SLOTS, slack: float = SLACK, size: Column | None = None,
) -> DataFrame:
    """``docs`` with size (UTF-8 bytes and 16), shard and slot, a gapless number in its shard.

    ``size`` may give the bytes where the text itself is not carried along. Columns of these
    three names are replaced.
    """
    docs = docs.drop("size", "shard", "slot")
    if slots & (slots - 1):
        raise ValueError("slots must be a power of two")
    spark = docs.sparkSession
    if size is None:
        size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0))
    size = size.cast("long") + ROW_BYTES
    sized = docs.withColumns({"size": size, "_slot": _slot(key_cols, slots), "_part": F.lit(0)})
    measures = [F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")]
    found = sized.groupBy("_slot", "_part").agg(*measures).collect()
    cut = _parts(found, shards)
    if cut:
        # Equal rows differ in their place only, so what part they got is written down.
        dealt = F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int")
        wide = sized.drop("_part").join(F.broadcast(spark.createDataFrame(cut, "_slot int, _parts int")), "_slot", "left")
        sized = staged(wide.withColumn("_part", F.coalesce(dealt, F.lit(0))).drop("_parts"), "sized")
        found = sized.groupBy("_slot", "_part").agg(*measures).collect()
    units = [(slot, 0) for slot in range(slots)] + sorted((r["_slot"], r["_part"]) for r in found if r["_part"])
    held = {(r["_slot"], r["_part"]): (r["b"], r["n"]) for r in found}
    placed = place_slots([held.get(u, (0, 0))[0] for u in units], shards, virtual, slack, units[slots:])
    before, rows = [0] * shards, []
    for unit, shard in zip(units, placed, strict=True):
        rows.append((*unit, shard, before[shard]))
        before[shard] += held.get(unit, (0, 0))[1]
    # One row per slot of the ring, bounded by a parameter, and at most 4 * shards / HEAVY parts.
    table = spark.createDataFrame(rows, T.StructType([
        T.StructField("_slot", T.IntegerType()), T.StructField("_part", T.IntegerType()),
        T.StructField("shard", T.IntegerType()), T.StructField("_before", T.LongType()),
    ]))
    order = Window.partitionBy("_slot", "_part").orderBy(*[F.col(f"`{c}`") for c in key_cols if c != text_col], F.xxhash64(*[F.col(f"`{c}`") for c in key_cols]))
    return (
        sized.withColumn("_nth", F.row_number().over(order)).join(F.broadcast(table), ["_slot", "_part"])
        .withColumn("slot", (F.col("_before") + F.col("_nth") - 1).cast("long"))
        .select(*docs.columns, "size", "shard", "slot")
    )
