"""Trie of conversation prefixes in node tables addressed by minimal perfect hashes.

A node is a distinct sequence of first turns; its members are the conversations that begin so.

1. *Rebuilding.* Every conversation takes over some first turns of the first conversation of its
   block of 100 ids. One ordered scan numbers the turns and sums their tagged hashes, so that each
   turn has a digest of its prefix and one of its parent's. Conversations of any length are cut
   into chunks by the scan.
2. *Shards.* Turns are dealt by first turn and conversation, in segments of ``segment`` turns at
   most, so a shard holds neighbouring parts of the trie and a first turn that everyone shares
   spreads over many shards. A task enumerates the distinct digests of a shard and assigns each a
   slot by a minimal perfect hash of its own; a slot keeps its digest, so a lookup that ends in a
   foreign slot is seen. Member counts are scattered into flat arrays, parents become slot numbers.
3. *Nodes.* The shards' counts are added up by digest. All members of a node must have the same
   parent and last turn: two prefixes with one digest end the job instead of being mixed up.
4. *Subtrees.* What a node adds to its ancestors (its saved tokens, and 1 for a leaf) goes to the
   shard of its smallest member. There the values are scattered into the slots and accumulated
   from the deepest level up through the parents' slots; sums by digest over the shards give the
   subtrees. A conversation that continues in a further segment brings the total of its deeper
   segments along as the value of the last node of each.

Turns are ordered by number, null first, and, where numbers repeat, by a digest of role and text.
Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out.
Ids are integers; the block of a negative id begins at the multiple of 100 next to it on the side
of 0. Without any conversation there is no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwise.llm.words import mix, whole_groups
from tickwise.operators.ordered import hot_keys, ordered_scan
from tickwise.session import staged

BLOCK = 100
MOST_TAKEN = 5
SEGMENT = 8_192
SHARD_ROWS = 100_000
PIECE = 1 << 20
LANES = ("s0", "s1", "s2", "s3")
Batches = Iterator[pa.RecordBatch]


@dataclass
class PerfectHash:
    """A minimal perfect hash of pairs of 64-bit numbers.

    Each level is a bit table somewhat larger than its keys; keys that are alone in their place
    stay there and the others go on to the next level with another seed. The slot of a key is the
    number of taken places before it. ``keys`` has the key of every slot.
    """

    levels: list[tuple[np.ndarray, np.ndarray]]
    keys: np.ndarray

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) & (1 << 64) - 1)
        return (mix(mix(keys[:, 0] + seed) ^ keys[:, 1]) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Slots for distinct ``keys``, an array of two columns."""
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        slots = np.empty_like(keys)
        left, taken = keys, 0
        while len(left):
            size = max(2, len(left) + len(left) // 2)
            place = cls._place(left, len(levels), size)
            table = np.bincount(place, minlength=size) == 1
            rank = taken + np.cumsum(table) - table
            alone = table[place]
            slots[rank[place[alone]]] = left[alone]
            taken += int(alone.sum())
            levels.append((table, rank))
            left = left[~alone]
            if len(levels) > 200:
                raise RuntimeError("two prefixes share a digest of 128 bits")
        return cls(levels, slots)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that the table does not hold."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for n, (table, rank) in enumerate(self.levels):
            place = self._place(keys[open_], n, len(table))
            hit = table[place]
            out[open_[hit]] = rank[place[hit]]
            open_ = open_[~hit]
        found = out >= 0
        found[found] = (self.keys[out[found]] == keys[found]).all(axis=1)
        return np.where(found, out, -1)


def _digest(depth: Column, *sums: Column) -> list[Column]:
    """Two numbers that name a prefix, from its length and the sums of its turns' hashes."""
    return [F.xxhash64(F.lit(seed), depth, *sums) for seed in (1, 2)]


def _turns(conversations: DataFrame) -> DataFrame:
    """(c, turn, turn_hash, chars, nth): narrow rows, a digest instead of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.md5(F.concat(F.octet_length(role), F.lit(":"), role, text))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.unhex(told).alias("turn_hash"), F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("nth"),
    )


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """(c, depth, turn_hash, chars, a, b, pa, pb, first, ends): turns of rebuilt conversations with prefix digests."""
    block = F.expr(f"c - c % {BLOCK}")
    taken = F.expr(f"CAST(crc32(encode(CAST(c AS STRING), 'UTF-8')) % {MOST_TAKEN + 1} AS INT)")
    opening = Window.partitionBy("c").orderBy("turn", "turn_hash", "nth")
    first_turns = (
        turns.where(f"c % {BLOCK} = 0").withColumn("p", F.row_number().over(opening)).where(F.col("p") <= MOST_TAKEN)
        .select(F.col("c").alias("of"), "p", "turn_hash", "chars")
    )
    ids = turns.select("c").distinct().where(f"c % {BLOCK} != 0").select("c", block.alias("block"), taken.alias("h"))
    taken_over = ids.join(first_turns, (F.col("block") == F.col("of")) & (F.col("p") <= F.col("h"))).select(
        "c", F.lit(1).alias("given"), F.lit(0).alias("own"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), "turn_hash", "chars",
        F.col("p").cast("long").alias("nth"),
    )
    own = turns.select("c", F.lit(0).alias("given"), F.lit(1).alias("own"), "turn", "turn_hash", "chars", "nth")
    # Turns taken over keep their order by number; own ones follow.
    rows = taken_over.withColumn("turn_key", F.lit(None).cast("binary")).unionByName(own.withColumn("turn_key", F.col("turn_hash")))
    hot = hot_keys(turns, ["c"])
    order = ["own", "turn", "turn_key", "nth"]
    numbered = ordered_scan(rows, ["c"], order, index="at", sums={"n_given": "given"}, hot=hot)
    nth_own = F.col("at") - F.col("n_given") + 1
    kept = numbered.where((F.col("own") == 0) | (F.expr(f"c % {BLOCK}") == 0) | (nth_own > taken))
    depth = F.when(F.col("own") == 0, F.col("at") + 1).when(F.expr(f"c % {BLOCK}") == 0, nth_own).otherwise(F.col("n_given") + nth_own - taken)
    tagged = kept.select("c", depth.cast("long").alias("depth"), "turn_hash", "chars")
    low, high = (F.xxhash64(F.lit(seed), "depth", "turn_hash") for seed in (3, 4))
    lanes = [low.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(low, 32), high.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(high, 32)]
    tagged = tagged.select("*", *[lane.alias(f"l{i}") for i, lane in enumerate(lanes)])
    summed = ordered_scan(
        tagged, ["c"], ["depth"], sums={s: f"l{i}" for i, s in enumerate(LANES)}, head={"first": "l0"}, lead={"_next": "depth"}, hot=hot
    )
    a, b = _digest(F.col("depth"), *[F.col(s) for s in LANES])
    pa_, pb = _digest(F.col("depth") - 1, *[F.col(s) - F.col(f"l{i}") for i, s in enumerate(LANES)])
    return summed.select(
        "c", "depth", "turn_hash", "chars", a.alias("a"), b.alias("b"), pa_.alias("pa"), pb.alias("pb"), "first", F.col("_next").isNull().alias("ends")
    )


def _pairs(t: pa.Table, a: str, b: str) -> np.ndarray:
    return np.stack([t.column(a).to_numpy().view(np.uint64), t.column(b).to_numpy().view(np.uint64)], axis=1)


_NODE = "shard long, slot int, parent int, depth long, a long, b long, pa long, pb long, n long, c long, chars long, turn_hash binary"


def _node_tables(segment: int, shard_rows: int) -> Callable[[Batches], Batches]:
    """The flat arrays of each shard, a row per slot."""

    def run(batches: Batches) -> Batches:
        shard = TaskContext.get().partitionId() << 32
        for t in whole_groups(batches, ["c", "segment"], shard_rows):
            keys = _pairs(t, "a", "b")
            order = np.lexsort((t.column("c").to_numpy(), keys[:, 1], keys[:, 0]))
            sorted_keys = keys[order]
            head = np.flatnonzero(np.r_[True, (sorted_keys[1:] != sorted_keys[:-1]).any(axis=1)])
            table = PerfectHash.build(sorted_keys[head])
            slot = table.lookup(keys)
            size = len(head)
            count = np.bincount(slot, minlength=size)
            # Rows are in order of c within a digest, so a digest's first row has its smallest member.
            of_slot = np.empty(size, np.int64)
            of_slot[slot[order[head]]] = order[head]
            turn = t.column("turn_hash").combine_chunks()
            if isinstance(turn, pa.ChunkedArray):
                turn = pa.concat_arrays(turn.chunks)
            ids = turn.dictionary_encode().indices.to_numpy()
            if (ids[of_slot][slot] != ids).any() or (_pairs(t, "pa", "pb")[of_slot][slot] != _pairs(t, "pa", "pb")).any():
                raise RuntimeError("two prefixes share a digest of 128 bits")
            own = t.take(pa.array(of_slot))
            # Segments hang together by what the last node of each carries, wherever they lie.
            opens = (own.column("depth").to_numpy() - 1) % segment == 0
            parent = np.where(opens, -1, table.lookup(_pairs(own, "pa", "pb")))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size, shard)), pa.array(np.arange(size, dtype=np.int32)), pa.array(parent.astype(np.int32)),
                    *[own.column(c).combine_chunks() for c in ("depth", "a", "b", "pa", "pb")], pa.array(count.astype(np.int64)),
                    own.column("c").combine_chunks(), own.column("chars").combine_chunks(), own.column("turn_hash").combine_chunks(),
                ],
                names=[f.split()[0] for f in _NODE.split(", ")],
            )
            shard += 1

    return run


def accumulate(parent: np.ndarray, depth: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sums of each value over the subtrees of a flat table, deepest level first; parent -1 is none."""
    totals = [v.copy() for v in values]
    order = np.argsort(-depth, kind="stable")
    edges = np.flatnonzero(np.r_[True, depth[order][1:] != depth[order][:-1], True]) if len(order) else [0]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        level = order[lo:hi]
        level = level[parent[level] >= 0]
        for total in totals:
            np.add.at(total, parent[level], total[level])
    return totals


def _subtrees(shard_rows: int) -> Callable[[Batches], Batches]:
    """(a, b, saved, leaves, parent_conv): what each shard adds to its nodes' subtrees."""

    def run(batches: Batches) -> Batches:
        for t in whole_groups(batches, ["shard"], shard_rows):
            shard, slot = t.column("shard").to_numpy(), t.column("slot").to_numpy().astype(np.int64)
            base = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            size = np.diff(np.r_[base, len(shard)])
            start = np.repeat(base, size)
            place = start + slot
            flat = np.empty(len(place), np.int64)
            flat[place] = np.arange(len(place))
            own = t.take(pa.array(flat))
            parent = own.column("parent").to_numpy().astype(np.int64)
            parent = np.where(parent >= 0, parent + start, -1)
            conv = own.column("conv_id").to_numpy()
            mine = own.column("c").to_numpy() == conv
            saved, leaves = (np.where(mine, own.column(c).to_numpy(), 0) for c in ("saved", "leaves"))
            saved, leaves = accumulate(parent, own.column("depth").to_numpy(), saved, leaves)
            above = pa.array(np.where(parent >= 0, conv[parent], 0), mask=parent < 0)
            yield pa.RecordBatch.from_arrays(
                [own.column("a").combine_chunks(), own.column("b").combine_chunks(), pa.array(saved), pa.array(leaves), above],
                names=["a", "b", "saved", "leaves", "above"],
            )

    return run


def _pieces(batches: Batches) -> Batches:
    """Decimal ids of each node's ends joined by commas, in pieces of bounded size and in order."""
    key, first, text = None, None, bytearray()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]]), pa.array([key[1]]), pa.array([first]), pa.array([bytes(text)], pa.binary())], names=["a", "b", "c", "piece"]
        )

    rows: list[pa.RecordBatch] = []
    for batch in batches:
        for a, b, c in zip(*[batch.column(n).to_pylist() for n in ("a", "b", "c")], strict=True):
            if key != (a, b) or len(text) > PIECE:
                if key is not None:
                    rows.append(row())
                key, first, text = (a, b), c, bytearray()
            text += b"%d," % c
            if len(rows) >= 1_000:
                yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
                rows = []
    if key is not None:
        rows.append(row())
    if rows:
        yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]


def _hashed(batches: Batches) -> Batches:
    """SHA-256 over the pieces of each node in order; only the running hash is held."""
    key, running, tail = None, None, b""
    out: list[tuple] = []
    for batch in batches:
        for a, b, piece in zip(*[batch.column(n).to_pylist() for n in ("a", "b", "piece")], strict=True):
            if key != (a, b):
                if key is not None:
                    running.update(tail[:-1])
                    out.append((*key, running.hexdigest()))
                key, running, tail = (a, b), hashlib.sha256(), b""
            running.update(tail)
            tail = piece
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "ends_sha256"), r, strict=True)) for r in out])
            out = []
    if key is not None:
        running.update(tail[:-1])
        out.append((*key, running.hexdigest()))
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "ends_sha256"), r, strict=True)) for r in out])


def _ends(members: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) from (a, b, c). A node that very many end at is spread by c; only its pieces meet again."""
    pieces = members.repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c").mapInArrow(_pieces, "a long, b long, c long, piece binary")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "c").mapInArrow(_hashed, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``segment`` bounds the turns of one conversation in a shard, ``shard_rows`` a shard's turns
    (up to one more segment). Extra columns of the input are ignored.
    """
    turns = staged(_turns(conversations), "turns")
    rebuilt = staged(rebuilt_turns(turns).withColumn("segment", F.expr(f"(depth - 1) div {segment}")), "rebuilt")
    dealt = (
        rebuilt.select("first", "c", "segment", "depth", "a", "b", "pa", "pb", "chars", "turn_hash")
        .repartitionByRange("first", "c", "segment").sortWithinPartitions("first", "c", "segment", "depth")
    )
    tables = staged(dealt.select("c", "segment", "depth", "a", "b", "pa", "pb", "chars", "turn_hash").mapInArrow(_node_tables(segment, shard_rows), _NODE), "node-tables")

    same = ("depth", "pa", "pb", "chars", "turn_hash")
    counted = tables.groupBy("a", "b").agg(
        F.sum("n").alias("n_convs"), F.min("c").alias("conv_id"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
        F.min("chars").alias("chars"),
        F.max(F.struct(*same)).alias("_most"), F.min(F.struct(*same)).alias("_least"),
    )
    clash = F.when(F.col("_most") != F.col("_least"), F.raise_error(F.lit("two prefixes share a digest of 128 bits")))
    counted = counted.where(clash.isNull()).drop("_most", "_least")
    members = turns.select("c").distinct()
    zero = [F.lit(0).cast("long")] * 4
    root_a, root_b = _digest(F.lit(0).cast("long"), *zero)
    none = F.lit(None).cast("long")
    root = members.agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id")).where("n_convs > 0").select(
        root_a.alias("a"), root_b.alias("b"), "n_convs", "conv_id", F.lit(0).cast("long").alias("depth"), none.alias("pa"), none.alias("pb"),
        F.lit(0).cast("long").alias("chars"),
    )
    nodes = staged(counted.unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({"pa": "a", "pb": "b"})
    nodes = nodes.join(children, ["a", "b"], "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0).cast("long")), "saved": (F.col("n_convs") - 1) * F.col("chars"),
        "leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"),
    })
    nodes = staged(nodes, "nodes-with-children")

    # Totals of a conversation's deeper segments, as the value of the last node of each segment before.
    last = f"(depth - 1) div {segment}"
    deep = nodes.where(F.col("depth") > segment).groupBy(F.col("conv_id").alias("c"), F.expr(last).alias("s")).agg(
        F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    down = Window.partitionBy("c").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = deep.select("c", (F.col("s") * segment).alias("depth"), F.sum("saved").over(down).alias("saved"), F.sum("leaves").over(down).alias("leaves"))
    # A segment in which the conversation owns no node passes on what is below it.
    spots = rebuilt.where((F.col("depth") % segment == 0) & ~F.col("ends")).select("c", "depth", "a", "b")
    gaps = Window.partitionBy("c").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = spots.join(carried, ["c", "depth"], "left").select(
        "a", "b", F.coalesce(F.last("saved", ignorenulls=True).over(gaps), F.lit(0)).alias("saved"),
        F.coalesce(F.last("leaves", ignorenulls=True).over(gaps), F.lit(0)).alias("leaves"),
    ).groupBy("a", "b").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    facts = nodes.select("a", "b", "conv_id", "saved", "leaves").join(passed, ["a", "b"], "left").select(
        "a", "b", "conv_id", (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
    )
    placed = (
        tables.select("shard", "slot", "parent", "depth", "a", "b", "c").join(facts, ["a", "b"])
        .select("shard", "slot", "parent", "depth", "a", "b", "c", "conv_id", "saved", "leaves")
        .repartition("shard").sortWithinPartitions("shard", "slot")
    )
    sums = staged(placed.mapInArrow(_subtrees(shard_rows), "a long, b long, saved long, leaves long, above long").groupBy("a", "b").agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"), F.max("above").alias("above")), "subtrees")

    turned = rebuilt.where("ends").select("a", "b", "c")
    turnless = members.join(turned.select("c"), "c", "left_anti").select(root_a.alias("a"), root_b.alias("b"), "c")
    ends = _ends(staged(turned.unionByName(turnless), "ends"))

    whole = nodes.join(sums, ["a", "b"], "left").join(ends, ["a", "b"], "left")
    top = nodes.where("depth = 0").select(F.col("conv_id").alias("root_conv"), F.lit(1).alias("depth"))
    # Segments begin without their parent; the root has no table.
    starts = nodes.where((F.col("depth") > 0) & (F.col("depth") % segment == 0)).select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("start_conv"))
    if starts.limit(1).count():
        whole = whole.join(starts, ["pa", "pb"], "left")
    else:
        whole = whole.withColumn("start_conv", none)
    first_level = _root_totals(nodes, sums)
    return (
        whole.join(F.broadcast(top), "depth", "left").join(F.broadcast(first_level), "depth", "left")
        .select(
            "conv_id", "depth", F.coalesce("above", "start_conv", "root_conv").alias("parent_conv_id"), "n_convs", "n_children",
            F.coalesce("n_leaves", "root_leaves").alias("n_leaves"), F.coalesce("saved_tokens", "root_saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def _root_totals(nodes: DataFrame, sums: DataFrame) -> DataFrame:
    """The root's totals, one row: those of the first level, and a leaf if there is none."""
    level = nodes.where("depth = 1").join(sums, ["a", "b"]).agg(F.sum("saved_tokens").alias("s"), F.sum("n_leaves").alias("n"))
    return level.select(
        F.lit(0).cast("long").alias("depth"), F.coalesce("s", F.lit(0)).alias("root_saved"), F.coalesce("n", F.lit(1)).alias("root_leaves"))
