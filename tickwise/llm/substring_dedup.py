"""Substring de-duplication with prefix-partitioned suffix trees.

A suffix starts at every word that has ``length`` words from there on in its document. Two
such suffixes share a node at depth ``length`` of the corpus's suffix tree if their first
``length`` words agree; every leaf below such a deep node, except the one that starts
earliest, is a repeat. The tree is never built whole:

1. *Prefix pass.* The word run of ``prefix`` words with the smallest hash among those that lie
   inside a suffix's first ``length`` words is its anchor. Equal suffixes have equal anchors at
   equal distances, and neighbouring suffixes mostly share one, so a document yields about one
   anchor per seven words. Anchors are counted over the corpus (combined before the shuffle).
   Suffixes of an anchor that occurs once are leaves that hang above the depth: they stay out.
2. *Partition pass.* Suffixes of repeated anchors travel with their words, neighbours together
   in one segment, to the group of their anchor's words. A group that would hold more than
   ``group_rows`` segments is dealt over salts, so that every group fits into memory.
3. *Subtrees.* A task reads its groups in order and refines each by the next words, level by
   level. Nodes with a single leaf are dropped at once. What is left at depth ``length`` are the
   deep internal nodes; all leaves but the earliest are marked.
4. *Longer prefixes.* Groups that were dealt over salts leave one representative leaf per deep
   node and salt. These go on under the longest prefix, all ``length`` words, where the earliest
   is an ordinary minimum and the rest are marked.

Documents without text have no words. A document is a row's (doc_id, text): rows that repeat
both are the same document, and rows that only share the id are ordered by a hash of the text.
A null id counts as larger than every other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.llm.words import mix, run_hashes, sliding_argmin, split_words, text_slices

LENGTH = 20
PREFIX = 6
GROUP_ROWS = 2_000
LEVEL = 4
BATCH_WORDS = 2_000_000
_LAST = (1 << 63) - 1
Batches = Iterator[pa.RecordBatch]


def _runs(words, length: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first suffix, number of suffixes, anchor's hash, text) of each run with one anchor."""
    keys = run_hashes(words.hashes, prefix)
    at = sliding_argmin(keys, length - prefix + 1)
    text = words.text_of_word()[: len(at)]
    whole = np.arange(len(at)) + length <= words.first[text + 1]
    new = whole.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~whole[:-1]
    start = np.flatnonzero(new)
    if not len(start):
        return start, start, np.empty(0, np.uint64), start
    suffixes = np.cumsum(whole)
    count = np.diff(np.r_[suffixes[start] - 1, suffixes[-1]])
    return start, count, keys[at[start]], text[start]


def _anchors(length: int, prefix: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for a, b, data, off in text_slices(batch.column("text")):
                w = split_words(data, off)
                start, count, key, text = _runs(w, length, prefix)
                u = batch.column("u").slice(a, b - a).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(u[text]), pa.array((start - w.first[text]) << 16 | count)],
                    names=["key", "u", "pos"],
                )

    return run


def _segments(length: int, prefix: int) -> Callable[[Batches], Batches]:
    """Words of the surviving suffixes, with their group's key and salt."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            lists = batch.column("found")
            for a, b, data, off in text_slices(batch.column("text")):
                w = split_words(data, off)
                keys = run_hashes(w.hashes, prefix)
                at = sliding_argmin(keys, length - prefix + 1)
                mine = lists.slice(a, b - a)
                found = mine.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                size = np.diff(np.asarray(mine.offsets)) if len(mine) else np.empty(0, np.int64)
                text = np.repeat(np.arange(b - a), size)
                rel, bits, count = found >> 16, found >> 8 & 255, found & 255
                start = rel + w.first[text]
                fits = (start + count + length - 1 <= w.first[text + 1]) & (start < len(at))
                text, rel, bits, count, start = (x[fits] for x in (text, rel, bits, count, start))
                u = batch.column("u").slice(a, b - a).to_numpy(zero_copy_only=False)[text]
                d = batch.column("doc_id").slice(a, b - a).fill_null(_LAST).to_numpy(zero_copy_only=False)[text]
                width = count + length - 1
                ends = np.cumsum(width)
                flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - width), width)
                codes = (w.hashes >> np.uint64(32)).astype(np.uint32)[flat]
                spread = mix(u.view(np.uint64) + rel.astype(np.uint64)) & ((np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1))
                offsets = pa.py_buffer(np.r_[0, ends * 4].astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[at[start]].view(np.int64)), pa.array(spread.astype(np.int32)), pa.array(bits > 0),
                        pa.array(d), pa.array(u), pa.array(rel << 8 | count),
                        pa.Array.from_buffers(pa.binary(), len(count), [None, offsets, pa.py_buffer(codes.tobytes())]),
                    ],
                    names=["key", "salt", "hot", "d", "u", "pos", "words"],
                )

    return run


def _deep_nodes(group: np.ndarray, codes: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, node) for all leaves below internal nodes at depth ``length``.

    ``at`` is where each leaf's words begin in ``codes``; ``group`` names the subtree. A level
    follows the next few words of all nodes at once and drops nodes that have one leaf left.
    """
    leaf, node = np.arange(len(at)), group
    for depth in range(0, length, LEVEL):
        if not len(leaf):
            break
        symbol = np.zeros(len(leaf), dtype=np.uint64)
        for j in range(depth, min(depth + LEVEL, length)):
            symbol = mix(symbol + codes[at[leaf] + j].astype(np.uint64))
        order = np.lexsort((symbol, node))
        leaf, node, symbol = leaf[order], node[order], symbol[order]
        new = np.r_[True, (node[1:] != node[:-1]) | (symbol[1:] != symbol[:-1])]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(leaf)])
        inner = np.repeat(size > 1, size)
        node = np.repeat(np.arange(len(first)), size)[inner]
        leaf = leaf[inner]
    return leaf, node


def _subtrees(length: int, hot: bool) -> Callable[[Batches], Batches]:
    """Marks of one kind of groups: (d, u, pos with a bit per repeated suffix).

    For hot groups the earliest leaf of each deep node, and every leaf that is alone in its
    salt, is a representative: it has the hashes of its whole prefix in ``a`` and ``b``.
    """

    def work(t: pa.Table) -> pa.RecordBatch:
        key = t.column("key").to_numpy()
        salt = t.column("salt").to_numpy()
        d, u, pos = (t.column(c).to_numpy() for c in ("d", "u", "pos"))
        binary = t.column("words").combine_chunks()
        if isinstance(binary, pa.ChunkedArray):
            binary = pa.concat_arrays(binary.chunks)
        off = np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(binary) + 1] // 4
        codes = np.frombuffer(binary.buffers()[2], np.uint32)
        count = pos & 255
        segment = np.repeat(np.arange(len(pos)), count)
        nth = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
        start = (pos >> 8)[segment] + nth
        at = off[:-1].astype(np.int64)[segment] + nth
        group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])[segment]
        leaf, node = _deep_nodes(group, codes, at, length)
        order = np.lexsort((start[leaf], u[segment[leaf]], d[segment[leaf]], node))
        leaf, node = leaf[order], node[order]
        head = np.r_[True, node[1:] != node[:-1]] if len(node) else np.empty(0, bool)
        first = leaf[head][np.cumsum(head) - 1] if len(node) else leaf
        same = (u[segment[leaf]] == u[segment[first]]) & (d[segment[leaf]] == d[segment[first]]) & (start[leaf] == start[first])
        marked = leaf[~same]
        bits = np.zeros(len(pos), dtype=np.int64)
        np.bitwise_or.at(bits, segment[marked], np.int64(1) << nth[marked])
        out = np.flatnonzero(bits)
        columns = [d[out], u[out], (pos[out] >> 8) << 32 | bits[out]]
        a = b = np.zeros(len(out), np.int64)
        if hot:
            alone = np.ones(len(at), bool)
            alone[marked] = False
            rep = np.flatnonzero(alone)
            ha, hb = np.full(len(rep), 7, np.uint64), np.full(len(rep), 11, np.uint64)
            for j in range(length):
                word = codes[at[rep] + j].astype(np.uint64)
                ha, hb = mix(ha * np.uint64(3) + word), mix(hb * np.uint64(5) + word)
            columns = [
                np.r_[c, r] for c, r in
                zip(columns, (d[segment[rep]], u[segment[rep]], start[rep] << 32 | 1), strict=True)
            ]
            a, b = np.r_[a, ha.view(np.int64)], np.r_[b, hb.view(np.int64)]
        is_rep = np.arange(len(a)) >= len(out)
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, columns), pa.array(a), pa.array(b), pa.array(is_rep)], names=["d", "u", "pos", "a", "b", "rep"]
        )

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            batch = batch.filter(batch.column("hot") if hot else pa.compute.invert(batch.column("hot")))
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("words").nbytes // 4
            if size < BATCH_WORDS:
                continue
            t = pa.Table.from_batches(held)
            key, salt = t.column("key").to_numpy(), t.column("salt").to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))
            if len(cut):
                yield work(t.slice(0, int(cut[-1]) + 1))
                t = t.slice(int(cut[-1]) + 1)
            held, size = t.combine_chunks().to_batches(), t.column("words").nbytes // 4
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(u, doc_id, text): u is a hash that names the document."""
    i, t = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(i, t).alias("u"), i.alias("doc_id"), t.alias("text"))


def repeated_suffixes(
    named: DataFrame, length: int = LENGTH, prefix: int = PREFIX, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """(d, u, marks): per document the suffixes whose first words also start earlier.

    A mark holds a first suffix in its upper bits and, in the lower 32, a bit for it and each
    of its followers. At most ``length - prefix + 1`` suffixes share an anchor, so bits suffice
    for lengths up to 32.
    """
    if not 0 < prefix < length <= 32:
        raise ValueError("prefix must be shorter than length, and length at most 32")
    anchors = named.select("u", "text").mapInArrow(_anchors(length, prefix), "key long, u long, pos long")
    counts = anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(group_rows)))).cast("long")
    found = (
        anchors.join(counts, "key")
        .select("u", F.col("pos").bitwiseAND(F.lit(0xFFFF)).alias("c"), F.shiftright("pos", 16).alias("s"), bits.alias("b"))
        .select("u", (F.shiftleft("s", 16) + F.shiftleft("b", 8) + F.col("c")).alias("pos"))
        .groupBy("u").agg(F.collect_set("pos").alias("found"))
    )
    segments = (
        named.join(found.hint("shuffle_hash"), "u")
        .select("u", "doc_id", "text", "found")
        .mapInArrow(_segments(length, prefix), "key long, salt int, hot boolean, d long, u long, pos long, words binary")
        .repartition("key", "salt")
        .sortWithinPartitions("key", "salt")
    )
    schema = "d long, u long, pos long, a long, b long, rep boolean"
    cold = segments.mapInArrow(_subtrees(length, False), schema)
    hot = segments.mapInArrow(_subtrees(length, True), schema)
    reps = hot.where("rep")
    earliest = reps.groupBy("a", "b").agg(F.min(F.struct("d", "u", "pos")).alias("e"))
    later = reps.join(earliest, ["a", "b"]).where(F.struct("d", "u", "pos") != F.col("e"))
    marks = cold.select("d", "u", "pos").unionAll(hot.where("NOT rep").select("d", "u", "pos")).unionAll(later.select("d", "u", "pos"))
    return marks.groupBy("d", "u").agg(F.collect_list("pos").alias("marks"))


def _covered(marks: pa.Array, first: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which words lie in a marked suffix's first ``length`` words."""
    size = np.diff(np.asarray(marks.offsets)) if len(marks) else np.empty(0, np.int64)
    mark = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    base = first[np.repeat(np.arange(len(size)), size)] + (mark >> 32)
    change = np.zeros(n + length + 1, dtype=np.int64)
    for j in range(length):
        at = base[(mark >> j & 1) == 1] + j
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
    return np.cumsum(change)[:n] > 0


def _kept(length: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            marks = batch.column("marks").fill_null([])
            n_words, n_removed, sha, kept_text = [], [], [], []
            for a, b, data, off in text_slices(batch.column("text")):
                w = split_words(data, off)
                gone = _covered(marks.slice(a, b - a), w.first, len(w.hashes), length)
                raw = data.tobytes()
                for i in range(b - a):
                    tokens = raw[off[i] : off[i + 1]].split()
                    lost = gone[w.first[i] : w.first[i + 1]]
                    n = int(lost.sum())
                    kept = b" ".join(compress(tokens, ~lost) if n else tokens)
                    n_words.append(len(tokens))
                    n_removed.append(n)
                    sha.append(hashlib.sha256(kept).hexdigest())
                    kept_text.append(kept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(sha, pa.string()), pa.array(kept_text, pa.binary()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return run


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, group_rows: int = GROUP_ROWS,
    id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
) -> DataFrame:
    """Every document without the words of repeats of at least ``length`` words.

    Returns doc_id, n_words, n_removed, kept_sha256 and, with ``with_text``, kept: the words
    that stay, joined by one space. One row per input row; a null text has no words.
    """
    named = _named(docs, id_col, text_col)
    marks = repeated_suffixes(named, length, prefix, group_rows)
    # Placed by u alone, as in the partition pass, so that the texts' shuffle there serves here too.
    same = (F.col("u") == F.col("_u")) & (F.coalesce("doc_id", F.lit(_LAST)).bitwiseXOR(F.col("_d")) == 0)
    whole = named.join(marks.withColumnsRenamed({"d": "_d", "u": "_u"}).hint("shuffle_hash"), same, "left")
    out = whole.select("doc_id", "text", "marks").mapInArrow(
        _kept(length), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
    )
    if with_text:
        return out.withColumn("kept", F.col("kept").cast("string"))
    return out.drop("kept")
