"""Suffix-array de-duplication by prefix-free parsing: every byte of a string that occurs twice goes.

A string of ``length`` bytes is a repeat if it also starts anywhere else in the corpus, in the
same document or another. Documents never touch each other. Each of the steps is a Spark job:

1. *Parsing.* A rolling hash of ``window`` bytes runs over every text; where it is 0 modulo
   ``modulus`` there is a trigger, and triggers cut the text into phrases. Of the triggers inside
   a string, the one with the smallest hash is the string's; equal strings have equal ones at
   equal distances. The neighbouring strings of one trigger are a piece of the parse: the end of
   a phrase, the trigger, and what follows in the parse.
2. *Dictionary.* Pieces whose trigger is unique in the corpus hold no repeat. Equal pieces are one
   entry of the dictionary; an entry that occurs twice settles all of its strings at once, however
   many copies there are, and only one of them goes on.
3. *Suffix arrays.* Entries that share a trigger meet in one group. Two arrays are sorted there:
   what precedes the trigger, read backwards (the suffixes of dictionary phrases), and what
   follows it (the suffixes of the parse), both with the longest common prefixes of neighbours.
4. *Combination.* A string is a suffix of a phrase of ``t`` bytes and the ``length - t`` bytes from
   the trigger on. Cutting both arrays at these depths gives its class in corpus order; a class
   of two or more is a repeat.

A group of more than ``group_rows`` entries is dealt over salts. There, classes that are alone in
their salt and one member of every other class go on under a hash of the whole string, where equal
ones meet at most once per salt.

A string without a trigger inside (a long phrase without one) is a piece by itself under its own
hash. Long runs of one character give one piece per byte, which is still linear.

A null text is empty. Rows that repeat a doc_id and a text are documents of their own, so all
their strings are repeats. A null doc_id is an id like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.llm.words import mix, text_slices
from tickwise.operators.lookup import join_facts
from tickwise.operators.ordered import HotKeys
from tickwise.session import staged

LENGTH = 400
WINDOW = 128
MODULUS = 32
GROUP_ROWS = 20_000
BATCH_BYTES = 24 << 20
SLICE = 4 << 20
HOT_PIECES = 1_000_000
MAX_HOT = 16_384
_NULL_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.Generator(np.random.PCG64(0xFACE)).integers(1, 1 << 63, 256, dtype=np.uint64)
Batches = Iterator[pa.RecordBatch]


def rolling_hashes(data: np.ndarray, window: int) -> np.ndarray:
    """Hash of the ``window`` bytes (a power of two) from each position on, by doubling."""
    h, width = _CODES[data], 1
    while width < window:
        if len(h) <= width:
            return h[:0]
        h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    return h


def triggers(data: np.ndarray, window: int, modulus: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, mixed hashes) of the windows whose hash is 0 modulo ``modulus``."""
    h = mix(rolling_hashes(data, window))
    at = np.flatnonzero(h % np.uint64(modulus) == 0)
    return at, h[at]


def _nearest_below(at: np.ndarray, value: np.ndarray, reach: int, strict: bool) -> np.ndarray:
    """Position of the nearest earlier trigger within ``reach`` that is smaller (or equal, unless strict)."""
    found = np.full(len(at), -1, dtype=np.int64)
    open_ = np.arange(1, len(at))
    back = 1
    while len(open_):
        other = open_ - back
        near = at[open_] - at[other] <= reach
        below = near & ((value[other] < value[open_]) if strict else (value[other] <= value[open_]))
        found[open_[below]] = at[other[below]]
        back += 1
        open_ = open_[near & ~below]
        open_ = open_[open_ >= back]
    return found


def pieces(data: np.ndarray, length: int, window: int, modulus: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, trigger, trigger's hash) of each piece of one text.

    Strings without a trigger come out one by one, with trigger -1 and hash 0.
    """
    none = np.empty(0, np.int64)
    last = len(data) - length
    if last < 0:
        return none, none, none, np.empty(0, np.uint64)
    at, value = triggers(data, window, modulus)
    reach = length - window
    left = _nearest_below(at, value, reach, strict=False)
    right = len(data) - 1 - _nearest_below(len(data) - 1 - at[::-1], value[::-1], reach, strict=True)[::-1]
    right[right == len(data)] = len(data) + length
    first = np.maximum(np.maximum(at - reach, left + 1), 0)
    end = np.minimum(np.minimum(at, right - reach - 1), last)
    real = first <= end
    first, end, at, value = first[real], end[real], at[real], value[real]
    change = np.zeros(last + 2, dtype=np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, end + 1, -1)
    bare = np.flatnonzero(np.cumsum(change)[: last + 1] == 0)
    return (
        np.r_[first, bare], np.r_[end - first + 1, np.ones(len(bare), np.int64)],
        np.r_[at, np.full(len(bare), -1)], np.r_[value, np.zeros(len(bare), np.uint64)],
    )


def _pack(first: np.ndarray, count: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A piece's place in one number: first string, strings, bytes before the trigger."""
    return first << 24 | count << 12 | before


def _slices(off: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """(text, first byte) of every text's slices: the starts of strings, ``SLICE`` at a time.

    A slice's last strings reach into the next one, so which piece a string is in may depend on
    the slice, but not which trigger it has.
    """
    for i, size in enumerate(np.diff(off).tolist()):
        for base in range(0, size - length + 1, SLICE):
            yield i, base


def _parse(length: int, window: int, modulus: int) -> Callable[[Batches], Batches]:
    """(key, h1, h2, d, u, pos) of every piece; key names the trigger, h1 and h2 the content."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for a, b, data, off in text_slices(batch.column("text")):
                us = batch.column("u").slice(a, b - a).to_numpy(zero_copy_only=False)
                ds = batch.column("d").slice(a, b - a).to_numpy(zero_copy_only=False)
                keys, digests, d, u, pos = [], [], [], [], []
                for i, base in _slices(off, length):
                    text = data[off[i] + base : min(off[i + 1], off[i] + base + SLICE + length - 1)]
                    first, count, at, value = pieces(text, length, window, modulus)
                    raw = text.tobytes()
                    before = np.where(at < 0, 0, at - first)
                    made = b"".join(
                        hashlib.blake2b(raw[s : s + m + length - 1], digest_size=16, salt=t.to_bytes(2, "big")).digest()
                        for s, m, t in zip(first.tolist(), count.tolist(), before.tolist(), strict=True)
                    )
                    h = np.frombuffer(made, np.int64).reshape(-1, 2)
                    keys.append(np.where(at < 0, h[:, 0], value.view(np.int64)))
                    digests.append(h)
                    pos.append(_pack(base + first, count, before))
                    d.append(np.full(len(first), ds[i]))
                    u.append(np.full(len(first), us[i]))
                if keys:
                    h = np.concatenate(digests)
                    columns = [np.concatenate(keys), h[:, 0], h[:, 1], *map(np.concatenate, (d, u, pos))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["key", "h1", "h2", "d", "u", "pos"])

    return run


def _cut(length: int) -> Callable[[Batches], Batches]:
    """The bytes of the pieces that were asked for, with their group."""

    def run(batches: Batches) -> Batches:
        cut: set[tuple[int, int]] = set()
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            rows: dict[str, list] = {c: [] for c in ("key", "salt", "hot", "settled", "d", "u", "pos", "bytes")}
            size = 0
            for text, d, u, found in zip(texts, batch.column("d").to_pylist(), batch.column("u").to_pylist(), batch.column("found").to_pylist(), strict=True):
                if (d, u) in cut:
                    continue
                cut.add((d, u))
                raw = text.as_py()
                for f in found:
                    s, m = f["pos"] >> 24, f["pos"] >> 12 & 4095
                    piece = raw[s : s + m + length - 1]
                    size += len(piece)
                    for c, v in zip(rows, (f["key"], (u ^ f["pos"]) % f["salts"], f["salts"] > 1, f["n"] > 1, d, u, f["pos"], piece), strict=True):
                        rows[c].append(v)
                if size > BATCH_BYTES:
                    yield _as_batch(rows)
                    rows, size = {c: [] for c in rows}, 0
            if size:
                yield _as_batch(rows)

    return run


_CUT_TYPES = {
    "key": pa.int64(), "salt": pa.int64(), "hot": pa.bool_(), "settled": pa.bool_(), "d": pa.int64(), "u": pa.int64(),
    "pos": pa.int64(), "bytes": pa.binary(),
}


def _as_batch(rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, _CUT_TYPES[c]) for c, v in rows.items()], names=list(rows))


def sorted_with_lcp(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the strings within their groups, and each one's common prefix with the one before.

    -1 where a group begins.
    """
    n = len(strings)
    keyed = [g.to_bytes(8, "big") + s for g, s in zip(group.tolist(), strings, strict=True)]
    order = np.array(sorted(range(n), key=keyed.__getitem__), dtype=np.int64)
    size = np.array([len(s) for s in strings], dtype=np.int64)[order]
    lcp = np.full(n, -1, dtype=np.int64)
    width = int(size.max(initial=0))
    step = max(2, (8 << 20) // max(1, width))
    for a in range(0, n, step - 1):
        part = order[a : a + step]
        block = np.zeros((len(part), width + 1), dtype=np.uint8)
        for i, e in enumerate(part.tolist()):
            block[i, : len(strings[e])] = np.frombuffer(strings[e], np.uint8)
        if len(part) > 1:
            same = block[1:] == block[:-1]
            same[:, width] = False
            lcp[a + 1 : a + len(part)] = np.minimum(same.argmin(axis=1), np.minimum(size[a + 1 : a + len(part)], size[a : a + len(part) - 1]))
    new = np.r_[True, group[order][1:] != group[order][:-1]] if n else np.empty(0, bool)
    lcp[new] = -1
    return order, lcp


def repeated_strings(group: np.ndarray, strings: list[bytes], pos: np.ndarray, length: int) -> np.ndarray:
    """Which strings of each piece share their class in corpus order: a row of flags per piece.

    The result has a column per string, counted from the piece's first.
    """
    n = len(strings)
    count, before = pos >> 12 & 4095, pos & 4095
    out = np.zeros((n, int(count.max(initial=1))), dtype=bool)
    heads = [s[:b][::-1] for s, b in zip(strings, before.tolist(), strict=True)]
    tails = [s[b:] for s, b in zip(strings, before.tolist(), strict=True)]
    by_head, head_lcp = sorted_with_lcp(heads, group)
    by_tail, tail_lcp = sorted_with_lcp(tails, group)
    head_class, tail_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for t in range(int((before - count).min(initial=0)) + 1, int(before.max(initial=0)) + 1):
        live = np.flatnonzero((t <= before) & (t > before - count))
        if t < 0 or len(live) < 2:
            continue
        head_class[by_head] = np.cumsum(head_lcp < t)
        tail_class[by_tail] = np.cumsum(tail_lcp < length - t)
        pair = head_class[live] * (n + 1) + tail_class[live]
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        hit = live[order[np.r_[False, same] | np.r_[same, False]]]
        out[hit, before[hit] - t] = True
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, columns) of the runs of True."""
    padded = np.zeros((flags.shape[0], flags.shape[1] + 2), dtype=np.int8)
    padded[:, 1:-1] = flags
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    return row, start, np.nonzero(step == -1)[1] - start


def _mark(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return first << 12 | count


def _classes(length: int, hot: bool) -> Callable[[Batches], Batches]:
    """Marks of the pieces of one kind of groups: (d, u, mark, h1, h2, settled).

    Of hot groups also, under their hash in h1 and h2, the strings that are alone in their salt
    and, as settled ones, one of each class that is not.
    """

    def work(t: pa.Table) -> pa.RecordBatch:
        key, salt, d, u, pos = (t.column(c).to_numpy() for c in ("key", "salt", "d", "u", "pos"))
        settled = t.column("settled").to_numpy()
        group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
        strings = t.column("bytes").to_pylist()
        flags = repeated_strings(group, strings, pos, length)
        row, start, size = _runs(flags & ~settled[:, None])
        columns = [d[row], u[row], _mark((pos[row] >> 24) + start, size)]
        h = np.zeros((len(row), 2), np.int64)
        known = np.ones(len(row), bool)
        if hot:
            inside = np.arange(flags.shape[1]) < (pos >> 12 & 4095)[:, None]
            seen: set[tuple[int, bytes]] = set()
            rows, starts, digests, sure = [], [], [], []
            for e, j in zip(*np.nonzero(inside), strict=True):
                string = hashlib.blake2b(strings[e][j : j + length], digest_size=16).digest()
                done = bool(flags[e, j] or settled[e])
                if done and (group[e], string) in seen:
                    continue
                seen.add((group[e], string))
                rows.append(e)
                starts.append(j)
                digests.append(string)
                sure.append(done)
            r, s = np.array(rows, np.int64), np.array(starts, np.int64)
            columns = [np.r_[c, x] for c, x in zip(columns, (d[r], u[r], _mark((pos[r] >> 24) + s, np.ones(len(r), np.int64))), strict=True)]
            h = np.r_[h, np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)]
            known = np.r_[known, np.array(sure, bool)]
        is_rep = np.arange(len(known)) >= len(row)
        arrays = [*columns, np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]), known, is_rep]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in arrays], names=["d", "u", "mark", "h1", "h2", "settled", "rep"])

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            batch = batch.filter(batch.column("hot") if hot else pa.compute.invert(batch.column("hot")))
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < BATCH_BYTES:
                continue
            t = pa.Table.from_batches(held)
            key, salt = t.column("key").to_numpy(), t.column("salt").to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))
            if len(cut):
                yield work(t.slice(0, int(cut[-1]) + 1))
                t = t.slice(int(cut[-1]) + 1)
            held, size = t.combine_chunks().to_batches(), t.nbytes
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(u, d, doc_id, text): u and d name the document."""
    i, t = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(i, t).alias("u"), F.coalesce(i, F.lit(_NULL_ID)).alias("d"), i.alias("doc_id"), t.alias("text"))


def _hot(counts: DataFrame, keys: list[str], limit: int) -> HotKeys:
    """The keys with more rows than one task should read; ``counts`` has them in ``n``."""
    rows = counts.where(F.col("n") > limit).orderBy(F.desc("n")).limit(MAX_HOT).collect()
    return HotKeys(tuple((tuple(r[k] for k in keys), r["n"]) for r in rows), limit)


def repeated_marks(
    named: DataFrame, length: int = LENGTH, window: int = WINDOW, modulus: int = MODULUS, group_rows: int = GROUP_ROWS,
    hot_pieces: int = HOT_PIECES,
) -> DataFrame:
    """(d, u, marks): per document the runs of starts of repeated strings, start << 12 | how many."""
    if window & (window - 1) or not 0 < window <= length < 2048:
        raise ValueError("window must be a power of two, at most length, and length below 2048")
    long_enough = named.where(F.octet_length("text") >= length)
    parsed = long_enough.select("text", "d", "u").mapInArrow(
        _parse(length, window, modulus), "key long, h1 long, h2 long, d long, u long, pos long"
    )
    parse = staged(parsed, "parse")
    shared = staged(parse.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-triggers")
    hot = _hot(shared, ["key"], hot_pieces)
    live = staged(join_facts(parse, shared.select("key"), ["key"], "inner", hot), "shared-pieces")

    entry = ["key", "h1", "h2"]
    dictionary = staged(live.groupBy(*entry).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "u", "pos")).alias("first")), "dictionary")
    twice = dictionary.where("n > 1")
    settled = join_facts(live, twice.select(*entry), entry, "inner", _hot(twice, entry, hot_pieces) if hot else HotKeys((), hot_pieces))
    whole = settled.select("d", "u", (F.shiftleft(F.shiftright("pos", 24), 12) + F.shiftright("pos", 12).bitwiseAND(4095)).alias("mark"))

    sizes = dictionary.groupBy("key").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1")
    salts = F.ceil(F.col("entries") / F.lit(group_rows)).cast("long")
    asked = (
        dictionary.join(sizes, "key")
        .select("first.d", "first.u", F.struct("key", salts.alias("salts"), "n", F.col("first.pos").alias("pos")).alias("f"))
        .groupBy("d", "u").agg(F.collect_list("f").alias("found"))
    )
    same = (F.col("u") == F.col("_u")) & (F.col("d") == F.col("_d"))
    # All columns of the texts, as in the last join, so that one shuffle of them serves both.
    groups = (
        long_enough.join(asked.withColumnsRenamed({"d": "_d", "u": "_u"}).hint("shuffle_hash"), same)
        .select("u", "d", "doc_id", "text", "found")
        .mapInArrow(_cut(length), "key long, salt long, hot boolean, settled boolean, d long, u long, pos long, bytes binary")
        .repartition("key", "salt")
        .sortWithinPartitions("key", "salt")
    )
    schema = "d long, u long, mark long, h1 long, h2 long, settled boolean, rep boolean"
    marks = whole.unionAll(groups.mapInArrow(_classes(length, False), schema).select("d", "u", "mark"))
    if sizes.where(F.col("entries") > group_rows).limit(1).count():
        dealt = staged(groups.mapInArrow(_classes(length, True), schema), "dealt")
        reps = dealt.where("rep")
        counts = reps.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
        across = reps.where("NOT settled").join(counts, ["h1", "h2"]).select("d", "u", "mark")
        marks = marks.unionAll(dealt.where("NOT rep").select("d", "u", "mark")).unionAll(across)
    return marks.groupBy("d", "u").agg(F.collect_set("mark").alias("marks"))


def _kept(length: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            marks = batch.column("marks")
            for a, b, data, off in text_slices(batch.column("text")):
                removed, spans, sha, kept_text = [], [], [], []
                for i in range(b - a):
                    text = data[off[i] : off[i + 1]]
                    mark = marks[a + i].values
                    m = np.empty(0, np.int64) if mark is None else mark.to_numpy(zero_copy_only=False)
                    change = np.zeros(len(text) + 1, dtype=np.int64)
                    np.add.at(change, m >> 12, 1)
                    np.add.at(change, (m >> 12) + (m & 4095) + length - 1, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    kept = text[~gone].tobytes()
                    removed.append(int(gone.sum()))
                    spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0)
                    sha.append(hashlib.sha256(kept).hexdigest())
                    kept_text.append(kept)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a), pa.array(np.diff(off).astype(np.int64)), pa.array(removed, pa.int64()),
                        pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return run


def remove_repeated_strings(
    docs: DataFrame, length: int = LENGTH, window: int = WINDOW, modulus: int = MODULUS, group_rows: int = GROUP_ROWS,
    hot_pieces: int = HOT_PIECES, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
) -> DataFrame:
    """Every document without the bytes of strings of ``length`` bytes that start anywhere else too.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with
    ``with_text``, kept: the bytes that stay, as binary, since a cut may fall inside a character.
    One row per input row. Documents shorter than ``length`` skip the join.
    """
    named = _named(docs, id_col, text_col)
    marks = repeated_marks(named, length, window, modulus, group_rows, hot_pieces).withColumnsRenamed({"d": "_d", "u": "_u"})
    enough: Column = F.octet_length("text") >= length
    same = (F.col("u") == F.col("_u")) & (F.col("d") == F.col("_d"))
    joined = named.where(enough).join(marks.hint("shuffle_hash"), same, "left").select("doc_id", "text", "marks")
    short = named.where(~enough).select("doc_id", "text", F.lit(None).cast("array<long>").alias("marks"))
    out = joined.unionAll(short).mapInArrow(
        _kept(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    return out if with_text else out.drop("kept")
