"""Near-duplicate documents by one-permutation MinHash.

One hash per shingle fills all bins: its upper bits name the bin, the smallest hash of a bin is
its value. An empty bin borrows from other bins in an order that is fixed for each bin (optimal
densification), so short documents get full signatures as well. ``rows`` bins make a band, and
documents that agree in a band share a bucket.

Documents with equal shingle sets form one class. Everything below works on classes, and emits
stars instead of all pairs of a bucket:

1. In each bucket every class is paired with one centre. Of the pairs that a class gets, the one
   with the best signature estimate is confirmed on the full sets.
2. Where a bucket still holds several components, its best connected class becomes the centre
   and is paired with all classes of other components.
3. What is left is settled exactly: in buckets that hold several components, each class outside
   the bucket's main component is compared with the classes of other components, in blocks of
   bounded size, inside the task. Signatures tell which classes of a block meet any class at all
   that could be similar; these rows alone fetch their full sets, on which the block's pairs are
   confirmed. A pair is looked at in one of its buckets, and a block emits a forest of links, so
   no stage writes more rows than blocks have classes.

Every link is confirmed on full sets. A pair at the required similarity of 0.8 shares no bucket
with a probability of 3e-6, and the signature bounds lie 3.5 standard deviations below it.

Documents without words have empty sets and stay alone. Rows that repeat an id and a text are
in one class. A null id counts as larger than every other and never names a component unless
all ids in it are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.llm.graph import components, merged
from tickwise.llm.words import mix, run_hashes, split_words, text_slices, whole_groups
from tickwise.session import small_batches, staged

SHINGLE = 5
PERCENT = 80
BINS = 256
BAND_ROWS = 6
BLOCK = 1024
#: Shingles on one side of a block, so that its full sets take about 8 MB.
BLOCK_SHINGLES = 1 << 20
#: Rows that Arrow hands over at once; a row may hold a text or two sets.
ROWS_AT_ONCE = 500
#: Rows of classes that are worth a task.
TASK_ROWS = 4_096
_LAST = (1 << 63) - 1
_ORDER = np.array([np.random.Generator(np.random.PCG64(i)).permutation(BINS) for i in range(BINS)])
Batches = Iterator[pa.RecordBatch]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, first hash of each text).

    A text with fewer words than a shingle has its whole sequence as its only one.
    """
    w = split_words(data, offsets, fold=True)
    n = np.diff(w.first)
    runs = run_hashes(w.hashes, size)
    text = w.text_of_word()[: len(runs)]
    inside = np.arange(len(runs)) + size <= w.first[text + 1] if len(runs) else np.empty(0, bool)
    hashes, owner = [runs[inside]], [text[inside]]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            hashes.append(mix(run_hashes(w.hashes, k)[w.first[short]] + np.uint64(k)))
            owner.append(short)
    h, o = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], np.searchsorted(o[new], np.arange(len(offsets)))


def _bins(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, filled) per text and bin; the sets are sorted, so a bin's first hash is its smallest."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    slot = owner * BINS + (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.empty(0, np.int64)
    values, filled = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    values[slot[head]], filled[slot[head]] = h[head], True
    return values.reshape(n, BINS), filled.reshape(n, BINS)


def _densified(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fill each empty bin from the first filled one in that bin's own order."""
    out = values.copy()
    text, slot = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for attempt in range(BINS):
        if not len(text):
            break
        source = _ORDER[slot, attempt]
        hit = filled[text, source]
        out[text[hit], slot[hit]] = values[text[hit], source[hit]]
        text, slot = text[~hit], slot[~hit]
    return out


def _signatures(size: int) -> Callable[[Batches], Batches]:
    """(n, class, bands, marks): a mark is 16 bits of a bin's value, 0 where the bin is empty."""
    bands = BINS // BAND_ROWS

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for a, b, data, off in text_slices(batch.column("text")):
                h, first = shingle_sets(data, off, size)
                n = np.diff(first)
                values, filled = _bins(h, first)
                rows = _densified(values, filled)[:, : bands * BAND_ROWS].reshape(len(n), bands, BAND_ROWS)
                band = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(n), bands)).copy()
                for j in range(BAND_ROWS):
                    band = mix(band * np.uint64(31) + rows[:, :, j])
                total = np.zeros((2, len(h) + 1), np.uint64)
                total[0, 1:], total[1, 1:] = np.cumsum(mix(h)), np.cumsum(mix(h ^ np.uint64(0xABCDEF)))
                name = (total[:, first[1:]] - total[:, first[:-1]]).T + n[:, None].astype(np.uint64)
                marks = np.where(filled, np.maximum(values & np.uint64(0xFFFF), np.uint64(1)), np.uint64(0)).astype(np.uint16)
                some = n > 0
                lists = np.where(some, bands, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a), batch.column("d").slice(a, b - a),
                        batch.column("u").slice(a, b - a), pa.array(n.astype(np.int64)),
                        pa.array([name[i].tobytes() if some[i] else None for i in range(len(n))], pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.r_[0, np.cumsum(lists)].astype(np.int32)), pa.array(band[some].ravel().view(np.int64))
                        ),
                        pa.array([m.tobytes() for m in marks], pa.binary()),
                    ],
                    names=["doc_id", "d", "u", "n", "c", "bands", "marks"],
                )

    return run


def _sets(size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for a, b, data, off in text_slices(batch.column("text")):
                h, first = shingle_sets(data, off, size)
                sets = [h[first[i] : first[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column("c").slice(a, b - a), pa.array(sets, pa.binary())], names=["c", "set"])

    return run


def _least_estimate(n: np.ndarray, percent: int) -> np.ndarray:
    """What a signature estimate must reach: 3.5 deviations below the required similarity."""
    s = percent / 100
    return s - 3.5 * np.sqrt(s * (1 - s) / np.minimum(BINS * 0.6, np.maximum(n, 4)))


def _estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal marks among the bins that either of two documents fills."""
    used = (x | y) > 0
    return ((x == y) & used).sum(axis=-1) / np.maximum(used.sum(axis=-1), 1)


def _marks(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BINS)


def _estimated(percent: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                e = _estimates(_marks(batch.column("ma")), _marks(batch.column("mb")))
                smaller = np.minimum(batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                ok = np.flatnonzero(e >= _least_estimate(smaller, percent))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a").take(pa.array(ok)), batch.column("b").take(pa.array(ok)), pa.array(e[ok])], names=["a", "b", "e"]
                )

    return run


def _confirmed(percent: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _near_pairs(t: pa.Table, percent: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(block, stray, members by falling estimate) for rows sorted by block.

    A pair belongs to the first bucket that its classes share, and a pair of two strays to the
    one with the smaller name.
    """
    columns = [t.column(k).to_numpy() for k in ("bucket", "sb", "mb")]
    new = np.zeros(t.num_rows, bool)
    for v in columns:
        new[1:] |= v[1:] != v[:-1]
    edges = np.r_[0, np.flatnonzero(new), t.num_rows]
    c, root = np.array(t.column("c").to_pylist(), object), np.array(t.column("root").to_pylist(), object)
    stray, outside, n = (t.column(k).to_numpy() for k in ("stray", "outside", "n"))
    marks = _marks(t.column("marks"))
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    for block, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        members = lo + np.flatnonzero(~stray[lo:hi])
        for i in lo + np.flatnonzero(stray[lo:hi]):
            m = members[100 * np.minimum(n[members], n[i]) >= percent * np.maximum(n[members], n[i])]
            m = m[(root[m] != root[i]) & (~outside[m] | (c[m] > c[i]))]
            m = m[bands[i][(bands[m] == bands[i]).argmax(axis=1)] == columns[0][i]]
            if len(m):
                e = _estimates(marks[m], marks[i])
                ok = e >= _least_estimate(np.minimum(n[m], n[i]), percent)
                if ok.any():
                    yield block, i, m[ok][np.argsort(-e[ok], kind="stable")]


def _candidates(percent: int) -> Callable[[Batches], Batches]:
    """Rows of blocks that are part of any pair which signatures let pass."""

    def run(batches: Batches) -> Batches:
        for t in whole_groups(batches, ["bucket", "sb", "mb"], 4 * BLOCK):
            used = np.zeros(t.num_rows, bool)
            for _, i, m in _near_pairs(t, percent):
                used[i] = used[m] = True
            yield from t.take(pa.array(np.flatnonzero(used))).to_batches()

    return run


def _settled(percent: int) -> Callable[[Batches], Batches]:
    """Links of blocks on full sets, as a forest over the components that meet in a block."""

    def run(batches: Batches) -> Batches:
        for t in whole_groups(batches, ["bucket", "sb", "mb"], 4 * BLOCK, 16 * BLOCK_SHINGLES):
            c, root, sets = t.column("c").to_pylist(), t.column("root").to_pylist(), t.column("set")
            parent: dict[tuple[int, bytes], tuple[int, bytes]] = {}

            def find(x: tuple[int, bytes]) -> tuple[int, bytes]:
                while (up := parent.get(x, x)) != x:  # noqa: B023
                    parent[x] = parent.get(up, up)  # noqa: B023
                    x = up
                return x

            out_a, out_b = [], []
            for block, i, near in _near_pairs(t, percent):
                own = np.frombuffer(sets[int(i)].as_py(), np.uint64)
                for m in near:
                    a, b = find((block, root[i])), find((block, root[m]))
                    if a == b:
                        continue
                    other = np.frombuffer(sets[int(m)].as_py(), np.uint64)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        parent[a] = b
                        out_a.append(c[i])
                        out_b.append(c[m])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"])

    return run


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more tasks than ``rows`` rows are worth, but as many as run at once.

    Many partitions of a few rows each would take their time for starting Python and writing files.
    """
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that broadcasts neither side: near-dedup has many, and the driver would hold a table for each."""
    return left.join(right.hint("merge"), on, how)


class _Links:
    """Candidate pairs to confirmed links, on signatures and sets that are computed once."""

    def __init__(self, classes: DataFrame, sets: DataFrame, percent: int):
        self.classes, self.sets, self.percent = classes, sets, percent
        self.rows = sets.count()

    def estimated(self, pairs: DataFrame, rows: int) -> DataFrame:
        """Pairs (a, b), of which there are at most ``rows``, that may reach the similarity, with their estimate."""
        facts = self.classes.select("c", "n", "marks")
        a, b = (facts.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("marks").alias(f"m{x}")) for x in "ab")
        close = F.lit(100) * F.least("na", "nb") >= F.lit(self.percent) * F.greatest("na", "nb")
        near = _met(_met(pairs, a, "a"), b, "b").where(close).select("a", "b", "na", "nb", "ma", "mb")
        return _dealt(near, rows).mapInArrow(_estimated(self.percent), "a binary, b binary, e double")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b), checked on the full sets; a class is ``a`` of one pair only."""
        a, b = (self.sets.select(F.col("c").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
        full = _met(_met(pairs.select("a", "b"), a, "a"), b, "b").select("a", "b", "sa", "sb")
        return _dealt(full, self.rows).mapInArrow(_confirmed(self.percent), "a binary, b binary")


def _mixed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (bucket, c, n, root) of buckets that hold several components, with their main one."""
    named = _met(buckets, roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    counts = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    mixed = counts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("k").alias("size"), F.sum("w").alias("weight"), F.max(F.struct("k", "root", "w")).alias("m"),
    ).where("parts > 1")
    return _met(named, mixed, "bucket").withColumn("main", F.col("m.root"))


def _settle(rest: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that still share a bucket; ``rest`` is of ``_mixed``."""
    wide = _met(rest.withColumn("outside", F.col("root") != F.col("main")), classes.select("c", "marks", "bands"), "c")
    blocks = lambda size, weight: F.ceil(F.greatest(size / BLOCK, weight / BLOCK_SHINGLES)).cast("int")
    outer = blocks(F.col("size") - F.col("m.k"), F.col("weight") - F.col("m.w"))
    every = blocks(F.col("size"), F.col("weight"))
    spread = lambda k: F.pmod(F.xxhash64("c"), k).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    fields = ["bucket", "c", "root", "n", "outside", "marks", "bands"]
    members = wide.select(*fields, F.lit(False).alias("stray"), each(outer).alias("sb"), spread(every).alias("mb"))
    strays = wide.where("outside").select(*fields, F.lit(True).alias("stray"), spread(outer).alias("sb"), each(every).alias("mb"))
    rows = members.unionAll(strays.select(members.columns))
    block = ["bucket", "sb", "mb"]
    near = staged(
        _dealt(rows.repartition(*block).sortWithinPartitions(*block), rest.count()).mapInArrow(
            _candidates(percent), "bucket long, c binary, root binary, n long, outside boolean, marks binary, bands array<long>, stray boolean, sb int, mb int"
        ),
        "near",
    )
    full = _met(near, sets, "c").repartition(*block).sortWithinPartitions(*block)
    return _dealt(full, near.count()).mapInArrow(_settled(percent), "a binary, b binary")


def _linked(named: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(signatures of all rows, (node, root) of the classes that links join)."""
    signed = staged(
        named.mapInArrow(
            _signatures(shingle),
            "doc_id long, d long, u long, n long, c binary, bands array<long>, marks binary",
        ),
        "signatures",
    )
    size = signed.count()
    classes = signed.where("c IS NOT NULL").groupBy("c", "n").agg(
        F.min(F.struct("d", "u")).alias("rep"), F.first("bands").alias("bands"), F.first("marks").alias("marks")
    )
    classes = staged(_dealt(classes, size), "classes")
    banded = classes.select("c", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(F.xxhash64("c"), "c")).getField("c").alias("centre"))
    buckets = staged(_dealt(_met(banded, shared.where("k > 1"), "bucket").select("bucket", "c", "n", "centre"), size), "buckets")
    # Only classes that share a bucket go on.
    met = staged(_dealt(_met(buckets.select("c").distinct(), classes, "c"), size), "met")
    texts = _met(named, met.select("c", "rep.d", "rep.u"), ["d", "u"]).select("d", "u", "c", "text").dropDuplicates(["d", "u"])
    sets = staged(_dealt(texts.select("c", "text"), met.count()).mapInArrow(_sets(shingle), "c binary, set binary"), "sets")
    links, held = _Links(met, sets, percent), buckets.count()

    rays = buckets.where("c <> centre").select(F.col("c").alias("a"), F.col("centre").alias("b")).distinct()
    best = links.estimated(rays, held).groupBy("a").agg(F.max(F.struct("e", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    found = staged(links.confirmed(best), "links")

    degrees = found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("c")).agg(F.count(F.lit(1)).alias("deg"))
    roots = components(found)
    mixed = _met(_mixed(buckets, roots), degrees, "c", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    hubs = mixed.groupBy("bucket").agg(F.max(F.struct("deg", "c", "root")).alias("hub"))
    pairs = _met(mixed, hubs, "bucket").where("root <> hub.root").select(F.col("c").alias("a"), F.col("hub.c").alias("b")).distinct()
    best = links.estimated(pairs, held).groupBy("a").agg(F.max(F.struct("e", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    found = staged(links.confirmed(best), "links")
    if not found.isEmpty():
        roots = merged(roots, found)

    rest = staged(_dealt(_mixed(buckets.drop("centre"), roots), held), "mixed")
    found = staged(_settle(rest, met, sets, percent), "links")
    if not found.isEmpty():
        roots = merged(roots, found)
    return signed, roots


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept; u, a hash that names the row; first.

    Two documents are linked if their distinct shingles overlap in ``percent`` of the union;
    component_id is the smallest id that links reach, and kept says that it is the row's own.
    Of a component's rows only those equal to the smallest by id and hash are ``first``.
    """
    i, t = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    named = docs.select(i.alias("doc_id"), F.coalesce(i, F.lit(_LAST)).alias("d"), F.xxhash64(i, t).alias("u"), t.alias("text"))
    with small_batches(docs.sparkSession, ROWS_AT_ONCE):
        signed, roots = _linked(named, shingle, percent)
    roots = roots.withColumnRenamed("node", "c")
    placed = _met(signed.select("doc_id", "d", "u", "n", "c"), roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    first = placed.groupBy("root").agg(F.min(F.struct("d", "u")).alias("first"))
    low = F.coalesce("first.d", "d")
    component = F.when(low != _LAST, low)
    return _met(placed, first, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), "u",
        F.coalesce(F.struct("d", "u") == F.col("first"), F.lit(True)).alias("first"),
    )


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id, in the columns of ``docs``.

    Of rows that share the smallest id one stays. Rows without words all stay.
    """
    i, t = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # Rows without words are neither compared nor numbered, so that many equal ones meet in no task.
    filled = t.rlike(r"[^\x20\x09-\x0D]")
    worded = docs.where(filled)
    stay = near_duplicates(worded, shingle, percent, id_col, text_col).where("first").select("u").distinct()
    # Repeats are dropped before the shuffle where they lie, and only then by hash.
    rows = worded.select(F.xxhash64(i, t).alias("u"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).dropDuplicates(["u"])
    return _met(rows, stay, "u").select("row.*").unionAll(docs.where(~filled))
