"""Benchmark decontamination by latent semantic retrieval.

Passages of the corpus and of the benchmark are TF-IDF vectors of hashed words. A randomised SVD
gives a basis of a few dozen latent directions; in it, a passage that contains a benchmark item,
or says it in other words, points where the item points. Every passage of every document is
compared with the items by cosine, and what comes close is checked: the longest common
subsequence of words must cover enough of the item, and so must the item's answer.

* Frequencies are counted over all blocks of all documents; in a block a term counts once.
* The basis is fitted on all items and on all passages of ``3 * BLOCK`` words of all documents, as
  often as they occur. Together the passages weigh as much as ``CORPUS_ROWS`` rows, so that a large
  corpus does not drown the items. The matrix is never stored: a pass cuts it from the texts anew,
  multiplies it with a tall matrix and sums the tasks' products by rows of terms. A task reads its
  texts once and holds one product of all columns, and there are no more tasks than the session runs
  at once, so memory and shuffle of a pass have a bound. A caller may name ``sample_docs`` to fit on that many documents
  only, chosen by a hash of id and text; rows that agree in both are one document of it.
* An item part whose words stand in a row in a document is checked whatever its cosine: positions
  of its first words are looked up by hash, then all its words are compared.
* The search reads whole documents, block by block. Neighbouring blocks of ``BLOCK`` words make
  passages as long as an item and a block, so that each item lies whole in some passage. Items
  longer than ``PART`` words are searched in parts. A benchmark is searched ``item_rows`` items at
  a time, in as many passes as it needs; distinct items are numbered in a staged table, and the
  driver reads one range of numbers per pass.

The answer is what a reader must not have seen: the last sentence of an item or, if that is shorter
than three words or all there is, its last third. Letters A to Z are folded, and punctuation
separates words. Documents and items without words match nothing, null ids are kept, and rows that
repeat are found each.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.llm.words import PUNCTUATION, mix, split_words, text_slices
from tickwise.session import small_batches, staged

Batches = Iterator[pa.RecordBatch]
TERMS = 1 << 18
BLOCK = 16
PART = 64
RANK = 64
OVERSAMPLE = 10
POWER = 1
PASSAGE = 3 * BLOCK
SAMPLE_PASSAGES = 3
CORPUS_ROWS = 750
SLAB = 37
TASK_BLOCKS = 1 << 20
PASSAGES_AT_ONCE = 4_096
#: Rows that a pass of the fit hands to Python at once; beside its product a task holds little else.
ROWS_AT_ONCE = 500
ITEM_WEIGHT = 4.0
ITEM_ROWS = 4_000
COSINE = 0.72
COVER = 0.6
ANSWER = 0.5
TERM_CHUNK = 4_096
#: Partitions in which the driver fetches a pass's sums, about 1 MB a chunk.
FETCHES = 32
HEAD = 5


def _terms(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(TERMS - 1)).astype(np.int64)


def _blocks(words) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each block, its text). A block never crosses a text's end."""
    owner = words.text_of_word()
    start = np.flatnonzero((np.arange(len(owner)) - words.first[owner]) % BLOCK == 0)
    return start, owner[start]


def _grid(words, width: int) -> np.ndarray:
    """Terms of consecutive passages of ``width`` words, one to a row; -1 where a text ends earlier."""
    n = np.diff(words.first)
    rows = -(-n // width)
    out = np.full((int(rows.sum()), width), -1, np.int32)
    # A text begins a row, however many places its predecessor leaves empty.
    shift = np.cumsum(rows) * width - rows * width - words.first[:-1]
    out.ravel()[np.arange(len(words.hashes)) + np.repeat(shift, n)] = _terms(words.hashes)
    return out


def _once(grid: np.ndarray) -> np.ndarray:
    """Rows of terms in order, further occurrences within a row as -1."""
    out = np.sort(grid, axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return out


def _frequencies(batches: Batches) -> Batches:
    """(chunk, part): in how many blocks of a task each term of a chunk occurs; chunk -1 counts blocks and passages."""
    total, counted = np.zeros(TERMS, np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for _, _, data, off in text_slices(batch.column("text")):
            words = split_words(data, off, True, PUNCTUATION)
            grid = _once(_grid(words, BLOCK))
            total += np.bincount(grid[grid >= 0], minlength=TERMS)
            counted += len(grid), int((-(-np.diff(words.first) // PASSAGE)).sum())
    chunks = [c for c in range(0, TERMS, TERM_CHUNK) if total[c : c + TERM_CHUNK].any()]
    parts = [counted.tobytes(), *(total[c : c + TERM_CHUNK].tobytes() for c in chunks)]
    yield pa.RecordBatch.from_arrays([pa.array([-1, *chunks], pa.int64()), pa.array(parts, pa.binary())], names=["chunk", "part"])


def _counted(t: pa.Table) -> pa.Table:
    parts = [np.frombuffer(p.as_py(), np.int64) for p in t.column("part")]
    return pa.table({"chunk": t.column("chunk")[:1], "part": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())})


@dataclass
class Frequencies:
    """In how many blocks each hashed term occurs, the number of blocks and of passages, and inverse frequencies."""

    n: np.ndarray
    blocks: int
    passages: int
    idf: np.ndarray


def frequencies(docs: DataFrame) -> Frequencies:
    """Counts over all blocks of all documents: as many numbers as there are hash values."""
    schema = "chunk long, part binary"
    n, blocks, passages = np.zeros(TERMS, np.int64), 0, 0
    with small_batches(docs.sparkSession, ROWS_AT_ONCE):
        found = docs.select("text").mapInArrow(_frequencies, schema).groupBy("chunk").applyInArrow(_counted, schema).collect()
    for r in found:
        own = np.frombuffer(r.part, np.int64)
        if r.chunk < 0:
            blocks, passages = own.tolist()
        else:
            n[r.chunk : r.chunk + len(own)] = own
    return Frequencies(n, blocks, passages, np.log((blocks + 1) / (n + 1)).clip(0).astype(np.float32))


def _sampled(passages: int) -> Callable[[Batches], Batches]:
    """Terms of some passages of each document, evenly spaced over its whole length, of each ``u`` once per task."""

    def run(batches: Batches) -> Batches:
        seen: set[int] = set()
        for batch in batches:
            us, out, of, nth = batch.column("u").to_pylist(), [], [], []
            for a, b, data, off in text_slices(batch.column("text")):
                w = split_words(data, off, True, PUNCTUATION)
                for i in range(b - a):
                    if us[a + i] in seen:
                        continue
                    seen.add(us[a + i])
                    h = _terms(w.hashes[w.first[i] : w.first[i + 1]])
                    for j in range(passages):
                        at = j * len(h) // passages
                        if len(h[at : at + PASSAGE]):
                            out.append(h[at : at + PASSAGE].astype(np.int32).tobytes())
                            of.append(us[a + i])
                            nth.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(nth, pa.int32()), pa.array(out, pa.binary())], names=["u", "nth", "terms"])

    return run


def _rows_times(x: np.ndarray, at: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Sums of the rows ``at`` of ``x``, weighted with ``v``: one per row of ``at``."""
    out = np.empty((len(at), x.shape[1]), np.float32)
    for lo in range(0, len(at), 64):
        own = at[lo : lo + 64]
        out[lo : lo + 64] = np.matmul(v[lo : lo + 64, None, :], x.take(own.ravel(), axis=0).reshape(*own.shape, -1))[:, 0]
    return out


def _rows_of(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the rows of ``x`` that ``at`` names, once each and in single precision, ``at`` as numbers among these).

    A row is named many times; widened here, it is not widened again for each of them.
    """
    named = np.zeros(len(x), bool)
    named[at.ravel()] = True
    rows = np.flatnonzero(named)
    number = np.empty(len(x), np.int32)
    number[rows] = np.arange(len(rows), dtype=np.int32)
    return x[rows].astype(np.float32), number[at]


def _add_transposed(out: np.ndarray, z: np.ndarray, at: np.ndarray, v: np.ndarray) -> None:
    """Add ``v`` times row p of ``z`` to row ``at`` of ``out`` for each place in row p of ``at``.

    Each term's places are gathered and summed at once, together with those of terms that have about as many.
    """
    known = np.flatnonzero(v.ravel())
    if not len(known):
        return
    # Sorted as one number: by term, then by place.
    both = np.sort(at.ravel()[known].astype(np.int64) << 32 | known)
    terms, source = both >> 32, both & 0xFFFFFFFF
    weight, source = v.ravel()[source], source // at.shape[1]
    head = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
    count = np.diff(np.r_[head, len(terms)])
    less, most = 0, 1
    while less < count.max():
        mine = np.flatnonzero((count > less) & (count <= most))
        step = max(1, 4_096 // most)
        for lo in range(0, len(mine), step):
            own = mine[lo : lo + step]
            inside = np.arange(most) < count[own][:, None]
            place = np.where(inside, head[own][:, None] + np.arange(most), 0)
            if most == 1:
                sums = z.take(source[place[:, 0]], axis=0)
                sums *= weight[place]
            else:
                sums = _rows_times(z, source[place], np.where(inside, weight[place], np.float32(0)))
            out[terms[head[own]]] += sums
        less, most = most, most * 2


def _signs(rows: int, width: int) -> np.ndarray:
    """The random matrix that the first pass takes for X: 1 and -1, the same in every task."""
    x = np.empty((rows, width), np.int8)
    for k in range(0, width, SLAB):
        x[:, k : k + SLAB] = np.random.Generator(np.random.PCG64([8, k])).integers(0, 2, (rows, min(SLAB, width - k)), np.int8)
    x += x
    x -= 1
    return x


def _product(shipped, width: int) -> Callable[[Batches], Batches]:
    """A task's part of A'(A X), in chunks of the vocabulary.

    A row of A is given by its terms, or a text gives a row for each of its passages.
    """

    def grids(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        weight = batch.column("weight").to_numpy()
        terms = [np.frombuffer(t or b"", np.int32) for t in batch.column("terms").to_pylist()]
        if any(map(len, terms)):
            grid = np.full((len(terms), max(map(len, terms))), -1, np.int32)
            for row, t in zip(grid, terms, strict=True):
                row[: len(t)] = t
            yield grid, weight
        for a, _, data, off in text_slices(batch.column("text")):
            words = split_words(data, off, True, PUNCTUATION)
            if len(words.hashes):
                passages = -(-np.diff(words.first) // PASSAGE)
                yield _grid(words, PASSAGE), np.repeat(weight[a : a + len(passages)], passages)

    def gathered(batches: Batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """About ``PASSAGES_AT_ONCE`` rows of one width at a time: the more, the more often a term is in them."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for grid, weight in (x for batch in batches for x in grids(batch)):
            if held and (held[0][0].shape[1] != grid.shape[1] or sum(len(w) for _, w in held) >= PASSAGES_AT_ONCE):
                yield np.concatenate([g for g, _ in held]), np.concatenate([w for _, w in held])
                held = []
            for lo in range(0, len(grid), PASSAGES_AT_ONCE):
                held.append((grid[lo : lo + PASSAGES_AT_ONCE], weight[lo : lo + PASSAGES_AT_ONCE]))
                if lo + PASSAGES_AT_ONCE < len(grid):
                    yield np.concatenate([g for g, _ in held]), np.concatenate([w for _, w in held])
                    held = []
        if held:
            yield np.concatenate([g for g, _ in held]), np.concatenate([w for _, w in held])

    def run(batches: Batches) -> Batches:
        x, place, idf = shipped.value
        if x is None:
            x = _signs(int(place.max()) + 1, width)
        out = np.zeros(x.shape, np.float32)
        for grid, weight in gathered(batches):
            v = np.where(grid >= 0, idf[grid], np.float32(0))
            v *= (weight / np.maximum(1e-12, np.sqrt(np.einsum("ij,ij->i", v, v))))[:, None].astype(np.float32)
            at = np.where(grid >= 0, place[grid], 0)
            rows, local = _rows_of(x, at)
            _add_transposed(out, _rows_times(rows, local, v), at, v)
        # One chunk to a batch, so that neither side holds a second copy of all of them.
        for c in range(0, len(out), TERM_CHUNK):
            if out[c : c + TERM_CHUNK].any():
                part = pa.array([out[c : c + TERM_CHUNK].tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), part], names=["chunk", "part"])

    return run


def _summed(t: pa.Table) -> pa.Table:
    """A chunk, summed over the tasks."""
    parts = t.column("part")
    whole = np.frombuffer(parts[0].as_py(), np.float32).copy()
    for part in parts[1:]:
        whole += np.frombuffer(part.as_py(), np.float32)
    return pa.table({"chunk": t.column("chunk")[:1], "part": pa.array([whole.tobytes()], pa.binary())})


def _inverse_root(gram: np.ndarray, least: float) -> np.ndarray:
    """Columns that make what has this matrix of scalar products orthonormal; directions without weight are left out."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    kept = values > least * max(values[-1], 1e-30)
    return vectors[:, kept] / np.sqrt(values[kept])


def randomised_basis(rows: DataFrame, idf: np.ndarray, vocabulary: np.ndarray, rank: int = RANK, power: int = POWER) -> np.ndarray:
    """Right singular vectors (vocabulary x at most rank) of the TF-IDF rows (terms or text, weight).

    With Y = A'A X, A'A is taken as Y inv(X'Y) Y': its vectors lie in the span of Y, as after another
    pass over X made from Y, which is saved. X is near to orthonormal: it is shipped in half precision,
    and what was shipped is X.
    """
    sc, schema = rows.sparkSession.sparkContext, "chunk long, part binary"
    place = np.full(TERMS, -1, np.int32)
    place[vocabulary] = np.arange(len(vocabulary))
    width = min(rank + OVERSAMPLE, len(vocabulary))
    x = None
    for _ in range(max(1, power) + 1):
        half = None if x is None else _halved(x)
        shipped = sc.broadcast((half, place, idf))
        if x is not None:
            _widened(half, x)
        parts = rows.mapInArrow(_product(shipped, width), schema)
        y = np.zeros((len(vocabulary), width), np.float32) if x is None else x
        inner, outer = np.zeros((width, width)), np.zeros((width, width))
        seen = set()
        # The driver fetches a partition at once. With their number given, few chunks stay in each.
        for p in parts.repartition(FETCHES, "chunk").groupBy("chunk").applyInArrow(_summed, schema).toLocalIterator():
            own = np.frombuffer(p.part, np.float32).reshape(-1, width)
            mine = y[p.chunk : p.chunk + len(own)]
            inner += mine.T.astype(float) @ own
            outer += own.T.astype(float) @ own
            # X is no longer needed where Y is known.
            mine[:] = own
            seen.add(p.chunk)
        for c in range(0, len(y), TERM_CHUNK):
            if c not in seen:
                y[c : c + TERM_CHUNK] = 0
        shipped.destroy()
        if x is not None:
            root = _inverse_root(inner, 1e-6)
            values, vectors = np.linalg.eigh(root.T @ outer @ root)
            best = [i for i in np.argsort(-values)[:rank] if values[i] > 1e-9 * max(values[-1], 1e-30)]
            turned = root @ vectors[:, best] / np.sqrt(values[best])
        else:
            turned = _inverse_root(outer, 1e-9)
        # Entries of about one for half precision; the basis itself has columns of length one.
        x, width = _turned(y, turned * (len(y) ** 0.5 if x is None else 1)), turned.shape[1]
        if not width:
            return np.zeros((len(vocabulary), 1), np.float32)
    return x


def _halved(x: np.ndarray) -> np.ndarray:
    """``x`` in half precision, in the front of its own memory."""
    out = x.reshape(-1).view(np.float16)[: x.size].reshape(x.shape)
    for c in range(0, len(x), TERM_CHUNK):
        out[c : c + TERM_CHUNK] = x[c : c + TERM_CHUNK].astype(np.float16)
    return out


def _widened(half: np.ndarray, x: np.ndarray) -> None:
    """Set ``x``, in the front of whose memory ``half`` lies, to its values, from the back."""
    for c in reversed(range(0, len(x), TERM_CHUNK)):
        x[c : c + TERM_CHUNK] = half[c : c + TERM_CHUNK].astype(np.float32)


def _turned(y: np.ndarray, by: np.ndarray) -> np.ndarray:
    """``y @ by``, which has no more columns, in the memory of ``y``: rows written never reach rows still to be read."""
    out = y.reshape(-1)[: len(y) * by.shape[1]].reshape(len(y), by.shape[1])
    for c in range(0, len(y), TERM_CHUNK):
        out[c : c + TERM_CHUNK] = y[c : c + TERM_CHUNK] @ by
    return out


@dataclass
class Index:
    """Latent vectors of item parts, and what is needed to verify them."""

    place: np.ndarray
    table: np.ndarray
    vectors: np.ndarray
    span: np.ndarray
    item: list
    words: list[tuple[int, ...]]
    answer: list[tuple[int, ...]]
    heads: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each position on that has as many."""
    out = hashes[: max(0, len(hashes) - n + 1)]
    for k in range(1, n):
        out = mix(out) + hashes[k : k + len(out)]
    return out


def _heads(parts: list[tuple[int, ...]]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, sorted hashes, parts, which low bits occur) of the first words of all parts, for each number of words."""
    out = []
    for n in sorted({min(HEAD, len(w)) for w in parts}):
        mine = [i for i, w in enumerate(parts) if min(HEAD, len(w)) == n]
        keys = np.concatenate([_runs(np.array(parts[i][:n], np.uint64), n) for i in mine])
        order = np.argsort(keys, kind="stable")
        low = np.zeros(TERMS, bool)
        low[_terms(keys)] = True
        out.append((n, keys[order], np.array(mine)[order], low))
    return out


def _folded(text: str | None) -> list[int]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return split_words(data, np.array([0, len(data)]), True, PUNCTUATION).hashes.tolist()


def answer_of(text: str) -> list[int]:
    """Words of an item's answer."""
    whole = _folded(text)
    last = _folded(re.split(r"(?<=[.!?])\s+", text.strip())[-1])
    return last if 3 <= len(last) < len(whole) else whole[-max(1, len(whole) // 3) :]


def _sample(docs: DataFrame, sample_docs: int) -> list[bytes]:
    """Terms of some passages of at most ``sample_docs`` documents."""
    keyed = docs.select("text", F.xxhash64(F.lit(8), "doc_id", "text").alias("u"))
    # As many rows as the sample may have documents, each of which may occur many times in the table.
    chosen = keyed.select("u").distinct().orderBy("u").limit(sample_docs)
    passages = keyed.join(F.broadcast(chosen), "u").select("text", "u").mapInArrow(_sampled(SAMPLE_PASSAGES), "u long, nth int, terms binary")
    return [r.terms for r in sorted(passages.dropDuplicates(["u", "nth"]).collect(), key=lambda r: (r.u, r.nth))]


def build_index(docs: DataFrame, items: list[tuple], sample_docs: int | None = None, rank: int = RANK, counts: Frequencies | None = None) -> Index | None:
    """Index of (id, text) items, fitted on all documents or on ``sample_docs`` of them; None if no item has words."""
    spark = docs.sparkSession
    counts = frequencies(docs) if counts is None else counts
    idf = counts.idf
    parts = []
    for item, text in items:
        words = _folded(text)
        answer = answer_of(text) if words else []
        for at in range(0, len(words), PART):
            own = words[at : at + PART]
            if len(own) >= min(5, len(words)):
                parts.append((item, tuple(own), tuple(answer) if at + PART >= len(words) else tuple(own[-max(1, len(own) // 3) :])))
    if not parts:
        return None
    terms = [_terms(np.array(w, np.uint64)).astype(np.int32) for _, w, _ in parts]
    schema = "terms binary, text string, weight double"
    own = spark.createDataFrame([(t.tobytes(), None, ITEM_WEIGHT) for t in terms], schema)
    if sample_docs is None:
        weight = (min(counts.passages, CORPUS_ROWS) / max(1, counts.passages)) ** 0.5
        whole = docs.select(F.lit(None).cast("binary").alias("terms"), "text", F.lit(weight).alias("weight"))
        tasks = min(-(-max(1, counts.blocks) // TASK_BLOCKS), max(1, spark.sparkContext.defaultParallelism))
        rows = own.coalesce(1).unionAll(whole).coalesce(tasks)
        vocabulary = np.union1d(np.flatnonzero(counts.n), np.concatenate(terms))
    else:
        sampled = _sample(docs, sample_docs)
        rows = own.unionAll(spark.createDataFrame([(t, None, 1.0) for t in sampled], schema)).repartition(4) if sampled else own
        vocabulary = np.unique(np.concatenate([*terms, *[np.frombuffer(t, np.int32) for t in sampled]]))
    with small_batches(spark, ROWS_AT_ONCE):
        basis = randomised_basis(rows, idf, vocabulary, rank)
    place = np.full(TERMS, -1, np.int32)
    place[vocabulary] = np.arange(len(vocabulary))
    basis *= idf[vocabulary][:, None]
    # Every task holds the table; only its directions count, and three digits of them are enough.
    basis *= np.float32(1_000 / max(1e-30, float(basis.max()), -float(basis.min())))
    table = basis.astype(np.float16)
    vectors = np.stack([table[place[t]].astype(np.float32).sum(axis=0) for t in terms])
    vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1))[:, None]
    span = np.array([-(-(len(w) + BLOCK - 1) // BLOCK) for _, w, _ in parts])
    return Index(place, table, vectors.astype(np.float32), span, [i for i, _, _ in parts], [w for _, w, _ in parts], [a for _, _, a in parts], _heads([w for _, w, _ in parts]))


def _masks(a: tuple[int, ...]) -> dict[int, int]:
    """At which places of ``a`` each of its words stands, as bits."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def common_subsequence(a: tuple[int, ...], b: list[int], masks: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, a row of bits per step; ``masks`` are those of ``a``, if known."""
    masks = _masks(a) if masks is None else masks
    full = (1 << len(a)) - 1
    row = full
    # Words that do not stand in ``a`` leave the row as it is.
    for mask in filter(None, map(masks.get, b)):
        hit = row & mask
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _search(shipped, cosine: float, cover: float, answer: float) -> Callable[[Batches], Batches]:
    def copies(index: Index, words, start: np.ndarray) -> dict[int, set[tuple[int, int]]]:
        """By span, (block, part) of the parts whose words stand in a row from within a block on."""
        found: dict[int, set[tuple[int, int]]] = {}
        for n, keys, parts, known in index.heads:
            runs = _runs(words.hashes, n)
            # Few runs share their low bits with an item; only these are looked up.
            maybe = np.flatnonzero(known.take(_terms(runs)))
            low, high = np.searchsorted(keys, runs[maybe], "left"), np.searchsorted(keys, runs[maybe], "right")
            for at, own_low, own_high in zip(maybe[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                block = int(np.searchsorted(start, at, "right")) - 1
                end = int(words.first[np.searchsorted(words.first, at, "right")])
                for i in parts[own_low:own_high].tolist():
                    own = index.words[i]
                    if at + len(own) <= end and (block, i) not in found.get(int(index.span[i]), ()) and tuple(words.hashes[at : at + len(own)].tolist()) == own:
                        found.setdefault(int(index.span[i]), set()).add((block, i))
        return found

    def candidates(index: Index, table: np.ndarray, words) -> Iterator[tuple[int, int, int, int, float]]:
        """(part, text, first word, end, cosine) of passages that come close."""
        start, text = _blocks(words)
        if not len(start):
            return
        # A term counts once per block, so that a repeated word cannot outweigh all others.
        grid = _once(_grid(words, BLOCK))
        at = np.where(grid >= 0, index.place[grid], -1)
        sums = _rows_times(table, np.maximum(at, 0), (at >= 0).astype(np.float32))
        whole = copies(index, words, start)
        passage = sums.copy()
        for span in range(1, int(index.span.max()) + 1):
            if span > 1 and span <= len(start):
                shift = span - 1
                passage[:-shift] += sums[shift:] * (text[shift:] == text[:-shift])[:, None]
            mine = np.flatnonzero(index.span == span)
            if len(mine):
                norm = np.maximum(1e-9, np.linalg.norm(passage, axis=1))
                near = passage @ index.vectors[mine].T
                near /= norm[:, None]
                close = near >= cosine
                for block, part in whole.get(span, ()):
                    close[block, np.searchsorted(mine, part)] = True
                for p, i in zip(*np.divmod(np.flatnonzero(close), len(mine)), strict=True):
                    first = max(int(words.first[text[p]]), int(start[p]) - BLOCK)
                    end = min(int(words.first[text[p] + 1]), int(start[p]) + (span + 1) * BLOCK)
                    yield int(mine[i]), int(text[p]), first, end, float(near[p, i])

    def run(batches: Batches) -> Batches:
        index = shipped.value
        # Products in half precision are slow. A worker keeps one copy only.
        table = index.table = index.table.astype(np.float32, copy=False)
        masks = functools.cache(lambda part: (_masks(index.words[part]), _masks(index.answer[part])))
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            doc, item, cos, lcs, ans = [], [], [], [], []
            for a, _, data, off in text_slices(batch.column("text")):
                words = split_words(data, off, True, PUNCTUATION)
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                for part, text, first, end, near in candidates(index, table, words):
                    region = words.hashes[first:end].tolist()
                    own = index.words[part]
                    share = common_subsequence(own, region, masks(part)[0]) / len(own)
                    if share < (cover if len(own) >= 5 else 1.0):
                        continue
                    told = common_subsequence(index.answer[part], region, masks(part)[1]) / len(index.answer[part])
                    if told >= answer:
                        key = (text, part)
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (share, told, near))
                for (text, part), (share, told, near) in sorted(best.items()):
                    doc.append(ids[a + text])
                    item.append(index.item[part])
                    cos.append(near)
                    lcs.append(share)
                    ans.append(told)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(item, pa.int64()), *[pa.array(x, pa.float64()) for x in (cos, lcs, ans)]],
                names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"],
            )

    return run


def _flagged(search: Callable[[Batches], Batches], names: list[str]) -> Callable[[Batches], Batches]:
    """Rows of a batch that the search finds nothing in."""

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []

        def numbered() -> Batches:
            for batch in batches:
                held.append(batch)
                yield pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column("text")], names=["doc_id", "text"])

        # The search answers each batch with one of its own before it takes the next.
        for found in search(numbered()):
            batch = held.pop()
            hit = np.zeros(batch.num_rows, bool)
            hit[found.column("doc_id").to_numpy()] = True
            yield batch.filter(pa.array(~hit)).select(names)

    return run


def numbered(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, text, n) of the distinct items, numbered without gaps in their order, and how many they are."""
    items = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text")
    placed = staged(items.withColumn("at", F.monotonically_increasing_id()), "items")
    # One row per partition: the upper bits of ``at`` are its number, the lower 33 count in it.
    parts = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("k")).orderBy("part").collect()
    before, total = [], 0
    for r in parts:
        before.append((r.part, total))
        total += r.k
    offsets = benchmark.sparkSession.createDataFrame(before, "part long, before long")
    own = placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(offsets), "part")
    return own.select("item_id", "text", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("n")), total


def _passes(docs: DataFrame, benchmark: DataFrame, item_rows: int, sample_docs: int | None, rank: int) -> Iterator[Index]:
    """Indexes of the benchmark, ``item_rows`` items each."""
    items, total = numbered(benchmark)
    counts = frequencies(docs) if total else None
    for at in range(0, total, item_rows):
        # At most item_rows rows.
        own = items.where((F.col("n") >= at) & (F.col("n") < at + item_rows)).orderBy("n").collect()
        index = build_index(docs, [(r.item_id, r.text) for r in own], sample_docs, rank, counts)
        if index is not None:
            yield index


def leaks(
    docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, cover: float = COVER, answer: float = ANSWER,
    item_rows: int = ITEM_ROWS, sample_docs: int | None = None, rank: int = RANK,
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share) for each document and item part it contains."""
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
    found = docs.sparkSession.createDataFrame([], schema)
    for index in _passes(docs, benchmark, item_rows, sample_docs, rank):
        shipped = docs.sparkSession.sparkContext.broadcast(index)
        found = found.unionAll(docs.select("doc_id", "text").mapInArrow(_search(shipped, cosine, cover, answer), schema))
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "lcs_share", "answer_share")])


def without_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, cover: float = COVER, answer: float = ANSWER) -> DataFrame:
    """Rows of ``docs`` that contain no item."""
    out = docs
    for index in _passes(docs, benchmark, ITEM_ROWS, None, RANK):
        shipped = docs.sparkSession.sparkContext.broadcast(index)
        out = out.mapInArrow(_flagged(_search(shipped, cosine, cover, answer), docs.columns), docs.schema)
    return out
