"""Ranked lexical search with MaxScore over pair bounds.

The documents are cut into segments; each is an inverted index of its own, one row of a table in
the shared folder, with a posting list (document, frequency) for every term that some query holds.
Segments grow with the corpus in number only, and every task works on a few whole ones.

1. *Index.* One pass over the whole texts writes the segments. The number of documents, all their
   terms and the documents per term are sums over the segments.
2. *Pair lists.* The terms of a query are paired. For every pair a segment gets the intersection
   of its two lists and the joint maximum: the highest score that the two terms give any one
   document together. That is at most the sum of the two maxima, and mostly far below it.
3. *First thresholds.* A number of segments is searched in full. The k-th best of any part of
   the corpus is a bound below which no document of the whole can rank.
4. *Search.* In each segment the pairs of a query are ordered by their bounds. Pairs whose bounds
   together stay below the threshold cannot lift a document by themselves: their lists are read
   only for documents found otherwise. A pair for which one term alone would stay below the
   threshold, but both together would not, offers only the documents of its intersection. Candidates
   are dropped as soon as what is left cannot lift them. Segments whose bounds stay below as a
   whole are not read further.
5. *Ranking.* The best of each segment and query are ranked over the corpus.

Scores are integers, so the result does not depend on segments, thresholds or the order of sums.
A document without terms, null or empty, is in no list and does not count. Every row is a document
and every query row a query of its own, whether ids repeat or not; a null doc_id ranks after all others
with its score. Queries without terms have no result. Only one block of queries is ever held in memory.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwise.llm.words import PUNCTUATION, split_words, text_slices
from tickwise.session import staged

K1_TENTHS = 12
B_PERCENT = 25
SEGMENT_DOCS = 4_096
SEGMENT_BYTES = 4 << 20
SEED_SEGMENTS = 32
BLOCK_QUERIES = 2_000
BLOCK_CHARS = 4_000_000
_NULL_ID = (1 << 63) - 1
_LISTS = ("docs", "sizes", "terms", "ends", "members", "counts")
Batches = Iterator[pa.RecordBatch]


def terms_of(text: str | None) -> np.ndarray:
    """Hashes of a text's terms in order: runs of ASCII letters and digits and all bytes above, A to Z folded."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return split_words(data, np.array([0, len(data)]), True, PUNCTUATION).hashes


@dataclass
class Segment:
    """Posting lists of some documents: list ``i`` is that of ``terms[i]``."""

    docs: np.ndarray
    sizes: np.ndarray
    terms: np.ndarray
    ends: np.ndarray
    members: np.ndarray
    counts: np.ndarray

    def impacts(self, weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
        """What each posting adds to a score that holds its term once."""
        m = 100 - B_PERCENT + (B_PERCENT * self.sizes * n_docs) // n_terms
        tf = self.counts.astype(np.int64)
        part = (1_000_000_000 * tf) // (1_000 * tf + K1_TENTHS * m[self.members])
        return part * np.repeat(weights[self.terms], np.diff(np.r_[0, self.ends]))


_TYPES = {"docs": np.int64, "sizes": np.int64, "terms": np.int32, "ends": np.int64, "members": np.uint16, "counts": np.uint32}


def _segment(batch: pa.RecordBatch, i: int) -> Segment:
    return Segment(*[np.frombuffer(batch.column(c)[i].as_py(), _TYPES[c]) for c in _LISTS])


def _index(vocabulary) -> Callable[[Batches], Batches]:
    """A row per segment: its lists, and its sums of documents and terms."""

    def run(batches: Batches) -> Batches:
        known = vocabulary.value
        order = np.argsort(known, kind="stable")
        ranked = known[order]
        task = TaskContext.get().partitionId() << 32
        docs, sizes, postings = [], [], []
        held = held_bytes = nth = 0

        def close() -> pa.RecordBatch:
            nonlocal held, held_bytes, nth
            member, term, count = (np.concatenate(x) for x in zip(*postings, strict=True))
            by_term = np.lexsort((member, term))
            member, term, count = member[by_term], term[by_term], count[by_term]
            last = np.flatnonzero(np.r_[term[1:] != term[:-1], True]) if len(term) else np.empty(0, np.int64)
            size = np.concatenate(sizes)
            values = (np.concatenate(docs), size, term[last], last + 1, member, count)
            row = [pa.array([task + nth]), pa.array([len(size)]), pa.array([int(size.sum())])]
            row += [pa.array([v.astype(_TYPES[c]).tobytes()], pa.binary()) for c, v in zip(_LISTS, values, strict=True)]
            docs.clear(), sizes.clear(), postings.clear()
            held = held_bytes = 0
            nth += 1
            return pa.RecordBatch.from_arrays(row, names=["segment", "n_docs", "n_terms", *_LISTS])

        for batch in batches:
            ids = batch.column("d").to_numpy(zero_copy_only=False)
            for a, b, data, off in text_slices(batch.column("text")):
                w = split_words(data, off, True, PUNCTUATION)
                size = np.diff(w.first)
                at = np.searchsorted(ranked, w.hashes)
                at[at == len(ranked)] = 0
                hit = np.flatnonzero(ranked[at] == w.hashes) if len(ranked) else np.empty(0, np.int64)
                pair, count = np.unique(w.text_of_word()[hit] * len(known) + order[at[hit]], return_counts=True)
                text = pair // max(1, len(known))
                full = np.flatnonzero(size)
                place = np.cumsum(size > 0) - 1
                # A slice may hold more documents than a segment.
                for lo in range(0, len(full), SEGMENT_DOCS):
                    part = full[lo : lo + SEGMENT_DOCS]
                    if held and held + len(part) > SEGMENT_DOCS:
                        yield close()
                    mine = (place[text] >= lo) & (place[text] < lo + SEGMENT_DOCS)
                    docs.append(ids[a:b][part])
                    sizes.append(size[part])
                    postings.append((place[text[mine]] - lo + held, pair[mine] % max(1, len(known)), count[mine]))
                    held += len(part)
                    held_bytes += len(data)
                    if held_bytes >= SEGMENT_BYTES:
                        yield close()
        if held:
            yield close()

    return run


@dataclass
class Plan:
    """A block of queries: per query its terms (by number) with their repeats, as pairs."""

    numbers: list[int]
    units: list[list[tuple[int, int, int, int]]]
    pairs: list[tuple[int, int, int, int]]
    weights: np.ndarray
    n_docs: int
    n_terms: int

    def pair_number(self) -> dict[tuple[int, int, int, int], int]:
        return {p: i for i, p in enumerate(self.pairs)}


def plan_queries(queries: list[tuple[int, Counter]], weights: np.ndarray, n_docs: int, n_terms: int) -> Plan:
    """Pair each query's terms, heaviest with next heaviest: rare terms that seldom meet, common ones that
    differ little. A unit is (term, repeats, other term, its repeats), the other -1 if one is left over."""
    units, pairs = [], {}
    for _, terms in queries:
        ranked = sorted(terms, key=lambda t: (-int(weights[t]) * terms[t], t))
        mine = []
        for a, b in zip(ranked[::2], [*ranked[1::2], -1], strict=False):
            unit = (a, terms[a], b, terms[b] if b >= 0 else 0)
            mine.append(unit)
            if b >= 0:
                pairs.setdefault(unit, None)
        units.append(mine)
    return Plan([n for n, _ in queries], units, list(pairs), weights, n_docs, n_terms)


def _lists(segment: Segment, impacts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    starts = np.r_[0, segment.ends[:-1]]
    return {
        int(t): (segment.members[a:b].astype(np.int64), impacts[a:b])
        for t, a, b in zip(segment.terms, starts, segment.ends, strict=True)
    }


def _pair_lists(shipped) -> Callable[[Batches], Batches]:
    """Per segment the pairs that meet in it: joint maxima and intersections."""

    def run(batches: Batches) -> Batches:
        plan = shipped.value
        for batch in batches:
            for i in range(batch.num_rows):
                segment = _segment(batch, i)
                lists = _lists(segment, segment.impacts(plan.weights, plan.n_docs, plan.n_terms))
                number, joint, size, members = [], [], [], []
                score = np.zeros(len(segment.docs), np.int64)
                for n, (a, times_a, b, times_b) in enumerate(plan.pairs):
                    if a not in lists or b not in lists:
                        continue
                    (docs_a, add_a), (docs_b, add_b) = lists[a], lists[b]
                    score[docs_a] = add_a * times_a
                    both = score[docs_b] > 0
                    if both.any():
                        number.append(n)
                        joint.append(int((score[docs_b[both]] + add_b[both] * times_b).max()))
                        size.append(int(both.sum()))
                        members.append(docs_b[both].astype(np.uint16))
                    score[docs_a] = 0
                found = np.concatenate(members) if members else np.empty(0, np.uint16)
                values = [np.array(number, np.int32), np.array(joint, np.int64), np.cumsum(np.array(size, np.int64)), found]
                columns = [batch.column(c).slice(i, 1) for c in ("segment", *_LISTS)] + [pa.array([v.tobytes()], pa.binary()) for v in values]
                yield pa.RecordBatch.from_arrays(columns, names=["segment", *_LISTS, "pairs", "joints", "pair_ends", "shared"])

    return run


def _best(score: np.ndarray, docs: np.ndarray, local: np.ndarray, k: int) -> np.ndarray:
    """The k best of some documents, equal ones by id."""
    if len(local) > k:
        floor = np.partition(score[local], len(local) - k)[len(local) - k]
        local = local[score[local] >= floor]
    return local[np.lexsort((docs[local], -score[local]))][:k]


def search_segment(
    segment: Segment, lists: dict, pairs: dict[int, tuple[int, np.ndarray]], units: list, number: dict, k: int, threshold: int
) -> tuple[np.ndarray, np.ndarray]:
    """(documents by place, scores) of a segment that reach ``threshold`` for one query, at most ``k``.

    ``pairs`` has a pair's joint maximum and intersection, if its terms meet in the segment at all.
    """
    rated = []
    for unit in units:
        a, times_a, b, times_b = unit
        parts = [(lists[t], times) for t, times in ((a, times_a), (b, times_b)) if t in lists]
        if not parts:
            continue
        alone = max(int(add.max()) * times for (_, add), times in parts)
        joint, shared = pairs.get(number.get(unit, -1), (0, None))
        rated.append((max(alone, joint), alone, parts, shared))
    rated.sort(key=lambda r: r[0])
    below = np.cumsum([0, *[r[0] for r in rated]]).tolist()
    none = np.empty(0, np.int64)
    if below[-1] < threshold or not rated:
        return none, none
    score = np.zeros(len(segment.docs), np.int64)
    marked = np.zeros(len(segment.docs), bool)
    first = len(rated)
    # From the strongest unit down: each adds its own candidates while a document without the
    # stronger ones could still reach the threshold.
    while first and below[first] >= max(threshold, 1):
        first -= 1
        _, alone, parts, shared = rated[first]
        if below[first] + alone >= threshold:
            for (docs, add), times in parts:
                marked[docs] = True
                score[docs] += add * times
        else:
            if shared is not None:
                marked[shared] = True
            for (docs, add), times in parts:
                score[docs] += add * times
    found = np.flatnonzero(marked)
    for r in range(first - 1, -1, -1):
        found = found[score[found] + below[r + 1] >= threshold]
        if not len(found):
            return none, none
        for (docs, add), times in rated[r][2]:
            if len(found) * 16 < len(docs):
                at = np.searchsorted(docs, found)
                at[at == len(docs)] = 0
                hit = docs[at] == found
                score[found[hit]] += add[at[hit]] * times
            else:
                score[docs] += add * times
    found = found[score[found] >= max(threshold, 1)]
    best = _best(score, segment.docs, found, k)
    return best, score[best]


def _search(shipped, thresholds, k: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        plan: Plan = shipped.value
        floor: dict[int, int] = thresholds.value
        number = plan.pair_number()
        for batch in batches:
            for i in range(batch.num_rows):
                segment = _segment(batch, i)
                lists = _lists(segment, segment.impacts(plan.weights, plan.n_docs, plan.n_terms))
                pair = np.frombuffer(batch.column("pairs")[i].as_py(), np.int32)
                joint = np.frombuffer(batch.column("joints")[i].as_py(), np.int64)
                ends = np.frombuffer(batch.column("pair_ends")[i].as_py(), np.int64)
                shared = np.frombuffer(batch.column("shared")[i].as_py(), np.uint16)
                pairs = {
                    int(p): (int(j), shared[a:b].astype(np.int64))
                    for p, j, a, b in zip(pair, joint, np.r_[0, ends[:-1]] if len(ends) else ends, ends, strict=True)
                }
                query, doc, score = [], [], []
                for q, units in zip(plan.numbers, plan.units, strict=True):
                    best, reached = search_segment(segment, lists, pairs, units, number, k, floor.get(q, 1))
                    query.append(np.full(len(best), q, np.int64))
                    doc.append(segment.docs[best])
                    score.append(reached)
                if query:
                    columns = [pa.array(np.concatenate(c)) for c in (query, doc, score)]
                    yield pa.RecordBatch.from_arrays(columns, names=["query", "d", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), "d")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, max_queries: int, max_chars: int) -> Iterator[list[tuple[int, str]]]:
    """(number, text) of the queries, a bounded block at a time."""
    block, size = [], 0
    for r in queries.select("query", "text").orderBy("query").toLocalIterator():
        block.append((r["query"], r["text"]))
        size += len(r["text"] or "")
        if len(block) >= max_queries or size >= max_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search_block(named: DataFrame, block: list[tuple[int, str]], k: int, seed_segments: int) -> DataFrame | None:
    sc = named.sparkSession.sparkContext
    hashes = [(n, terms_of(text)) for n, text in block]
    known = np.unique(np.concatenate([h for _, h in hashes]))
    if not len(known):
        return None
    shipped = sc.broadcast(known)
    schema = "segment long, n_docs long, n_terms long, " + ", ".join(f"{c} binary" for c in _LISTS)
    index = staged(named.select("text", "d").mapInArrow(_index(shipped), schema), "lexical-index")
    totals = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    if not totals["n"]:
        return None

    def lengths(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = _segment(batch, i)
                yield pa.RecordBatch.from_arrays([pa.array(segment.terms), pa.array(np.diff(np.r_[0, segment.ends]))], names=["term", "n"])

    df = np.zeros(len(known), np.int64)
    # At most as many rows as the block of queries has terms.
    for r in index.mapInArrow(lengths, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    weights = np.array([math.floor(1000 * math.log((2 * totals["n"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    counted = [(n, Counter(np.searchsorted(known, h).tolist())) for n, h in hashes]
    plan = sc.broadcast(plan_queries([(n, c) for n, c in counted if c], weights, totals["n"], totals["l"]))
    packed = "segment long, " + ", ".join(f"{c} binary" for c in (*_LISTS, "pairs", "joints", "pair_ends", "shared"))
    paired = staged(index.mapInArrow(_pair_lists(plan), packed), "lexical-pairs")

    out = "query long, d long, score long"
    chosen = [r["segment"] for r in paired.select("segment").orderBy(F.xxhash64("segment")).limit(seed_segments).collect()]
    seeds = paired.where(F.col("segment").isin(chosen)).mapInArrow(_search(plan, sc.broadcast({}), k), out)
    floors = {r["query"]: r["score"] for r in _ranked(seeds, k).where(F.col("rank") == k).collect()}
    return _ranked(paired.mapInArrow(_search(plan, sc.broadcast(floors), k), out), k)


def rank_documents(
    docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id",
    query_text_col: str = "text", seed_segments: int = SEED_SEGMENTS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` best documents of every query: (query id, rank, document id, score).

    The queries are read in blocks of at most ``block_queries`` rows, or somewhat more than
    ``BLOCK_CHARS`` characters, each with an index of the terms that its queries hold.
    ``seed_segments`` bounds the part searched for first thresholds; any value gives the same rows.
    """
    named = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID)).alias("d"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    numbered = staged(
        queries.select(
            F.monotonically_increasing_id().alias("query"), F.col(f"`{query_id_col}`").alias("item"),
            F.col(f"`{query_text_col}`").cast("string").alias("text"),
        ),
        "lexical-queries",
    )
    found = [r for block in _blocks(numbered, block_queries, BLOCK_CHARS) if (r := _search_block(named, block, k, seed_segments)) is not None]
    schema = "query long, d long, score long, rank int"
    ranked = docs.sparkSession.createDataFrame([], schema)
    for r in found:
        ranked = ranked.unionByName(r) if ranked is not None else r
    # The key stands in for a null id; a real id of that value stays, since such rows keep their score and rank.
    item = numbered.select("query", "item")
    return ranked.join(item, "query").select(
        F.col("item").alias(query_id_col), F.col("rank").cast("int").alias("rank"),
        F.when(F.col("d") != _NULL_ID, F.col("d")).alias(id_col), "score",
    )
