"""Prefix trie, lexical search and parse-based de-duplication against plain Python versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tickwise.llm import lexical, parse_dedup, prefix_trie
from tickwise.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=str)


# ---- prefix trie -------------------------------------------------------------------------------

def _md5(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def _trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), _md5(role or "", text or ""), (role or "", text or "")))
    own = {c: [t for *_, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in own.items():
        block = c - int(math.fmod(c, 100))
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(block, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].add(c)
        ends[tuple(whole)].add(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not children[p]
    return _sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def _conversations(seed=4):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "of nobody"), (7, 1, None, None), (7, None, "user", "first"), (8, 3, "user", "tie b"), (8, 3, "user", "tie a"),
            (-101, 0, "user", "below zero"), (-100, 0, "user", "opens"), (-100, 0, "user", "opens"), (1, 0, "user", "ab"), (1, 1, "a", "b"),
            (2, 0, "use", "rab"), (1_000_000_007, 5, "user", "é" * 50)]
    says = [f"text {i} {'x' * i}" for i in range(4)]
    for c in [*range(100, 160), *range(200, 260), *range(303, 330)]:
        for t in range(rng.choice([1, 2, 3, 4, 9])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(says) if rng.random() < 0.7 else says[0]))
    # Two conversations that agree for long, and one that is a beginning of them.
    for c, n in ((401, 60), (402, 70), (403, 31)):
        rows += [(c, t, "user", f"same {t % 7}") for t in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("kw", [{}, {"segment": 4, "shard_rows": 6}, {"segment": 1, "shard_rows": 1}, {"segment": 16, "shard_rows": 40}])
def test_prefix_trie(spark, kw):
    rows = _conversations()
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5), **kw)
    assert _sorted(got.collect()) == _trie(rows)


def test_prefix_trie_of_one_long_conversation_in_chunks(spark):
    rows = [(1, t // 2, "user", f"t{t % 11}") for t in range(400)] + [(2, t, "user", "x") for t in range(3)]
    spark.conf.set("spark.tickwise.hotKeyRows", "50")
    try:
        got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), segment=32, shard_rows=20)
        assert _sorted(got.collect()) == _trie(rows)
    finally:
        spark.conf.unset("spark.tickwise.hotKeyRows")


def test_prefix_trie_edges(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(empty).count() == 0
    # A turnless conversation: shorter than what it drops, and no first conversation in its block.
    c = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "dropped")]
    assert _sorted(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()) == _trie(rows)
    clash = spark.createDataFrame([(*r, 1, 2, "s") for r in _conversations()], TURNS + ", c long, depth long, turn_hash string")
    assert _sorted(prefix_trie.prefix_trie(clash).collect()) == _trie(_conversations())


def test_perfect_hash_is_minimal_and_sees_foreign_keys():
    keys = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 63, (5_000, 2), dtype=np.uint64)
    table = prefix_trie.PerfectHash.build(keys)
    assert sorted(table.lookup(keys).tolist()) == list(range(5_000))
    assert (table.lookup(keys + np.uint64(1)) == -1).all()
    with pytest.raises(RuntimeError, match="share a digest"):
        prefix_trie.PerfectHash.build(np.r_[keys[:1], keys[:1]])


# ---- lexical search ----------------------------------------------------------------------------

def _terms(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _search(docs, items, k=20):
    full = [(d, Counter(_terms(t))) for d, t in docs]
    full = [(d, c) for d, c in full if c]
    n_docs, n_terms = len(full), sum(sum(c.values()) for _, c in full)
    df = Counter(t for _, c in full for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in full:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                for t in _terms(text) if t in c
            )
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return _sorted(out)


def _texts(seed=9, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(None, "w1 w2 w3"), (None, None), (1, ""), (2, "!!! ..."), (3, "W1-w1_w1"), (3, "W1-w1_w1"), (4, "w5 " * 3_000)]
    docs += [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30, 120])))) for i in range(10, n)]
    items = [(1, None), (2, ""), (3, "nothing here"), (4, "w1 W1 w2 w9 w40"), (4, "w59 w58"), (None, "naïve É w3"), (6, "w0")]
    items += [(i, " ".join(rng.choices(words, k=rng.choice([2, 7, 25])))) for i in range(10, 40)]
    return docs, items


@pytest.mark.parametrize("kw", [{}, {"seed_segments": 3, "block_queries": 5}, {"seed_segments": 0}])
def test_lexical_search(spark, kw, monkeypatch):
    docs, items = _texts()
    df = spark.createDataFrame(docs, DOCS).repartition(40)
    got = lexical.rank_documents(df, spark.createDataFrame(items, "item_id long, text string"), **kw)
    assert _sorted(got.collect()) == _search(docs, items)


def test_lexical_search_edges(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = spark.createDataFrame([], DOCS)
    assert lexical.rank_documents(none, items).count() == 0
    assert lexical.rank_documents(spark.createDataFrame([(1, "a")], DOCS), items.limit(0)).count() == 0
    assert lexical.rank_documents(spark.createDataFrame([(1, "--"), (2, None)], DOCS), items).count() == 0
    clash = spark.createDataFrame([(1, "a b c", 5, 6)], DOCS + ", d long, query long")
    odd = spark.createDataFrame([(1, "a b", 9, 8)], "item_id long, text string, query long, rank long")
    assert _sorted(lexical.rank_documents(clash, odd).collect()) == _search([(1, "a b c")], [(1, "a b")])


def test_thresholds_and_pairs_skip_without_loss():
    """Every threshold gives the documents at or above it; joint maxima never exceed the sum of single ones."""
    rng = np.random.Generator(np.random.PCG64(5))
    n, n_terms = 500, 12
    member, term = np.nonzero(rng.random((n, n_terms)) < 0.3)
    order = np.lexsort((member, term))
    member, term = member[order], term[order]
    last = np.flatnonzero(np.r_[term[1:] != term[:-1], True])
    count = rng.integers(1, 9, len(member))
    segment = lexical.Segment(np.arange(n), np.full(n, 40), term[last].astype(np.int32), last + 1, member.astype(np.uint16), count.astype(np.uint32))
    weights = rng.integers(100, 9_000, n_terms)
    impacts = segment.impacts(weights, n, 40 * n)
    lists = lexical._lists(segment, impacts)
    plan = lexical.plan_queries([(0, Counter({t: 1 + t % 2 for t in range(n_terms)}))], weights, n, 40 * n)
    score = np.zeros(n, np.int64)
    for t, (docs, add) in lists.items():
        score[docs] += add * (1 + t % 2)
    pairs = {}
    for i, (a, x, b, y) in enumerate(plan.pairs):
        both = np.intersect1d(lists[a][0], lists[b][0])
        joint = [lists[a][1][lists[a][0] == d][0] * x + lists[b][1][lists[b][0] == d][0] * y for d in both]
        pairs[i] = (int(max(joint)), both)
    for floor in [1, *np.quantile(score, [0.3, 0.9, 0.99]).astype(int).tolist(), int(score.max()), int(score.max()) + 1]:
        best, reached = lexical.search_segment(segment, lists, pairs, plan.units[0], plan.pair_number(), 20, floor)
        expected = [(int(s), int(d)) for s, d in sorted(((-s, d) for d, s in enumerate(score.tolist()) if s >= floor))[:20]]
        assert list(zip((-reached).tolist(), best.tolist(), strict=True)) == expected
    assert sum(j for j, _ in pairs.values()) <= sum(int(add.max()) * (1 + t % 2) for t, (_, add) in lists.items())


# ---- parse-based de-duplication ----------------------------------------------------------------

def _removed(rows, length=400):
    starts = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        starts.update(raw[p : p + length] for p in range(len(raw) - length + 1))
    out = []
    for d, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if starts[raw[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return _sorted(out)


def _copies(seed=3, n=120):
    rng = random.Random(seed)
    words = [f"é{i}" for i in range(40)] + [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=300)) for _ in range(5)]
    rows = [(1, None), (2, ""), (3, "x" * 399), (4, "a" * 900), (5, "a" * 401), (6, "ab" * 500), (7, base[0]), (7, base[0]), (None, base[1]), (None, base[1] + "!")]
    for i in range(10, n):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"q{rng.randint(0, 9999)}"
        lo = rng.randint(0, 100)
        text = " ".join(w[lo : lo + rng.randint(30, 300)])
        rows.append((i, text + rng.choice(base)[rng.randint(0, 500) :] if rng.random() < 0.3 else text))
    return rows


@pytest.mark.parametrize("kw", [{}, {"group_rows": 3}, {"group_rows": 5, "hot_pieces": 4}, {"window": 32, "modulus": 2}, {"modulus": 4_096}])
def test_parse_dedup(spark, kw):
    rows = _copies()
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    assert _sorted(parse_dedup.remove_repeated_strings(df, **kw).collect()) == _removed(rows)


def test_parse_dedup_of_texts_in_slices(spark, monkeypatch):
    data = np.frombuffer(" ".join(f"w{i * i % 997}" for i in range(3_000)).encode(), np.uint8)
    for size in (1 << 20, 1_000):
        monkeypatch.setattr(parse_dedup, "SLICE", size)
        starts = []
        for _, base in parse_dedup._slices(np.array([0, len(data)]), 400):
            first, count, at, _ = parse_dedup.pieces(data[base : base + size + 399], 400, 128, 32)
            starts += [base + s + j for s, m in zip(first, count) for j in range(m)]
        assert sorted(starts) == list(range(len(data) - 399))


def test_parse_dedup_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert parse_dedup.remove_repeated_strings(empty).count() == 0
    rows = [(1, "k" * 3_000), (2, "z" + "k" * 450), (3, "short")]
    clash = spark.createDataFrame([(*r, 1, 2, "m") for r in rows], DOCS + ", u long, d long, marks string")
    assert _sorted(parse_dedup.remove_repeated_strings(clash).collect()) == _removed(rows)
    kept = parse_dedup.remove_repeated_strings(spark.createDataFrame(rows, DOCS), with_text=True)
    assert {bytes(r["kept"]) for r in kept.collect()} == {b"", b"z", b"short"}


# ---- the registered queries over a folder ------------------------------------------------------

def test_registered_queries(spark, tmp_path):
    docs, items = _texts(n=60)
    turns, copies = _conversations(), _copies(n=30)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    spark.createDataFrame(turns, TURNS).write.parquet(f"{tmp_path}/a/conversations.parquet")
    spark.createDataFrame(copies, DOCS).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert _sorted(QUERIES["op12_lexical_search"](spark, f"{tmp_path}/a").collect()) == _search(docs, items)
    assert _sorted(QUERIES["op11_prefix_trie"](spark, f"{tmp_path}/a").collect()) == _trie(turns)
    assert _sorted(QUERIES["op13_parse_dedup"](spark, f"{tmp_path}/b").collect()) == _removed(copies)
