"""A quality classifier by co-training.

Two classifiers see different views of a document: its text content (which words occur, and how
the text is built) and its metadata (language, source, length as recorded). Both are logistic
regressions on binary features, fitted on labelled rows. In each round either one labels the
pool rows that it is most confident of, and those join the other's training rows with a smaller
weight; how confident it must be is read off held-out labelled rows. A view that is never that
reliable passes nothing on. In the end both are calibrated on the held-out rows, and a small
regression of the two calibrated views scores every document.

Fitting uses a bounded sample, chosen by a hash of the id: at most ``labelled`` labelled rows and
``pool`` unlabelled ones, whose features (not their texts) reach the driver. Rows that agree in id
and in both views are one row of the sample; each chosen id has a row in it before any has a
second one, and the rows of an id share the weight of one. Scoring reads every document whole, in
one pass without a shuffle, with two weight tables of fixed size.

A document is bad if its quality is 0 or it is toxic; of several labels of one id the worse
counts, and null labels do not. A null text has no words. Without labels of both classes nothing
can be learnt, and every document is kept with a score of null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.llm.words import PUNCTUATION, mix, split_words, text_slices
from tickwise.session import staged

Batches = Iterator[pa.RecordBatch]
LABELLED = 8_000
POOL = 4_000
ROUNDS = 3
HELD_OUT = 0.25
BUCKETS = 1 << 22
META_BUCKETS = 1 << 16
FEATURES = 4_000
LEAST_Z = 2.5
TRUST = 0.98
PSEUDO_WEIGHT = 0.3
PSEUDO_ROWS = 400
THRESHOLD = 0.5
ENTRIES_AT_ONCE = 1 << 17
VIEWS = ("text", "lang", "source", "n_chars")
_ALPHA = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_MARK = PUNCTUATION & ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LINE = np.arange(256) == 10


def _per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the content view: words without case and punctuation, and traits in steps."""
    w = split_words(data, offsets, fold=True, between=PUNCTUATION)
    owner = w.text_of_word()
    n = len(offsets) - 1
    size = np.maximum(1, np.diff(offsets))
    words = np.diff(w.first)
    again = np.zeros(len(w.hashes) + 1, np.int64)
    if len(w.hashes) > 1:
        same = (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1])
        again[2:] = np.cumsum(same)
    traits = [
        _per_text(_UPPER[data], offsets) / np.maximum(1, _per_text(_ALPHA[data], offsets)),
        _per_text(_MARK[data], offsets) / size, _per_text(_DIGIT[data], offsets) / size, _per_text(_LINE[data], offsets) / size * 10,
        (again[w.first[1:]] - again[w.first[:-1]]) / np.maximum(1, words), np.log2(1 + words) / 16,
    ]
    rows, buckets = [owner], [(w.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
    for j, trait in enumerate(traits):
        step = np.minimum(31, np.floor(trait * 32)).astype(np.uint64)
        rows.append(np.arange(n))
        buckets.append((mix(step + np.uint64(1000 * (j + 1))) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def meta_features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the metadata view: language, source, their pair, and the recorded length."""
    lang, source, chars = (batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))
    rows, buckets = [], []
    for i, (a, b, c) in enumerate(zip(lang, source, chars, strict=True)):
        length = None if c is None else int(2 * np.log2(1 + max(0, c)))
        for name in (f"lang {a}", f"source {b}", f"both {a} {b}", f"length {length}"):
            h = 14695981039346656037
            for byte in name.encode():
                h = (h ^ byte) * 1099511628211 & (1 << 64) - 1
            rows.append(i)
            buckets.append((h ^ h >> 32) & META_BUCKETS - 1)
    return np.array(rows, np.int64), np.array(buckets, np.int64)


def _features() -> Callable[[Batches], Batches]:
    """Features of the chosen rows, of each (order, row) once per task."""

    def run(batches: Batches) -> Batches:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            fresh = []
            for i, key in enumerate(zip(batch.column("order").to_pylist(), batch.column("row").to_pylist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh, pa.int64()))
            out: list[bytes] = []
            for _, _, data, off in text_slices(batch.column("text")):
                rows, buckets = text_features(data, off)
                pairs = np.unique(rows * np.int64(BUCKETS) + buckets)
                cut = np.searchsorted(pairs // BUCKETS, np.arange(len(off)))
                out += [(pairs[a:b] % BUCKETS).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            rows, buckets = meta_features(batch)
            meta = [buckets[rows == i].astype(np.int32).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("bad", "order", "row")], pa.array(out, pa.binary()), pa.array(meta, pa.binary())],
                names=["bad", "order", "row", "text_f", "meta_f"],
            )

    return run


class _Rows:
    """Sparse binary rows: features of all rows behind each other, numbered as they occur here."""

    def __init__(self, packed: list[bytes]):
        self.size = np.array([len(p) // 4 for p in packed], np.int64)
        self.first = np.r_[0, np.cumsum(self.size)]
        seen = np.zeros(BUCKETS, bool)
        for p in packed:
            seen[np.frombuffer(p, np.int32)] = True
        self.names = np.flatnonzero(seen).astype(np.int32)
        place = np.empty(int(self.names[-1]) + 1 if len(self.names) else 0, np.int32)
        place[self.names] = np.arange(len(self.names), dtype=np.int32)
        self.flat = np.empty(int(self.first[-1]), np.int32)
        for p, lo, hi in zip(packed, self.first[:-1], self.first[1:], strict=True):
            self.flat[lo:hi] = place[np.frombuffer(p, np.int32)]
        self.row = np.repeat(np.arange(len(packed), dtype=np.int32), self.size)

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, feature) of the entries in their order, some at a time: the driver holds few of them as wide numbers."""
        for lo in range(0, len(self.flat), ENTRIES_AT_ONCE):
            part = slice(lo, lo + ENTRIES_AT_ONCE)
            yield self.row[part].astype(np.int64), self.flat[part].astype(np.int64)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.size))
        for row, flat in self.parts():
            np.add.at(out, row, weights[flat])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression on few dense columns, the first of them constant."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        penalty = np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
        grad = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_view(rows: _Rows, use: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """(weight per feature of the rows, intercept): regression on the features that tell the classes apart.

    A feature is used if its log odds differ from 0 by ``LEAST_Z`` deviations, the clearest first.
    """
    buckets = len(rows.names)
    used = np.where(use, weight, 0.0)
    positive, every = np.zeros(buckets), np.zeros(buckets)
    for row, flat in rows.parts():
        w = used[row]
        np.add.at(positive, flat, w * y[row])
        np.add.at(every, flat, w)
    all_pos, all_ = float((weight * y * use).sum()), float((weight * use).sum())
    a, b = positive + 0.5, every - positive + 0.5
    c, d = all_pos - positive + 0.5, all_ - all_pos - (every - positive) + 0.5
    z = np.abs(np.log(a) - np.log(b) - np.log(c) + np.log(d)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    z[every < 2] = 0
    top = np.argsort(-z, kind="stable")[:FEATURES]
    top = top[z[top] >= LEAST_Z]
    out = np.zeros(buckets)
    place = np.full(buckets, -1, np.int64)
    place[top] = np.arange(len(top))
    kept = []
    for row, flat in rows.parts():
        local = place[flat]
        keep = (local >= 0) & use[row]
        kept.append((row[keep].astype(np.int32), local[keep].astype(np.int32)))
    r, f = (np.concatenate([k[i] for k in kept] or [np.empty(0, np.int32)]).astype(np.int64) for i in (0, 1))
    del kept
    coef, bias = np.zeros(len(top)), float(np.log((all_pos + 1) / (all_ - all_pos + 1)))
    speed_c, speed_b = np.full(len(top), 1e-8), 1e-8
    n = len(rows.size)
    for _ in range(200):
        p = _sigmoid(bias + np.bincount(r, weights=coef[f], minlength=n))
        g = np.where(use, weight * (p - y), 0.0)
        gc, gb = np.bincount(f, weights=g[r], minlength=len(top)) + ridge * coef, g.sum()
        speed_c, speed_b = speed_c + gc * gc, speed_b + gb * gb
        coef -= 0.5 * gc / np.sqrt(speed_c)
        bias -= 0.5 * gb / np.sqrt(speed_b)
    out[top] = coef
    return out, bias


@dataclass
class Model:
    """Weights of the two views (buckets, weights), and how their calibrated logits combine."""

    text: tuple[np.ndarray, np.ndarray]
    text_bias: float
    meta: tuple[np.ndarray, np.ndarray]
    meta_bias: float
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    joint: tuple[float, float, float]
    report: dict = field(default_factory=dict)


def _reach(p: np.ndarray, y: np.ndarray, share: np.ndarray, trust: float) -> float:
    """The smallest probability from which on the held-out rows are right often enough."""
    order = np.argsort(-p, kind="stable")
    total = np.cumsum(share[order])
    right = np.cumsum((share * y)[order]) / total
    good = np.flatnonzero((right >= trust) & (total >= 10))
    return float(p[order[good[-1]]]) if len(good) else 2.0


def co_train(text: _Rows, meta: _Rows, bad: np.ndarray, owner: np.ndarray, rounds: int = ROUNDS, trust: float = TRUST) -> Model | None:
    """Fit both views. ``bad`` is 1, 0, or -1 for pool rows; rows come in the order of ``owner``, a hash of their id.

    The rows of an id are held out together or not at all.
    """
    known = bad >= 0
    first = np.r_[True, owner[1:] != owner[:-1]][: len(bad)]
    ids = np.cumsum(first)
    share = 1 / np.bincount(ids)[ids]
    held = known & (np.cumsum(known & first) % max(2, round(1 / HELD_OUT)) == 0)
    if min((bad[known & ~held] == v).sum() for v in (0, 1)) < 2 or min((bad[held] == v).sum() for v in (0, 1)) < 2:
        return None
    y_held = bad[held].astype(float)
    views = {"text": text, "meta": meta}
    y = {v: bad.astype(float) for v in views}
    use = {v: known & ~held for v in views}
    weight = {v: share.copy() for v in views}
    fitted: dict[str, tuple[np.ndarray, float]] = {}
    passed = {"text": 0, "meta": 0}
    for turn in range(rounds + 1):
        for v, rows in views.items():
            fitted[v] = fit_view(rows, use[v], np.where(use[v], y[v], 0.0), weight[v])
        if turn == rounds:
            break
        for v, other in (("text", "meta"), ("meta", "text")):
            p = _sigmoid(views[v].sums(fitted[v][0]) + fitted[v][1])
            open_ = np.flatnonzero((bad < 0) & ~use[other])
            for label, q in ((1.0, p), (0.0, 1 - p)):
                limit = _reach(q[held], y_held if label else 1 - y_held, share[held], trust)
                sure = open_[q[open_] >= limit]
                sure = sure[np.argsort(-q[sure], kind="stable")][:PSEUDO_ROWS]
                y[other][sure], use[other][sure], weight[other][sure] = label, True, PSEUDO_WEIGHT * share[sure]
                passed[v] += len(sure)
    logits = {v: (views[v].sums(fitted[v][0]) + fitted[v][1])[held] for v in views}
    one = np.ones(len(y_held))
    scale = {v: tuple(_newton(np.stack([one, logits[v]], 1), y_held, share[held])) for v in views}
    calibrated = [scale[v][0] + scale[v][1] * logits[v] for v in views]
    joint = _newton(np.stack([one, *calibrated], 1), y_held, share[held])
    p = _sigmoid(np.stack([one, *calibrated], 1) @ joint)
    report = {"held_out": int(held.sum()), "passed": passed, "right": float(np.average((p >= THRESHOLD) == (y_held > 0), weights=share[held]))}
    used = {v: np.flatnonzero(fitted[v][0]) for v in views}
    sparse = {v: (views[v].names[used[v]], fitted[v][0][used[v]].astype(np.float32)) for v in views}
    return Model(sparse["text"], fitted["text"][1], sparse["meta"], fitted["meta"][1], scale["text"], scale["meta"], tuple(joint), report)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS) -> Model | None:
    """Co-train on the labelled sample and the pool; None if there is nothing to learn from."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(F.max(bad.cast("int")).alias("bad"))
    order = F.xxhash64(F.lit(11), "doc_id")
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    marked = ids.join(known, "doc_id", "left").withColumn("order", order)
    chosen = marked.where("bad IS NOT NULL").orderBy("order", "doc_id").limit(labelled).unionAll(
        marked.where("bad IS NULL").orderBy("order", "doc_id").limit(pool)
    )
    # Equal for rows that agree in both views, nulls included.
    rows = docs.select("doc_id", *VIEWS).withColumn("row", F.xxhash64(*VIEWS, *[F.col(c).isNull() for c in VIEWS]))
    choices = staged(rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "bad", "order", "row").distinct(), "choices")
    # At most labelled + pool ids.
    first = choices.groupBy("doc_id").agg(F.min("row").alias("first"))
    turn = choices.join(F.broadcast(first), "doc_id").withColumn("later", F.col("row") != F.col("first"))
    by = ["later", F.xxhash64(F.lit(11), "doc_id", "row"), "doc_id", "row"]
    picked = turn.where("bad IS NOT NULL").orderBy(*by).limit(labelled).unionAll(turn.where("bad IS NULL").orderBy(*by).limit(pool))
    # At most labelled + pool rows, each of which may occur many times in the table.
    sample = rows.join(F.broadcast(picked.select("doc_id", "row", "bad", "order")), ["doc_id", "row"]).select(*VIEWS, "bad", "order", "row")
    features = sample.mapInArrow(_features(), "bad int, order long, row long, text_f binary, meta_f binary")
    found = features.dropDuplicates(["order", "row"]).collect()
    found.sort(key=lambda r: (r.order, r.text_f, r.meta_f))
    target = np.array([-1 if r.bad is None else r.bad for r in found], np.int64)
    owner = np.array([r.order for r in found], np.int64)
    text, meta = _Rows([r.text_f for r in found]), _Rows([r.meta_f for r in found])
    # The collected rows are no longer needed while both views are fitted.
    del found
    return co_train(text, meta, target, owner, rounds)


def _score(model, threshold: float) -> Callable[[Batches], Batches]:
    def logits(rows: np.ndarray, buckets: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        hit = np.flatnonzero(weights[buckets])
        pairs = np.unique(rows[hit] * np.int64(len(weights)) + buckets[hit])
        return np.bincount(pairs // len(weights), weights=weights[pairs % len(weights)], minlength=n)

    def run(batches: Batches) -> Batches:
        m = model.value
        tables = []
        for (names, values), size in ((m.text, BUCKETS), (m.meta, META_BUCKETS)):
            table = np.zeros(size, np.float32)
            table[names] = values
            tables.append(table)
        for batch in batches:
            text = np.concatenate([
                logits(*text_features(data, off), tables[0], b - a) for a, b, data, off in text_slices(batch.column("text"))
            ] or [np.empty(0)])
            meta = logits(*meta_features(batch), tables[1], batch.num_rows)
            t = m.text_scale[0] + m.text_scale[1] * (text + m.text_bias)
            s = m.meta_scale[0] + m.meta_scale[1] * (meta + m.meta_bias)
            bad = _sigmoid(m.joint[0] + m.joint[1] * t + m.joint[2] * s)
            columns = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(1 - _sigmoid(t)), pa.array(1 - _sigmoid(s)), pa.array(1 - bad), pa.array(bad < threshold)],
                names=[*batch.schema.names, "text_score", "meta_score", "score", "kept"],
            )

    return run


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns with text_score, meta_score, score (1 is good) and kept, for every row."""
    needed = list(dict.fromkeys([*carry, "text", "lang", "source", "n_chars"]))
    rows = docs.select(*needed)
    out = ["text_score", "meta_score", "score"]
    if model is None:
        return rows.select(*carry, *[F.lit(None).cast("double").alias(c) for c in out], F.lit(True).alias("kept"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    scored = rows.mapInArrow(_score(shipped, threshold), f"{fields}, text_score double, meta_score double, score double, kept boolean")
    return scored.select(*carry, *out, "kept")


def _good(score_rows: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for scored in score_rows(iter([batch.select(["text", "lang", "source", "n_chars"])])):
                yield batch.filter(scored.column("kept"))

    return run


def only_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the model keeps, in the columns of ``docs``."""
    if model is None:
        return docs
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_good(_score(shipped, threshold)), docs.schema)
