"""Secret scans with a trigram inverted index.

From each rule's expression a Boolean query of trigrams is derived that every match satisfies:
literals give the trigrams they contain, sequences join with AND, alternatives with OR. The
index maps each trigram that some rule asks for to the documents that contain it. Postings are
intersected and united as the query says, and only the documents that remain are verified with
the expression itself. A rule without mandatory trigrams, such as a long run of hex digits, is
run on every document.

The index is built segment by segment, a segment being a slice of a task's documents, and is
used right there. So no postings are shuffled, memory depends on the slice, and a lost task
rebuilds its own segments. Letters A to Z are folded in the index, which can only add candidates.

A null text is empty and has no secrets. Spans are in code points, end exclusive.
"""

from __future__ import annotations


import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from re import _constants as C
from re import _parser

from tickwise.llm.words import _FOLD, text_slices

Batches = Iterator[pa.RecordBatch]
MAX_STRINGS = 64
Query = tuple  # ("all",) | ("tri", code) | ("and", parts) | ("or", parts)
ALL: Query = ("all",)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches are kept if ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    base: bool = False


# The patterns of the contract, and public formats of well-known keys.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, True),
    Rule("hex", r"[0-9a-f]+", 32, 0, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
# End of fixed values.


def _trigrams(s: str) -> Query:
    b = bytes(_FOLD[list(s.encode())]) if s else b""
    return _all_of([("tri", b[i] << 16 | b[i + 1] << 8 | b[i + 2]) for i in range(len(b) - 2)])


def _all_of(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _walk(tree) -> tuple[list[str] | None, Query]:
    """(all strings that the expression can be, if they are few; what every match contains)."""
    strings, need = [""], []

    def flush() -> None:
        nonlocal strings
        need.append(_any_of([_trigrams(s) for s in strings]))
        strings = [""]

    exact = True
    for op, arg in tree:
        own, query = _node(op, arg)
        if own is None or len(own) * len(strings) > MAX_STRINGS:
            flush()
            exact = False
            need.append(query)
            if own is not None:
                strings = own
        else:
            strings = ["".join(x) for x in product(strings, own)]
    if exact:
        return strings, _any_of([_trigrams(s) for s in strings])
    flush()
    return None, _all_of(need)


def _node(op, arg) -> tuple[list[str] | None, Query]:
    if op is C.LITERAL:
        return [chr(arg).lower() if arg < 128 else chr(arg)], ALL
    if op is C.SUBPATTERN:
        return _walk(arg[3])
    if op is C.AT:
        return [""], ALL
    if op is C.BRANCH:
        found = [_walk(x) for x in arg[1]]
        strings = None if any(s is None for s, _ in found) else [x for s, _ in found for x in s]
        return strings, _any_of([q for _, q in found])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = arg
        strings, query = _walk(inner)
        if low == 0:
            return ([*strings, ""] if strings is not None and high == 1 else None), ALL
        if low == high == 1:
            return strings, query
        return None, query
    if op is C.IN and all(k is C.LITERAL for k, _ in arg):
        return sorted({chr(v).lower() if v < 128 else chr(v) for _, v in arg}), ALL
    return None, ALL


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every match of ``pattern`` satisfies."""
    return _walk(_parser.parse(pattern))[1]


def asked(query: Query) -> set[int]:
    """Trigrams that a query asks for."""
    if query[0] == "tri":
        return {query[1]}
    return set() if query == ALL else set().union(*[asked(q) for q in query[1]])


def _select(query: Query, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Documents of a segment that satisfy the query, ascending."""
    if query == ALL:
        return np.arange(n)
    if query[0] == "tri":
        return postings.get(query[1], np.empty(0, np.int64))
    if query[0] == "or":
        return np.unique(np.concatenate([_select(q, postings, n) for q in query[1]]))
    found: np.ndarray | None = None
    for q in query[1]:
        docs = _select(q, postings, n)
        found = docs if found is None else np.intersect1d(found, docs, assume_unique=True)
        if not len(found):
            break
    return found


def segment_postings(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> dict[int, np.ndarray]:
    """Postings of a segment: trigram to ascending documents, for the sorted trigrams ``wanted``.

    The first two bytes are looked up in a table, so that only places where a wanted trigram may
    begin are looked at further.
    """
    if len(data) < 3 or not len(wanted):
        return {}
    folded = _FOLD[data].astype(np.int32)
    two = folded[:-2] << 8 | folded[1:-1]
    begins = np.zeros(1 << 16, dtype=bool)
    begins[wanted >> 8] = True
    at = np.flatnonzero(begins[two])
    code = two[at] << 8 | folded[at + 2]
    index = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
    hit = wanted[index] == code
    at, index = at[hit], index[hit]
    doc = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 3 <= offsets[doc + 1]
    pairs = np.unique(index[inside] * np.int64(len(offsets)) + doc[inside])
    term, doc = pairs // len(offsets), pairs % len(offsets)
    cut = np.searchsorted(term, np.arange(len(wanted) + 1))
    return {int(wanted[i]): doc[cut[i] : cut[i + 1]] for i in range(len(wanted)) if cut[i] < cut[i + 1]}


def _found(rule: Rule, expression: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in expression.finditer(text) if len(m.group(rule.group)) >= rule.least]


def _scan(rules: tuple[Rule, ...]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        expressions = [re.compile(r.pattern) for r in rules]
        needs = [trigram_query(r.pattern) for r in rules]
        wanted = np.array(sorted(set().union(*map(asked, needs))), dtype=np.int32)
        for batch in batches:
            for a, b, data, off in text_slices(batch.column("text")):
                postings = segment_postings(data, off, wanted)
                raw = data.tobytes()
                texts: dict[int, str] = {}
                spans: dict[int, list[tuple[int, int, int]]] = {}
                for k, (rule, expression, need) in enumerate(zip(rules, expressions, needs, strict=True)):
                    for i in _select(need, postings, b - a).tolist():
                        if i not in texts:
                            texts[i] = raw[off[i] : off[i + 1]].decode()
                        for start, end in _found(rule, expression, texts[i]):
                            spans.setdefault(i, []).append((start, k, end))
                rows = [[(rules[k].kind, s, e, rules[k].base) for s, k, e in sorted(spans.get(i, ()))] for i in range(b - a)]
                kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
                lists = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in row] for row in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(lists, pa.list_(kind))], names=["doc_id", "found"]
                )

    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): per row all spans as structs (kind, start, end, base), by start and rule."""
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return named.mapInArrow(_scan(rules), "doc_id long, found array<struct<kind: string, start: long, end: long, base: boolean>>")


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the number of spans of each base kind, a digest of them, and all spans."""
    found = find_secrets(docs, rules, id_col, text_col)
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("found", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{r.kind}": count(r.kind) for r in rules if r.base}
    return found.select(
        "doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans")
    )
