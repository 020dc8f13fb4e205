"""Token counts with a compiled finite-state transducer.

Two deterministic automata are composed. The first cuts a text into pieces, by the classes of
its characters. The second reads a piece's bytes: its state holds the longest suffix that some
token may still grow from, and the last token at each place within that suffix. Reading a byte
decides which token ends there, because the tokens of a prefix are those of a shorter prefix
and one more that is compatible with its neighbour. Each transition is annotated with the
change in the number of emitted tokens, so a piece's count is the sum along its path. States
and transitions are determinised when they are first needed and kept; pieces that occur again
are looked up whole. Both tables are bounded and start anew when they are full.

Long texts are cut into chunks that different tasks read. A chunk's state map says what it does
to any state it may be entered in: a character that is no white space followed by white space
always ends a piece, whatever came before, so behind the first such place the map is constant.
What stands before it and behind the last one is carried along, as a head and a tail. Maps
compose associatively, and a scan over a text's chunks gives its count.

A null text is empty. Strings of added tokens count as one token wherever they occur, as the
library does by default. Rows that repeat count each.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]
CHUNK_CHARS = 1 << 16
MAX_STATES = 200_000
MAX_PIECES = 500_000
# How byte-level vocabularies cut texts, and where they put the 256 bytes.
PIECE = r"""'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = ((33, 126), (161, 172), (174, 255))
# End of fixed values.
SYNC = regex.compile(r"(?<=\S)(?=\s)")
RUN = regex.compile(r"\s\s")


def _byte_chars() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file."""
    own = {b for lo, hi in PRINTABLE for b in range(lo, hi + 1)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Bytes of a piece to its number of tokens."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.made: dict[bytes, tuple[bytes, bytes]] = {}
        for left, right in merges:
            self.made.setdefault(left + right, (left, right))
        self.tokens = {t for t in vocabulary if self._merged(t) == (t,)}
        self.grows = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.edges: tuple[dict[bytes, list], dict[bytes, list]] = ({}, {})
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = [((b"", None, 0),)]
        self.names: dict[tuple, int] = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}

    def _merged(self, word: bytes) -> tuple[bytes, ...]:
        """Tokens of a word by the merges' order, for the vocabulary's own entries."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, len(self.ranks)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """What stands at a token's left (0) or right (1) end while it is being merged.

        From its outer byte up to the whole token, each with the rank of the merge that ends it.
        """
        known = self.edges[side].get(token)
        if known is None:
            known, until, part = [], float("inf"), token
            while True:
                known.append((part, until))
                if part not in self.made:
                    break
                until = self.ranks[self.made[part]]
                part = self.made[part][side]
            known.reverse()
            self.edges[side][token] = known
        return known

    def _compatible(self, a: bytes, b: bytes) -> bool:
        """Whether no merge crosses the border between two tokens while both are being merged."""
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        fits = True
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.ranks.get((x, y))
            if rank is not None and rank < x_ends and rank <= y_ends:
                fits = False
                break
            if i == len(left) - 1 and j == len(right) - 1:
                break
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= MAX_STATES:
            self.pairs.clear()
        self.pairs[(a, b)] = fits
        return fits

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change in the number of tokens).

        A state lists the places from which a token may still grow: what has been read since,
        the last token before it, and how many tokens fewer or more there were.
        """
        places, read = self.states[state], bytes((byte,))
        for since, before, count in places:
            token = since + read
            if token in self.tokens and (before is None or self._compatible(before, token)):
                break
        else:
            raise ValueError(f"no token ends with byte {byte}")
        change = count + 1
        name = (*[(s + read, t, c - change) for s, t, c in places if s + read in self.grows], (b"", token, 0))
        to = self.names.get(name)
        if to is None:
            to = self.names[name] = len(self.states)
            self.states.append(name)
        self.steps[state << 8 | byte] = out = (to, change)
        return out

    def count(self, piece: bytes) -> int:
        """Tokens of one piece."""
        if len(self.states) >= MAX_STATES:
            self._reset()
        state = total = 0
        steps = self.steps
        for byte in piece:
            state, change = steps.get(state << 8 | byte) or self._step(state, byte)
            total += change
        return total


class _Spaced(dict):
    """Counts of what lies between two spaces, the first of them included."""

    def __init__(self, counter: Counter):
        self.counter = counter

    def __missing__(self, part: str) -> int:
        if len(self) >= MAX_STATES:
            self.clear()
        n = self[part] = self.counter._piecewise(" " + part)
        return n


class Counter(dict):
    """Counts of whole texts and state maps of chunks; remembers pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary without normalisation is needed")
        chars = _byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        added = [t["content"] for t in spec.get("added_tokens", ())]
        vocabulary = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.transducer = Transducer(vocabulary, [(raw(a), raw(b)) for a, b in pairs])
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pieces = regex.compile(PIECE)
        self.spaced = _Spaced(self)

    def __missing__(self, piece: str) -> int:
        if len(self) >= MAX_PIECES:
            self.clear()
        n = self[piece] = self.transducer.count(piece.encode())
        return n

    def _piecewise(self, text: str) -> int:
        return sum(map(self.__getitem__, self.pieces.findall(text)))

    def tokens(self, text: str) -> int:
        """Tokens of a text, or of a part of it between two places where pieces always end."""
        if self.added is not None and self.added.search(text):
            parts = self.added.split(text)
            return len(parts) - 1 + sum(self.tokens(p) for p in parts if p)
        if RUN.search(text):
            return self._piecewise(text)
        # Without neighbouring white space, a piece ends before every space.
        first, *rest = text.split(" ")
        return self._piecewise(first) + sum(map(self.spaced.__getitem__, rest))

    def chunk_map(self, text: str) -> tuple[str, int, str | None]:
        """(head, tokens, tail) of a chunk; without a place where pieces always end, tail is None."""
        first = SYNC.search(text)
        if first is None:
            return text, 0, None
        at = end = first.start()
        for place in SYNC.finditer(text, at):
            end = place.start()
        return text[:at], self.tokens(text[at:end]), text[end:]

    def compose(self, a: tuple[str, int, str | None], b: tuple[str, int, str | None]) -> tuple[str, int, str | None]:
        """The map of two neighbouring chunks. A place may also lie exactly between them."""
        middle = (a[0] if a[2] is None else a[2]) + b[0]
        cut = [m.start() for m in SYNC.finditer(middle)]
        if a[2] is None and b[2] is None:
            return (middle, 0, None) if not cut else (middle[: cut[0]], self.tokens(middle[cut[0] : cut[-1]]), middle[cut[-1] :])
        if a[2] is None:
            return (middle, b[1], b[2]) if not cut else (middle[: cut[0]], self.tokens(middle[cut[0] :]) + b[1], b[2])
        if b[2] is None:
            return (a[0], a[1], middle) if not cut else (a[0], a[1] + self.tokens(middle[: cut[-1]]), middle[cut[-1] :])
        return a[0], a[1] + self.tokens(middle) + b[1], b[2]

    def scan(self, maps: list[tuple[str, int, str | None]]) -> int:
        """Tokens of a text from its chunks' maps, composed pairwise as a tree."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self.tokens(head) + n + (self.tokens(tail) if tail else 0)


_counters: dict[str, Counter] = {}


def _counter(name: str) -> Counter:
    """One counter per worker; the vocabulary is a file that the session ships to executors."""
    if name not in _counters:
        _counters[name] = Counter(SparkFiles.get(name))
    return _counters[name]


def _short(name: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        counter = _counter(name)
        for batch in batches:
            n = [counter.tokens(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def _chunks(size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                text = row.column("text")[0].as_py()
                for at in range(0, len(text), size):
                    yield pa.RecordBatch.from_arrays(
                        [row.column("doc_id"), row.column("n_bytes"), row.column("u"), pa.array([at // size]), pa.array([text[at : at + size]])],
                        names=["doc_id", "n_bytes", "u", "no", "chunk"],
                    )

    return run


def _maps(name: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        counter = _counter(name)
        for batch in batches:
            maps = [counter.chunk_map(t.as_py()) for t in batch.column("chunk")]
            columns = [pa.array(c, t) for c, t in zip(zip(*maps, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)] if maps else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "n_bytes", "u", "no")], *columns], names=["doc_id", "n_bytes", "u", "no", "head", "n", "tail"])

    return run


def _composed(name: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        counter = _counter(name)
        for batch in batches:
            n = [counter.scan([(m["head"], m["n"], m["tail"]) for m in maps.as_py()]) for maps in batch.column("maps")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), batch.column("rows")], names=["doc_id", "n_bytes", "n_tokens", "rows"]
            )

    return run


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = 1024, chunk_chars: int = CHUNK_CHARS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit. ``vocabulary`` is the path of a .json file."""
    sc = docs.sparkSession.sparkContext
    name = vocabulary.rsplit("/", 1)[-1]
    if name not in [f.rsplit("/", 1)[-1] for f in sc.listFiles]:
        sc.addFile(vocabulary)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    long_ = F.length("text") > chunk_chars
    short = named.where(~long_).mapInArrow(_short(name), "doc_id long, n_bytes long, n_tokens long")
    maps = (
        named.where(long_).withColumn("u", F.xxhash64("text"))
        .mapInArrow(_chunks(chunk_chars), "doc_id long, n_bytes long, u long, no long, chunk string")
        .repartition("u", "doc_id", "no")
        .mapInArrow(_maps(name), "doc_id long, n_bytes long, u long, no long, head string, n long, tail string")
    )
    whole = maps.groupBy("doc_id", "n_bytes", "u").agg(
        F.array_sort(F.collect_set(F.struct("no", "head", "n", "tail"))).alias("maps"), F.count_if(F.col("no") == 0).alias("rows")
    )
    scanned = (
        whole.select("doc_id", "n_bytes", "rows", "maps").mapInArrow(_composed(name), "doc_id long, n_bytes long, n_tokens long, rows long")
        .withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select("doc_id", "n_bytes", "n_tokens")
    )
    return short.unionAll(scanned).withColumn("over_limit", F.col("n_tokens") > limit)
