"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wiretide.llm.common import as_bytes, session_of

#: Code points with the property White_Space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Classes of characters. QUOTE2 and QUOTE3 are apostrophes before a contraction of 2 and 3 characters, GLUE a space and
#: SINGLE other white space right before a visible character, RUN the rest of white space, END stands between texts.
LETTER, NUMBER, OTHER, QUOTE2, QUOTE3, GLUE, SINGLE, RUN, END = range(9)
#: What kind of slice a character has left open: none, letters, numbers, others, a space that takes the next run along,
#: white space, a contraction that lacks one or two characters.
NONE, LETTERS, NUMBERS, OTHERS, OPEN, BLANK, LACKS1, LACKS2 = range(8)
STATES = 8
#: Characters of a block of the scan.
BLOCK = 64
#: Bytes from which a slice's pairs go into a heap.
LONG = 80
#: Slices that a worker remembers.
CACHED = 300_000
#: Ids that are decoded at once: their bytes' places take about 10 MB.
GATHERED = 250_000
_STOP = 0x110000


@cache
def _table() -> np.ndarray:
    """Class of each code point, without regard to its neighbours."""
    out = np.full(_STOP + 1, OTHER, np.uint8)
    kinds = [unicodedata.category(chr(c))[0] for c in range(_STOP)]
    for c, kind in enumerate(kinds):
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    out[SPACES] = RUN
    out[_STOP] = END
    return out


@cache
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and starts[class, state]: the state after a character, and whether a slice starts with it."""
    follow, starts = np.zeros((9, STATES), np.intp), np.ones((9, STATES), bool)
    for kind, run in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
        follow[kind] = run
        starts[kind, [run, OPEN]] = False
    follow[LETTER, LACKS1], follow[LETTER, LACKS2] = NONE, LACKS1
    starts[LETTER, [LACKS1, LACKS2]] = False
    for kind, lacks in ((QUOTE2, LACKS1), (QUOTE3, LACKS2)):  # an apostrophe inside a run of others, or after its space, is one of them
        follow[kind] = lacks
        follow[kind, [OTHERS, OPEN]] = OTHERS
        starts[kind, [OTHERS, OPEN]] = False
    follow[GLUE], follow[SINGLE], follow[RUN], follow[END] = OPEN, NONE, BLANK, NONE
    starts[RUN, BLANK] = False
    return follow, starts


def classes(points: np.ndarray) -> np.ndarray:
    """Class of each character of a sequence of code points in which _STOP ends each text."""
    out = _table()[points]
    after = np.concatenate((out[1:], [END]))
    last = (out == RUN) & (after != RUN) & (after != END)
    out[last] = np.where(points[last] == 0x20, GLUE, SINGLE)
    at = np.flatnonzero(points == 0x27)
    one = points[np.minimum(at + 1, len(points) - 1)]
    two = points[np.minimum(at + 2, len(points) - 1)]
    out[at[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE2
    out[at[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = QUOTE3
    return out


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where slices start, among them each _STOP, by an associative scan: every character is a function from states to states;
    blocks compose theirs, the compositions are scanned by doubling, and each block then runs on from the state it starts in."""
    follow, starts = _machine()
    kinds = classes(points)
    n = len(kinds)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, END, np.intp)
    padded[:n] = kinds
    steps = np.ascontiguousarray(padded.reshape(rows, BLOCK).T) * STATES
    table = follow.ravel()
    maps = np.tile(np.arange(STATES), (rows, 1))
    for step in steps:
        maps = table.take(step[:, None] + maps)
    reach = 1
    while reach < rows:  # maps[i] becomes the composition of all blocks up to i
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), axis=1)
        reach *= 2
    state = np.concatenate(([NONE], maps[:-1, NONE]))
    begins = np.empty((BLOCK, rows), bool)
    first = starts.ravel()
    for t, step in enumerate(steps):
        at = step + state
        begins[t] = first.take(at)
        state = table.take(at)
    return np.flatnonzero(begins.T.ravel()[:n])


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a long slice by a heap: the adjacent pair of least rank is joined, the leftmost of equals, until none has a rank."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part is known by its start; -1 ends those that are gone
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = end[i]
        if j < 0 or j >= n or ranks.get(piece[i : end[j]]) != rank:
            continue
        end[i], end[j] = end[j], -1
        k = end[i]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[h : end[i]])) is not None:
            heapq.heappush(heap, (r, h))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(out)


class Merger:
    """Merges many short slices at once; each step joins the best pair of every slice that has one left."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.none = 2 * max(ranks.values()) + 2
        joins = sorted((ranks[w[:k]] << 32 | ranks[w[k:]], i) for w, i in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks)
        self.keys, self.made = np.array([k for k, _ in joins], np.int64), np.array([i for _, i in joins], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that two adjacent ids join to."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.made[at], self.none)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of slices of at least one byte each and about the same length."""
        n, width = len(pieces), max(map(len, pieces)) + 1
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        sizes = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < sizes[:, None], self.single[raw], -1)
        pairs = np.full((n, width), self.none)
        pairs[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        after, before = np.tile(np.arange(1, width + 1), (n, 1)), np.tile(np.arange(-1, width - 1), (n, 1))
        rows = np.arange(n)
        while rows.size:
            at = pairs[rows].argmin(axis=1)
            best = pairs[rows, at]
            more = best < self.none
            rows, at, best = rows[more], at[more], best[more]
            gone = after[rows, at]
            then = after[rows, gone]  # at most the width less one: the last column is never part of a slice
            ids[rows, at], ids[rows, gone] = best, -1
            after[rows, at], before[rows, then] = then, at
            pairs[rows, gone] = self.none
            pairs[rows, at] = self.rank(best, ids[rows, then])
            left = before[rows, at]
            has = left >= 0
            r, k = rows[has], left[has]
            pairs[r, k] = self.rank(ids[r, k], best[has])
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, data.splitlines()) if word}


class Codec:
    """Encodes and decodes by the ranks of one vocabulary file."""

    def __init__(self, data: bytes) -> None:
        self.ranks = read_ranks(data)
        self.words: dict[int, bytes] = {i: w for w, i in self.ranks.items()}
        self.sizes = np.zeros(max(self.words, default=0) + 1, np.int64)
        self.sizes[list(self.words)] = [len(w) for w in self.words.values()]
        self.cache: dict[str, tuple[int, ...]] = {}

    @cached_property
    def merger(self) -> Merger:
        """Only a worker that encodes has need of it."""
        return Merger(self.ranks)

    def _learn(self, pieces: set[str]) -> None:
        """Puts the ids of slices into the cache."""
        if len(self.cache) + len(pieces) > CACHED:
            self.cache.clear()
        todo: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[piece] = (whole,)
            elif len(raw) > LONG:
                self.cache[piece] = merge_long(raw, self.ranks)
            else:
                todo.setdefault(len(raw) // 6, []).append((piece, raw))
        for some in todo.values():
            for k in range(0, len(some), 20_000):
                part = some[k : k + 20_000]
                self.cache.update(zip([p for p, _ in part], self.merger.merge([r for _, r in part])))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not texts:
            return []
        points = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
        points[ends] = _STOP
        starts = boundaries(points)
        cuts = np.searchsorted(starts, ends)
        pieces: list[list[str]] = []
        at = base = 0
        for text, cut, end in zip(texts, cuts.tolist(), ends.tolist()):
            marks = (starts[at : cut + 1] - base).tolist()
            pieces.append([text[a:b] for a, b in zip(marks, marks[1:])])
            at, base = cut + 1, end + 1
        used = set().union(*pieces)
        new = used.difference(self.cache)
        if len(self.cache) + len(new) > CACHED:
            new = used
        self._learn(new)
        known = self.cache.__getitem__
        out = [np.fromiter(chain.from_iterable(map(known, some)), np.int32) for some in pieces]
        for piece in new:
            if len(piece) > LONG:
                del self.cache[piece]
        return out

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and where each id's begin; ids that the vocabulary lacks have none."""
        data = np.frombuffer(b"".join(self.words.get(i, b"") for i in range(len(self.sizes))), np.uint8)
        return data, np.concatenate(([0], np.cumsum(self.sizes)[:-1]))

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, list[int]]:
        """The bytes of many lists of ids, whose places are given by their bounds, and the bounds in bytes."""
        ids = np.asarray(ids, np.int64)
        if ids.size and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("an id that the vocabulary lacks")
        data, starts = self.spelled
        sizes = self.sizes[ids]
        until = np.concatenate(([0], np.cumsum(sizes)))
        out = []
        for k in range(0, len(ids), GATHERED):
            mine = slice(k, k + GATHERED)
            n = until[min(k + GATHERED, len(ids))] - until[k]
            out.append(data[np.arange(n) + np.repeat(starts[ids[mine]] - (until[:-1][mine] - until[k]), sizes[mine])].tobytes())
        return b"".join(out), until[bounds].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


_codecs: dict[str, Codec] = {}


def _vocabulary(spark, path: str):
    """A function that gives a worker its codec. The vocabulary file is some MB and doesn't grow with the data; executors get
    it by broadcast and need no such path."""
    with open(path, "rb") as f:
        data = f.read()
    shared, key = spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    def codec() -> Codec:
        if key not in _codecs:
            _codecs[key] = Codec(shared.value)
        return _codecs[key]

    return codec


def _portions(texts: Iterable[str], most: int = 1_000_000) -> Iterator[list[str]]:
    portion, size = [], 0
    for t in texts:
        if portion and size + len(t) > most:
            yield portion
            portion, size = [], 0
        portion.append(t)
        size += len(t)
    if portion:
        yield portion


def _encoding(codec_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of()
        for batch in batches:
            at = 0
            for texts in _portions(b.as_py().decode("utf-8", "replace") for b in batch.column(1)):
                ids = codec.encode_all(texts)
                flat = np.concatenate(ids)
                ends = np.cumsum([0, *map(len, ids)])
                sizes = codec.sizes[flat]
                until = np.concatenate(([0], np.cumsum(sizes)))
                offsets = until[:-1] - np.repeat(until[ends[:-1]], np.diff(ends))
                rows = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(ids)), pa.ListArray.from_arrays(rows, pa.array(flat)), pa.ListArray.from_arrays(rows, pa.array(offsets.astype(np.int32)))],
                    names=["doc_id", "ids", "offsets"],
                )
                at += len(ids)

    return run


def _decoding(codec_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                lists = some.column(1)
                sizes = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
                data, ends = codec.decode_all(lists.flatten().to_numpy(zero_copy_only=False), sizes)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([data[a:b] for a, b in zip(ends, ends[1:])], pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, offsets array<int>): the ids of every whole text by the vocabulary file at path (of the driver),
    and the byte at which each id's piece starts in the text, by which any span can be decoded on its own.

    A null or empty text has no ids. Repeated rows and null ids come out as they go in; other columns are not read. Special
    tokens are ordinary text. Bytes that aren't UTF-8 count as U+FFFD. A text of any length is encoded whole.
    """
    codec_of = _vocabulary(session_of(docs), path)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("text")).mapInArrow(_encoding(codec_of), f"doc_id {kind}, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes that the ids stand for. Null ids count as none; an id that the vocabulary lacks is an error."""
    codec_of = _vocabulary(session_of(encoded), path)
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(_decoding(codec_of), f"doc_id {kind}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded binary): what decode() makes of the ids that encode() gives, row by row. One worker of a task does
    both, so that there is one codec, not two, and the ids cross to the JVM once."""
    codec_of = _vocabulary(session_of(docs), path)
    kind = docs.schema[id_col].dataType.simpleString()
    encoding, decoding = _encoding(codec_of), _decoding(codec_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoding(b.select(["doc_id", "ids"]) for b in encoding(batches))

    return docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what decode() and round_trip() return."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    from wiretide.llm.common import table

    return digests(round_trip(table(spark, sf_dir, "documents"), vocabulary_path()))
