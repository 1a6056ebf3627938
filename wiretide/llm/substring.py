"""Substring dedup: fixed-block anchors, rolling probes, and extension to maximal exact repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wiretide.llm.common import as_bytes, partitions, session_of
from wiretide.llm.wordhash import CHECK_STEP, ngrams, starts_within, word_hashes

#: Words of a repeat at least.
WINDOW = 13
#: Bytes of text in a chunk: the unit that is hashed, asks and is answered.
CHUNK = 6_000_000
#: Bytes of text for each bucket of hashes, about 2 million words; and buckets at most.
BUCKET, BUCKETS = 12_000_000, 1 << 18
_ANCHORS = "role int, chunk long, bucket int, hashes binary"
_WINDOWS = "chunk long, bucket int, hashes binary, checks binary, ids binary"


def _planes(values: np.ndarray) -> bytes:
    """Ascending numbers as differences, split into byte planes: the planes of high bytes are zeros and compress away."""
    if not values.size:
        return b""
    return np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel(), dtype=kind)


def _by_bucket(sorted_hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Where each bucket's hashes lie: a bucket is a range of the upper 32 bits."""
    of = ((sorted_hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    at = np.flatnonzero(np.diff(of, prepend=np.uint64(1 << 40)))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(of)]):
        yield int(of[a]), slice(a, b)


class _Chunk:
    """The documents of a chunk with their hashes; words is where each document's words start."""

    def __init__(self, rows: pa.Table, window: int) -> None:
        self.ids = rows["doc_id"].to_numpy()
        self.texts = [x.as_py() for x in rows["text"]]
        self.hashes, self.words = word_hashes(self.texts)
        self.window, self.block = window, (window + 1) // 2

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, place and document of all n-grams."""
        at = np.flatnonzero(starts_within(self.words, n))
        return ngrams(self.hashes, n)[at], at, np.searchsorted(self.words, at, side="right") - 1

    def checks(self, at: np.ndarray) -> np.ndarray:
        """32 bits of a second hash of the windows at some places: windows are equal if both hashes are."""
        return ngrams(self.hashes, self.window, CHECK_STEP)[at].astype(np.uint32)


def _ask(chunk: _Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of all rolling blocks, the probes, and of the non-overlapping blocks, the index."""
    hashes, at, doc = chunk.grams(chunk.block)
    return np.unique(hashes), np.unique(hashes[(at - chunk.words[doc]) % chunk.block == 0])


def _short(hashes: np.ndarray) -> np.ndarray:
    """The 32 bits below those that pick the bucket are enough for a filter; what follows is exact."""
    return np.unique(hashes.astype(np.uint32))


def _fresh(hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Marks the first of each run of equal windows, in order of hash and check."""
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
    return new


def _find(hashes: np.ndarray, checks: np.ndarray, of: np.ndarray, of_check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in windows ordered by hash each of others is, and whether it is there. Where hashes collide, the check decides."""
    at = np.minimum(np.searchsorted(hashes, of), len(hashes) - 1)
    while True:
        collides = (hashes[at] == of) & (checks[at] != of_check) & (at + 1 < len(hashes))
        if not collides.any():
            return at, (hashes[at] == of) & (checks[at] == of_check)
        at[collides] += 1


def _candidates(chunk: _Chunk, hits: dict[int, np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place and document of the windows around blocks that another document has too: those that the buckets report, and
    those that two documents of the chunk share."""
    hashes, at, doc = chunk.grams(chunk.block)
    live = np.zeros(len(hashes), bool)
    order = np.argsort(hashes, kind="stable")
    run = hashes[order]
    same = run[1:] == run[:-1]
    other = same & (doc[order][1:] != doc[order][:-1])
    if other.any():
        live |= np.isin(hashes, run[1:][other])
    for bucket, part in _by_bucket(run, buckets):
        if bucket in hits:
            live[order[part]] |= np.isin(run[part].astype(np.uint32), hits[bucket])
    near = np.zeros(int(chunk.words[-1]) + 1, np.int32)
    first = np.maximum(at[live] - (chunk.window - chunk.block), chunk.words[doc[live]])
    np.add.at(near, first, 1)
    np.add.at(near, at[live] + 1, -1)
    near = np.cumsum(near) > 0
    windows, place, of = chunk.grams(chunk.window)
    keep = near[place]
    return windows[keep], place[keep], of[keep]


def _result(chunk: _Chunk, least: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """Removes what windows cover that start in a document of smaller id: in this chunk, or by the ids that the buckets report."""
    windows, place, of = chunk.grams(chunk.window)
    checks = chunk.checks(place)
    order = np.lexsort((chunk.ids[of], checks, windows))
    new = _fresh(windows[order], checks[order])
    first = chunk.ids[of[order]][new]
    keys, checks = windows[order][new], checks[order][new]
    for bucket, part in _by_bucket(keys, buckets):
        if bucket in least:
            hashes, told, ids = least[bucket]
            found, there = _find(hashes, told, keys[part], checks[part])
            first[part] = np.where(there, np.minimum(ids[found], first[part]), first[part])
    gone = np.zeros(int(chunk.words[-1]) + 1, np.int32)
    hit = place[order][first[np.cumsum(new) - 1] < chunk.ids[of[order]]]
    np.add.at(gone, hit, 1)
    np.add.at(gone, hit + chunk.window, -1)
    gone = np.cumsum(gone)[:-1] > 0
    n_words, n_removed, digests, spans = np.diff(chunk.words), np.zeros(len(chunk.texts), np.int64), [], []
    for d, text in enumerate(chunk.texts):
        words, mine = text.split(), gone[chunk.words[d] : chunk.words[d + 1]]
        edge = np.diff(mine.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        for a, b in reversed(runs):
            del words[a:b]
        n_removed[d] = mine.sum()
        spans.append([{"start": a, "end": b} for a, b in runs])
        digests.append(b" ".join(words))
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk.ids), pa.array(n_words), pa.array(n_removed), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(digests, pa.binary())],
        names=["doc_id", "n_words", "n_removed", "removed", "kept"],
    )


def _shared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of one bucket: the blocks that are in the index and are probed by two chunks or more, told to each chunk that probes them."""
    probes = [(c, _unplanes(h, np.uint32)) for r, c, h in zip(*(rows[k].to_pylist() for k in ("role", "chunk", "hashes"))) if r == 0]
    index = [_unplanes(h, np.uint32) for r, h in zip(rows["role"].to_pylist(), rows["hashes"].to_pylist()) if r == 1]
    if not index or len(probes) < 2:
        return
    every = np.sort(np.concatenate([p for _, p in probes]))
    often = np.unique(every[1:][every[1:] == every[:-1]])
    live = often[np.isin(often, np.unique(np.concatenate(index)), assume_unique=True)]
    del every, often
    bucket = rows["bucket"][0].as_py()
    for chunk, probe in probes:
        hit = live[np.isin(live, probe, assume_unique=True)] if live.size else live
        if hit.size:
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_planes(hit)], pa.binary())], names=["role", "chunk", "bucket", "hashes"])


def _least(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of one bucket: the least document of each window, told to each chunk that has the window only later."""
    parts = [(c, *_told(h, k, i)) for c, h, k, i in zip(*(rows[n].to_pylist() for n in ("chunk", "hashes", "checks", "ids")))]
    if len(parts) < 2:
        return
    hashes, checks, ids = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    order = np.lexsort((ids, checks, hashes))
    hashes, checks, ids = hashes[order], checks[order], ids[order]
    new = _fresh(hashes, checks)
    keys, marks, least = hashes[new], checks[new], ids[new]
    del hashes, checks, ids, order
    bucket = rows["bucket"][0].as_py()
    for chunk, mine, check, own in parts:
        found = least[_find(keys, marks, mine, check)[0]]
        told = found < own
        if told.any():
            columns = [_planes(mine[told]), check[told].tobytes(), found[told].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)], names=["chunk", "bucket", "hashes", "checks", "ids"])


def _told(hashes: bytes, checks: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _unplanes(hashes, np.uint64), np.frombuffer(checks, np.uint32), np.frombuffer(ids, np.int64)


def _grouped(schema: str, run):
    """A function of a group of rows for applyInArrow."""

    def of(rows: pa.Table) -> pa.Table:
        batches = list(run(rows))
        return pa.Table.from_batches(batches) if batches else schema_table(schema)

    return of


def schema_table(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<struct<start:int,end:int>>": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]).empty_table()


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, removed array<struct<start, end>>, kept binary) for every row of docs.

    Removed is every word that a window of that many consecutive words covers whose word sequence also starts in a document of
    smaller id; removed holds the maximal runs of such words, kept the other words joined by a space. Windows are those of
    the input. Ids are integers. A row with a null id keeps all and is no reference; rows of equal id aren't smaller than
    one another; a null text has no words. An empty table gives an empty one; other columns are not read. Any length of text
    is taken whole. Windows are equal if a 64-bit hash and 32 bits of a second one are.

    Documents are dealt by hash into chunks of about CHUNK bytes; that exchange is the only one of texts and is used three
    times. (1) Each chunk sends the distinct hashes of its non-overlapping blocks of (window + 1) / 2 words, the index, and of
    all its rolling blocks, the probes, to buckets, of which each tells the chunks what they share: every window holds one
    block of the index wherever it starts, so nothing is missed. (2) Windows around such blocks go with the chunk's least
    document to buckets, which answer with the least of all. (3) The chunk extends the hits to maximal runs. A chunk sends a
    hash once, however many of its documents hold it, so a passage that a third of all documents share costs as many entries
    as there are chunks.
    """
    spark = session_of(docs)
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(partitions(spark), -(-size // CHUNK))
    buckets = min(BUCKETS, max(partitions(spark), -(-size // BUCKET)))
    dealt = whole.where("doc_id is not null").select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long").alias("chunk"), "doc_id", as_bytes("text").alias("text"))

    def ask(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        chunk = rows["chunk"][0].as_py()
        for role, hashes in enumerate(_ask(_Chunk(rows, window))):
            parts = [(b, _planes(_short(hashes[part]))) for b, part in _by_bucket(hashes, buckets)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([role] * n, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array([b for b, _ in parts], pa.int32()), pa.array([h for _, h in parts], pa.binary())], names=["role", "chunk", "bucket", "hashes"])

    def extend(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema_table(_WINDOWS)
        chunk = _Chunk(rows, window)
        hits = {b: _unplanes(h, np.uint32) for b, h in zip(told["bucket"].to_pylist(), told["hashes"].to_pylist())}
        windows, place, of = _candidates(chunk, hits, buckets)
        checks = chunk.checks(place)
        order = np.lexsort((chunk.ids[of], checks, windows))
        order = order[_fresh(windows[order], checks[order])]
        windows, checks, ids = windows[order], checks[order], chunk.ids[of[order]]
        parts = [(b, _planes(windows[part]), checks[part].tobytes(), ids[part].tobytes()) for b, part in _by_bucket(windows, buckets)]
        return pa.table([pa.array([rows["chunk"][0].as_py()] * len(parts), pa.int64()), pa.array([p[0] for p in parts], pa.int32()), *(pa.array([p[k] for p in parts], pa.binary()) for k in (1, 2, 3))], names=["chunk", "bucket", "hashes", "checks", "ids"])

    result = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept binary"

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema_table(result)
        least = {b: _told(h, k, i) for b, h, k, i in zip(*(told[n].to_pylist() for n in ("bucket", "hashes", "checks", "ids")))}
        return pa.Table.from_batches([_result(_Chunk(rows, window), least, buckets)])

    asked = dealt.groupBy("chunk").applyInArrow(_grouped(_ANCHORS, ask), _ANCHORS)
    shared = asked.groupBy("bucket").applyInArrow(_grouped(_ANCHORS, _shared), _ANCHORS)
    windows = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(extend, _WINDOWS)
    least = windows.groupBy("bucket").applyInArrow(_grouped(_WINDOWS, _least), _WINDOWS)
    found = dealt.groupBy("chunk").cogroup(least.groupBy("chunk")).applyInArrow(finish, result)
    lone = whole.where("doc_id is null").select("doc_id", as_bytes("text").alias("text"))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [x.as_py().split() for x in batch.column(1)]
            n = len(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([0] * n, pa.int64()), pa.array([[]] * n, schema_table(result).schema.field("removed").type), pa.array([b" ".join(w) for w in words], pa.binary())], names=["doc_id", "n_words", "n_removed", "removed", "kept"])

    return found.unionByName(lone.mapInArrow(alone, result))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from wiretide.llm.common import table

    out = repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_OP2 = f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) < {WINDOW} THEN [] ELSE list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' ')) END) AS g,
  unnest(range(1, greatest(1, len(w) - {WINDOW - 2}))) AS i FROM w),
f AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS m FROM g) WHERE m < doc_id),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM f),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT p.*, r.i IS NOT NULL AS gone FROM p LEFT JOIN r USING (doc_id, i)),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN a USING (doc_id)
"""
