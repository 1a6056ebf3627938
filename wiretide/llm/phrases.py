"""Phrase collocations by dynamic itemset counting."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from wiretide.llm.common import folder, partitions, store, table

#: Parts of the corpus that are scanned in turn, occurrences of a phrase that matter, and words of the longest phrase.
SHARDS, LEAST, LONGEST = 4, 30, 4
#: A phrase goes if a longer one that holds it has this percentage of its occurrences; phrases told of a language.
COVERED, TOP = 80, 2000
#: Bits of each filter of frequent phrases that goes to the workers: 4 MB, whatever the input. False positives, 2 in 100 at
#: 2.5 million phrases, cost counting; a full filter only stops sparing it.
BITS = 1 << 25
#: Characters of text that are encoded together, and positions that a task holds before it adds them up.
CHUNK, HELD = 1 << 24, 1 << 23
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _word_hashes(lang: str, words) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in words), np.uint64, len(words))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    return _mix(h * _MULTIPLIER + word)


def _keys(h: np.ndarray, parts: int) -> np.ndarray:
    """A phrase's key: its part, by the upper half of its hash, and the lower half. Phrases that share a key are counted as one."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _slots(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    x, mask = _mix(keys * _MULTIPLIER), np.uint64(size - 1)
    return (x & mask).astype(np.int64), (x >> np.uint64(32) & mask).astype(np.int64)


def _holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    one, two = _slots(keys, len(bits) << 6)
    at = lambda i: bits[i >> 6] >> (i & 63).astype(np.uint64)
    return (at(one) & at(two) & np.uint64(1)).astype(bool)


def _encoded(told: DataFrame, shards: int) -> DataFrame:
    """(shard, lang, codes, hashes, words) of (lang, text), in which a space parts words and a line end is the word that parts pieces: a
    row for each language of some texts, with its distinct words, their hashes, and the number of the word at each position. Word 0 is the line end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[str, list[str]] = {}
        held, nth = 0, TaskContext.get().partitionId()

        def out() -> Iterator[pa.RecordBatch]:
            for i, lang in enumerate(sorted(groups)):
                tokens = np.array(("\n " + " \n ".join(groups.pop(lang))).split(" "), dtype=object)
                codes, words = pd.factorize(tokens[tokens != ""])
                row = [[(nth + i) % shards], [lang], [codes.astype(np.int32).tobytes()], [_word_hashes(lang, words).tobytes()], [" ".join(words)]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.string()))], names=["shard", "lang", "codes", "hashes", "words"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                groups.setdefault(lang, []).append(text)
                held += len(text)
                if held >= CHUNK:
                    yield from out()
                    held, nth = 0, nth + 1
        yield from out()

    return told.mapInArrow(run, "shard int, lang string, codes binary, hashes binary, words string")


def _chain(codes: np.ndarray, hashes: np.ndarray, longest: int, parts: int, every: np.ndarray, old: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes) at the positions of phrases of two words or more all of whose parts are in every, and not all of them in old."""
    keys = _keys(hashes, parts)
    known, new = _holds(every, keys), ~_holds(old, keys)
    at = np.flatnonzero((codes != 0) & known[codes])
    h, fresh = hashes[codes[at]], new[codes[at]]
    for k in range(2, longest + 1):
        i = np.flatnonzero(at[1:] == at[:-1] + 1)
        if not len(i):
            return
        fresh = fresh[i] | fresh[i + 1]
        at, h = at[i], _longer(h[i], hashes[codes[at[i] + k - 1]])
        yield k, h[fresh]
        if k < longest:
            keys = _keys(h, parts)
            known = np.flatnonzero(_holds(every, keys))
            at, h, fresh = at[known], h[known], fresh[known] | ~_holds(old, keys[known])


def _packed(keys: np.ndarray, n: np.ndarray, most: int, shift: int) -> Iterator[pa.RecordBatch]:
    """(part, keys, n), a row for each part, of ascending keys; counts of more than most are that. shift tells the parts of the longest phrases."""
    part = (keys >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    ends = [*cuts[1:].tolist(), len(keys)]
    low, n = keys.astype(np.uint32), np.minimum(n, most).astype(np.min_scalar_type(most))
    rows = [pa.array(part[cuts] + shift, pa.int32())] + [pa.array([x[a:b].tobytes() for a, b in zip(cuts.tolist(), ends)], pa.binary()) for x in (low, n)]
    yield pa.RecordBatch.from_arrays(rows, names=["part", "keys", "n"])


def _added(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs or the sum of its n."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(at, append=len(keys)) if n is None else np.add.reduceat(n, at, dtype=np.int64) if len(at) else n


def _counted(shard: DataFrame, first: bool, longest: int, parts: int, least: int, filters) -> DataFrame:
    """(part, keys, n) of a shard, added up within a task: phrases whose parts filters names, and words if it's the first cycle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, old = filters.value
        held: dict[bool, list[np.ndarray]] = {False: [], True: []}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for last, some in held.items():
                if some:
                    yield from _packed(*_added(np.concatenate(some)), least, parts * last)
                    some.clear()

        for batch in batches:
            for one in zip(*batch.columns):
                codes, hashes = (np.frombuffer(x.as_buffer(), t) for x, t in zip(one, (np.int32, np.uint64)))
                if first:
                    n = np.bincount(codes, minlength=len(hashes))[1:]
                    yield from _packed(*_added(_keys(hashes[1:], parts), n), least, parts * (longest == 1))
                for k, h in _chain(codes, hashes, longest, parts, every, old):
                    if len(h):
                        held[k == longest].append(_keys(h, parts))
                        size += len(h)
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    return shard.select("codes", "hashes").mapInArrow(run, "part int, keys binary, n binary")


def _merged(counted: DataFrame, before: DataFrame, least: int) -> DataFrame:
    """(part, keys, n, risen): the counts of a scan added up, and the keys that occur least times in it and the scans before."""
    kind = np.min_scalar_type(least)

    def run(rows: pa.Table) -> pa.Table:
        def total(some: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            join = lambda c, t: np.frombuffer(b"".join(x.as_py() for x in some.column(c)), t)
            keys, n = _added(join("keys", np.uint32), join("n", kind))
            return keys, np.minimum(n, least).astype(np.int64)

        keys, n = total(rows.filter(pc.field("now")))
        past, m = total(rows.filter(~pc.field("now")))
        all_n = n.copy()
        if len(past) and len(keys):
            at = np.minimum(np.searchsorted(past, keys), len(past) - 1)
            all_n += np.where(past[at] == keys, m[at], 0)
        values = [keys.tobytes(), n.astype(kind).tobytes(), keys[all_n >= least].tobytes()]
        return pa.table([rows.column("part").slice(0, 1).cast(pa.int32()), *[pa.array([v], pa.binary()) for v in values]], names=["part", "keys", "n", "risen"])

    both = counted.withColumn("now", F.lit(True)).unionByName(before.select("part", "keys", "n").withColumn("now", F.lit(False)))
    return both.groupBy("part").applyInArrow(run, "part int, keys binary, n binary, risen binary")


def _risen(log: DataFrame, parts: int, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bits of what rose, of phrases that may be parts and of the longest, as (index, word) of the words that aren't zero: at most size / 64 of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, risen in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys = np.frombuffer(risen.as_buffer(), np.uint32).astype(np.uint64) | np.uint64(part % parts << 32)
                slots = np.concatenate(_slots(keys, size))
                index, inverse = np.unique(slots >> 6, return_inverse=True)
                value = np.zeros(len(index), np.uint64)
                np.bitwise_or.at(value, inverse, np.uint64(1) << (slots & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), part // parts, np.int32)), pa.array(index), pa.array(value.view(np.int64))], names=["which", "at", "bits"])

    made = log.select("part", "risen").where(F.length("risen") > 0).mapInArrow(run, "which int, at long, bits long")
    got = made.groupBy("which", "at").agg(F.bit_or("bits").alias("bits")).toArrow()
    which, at, bits = (got.column(i).to_numpy() for i in range(3))
    return [(at[which == w], bits[which == w].astype(np.int64).view(np.uint64)) for w in (0, 1)]


def _phrases(lang: str, codes: np.ndarray, hashes: np.ndarray, words: list[str], longest: int, parts: int, filters: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(length, phrases, counts) of the phrases in the filters, of those of fewer than longest words and of the longest, told apart by their words; of length 0 the number of words."""
    n = np.bincount(codes, minlength=len(hashes))
    yield 0, pa.array([""]), np.array([len(codes) - n[0]])
    known = _holds(filters[longest == 1], _keys(hashes, parts))
    known[0] = False
    spelled = pa.array(words, pa.string())
    some = np.flatnonzero(known & (n > 0))
    yield 1, spelled.take(pa.array(some)), n[some]
    at = np.flatnonzero(known[codes])
    ids = codes[at].astype(np.int64)
    h = hashes[ids]
    for k in range(2, longest + 1):
        i = np.flatnonzero(at[1:] == at[:-1] + 1)
        last = codes[at[i] + k - 1]
        longer = _longer(h[i], hashes[last])
        own = np.flatnonzero(_holds(filters[k == longest], _keys(longer, parts)))
        if not len(own):
            return
        i, h, last = i[own], longer[own], last[own]
        at, (ids, pairs) = at[i], pd.factorize(ids[i] * len(words) + last)
        first = np.zeros(len(pairs), np.int64)
        first[ids[::-1]] = at[::-1]
        yield k, pc.binary_join_element_wise(*[spelled.take(pa.array(codes[first + j])) for j in range(k)], " "), np.bincount(ids, minlength=len(pairs))


def _spelled(corpus: DataFrame, longest: int, parts: int, filters) -> DataFrame:
    """(lang, k, phrase, n): all occurrences of the phrases in the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, codes, hashes, words in zip(*batch.columns):
                one = np.frombuffer(codes.as_buffer(), np.int32), np.frombuffer(hashes.as_buffer(), np.uint64)
                for k, phrases, n in _phrases(lang.as_py(), *one, words.as_py().split(" "), longest, parts, filters.value):
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(phrases), pa.string()), pa.array(np.full(len(phrases), k, np.int32)), phrases, pa.array(n.astype(np.int64))], names=["lang", "k", "phrase", "n"])

    made = corpus.select("lang", "codes", "hashes", "words").mapInArrow(run, "lang string, k int, phrase string, n long")
    return made.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """(lang, k, phrase, n): the phrases of 1 to longest words that occur at least least times in a language, with all their
    occurrences; the row of k = 0 has the number of its words.

    Dynamic itemset counting: the corpus is dealt into shards, which are scanned in turn. Words are counted from the first scan.
    A longer phrase is counted from the scan after that in which all its parts had been seen least times, for one full cycle, so
    each of its occurrences counts once; short and long ones are counted in the same scans. Parts of a frequent phrase are
    frequent, hence none is missed. There are at most longest cycles.

    A null text is empty, a null language `und`. Only A-Z are lower-cased; . , ; : ! ? and line ends part pieces, spaces and
    tabs part words, phrases don't cross pieces. Repeated rows count each. An empty table gives an empty one. Other columns
    are not read.

    Texts are parted into words once. Scans count by keys, short hashes, so that only keys and counts, packed by part, are
    shuffled; phrases that share a key can only be counted too high. What has been frequent is a filter of fixed size, bits (a
    power of two) in all. A bit never goes, so the scan in which all bits of a phrase were there first is the same for all
    shards, false positives included, and its cycle is whole. A last scan spells the phrases in the filters and counts them by
    their text, which is exact.
    """
    spark = docs.sparkSession
    top, parts = folder(spark), partitions(spark)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.regexp_replace(F.translate(text_col, upper + "\t", lower + " "), r"[.,;:!?\x0A-\x0D]", " \n ")
    told = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    _encoded(told, shards).write.partitionBy("shard").parquet(f"{top}/shards")
    corpus = spark.read.schema("lang string, codes binary, hashes binary, words string, shard int").parquet(f"{top}/shards")

    none = np.zeros(bits >> 6, np.uint64)
    seen, last, step = deque([none] * (shards + 1), shards + 1), none.copy(), 0  # the filter before each scan of a cycle and this one, and that of the longest phrases
    log = lambda at: spark.read.schema("part int, keys binary, n binary, risen binary").parquet(*[f"{top}/scan/{i}" for i in at])
    while step < shards or not np.array_equal(seen[-1], seen[0]):
        filters = spark.sparkContext.broadcast((seen[-1], seen[0]))
        counted = _counted(corpus.where(F.col("shard") == step % shards), step < shards, longest, parts, least, filters)
        before = log(range(max(0, step - shards + 1), step)) if step and shards > 1 else spark.createDataFrame([], "part int, keys binary, n binary")
        _merged(counted, before, least).write.parquet(f"{top}/scan/{step}")
        filters.destroy()
        now = seen[-1].copy()
        for have, (index, value) in zip((now, last), _risen(log([step]), parts, bits)):
            have[index] |= value
        seen.append(now)
        step += 1
    filters = spark.sparkContext.broadcast((seen[-1], last))
    out = store(_spelled(corpus, longest, parts, filters).where((F.col("n") >= least) | (F.col("k") == 0)))
    filters.destroy()
    return out


def collocations(counts: DataFrame, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of what frequent_phrases() returns: each language's first phrases of two words or more.

    score is that of the lowest-scoring cut in two, floor(2000000 a / (l + r)); of equal ones the first cut counts. Phrases whose
    words lie inside a longer one with covered percent of their occurrences are dropped. Order: score and a descending, phrase by
    UTF-8 bytes. Products are decimals. A language's first phrases are found in parts of its phrases, then among those.
    """
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    words = counts.where("k = 0").select("lang", F.col("n").alias("words"))
    known = counts.where("k >= 1")
    some = known.where("k >= 2").select("lang", "k", "phrase", F.col("n").alias("a"))
    cuts = some.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', cut)")).withColumn("tail", F.expr("substring_index(phrase, ' ', cut - k)"))
    of = lambda name, value: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(value))
    cuts = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(38,0)) * 2000000) div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, m), " "))))
    inside = some.where("k >= 3").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (whole("longer") * 100 < whole("a") * covered))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    place = F.pmod(F.xxhash64("phrase"), F.lit(partitions(counts.sparkSession)))
    first = kept.withColumn("_place", place).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_place").orderBy(*order))).where(F.col("rank") <= top).drop("_place", "rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(frequent_phrases(table(spark, sf_dir, "documents")))


ORACLE_OP12 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k),
c AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY lang, k, phrase),
f AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS s FROM c WHERE n >= {LEAST}),
words AS (SELECT lang, sum(n) AS words FROM c WHERE k = 1 GROUP BY lang),
parts AS (SELECT lang, phrase, n AS a, j, array_to_string(s[1:j], ' ') AS head, array_to_string(s[j + 1:], ' ') AS tail FROM f, range(1, {LONGEST}) t(j) WHERE j < k),
left_of AS (SELECT p.*, f.n AS l FROM parts p JOIN f ON f.lang = p.lang AND f.phrase = p.head),
cut AS (SELECT p.*, f.n AS r, (2000000::HUGEINT * a) // (l::HUGEINT + f.n) AS score FROM left_of p JOIN f ON f.lang = p.lang AND f.phrase = p.tail),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
sub AS (SELECT x.lang, array_to_string(x.s[i:i + m - 1], ' ') AS phrase, max(x.n) AS longer FROM f x, range(2, {LONGEST}) t(m), range(1, {LONGEST}) u(i)
  WHERE m < x.k AND i + m - 1 <= x.k GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN sub USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < {COVERED}::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, words::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN words USING (lang) QUALIFY rank <= {TOP}
"""
