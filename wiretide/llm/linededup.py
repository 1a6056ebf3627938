"""Line dedup by a suffix array over line IDs, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wiretide.llm.common import WS, join_spread, row_key, store

#: Lines of a repeated run at least, or words of one that has fewer.
MIN_LINES, MIN_WORDS = 3, 50


def line_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _k, ids, words): the line IDs of each document, 64-bit hashes, and the words of each line. Rows that agree in id and text are one document."""
    lines = F.split(text_col, "\n")
    made = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_k"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("ids"), F.transform(lines, lambda x: F.regexp_count(x, F.lit(f"[^{WS}]+"))).alias("words"),
    )
    return made.dropDuplicates(["_id", "_k"])


def _ranked(at: DataFrame, *by: str) -> DataFrame:
    """The positions whose values in by occur more than once, with their rank and its first position, by id (null first) and line.

    Ranks keep the order of the values, so positions of equal rank are an interval of the suffix array. What is counted and
    ordered are distinct values; a value that many positions hold is salted when it is joined back.
    """
    groups = at.groupBy(*by).agg(F.count("*").alias("_n"), F.min(F.struct("_id", "_k", "_at")).alias("first")).where("_n > 1")
    order = store(groups.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()))
    return store(join_spread(at, order, list(by), "_n").select("_id", "_k", "_at", "head", "words", "rank", "first"))


def repeated_prefixes(ids: DataFrame, min_lines: int, min_words: int) -> list[tuple[int, DataFrame]]:
    """(depth, positions) for growing depths: the suffixes whose first depth lines begin another suffix too, with the rank of that
    prefix and its first position. Equal ranks are the intervals of the suffix array of longest common prefix depth or more.

    Depths grow by one up to min_lines, as shorter runs may hold min_words words, and double from there on until no prefix is
    repeated: the rank by 2h lines is the rank of the pair of ranks by h lines, here and h lines on. A suffix whose prefix is
    unique at h stays so, hence it leaves after each round, and the rounds are as many as the logarithm of the longest repeat.
    Each is a union grouped by position, a count, a range sort of the distinct pairs and a join back; nothing is gathered.
    """
    lines = ids.select("_id", "_k", F.posexplode(F.arrays_zip("ids", "words")).alias("_at", "line")).select("_id", "_k", "_at", F.col("line.words").alias("head"), F.col("line.words").alias("words"), F.col("line.ids").alias("line"))
    now, h, found = _ranked(lines, "line"), 1, []
    while not now.isEmpty():
        found.append((h, now if h >= min_lines else now.where(F.col("words") >= min_words)))
        step = 1 if h < min_lines else h
        words = F.col("head") + F.col("more") if h < min_lines else F.lit(0)  # only runs below min_lines are weighed by words
        place = ["_id", "_k", "_at"]
        here = now.select(*place, "head", F.col("rank").alias("first_rank"), F.lit(None).cast("long").alias("next"), F.lit(None).cast("int").alias("more"))
        on = now.select("_id", "_k", F.col("_at") - step, F.lit(None).cast("int"), F.lit(None).cast("long"), "rank", "words")
        both = here.union(on).groupBy(*place).agg(*[F.max(c).alias(c) for c in ("head", "first_rank", "next", "more")]).where("first_rank is not null and next is not null")
        now, h = _ranked(both.select(*place, "head", words.alias("words"), "first_rank", "next"), "first_rank", "next"), h + step
    return found


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _k, start, n_lines, copy_id, copy_k, copy_start): the runs of lines, from 0, of each document that an earlier place holds
    too, and that place: a document of smaller id (null first) or row key, or lines before. A run ends where the two differ.

    Each position takes the deepest interval in which it isn't first, and from it the nearest copy in its own document or else
    the first of all. Positions in a row whose copies are in a row make one run, which goes as far as their prefixes; as
    the prefix of a position is known up to a doubling only, what follows is compared line by line, over less than the depth.
    All this is dealt by document, whose positions its text bounds; a document that very many runs copy is salted.
    """
    ids = store(line_ids(docs, id_col, text_col))
    levels = [p.select("_id", "_k", "_at", F.lit(d).alias("depth"), "rank", "first") for d, p in repeated_prefixes(ids, min_lines, min_words)]
    if not levels:
        return ids.select("_id", "_k", F.lit(0).alias("start"), F.lit(0).alias("n_lines"), F.col("_id").alias("copy_id"), F.col("_k").alias("copy_k"), F.lit(0).alias("copy_start")).limit(0)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    document = ["_id", "_k"]
    before = F.lag("_at").over(Window.partitionBy(*document, "depth", "rank").orderBy("_at"))
    copied = every.repartition(*document).withColumn("_before", before).where(F.col("_before").isNotNull() | ~F.col("first").eqNullSafe(F.struct("_id", "_k", "_at")))
    copy = F.when(F.col("_before").isNotNull(), F.struct("_id", "_k", F.col("_before").alias("_at"))).otherwise(F.col("first"))
    deepest = copied.withColumn("_copy", copy).groupBy(*document, "_at").agg(F.max("depth").alias("depth"), F.max_by("_copy", "depth").alias("_copy"))
    order = Window.partitionBy(*document).orderBy("_at")
    last = F.lag(F.struct("_at", "_copy")).over(order)
    goes_on = (last["_at"] == F.col("_at") - 1) & last["_copy"]["_id"].eqNullSafe(F.col("_copy._id")) & (last["_copy"]["_k"] == F.col("_copy._k")) & (last["_copy"]["_at"] == F.col("_copy._at") - 1)
    chained = deepest.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_chain", F.sum("_new").over(order))
    known = store(chained.groupBy(*document, "_chain").agg(F.min("_at").alias("start"), F.max(F.struct((F.col("_at") + F.col("depth")).alias("end"), "depth")).alias("_to"), F.min_by("_copy", "_at").alias("_copy")).select(
        *document, "start", F.col("_to.end").alias("end"), F.col("_to.depth").alias("depth"), F.col("_copy._id").alias("copy_id"), F.col("_copy._k").alias("copy_k"), F.col("_copy._at").alias("copy_start")))
    # line by line beyond what the depths say: fewer lines than the depth, of either document
    mine = ids.select(F.col("_id").alias("_a"), F.col("_k").alias("_b"), F.col("ids").alias("_lines"))
    with_own = known.join(mine, F.col("_id").eqNullSafe(F.col("_a")) & (F.col("_k") == F.col("_b"))).withColumn("_own", F.slice("_lines", F.col("end") + 1, F.col("depth"))).drop("_a", "_b", "_lines")
    asked = with_own.withColumn("_key", F.xxhash64("copy_id", "copy_k"))
    counted = store(known.groupBy(F.xxhash64("copy_id", "copy_k").alias("_key"), "copy_id", "copy_k").agg(F.count("*").alias("_n")))
    theirs = counted.join(mine, F.col("copy_id").eqNullSafe(F.col("_a")) & (F.col("copy_k") == F.col("_b"))).select("_key", F.col("copy_id").alias("_a"), F.col("copy_k").alias("_b"), F.col("_lines"), "_n")
    both = join_spread(asked, theirs, ["_key"], "_n", counted).where(F.col("copy_id").eqNullSafe(F.col("_a")) & (F.col("copy_k") == F.col("_b")))
    there = F.slice("_lines", F.col("copy_start") + (F.col("end") - F.col("start")) + 1, F.col("depth"))
    differs = F.array_position(F.zip_with("_own", there, lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(False))  # past an end is unlike
    more = F.when(F.size("_own") == 0, 0).when(differs > 0, differs - 1).otherwise(F.size("_own"))
    return both.select(*document, "start", (F.col("end") - F.col("start") + more).cast("int").alias("n_lines"), "copy_id", "copy_k", "copy_start")


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _k, gone array<int>): per document the lines, from 0, that lie in a run of repeated_runs(). Documents that lose no line are absent."""
    runs = repeated_runs(docs, id_col, text_col, min_lines, min_words).repartition("_id", "_k").withColumn("_end", F.col("start") + F.col("n_lines"))
    order = Window.partitionBy("_id", "_k").orderBy("start", "_end")
    reach = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = runs.withColumn("_new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order)).groupBy("_id", "_k", "_island").agg(F.min("start").alias("_a"), F.max("_end").alias("_b"))
    return merged.groupBy("_id", "_k").agg(F.sort_array(F.flatten(F.collect_list(F.sequence("_a", F.col("_b") - 1)))).alias("gone"))


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with _wt_gone, the lines to delete, and _wt_kept, the text that is left."""
    gone = later_copies(docs, id_col, text_col, min_lines, min_words).select(F.col("_id").alias("_wt_id"), F.col("_k").alias("_wt_k"), F.col("gone").alias("_wt_gone"))
    rows = docs.withColumn("_wt_key", row_key(id_col, text_col))
    joined = rows.join(gone, (rows["_wt_key"] == gone["_wt_k"]) & rows[id_col].eqNullSafe(gone["_wt_id"]), "left").drop("_wt_id", "_wt_k", "_wt_key")
    left = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_wt_gone")), lambda i: F.get(lines, i))
    kept = F.get(F.transform(F.array(F.split(F.col(text_col), "\n")), lambda lines: F.array_join(left(lines), "\n")), F.lit(0))  # the array of one binds the split lines, which are then made once
    return joined.withColumn("_wt_kept", F.when(F.col("_wt_gone").isNull(), F.col(text_col)).otherwise(kept))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all columns and rows, without the later copies of repeated line runs in the text.

    A run is min_lines or more consecutive lines (split at line feeds, compared exactly, blank ones included) of one document, or
    fewer that hold min_words words; all its copies but the first, by id and line, are deleted, within a document too. Rows
    that agree in id and text are one document: both lose the same lines. A null text stays null; a text may become empty; an
    empty table stays empty. Columns of any names pass, but for those that start with _wt_.

    Lines are compared by 64-bit hashes. A line, or a rank, that a third of the documents share is one row of a partial
    aggregate, and its positions are dealt by salt when it is joined back; each document's positions are bounded by its text.
    """
    return mark(docs, id_col, text_col, min_lines, min_words).withColumn(text_col, F.col("_wt_kept")).drop("_wt_gone", "_wt_kept")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, kept_text): n_runs counts the maximal deleted runs. A null text has no lines and is empty."""
    found = mark(docs, id_col, text_col, min_lines, min_words)
    gone = F.coalesce("_wt_gone", F.array().cast("array<int>"))
    starts = F.filter(gone, lambda x, i: (i == 0) | (F.get(gone, i - 1) != x - 1))
    return found.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"), F.size(starts).cast("long").alias("n_runs"), F.coalesce("_wt_kept", F.lit("")).alias("kept_text"),
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    from wiretide.llm.common import table

    out = report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: Windows of one, two and three lines in place of runs: a run of three lines or more is made of such windows, and a shorter one is one.
ORACLE_OP8 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
n AS (SELECT *, len(list_filter(regexp_split_to_array(line, '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '')) AS n FROM l),
w AS (SELECT *, lead(line, 1) OVER d AS b, lead(line, {MIN_LINES - 1}) OVER d AS c, lead(n, 1) OVER d AS nb FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, {MIN_LINES} AS h, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, i) AS k FROM w WHERE c IS NOT NULL
  UNION ALL SELECT doc_id, i, 2, row_number() OVER (PARTITION BY line, b ORDER BY doc_id, i) FROM w WHERE n + nb >= {MIN_WORDS}
  UNION ALL SELECT doc_id, i, 1, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) FROM w WHERE n >= {MIN_WORDS}),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + h)) AS i FROM r WHERE k > 1),
k AS (SELECT l.*, g.i IS NOT NULL AS gone FROM l LEFT JOIN g USING (doc_id, i)),
m AS (SELECT *, lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k),
a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_runs,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN a USING (doc_id)
"""
