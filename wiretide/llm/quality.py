"""Quality rules with risk-controlled cutoffs, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretide.llm.common import WS, cut, row_key

#: Rules: a document is rejected if the value is above the cutoff. Values are per word or per line, from the counts below.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "word_chars / greatest(n_words, 1)",
}
#: Candidate cutoffs of each rule.
CUTOFFS = {
    "symbols": (0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0),
    "dup_lines": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "repeats": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45),
    "long_words": (6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0),
}
#: Share of good documents of a stratum that all rules together may reject, and the probability that this fails anywhere.
RISK, DELTA = 0.05, 0.05
#: Strata up to which the cutoffs are broadcast, 200 bytes each; more are joined by a shuffle.
STRATA = 10_000
#: A cutoff is of use if it rejects this share of the bad documents, and so many times the share of the good ones.
GAIN, LIFT = 0.02, 10.0


def text_counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The columns in keep, with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the whole text.

    Each row is worked out on its own, so no text is shuffled. Three-word windows are compared by 64-bit hashes. The window
    arrays of a text are sorted once; those without an equal pair, most, skip the second part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    space = " \t\n\x0b\f\r"
    one = docs.select(*keep, text.alias("_text"), F.btrim(text, F.lit(space)).alias("_trimmed"))
    two = one.select(*keep, "_text", F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", f"[{WS}]+")).alias("_words"))
    n = F.size("_words")
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    three = two.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.octet_length("_text") - F.octet_length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{WS}]")).alias("_lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<bigint>")).alias("_hashes"),
    )
    pairs = F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(F.transform("_hashes", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    four = three.select(
        *keep, "n_words", "word_chars", "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        pairs.alias("_pairs"),
    )
    same = lambda s, i: F.coalesce((i > 0) & (F.get("_pairs", i - 1)["x"] == s["x"]), F.lit(False)) | F.coalesce(F.get("_pairs", i + 1)["x"] == s["x"], F.lit(False))
    five = four.withColumn("_at", F.sort_array(F.transform(F.filter("_pairs", same), lambda s: s["i"])))
    covered = F.aggregate(F.transform("_at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return five.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in three-word windows that the text holds twice or more."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series from 16 on, where it is right to 12 digits."""
    n = n.cast("double")
    series = n * F.log(n) - n + 0.5 * F.log(n * 6.283185307179586) + 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * F.pow(n, F.lit(5.0)))
    return F.when(n < 16, F.log(F.factorial(F.least(n, F.lit(16.0)).cast("int")))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial with n trials of probability p; 1 if k is not below the mean, where no bound could hold.

    Summed from k downwards; so far down that what is left out is below double precision.
    """
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    terms = F.least(k, F.ceil(12 * F.sqrt(n * p)) + 50)
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(acc: Column, j: Column) -> Column:
        i = k - j + 1
        t = acc["t"] * (i * (1 - p)) / ((n - i + 1) * p)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    total = F.when(terms >= 1, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1)).cast("long")), start, add, lambda acc: acc["s"])).otherwise(F.lit(1.0))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(top * total)


def choose_cutoffs(labelled: DataFrame, stratum: str = "stratum", good: str = "good", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, cutoffs map<rule, cutoff>): the cutoffs of each stratum that are certified and of use.

    labelled has the counts of text_counts() with a boolean good, one row an independent trial; all of it is the holdout, as nothing else is fitted. A cutoff
    of a rule is certified if the exact binomial bound on its share of rejected good documents is within risk / rules, at the
    level delta / (strata x rules x cutoffs): by Bonferroni all certified cutoffs hold at once, whichever is then picked. Picked
    is the one of largest rejected share of bad less LIFT times that of good documents. Rules without such a cutoff are absent.
    """
    value = {r: F.expr(e) for r, e in RULES.items()}
    tests = [(r, c) for r in RULES for c in CUTOFFS[r]]
    seen = labelled.where(F.col(good).isNotNull()).groupBy(stratum).agg(
        F.count_if(F.col(good)).alias("n_good"), F.count_if(~F.col(good)).alias("n_bad"),
        F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.count_if(F.col(good) & (value[r] > c)).alias("hit_good"), F.count_if(~F.col(good) & (value[r] > c)).alias("hit_bad")) for r, c in tests]).alias("tests"),
    )
    strata = seen.agg(F.count("*").alias("_strata"))
    each = seen.crossJoin(F.broadcast(strata)).select(stratum, "n_good", "n_bad", "_strata", F.inline("tests"))  # one row: the number of strata
    p = risk / len(RULES)
    share_bad, share_good = F.col("hit_bad") / F.greatest("n_bad", F.lit(1)), F.col("hit_good") / F.greatest("n_good", F.lit(1))
    fine = each.where((share_bad >= GAIN) & (share_bad >= LIFT * share_good)).withColumn("tail", binomial_tail(F.col("hit_good"), F.col("n_good"), p)).where(F.col("tail") <= F.lit(delta / len(tests)) / F.col("_strata"))
    best = fine.groupBy(stratum, "rule").agg(F.max_by("cutoff", F.struct(share_bad - LIFT * share_good, -F.col("cutoff"))).alias("cutoff"))
    return best.groupBy(stratum).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def select_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """docs, all columns, without the rows that judge() rejects. Rows that agree in id and text have the same verdict."""
    good = _judged(docs, labels, id_col, text_col, stratum_col).where("kept").select(F.col("doc_id").alias("_wt_id"), F.col("_key").alias("_wt_good")).distinct()
    rows = docs.withColumn("_wt_key", row_key(id_col, text_col))
    return rows.join(good, (rows["_wt_key"] == good["_wt_good"]) & rows[id_col].eqNullSafe(good["_wt_id"]), "left_semi").drop("_wt_key")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, kept) for every row of docs.

    kept is false where base_failed, or where a rule's value is above the cutoff that choose_cutoffs() certifies for the row's
    stratum. labels has an id and quality (1 good, 0 bad, null unknown). A null text has no words and fails; null strata are a
    stratum of their own; rows with a null id can't be labelled. A distinct text of a stratum is one trial, however many rows,
    copies and labels it has, as the binomial bound takes independent ones; where its labels disagree it is none. Only the
    named columns are read. Without labels, or with too few, the base rules alone decide.

    The counts are made once, from one pass over the texts, and written to the checkpoint folder: learning and judging then
    read about 60 bytes a document. At most strata x rules cutoffs are joined back.
    """
    return _judged(docs, labels, id_col, text_col, stratum_col, risk, delta).drop("_key")


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """What judge() returns, with the row's key."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("\x00none")).alias("stratum"), row_key(id_col, text_col).alias("_key"),
        F.xxhash64(text_col).alias("_same"), F.col(text_col).alias("_body"),
    )
    counts = cut(text_counts(rows, "_body", ("doc_id", "stratum", "_key", "_same")))
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min("quality").alias("_low"), F.max("quality").alias("_high"))
    measures = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    trials = counts.where(~base_failed()).join(known, "doc_id").groupBy("stratum", "_same").agg(*[F.first(m).alias(m) for m in measures], F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    cutoffs = cut(choose_cutoffs(trials.where("_low = _high").withColumn("good", F.col("_low") == 1), risk=risk, delta=delta))
    if cutoffs.limit(STRATA + 1).count() <= STRATA:
        cutoffs = F.broadcast(cutoffs)
    above = F.lit(False)
    for rule, value in RULES.items():
        above = above | F.coalesce(F.expr(value) > F.col("cutoffs")[rule], F.lit(False))
    judged = counts.join(cutoffs, "stratum", "left")
    return judged.select("doc_id", "_key", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~above).alias("kept"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    from wiretide.llm.common import table

    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    ws = r"[ \t\n\x0B\f\r]"
    value = {r: e.replace(" / ", "::DOUBLE / ") for r, e in RULES.items()}
    tests = [(r, c) for r in RULES for c in CUTOFFS[r]]
    p = RISK / len(RULES)
    grid = " UNION ALL ".join(
        f"SELECT stratum, '{r}' AS rule, {c}::DOUBLE AS cutoff, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS nb, "
        f"count(*) FILTER (good AND {value[r]} > {c}) AS k, count(*) FILTER (NOT good AND {value[r]} > {c}) AS kb FROM lab GROUP BY stratum"
        for r, c in tests
    )
    above = " OR ".join(f"coalesce({value[r]} > (SELECT cutoff FROM best b WHERE b.stratum = c.stratum AND b.rule = '{r}'), false)" for r in RULES)
    failed = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, 'none?') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, stratum, text, list_filter(regexp_split_to_array(text, '{ws}+'), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l FROM t),
g AS (SELECT *, CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS g FROM w),
u AS (SELECT row_number() OVER () AS r, * FROM g),
pos AS (SELECT r, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM u),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM pos) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY r),
c AS (SELECT doc_id, stratum, text, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM u LEFT JOIN rep USING (r)),
lab AS (SELECT stratum, any_value(n_words) AS n_words, any_value(word_chars) AS word_chars, any_value(n_symbols) AS n_symbols, any_value(n_lines) AS n_lines,
    any_value(n_dup_lines) AS n_dup_lines, any_value(n_repeat_words) AS n_repeat_words, min(quality) = 1 AS good
  FROM c JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND NOT {failed} GROUP BY stratum, text HAVING min(quality) = max(quality)),
grid AS ({grid}),
fine AS (SELECT *, kb::DOUBLE / greatest(nb, 1) AS sb, k::DOUBLE / greatest(n, 1) AS sg FROM grid),
ok AS (SELECT * FROM fine WHERE sb >= {GAIN} AND sb >= {LIFT} * sg AND k < n * {p} AND
  (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({p}) + (n - i) * ln(1 - {p}))) FROM range(0, k + 1) q(i))
  <= {DELTA} / {len(tests)} / (SELECT count(DISTINCT stratum) FROM lab)),
best AS (SELECT stratum, rule, cutoff FROM ok QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY sb - {LIFT} * sg DESC, cutoff) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND NOT ({above}) AS kept FROM c
"""


ORACLE_OP3 = _oracle()
