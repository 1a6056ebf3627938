"""Personal data by fixed patterns and by bootstrapped contexts, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from wiretide.llm.common import WS, join_spread, store, table

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns. Possessive repeats, and starts only at the head of a run or where the last match ended, change no match:
#: what fails at the head of a run fails at its later characters too. They keep the time linear and the stack flat.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
GATES = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTET = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"
#: A word with a digit or an at sign may be an identifier, less the punctuation around it, if it has so many characters, and so many digits or an at sign.
CANDIDATE, LEAST_CHARS, LEAST_DIGITS = rf"(?<![^{WS}])[^{WS}0-9@]*+[0-9@][^{WS}]*+", 6, 4
PUNCTUATION = "!\"#$%&'()*,-./:;<=>?[\\]^_`{|}~"
#: Characters on either side in which context words are sought, and characters of a word that count.
REACH, WORD = 100, 40
#: A pattern is trusted from so many known instances and this share of all its instances; an instance from this score; rounds.
SUPPORT, TRUST, ACCEPT, ROUNDS = 3, 0.6, 0.7, 3
BLOCK = 64


def _pieces(text: Column, found: Column, pattern: str) -> Column:
    """What lies before, between and after the matches."""
    return F.when(F.size(found) > 0, F.split(text, pattern, -1))


def _lengths(found: str, pieces: str) -> Column:
    return F.transform(found, lambda m, i: F.char_length(F.get(F.col(pieces), i)) + F.char_length(m))


def _sums(lengths: str) -> Column:
    """Sums of blocks, so that a running sum at any place adds up few numbers."""
    n = F.size(lengths)
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, BLOCK), F.lit(0), lambda a, x: a + x))


def _until(lengths: str, sums: str, i: Column) -> Column:
    """The sum of the first i + 1 lengths."""
    add = lambda a, x: a + x
    block = F.floor(i / BLOCK).cast("int")
    return F.aggregate(F.slice(sums, F.lit(1), block), F.lit(0), add) + F.aggregate(F.slice(lengths, block * BLOCK + 1, i % BLOCK + 1), F.lit(0), add)


def _words(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), f"[{WS}]+"), lambda w: w != ""), lambda w: F.substring(w, 1, WORD))


def _contexts(left: Column, right: Column) -> Column:
    """The lexical patterns of a place: two words before it; one on either side; two after it."""
    before, after = _words(F.right(left, F.lit(REACH))), _words(F.left(right, F.lit(REACH)))
    n = F.size(before)
    two = F.when(n >= 2, F.concat_ws(" ", F.get(before, n - 2), F.get(before, n - 1), F.lit("_")))
    one = F.when((n >= 1) & (F.size(after) >= 1), F.concat_ws(" ", F.get(before, n - 1), F.lit("_"), F.get(after, F.lit(0))))
    next_two = F.when(F.size(after) >= 2, F.concat_ws(" ", F.lit("_"), F.get(after, F.lit(0)), F.get(after, F.lit(1))))
    return F.filter(F.array(two, one, next_two), lambda p: p.isNotNull())


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    at = lambda i: F.substring(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda a, i: a + at(i) - F.when(at(i) > 9, 9).otherwise(0))
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether what the pattern of the kind matched counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return ~F.exists(F.split(match, r"\."), lambda part: ~part.rlike(OCTET))
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.when(F.char_length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.char_length(F.translate(match, "+ ().-", "")).between(10, 15)


def _instance(body: Column) -> Column:
    return F.md5(F.lower(body).cast("binary"))


def _span(kind: str) -> Callable[[Column, Column], Column]:
    def span(m: Column, i: Column) -> Column:
        end = _until("_l", "_s", i)
        return F.when(valid(kind, m), F.struct((end - F.char_length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("order"), end.alias("end"), _instance(m).alias("instance"), _contexts(F.get("_p", i), F.get("_p", i + 1)).alias("contexts")))

    return span


def _blank(kind: str) -> Callable[[Column, Column], Column]:
    return lambda m, i: F.concat(F.get("_p", i), F.when(valid(kind, m), F.repeat(F.lit(" "), F.char_length(m))).otherwise(m))


def _base(rows: DataFrame) -> DataFrame:
    """rows with s_<kind>: the valid matches of each kind, with instance and contexts; and masked, the text with them blanked."""
    keep = [c for c in rows.columns if c != "masked"]
    for kind in KINDS:
        gate = F.col("text").contains(GATES[kind]) if GATES[kind] else F.lit(True)
        none = F.array().cast("array<string>")
        rows = rows.withColumn("_f", F.when(gate, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none))
        rows = rows.withColumn("_p", _pieces(F.col("text"), F.col("_f"), PATTERNS[kind]))
        rows = rows.withColumn("_l", _lengths("_f", "_p")).withColumn("_s", _sums("_l"))
        rows = rows.withColumn(f"s_{kind}", F.filter(F.transform("_f", _span(kind)), lambda s: s.isNotNull()))
        rows = rows.select(*keep, "masked", f"s_{kind}")
        keep.append(f"s_{kind}")
        # what is masked is sought anew in the masked text, as kinds may overlap
        rows = rows.withColumn("_f", F.when(F.size(f"s_{kind}") > 0, F.regexp_extract_all("masked", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none))
        rows = rows.withColumn("_p", _pieces(F.col("masked"), F.col("_f"), PATTERNS[kind]))
        rows = rows.select(*keep, F.when(F.size("_f") > 0, F.concat(F.array_join(F.transform("_f", _blank(kind)), ""), F.element_at("_p", -1))).otherwise(F.col("masked")).alias("masked"))
    return rows


def _candidates(rows: DataFrame) -> DataFrame:
    """rows, without text, with candidates: words of the masked text that may be identifiers, with instance and contexts."""
    keep = [c for c in rows.columns if c not in ("text", "masked")]
    rows = rows.withColumn("_f", F.regexp_extract_all("masked", F.lit(CANDIDATE), F.lit(0)))
    rows = rows.withColumn("_p", _pieces(F.col("masked"), F.col("_f"), CANDIDATE)).withColumn("_l", _lengths("_f", "_p")).withColumn("_s", _sums("_l"))

    def span(m: Column, i: Column) -> Column:
        head = F.ltrim(m, F.lit(PUNCTUATION))
        body = F.rtrim(head, F.lit(PUNCTUATION + "+@"))
        start = _until("_l", "_s", i) - F.char_length(head)
        digits = F.char_length(F.regexp_replace(body, "[^0-9]", ""))
        fine = (F.char_length(body) >= LEAST_CHARS) & ((digits >= LEAST_DIGITS) | body.contains("@"))
        return F.when(fine, F.struct(start.alias("start"), (start + F.char_length(body)).alias("end"), _instance(body).alias("instance"), _contexts(F.get("_p", i), F.get("_p", i + 1)).alias("contexts")))

    return rows.select(*keep, F.filter(F.transform("_f", span), lambda s: s.isNotNull()).alias("candidates"))


def learn(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The instances (instance) that trusted patterns discover, from seen (instance, context, seed).

    Instances and patterns are a graph of distinct edges. Seeds are known with score 1. In each round a pattern's trust is the
    sum of the scores of its known instances over the number of all its instances; it counts from SUPPORT and TRUST on. An
    instance's score is the noisy or of its trusted patterns, known from ACCEPT on. Patterns of fewer than SUPPORT instances
    can never count and are left out. Instances and patterns that many edges meet are salted.
    """
    edges = store(seen.groupBy("context", "instance").agg(F.max("seed").alias("seed")))
    size = edges.groupBy("context").agg(F.count("*").alias("_size")).where(F.col("_size") >= SUPPORT)
    size = store(size)
    edges = store(join_spread(edges, size, ["context"], "_size"))
    degree = store(edges.groupBy("instance").agg(F.count("*").alias("_n"), F.max("seed").alias("seed")))
    known = store(degree.where("seed").select("instance", "_n", F.lit(1.0).alias("score")))
    found = known.where("score < 0")
    for _ in range(rounds):
        told = join_spread(edges.select("context", "_size", "instance"), known, ["instance"], "_n")
        patterns = told.groupBy("context", "_size").agg(F.sum("score").alias("_score"))
        trusted = store(patterns.where((F.col("_score") >= SUPPORT) & (F.col("_score") >= TRUST * F.col("_size"))).select("context", F.col("_size").alias("_n"), (F.col("_score") / F.col("_size")).alias("trust")))
        met = join_spread(edges.where("not seed").select("context", "instance"), trusted, ["context"], "_n")
        scores = met.groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("score"))
        found = store(scores.where(F.col("score") >= ACCEPT).join(degree.where("not seed"), "instance").select("instance", "_n", "score"))
        known = degree.where("seed").select("instance", "_n", F.lit(1.0).alias("score")).unionByName(found)
    return found.select("instance")


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row, by start and then kind; positions are code points, the end exclusive.

    Kinds: email, ip, card, phone by fixed patterns, each the leftmost matches that don't overlap, less those that fail a check;
    context for unseen identifiers. Those are bootstrapped: the fixed ones are seeds, the words around them are patterns, and
    patterns that hold mostly known identifiers make known the other words with digits that they hold; see learn(). All
    places of a discovered identifier are told. A null or empty text has no spans. Repeated rows and null ids come out as they
    go in; other columns are not read. An empty table gives an empty one.

    Each text is read once, on its own, in time proportional to its length; its places, a hundredth of it, are written. Only
    these are shuffled, and only the graph is iterated.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("masked", F.col("text"))
    local = _candidates(_base(rows))
    told = local.select("doc_id", F.concat(*[f"s_{k}" for k in KINDS]).alias("base"), "candidates").withColumn("_row", F.monotonically_increasing_id())
    told = store(told)
    each = lambda c, seed: told.select(F.explode(c).alias("s")).select("s.instance", F.explode("s.contexts").alias("context"), F.lit(seed).alias("seed"))
    found = learn(each("base", True).unionByName(each("candidates", False)))
    places = told.select("_row", F.explode("candidates").alias("s")).select("_row", "s.start", "s.end", "s.instance")
    counts = store(places.groupBy("instance").agg(F.count("*").alias("_n")).join(found, "instance"))
    new = join_spread(places, counts, ["instance"], "_n").groupBy("_row").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("order"), "end")).alias("new"))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end")))
    empty = F.array().cast("array<struct<start:int,order:int,end:int>>")
    every = F.array_sort(F.concat(base, F.coalesce("new", empty)))
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "context")])
    spans = F.transform(every, lambda s: F.struct(F.get(kinds, s["order"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return told.join(new, "_row", "left").select("doc_id", spans.alias("spans"))


def op11_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = said(F.filter("spans", lambda s: s["kind"] != "context"))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), count("context"))
