"""The pipeline against a brute-force version of its stages on the smallest tables."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_operators import brute_counts, split
from wiretide.llm import bpe
from wiretide.llm.common import store

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def five_words(t):
    w = split((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_pipeline_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    good = []
    for d, t in docs:
        n, *_, rep = brute_counts(t)
        if n >= 50 and 2 * rep <= n:  # with so few labels no cutoff can be certified
            good.append((d, t))
    seen, lined = set(), []
    for d, t in good:
        lines, gone = t.split("\n"), set()
        for i in range(len(lines)):
            for h in (1, 2, 3):
                k = tuple(lines[i : i + h])
                if len(k) == h and (h == 3 or sum(len(split(x)) for x in k) >= 50):
                    if k in seen:
                        gone.update(range(i, i + h))
                    seen.add(k)
        lined.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    sets = [five_words(t) for _, t in lined]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and (n := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    near = [lined[i] for i in sorted(set(label))]

    def shingles(t):
        w = split(t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    bench = [s for s in map(shingles, items) if s]
    clean = [(d, t) for d, t in near if not any(len(s & own) >= 0.8 * len(s) - 1e-9 for own in [shingles(t)] for s in bench)]
    with open(bpe.vocabulary_path(), "rb") as f:
        codec = bpe.Codec(f.read())
    want = sorted((d, ids.tolist(), hashlib.sha256(t.encode()).hexdigest()) for (d, t), ids in zip(clean, codec.encode_all([t for _, t in clean])))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r["doc_id"], r["ids"], r["decoded_sha256"]) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        docs = out


def test_stages_take_odd_rows(spark):
    """Null ids and texts, empty and long texts, repeated rows, clashing columns and empty tables go through the stages one after another."""
    docs = cases.frame(spark).withColumns({"_id": F.lit("x"), "gone": F.lit("x"), "node": F.lit("x"), "n_chars": F.lit(0).cast("long")})
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, DATA)
            assert out.columns == frame.columns
            frame = store(out)
        made = corpus_pipeline.STAGES[-1][1](spark, frame, DATA)
        assert made.count() == frame.count()


def test_near_dedup_stage_against_jaccard_brute_force(spark):
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]

    def edited(w, k):
        w = list(w)
        for i in rng.sample(range(len(w)), k):
            w[i] = f"e{rng.randrange(10**6)}"
        return w

    base = [new(rng.randrange(60, 400)) for _ in range(40)]
    texts = [" ".join(w) for w in base] + [" ".join(edited(w, k)) for w in base for k in (1, max(1, len(w) // 60), len(w) // 40, len(w) // 25)]
    texts += [texts[0].upper(), texts[1], "", "  ", None, "one two", "one  two", "one two three"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, texts[2])]

    def shingles(t):
        w = split((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, label = [shingles(t) for _, t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if label[i] != label[j] and (n := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    least = {}
    for (d, _), x in zip(docs, label):
        least[x] = min(least.get(x, (True, 10**9)), (d is not None, d or 0))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, DATA).collect()]
    assert sorted((d is not None, d or 0) for d in got) == sorted(least.values())
    assert corpus_pipeline.near_dedup(spark, frame.limit(0), DATA).count() == 0
