"""Phrase mining against counting every phrase."""

import random
import re
from collections import Counter

import pytest

from tests.llm.cases import empty, frame, rows
from wiretide.llm import phrases as ph


def counts(docs):
    """(lang, phrase) -> occurrences of all phrases; words of each language."""
    found, words = Counter(), Counter()
    for text, lang in docs:
        lang = lang or "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            words[lang] += len(w)
            for k in range(1, ph.LONGEST + 1):
                for i in range(len(w) - k + 1):
                    found[lang, " ".join(w[i : i + k])] += 1
    return found, words


def plain(docs, least, top):
    f, words = counts(docs)
    size = lambda x: x.count(" ") + 1
    often = {key: a for key, a in f.items() if a >= least}
    out = []
    for (lang, x), a in often.items():
        w = x.split(" ")
        if len(w) < 2:
            continue
        cuts = [(2000000 * a // (f[lang, " ".join(w[:k])] + f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if any(lg == lang and size(y) > size(x) and f" {x} " in f" {y} " and 100 * b >= ph.COVERED * a for (lg, y), b in often.items()):
            continue
        out.append((lang, x, a, f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])], words[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(lang, i + 1, *o[1:]) for i, o in enumerate(mine)]
    return sorted(ranked)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "é", "ﬀ", "\x85", "w\xa0x", "Z", "k", "İ"]
    fixed = ["new york city hall", "in spite of that", "b c a", "a a a a a"]
    out = []
    for i in range(160):
        piece = lambda: rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(9)))
        text = "".join(piece() + rng.choice([" ", "\t", ". ", ",", "\n", "!", "\r\n"]) for _ in range(rng.randrange(12)))
        out.append((text, rng.choice(["en", "en", "fr", None, "und"])))
    return out + [(None, "en"), ("", None), (out[0][0], out[0][1])] * 2


@pytest.mark.parametrize(("seed", "top", "shards"), [(0, 2000, 4), (1, 7, 3)])
def test_against_all_phrases(spark, seed, top, shards):
    docs = corpus(seed)
    data = spark.createDataFrame([(i, *d, "x", 1) for i, d in enumerate(docs)], "doc_id long, text string, lang string, phrase string, k int")
    got = ph.collocations(ph.frequent_phrases(data, least=12, shards=shards), top=top).collect()
    assert sorted(tuple(r) for r in got) == plain(docs, 12, top)


def test_late_phrases_are_counted_whole(spark):
    """Phrases that become frequent in the last shard, and those whose counting starts in mid-cycle, have all their occurrences."""
    docs = [(f"{i}q {i % 5}r one two three four. {i}", "en") for i in range(ph.LEAST)] + [("seldom met words here", "en")] * (ph.LEAST - 1)
    f = counts(docs)[0]
    got = ph.frequent_phrases(spark.createDataFrame(docs, "text string, lang string"), shards=3).where("k >= 1").collect()
    assert {(r["lang"], r["phrase"]): r["n"] for r in got} == {key: n for key, n in f.items() if n >= ph.LEAST}


def test_filter_without_room(spark):
    """A full filter lets all through: rows are the same."""
    docs = corpus(2)
    got = ph.frequent_phrases(spark.createDataFrame(docs, "text string, lang string"), least=12, shards=2, bits=64).where("k >= 1").collect()
    assert {(r["lang"], r["phrase"]): r["n"] for r in got} == {key: n for key, n in counts(docs)[0].items() if n >= 12}


def test_exact_beyond_64_bits(spark):
    n = 9_000_000_000_000_000_000
    data = spark.createDataFrame([("en", 0, "", n), ("en", 1, "a", n), ("en", 1, "b", n - 7), ("en", 2, "a b", n - 11)], "lang string, k int, phrase string, n long")
    row = ph.collocations(data).first()
    assert (row["score"], row["a"], row["l"], row["r"]) == (2000000 * (n - 11) // (2 * n - 7), n - 11, n, n - 7)


def test_odd_rows(spark):
    assert ph.collocations(ph.frequent_phrases(empty(spark))).collect() == []
    docs = [(t, lang) for _, t, lang, *_ in rows()] + [(rows()[5][1], None), (None, None)]
    got = ph.collocations(ph.frequent_phrases(frame(spark), least=20, shards=2), top=50).collect()
    assert sorted(tuple(r) for r in got) == plain(docs, 20, 50)


def test_nothing_that_grows_is_sent_to_the_workers(spark, monkeypatch):
    """Phrases are told to the workers by filters of a fixed size alone, and words are spelled in one scan."""

    def no(_):
        raise AssertionError("a table of phrases is broadcast")

    monkeypatch.setattr(ph.F, "broadcast", no)
    docs = corpus(3)
    got = ph.frequent_phrases(spark.createDataFrame(docs, "text string, lang string"), least=12, shards=2).where("k >= 1").collect()
    assert {(r["lang"], r["phrase"]): r["n"] for r in got} == {key: n for key, n in counts(docs)[0].items() if n >= 12}


def test_phrases_of_old_parts_are_not_counted_again():
    codes, words = ph.pd.factorize(ph.np.array(["\n", "a", "b", "c", "\n", "a", "b"], dtype=object))
    hashes = ph._word_hashes("en", words)
    full, none = ph.np.full(1, 2**64 - 1, ph.np.uint64), ph.np.zeros(1, ph.np.uint64)
    assert [(k, len(h)) for k, h in ph._chain(codes, hashes, 4, 1, full, none)] == [(2, 3), (3, 1)]
    assert not sum(len(h) for _, h in ph._chain(codes, hashes, 4, 1, full, full))
