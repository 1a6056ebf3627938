"""Personal data: fixed patterns against plain regular expressions, bootstrapping against a plain version, recall and precision."""

import random
import re
from collections import defaultdict

import pytest

from tests.llm.cases import empty, frame, rows
from wiretide.llm import personal as p

WS = " \t\n\x0b\f\r"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    back = [int(c) for c in reversed(digits)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(back)) % 10 == 0


def fine(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in match.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def base(text):
    return [(m.start(), p.KINDS.index(k), m.end()) for k in p.KINDS for m in re.finditer(PLAIN[k], text) if fine(k, m.group())]


def contexts(left, right):
    words = lambda t: [w[: p.WORD] for w in re.split(f"[{WS}]+", t.lower()) if w]
    b, a = words(left[-p.REACH :]), words(right[: p.REACH])
    out = [f"{b[-2]} {b[-1]} _"] if len(b) > 1 else []
    out += [f"{b[-1]} _ {a[0]}"] if a and b else []
    return out + ([f"_ {a[0]} {a[1]}"] if len(a) > 1 else [])


def places(text, pattern):
    """(start, match, text since the match before, text up to the next)"""
    found = list(re.finditer(pattern, text))
    edges = [0, *[e for m in found for e in (m.start(), m.end())], len(text)]
    return [(m.start(), m.group(), text[edges[2 * i] : edges[2 * i + 1]], text[edges[2 * i + 2] : edges[2 * i + 3]]) for i, m in enumerate(found)]


def plain(texts):
    """Spans of each text, all by dictionaries."""
    edges, seeds, own = set(), set(), []
    for text in texts:
        masked = text
        for k in p.KINDS:
            for _, m, left, right in places(text, PLAIN[k]):
                if fine(k, m):
                    for c in contexts(left, right):
                        edges.add((c, m.lower()))
                        seeds.add((c, m.lower()))
            masked = re.sub(PLAIN[k], lambda m: " " * len(m.group()) if fine(k, m.group()) else m.group(), masked)  # noqa: B023
        mine = []
        for at, m, left, right in places(masked, rf"[^{WS}0-9@]*[0-9@][^{WS}]*"):
            head = m.lstrip(p.PUNCTUATION)
            body = head.rstrip(p.PUNCTUATION + "+@")
            if len(body) >= p.LEAST_CHARS and (len(re.sub("[^0-9]", "", body)) >= p.LEAST_DIGITS or "@" in body):
                at += len(m) - len(head)
                mine.append((at, at + len(body), body.lower()))
                edges |= {(c, body.lower()) for c in contexts(left, right)}
        own.append(mine)
    of = defaultdict(set)
    for c, i in edges:
        of[c].add(i)
    of = {c: found for c, found in of.items() if len(found) >= p.SUPPORT}
    sure = {i for c, i in seeds if c in of}
    score = dict.fromkeys(sure, 1.0)
    found = {}
    for _ in range(p.ROUNDS):
        known = {c: sum(score.get(i, 0) for i in s) for c, s in of.items()}
        trust = {c: known[c] / len(of[c]) for c in of if known[c] >= p.SUPPORT and known[c] >= p.TRUST * len(of[c])}
        miss = defaultdict(lambda: 1.0)
        for c, t in trust.items():
            for i in of[c] - sure:
                miss[i] *= max(1 - t, 1e-9)
        found = {i: 1 - m for i, m in miss.items() if 1 - m >= p.ACCEPT}
        score = dict.fromkeys(sure, 1.0) | found
    return [sorted(base(t) + [(a, 4, b) for a, b, i in mine if i in found]) for t, mine in zip(texts, own)]


def spans(spark, texts):
    got = p.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kinds = [*p.KINDS, "context"]
    by = {r["doc_id"]: [(s["start"], kinds.index(s["kind"]), s["end"]) for s in r["spans"]] for r in got}
    return [by[i] for i in range(len(texts))]


def card(rng):
    body = [rng.randrange(10) for _ in range(15)]
    return next("".join(map(str, body)) + str(c) for c in range(10) if luhn("".join(map(str, body)) + str(c)))


def planted(n=60, seed=3):
    """Texts in which known and unseen identifiers stand in the same contexts, and other numbers in others."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "stone", "river"]) + rng.choice("abcdefgh")
    out, unseen, other = [], [], []
    for i in range(n):
        known = [f"{word()}{i}@mail.example.org", f"10.{i}.3.{i % 250}", card(rng), f"+1 (555) 010-{1000 + i}"][i % 4]
        out.append(f"{word()} {word()} please reach me at {known} or write {word()}")
        if i % 3 == 0:
            ident = f"ID{rng.randrange(10**7, 10**8)}"
            unseen.append((len(out), ident))
            out.append(f"{word()} please reach me at {ident} or write {word()}")
        number = f"{rng.randrange(10**6, 10**7)}"
        other.append((len(out), number))
        out.append(f"{word()} the value of {number} {word()} {word()} {word()}")
    return out, unseen, other


ODD = ["", "a@b.co_x@y.zz", "x@y.z.@q.rr..s", "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.1.1.256 0000000255.01.1.1", "4 1-1 1--1 1", "+1 () 1", "+1 (555) 123-4567 89+12345678901", "++49 30 1234567-",
       "é漢 a@b.cd é 😀 1.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111", "4111111111111111" * 3, "a" * 30000, "a@" * 5000, "a@b" + ".c" * 20000, "1." * 20000, "1 " * 20000, "+1 " * 9000, "-" * 9000 + "@", "@@@@ 12345@ @12345 '#12345#'"]


@pytest.mark.parametrize("seed", [0, 1])
def test_base_spans(spark, seed):
    rng = random.Random(seed)
    texts = ODD + ["".join(rng.choice(["a", "7", "12", "255", "256", "@", ".", "-", " ", "+", "(", ")", "_", "é", "😀", "\n", "41111111111111", "x.y"]) for _ in range(rng.randrange(200))) for _ in range(150)]
    got = spans(spark, texts)
    assert [[s for s in g if s[1] < 4] for g in got] == [sorted(base(t)) for t in texts]


def test_against_plain_bootstrapping(spark):
    texts = planted()[0] + ODD[:8] + [t or "" for _, t, *_ in rows()[:40]]
    assert spans(spark, texts) == plain(texts)


def test_recall_and_precision(spark):
    texts, unseen, other = planted()
    got = spans(spark, texts)
    hit = lambda i, x: any(k == 4 and texts[i][a:b] == x for a, k, b in got[i])
    assert sum(hit(*u) for u in unseen) >= 0.9 * len(unseen)
    assert sum(hit(*o) for o in other) == 0


def test_discovered_identifiers_are_told_everywhere(spark):
    texts, unseen, _ = planted()
    texts.append(f"nothing here but {unseen[0][1]} again")
    assert [texts[-1][a:b] for a, k, b in spans(spark, texts)[-1]] == [unseen[0][1]]


def test_odd_rows(spark):
    data = frame(spark)
    got = p.find_personal(data).collect()
    assert len(got) == data.count()
    assert p.find_personal(empty(spark)).collect() == []
    named = data.withColumnsRenamed({"fp": "masked", "u": "candidates", "component_id": "_f"})
    assert sorted(map(str, p.find_personal(named).collect())) == sorted(map(str, got))


def test_repeated_rows(spark):
    text = "mail a@b.cd now"
    got = p.find_personal(spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, len(r["spans"])) for r in got) == [(0, 0), (0, 1), (1, 1), (1, 1)]


def test_no_python_in_the_plan(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    plan = p.op11_personal_data(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
