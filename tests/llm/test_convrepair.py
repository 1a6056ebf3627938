"""Conversation repair against a plain decoder that carries whole strings, and against all edits of short conversations."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import types as T

from wiretide.llm import convrepair as cr

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       T.StructField("part", T.StringType()), T.StructField("fault", T.StringType()), T.StructField("copies", T.IntegerType())])
WS = " \t\n\x0b\f\r"


def plain(rows):
    """(cost, audit) of rows of (initial, fault); each state's best is held as a whole string."""
    now = {0: (0, "")}
    after = lambda s, i: 1 if i == "s" and s == 0 else 2 if i == "u" and s != 2 else 3 if i == "a" and s == 2 else None
    inserted = {0: [(0, ""), (2, "I"), (3, "II")], 1: [(1, ""), (2, "I"), (3, "II")], 2: [(2, ""), (3, "I")], 3: [(3, ""), (2, "I")]}
    for initial, fault in rows:
        then = {}
        for s, (cost, audit) in now.items():
            for mid, w in inserted[s]:
                ways = [(mid, 2, "D")]
                if fault not in ("blank", "duplicate"):
                    extra = 5 * (fault == "truncated")
                    ways += [(after(mid, initial), extra, "K"), (3 if mid == 2 else 2, 1 + extra, "R")]
                for end, price, edit in ways:
                    if end is not None:
                        found = (cost + 5 * len(w) + price, audit + w + edit)
                        then[end] = min(then.get(end, found), found)
        now = then
    return min((cost + 5 * len(w), audit + w) for s, (cost, audit) in now.items() for w in [{0: "", 1: "II", 2: "I", 3: ""}[s]])


def every(rows):
    """The same by trying all edits."""
    best = []

    def go(i, roles, audit, cost):
        for k in range(3):
            for put in itertools.product("ua", repeat=k):
                r, a, c = roles + "".join(put), audit + "I" * k, cost + 5 * k
                if i == len(rows):
                    if re.fullmatch("(s?(ua)+)?", r):
                        best.append((c, a))
                    continue
                initial, fault = rows[i]
                go(i + 1, r, a + "D", c + 2)
                if fault not in ("blank", "duplicate"):
                    extra = 5 * (fault == "truncated")
                    go(i + 1, r + (initial or "x"), a + "K", c + extra)
                    for x in "ua":
                        go(i + 1, r + x, a + "R", c + 1 + extra)

    go(0, "", "", 0)
    return min(best)


def expected(rows):
    """The digest columns of one conversation's rows (turn, role, text), by plain()."""
    rows = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode()))
    seen, marked = set(), []
    for _, role, text in rows:
        body = text.rstrip(WS)
        fault = "blank" if not body.strip(WS) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role[:1], fault))
    cost, audit = plain(marked)
    said, i, state = [], 0, ""
    for edit in audit:
        _, role, text = rows[i] if edit != "I" else (None, None, "")
        i += edit != "I"
        if edit == "D":
            continue
        role = role if edit == "K" else "assistant" if state == "u" else "user"
        state = role[:1]
        said.append(f"{role}:{text}")
    turns = {r[0] for r in rows if r[0] is not None}
    count = lambda f: sum(m[1] == f for m in marked)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def odd_rows(seed=0):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "What?", "so", "", " \n", "é漢 ok.", "ok .  \n", None, "x" * 70 + "a.", "x" * 70 + "b.", "end"]
    out = []
    for conv in [*range(12), None]:
        for _ in range(rng.choice([1, 3, 8, 20])):
            out.append((conv, rng.choice([None, 1, 2, 3, 5, 8, 13]), rng.choice(["user", "assistant", "system", "tool", "", None, "u" * 80]), rng.choice(texts), "x", "y", 3))
    out += [out[0], out[1], out[1]]
    out += [(77, i, "user", f"t{i}.", None, None, None) for i in range(300)]  # one conversation over all partitions, no edits shared before its end
    out += [(77, 5, "assistant", "same.", None, None, None)] * 200 + [(77, i, "assistant", "same.", None, None, None) for i in range(100)]
    out += [(78, i, ["user", "assistant"][i % 2], f"{i} " + "w" * 500 + ".", None, None, None) for i in range(200)]
    out += [(79, i, "system", " ", None, None, None) for i in range(90)] + [(80, None, None, None, None, None, None)]
    return out


def test_short_conversations_against_all_edits():
    rng = random.Random(1)
    for _ in range(150):
        rows = [(rng.choice("suauax"), rng.choice(["", "", "blank", "truncated", "duplicate"])) for _ in range(rng.randrange(4))]
        assert plain(rows) == every(rows), rows


def test_decoder_against_whole_strings():
    rng = random.Random(2)
    for _ in range(800):
        roles, faults = rng.choice([["u"], ["u", "a"], ["s", "u", "a"], ["s", "u", "a", "x", ""]]), rng.choice([[""], ["", "truncated"], ["", "", "blank", "truncated", "duplicate"]])
        rows = [(rng.choice(roles), rng.choice(faults)) for _ in range(rng.randrange(60))]
        decoder = cr.Decoder()
        audit = "".join(e for r in rows for _, e in decoder.push(r, *r)) + "".join(e for _, e in decoder.finish())
        assert audit == plain(rows)[1], rows


def test_survivors_coalesce():
    decoder, held, told = cr.Decoder(), 0, 0
    for i in range(5000):
        told += sum(1 for _ in decoder.push(i, "ua"[i % 2], "blank" if i % 7 == 0 else ""))
        held = max(held, i + 1 - told)
    assert held < 40


def test_unresolved_ties_take_linear_time():
    decoder = cr.Decoder()
    told = sum(1 for i in range(100_000) for _ in decoder.push(i, "u", ""))
    assert told + sum(1 for _ in decoder.finish()) == 100_000


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    rows = odd_rows(seed)
    frame = spark.createDataFrame(rows, SCHEMA)
    groups = {}
    for conv, turn, role, text, *_ in rows:
        groups.setdefault(conv, []).append((turn, role or "", text or ""))
    want = {conv: expected(found) for conv, found in groups.items()}
    edits = cr.repair(frame)
    got = {r[0]: tuple(r[1:]) for r in cr.digests(edits).collect()}
    assert got == want
    assert edits.where("split").select("conv_id", "part").distinct().count() > 3


def test_pieces_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(cr, "PIECE", 50)
    rows = [r for r in odd_rows() if r[0] in (77, 78)]
    got = {r[0]: tuple(r[1:]) for r in cr.digests(cr.repair(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {c: expected([(t, r, x) for k, t, r, x, *_ in rows if k == c]) for c in (77, 78)}


def test_empty_table(spark):
    assert cr.digests(cr.repair(spark.createDataFrame([], SCHEMA))).collect() == []


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "cut off"), (1, 3, "assistant", "Yes.")]
    got = cr.repair(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).orderBy("seq").collect()
    assert [(r["edit"], r["role"], r["text"], r["fault"]) for r in got] == [("D", None, None, ""), ("K", "user", "Hi?", ""), ("D", None, None, "truncated"), ("K", "assistant", "Yes.", "")]


def test_query_has_every_conversation(spark, tmp_path):
    frame = spark.createDataFrame([(c, t, "user", "Yes.", None, None, None) for c in range(60) for t in range(1)], SCHEMA)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = cr.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert sorted(r["conv_id"] for r in got) == list(range(60))
    assert {(r["audit"], r["cost"]) for r in got} >= {("", 0)}
