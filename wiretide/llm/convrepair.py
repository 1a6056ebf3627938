"""Conversation structure repair: cheapest edits by Viterbi decoding with coalescing survivors.

The roles of a repaired conversation read `(s?(ua)+)?`. What has been put out so far is one of four states: nothing, a system
turn, a user turn that waits for its answer, an answer. A row is kept, given another role or deleted, and turns may be inserted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wiretide.llm.common import cut, join_spread, partitions, store, table

#: What an edit costs, and what a truncated row that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NOTHING, SYSTEM, USER, ANSWER = range(4)
#: Inserted turns that lead from a state to each other state, and those that end a conversation.
LEADS = {NOTHING: ((NOTHING, ""), (USER, "I"), (ANSWER, "II")), SYSTEM: ((SYSTEM, ""), (USER, "I"), (ANSWER, "II")), USER: ((USER, ""), (ANSWER, "I")), ANSWER: ((ANSWER, ""), (USER, "I"))}
ENDS = {NOTHING: "", SYSTEM: "II", USER: "I", ANSWER: ""}
#: Bytes of text and edits that one row of a conversation in many pieces holds.
PIECE = 1_000_000
#: Characters of role and text that decide, besides conversation and turn, in which partition a row lies.
SORTED_BY = 64


def _after(state: int, initial: str) -> int | None:
    """The state once a turn of this initial follows, if it may."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return None if state == USER else USER
    return ANSWER if initial == "a" and state == USER else None


def _moves(initial: str, truncated: bool) -> list[list[tuple[int, int, str]]]:
    """For each state after a row (from state, cost, edits): the cheapest and then ASCII-least way from each state before it.

    Turns are never inserted before a deleted row: to insert them after it costs the same and is ASCII-less.
    """
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start, leads in LEADS.items():
        found = [(start, DELETE, "D")]
        for state, inserts in leads:
            cost = INSERT * len(inserts) + TRUNCATED * truncated
            for end, edit, more in ((_after(state, initial), "K", KEEP), (USER if state != USER else ANSWER, "R", REROLE)):
                if end is not None:
                    found.append((end, cost + more, inserts + edit))
        for end, cost, edits in found:
            best[start, end] = min(best.get((start, end), (cost, edits)), (cost, edits))
    return [[(start, *best[start, end]) for start in range(4) if (start, end) in best] for end in range(4)]


MOVES = {(i, t): _moves(i, t) for i in ("s", "u", "a", "") for t in (False, True)}


class Node:
    """A row's edits on a survivor's path; it lives while a later node or a survivor refers to it."""

    __slots__ = ("parent", "kids", "held", "row", "edits")

    def __init__(self, parent: Node | None, row, edits: str) -> None:
        self.parent, self.kids, self.held, self.row, self.edits = parent, [], 0, row, edits
        if parent is not None:
            parent.kids.append(self)


class Decoder:
    """Reads rows one by one and gives back (row, edits) as soon as all survivors share them.

    A survivor is the cheapest path into a state, by cost and then by its edits as ASCII. Complete paths are compared without
    being walked: all survivors end with the same row, so none is a prefix of another, and their order is kept as a rank; two
    ways into a state compare by the ranks of the survivors that they extend. Paths are a tree of back pointers with reference
    counts. What is in memory is the part of the tree below the last ancestor that all survivors share.
    """

    def __init__(self, entry: int = NOTHING, tree: bool = True) -> None:
        self.tree = tree
        self.root = Node(None, None, "")
        self.alive: dict[int, tuple[int, int, Node]] = {entry: (0, 0, self.root)}
        self.root.held = 1

    def push(self, row, initial: str, fault: str, copies: int = 1) -> Iterator[tuple[object, str]]:
        if fault in ("blank", "duplicate"):
            ways = [(rank, "D", state, state, cost + DELETE * copies) for state, (cost, rank, _) in self.alive.items()]
        else:
            ways = []
            for end, moves in enumerate(MOVES[initial if initial in ("s", "u", "a") else "", fault == "truncated"]):
                found = [(self.alive[start][0] + cost, self.alive[start][1], edits, start) for start, cost, edits in moves if start in self.alive]
                if found:
                    cost, rank, edits, start = min(found)
                    ways.append((rank, edits, end, start, cost))
        ways.sort()
        before, self.alive = self.alive, {}
        for rank, (_, edits, end, start, cost) in enumerate(ways):
            self.alive[end] = (cost, rank, Node(before[start][2], row, edits) if self.tree else self.root)
        if self.tree:
            for _, _, node in self.alive.values():
                node.held = 1
            for _, _, node in before.values():
                self._release(node)
            self._prune()
            yield from self._shared()

    def _prune(self) -> None:
        """Drops survivors that another one beats whatever follows, by a cost that no tie can make up."""
        cost = {state: c for state, (c, _, _) in self.alive.items()}
        far = 1 << 62
        user, answer = cost.get(USER, far), cost.get(ANSWER, far)
        whole = min(answer, user + INSERT)
        lost = {NOTHING: whole + DELETE, SYSTEM: whole, USER: answer + INSERT, ANSWER: user + INSERT}
        for state in [s for s, c in cost.items() if c > lost[s]]:
            self._release(self.alive.pop(state)[2])

    def _release(self, node: Node) -> None:
        node.held = 0
        while not node.kids and not node.held and node.parent is not None:
            parent = node.parent
            parent.kids.remove(node)
            node = parent

    def _shared(self) -> Iterator[tuple[object, str]]:
        while len(self.root.kids) == 1 and not self.root.held:
            self.root = self.root.kids[0]
            self.root.parent = None
            yield self.root.row, self.root.edits

    def finish(self, leave: int | None = None) -> Iterator[tuple[object, str]]:
        """The rest of the path into the state to leave in; by default, the cheapest end, with its inserted turns."""
        trail = ""
        if leave is None:
            leave, trail = cheapest_end({state: (cost, rank) for state, (cost, rank, _) in self.alive.items()})
        path, node = [], self.alive[leave][2]
        while node is not self.root:
            path.append((node.row, node.edits))
            node = node.parent
        yield from reversed(path)
        if trail:
            yield None, trail


def cheapest_end(alive: dict[int, tuple[int, int]]) -> tuple[int, str]:
    _, _, trail, state = min((cost + INSERT * len(ENDS[s]), rank, ENDS[s], s) for s, (cost, rank) in alive.items())
    return state, trail


def _of_copies(fault: str, copies: int) -> list[tuple[str, int]]:
    """Equal rows as faults and how many have each: all but the first are duplicates, unless they are blank."""
    return [(fault, copies)] if copies == 1 or fault in ("blank", "duplicate") else [(fault, 1), ("duplicate", copies - 1)]


def _starts(by: list) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(by) + 1):
        if i == len(by) or by[i] != by[start]:
            yield start, i
            start = i


# ---- faults ----------------------------------------------------------------------------------------------------------------


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, _conv, turn, role, text, copies, fault): rows with the first fault of each; rows that agree in everything are one, with their number.

    blank: no word character; duplicate: role and text seen earlier in the conversation; truncated: the last character that isn't
    white space isn't one of . ! ?. Of copies, which follow one another, the first has the fault that is told.
    """
    spark = rows.sparkSession
    space = F.lit(" \t\n\x0b\f\r")
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    told = rows.select("conv_id", key.alias("_conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = told.withColumn("_same", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    seen = store(told.groupBy("_conv", "_same").agg(F.min(F.struct("turn")).alias("_first"), F.count("*").alias("_n")).where("_n > 1"))
    met = join_spread(told, seen, ["_conv", "_same"], "_n", how="left")
    once = met.where("_n is null").select("conv_id", "_conv", "turn", "role", "text", F.lit(1).cast("long").alias("copies"), F.lit(False).alias("_later"))
    more = met.where("_n is not null").withColumn("_later", ~F.col("turn").eqNullSafe(F.col("_first.turn")))
    more = more.groupBy("conv_id", "_conv", "turn", "role", "text").agg(F.count("*").alias("copies"), F.max("_later").alias("_later"))
    last = F.right(F.rtrim("text", space), F.lit(1))
    fault = F.when(F.btrim("text", space) == "", "blank").when(F.col("_later"), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return once.unionByName(more).select("conv_id", "_conv", "turn", "role", "text", "copies", fault.alias("fault"))


def in_order(faulty: DataFrame) -> DataFrame:
    """The rows by conversation and turn (null first), then role and text, dealt by ranges over the shuffle partitions and written. part numbers them.

    A conversation may go on in the next partition, so one of any length is many tasks.
    """
    short = F.char_length("role") < SORTED_BY
    keys = [F.col("_conv"), F.col("turn").asc_nulls_first(), F.substring("role", 1, SORTED_BY), F.when(short, F.substring("text", 1, SORTED_BY)).asc_nulls_first()]
    dealt = faulty.repartitionByRange(partitions(faulty.sparkSession), *keys)
    return cut(dealt.sortWithinPartitions("_conv", F.col("turn").asc_nulls_first(), "role", "text").withColumn("part", F.spark_partition_id()))


# ---- conversations that cross partitions -----------------------------------------------------------------------------------


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last conversation of a partition: for each state before it, cost and rank into each state after it."""
    conv, part, rows, number = None, 0, [], 0
    out: list[tuple] = []

    def told() -> None:
        table = []
        for entry in range(4):
            decoder = Decoder(entry, tree=False)
            for initial, fault, copies in rows:
                for _ in decoder.push(None, initial, fault, copies):
                    pass
            table += [v for state in range(4) for v in (decoder.alive[state][:2] if state in decoder.alive else (-1, -1))]
        out.append((conv, part, table))

    for batch in batches:
        convs, parts, roles, faults, copies = (c.to_pylist() for c in batch.columns)
        for a, b in _starts(convs):
            if convs[a] != conv:
                if conv is not None and number == 1:
                    told()
                conv, part, rows, number = convs[a], parts[a], [], number + 1
            rows += [(role[:1], mine, k) for role, fault, n in zip(roles[a:b], faults[a:b], copies[a:b]) for mine, k in _of_copies(fault, n)]
    if conv is not None:
        told()
    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.list_(pa.int64())))], names=["_conv", "part", "table"])


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the pieces of a conversation, by part: the states in which the cheapest path enters and leaves each."""
    for batch in batches:
        out = []
        for conv, pieces in zip(batch.column("_conv").to_pylist(), batch.column("pieces").to_pylist()):
            alive, back = {NOTHING: (0, 0)}, []
            for piece in pieces:
                at = lambda p, q: piece["table"][8 * p + 2 * q : 8 * p + 2 * q + 2]  # noqa: B023, E731
                ways = []
                for q in range(4):
                    found = [(alive[p][0] + at(p, q)[0], alive[p][1], at(p, q)[1], p) for p in alive if at(p, q)[0] >= 0]
                    if found:
                        cost, rank, inner, p = min(found)
                        ways.append((rank, inner, q, p, cost))
                ways.sort()
                alive = {q: (cost, i) for i, (_, _, q, _, cost) in enumerate(ways)}
                back.append({q: p for _, _, q, p, _ in ways})
            leave = cheapest_end(alive)[0]
            for i in range(len(pieces) - 1, -1, -1):
                out.append((conv, pieces[i]["part"], back[i][leave], leave, i == len(pieces) - 1))
                leave = back[i][leave]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["_conv", "part", "enter", "leave", "ends"])


def routes(ordered: DataFrame) -> DataFrame:
    """(_conv, part, enter, leave, ends) of each piece of the conversations that lie in more than one partition: at most two a partition."""
    pieces = ordered.select("_conv", "part", "role", "fault", "copies").mapInArrow(_crossings, "_conv string, part int, table array<bigint>")
    grouped = pieces.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("part", "table"))).alias("pieces")).where(F.size("pieces") > 1)
    return store(grouped.mapInArrow(_routes, "_conv string, part int, enter int, leave int, ends boolean"))


# ---- edits -----------------------------------------------------------------------------------------------------------------

_EDIT = {
    "part": pa.int32(), "split": pa.bool_(), "seq": pa.int64(), "edit": pa.string(), "cost": pa.int64(), "turn": pa.int64(),
    "fault": pa.string(), "was": pa.string(), "role": pa.string(), "text": pa.string(),
}


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of the rows of a partition, in order. A batch is put out at least once a batch is read, so only what is unresolved stays."""
    names: list[str] = []
    kept: dict[str, list] = {}
    now: dict = {}

    def add(conv_id, row, edits: str) -> None:
        turn, role, text, fault, copies = row if row is not None else (None, None, None, None, 1)
        for edit in edits:
            state = now["state"]
            initial, out, cost = None, None, {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
            if edit == "K":
                initial, out = role[:1], role
            elif edit != "D":
                initial = "a" if state == USER else "u"
                out = "assistant" if initial == "a" else "user"
            if edit in "KR" and fault == "truncated":
                cost += TRUNCATED
            if initial is not None:
                now["state"] = _after(state, initial)
            for _ in range(copies if edit == "D" else 1):
                mine = None if edit == "I" else fault
                body = (text if edit != "I" else "") if edit != "D" else None
                for name, value in zip(names, (conv_id, now["part"], now["split"], now["seq"], edit, cost, turn if edit != "I" else None, mine, role if edit != "I" else None, out, body)):
                    kept[name].append(value)
                now["seq"] += 1

    def close() -> None:
        if now:
            for row, edits in now["decoder"].finish(None if now["ends"] else now["leave"]):
                add(now["conv_id"], row, edits)

    def flush(kind: pa.DataType) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(kept[n], kind if n == "conv_id" else _EDIT[n]) for n in names], names=names)
        for n in names:
            kept[n] = []
        return batch

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        if not names:
            names = ["conv_id", *_EDIT]
            kept.update((n, []) for n in names)
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        for a, b in _starts(columns["_conv"]):
            if not now or now["conv"] != columns["_conv"][a]:
                close()
                enter, leave, ends = columns["enter"][a], columns["leave"][a], columns["ends"][a]
                now.clear()
                now.update(conv=columns["_conv"][a], conv_id=columns["conv_id"][a], part=columns["part"][a], split=enter is not None, seq=0,
                           state=enter or NOTHING, leave=leave, ends=ends is not False, decoder=Decoder(enter or NOTHING))
            for i in range(a, b):
                turn, role, text, fault, copies = (columns[n][i] for n in ("turn", "role", "text", "fault", "copies"))
                for mine, n in _of_copies(fault, copies):
                    for done, edits in now["decoder"].push((turn, role, text, mine, n), role[:1], mine, n):
                        add(now["conv_id"], done, edits)
        yield flush(kind)
    close()
    if names:
        yield flush(kind)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, part, split, seq, edit, cost, turn, fault, was, role, text): the cheapest edits of each conversation, in order of part and seq.

    rows has conv_id, an integer turn, role and text; no other column is read. edit is K (keep), R (other role), D (delete) or I
    (inserted turn); was is the role before, role and text what the repaired conversation holds, null for D. Of equally cheap
    edits the ASCII-least are taken. Rows are ordered by turn (null first), role and text; a null role or text is empty; rows
    with a null conv_id are one conversation; equal rows are copies, of which all but the first are duplicates. An empty table
    gives an empty one.

    Rows are sorted by ranges, so that a conversation of any length is many tasks. For the at most two conversations of a
    partition that go on in another one, a first pass finds the cost from each state to each across the piece, and these are
    chained. Then each piece is decoded on its own, from where the best path enters it to where it leaves.
    """
    ordered = in_order(with_faults(rows))
    ways = F.broadcast(routes(ordered))  # at most two rows a partition
    told = ordered.join(ways, ["_conv", "part"], "left").select("conv_id", "_conv", "part", F.col("turn").cast("long").alias("turn"), "role", "text", "copies", "fault", "enter", "leave", "ends")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return told.mapInArrow(_edited, f"conv_id {kind}, part int, split boolean, seq long, edit string, cost long, turn long, fault string, was string, role string, text string")


# ---- digests ---------------------------------------------------------------------------------------------------------------

_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_PIECE = {
    "part": pa.int32(), "split": pa.bool_(), "seq": pa.int64(), "low": pa.int64(), "high": pa.int64(), "turns": pa.int64(), "first": pa.string(), "last": pa.string(),
    **{c: pa.int64() for c in _COUNTS}, "audit": pa.string(), "said": pa.int64(), "body": pa.binary(), "sha": pa.string(),
}
_PIECE_SQL = "part int, split boolean, seq long, low long, high long, turns long, first string, last string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, said long, body binary, sha string"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of a partition; for those that go on elsewhere, rows of about PIECE bytes with their texts."""
    out: list[dict] = []
    now: dict | None = None
    kind = None

    def fresh(conv_id, part, split, seq) -> dict:
        return {"conv_id": conv_id, "part": part, "split": split, "seq": seq, "low": None, "high": None, "turns": 0, "first": None, "last": None,
                **dict.fromkeys(_COUNTS, 0), "audit": [], "said": 0, "body": [], "size": 0, "sha": hashlib.sha256()}

    def done(piece: dict) -> None:
        split = piece["split"]
        out.append(piece | {"audit": "".join(piece["audit"]), "body": b"\n".join(piece["body"]) if split else None, "sha": None if split else piece["sha"].hexdigest()})

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        ids, parts, splits, seqs, edits, costs, turns, faults, was, roles, texts = (c.to_pylist() for c in batch.columns)
        for i, edit in enumerate(edits):
            if now is None or seqs[i] == 0:
                if now is not None:
                    done(now)
                now = fresh(ids[i], parts[i], splits[i], seqs[i])
            elif splits[i] and now["size"] > PIECE:
                done(now)
                now = fresh(ids[i], parts[i], splits[i], seqs[i])
            now["audit"].append(edit)
            now["cost"] += costs[i]
            now["size"] += 1
            if edit != "I":
                initial = was[i][:1]
                if faults[i]:
                    now[faults[i]] += 1
                if now["first"] is None:
                    now["first"] = initial
                elif now["last"] + initial not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["last"] = initial
                if turns[i] is not None and turns[i] != now["high"]:
                    now["low"] = turns[i] if now["low"] is None else now["low"]
                    now["high"] = turns[i]
                    now["turns"] += 1
            if edit != "D":
                line = f"{roles[i]}:{texts[i]}".encode("utf-8", "surrogatepass")
                if now["split"]:
                    now["body"].append(line)
                    now["size"] += len(line)
                else:
                    now["sha"].update(b"\n" + line if now["said"] else line)
                now["said"] += 1
        if out:
            yield _told(out, kind)
            out = []
    if now is not None:
        done(now)
        yield _told(out, kind)


def _told(out: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", *_PIECE]
    return pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], kind if n == "conv_id" else _PIECE[n]) for n in names], names=names)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the pieces of a conversation, which follow one another; of their texts one piece is in memory."""
    now: dict | None = None
    kind, key = None, None

    def done() -> pa.RecordBatch:
        return _told([now | {"audit": "".join(now["audit"]), "sha": now["sha"].hexdigest(), "body": None}], kind)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            if now is None or row["conv_id"] != key:
                if now is not None:
                    yield done()
                key = row["conv_id"]
                now = row | {"audit": [row["audit"]], "sha": hashlib.sha256(row["body"])}
                continue
            for name in _COUNTS:
                now[name] += row[name]
            if row["first"] is not None:
                if now["first"] is None:
                    now["first"] = row["first"]
                elif now["last"] + row["first"] not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["last"] = row["last"]
            if row["low"] is not None:
                now["turns"] += row["turns"] - (now["high"] == row["low"])
                now["low"] = row["low"] if now["low"] is None else now["low"]
                now["high"] = row["high"]
            now["audit"].append(row["audit"])
            if row["said"]:
                now["sha"].update((b"\n" if now["said"] else b"") + row["body"])
            now["said"] += row["said"]
    if now is not None:
        yield done()


def digests(edits: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of what repair() returns, one row a conversation.

    Read in the order in which repair() leaves the rows, without a shuffle. Only conversations that lie in several partitions
    are brought together, in pieces, to be digested one after another, as SHA-256 asks: their audit is held, their texts are not.
    """
    schema = f"conv_id {edits.schema['conv_id'].dataType.simpleString()}, {_PIECE_SQL}"
    pieces = store(edits.mapInArrow(_digested, schema))
    chained = pieces.where("split").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_chained, schema)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return pieces.where("not split").unionByName(chained).select("conv_id", gaps.alias("gaps"), *_COUNTS, "audit", F.col("sha").alias("repaired_sha256"))


# ---- the query -------------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults of five kinds, by a checksum of conversation and turn; null is one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).cast("int")
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    changed = rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"),
    )
    return changed.drop("_copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations")
    found = digests(repair(damaged(told)))
    every = told.select(F.col("conv_id").alias("_id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    nothing = hashlib.sha256(b"").hexdigest()
    return every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"), *[zero(c) for c in ("gaps", *_COUNTS)], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _oracle() -> str:
    values = lambda rows: ", ".join(str(r) for r in rows)
    leads = values((a, b, w) for a, ways in LEADS.items() for b, w in ways)
    steps = values([(0, "s", 1, 0), (0, "u", 2, 0), (1, "u", 2, 0), (3, "u", 2, 0), (2, "a", 3, 0)])
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
    ws = " \\t\\n\\x0B\\f\\r"
    return f"""
WITH RECURSIVE
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kind AS (SELECT *, {crc} % 20 AS kind FROM raw),
harm AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM kind)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS ini FROM harm),
bad AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{ws}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][{ws}]*$') THEN 'truncated' ELSE '' END AS fault, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM num),
leads(start, mid, ins) AS (VALUES {leads}),
steps(mid, ini, stop, price) AS (VALUES {steps}),
edits AS (SELECT l.start, s.stop, s.ini, l.ins || 'K' AS word, 5 * length(l.ins) AS price, false AS forced FROM leads l JOIN steps s USING (mid)
  UNION ALL SELECT l.start, s.stop, NULL, l.ins || 'R', 5 * length(l.ins) + 1, false FROM leads l JOIN steps s USING (mid) WHERE s.ini <> 's'
  UNION ALL SELECT start, mid, NULL, ins || 'D', 5 * length(ins) + 2, true FROM leads),
path AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit FROM (SELECT DISTINCT conv_id FROM bad)
  UNION ALL
  SELECT conv_id, i, state, cost, audit FROM (
    SELECT p.conv_id, b.i, e.stop AS state, (p.cost + e.price + CASE WHEN NOT e.forced AND b.fault = 'truncated' THEN 5 ELSE 0 END)::BIGINT AS cost, p.audit || e.word AS audit
    FROM path p JOIN bad b ON b.conv_id IS NOT DISTINCT FROM p.conv_id AND b.i = p.i + 1
    JOIN edits e ON e.start = p.state AND (e.ini IS NULL OR e.ini = b.ini) AND (e.forced OR b.fault NOT IN ('blank', 'duplicate')))
  QUALIFY row_number() OVER (PARTITION BY conv_id, i, state ORDER BY cost, audit) = 1),
ends(state, tail) AS (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')),
best AS (SELECT p.conv_id, p.cost + 5 * length(tail) AS cost, audit || tail AS audit FROM path p JOIN ends USING (state)
  JOIN (SELECT conv_id, max(i) AS n FROM bad GROUP BY conv_id) z ON z.conv_id IS NOT DISTINCT FROM p.conv_id AND z.n = p.i
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + 5 * length(tail), audit || tail) = 1),
ops AS (SELECT conv_id, unnest(string_split(audit, '')) AS op, unnest(range(1, length(audit) + 1)) AS j FROM best WHERE audit <> ''),
spot AS (SELECT *, sum((op <> 'I')::INT) OVER w AS i, sum((op <> 'D')::INT) OVER w AS o FROM ops WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
put AS (SELECT a.conv_id, a.op, a.j, a.o, CASE WHEN op = 'K' THEN b.role END AS role, CASE WHEN op = 'I' THEN '' ELSE b.text END AS text,
    max((a.op = 'K' AND b.ini = 's')::INT) OVER (PARTITION BY a.conv_id) AS lead
  FROM spot a LEFT JOIN bad b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = a.i AND a.op <> 'I' WHERE a.op <> 'D'),
out AS (SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN (o - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY j)) AS sha FROM put GROUP BY conv_id),
seen AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM bad GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN seen s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN out o ON o.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLE_OP13 = _oracle()
