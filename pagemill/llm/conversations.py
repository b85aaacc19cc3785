"""Conversation structure repair by survivor-coalescence Viterbi.

A conversation's rows are repaired by edits so that their role initials are nothing, or a system row at most, then user
and assistant in turns, up to an assistant: `(s?(ua)+)?`. Keep costs 0, Rerole to user or assistant 1, Delete 2 (forced on blank
rows and repeats), Insert 5, a truncated row that stays 5 more. The cheapest edits are found, and of these the ASCII-least.

There are four states: nothing yet, after s, after u, after a. Each state has a survivor, the best path that ends there. One
that is dearer than another by more than it can still make good is dropped. Survivors are leaves of a tree of back pointers
that counts references; where all of them come from one node, the edits up to it are final and are given out, so the tree
holds only what isn't resolved. Two paths of equal cost into a state are compared over all that they don't share: the order of the survivors' complete strings is carried along as their ranks, and
an extended path compares by its survivor's rank, then by its own step. (Given an edit, the next state is known, and a step
ends with a row's edit; so no survivor's string begins another's.) Inserts stand before a row's edit or at the end.

Equal rows are one row with a count before anything is sorted. A conversation of up to CHUNK_ROWS rows and CHUNK_BYTES is one
piece; a longer one, however long, is spread by turn over many tasks and cut into pieces. Each piece yields what it costs to
get from each state to each, with ranks; a row per piece goes through a small chain that finds where the best path enters and
leaves it, and then the pieces are repaired side by side. Repeats are found by a count per role and text. What can't be
divided is what the report asks for, one string and one digest of a conversation: its pieces' edits and lines go by in order.

Null roles and texts count as one space, a null turn comes first, a null conv_id is a conversation; rows of one turn are
taken by role, then text. Empty texts are blank. Extra columns, whatever their names, aren't read; an empty table gives an
empty result. Very long texts are whole: one may make a piece of its own."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark import TaskContext

from pagemill.llm.common import small_batches, stored

CHUNK_ROWS = 4_096
CHUNK_BYTES = 4 << 20
WHITE = " \t\n\x0b\f\r"

FINE, BLANK, REPEAT, CUT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the state after a row that is made to fit
# What it costs at most to go on from another state instead: (that state, cost). A system row can only be kept at the start.
STAND_IN = (((ASSISTANT, DELETE), (USER, INSERT + DELETE)), ((ASSISTANT, 0), (USER, INSERT)), ((ASSISTANT, INSERT),), ((USER, INSERT),))
TAILS = ("", "II", "I", "")  # inserts that end a path well, by state
LEGAL = {"su", "ua", "au"}


def _steps(initial: str, fault: int) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, step) for a row: the cheapest, then least, step between every two states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for begin in range(4):
        state, cost, step = begin, 0, ""
        for _ in range(3):  # two inserts reach every state that can be reached
            ways = [(state, DELETE, "D")]
            if fault in (FINE, CUT):
                more = TRUNCATED if fault == CUT else 0
                ways.append((NEXT[state], REROLE + more, "R"))
                if initial == "s" and state == START:
                    ways.append((SYSTEM, KEEP + more, "K"))
                if initial == "u" and NEXT[state] == USER or initial == "a" and NEXT[state] == ASSISTANT:
                    ways.append((NEXT[state], KEEP + more, "K"))
            for end, price, edit in ways:
                best[begin, end] = min(best.get((begin, end), (1 << 60, "")), (cost + price, step + edit))
            state, cost, step = NEXT[state], cost + INSERT, step + "I"
    return [(a, b, c, s) for (a, b), (c, s) in best.items()]


STEPS = {(i, f): _steps(i, f) for i in ("s", "u", "a", "") for f in (FINE, BLANK, REPEAT, CUT)}


class Node:
    __slots__ = ("parent", "refs", "step")

    def __init__(self, parent: Node | None, step: str):
        self.parent, self.step, self.refs = parent, step, 0


class Trellis:
    """The survivors of the rows seen so far, entered in one state. `out` has the steps that are resolved."""

    def __init__(self, entry: int):
        self.root = Node(None, "")
        self.tips: list[Node | None] = [None] * 4
        self.tips[entry] = self.root
        self.cost, self.rank = [0] * 4, [0] * 4
        self.out: list[str] = []
        self.open, self.look = 0, 64

    def row(self, initial: str, fault: int, copies: int) -> None:
        """Go on by a row and its further copies, which have to go."""
        found: list[tuple | None] = [None] * 4
        tips, cost, rank = self.tips, self.cost, self.rank
        for begin, end, price, step in STEPS[initial, fault]:
            if tips[begin] is not None:
                way = (cost[begin] + price, rank[begin], step, begin)
                if found[end] is None or way < found[end]:
                    found[end] = way
        price = [way[0] if way else 1 << 60 for way in found]
        for end in range(4):  # a survivor that others can do all that follows for less than is dropped
            if any(price[end] > price[other] + more for other, more in STAND_IN[end]):
                found[end] = None
        self.tips = [None] * 4
        for end, way in enumerate(found):
            if way:
                parent = tips[way[3]]
                parent.refs += 1
                self.tips[end] = Node(parent, way[2])
        for order, (_, _, end) in enumerate(sorted((way[1], way[2], end) for end, way in enumerate(found) if way)):
            rank[end] = order
        self.cost = [way[0] + DELETE * (copies - 1) if way else 0 for way in found]
        for tip in tips:  # paths that no survivor goes on from
            while tip is not None and tip.refs == 0 and tip is not self.root:
                tip = tip.parent
                tip.refs -= 1
        self.open += 1
        if self.open >= self.look:
            self.settle()

    def settle(self) -> None:
        """Give out the steps that all survivors share."""
        path, node = [], next(t for t in self.tips if t is not None)
        while node is not self.root:
            path.append(node)
            node = node.parent
        while len(path) > 1 and self.root.refs == 1:
            self.root = path.pop()
            self.root.parent = None
            self.out.append(self.root.step)
        self.open = len(path)
        self.look = max(64, 2 * self.open)

    def path(self, end: int) -> list[str]:
        node, last = self.tips[end], []
        while node is not None and node is not self.root:
            last.append(node.step)
            node = node.parent
        return self.out + last[::-1]


def walked(rows: list[tuple[str, int, int]], entry: int) -> Trellis:
    t = Trellis(entry)
    for row in rows:
        t.row(*row)
    return t


def ended(t: Trellis) -> int:
    """The state in which a conversation's best path ends."""
    return min((t.cost[s] + INSERT * len(TAILS[s]), t.rank[s], s) for s in range(4) if t.tips[s] is not None)[2]


def initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: rows with the damage that the crc32 of id and turn gives them, repeats as a count n."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    d = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(F.encode(key, "UTF-8")) % 20).alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return d.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("k") == 3, 2).otherwise(1).cast("long").alias("n"))


def equal_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: equal rows as one, n counting them; rows may come with counts of their own."""
    space, n = F.lit(" "), F.col("n") if "n" in rows.columns else F.lit(1)
    return rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), n.cast("long").alias("n")).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def sizes_of(rows: DataFrame) -> DataFrame:
    """conv_id, rows, bytes, gaps of each conversation of equal_rows()."""
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    return rows.groupBy("conv_id").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"), gaps.alias("gaps"))


def faulty_rows(rows: DataFrame, long: DataFrame) -> DataFrame:
    """rows with their fault, and whether their conversation is long. A row is a repeat if its role and text have an earlier turn."""
    h = [F.xxhash64("conv_id", "role", "text").alias("h1"), F.xxhash64(F.lit(19), "conv_id", "role", "text").alias("h2")]
    rows = rows.select("*", *h)
    seen = rows.groupBy("h1", "h2").agg(F.count("*").alias("turns"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("early")).where("turns > 1")
    d = rows.join(stored(seen.select("h1", "h2", "first", "early"), "repeats"), ["h1", "h2"], "left")
    repeat = F.when(F.col("early"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    fault = F.when(last == "", BLANK).when(F.coalesce(repeat, F.lit(False)), REPEAT).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)
    d = d.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))
    long = long.select(F.col("conv_id").alias("_long"), F.lit(True).alias("_is"))
    return d.join(long, d.conv_id.eqNullSafe(F.col("_long")), "left").drop("_long").withColumn("long", F.coalesce("_is", F.lit(False))).drop("_is")


def pieces(rows: DataFrame, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """One row per piece of a conversation, in the order of (part, seq): its rows, and for a long conversation the costs and
    ranks from each state to each, -1 where there is no way."""
    by = [F.when(F.col("long"), F.col(c)).alias(f"_{c}") for c in ("turn", "role")] + [F.when(F.col("long"), F.substring("text", 1, 64)).alias("_text")]
    d = rows.select("*", *by).repartitionByRange("conv_id", "_turn", "_role", "_text").drop("_turn", "_role", "_text").sortWithinPartitions("conv_id", "turn", "role", "text")
    row = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("fault", T.IntegerType())]))
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("long", T.BooleanType()), T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("rows", row), T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("ranks", T.ArrayType(T.LongType()))])

    def ways(rows: list[dict]) -> tuple[list[int], list[int]]:
        short = [(initial(r["role"]), r["fault"], r["n"]) for r in rows]
        costs, ranks = [-1] * 16, [-1] * 16
        for entry in range(4):
            t = walked(short, entry)
            for end in range(4):
                if t.tips[end] is not None:
                    costs[4 * entry + end], ranks[4 * entry + end] = t.cost[end], t.rank[end]
        return costs, ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        arrow = None
        key, held, size = None, [], 0

        ready, bytes_ready = [], 0

        def piece() -> dict:
            costs, ranks = ways(held) if key[1] else (None, None)
            return {"conv_id": key[0], "long": key[1], "part": part, "seq": seq, "rows": held, "costs": costs, "ranks": ranks}

        for batch in batches:
            if arrow is None:
                item = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("fault", pa.int32())]))
                arrow = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("long", pa.bool_()), ("part", pa.int64()), ("seq", pa.int64()), ("rows", item), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))])
            for start in range(0, batch.num_rows, 1_000):
                for r in batch.slice(start, 1_000).to_pylist():
                    of = (r["conv_id"], r["long"])
                    if held and (of != key or r["long"] and (len(held) >= chunk_rows or size + len(r["text"]) > chunk_bytes)):
                        ready.append(piece())
                        bytes_ready += size
                        seq, held, size = seq + 1, [], 0
                        if bytes_ready > chunk_bytes or len(ready) >= 1_000:
                            yield pa.RecordBatch.from_pylist(ready, schema=arrow)
                            ready, bytes_ready = [], 0
                    key = of
                    held.append({k: r[k] for k in ("role", "text", "n", "fault")})
                    size += len(r["text"])
        if held:
            yield pa.RecordBatch.from_pylist([*ready, piece()], schema=arrow)

    return d.select("conv_id", "long", "role", "text", "n", "fault").mapInArrow(run, schema)


def gates(cut: DataFrame) -> DataFrame:
    """(part, seq, entry, exit) of the pieces of long conversations: a row per piece, chained from the end to find what the rest
    costs from each state, then from the start."""

    def run(rows):
        import pandas as pd

        rows = rows.sort_values(["part", "seq"])
        rest, choices = [INSERT * len(x) for x in TAILS], []
        for costs, ranks in zip(rows["costs"].tolist()[::-1], rows["ranks"].tolist()[::-1]):
            best = [min((costs[4 * e + x] + rest[x], ranks[4 * e + x], x) for x in range(4) if costs[4 * e + x] >= 0) for e in range(4)]
            rest = [b[0] for b in best]
            choices.append([b[2] for b in best])
        entries, state = [], START
        for choice in choices[::-1]:
            entries.append((state, choice[state]))
            state = choice[state]
        return pd.DataFrame({"part": rows["part"].tolist(), "seq": rows["seq"].tolist(), "entry": [x[0] for x in entries], "exit": [x[1] for x in entries], "last": [False] * (len(rows) - 1) + [True]})

    return cut.where("long").select("conv_id", "part", "seq", "costs", "ranks").groupBy("conv_id").applyInPandas(run, "part long, seq long, entry int, exit int, last boolean")


def repaired_pieces(rows: DataFrame, sizes: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """conv_id, part, seq, audit, repaired (role and text of the rows that are left), counts of faults, cost, first and last
    initial: a row for each piece."""
    long = sizes.where((F.col("rows") > chunk_rows) | (F.col("bytes") > chunk_bytes)).select("conv_id")
    with small_batches(rows.sparkSession):
        cut = stored(pieces(faulty_rows(rows, long), chunk_rows, chunk_bytes), "pieces")
        d = cut.drop("costs", "ranks").join(stored(gates(cut), "gates"), ["part", "seq"], "left")
        pair = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
        counts = [T.StructField(c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("repaired", pair), *counts, T.StructField("first", T.StringType()), T.StructField("last", T.StringType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                arrow = pa.schema([("conv_id", kind), ("part", pa.int64()), ("seq", pa.int64()), ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("first", pa.string()), ("last", pa.string())])
                for start in range(0, batch.num_rows, 100):
                    rows = [{"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"]} | repaired(r["rows"], r["entry"], r["exit"], r["last"]) for r in batch.slice(start, 100).to_pylist()]
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        return stored(d.select("conv_id", "part", "seq", "rows", "entry", "exit", "last").mapInArrow(run, schema), "repaired")


def repaired(rows: list[dict], entry: int | None, exit: int | None, last: bool | None) -> dict:
    """The repair of a piece that is entered and left in these states; without them it is a whole conversation."""
    t = walked([(initial(r["role"]), r["fault"], r["n"]) for r in rows], entry or START)
    whole = exit is None
    end = ended(t) if whole else exit
    tail = TAILS[end] if whole or last else ""
    audit, out, state = [], [], entry or START
    before = None
    count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)

    def fitted(text: str) -> None:
        nonlocal state
        state = NEXT[state]
        out.append({"role": "user" if state == USER else "assistant", "text": text})

    for r, step in zip(rows, t.path(end), strict=True):
        for edit in step:
            if edit == "K":
                state = SYSTEM if r["role"][:1] == "s" else NEXT[state]
                out.append({"role": r["role"], "text": r["text"]})
            elif edit != "D":
                fitted(r["text"] if edit == "R" else "")
        audit.append(step + "D" * (r["n"] - 1))
        if r["fault"] == BLANK:
            count["blank"] += r["n"]
        else:
            count["duplicate"] += r["n"] - (r["fault"] != REPEAT)
            count["truncated"] += r["fault"] == CUT
        now = r["role"][:1]
        count["illegal"] += r["n"] - 1 + (before is not None and before + now not in LEGAL)
        before = now
    for _ in tail:
        fitted("")
    return count | {"audit": "".join(audit) + tail, "repaired": out, "cost": t.cost[end] + INSERT * len(tail), "first": rows[0]["role"][:1], "last": before}


def repair(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(conv_id, part, seq, place, role, text): the repaired rows; part, seq, place is their order in a conversation."""
    rows = stored(equal_rows(conversations), "equal-rows")
    d = repaired_pieces(rows, stored(sizes_of(rows), "conversation-sizes"), chunk_rows, chunk_bytes)
    return d.select("conv_id", "part", "seq", F.posexplode("repaired").alias("place", "row")).select("conv_id", "part", "seq", "place", "row.role", "row.text")


def repair_report(conversations: DataFrame, damaged: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each conv_id of conversations: gaps, faults, cost, audit and digest of the repair of its damaged rows."""
    rows = stored(equal_rows(damaged), "equal-rows")
    sizes = stored(sizes_of(rows), "conversation-sizes")
    d = repaired_pieces(rows, sizes, chunk_rows, chunk_bytes)
    line = F.array_join(F.transform("repaired", lambda x: F.concat(x.role, F.lit(":"), x.text)), "\n")
    d = d.withColumn("lines", line).drop("repaired").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([T.StructField("_id", rows.schema["conv_id"].dataType), *[T.StructField(c, T.LongType()) for c in counts], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, key, now, digest, last, any_line = None, None, None, None, None, False

        def done() -> dict:
            return now | {"_id": key, "audit": "".join(now["audit"]), "repaired_sha256": digest.hexdigest()}

        for batch in batches:
            arrow = pa.schema([("_id", batch.schema.field("conv_id").type), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            ready = []
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != key:
                    if now is not None:
                        ready.append(done())
                    key, now, digest, last, any_line = r["conv_id"], dict.fromkeys(counts, 0) | {"audit": []}, hashlib.sha256(), None, False
                for c in counts:
                    now[c] += r[c]
                now["illegal"] += last is not None and last + r["first"] not in LEGAL
                now["audit"].append(r["audit"])
                last = r["last"]
                if r["lines"]:
                    digest.update(("\n" if any_line else "").encode() + r["lines"].encode())
                    any_line = True
            yield pa.RecordBatch.from_pylist(ready, schema=arrow)
        if now is not None:
            yield pa.RecordBatch.from_pylist([done()], schema=arrow)

    with small_batches(rows.sparkSession):
        digests = stored(d.mapInArrow(run, schema), "digests")
    gaps = sizes.select(F.col("conv_id").alias("_id"), "gaps").unionByName(conversations.select(F.col("conv_id").alias("_id")).distinct().withColumn("gaps", F.lit(0).cast("long")))
    ids = gaps.groupBy("_id").agg(F.max("gaps").alias("gaps")).select(F.col("_id").alias("conv_id"), "gaps")
    found = ids.join(digests, ids.conv_id.eqNullSafe(digests["_id"]), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in counts]
    return found.select("conv_id", "gaps", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def repair_damaged(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    return repair_report(conversations, damage(conversations), chunk_rows, chunk_bytes)


def repair_sql(conversations: str = "conversations") -> str:
    crc = "xor(list_reduce(list_transform(string_split(key, ''), lambda ch: ord(ch)::BIGINT), lambda a, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), 4294967295::BIGINT), 4294967295)"

    def went(state: int, edit: str, cost: str) -> str:
        return f"{{'c': v[{state}].c + {cost}, 'a': v[{state}].a || '{edit}'}}"

    closed = f"list_reduce(range(2), lambda v, j: [v[1], v[2], list_min([v[3], {went(1, 'I', '5')}, {went(2, 'I', '5')}, {went(4, 'I', '5')}]), list_min([v[4], {went(3, 'I', '5')}])], acc)"
    stay, keep = "(CASE x.f WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000000000 END)", "(CASE x.f WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000000000 END + CASE WHEN x.r = '{}' THEN 0 ELSE 1000000000000 END)"
    fit = ", ".join([went(s, "R", f"1 + {stay}") for s in (1, 2, 4)] + [went(s, "K", keep.format("u")) for s in (1, 2, 4)])
    edited = f"[{went(1, 'D', '2')}, list_min([{went(2, 'D', '2')}, {went(1, 'K', keep.format('s'))}]), list_min([{went(3, 'D', '2')}, {fit}]), list_min([{went(4, 'D', '2')}, {went(3, 'R', f'1 + {stay}')}, {went(3, 'K', keep.format('a'))}])]"
    # an expression can be named within a list only by going over a list of one
    step = f"list_transform([{closed}], lambda v: {edited})[1]"
    begin = "[{'c': 0::BIGINT, 'a': ''}, {'c': 1000000000000::BIGINT, 'a': ''}, {'c': 1000000000000::BIGINT, 'a': ''}, {'c': 1000000000000::BIGINT, 'a': ''}]"
    return f"""
WITH s AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM {conversations}),
k AS (SELECT *, {crc} % 20 AS k FROM s),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 3 ELSE 0 END AS f,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
l AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(f = 1)::BIGINT AS blank, count_if(f = 2)::BIGINT AS duplicate, count_if(f = 3)::BIGINT AS truncated,
  count_if(before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, list({{'r': left(role, 1), 'f': f}} ORDER BY i) AS xs FROM f GROUP BY conv_id),
v AS (SELECT *, list_reduce(xs, lambda acc, x: {step}, {begin}) AS acc FROM l),
e AS (SELECT *, list_transform([{closed}], lambda v: list_min([v[1], v[4]]))[1] AS best FROM v),
p AS (SELECT f.conv_id, i, role, text, CASE WHEN best.a LIKE '%I%' THEN error('insert') ELSE substr(best.a, i, 1) END AS edit FROM f JOIN e ON f.conv_id IS NOT DISTINCT FROM e.conv_id),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS j, first_value(edit = 'K' AND left(role, 1) = 's') OVER (PARTITION BY conv_id ORDER BY i) AS sys FROM p WHERE edit <> 'D'),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - sys::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS sha FROM n GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM {conversations}) c LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN h ON c.conv_id IS NOT DISTINCT FROM h.conv_id
"""
