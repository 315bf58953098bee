"""Operator 11: conversation structure repair by bidirectional Dijkstra over the edit lattice.

A conversation should read `(s?(ua)+)?` by the initials of its roles. A node of its lattice is (rows consumed, state),
the states being: nothing yet, after a system turn, a user's turn open, a pair closed. Edges consume a row - Keep (0),
Rerole to the role that fits (3), Delete (4; all that blank and duplicate rows have) - or Insert the role that fits (3);
truncated rows that stay cost 3 more. In each state one role fits each edit, so the letters of the edits, the audit,
tell the whole repair.

Two heaps start from both ends. Both order nodes by (cost, rows consumed), so when a node is settled all its
predecessors of equal cost are, and its label is the least audit from its end. They stop when no cheaper or equally
cheap path can remain; of all crossings of least cost, at nodes or over edges, the one of least concatenated audit wins.
Among audits of equal cost between the same nodes none starts with another, since what is longer has more inserts, so
least parts give the least whole.

Scale. Rows are sorted over all partitions by (conversation, turn, role and text) and numbered; 2 ** PIECE_BITS consecutive
numbers at most make a piece of a conversation. Repeated rows are found by an aggregate of text keys, faults and
pieces by DataFrame operations. A conversation within one piece is solved there; of a split one, each piece is solved for
all pairs of states it may begin and end in, on its own, and pieces are joined from the end by least (cost, audit).
Only that joining has one task a conversation, and it holds audits, not texts. Repaired turns are rows again. `digests`
streams them in order and keeps nothing, but a hash of one text is made in one task.

Rows: NULL roles and texts are one space. Rows come by turn, NULL first, then by role and text; equal rows are repeats. A
NULL conversation id is an id like others. Other columns are not passed on. An empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hostlake.llm.common import stored

PIECE_BITS = 9
#: Characters of role and text by which rows of one turn are dealt to partitions.
DEALT_CHARS = 128
BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, CLOSED = range(4)
FITTING = {START: ("user", USER), SYSTEM: ("user", USER), CLOSED: ("user", USER), USER: ("assistant", CLOSED)}
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", CLOSED): USER, ("a", USER): CLOSED}
LEGAL = {"su", "ua", "au"}
#: What a row is to the lattice: blank or duplicate, or the initial of its role, in upper case if it is truncated.
BLANK, DUPLICATE, OTHER = "b", "d", "o"
CODES = [BLANK, DUPLICATE, *"suaoSUAO"]


def _edges(code: str) -> list[tuple[str, int, int, int]]:
    """(letter, cost, state before, state after) of what can be done with a row."""
    out = [("D", 4, s, s) for s in range(4)]
    if code not in (BLANK, DUPLICATE):
        more = 3 if code.isupper() else 0
        out += [("K", more, before, after) for (initial, before), after in KEPT.items() if initial == code.lower()]
        out += [("R", 3 + more, before, after) for before, (_, after) in FITTING.items()]
    return out


INSERTS = [("I", 3, before, after) for before, (_, after) in FITTING.items()]
FORWARD = {c: [[(e[0], e[1], e[3]) for e in _edges(c) if e[2] == s] for s in range(4)] for c in CODES}
REVERSE = {c: [[(e[0], e[1], e[2]) for e in _edges(c) if e[3] == s] for s in range(4)] for c in CODES}
INSERT_FORWARD = [[(e[0], e[1], e[3]) for e in INSERTS if e[2] == s] for s in range(4)]
INSERT_REVERSE = [[(e[0], e[1], e[2]) for e in INSERTS if e[3] == s] for s in range(4)]


class _Side:
    """One end's heap: nodes are (rows consumed, state); labels are (cost, audit)."""

    def __init__(self, codes: str, starts: list[tuple[int, int]], forward: bool):
        self.codes, self.forward = codes, forward
        self.rows, self.inserts = (FORWARD, INSERT_FORWARD) if forward else (REVERSE, INSERT_REVERSE)
        self.labels = {node: (0, "") for node in starts}
        self.settled: dict[tuple[int, int], tuple[int, str]] = {}
        self.heap: list[tuple[int, int, int]] = []

    def edges(self, node: tuple[int, int]) -> Iterator[tuple[str, int, tuple[int, int]]]:
        row, state = node
        if self.forward:
            if row < len(self.codes):
                for letter, cost, other in self.rows[self.codes[row]][state]:
                    yield letter, cost, (row + 1, other)
        elif row:
            for letter, cost, other in self.rows[self.codes[row - 1]][state]:
                yield letter, cost, (row - 1, other)
        for letter, cost, other in self.inserts[state]:
            yield letter, cost, (row, other)

    def settle(self, node: tuple[int, int], other: _Side, best: int) -> int:
        """Settles a node, and returns the least cost of a crossing known then."""
        cost, audit = self.settled[node] = self.labels[node]
        if node in other.settled:
            best = min(best, cost + other.settled[node][0])
        for letter, more, further in self.edges(node):
            label = (cost + more, audit + letter if self.forward else letter + audit)
            if further in other.settled:
                best = min(best, label[0] + other.settled[further][0])
            known = self.labels.get(further)
            if known is None or label < known:
                self.labels[further] = label
                if known is None or label[0] < known[0]:
                    heapq.heappush(self.heap, (label[0], further[0] if self.forward else -further[0], further[1]))
        return best

    def head(self) -> int | None:
        """The cost of the next node that is not settled; None if there is none."""
        while self.heap:
            cost, row, state = self.heap[0]
            node = (abs(row), state)
            if node not in self.settled and self.labels[node][0] == cost:
                return cost
            heapq.heappop(self.heap)
        return None

    def take(self) -> tuple[int, int]:
        _, row, state = heapq.heappop(self.heap)
        return abs(row), state


@lru_cache(maxsize=1 << 14)
def cheapest(codes: str, enter: int, leaves: tuple[int, ...]) -> tuple[int, str] | None:
    """Least cost, and least audit of that cost, from state `enter` before all rows to one of `leaves` after them."""
    never = 1 << 60
    source, goals = (0, enter), [(len(codes), s) for s in leaves]
    ahead, back = _Side(codes, [source], True), _Side(codes, goals, False)
    best = ahead.settle(source, back, never)
    for goal in goals:
        best = back.settle(goal, ahead, best)
    while True:
        near, far = ahead.head(), back.head()
        if near is None or far is None or near + far > best:
            break
        best = ahead.settle(ahead.take(), back, best) if near <= far else back.settle(back.take(), ahead, best)
    if best == never:
        return None
    audits = []
    for node, (cost, audit) in ahead.settled.items():
        if node in back.settled and cost + back.settled[node][0] == best:
            audits.append(audit + back.settled[node][1])
        for letter, more, further in ahead.edges(node):
            if further in back.settled and cost + more + back.settled[further][0] == best:
                audits.append(audit + letter + back.settled[further][1])
    return best, min(audits)


def edits(codes: str, enter: int, audit: str) -> list[tuple[str, int | None, str | None]]:
    """(letter, row or None, new role or None) of each edit of an audit."""
    out, state, row = [], enter, 0
    for letter in audit:
        role = None
        if letter in "RI":
            role, state = FITTING[state]
        elif letter == "K":
            state = KEPT[codes[row].lower(), state]
        out.append((letter, None if letter == "I" else row, role))
        row += letter != "I"
    return out


class _Chain(NamedTuple):
    """The repair from a state on: this piece's way, then the chain after it."""

    cost: int
    enter: int
    audit: str
    rest: _Chain | None


def _precedes(a: _Chain, b: _Chain) -> bool:
    """Whether a is cheaper than b, or as cheap and of lesser audit."""
    if a.cost != b.cost:
        return a.cost < b.cost
    x, y = a.audit, b.audit
    while True:
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]
        while not x and a.rest:
            a = a.rest
            x = a.audit
        while not y and b.rest:
            b = b.rest
            y = b.audit
        if not x or not y or (a is b and x == y):
            return bool(y) and not x


def joined(pieces: list[list[tuple[int, int, int, str]]]) -> _Chain:
    """The least chain through the ways (enter, leave, cost, audit) of consecutive pieces."""
    after: dict[int, _Chain | None] = {START: None, CLOSED: None}
    for ways in reversed(pieces):
        here: dict[int, _Chain] = {}
        for enter, leave, cost, audit in ways:
            if leave in after:
                rest = after[leave]
                chain = _Chain(cost + (rest.cost if rest else 0), enter, audit, rest)
                if enter not in here or _precedes(chain, here[enter]):
                    here[enter] = chain
        after = here
    return after[START]


def damage(turns: DataFrame) -> DataFrame:
    """Rows with planted faults, chosen by the CRC of `conv_id:turn`: dropped, emptied, cut, repeated, or made a user's."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    key = F.concat(conv, F.lit(":"), turn)
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, position): stored; positions grow in the order of rows and leave gaps between partitions."""
    content = F.concat("role", F.lit("\0"), "text")
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    dealt = rows.repartitionByRange("conv_id", "turn", F.substring(content, 1, DEALT_CHARS)).sortWithinPartitions("conv_id", "turn", content)
    return stored(dealt.withColumn("position", F.monotonically_increasing_id()), "turns")


def _pieces(rows: DataFrame) -> DataFrame:
    """(conv_id, piece, start, codes, initials, blank, duplicate, truncated, turn figures): a row for each piece."""
    key = F.unhex(F.md5(F.concat("role", F.lit("\0"), "text").cast("binary")))
    small = rows.select(
        "conv_id", "turn", "position", key.alias("key"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("is_blank"),
        (~F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1).isin(".", "!", "?")).alias("is_cut"),
        F.substring("role", 1, 1).alias("initial"),
    )
    again = small.groupBy("conv_id", "key").agg(F.count("*").alias("n"), F.min("position").alias("first")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first")
    marked = small.join(again, small["conv_id"].eqNullSafe(again["c"]) & (small["key"] == again["k"]), "left")
    repeated = F.coalesce(F.col("position") > F.col("first"), F.lit(False))
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit(OTHER))
    code = F.when(F.col("is_blank"), F.lit(BLANK)).when(repeated, F.lit(DUPLICATE)).when(F.col("is_cut"), F.upper(known)).otherwise(known)
    faults = marked.select(
        "conv_id", "position", "turn", code.alias("code"),
        # An empty role has no initial; NUL holds its place.
        F.when(F.col("initial") == "", F.lit("\0")).otherwise(F.col("initial")).alias("initial"),
    )
    row = F.struct("position", "turn", "code", "initial")
    cut = F.when(F.col("code").isin(BLANK, DUPLICATE), 0).otherwise((F.col("code") == F.upper("code")).cast("int"))
    held = faults.groupBy("conv_id", F.shiftright("position", PIECE_BITS).alias("piece")).agg(
        F.array_sort(F.collect_list(row)).alias("rows"),
        F.sum((F.col("code") == BLANK).cast("bigint")).alias("blank"),
        F.sum((F.col("code") == DUPLICATE).cast("bigint")).alias("duplicate"),
        F.sum(cut.cast("bigint")).alias("truncated"),
        F.min("turn").alias("turn_lo"),
        F.max("turn").alias("turn_hi"),
    )
    return held.select(
        "conv_id", "piece", "blank", "duplicate", "truncated", "turn_lo", "turn_hi",
        F.size(F.array_distinct(F.array_compact("rows.turn"))).cast("bigint").alias("n_turns"),
        F.col("rows")[0]["position"].alias("start"),
        F.array_join("rows.code", "").alias("codes"),
        F.array_join("rows.initial", "").alias("initials"),
    )


WAYS = T.ArrayType(T.StructType([T.StructField("enter", T.IntegerType()), T.StructField("leave", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
PARTS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("codes", T.StringType()), T.StructField("enter", T.IntegerType()), T.StructField("audit", T.StringType())]))
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _solved(pieces: DataFrame) -> DataFrame:
    """pieces with `ways`: of a whole conversation its repair, of a part of one those between any two states."""
    split = pieces.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.lit(True).alias("split"))
    marked = pieces.join(split, pieces["conv_id"].eqNullSafe(split["c"]), "left").drop("c")
    schema = T.StructType([*pieces.schema.fields, T.StructField("ways", WAYS)])
    kind = to_arrow_schema(schema).field("ways").type
    names = pieces.columns

    def ways(codes: str, part: bool) -> list[tuple]:
        if not part:
            cost, audit = cheapest(codes, START, (START, CLOSED))
            return [(START, CLOSED, cost, audit)]
        found = [(enter, leave, cheapest(codes, enter, (leave,))) for enter in range(4) for leave in range(4)]
        return [(enter, leave, *way) for enter, leave, way in found if way]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [ways(codes, bool(part)) for codes, part in zip(batch.column("codes").to_pylist(), batch.column("split").to_pylist(), strict=True)]
            made = [[dict(zip(("enter", "leave", "cost", "audit"), way, strict=True)) for way in found] for found in made]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(made, kind)], [*names, "ways"])

    return marked.mapInArrow(run, schema)


def _repaired(solved: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, parts): a row for each conversation."""
    schema = T.StructType([solved.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType()), T.StructField("parts", PARTS)])
    arrow = to_arrow_schema(schema)

    def whole(pieces: list[dict]) -> dict:
        chain = joined([[(w["enter"], w["leave"], w["cost"], w["audit"]) for w in p["ways"]] for p in pieces])
        cost, parts = chain.cost, []
        for p in pieces:
            parts.append({"start": p["start"], "codes": p["codes"], "enter": chain.enter, "audit": chain.audit})
            chain = chain.rest
        dated = [p for p in pieces if p["n_turns"]]
        distinct = sum(p["n_turns"] for p in dated) - sum(a["turn_hi"] == b["turn_lo"] for a, b in zip(dated, dated[1:], strict=False))
        inside = sum(x + y not in LEGAL for p in pieces for x, y in zip(p["initials"], p["initials"][1:], strict=False))
        across = sum(a["initials"][-1] + b["initials"][0] not in LEGAL for a, b in zip(pieces, pieces[1:], strict=False))
        return {
            "conv_id": pieces[0]["conv_id"],
            "gaps": dated[-1]["turn_hi"] - dated[0]["turn_lo"] + 1 - distinct if dated else 0,
            **{k: sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated")},
            "illegal": inside + across,
            "cost": cost,
            "audit": "".join(x["audit"] for x in parts),
            "parts": parts,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out = []
            for piece in batch.to_pylist():
                if held and held[-1]["conv_id"] != piece["conv_id"]:
                    out.append(whole(held))
                    held = []
                held.append(piece)
            yield pa.RecordBatch.from_pylist(out, arrow)
        if held:
            yield pa.RecordBatch.from_pylist([whole(held)], arrow)

    return solved.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(run, schema)


def _edit_rows(found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, position, new_role): the edits of each conversation; place orders them."""
    schema = T.StructType([found.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("position", T.LongType()), T.StructField("new_role", T.StringType())])
    arrow = to_arrow_schema(schema)
    parts = found.select("conv_id", F.posexplode("parts").alias("n", "part")).select("conv_id", "n", "part.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                out = [
                    {"conv_id": p["conv_id"], "place": p["n"] << 32 | k, "edit": letter, "position": None if row is None else p["start"] + row, "new_role": role}
                    for k, (letter, row, role) in enumerate(edits(p["codes"], p["enter"], p["audit"]))
                ]
                yield pa.RecordBatch.from_pylist(out, arrow)

    return parts.mapInArrow(run, schema)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables. Conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Repaired turns:
    conv_id, place (their order), edit, turn (NULL for inserted ones), role, text."""
    rows = _ordered(turns)
    found = stored(_repaired(_solved(_pieces(rows))), "repairs")
    done = _edit_rows(found).where("edit <> 'D'")
    old = done.where("position is not null").join(rows.select("position", "turn", "role", "text"), "position")
    kept = old.select("conv_id", "place", "edit", "turn", F.coalesce("new_role", "role").alias("role"), "text")
    new = done.where("position is null").select("conv_id", "place", "edit", F.lit(None).cast("bigint").alias("turn"), F.col("new_role").alias("role"), F.lit("").alias("text"))
    return found.drop("parts"), kept.union(new)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired turns: `role:text`, joined by newlines, as they stream by."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, None
        for batch in batches:
            out = []
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role"), batch.column("text"), strict=True):
                if known is None or conv != at:
                    if known is not None:
                        out.append({"conv_id": at, "repaired_sha256": known.hexdigest()})
                    at, known = conv, hashlib.sha256()
                else:
                    known.update(b"\n")
                known.update(f"{role.as_py()}:{text.as_py()}".encode())
            yield pa.RecordBatch.from_pylist(out, arrow)
        if known is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": at, "repaired_sha256": known.hexdigest()}], arrow)

    ordered = turns.select("conv_id", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(run, schema)


def report(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each conversation of `ids`: the repair's figures and the digest of the repaired turns. Those without rows
    have zeros, an empty audit and the digest of an empty text."""
    found, repaired = repair(turns)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    left = ids.select("conv_id").distinct()
    for part in (found, digests(repaired)):
        own = part.withColumnRenamed("conv_id", "own_id")
        left = left.join(own, left["conv_id"].eqNullSafe(own["own_id"]), "left").drop("own_id")
    return left.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )
