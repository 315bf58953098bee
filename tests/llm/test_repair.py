"""Conversation repair against plain relaxation over all edits, and on awkward rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from hostlake.llm import conversation_repair as repair

SPACE = re.compile(r"[^\x20\x09-\x0D]")
KEEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def plain_repair(codes):
    """(cost, audit): all labels are relaxed until none changes."""
    best = {(0, 0): (0, "")}
    for i in range(len(codes) + 1):
        for _ in range(4):
            for state in range(4):
                if (i, state) in best:
                    cost, audit = best[i, state]
                    after = 3 if state == 2 else 2
                    best[i, after] = min(best.get((i, after), (1 << 60, "")), (cost + 3, audit + "I"))
        if i < len(codes):
            for state in range(4):
                if (i, state) in best:
                    cost, audit = best[i, state]
                    ways = [(4, "D", state)]
                    if codes[i] not in "bd":
                        more = 3 if codes[i].isupper() else 0
                        ways.append((3 + more, "R", 3 if state == 2 else 2))
                        if (codes[i].lower(), state) in KEEPS:
                            ways.append((more, "K", KEEPS[codes[i].lower(), state]))
                    for more, letter, after in ways:
                        best[i + 1, after] = min(best.get((i + 1, after), (1 << 60, "")), (cost + more, audit + letter))
    return min(best[len(codes), s] for s in (0, 3) if (len(codes), s) in best)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_report(rows, ids):
    by = collections.defaultdict(list)
    for row in rows:
        by[row[0]].append(row[1:])
    out = []
    for conv in set(ids):
        own = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1] + "\0" + r[2]))
        seen, codes = set(), ""
        for _, role, text in own:
            found = SPACE.findall(text)
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "b" if not found else "d" if (role, text) in seen else code if found[-1] in ".!?" else code.upper()
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = plain_repair(codes)
        kept, state, k = [], 0, 0
        for letter in audit:
            if letter in "IR":
                kept.append(("assistant" if state == 2 else "user", "" if letter == "I" else own[k][2]))
                state = 3 if state == 2 else 2
            elif letter == "K":
                kept.append(own[k][1:])
                state = KEEPS[codes[k].lower(), state]
            k += letter != "I"
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, codes.count("b"), codes.count("d"), sum(c.isupper() for c in codes), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return collections.Counter(out)


def got(df):
    return collections.Counter(tuple(r) for r in df.select("conv_id", *repair.COUNTS, "audit", "repaired_sha256").collect())


def test_search_equals_relaxation():
    for n in range(5):
        for codes in itertools.product("bsuaoSU", repeat=n):
            assert repair.cheapest("".join(codes), 0, (0, 3)) == plain_repair("".join(codes))
    rng = random.Random(5)
    for _ in range(300):
        codes = "".join(rng.choices("uauasoUASbd", k=rng.randint(5, 120)))
        assert repair.cheapest(codes, 0, (0, 3)) == plain_repair(codes)


def test_pieces_join_to_the_whole():
    rng = random.Random(6)
    for _ in range(300):
        codes = "".join(rng.choices("uauasoUASbd", k=rng.randint(2, 40)))
        cuts = sorted({0, len(codes), *(rng.randrange(len(codes)) for _ in range(rng.randint(0, 6)))})
        pieces = [[(e, x, *w) for e in range(4) for x in range(4) if (w := repair.cheapest(codes[a:b], e, (x,)))] for a, b in itertools.pairwise(cuts)]
        chain = repair.joined(pieces)
        cost, audit = chain.cost, ""
        while chain:
            audit, chain = audit + chain.audit, chain.rest
        assert (cost, audit) == plain_repair(codes)


def awkward():
    rng = random.Random(7)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "User", "umpire"]
    texts = ["Yes.", "No!", "why?", "", " \t", None, "cut off", "end.  \n", "é。", "same.", "same.", "x" * 5000 + "."]
    rows = [(k // 6, rng.choice([k % 6, k % 6, 3, None]), rng.choice(roles), rng.choice(texts)) for k in range(900)]
    rows += [(None, t, rng.choice(roles), rng.choice(texts)) for t in range(20)]
    rows += [(5000, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)]
    rows += [(5001, None, "user", "a."), (5002, 7, "user", "b."), (5002, 7, "user", "b.")]
    return [*rows, rows[0], rows[0], rows[3]]


@pytest.mark.parametrize("bits", [2, 9])
def test_report(engine, monkeypatch, bits):
    monkeypatch.setattr(repair, "PIECE_BITS", bits)
    rows = awkward()
    turns = engine.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("position", F.lit("?")).withColumn("piece", F.lit(1)).repartition(5)
    found = repair.report(repair.damage(turns), turns)
    assert got(found) == plain_report(damaged(rows), [r[0] for r in rows])


def test_repaired_turns_are_sound(engine):
    rows = awkward()
    turns = engine.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    _, kept = repair.repair(turns)
    by = collections.defaultdict(list)
    for r in kept.collect():
        by[r["conv_id"]].append((r["place"], r["role"][:1], r["edit"]))
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[1] for x in sorted(v))) for v in by.values())
    assert {e for v in by.values() for _, _, e in v} == {"K", "R", "I"}


def test_no_rows(engine):
    none = engine.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert repair.report(none, none).count() == 0
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    one = engine.createDataFrame([(dropped, 0, "user", "x.")], "conv_id long, turn long, role string, text string")
    assert got(repair.report(repair.damage(one), one)) == {(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()): 1}


def test_registered_query_equals_plain_version(engine):
    from hostlake.llm.queries import QUERIES

    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in engine.read.parquet(f"{path}/conversations.parquet").collect()]
    assert got(QUERIES["op11_bidirectional_repair"](engine, path)) == plain_report(damaged(rows), [r[0] for r in rows])
