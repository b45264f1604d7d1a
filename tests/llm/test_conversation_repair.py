"""Conversation repair against all edit sequences of small conversations, and against a plain walk of the tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parley.llm import conversation_repair as c

from .conftest import counted

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def every(rows):
    """Least (cost, audit, repaired turns) of all edits with up to len(rows) + 2 insertions; rows: (role, text, fault)."""
    best = None
    for most in range(len(rows) + 3):
        if best is not None and best[0] <= 5 * most:
            break
        for gaps in itertools.combinations_with_replacement(range(len(rows) + 1), most):
            for roles in itertools.product(("user", "assistant"), repeat=most):
                options = [[("D", 2, None)] if f in ("blank", "duplicate") else [("D", 2, None), ("K", 5 * (f == "truncated"), r), ("R", 1 + 5 * (f == "truncated"), "user"), ("R", 1 + 5 * (f == "truncated"), "assistant")] for r, _, f in rows]
                for chosen in itertools.product(*options):
                    audit, turns, cost, new = "", [], 5 * most, iter(zip(gaps, roles))
                    ahead = next(new, None)
                    for k in range(len(rows) + 1):
                        while ahead is not None and ahead[0] == k:
                            audit, ahead = audit + "I", turns.append((ahead[1], "")) or next(new, None)
                        if k < len(rows):
                            letter, price, role = chosen[k]
                            audit, cost = audit + letter, cost + price
                            if role is not None:
                                turns.append((role, rows[k][1]))
                    if GRAMMAR.match("".join(r[:1] for r, _ in turns)) and (best is None or (cost, audit) < best[:2]):
                        best = (cost, audit, turns)
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def viterbi(rows):
    """Least (cost, audit, turns) by a plain table of whole audits; rows with faults."""
    follow = {"": ("su"), "s": "u", "u": "a", "a": "u"}

    def grown(table):
        for _ in range(3):
            for state, (cost, audit, turns) in list(table.items()):
                for x in follow[state].replace("s", ""):
                    way = (cost + 5, audit + "I", [*turns, ("user" if x == "u" else "assistant", "")])
                    table[x] = min(table.get(x, way), way)
        return table

    table = grown({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, turns) in table.items():
            ways = [(state, (cost + 2, audit + "D", turns))]
            if fault not in ("blank", "duplicate"):
                charge = 5 * (fault == "truncated")
                if role[:1] and role[:1] in follow[state]:
                    ways.append((role[:1], (cost + charge, audit + "K", [*turns, (role, text)])))
                for x in follow[state].replace("s", ""):
                    ways.append((x, (cost + charge + 1, audit + "R", [*turns, ("user" if x == "u" else "assistant", text)])))
            for to, way in ways:
                after[to] = min(after.get(to, way), way)
        table = grown(after)
    return min(table[s] for s in ("", "a") if s in table)


def row(conv, rows, turns):
    """The contract's row for one conversation's rows in order."""
    found = faults(rows)
    cost, audit, repaired = viterbi(found)
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    kinds = [f for *_, f in found]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())


def test_all_edits_of_small_conversations():
    rng = random.Random(5)
    for _ in range(60):
        rows = faults([(rng.choice(("system", "user", "assistant", "tool")), rng.choice(("a.", "b!", "", "cut"))) for _ in range(rng.randint(0, 3))])
        assert every(rows) == viterbi(rows)
        symbols = "".join("x" if f in ("blank", "duplicate") else (r[0] if r[0] in "sua" else "o").upper() if f == "truncated" else r[0] if r[0] in "sua" else "o" for r, _, f in rows)
        assert c.search(symbols, c.START, c.ACCEPTING).popitem()[1] == viterbi(rows)[:2]


def test_blocks_compose(monkeypatch):
    """A conversation cut into blocks of any length has the edits of the whole."""
    rng = random.Random(6)
    whole = [("".join(rng.choices("suaoxSUAO", (1, 6, 6, 1, 2, 1, 2, 2, 1), k=rng.randint(0, 60)))) for _ in range(150)]
    want = [c.search(s, c.START, c.ACCEPTING).popitem()[1] for s in whole]
    for size in (1, 2, 7):
        monkeypatch.setattr(c, "BLOCK", size)
        for s, w in zip(whole, want):
            own = c.Composer(c.Memo(lambda x: c.search(x, c.START, c.ACCEPTING).popitem()[1]), c.Memo(c.block_map))
            for x in s:
                own.add(x)
            assert own.end() == w


def plain_damage(rows):
    """By conversation, rows after damage in order: (turn, role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key, role, text = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}", " " if role is None else role, " " if text is None else text
        damage = zlib.crc32(key.encode()) % 20
        own = out[conv]
        if damage == 1:
            text = ""
        if damage == 2:
            text = re.sub("[.!?]", "", text)
        if damage == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if damage == 0 else 2 if damage == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_the_query_equals_a_plain_walk(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = [row(conv, [x[1:] for x in own], [x[0] for x in own]) for conv, own in plain_damage(rows).items()]
    got = c.op12_conversation_repair(spark, folder)
    assert got.columns == ["conv_id", *c.FIGURES, "audit", "repaired_sha256"]
    assert counted(map(tuple, got.collect())) == counted(want)


SHAPE = "conv_id long, turn long, role string, text string, place int, audit string, figures int"


def test_odd_rows(spark):
    rng = random.Random(7)
    rows = [(rng.choice((None, 1, 2, 3)), rng.choice((None, 5, 6, 900)), rng.choice((None, "user", "assistant", "system", "", "tool")), rng.choice((None, "", "same.", "\t.\n", "é?", "open", "x" * 5000))) for _ in range(120)]
    df = spark.createDataFrame([(*r, 1, "a", 2) for r in rows], SHAPE).repartition(3)
    want = [row(conv, [x[1:] for x in own], [x[0] for x in own]) for conv, own in plain_damage(rows).items()]
    got = c.repair_conversations(c.damaged(df), absent=F.col("dropped"))
    assert counted(map(tuple, got.collect())) == counted(want)
    turns = defaultdict(list)
    for r in c.repaired_turns(c.damaged(df), absent=F.col("dropped")).orderBy("conv_id", "place").collect():
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {w[0]: w[-1] for w in want} == {w[0]: hashlib.sha256("\n".join(turns[w[0]]).encode()).hexdigest() for w in want}


def test_one_long_conversation_and_none(spark):
    rng = random.Random(8)
    rows = [(4, k, rng.choice(("user", "assistant", "user", "system")), rng.choice((f"{k}.", f"{k}.", f"{k}", "", "again."))) for k in range(1500)]
    got = c.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    assert [tuple(r) for r in got] == [row(4, [r[2:] for r in rows], [r[1] for r in rows])]
    empty = spark.createDataFrame([], SHAPE)
    assert c.repair_conversations(c.damaged(empty), absent=F.col("dropped")).count() == 0
    gone = spark.createDataFrame([(9, 1, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in c.repair_conversations(gone, absent=F.lit(True)).collect()] == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
