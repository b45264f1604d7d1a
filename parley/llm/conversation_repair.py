"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, by A* on the edit lattice."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Memo, map_arrow, slices

#: White space of the contract, beside which a text is blank.
WHITE = " \t\n\x0b\x0c\r"

#: Costs of the edits; an undeleted truncated row costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. By state, what may follow: initial and next state.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ACCEPTING = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}

#: Rows of a conversation that A* takes at once; longer ones are composed of blocks.
BLOCK = 128

FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


# ---------------------------------------------------------------- the search


def search(symbols: str, entry: int, exits: tuple[int, ...], all_exits: bool = False) -> dict[int, tuple[int, str]]:
    """By exit state the least (cost, audit) of edits that lead from ``entry`` through the rows; only the best exit unless ``all_exits``.

    Symbols: 'x' a row that must be deleted; s, u, a, o a row of that initial (o: any other); in capitals if it is truncated.
    The heuristic is a suffix sum: what rows ahead cost at least, a deletion for each 'x', and for each truncated row the lesser of
    deleting it and its charge. It never falls by more than an edit costs, so the first time a node leaves the queue, which is ordered by
    cost plus heuristic and then by audit, its edits are the cheapest and of those the least: of two ways to one node neither audit begins
    the other, so what follows does not change their order.
    """
    n = len(symbols)
    ahead = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        ahead[k] = ahead[k + 1] + (DELETE if symbols[k] == "x" else min(DELETE, TRUNCATED) if symbols[k].isupper() else 0)
    queue: list[tuple[int, str, int, int, int]] = [(ahead[0], "", 0, entry, 0)]
    closed: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while queue:
        _, audit, at, state, cost = heappop(queue)
        if (at, state) in closed:
            continue
        closed.add((at, state))
        if at == n and state in exits:
            found[state] = (cost, audit)
            if not all_exits or len(found) == len(exits):
                break
        steps = [("I", at, NEXT[state][c], INSERT) for c in "ua" if c in NEXT[state]]
        if at < n:
            symbol = symbols[at]
            steps.append(("D", at + 1, state, DELETE))
            if symbol != "x":
                charge = TRUNCATED if symbol.isupper() else 0
                kept = NEXT[state].get(symbol.lower())
                if kept is not None:
                    steps.append(("K", at + 1, kept, charge))
                steps += [("R", at + 1, NEXT[state][c], REROLE + charge) for c in "ua" if c in NEXT[state]]
        for letter, to, after, price in steps:
            if (to, after) not in closed:
                heappush(queue, (cost + price + ahead[to], audit + letter, to, after, cost + price))
    return found


def block_map(symbols: str) -> list[dict[int, tuple[int, str]]]:
    """The least (cost, audit) from each state before a block of rows to each state after it."""
    return [search(symbols, entry, tuple(range(4)), True) for entry in range(4)]


class Composer:
    """Edits of one conversation, whose symbols come one by one: blocks' maps are applied to the best way into each state."""

    def __init__(self, short: Memo, blocks: Memo):
        self.short, self.blocks, self.held, self.ways = short, blocks, [], None

    def add(self, symbol: str) -> None:
        self.held.append(symbol)
        if len(self.held) == BLOCK:
            self.ways, self.held = self._after(self.blocks["".join(self.held)]), []

    def _after(self, block: list[dict[int, tuple[int, str]]]) -> dict[int, tuple[int, str]]:
        ways = {START: (0, "")} if self.ways is None else self.ways
        after: dict[int, tuple[int, str]] = {}
        for at, (cost, audit) in ways.items():
            for to, (more, letters) in block[at].items():
                way = (cost + more, audit + letters)
                after[to] = min(after.get(to, way), way)
        return after

    def end(self) -> tuple[int, str]:
        if self.ways is None:
            return self.short["".join(self.held)]
        ways = self._after(self.blocks["".join(self.held)])
        return min(ways[s] for s in ACCEPTING if s in ways)


# ---------------------------------------------------------------- rows


def prepared(df: DataFrame, conv: str, turn: str, role: str, text: str, absent: Column | None) -> DataFrame:
    """conv_id, turn, role, text, fp (of role and text), absent. Null roles and texts are one space."""
    gone = F.lit(False) if absent is None else F.coalesce(absent, F.lit(False))
    own_role = F.when(gone, "").otherwise(F.coalesce(F.col(role).cast("string"), F.lit(" ")))
    own_text = F.when(gone, "").otherwise(F.coalesce(F.col(text).cast("string"), F.lit(" ")))
    rows = df.select(F.col(conv).alias("conv_id"), F.when(~gone, F.col(turn)).cast("long").alias("turn"), own_role.alias("role"), own_text.alias("text"), gone.alias("absent"))
    return rows.withColumn("fp", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def plans(rows: DataFrame) -> DataFrame:
    """conv_id, figures (gaps, blank, duplicate, truncated, illegal, cost) and audit of each conversation; texts are not shuffled for it."""
    bare = F.rtrim("text", F.lit(WHITE))
    light = rows.select("conv_id", "turn", "role", "fp", "absent", F.substring("role", 1, 1).alias("initial"), F.when(bare == "", "b").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("").alias("fault"))
    kind = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {kind}, figures array<long>, audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = Memo(lambda s: search(s, START, ACCEPTING).popitem()[1])
        blocks = Memo(block_map, 2000)
        shape, own, now, out = None, None, object(), []

        def flush() -> pa.RecordBatch:
            ids, figures, audits = zip(*out)
            batch = pa.RecordBatch.from_arrays([pa.array(ids, shape), pa.array(figures, pa.list_(pa.int64())), pa.array(audits, pa.string())], names=["conv_id", "figures", "audit"])
            out.clear()
            return batch

        for batch in batches:
            shape = batch.column("conv_id").type
            for conv, turn, fp, absent, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "fp", "absent", "initial", "fault"))):
                if own is None or conv != now:
                    if own is not None:
                        out.append((now, *own.result()))
                    now, own = conv, Conversation(short, blocks)
                if not absent:
                    own.add(turn, fp, initial, fault)
            if len(out) >= 1000:
                yield flush()
            short.trim()
            blocks.trim()
        if own is not None:
            out.append((now, *own.result()))
        if out:
            yield flush()

    ordered = light.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "fp")
    return map_arrow(ordered, run, schema)


class Conversation:
    """Figures of one conversation whose rows come in order. It holds 16 bytes of each distinct row and a letter of each row's edit."""

    def __init__(self, short: Memo, blocks: Memo):
        self.edits, self.seen, self.before = Composer(short, blocks), set(), None
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, fp: bytes, initial: str, fault: str) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if fault == "b":
            self.blank += 1
        elif fp in self.seen:
            self.duplicate += 1
            fault = "b"
        elif fault == "t":
            self.truncated += 1
        self.seen.add(fp)
        symbol = "x" if fault == "b" else initial if initial in ("s", "u", "a") else "o"
        self.edits.add(symbol.upper() if fault == "t" else symbol)

    def result(self) -> tuple[list[int], str]:
        cost, audit = self.edits.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost], audit


def _walk(rows: DataFrame, planned: DataFrame, sink: Callable, schema: str) -> DataFrame:
    """Texts in order behind their conversation's plan, through ``sink``: an object for each task that takes begin(conv, figures, audit),
    turn(role, text), end(), and gives take(shape) -> record batch, once ``full``."""
    texts = rows.where(~F.col("absent")).select("conv_id", "turn", "role", "fp", "text")
    both = texts.withColumns({"place": F.lit(1), "figures": F.lit(None).cast("array<long>"), "audit": F.lit(None).cast("string")}).unionByName(planned.withColumn("place", F.lit(0)), allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "place", F.col("turn").asc_nulls_first(), "role", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shape, letters, state, open_ = sink(), None, iter(()), START, False

        def inserted(until: str | None) -> str | None:
            """Passes insertions up to the next row's letter, which it returns."""
            nonlocal state
            for letter in letters:
                if letter != "I":
                    return letter
                c = "a" if state == USER else "u"
                state = NEXT[state][c]
                out.turn(ROLES[c], "", "I")
            return until

        for batch in slices(batches, "text", 8 << 20):
            shape = batch.column("conv_id").type
            for conv, place, role, text, figures, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text", "figures", "audit"))):
                if place == 0:
                    if open_:
                        inserted(None)
                        out.end()
                    open_, letters, state = True, iter(audit), START
                    out.begin(conv, figures, audit)
                    continue
                letter = inserted(None)
                if letter == "D":
                    continue
                if letter == "R":
                    c = "a" if state == USER else "u"
                    role = ROLES[c]
                else:
                    c = role[:1]
                state = NEXT[state][c]
                out.turn(role, text, letter)
            if out.full():
                yield out.take(shape)
        if open_:
            inserted(None)
            out.end()
        if shape is not None:
            yield out.take(shape)

    return map_arrow(ordered.select("conv_id", "place", "role", "text", "figures", "audit"), run, schema)


class _Digests:
    """A row for each conversation: its figures and the hash of its repaired turns, fed turn by turn."""

    def __init__(self):
        self.rows: list[tuple] = []

    def begin(self, conv, figures: list[int], audit: str) -> None:
        self.own, self.hash, self.first = (conv, *figures, audit), hashlib.sha256(), True

    def turn(self, role: str, text: str, letter: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def end(self) -> None:
        self.rows.append((*self.own, self.hash.hexdigest()))

    def full(self) -> bool:
        return len(self.rows) >= 1000

    def take(self, shape: pa.DataType) -> pa.RecordBatch:
        types = [shape, *[pa.int64()] * len(FIGURES), pa.string(), pa.string()]
        columns = list(zip(*self.rows)) or [()] * len(types)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", *FIGURES, "audit", "repaired_sha256"])


class _Turns:
    """A row for each repaired turn."""

    def __init__(self):
        self.rows: list[tuple] = []

    def begin(self, conv, figures: list[int], audit: str) -> None:
        self.conv, self.place = conv, 0

    def turn(self, role: str, text: str, letter: str) -> None:
        self.rows.append((self.conv, self.place, role, text, letter))
        self.place += 1

    def end(self) -> None: ...

    def full(self) -> bool:
        return True

    def take(self, shape: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 5
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [shape, pa.int64(), pa.string(), pa.string(), pa.string()])], names=["conv_id", "place", "role", "text", "edit"])


def repair_conversations(df: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", absent: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation.

    Rows are taken by turn, nulls first, rows of one turn by role and then by a hash of role and text. Each row's first fault counts:
    blank (only white space), duplicate (role and text seen earlier), truncated (the last character that is not white is none of .!?).
    Edits are Keep, Rerole, Delete and Insert; the audit lists the initials of the cheapest ones, of equally cheap ones the least. Rows for which
    ``absent`` holds only name their conversation: one without other rows has zeros, an empty audit and the hash of nothing. Null ids
    are one conversation, null roles and texts are one space, an empty role is kept nowhere, repeated rows are duplicates, an empty
    table gives an empty one, and other columns are not read.

    Two passes: the first shuffles what faults and edits depend on, without texts, and plans; the second walks the texts behind their plans and
    hashes them one by one. A conversation of any length takes memory for a hash of each distinct row and its audit alone.
    """
    rows = prepared(df, conv_column, turn_column, role_column, text_column, absent)
    kind = dict(rows.dtypes)["conv_id"]
    return _walk(rows, plans(rows), _Digests, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in FIGURES) + ", audit string, repaired_sha256 string")


def repaired_turns(df: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", absent: Column | None = None) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), role, text and edit (K, R or I) of each turn; otherwise as ``repair_conversations``."""
    rows = prepared(df, conv_column, turn_column, role_column, text_column, absent)
    return _walk(rows, plans(rows), _Turns, f"conv_id {dict(rows.dtypes)['conv_id']}, place long, role string, text string, edit string")


# ---------------------------------------------------------------- the query


def damaged(df: DataFrame) -> DataFrame:
    """The damage that the contract asks for, by crc32('conv_id:turn') % 20: 0 drops a row (it stays with ``dropped``, without a text), 1 empties
    its text, 2 removes its .!?, 3 repeats it, 4 makes it a user's."""
    def plain(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    rows = df.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), (F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20).alias("damage"))
    text = F.when(F.col("damage") <= 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("damage") == 0).alias("dropped"), F.explode(copies).alias("copy")).drop("copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), absent=F.col("dropped"))
