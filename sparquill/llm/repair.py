"""Repair of conversations: the cheapest edits that give a turn structure, found by A* on the edit lattice.

A node of the lattice is (rows worked off, state), the state being what the repaired conversation ends with: nothing, a system
row, a user's or an assistant's. Keep, rerole and delete work off a row, insert does not. The heuristic is a suffix sum: 4 for
each row to come that must be deleted, 3 for each truncated one (the charge if it stays, less than a deletion), so it never
exceeds what is still to pay and never falls by more than a step costs. Nodes are taken by (cost plus heuristic, audit):
each is settled with its least cost and, of equal ones, the ASCII-least row of edit initials.

Long conversations are cut into blocks of at most BLOCK rows and searched in parallel: a block's search goes from each state that
it may begin in to each that it may end in. The blocks of a conversation are then chained by cost in one pass over four
numbers a block. Ties need no audits there: of two different audits that have worked off the same rows neither begins
the other (an insertion belongs to the row after it), so the order of what came before decides.

No task holds a conversation: rows are sorted by a range partitioning, so that one with a third of all rows is spread; rows that
came earlier are found by an aggregation and a join on a written table; the chain and the hash run through a conversation's
blocks and lines in order and keep a few bytes a block (a hash is sequential, so one task reads the lines of a conversation).

Defined cases: a null role or text counts as one space, a null conv_id is a conversation; rows of one turn follow role, then the
md5 of their text; repeated rows are duplicates; empty and blank texts are blank; texts of any length are only read by the
JVM and streamed; an empty table gives no row; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import types

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fence, stash, table, tidy

#: Rows of a block are those of one conversation in 2**BLOCK_BITS places in a row.
BLOCK_BITS = 9
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
#: States: what the repaired rows end with. In OPEN a user's row may follow.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)


def step(state: int, code: str):
    """(initial, cost, state) of the ways to work off a row. code: the role's initial or x, upper case if truncated, or `.` if
    the row must go."""
    yield "D", DELETE, state
    if code == ".":
        return
    charge, role = TRUNCATED if code.isupper() else 0, code.lower()
    if role == "s" and state == NOTHING:
        yield "K", charge, SYSTEM
    following = ASSISTANT if state == USER else USER
    if role == ("a" if state == USER else "u"):
        yield "K", charge, following
    else:
        yield "R", REROLE + charge, following


def search(codes: str, state: int) -> list:
    """(cost, audit) of the cheapest edits that work off all rows from a state, for each state that they may end in, or None."""
    from heapq import heappop, heappush

    n = len(codes)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if codes[i] == "." else TRUNCATED if codes[i].isupper() else 0)
    found: list = [None] * 4
    settled, queue = set(), [(ahead[0], "", 0, state)]
    while queue:
        most, audit, i, state = heappop(queue)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        cost = most - ahead[i]
        if i == n:
            found[state] = (cost, audit)
            continue
        for initial, price, to in step(state, codes[i]):
            if (i + 1, to) not in settled:
                heappush(queue, (cost + price + ahead[i + 1], audit + initial, i + 1, to))
        to = ASSISTANT if state == USER else USER
        if (i, to) not in settled:
            heappush(queue, (most + INSERT, audit + "I", i, to))
    return found


def replay(codes: str, audit: str, state: int):
    """(inserted, role) for each row: the roles inserted before it; its new role, "" for its own, None if it goes."""
    out, inserted, i = [], [], 0
    for initial in audit:
        to = ASSISTANT if state == USER else USER
        if initial == "I":
            inserted.append("assistant" if to == ASSISTANT else "user")
            state = to
            continue
        role = None
        if initial == "R":
            role, state = ("assistant" if to == ASSISTANT else "user"), to
        elif initial == "K":
            role, state = "", SYSTEM if codes[i].lower() == "s" else to
        out.append((inserted, role))
        inserted, i = [], i + 1
    return out


#: What has to be inserted at the end, by the state.
ENDS = {NOTHING: [], SYSTEM: ["user", "assistant"], USER: ["assistant"], ASSISTANT: []}


def _searches():
    """Arrow UDF: codes of a block -> costs and audits by (state at its start) * 4 + (state at its end)."""

    @F.arrow_udf("struct<costs:array<int>,audits:array<string>>")
    def run(column):
        from functools import lru_cache

        import pyarrow as pa

        @lru_cache(maxsize=20_000)
        def all_ways(codes: str):
            ways = [w for state in range(4) for w in search(codes, state)]
            return {"costs": [w and w[0] for w in ways], "audits": [w and w[1] for w in ways]}

        kind = pa.struct([("costs", pa.list_(pa.int32())), ("audits", pa.list_(pa.string()))])
        return pa.array([all_ways(c) for c in column.to_pylist()], kind)

    return run


def _replays():
    """Arrow UDF: (codes, audit, state) -> per row the roles inserted before it and its role."""

    @F.arrow_udf("array<struct<inserted:array<string>,role:string>>")
    def run(codes, audits, states):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("inserted", pa.list_(pa.string())), ("role", pa.string())]))
        rows = zip(codes.to_pylist(), audits.to_pylist(), states.to_pylist())
        return pa.array([[{"inserted": i, "role": r} for i, r in replay(*row)] for row in rows], kind)

    return run


def _null_safe(a: str, b: str, *names: str) -> Column:
    return F.expr(" and ".join(f"{a}.{n} <=> {b}.{n}" for n in names))


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Written rows with `at`, which grows by (conv_id, turn, role, md5 of the text); ties are equal rows."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    core = F.rtrim(text, F.lit(BLANKS))
    facts = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.md5(text).alias("mark"),
        (core == "").alias("blank"), F.substring(core, -1, 1).isin(".", "!", "?").alias("ended"), F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "mark", "tie"]
    placed = facts.repartitionByRange(*order).sortWithinPartitions(*order)
    return stash(placed.drop("tie").withColumn("at", F.monotonically_increasing_id()))


def _blocks(rows: DataFrame, bits: int) -> DataFrame:
    """A written row for each block: its rows in order, their codes, counts, edges, and the searches' results."""
    placed = _sorted_rows(rows)
    slim = placed.select("conv_id", "role", "mark", "at")
    again = stash(slim.groupBy("conv_id", "role", "mark").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = slim.alias("s").join(again.alias("a"), _null_safe("s", "a", "conv_id", "role", "mark")).where("s.at > a.first").select("s.conv_id", "s.at")
    row = F.struct("at", "turn", "role", "text", "blank", "ended")
    block = F.shiftright("at", bits).alias("block")
    both = placed.select("conv_id", block, row.alias("row"), F.lit(None).cast("long").alias("again")).union(
        later.select("conv_id", block, F.lit(None).cast(placed.select(row.alias("r")).schema["r"].dataType), F.col("at"))
    )
    whole = both.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.collect_list("again").alias("again"))

    initial = lambda r: F.substring(r["role"], 1, 1)
    fault = lambda r: F.when(r["blank"], "b").when(F.array_contains("again", r["at"]), "d").when(~r["ended"], "t").otherwise("")
    known = F.transform("rows", lambda r: F.struct(initial(r).alias("i"), fault(r).alias("f"), r["turn"].alias("turn")))
    letter = lambda k: F.when(k["i"].isin("s", "u", "a"), k["i"]).otherwise("x")
    code = lambda k: F.when(k["f"].isin("b", "d"), ".").when(k["f"] == "t", F.upper(letter(k))).otherwise(letter(k))
    pairs = F.transform("known", lambda k, i: F.concat(k["i"], F.get(F.col("known")["i"], i + 1)))
    turns = F.filter(F.col("known")["turn"], lambda t: t.isNotNull())
    count = lambda f: F.size(F.filter("known", lambda k: k["f"] == f))
    facts = fence(whole.withColumn("known", known)).select(
        "conv_id", "block", "rows", F.array_join(F.transform("known", code), "").alias("codes"), count("b").alias("blank"), count("d").alias("duplicate"),
        count("t").alias("truncated"), F.size(F.filter(pairs, lambda p: p.isNotNull() & ~p.isin("su", "ua", "au"))).alias("illegal"),
        F.get(F.col("known")["i"], F.lit(0)).alias("first_initial"), F.element_at("known", -1)["i"].alias("last_initial"),
        F.array_min(turns).alias("first_turn"), F.array_max(turns).alias("last_turn"), F.size(F.array_distinct(turns)).alias("turns"),
    )
    return stash(facts.withColumn("ways", _searches()("codes")))


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_FACTS = ("block", *_COUNTS, "first_initial", "last_initial", "first_turn", "last_turn", "turns", "costs", "audits")
_CHAIN = "block long, state int, way int, tail int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


class _Chain:
    """The blocks of one conversation in order: for each state the cheapest cost, its place in the order of audits, and the way."""

    def __init__(self):
        self.costs, self.places = {NOTHING: 0}, {NOTHING: 0}
        self.blocks, self.ways = [], []
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.initial = self.low = self.high = None
        self.turns = 0

    def add(self, b: dict) -> None:
        best: dict = {}
        for state, cost in self.costs.items():
            for to in range(4):
                if (more := b["costs"][state * 4 + to]) is not None:
                    way = (cost + more, self.places[state], b["audits"][state * 4 + to], state)
                    best[to] = min(best[to], way) if to in best else way
        self.costs = {to: w[0] for to, w in best.items()}
        in_order = sorted(best, key=lambda to: best[to][1:3])
        self.places = {to: place for place, to in enumerate(in_order)}
        self.blocks.append(b["block"])
        self.ways.append(bytes(best[to][3] if to in best else 9 for to in range(4)))
        for c in _COUNTS:
            self.counts[c] += b[c]
        if self.initial is not None and self.initial + b["first_initial"] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = b["last_initial"]
        if b["turns"]:
            self.turns += b["turns"] - (self.high == b["first_turn"])
            self.low = b["first_turn"] if self.low is None else self.low
            self.high = b["last_turn"]

    def rows(self):
        """A row of _CHAIN for each block; the last has the conversation's totals."""
        end = min(self.costs, key=lambda s: (self.costs[s] + INSERT * len(ENDS[s]), self.places[s]))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        tail, cost, state, out = end, self.costs[end] + INSERT * len(ENDS[end]), end, []
        for block, ways in zip(reversed(self.blocks), reversed(self.ways)):
            totals = (tail, gaps, *self.counts.values(), cost) if not out else (None,) * 7
            out.append((block, ways[state], ways[state] * 4 + state, *totals))
            state = ways[state]
        return reversed(out)


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    """All rows of a conversation in one partition, in order, to be streamed."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _chained(blocks: DataFrame) -> DataFrame:
    """(conv_id, *_CHAIN): how each block is entered and left in the cheapest repair of its conversation."""
    conv = blocks.schema["conv_id"]
    schema = T.StructType([conv, *T._parse_datatype_string(_CHAIN).fields])

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([("block", pa.int64()), ("state", pa.int32()), ("way", pa.int32()), ("tail", pa.int32()), *[(c, pa.int64()) for c in ("gaps", *_COUNTS, "cost")]])
        chain, now, kind = None, None, None

        def rows(key, chained):
            done = list(chained.rows())
            for at in range(0, len(done), 10_000):
                part = done[at : at + 10_000]
                columns = [pa.array([key] * len(part), kind), *[pa.array(c, f.type) for c, f in zip(zip(*part), kinds)]]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", *kinds.names])

        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, 1000):
                for r in batch.slice(at, 1000).to_pylist():
                    if chain is None or r["conv_id"] != now:
                        if chain is not None:
                            yield from rows(now, chain)
                        chain, now = _Chain(), r["conv_id"]
                    chain.add(r)
        if chain is not None:
            yield from rows(now, chain)

    facts = blocks.select("conv_id", *[c for c in _FACTS if c not in ("costs", "audits")], "ways.costs", "ways.audits")
    return _in_order(facts, "block").mapInArrow(run, schema)


def _lines(rows: DataFrame, bits: int) -> DataFrame:
    """(conv_id, block, pos, role, text, audit, and on a conversation's last line _CHAIN's totals): the repaired rows in order of
    block and pos. A block without any has one with a null role."""
    blocks = _blocks(rows, bits)
    chain = stash(_chained(blocks)).alias("c")
    both = blocks.alias("b").join(chain, _null_safe("b", "c", "conv_id", "block"))
    both = both.select("b.*", F.expr("ways.audits[way]").alias("audit"), *[f"c.{c}" for c in ("state", "tail", "gaps", "cost")], *[F.col(f"c.{c}").alias(f"all_{c}") for c in _COUNTS])
    both = both.drop(*_COUNTS).withColumn("edits", _replays()("codes", "audit", "state"))
    fresh = lambda role: F.struct(role.alias("role"), F.lit("").alias("text"))

    def one(r, e):
        own = F.struct(F.when(e["role"] == "", r["role"]).otherwise(e["role"]).alias("role"), r["text"].alias("text"))
        return F.concat(F.transform(e["inserted"], fresh), F.when(e["role"].isNull(), F.slice(F.array(own), 1, 0)).otherwise(F.array(own)))

    ends = F.element_at(F.create_map(*[x for s, roles in ENDS.items() for x in (F.lit(s), F.array(*map(F.lit, roles)).cast("array<string>"))]), F.coalesce("tail", F.lit(NOTHING)))
    out = F.concat(F.flatten(F.zip_with("rows", "edits", one)), F.transform(ends, fresh))
    first = F.coalesce("pos", F.lit(0)) == 0
    totals = ("tail", "gaps", "cost", *[f"all_{c}" for c in _COUNTS])
    lines = both.select("conv_id", "block", "audit", *totals, F.posexplode_outer(out).alias("pos", "line"))
    return lines.select("conv_id", "block", F.coalesce("pos", F.lit(0)).alias("pos"), "line.role", "line.text", F.when(first, F.col("audit")).alias("audit"), *[F.when(first, F.col(c)).alias(c) for c in totals])


@tidy
def repaired(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(conv_id, block, pos, role, text): the repaired conversations; their rows follow (block, pos)."""
    return _lines(rows, bits).where("role is not null").select("conv_id", "block", "pos", "role", "text")


@tidy
def report(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of rows."""
    lines = _lines(rows, bits).withColumnRenamed("tail", "last")
    conv = lines.schema["conv_id"]
    names = ("gaps", *_COUNTS, "cost")
    schema = T.StructType([conv, *T._parse_datatype_string(", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string").fields])
    line = F.concat("role", F.lit(":"), "text")
    lines = lines.select("conv_id", "block", "pos", line.alias("line"), "audit", "last", "gaps", *[F.col(f"all_{c}").alias(c) for c in _COUNTS], "cost")

    def run(batches):
        import hashlib

        import pyarrow as pa

        done, kind = [], None

        def frame():
            columns = [pa.array(c, kind if i == 0 else pa.string() if i > len(names) else pa.int64()) for i, c in enumerate(zip(*done))]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", *names, "audit", "repaired_sha256"])

        now = None
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, 1000):
                for r in batch.slice(at, 1000).to_pylist():
                    if now is None or r["conv_id"] != now.key:
                        if now is not None:
                            done.append(now.row())
                            if len(done) == 10_000:
                                yield frame()
                        now = _digest(r["conv_id"], hashlib.sha256())
                    now.add(r)
        if now is not None:
            done.append(now.row())
        if done:
            yield frame()

    return _in_order(lines, "block", "pos").mapInArrow(run, schema)


def _digest(key, sha) -> types.SimpleNamespace:
    """Takes the lines of one conversation in order and gives its row of the report."""
    held = types.SimpleNamespace(key=key, audits=[], totals=None, empty=True)

    def add(r: dict) -> None:
        if r["audit"] is not None:
            held.audits.append(r["audit"])
        if r["last"] is not None:
            held.audits.append("I" * len(ENDS[r["last"]]))
            held.totals = [r[n] for n in ("gaps", *_COUNTS, "cost")]
        if r["line"] is not None:
            sha.update(r["line"].encode() if held.empty else b"\n" + r["line"].encode())
            held.empty = False

    held.add = add
    held.row = lambda: (key, *held.totals, "".join(held.audits), sha.hexdigest())
    return held


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in, by crc32(`conv_id:turn`) mod 20: 0 drops a row, 1 empties its text, 2 takes its full
    stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    rows = conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times")
    )
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def op13_repair(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = report(damaged(conversations)).alias("r")
    every = conversations.select("conv_id").distinct().alias("e")
    counts = [F.coalesce(f"r.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS, "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.join(found, _null_safe("e", "r", "conv_id"), "left").select(
        "e.conv_id", *counts, F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("r.repaired_sha256", nothing).alias("repaired_sha256")
    )
