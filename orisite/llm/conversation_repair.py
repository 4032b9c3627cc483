"""Repair of role structure in conversations: the cheapest edits, found by a persistent audit DP.

Each turn's first fault counts: *blank* (no visible character), *duplicate* (role and text seen
earlier in the conversation), *truncated* (the last visible character is none of ``.!?``).  Edits are
Keep (0), Rerole to user or assistant (3), Delete (4, the only one for blank and duplicate turns) and
Insert of an empty user or assistant turn anywhere (3); a truncated turn that stays adds 3.  The
initials of the repaired roles must read ``(s?(ua)+)?``.  Of the cheapest edits those win whose
initials, in order, are ASCII-least: the *audit*.

Method.  A state is what the roles so far allow next: nothing yet, after the system turn, after a
user turn, after an assistant turn.  The DP goes through the turns and keeps for each state the
cheapest edits as a node of a shared tree of edit prefixes (``Prefixes``): a node adds one edit to
its parent, and holds ancestors at distances 1, 2, 4, ... and a rolling hash of its whole prefix.
Equal costs are settled by the longest common prefix, searched downwards over the ancestors'
hashes; what the hashes call equal is then compared edit by edit.

No task holds a conversation.  Turns are sorted in ranges of (conversation, turn), so a long
conversation lies in several partitions, and each stretch of it is cut into blocks of ``BLOCK``
turns.  The DP runs over a block from each state that it may begin in.  Block audits end in the edit
of a turn (Inserts go before the next turn), hence of two audits of a block that begin in one state
neither begins the other, and their order settles that of everything after.  So blocks, and then the
stretches of a conversation, are joined by their costs and by the *ranks* of their audits alone.
A stretch is a row for each partition at most.  Repaired turns meet their texts in a join on a
unique number.  An audit, and a digest over a repaired conversation, are single values and so are
put together by one task each, as a stream.

Defined results: turns are ordered by turn (nulls first), then role, then a hash of role and text,
so repeated rows are adjacent; a null role or text counts as one space; rows with a null
conversation are one conversation; a role is known by its first character, s, u or a, others
(an empty role too) are never kept.  An empty table gives empty results.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from orisite.llm.common import bounded_batches, checkpointed

BLANKS = " \t\n\x0b\x0c\r"
#: Turns that one run of the DP takes; its tree of prefixes is let go of at the end.
BLOCK = 1024
BATCH_ROWS = 4096
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# A turn's code: class of its role, and marks.
SYSTEM, USER, ASSISTANT, OTHER, IS_TRUNCATED, IS_BLANK, IS_DUPLICATE = 0, 1, 2, 3, 4, 8, 16
GONE = IS_BLANK | IS_DUPLICATE
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
# States: nothing yet, after system, after user, after assistant.
EMPTY, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
#: The role that follows a state, and the state that it leads to.
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: Inserts that end a conversation in a state.
TAIL = (0, 2, 1, 0)


class Prefixes:
    """Edit prefixes as nodes of a tree.  Node 0 is the empty prefix."""

    MODULUS, BASE = (1 << 61) - 1, 1_000_003

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, parent: int, letter: str) -> int:
        up = [parent]  # ancestors at distances 1, 2, 4, ...
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * self.BASE + ord(letter)) % self.MODULUS)
        self.up.append(tuple(up))
        return len(self.letter) - 1

    def lift(self, node: int, depth: int) -> int:
        """The ancestor of ``node`` at ``depth``."""
        far = self.depth[node] - depth
        while far:
            k = far.bit_length() - 1
            node, far = self.up[node][k], far - (1 << k)
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def first_difference(self, a: int, b: int) -> tuple[int, int] | None:
        """The nodes, of equal depth, at which the two prefixes first differ; None if one begins the other."""
        depth = min(self.depth[a], self.depth[b])
        a, b = self.lift(a, depth), self.lift(b, depth)
        found = None
        if self.hash[a] != self.hash[b]:
            for k in reversed(range(len(self.up[a]))):
                if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                    a, b = self.up[a][k], self.up[b][k]
            found = a, b
            a, b = self.up[a][0], self.up[b][0]
        while a != b:  # equal by their hashes: verified down to the node that they share
            if self.letter[a] != self.letter[b]:
                found = a, b
            a, b = self.up[a][0], self.up[b][0]
        return found

    def less(self, a: int, b: int) -> bool:
        differ = self.first_difference(a, b)
        if differ is None:
            return self.depth[a] < self.depth[b]
        return self.letter[differ[0]] < self.letter[differ[1]]


Ways = dict  # state -> (cost, node)


def _offer(tree: Prefixes, ways: Ways, state: int, cost: int, parent: int, letter: str) -> None:
    held = ways.get(state)
    if held is None or cost < held[0]:
        ways[state] = cost, tree.add(parent, letter)
    elif cost == held[0]:
        node = tree.add(parent, letter)
        if tree.less(node, held[1]):
            ways[state] = cost, node


def step(tree: Prefixes, ways: Ways, code: int) -> Ways:
    """The cheapest edits for each state after one more turn."""
    out: Ways = {}
    for state, (cost, node) in ways.items():
        _offer(tree, out, state, cost + DELETE, node, "D")
    if code & GONE:
        return out
    before = dict(ways)
    for _ in range(2):  # more Inserts only lead back
        for state, (cost, node) in list(before.items()):
            _offer(tree, before, NEXT_STATE[state], cost + INSERT, node, "I")
    role, extra = code & 3, TRUNCATED if code & IS_TRUNCATED else 0
    for state, (cost, node) in before.items():
        to = NEXT_STATE[state]
        if role == SYSTEM and state == EMPTY:
            _offer(tree, out, AFTER_S, cost + extra, node, "K")
        elif role == (USER if to == AFTER_U else ASSISTANT):
            _offer(tree, out, to, cost + extra, node, "K")
        _offer(tree, out, to, cost + REROLE + extra, node, "R")
    return out


def transfer(codes: bytes, begin: int) -> dict[int, tuple[int, str]]:
    """state -> (cost, audit) over a block that begins in the state ``begin``."""
    tree = Prefixes()
    ways: Ways = {begin: (0, 0)}
    for code in codes:
        ways = step(tree, ways, code)
    return {state: (cost, tree.text(node)) for state, (cost, node) in ways.items()}


def ranked(ends: dict[int, tuple[int, str]]) -> dict[int, tuple[int, int]]:
    order = sorted(ends, key=lambda s: ends[s][1])
    return {s: (ends[s][0], order.index(s)) for s in ends}


def extend(ways: dict, stretch: dict[int, dict[int, tuple[int, int]]]) -> dict:
    """Join what came before, state -> (cost, rank, path), with a stretch, begin -> end -> (cost, rank).
    A path is (path before, (begin, end))."""
    best: dict = {}
    for begin, (cost, rank, path) in ways.items():
        for end, (more, order) in stretch[begin].items():
            # of equal costs the least audit so far; two ways to begin never have the same one
            key = (cost + more, rank, order)
            if end not in best or key < best[end][0]:
                best[end] = key, (path, (begin, end))
    ranks = sorted(best, key=lambda s: best[s][0][1:])
    return {s: (key[0], ranks.index(s), path) for s, (key, path) in best.items()}


def finish(ways: dict) -> tuple[int, int]:
    """(cost, state) of the best way to end a conversation."""
    cost, _, state = min((c + TAIL[s] * INSERT, rank, s) for s, (c, rank, *_) in ways.items())
    return cost, state


def steps_of(path) -> list[tuple[int, int]]:
    out = []
    while path:
        path, pair = path
        out.append(pair)
    return out[::-1]


class Stretch:
    """One conversation's turns in one partition, added in order."""

    def __init__(self, begins: range | list[int]):
        self.begins = begins
        self.codes, self.rows = bytearray(), []
        self.low = self.high = None
        self.turns = self.illegal = 0

    def add(self, row: int, turn: int | None, code: int) -> None:
        if self.codes and (self.codes[-1] & 3, code & 3) not in LEGAL:
            self.illegal += 1
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.codes.append(code)
        self.rows.append(row)

    def ends(self) -> dict[int, dict[int, tuple[int, int, str]]]:
        """begin -> end -> (cost, rank, audit)."""
        ways = {b: {b: (0, 0, None)} for b in self.begins}
        blocks = []
        for at in range(0, len(self.codes), BLOCK):
            begins = sorted({s for w in ways.values() for s in w})
            found = {b: transfer(bytes(self.codes[at: at + BLOCK]), b) for b in begins}
            blocks.append(found)
            ranks = {b: ranked(f) for b, f in found.items()}
            ways = {b: extend(w, ranks) for b, w in ways.items()}
        return {b: {end: (cost, rank, "".join(blocks[i][x][y][1] for i, (x, y) in enumerate(steps_of(path))))
                    for end, (cost, rank, path) in w.items()} for b, w in ways.items()}

    def counts(self) -> dict:
        c = self.codes
        return {"blank": sum(1 for x in c if x & IS_BLANK), "duplicate": sum(1 for x in c if x & IS_DUPLICATE),
                "truncated": sum(1 for x in c if x & IS_TRUNCATED), "illegal": self.illegal}


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: What is known of a stretch.  One that touches a border of its partition may go on in the next, and
#: has all its ways; the others are whole conversations and have their audit.
STRETCH_SQL = ("pid int, no int, border boolean, low bigint, high bigint, turns bigint, first int, last int, codes binary, "
               "`rows` array<bigint>, audit string, tail int, "
               "ways array<struct<begin: int, end: int, cost: bigint, rank: int, audit: string>>, "
               + ", ".join(f"{t} bigint" for t in TOTALS))
CHOICE_SQL = "pid int, no int, begin int, end int, tail int, " + ", ".join(f"{t} bigint" for t in TOTALS)
CHOICE = pa.schema([*((k, pa.int32()) for k in ("pid", "no", "begin", "end", "tail")), *((t, pa.int64()) for t in TOTALS)])


def _described(conv, pid: int, no: int, border: bool, s: Stretch) -> dict:
    ends = s.ends()
    out = {"conv": conv, "pid": pid, "no": no, "border": border, "low": s.low, "high": s.high, "turns": s.turns,
           "first": s.codes[0] & 3, "last": s.codes[-1] & 3, "codes": bytes(s.codes), "rows": s.rows, **s.counts()}
    if border:
        ways = [{"begin": b, "end": e, "cost": cost, "rank": rank, "audit": audit}
                for b, w in ends.items() for e, (cost, rank, audit) in w.items()]
        return out | {"ways": ways, "gaps": 0, "cost": 0}
    cost, end = finish(ends[EMPTY])
    return out | {"audit": ends[EMPTY][end][2] + "I" * TAIL[end], "tail": TAIL[end], "cost": cost, "gaps": gaps(s.low, s.high, s.turns)}


def _batches(rows: Iterator[dict], schema: pa.Schema, size: Callable[[dict], int] = lambda r: 1,
             most: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += size(r)
        if n >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def stretches(turns: DataFrame) -> DataFrame:
    """The stretches of (conv, pid, row, turn, code), whose partitions are sorted."""
    out = to_arrow_schema(StructType([turns.schema["conv"], *StructType.fromDDL(STRETCH_SQL)]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            s, conv, pid, no = None, None, None, 0
            for b in batches:
                for r in b.to_pylist():
                    if s is None or r["conv"] != conv:
                        if s is not None:
                            yield _described(conv, pid, no, no == 0, s)
                            no += 1
                        conv, pid, s = r["conv"], r["pid"], Stretch(STATES if s is None else [EMPTY])
                    s.add(r["row"], r["turn"], r["code"])
            if s is not None:
                yield _described(conv, pid, no, True, s)

        return _batches(each(), out, lambda r: 20 + len(r["rows"]), 1 << 16)

    return turns.mapInArrow(scan, StructType([turns.schema["conv"], *StructType.fromDDL(STRETCH_SQL)]))


def choose(t: pa.Table) -> pa.Table:
    """For one conversation's border stretches (a row for each partition at most): how each begins and
    ends, and on the first one the conversation's totals."""
    rows = sorted(t.to_pylist(), key=lambda r: (r["pid"], r["no"]))
    ways: dict = {EMPTY: (0, 0, None)}
    low = high = last = None
    turns, total = 0, dict.fromkeys(TOTALS, 0)
    for r in rows:
        found: dict = {}
        for w in r["ways"]:
            found.setdefault(w["begin"], {})[w["end"]] = (w["cost"], w["rank"])
        ways = extend(ways, found)
        for k in ("blank", "duplicate", "truncated", "illegal"):
            total[k] += r[k]
        total["illegal"] += last is not None and (last, r["first"]) not in LEGAL
        last = r["last"]
        turns += r["turns"] - (r["low"] is not None and r["low"] == high)
        low, high = r["low"] if low is None else low, high if r["high"] is None else r["high"]
    total["gaps"] = gaps(low, high, turns)
    total["cost"], end = finish(ways)
    out = [{"pid": r["pid"], "no": r["no"], "begin": b, "end": e, "tail": 0, **dict.fromkeys(TOTALS, 0)}
           for r, (b, e) in zip(rows, steps_of(ways[end][2]))]
    out[0] |= total
    out[-1]["tail"] = TAIL[end]
    return pa.Table.from_pylist(out, CHOICE)


def repaired_turns(codes: bytes, rows: list[int], begin: int, audit: str) -> Iterator[tuple[int | None, str | None]]:
    """(row, role) of each repaired turn: no row for an inserted one, no role for one that keeps its own."""
    state, at = begin, 0
    for edit in audit:
        if edit == "I":
            yield None, NEXT_ROLE[state]
            state = NEXT_STATE[state]
            continue
        if edit == "R":
            yield rows[at], NEXT_ROLE[state]
            state = NEXT_STATE[state]
        elif edit == "K":
            yield rows[at], None
            state = AFTER_S if codes[at] & 3 == SYSTEM else NEXT_STATE[state]
        at += 1


def _lines(pieces: DataFrame) -> DataFrame:
    schema = StructType([pieces.schema["conv"], *StructType.fromDDL("pid int, no int, place bigint, row bigint, role string")])
    arrow = to_arrow_schema(schema)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for b in batches:
                for r in b.to_pylist():
                    for place, (row, role) in enumerate(repaired_turns(r["codes"], r["rows"], r["begin"], r["audit"])):
                        yield {"conv": r["conv"], "pid": r["pid"], "no": r["no"], "place": place, "row": row, "role": role}

        return _batches(each(), arrow)

    return pieces.select("conv", "pid", "no", "codes", "rows", "begin", "audit").mapInArrow(expand, schema)


def coded_turns(rows: DataFrame) -> DataFrame:
    """(conv, pid, row, turn, code) in order, from (conv, turn, role, text, row): written, sorted, in
    ranges of (conv, turn).  A code holds the class of the role and the first fault."""
    visible = F.rtrim("text", F.lit(BLANKS))
    first = F.substring("role", 1, 1)
    slim = rows.select(
        "conv", "turn", "role", "row", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"),
        F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER).alias("class"),
        (visible == "").alias("blank"), (~F.right(visible, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    seen = slim.groupBy("conv", "same").agg(F.min(F.struct("turn", "row")).alias("first"))  # nulls sort first
    new = seen.select(F.col("first.row").alias("row"), F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), IS_BLANK).when(F.col("new").isNull(), IS_DUPLICATE).when(F.col("truncated"), IS_TRUNCATED).otherwise(0)
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("same"), F.asc("row")]
    coded = slim.join(new, "row", "left").select("conv", "turn", "role", "same", "row", (F.col("class") + fault).alias("code"))
    ranged = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpointed(ranged.select("conv", F.spark_partition_id().alias("pid"), "row", "turn", "code"))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(audits, repaired).  Audits: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, one row
    for each conversation.  Repaired: conv, pid, no, place, role, text, the turns of the repaired
    conversations; (pid, no, place) orders those of one."""
    def col(c: str):
        return F.col(f"`{c}`")

    rows = checkpointed(bounded_batches(turns).select(
        col(conv_col).alias("conv"), col(turn_col).cast("long").alias("turn"), F.coalesce(col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(col(text_col), F.lit(" ")).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    found = checkpointed(stretches(coded_turns(rows)))
    border, whole = found.where("border"), found.where("not border")
    slim_ways = F.transform("ways", lambda w: w.dropFields("audit")).alias("ways")
    chosen = (border.select("conv", "pid", "no", "low", "high", "turns", "first", "last", "blank", "duplicate", "truncated", "illegal",
                            slim_ways).groupBy("conv").applyInArrow(choose, CHOICE_SQL))
    way = F.filter("ways", lambda w: (w["begin"] == F.col("begin")) & (w["end"] == F.col("end")))[0]["audit"]
    joined = (border.select("conv", "pid", "no", "codes", "rows", "ways").join(chosen, ["pid", "no"])
              .withColumn("audit", F.concat(way, F.repeat(F.lit("I"), F.col("tail")))))
    columns = ["conv", "pid", "no", "codes", "rows", "begin", "audit", *TOTALS]
    joined = checkpointed(joined.select(*columns))
    whole = whole.withColumn("begin", F.lit(EMPTY))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pid", "no", "audit"))), lambda p: p["audit"]), "")
    audits = whole.select("conv", *TOTALS, "audit").unionByName(
        joined.groupBy("conv").agg(*(F.sum(t).alias(t) for t in TOTALS), text.alias("audit")))
    lines = _lines(whole.select(*columns).unionByName(joined))
    own = rows.select("row", F.col("role").alias("own"), "text")
    kept = lines.join(own, "row").select("conv", "pid", "no", "place", F.coalesce("role", "own").alias("role"), "text")
    new = lines.where("row is null").select("conv", "pid", "no", "place", "role", F.lit("").alias("text"))
    return audits, kept.unionByName(new)


def line_digests(lines: DataFrame) -> DataFrame:
    """(conv, sha256) of ``role:text`` of each conversation's turns, newline-joined: read as a stream,
    since a hash takes its bytes in order; memory holds one batch."""
    schema = StructType([lines.schema["conv"], StructField("sha256", StringType())])
    arrow = to_arrow_schema(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            conv, h = None, None
            for b in batches:
                for c, line in zip(b.column("conv").to_pylist(), b.column("line").to_pylist()):
                    if h is None or c != conv:
                        if h is not None:
                            yield {"conv": conv, "sha256": h.hexdigest()}
                        conv, h = c, hashlib.sha256()
                    else:
                        h.update(b"\n")
                    h.update(line.encode())
            if h is not None:
                yield {"conv": conv, "sha256": h.hexdigest()}

        return _batches(each(), arrow)

    in_order = lines.repartition("conv").sortWithinPartitions("conv", "pid", "no", "place")
    return in_order.select("conv", F.concat("role", F.lit(":"), "text").alias("line")).mapInArrow(digest, schema)


def damage(turns: DataFrame, kind: Column, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``turns`` with the fault that ``kind`` gives each: 0 drops it, 1 empties its text, 2 takes out
    ``.!?``, 3 repeats it, 4 makes its role user; others stay.  A null role or text becomes a space."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in (role_col, text_col))
    out = turns.withColumns({"__kind": kind, role_col: role, text_col: text}).where("__kind is null or __kind <> 0")
    k = F.col("__kind")
    out = out.withColumns({
        text_col: F.when(k == 1, "").when(k == 2, F.translate(F.col(f"`{text_col}`"), ".!?", "")).otherwise(F.col(f"`{text_col}`")),
        role_col: F.when(k == 4, "user").otherwise(F.col(f"`{role_col}`")),
        "__copy": F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))})
    return out.drop("__kind", "__copy")
