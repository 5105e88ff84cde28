"""Conversation structure repair: the cheapest edits that give every conversation the roles `(s?(ua)+)?`.

Rows of a conversation are taken by turn (nulls first), rows of one turn by role and text. Each row is kept (cost 0),
reroled (1), deleted (2, and required if blank or a duplicate), and empty rows may be inserted (5); a truncated row that
isn't deleted adds 5. Four states tell what stands last: nothing, a system row, a user row, an assistant row. Edits are
written as initials; of all cheapest edits the ASCII-least ones are taken.

Hirschberg's divide and conquer finds them in linear space: the least costs from the start to the middle row and from
there to the end meet in one of the four states. Inserted rows belong to the row that follows them, so that edits up to
the middle end with the middle row's own and none is the beginning of another; hence of the crossings with the least
cost the one with the ASCII-least edits before it is right, whatever follows. Ranks of the states by their least edits
are carried along with the costs, so no edits are kept while costs are searched.

Spark deals conversations by conv_id, sorted, and each goes through a task with its own rows alone in memory. A
conversation of more than `LONG` rows or `LONG_BYTES` bytes is dealt by ranges of its rows instead: tasks give each range's costs from every state
to every state, ranges are chained, which fixes the states between them, and each range finds its edits by itself. Only
the digest of such a conversation's repaired rows, which can't be split, goes through them in one task, row by row.

Null roles and texts are one space; a null conv_id is a conversation of its own. Repeated rows are duplicates. No
rows after damage: zeros, no edits and the digest of nothing. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelaudit.llm.common import partitions, stored, tune

#: Rows and bytes of text of a conversation beyond which it is dealt by ranges of its rows.
LONG, LONG_BYTES = 20_000, 64 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEVER = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"

#: What may be written next in each state, and where it leads.
NEXT = (USER, USER, ASSISTANT, USER)
NEXT_ROLE = ("user", "user", "assistant", "user")
#: The costs and edits that end a conversation in each state.
ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def row_code(initial: str, deleted: bool, truncated: bool) -> int:
    """All that decides about a row's edits: its role's initial, and whether it must go or lacks its end."""
    return "sua".find(initial or "-") + 1 + 4 * deleted + 8 * (truncated and not deleted)


def _moves(code: int) -> list[list[tuple[int, int, str]]]:
    """For each state after a row with that code: states before it, costs and edits, the best one of each pair of states."""
    role, deleted, extra = code % 4, code // 4 % 2, TRUNCATED * (code // 8)
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(before: int, after: int, cost: int, edits: str) -> None:
        best[before, after] = min(best.get((before, after), (NEVER, "")), (cost, edits))

    for before in STATES:
        inserted = [(before, 0, ""), (NEXT[before], INSERT, "I")] + [(ASSISTANT, 2 * INSERT, "II")] * (before in (START, SYSTEM))
        for now, cost, edits in inserted:
            offer(before, now, cost + DELETE, edits + "D")
            if not deleted:
                offer(before, NEXT[now], cost + REROLE + extra, edits + "R")
                if (role == USER and NEXT[now] == USER) or (role == ASSISTANT and NEXT[now] == ASSISTANT):
                    offer(before, role, cost + KEEP + extra, edits + "K")
                if role == SYSTEM and now == START:
                    offer(before, SYSTEM, cost + KEEP + extra, edits + "K")
    return [[(b, *best[b, after]) for b in STATES if (b, after) in best] for after in STATES]


MOVES = [_moves(code) for code in range(16)]
Vector = tuple[list[int], list[int]]  # cost and rank of each state


def begin(state: int) -> Vector:
    return [0 if s == state else NEVER for s in STATES], [0 if s == state else 1 for s in STATES]


def forward(codes: bytes, vector: Vector) -> Vector:
    """Costs and ranks after some rows."""
    costs, ranks = vector
    for code in codes:
        found = []
        for moves in MOVES[code]:
            at = [(costs[b] + c, ranks[b], edits) for b, c, edits in moves if costs[b] < NEVER]
            found.append(min(at) if at else (NEVER, NEVER, ""))
        costs = [f[0] for f in found]
        order = sorted(STATES, key=lambda s: found[s][1:])
        ranks = [order.index(s) for s in STATES]
    return costs, ranks


def backward(codes: bytes, end: int) -> list[int]:
    """The cost from each state before some rows to one after them."""
    costs = [0 if s == end else NEVER for s in STATES]
    for code in reversed(codes):
        before = [NEVER] * 4
        for after, moves in enumerate(MOVES[code]):
            for b, c, _ in moves:
                before[b] = min(before[b], c + costs[after])
        costs = before
    return costs


def crossing(costs: list[int], ranks: list[int], rest: list[int]) -> int:
    """The state with the least cost on both sides together, of equal ones that with the ASCII-least edits before it."""
    return min(STATES, key=lambda s: (min(costs[s] + rest[s], NEVER), ranks[s]))


def edits_between(codes: bytes, start: int, end: int) -> list[str]:
    """The ASCII-least of the cheapest edits of some rows between two states: for each row its own and the inserts before it."""
    out: list[str] = []
    todo = [(0, len(codes), start, end)]
    while todo:
        low, high, first, last = todo.pop()
        if high - low == 1:
            out.append(next(edits for b, _, edits in MOVES[codes[low]][last] if b == first))
        elif high > low:
            middle = (low + high) // 2
            meet = crossing(*forward(codes[low:middle], begin(first)), backward(codes[middle:high], last))
            todo += [(middle, high, meet, last), (low, middle, first, meet)]  # the first half is taken next
    return out


def cheapest(codes: bytes) -> tuple[int, list[str], str]:
    """Cost and edits of a conversation: those of each row, and those after the last."""
    costs, ranks = forward(codes, begin(START))
    ends = [c for c, _ in ENDS]
    last = crossing(costs, ranks, ends)
    return costs[last] + ends[last], edits_between(codes, START, last), ENDS[last][1]


def repaired(edits: str, role: str, text: str, state: int) -> tuple[list[str], int]:
    """Lines that a row's edits leave, and the state after them."""
    lines = []
    for edit in edits:
        if edit != "D":
            kept = edit == "K"
            lines.append(f"{role if kept else NEXT_ROLE[state]}:{'' if edit == 'I' else text}")
            state = SYSTEM if kept and role[:1] == "s" else NEXT[state]
    return lines, state


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as the contract damages them; a dropped row stays as a mark (gone) without role and text."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    keyed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20).alias("fault"))
    role = F.when(F.col("fault") == 0, "").when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("fault") < 2, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return keyed.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), times.alias("copy")).drop("copy")


def with_ends(rows: DataFrame) -> DataFrame:
    """blank and open (the last character that isn't blank is no `[.!?]`) of each text."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    return rows.withColumns({"blank": last == "", "open": ~last.isin(".", "!", "?")})


OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
OUT_SCHEMA = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
LEGAL = ("su", "ua", "au")
ORDER = ["conv_id", "turn", "role", "text"]  # ascending: nulls first


def conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows of one conv_id; its rows alone are held."""
    held: list[dict] = []
    for rows in batches:
        for row in rows.to_pylist():
            if held and row["conv_id"] != held[0]["conv_id"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def repair_one(rows: list[dict]) -> tuple:
    """The result row of one conversation, its rows in order."""
    conv_id, rows = rows[0]["conv_id"], [r for r in rows if not r["gone"]]
    faults, seen, codes = [0, 0, 0], set(), bytearray()
    for r in rows:
        same = (r["role"], r["text"])
        fault = 0 if r["blank"] else 1 if same in seen else 2 if r["open"] else 3
        seen.add(same)
        if fault < 3:
            faults[fault] += 1
        codes.append(row_code(r["role"][:1], fault < 2, fault == 2))
    turns = {r["turn"] for r in rows} - {None}
    illegal = sum(a["role"][:1] + b["role"][:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    cost, edits, tail = cheapest(bytes(codes))
    lines, state = [], START
    for r, e in zip(rows, edits, strict=True):
        some, state = repaired(e, r["role"], r["text"], state)
        lines += some
    lines += repaired(tail, "", "", state)[0]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return conv_id, gaps, *faults, illegal, cost, "".join(edits) + tail, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def repair_short(rows: DataFrame) -> DataFrame:
    def run(batches):
        for conversation in conversations(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(repair_one(conversation), OUT_SCHEMA, strict=True)], schema=OUT_SCHEMA)

    def joined(batches):
        waiting = []
        for b in run(batches):
            waiting.append(b)
            if len(waiting) == 1000:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting = []
        if waiting:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    return rows.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(joined, OUT)


def with_codes(rows: DataFrame, pieces: int) -> DataFrame:
    """Rows of long conversations in order: part (a range of rows), place in it, turn, role, text, fault and code.

    A duplicate is a row with an earlier equal one: in an earlier turn, by an aggregate over the conversation, or just
    before it, as equal rows of one turn lie side by side and no range parts them.
    """
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    keyed = rows.withColumn("same", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    firsts = stored(keyed.groupBy("conv_id", "same").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("conv_id", "same", "first"), "first-rows")
    firsts = firsts.withColumnsRenamed({"conv_id": "of", "same": "its"})
    found = keyed.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("its")), "left")
    found = found.select("conv_id", "turn", "role", "text", "blank", "open", F.coalesce(place > F.col("first"), F.lit(False)).alias("later"))
    names = ["conv_id", "part", "place", "turn", "role", "text", "fault", "code"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches):
        before, place = None, 0
        for rows in batches:
            places, faults, codes = [], [], []
            columns = [rows.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "blank", "open", "later")]
            for conv_id, turn, role, text, blank, unended, later in zip(*columns, strict=True):
                now = (conv_id, turn, role, text)
                fault = 0 if blank else 1 if later or now == before else 2 if unended else 3
                before, place = now, place + 1
                places.append(place)
                faults.append(fault)
                codes.append(row_code(role[:1], fault < 2, fault == 2))
            arrays = [rows.column("conv_id"), rows.column("part"), places, *(rows.column(c) for c in ("turn", "role", "text")), faults, codes]
            yield pa.RecordBatch.from_arrays([pa.array(a, t) if isinstance(a, list) else a for a, t in zip(arrays, types, strict=True)], schema=schema)

    dealt = found.repartitionByRange(pieces, *ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id())
    return stored(dealt.mapInArrow(run, "conv_id long, part int, place long, turn long, role string, text string, fault int, code int"), "coded-rows")


def _runs(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows in order by the runs of equal keys; a run's rows are streamed."""
    from itertools import groupby

    rows = (row for b in batches for row in b.to_pylist())
    return groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def range_costs(coded: DataFrame) -> DataFrame:
    """For each range of a conversation its counts, its first and last turns and roles, and costs and ranks from each state to each."""
    numbers = ["blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn"]
    out = f"conv_id long, part int, {', '.join(f'{c} long' for c in numbers)}, first_role string, last_role string, costs array<long>, ranks array<int>"
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), *((c, pa.int64()) for c in numbers), ("first_role", pa.string()), ("last_role", pa.string()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))])

    def run(batches):
        for (conv_id, part), rows in _runs(batches, "conv_id", "part"):
            faults, illegal, turns, first_turn, turn, first, last, codes = [0] * 4, 0, 0, None, None, None, None, bytearray()
            for r in rows:
                faults[r["fault"]] += 1
                illegal += last is not None and last + r["initial"] not in LEGAL
                turns += r["turn"] is not None and r["turn"] != turn
                first_turn = r["turn"] if first_turn is None else first_turn
                first, last, turn = r["initial"] if first is None else first, r["initial"], r["turn"]
                codes.append(r["code"])
            ways = [forward(bytes(codes), begin(s)) for s in STATES]
            row = [conv_id, part, *faults[:3], illegal, turns, first_turn, turn, first, last, sum((w[0] for w in ways), []), sum((w[1] for w in ways), [])]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    wanted = coded.select("conv_id", "part", "place", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", "code")
    return wanted.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place").mapInArrow(run, out)


def chained(costs: DataFrame) -> DataFrame:
    """The state before and after each range, and on the last one the conversation's figures."""
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = f"conv_id long, part int, before int, after int, {', '.join(f'{c} long' for c in numbers)}"
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("before", pa.int32()), ("after", pa.int32()), *((c, pa.int64()) for c in numbers)])

    def through(vector: Vector, r: dict) -> Vector:
        """As forward, for all of a range's rows."""
        costs, ranks = vector
        found = []
        for s in STATES:
            ways = [(costs[b] + c, ranks[b], r["ranks"][4 * b + s]) for b in STATES if costs[b] < NEVER and (c := r["costs"][4 * b + s]) < NEVER]
            found.append(min(ways) if ways else (NEVER, NEVER, 0))
        order = sorted(STATES, key=lambda s: found[s][1:])
        return [f[0] for f in found], [order.index(s) for s in STATES]

    def run(batches):
        for (conv_id,), rows in _runs(batches, "conv_id"):
            ranges = list(rows)  # no more than ranges of rows
            vectors = [begin(START)]
            for r in ranges:
                vectors.append(through(vectors[-1], r))
            rest = [c for c, _ in ENDS]
            states = [crossing(*vectors[-1], rest)]
            cost = vectors[-1][0][states[0]] + rest[states[0]]
            for r, vector in zip(reversed(ranges), reversed(vectors[:-1]), strict=True):
                states.append(crossing(*vector, [r["costs"][4 * b + states[-1]] for b in STATES]))
            states.reverse()
            sums = {c: sum(r[c] for r in ranges) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
            for a, b in zip(ranges, ranges[1:], strict=False):
                sums["illegal"] += a["last_role"] + b["first_role"] not in LEGAL
                sums["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
            known = [t for r in ranges for t in (r["first_turn"], r["last_turn"]) if t is not None]
            gaps = max(known) - min(known) + 1 - sums["turns"] if known else 0
            figures = [gaps, *(sums[c] for c in ("blank", "duplicate", "truncated", "illegal")), cost]
            n = len(ranges)
            columns = [[conv_id] * n, [r["part"] for r in ranges], states[:-1], states[1:], *([f] * n for f in figures)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return costs.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, out)


def repair_long(rows: DataFrame, pieces: int) -> DataFrame:
    """As repair_short, for conversations that may be longer than a task holds."""
    coded = with_codes(rows.where("not gone"), pieces)
    states = stored(chained(range_costs(coded)), "range-states")
    keys = ["conv_id", "part"]
    both = lambda a, b: F.col(f"a.{keys[0]}").eqNullSafe(F.col(f"b.{keys[0]}")) & (F.col(f"a.{keys[1]}") == F.col(f"b.{keys[1]}"))
    placed = coded.select(*keys, "place", "code").alias("a").join(states.select(*keys, "before", "after").alias("b"), both("a", "b")).select("a.*", "before", "after")
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("edits", pa.string()), ("state", pa.int32())])

    def find(batches):
        for (conv_id, part, start, end), found in _runs(batches, "conv_id", "part", "before", "after"):
            places, codes = zip(*((r["place"], r["code"]) for r in found), strict=True)
            edits, state, before = edits_between(bytes(codes), start, end), start, []
            for code, e in zip(codes, edits, strict=True):
                before.append(state)
                state = repaired(e, "s" if code % 4 == SYSTEM else "", "", state)[1]
            for at in range(0, len(places), 10_000):
                some = slice(at, at + 10_000)
                n = len(places[some])
                columns = [[conv_id] * n, [part] * n, places[some], edits[some], before[some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    edits = stored(placed.repartition(*keys).sortWithinPartitions(*keys, "place").mapInArrow(find, "conv_id long, part int, place long, edits string, state int"), "range-edits")
    same = both("a", "b") & (F.col("a.place") == F.col("b.place"))
    lined = coded.select(*keys, "place", "role", "text").alias("a").join(edits.alias("b"), same).select("a.*", "edits", "state")
    out_schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def digest(batches):
        for (conv_id,), found in _runs(batches, "conv_id"):
            audit, sha, state, any_line = [], hashlib.sha256(), START, False
            for r in found:
                audit.append(r["edits"])
                lines, state = repaired(r["edits"], r["role"], r["text"], r["state"])
                for line in lines:
                    sha.update(("\n" if any_line else "").encode() + line.encode())
                    any_line = True
            audit.append(ENDS[state][1])
            for line in repaired(ENDS[state][1], "", "", state)[0]:
                sha.update(("\n" + line).encode())
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((conv_id, "".join(audit), sha.hexdigest()), out_schema, strict=True)], schema=out_schema)

    texts = lined.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(digest, "conv_id long, audit string, repaired_sha256 string")
    figures = states.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")))
    all_ids = rows.select("conv_id").distinct().alias("i")
    joined = all_ids.join(figures.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left").join(texts.alias("t"), F.col("i.conv_id").eqNullSafe(F.col("t.conv_id")), "left")
    counts = [F.coalesce(f"f.{c}", F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("i.conv_id", *counts, F.coalesce("t.audit", F.lit("")).alias("audit"), F.coalesce("t.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair(rows: DataFrame, long_rows: int = LONG, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The repair of each conversation of rows (conv_id, turn, role, text), none of which is damaged here: rows of damaged() or with gone = false."""
    tune(rows.sparkSession)
    ready = with_ends(rows.select("conv_id", "turn", "role", "text", "gone"))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    large = stored(sizes.where((F.col("n") > long_rows) | (F.col("size") > long_bytes)).select(F.col("conv_id").alias("large_id")), "long-conversations")
    if large.isEmpty():
        return repair_short(ready)
    is_large = F.col("conv_id").eqNullSafe(F.col("large_id"))
    short, long = ready.join(large, is_large, "left_anti"), ready.join(large, is_large, "left_semi")
    return repair_short(short).unionByName(repair_long(long, 4 * partitions(rows.sparkSession)))


def repaired_conversations(rows: DataFrame, long_rows: int = LONG, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The contract's damage, then the repair."""
    return repair(damaged(rows), long_rows, long_bytes)
