"""Repair of conversations: the cheapest edits that make the roles run system, user, assistant, user, ...

Rows of a conversation stand by turn (null first); rows of one turn by role, then by a hash of their text.
The first fault of a row counts: blank, duplicate (role and text of an earlier row) or truncated (no mark at
the end). A row can be kept, given the role user or assistant, or deleted; rows without text can be inserted.
Blank and duplicate rows have to go. A row whose role starts with none of s, u and a can't be kept.

Rows are dealt to tasks by ranges of (conversation, turn, role, hash), so that a conversation with very many
rows is spread. A task streams its rows. A conversation that lies inside one task is searched there; one that
may reach into a neighbour, or is longer than a chunk, leaves chunks, each searched from all four states it
could be entered in. A chunk then is one step of the same search over the chunks of a conversation, whose
decided states give every chunk its edits. Only hashes, a row's number of copies and the chunks are shuffled
besides that. The hash of one repaired conversation is one stream of bytes by its definition; it is fed chunk
by chunk.

A null role or text is one blank. Null ids are one conversation, null turns a turn of their own that no gap
counts. Rows equal in all columns travel once, with their number. Extra columns are left out of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import documents, scratch, ship
from tallyscope.llm.survivors import Move, Survivors

# Costs of edits.
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

#: What the output so far ends with: nothing yet, the system row, a user row, an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: The role that can be made up in each state; it leads to the state of that role.
NEXT_ROLE = {NOTHING: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
REACHED = {"user": USER, "assistant": ASSISTANT}
#: (state, initial): the state after a row that is kept.
KEPT = {(NOTHING, "s"): SYSTEM} | {(s, role[0]): REACHED[role] for s, role in NEXT_ROLE.items()}
#: Ways to end.
FINISH = {NOTHING: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
#: What a path in the second state pays at most beyond one in the first, whatever rows come: inserts that lead to
#: the same role, or the deletion of a system row that only a path without output can keep.
CATCH_UP = (
    (0, 2 * INSERT, INSERT + DELETE, DELETE),
    (0, 0, INSERT, 0),
    (INSERT, INSERT, 0, INSERT),
    (0, 2 * INSERT, INSERT, 0),
)
#: Keys of repeated rows that are broadcast; more are joined by key.
BROADCAST_ROWS = 20_000
CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 20
OUT_ROWS, OUT_BYTES = 1024, 1 << 23
NONE = -1

_moves: dict[tuple[str, bool, bool], list[list[Move]]] = {}


def moves(initial: str, must_go: bool, truncated: bool) -> list[list[Move]]:
    """Ways past a row of this kind from each state, inserts before it included. Two inserts from a
    system row or from nothing lead on to new states, more never do."""
    kind = (initial if initial in ("s", "u", "a") else "", must_go, truncated)
    if kind not in _moves:
        table = []
        for start in STATES:
            best: dict[int, tuple[int, str]] = {}
            state, cost, label = start, 0, ""
            for _ in range(3):
                ways = [(state, DELETE, "D")]
                if not must_go:
                    left = LEFT_TRUNCATED if truncated else 0
                    ways.append((REACHED[NEXT_ROLE[state]], REROLE + left, "R"))
                    if (state, kind[0]) in KEPT:
                        ways.append((KEPT[state, kind[0]], KEEP + left, "K"))
                for to, more, edit in ways:
                    way = (cost + more, label + edit)
                    best[to] = min(best.get(to, way), way)
                state, cost, label = REACHED[NEXT_ROLE[state]], cost + INSERT, label + "I"
            table.append([(to, cost, label) for to, (cost, label) in best.items()])
        _moves[kind] = table
    return _moves[kind]


def applied(audit: str, state: int, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired rows, by a string of edits that starts in a state."""
    rows = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = NEXT_ROLE[state]
        state = KEPT[state, role[:1]]
        yield role, text


def joined(rows: Iterable[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in rows).encode()


class Tally:
    """Counts over the rows of a conversation, or of a part of it."""

    def __init__(self) -> None:
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = ""  # initials
        self.low = self.high = None  # turns

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if self.rows and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if not self.rows:
            self.first = initial
        self.rows, self.last = self.rows + 1, initial
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn

    def follow(self, part: dict) -> None:
        """Add the counts of the part behind this one."""
        if self.rows and self.last + part["first"] not in ("su", "ua", "au"):
            self.illegal += 1
        if part["low"] is not None:
            self.turns += part["turns"] - (part["low"] == self.high)
            self.low, self.high = part["low"] if self.low is None else self.low, part["high"]
        for name in ("rows", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + part[name])
        self.last = part["last"]

    def report(self) -> dict:
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return {n: getattr(self, n) for n in ("blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps}


PARTS = (
    "part int, chunk int, rows long, blank long, duplicate long, truncated long, illegal long, turns long, first string, "
    "last string, low long, high long, gaps long, costs array<long>, audits array<string>, roles array<string>, "
    "texts array<string>, cost long, audit string, sha string"
)
FOLDED = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha string, "
    "path array<struct<part: int, chunk: int, state: int, to: int, tail: int, position: long>>"
)


def batched(rows: Iterable[dict], schema: pa.Schema, weight: Callable[[dict], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if len(held) >= OUT_ROWS or size >= OUT_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def search(rows: list[tuple], state: int) -> tuple[list[str], Survivors]:
    """Decided labels and survivors after these rows."""
    decided: list[str] = []
    found = Survivors(state, decided.append, CATCH_UP)
    for _, role, _, must_go, truncated in rows:
        found.step(moves(role[:1], must_go, truncated))
    return decided, found


def whole(conv, tally: Tally, rows: list[tuple], keep_rows: bool) -> dict:
    """The result row of a conversation that lies in one piece."""
    decided, found = search(rows, NOTHING)
    _, cost, rest = found.best(FINISH)
    audit = "".join(decided) + "".join(rest)
    repaired = list(applied(audit, NOTHING, ((r[1], r[2]) for r in rows)))
    out = {"conv_id": conv, "cost": cost, "audit": audit, "sha": hashlib.sha256(joined(repaired)).hexdigest()}
    if keep_rows:
        out |= {"roles": [r for r, _ in repaired], "texts": [t for _, t in repaired]}
    return out | tally.report()


def open_chunk(conv, part: int, chunk: int, tally: Tally, rows: list[tuple]) -> dict:
    """A piece of a conversation, with its edits from each state to each."""
    costs, audits = [NONE] * 16, [""] * 16
    for state in STATES:
        decided, found = search(rows, state)
        for to, (cost, _, node) in found.leaves.items():
            costs[4 * state + to] = cost
            audits[4 * state + to] = "".join(decided) + "".join(found.suffix(node))
    names = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "low", "high")
    return {"conv_id": conv, "part": part, "chunk": chunk, "costs": costs, "audits": audits} | {
        "roles": [r[1] for r in rows], "texts": ["" if r[3] else r[2] for r in rows],
    } | {n: getattr(tally, n) for n in names}


def conversation_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, turn, role, text, fault) in order, copies unfolded, from rows and the marks before them."""
    marked = None
    for batch in batches:
        for conv, turn, role, k1, k2, is_row, text, copies, blank, truncated in zip(*(c.to_pylist() for c in batch.columns)):
            key = (conv, turn, role, k1, k2)
            if not is_row:
                marked = key
                continue
            for copy in range(copies):
                again = copy > 0 or key == marked
                yield conv, turn, role, text, "blank" if blank else "duplicate" if again else "truncated" if truncated else ""


def searched(keep_rows: bool, schema: pa.Schema, chunk_rows: int, chunk_bytes: int):
    """A task's rows -> results of whole conversations and chunks of the others."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        # chunks are numbered through within a task
        current, split, chunk, tally, rows, size = None, True, 0, Tally(), [], 0
        for conv, turn, role, text, fault in conversation_rows(batches):
            if current is not None and current[0] != conv:
                # the first conversation of a task may have begun in the one before
                if split:
                    yield open_chunk(current[0], part, chunk, tally, rows)
                    chunk += 1
                else:
                    yield whole(current[0], tally, rows, keep_rows)
                split, tally, rows, size = False, Tally(), [], 0
            elif len(rows) >= chunk_rows or size >= chunk_bytes:
                yield open_chunk(conv, part, chunk, tally, rows)
                split, chunk, tally, rows, size = True, chunk + 1, Tally(), [], 0
            current = (conv,)
            must_go = fault in ("blank", "duplicate")
            rows.append((turn, role, "" if must_go else text, must_go, fault == "truncated"))
            size += 0 if must_go else len(text)
            tally.add(turn, role[:1], fault)
        if current is not None:  # it may go on in the next task
            yield open_chunk(current[0], part, chunk, tally, rows)

    def run(batches):
        yield from batched(pieces(batches), schema, lambda r: sum(map(len, r.get("texts") or ())))

    return run


def folded(schema: pa.Schema):
    """Chunks without texts, in order -> the result of each conversation and its state at every chunk."""

    def close(conv, tally: Tally, chunks: list[tuple], decided: list[str], found: Survivors) -> dict:
        end, cost, rest = found.best(FINISH)
        labels = decided + rest[:-1]
        path, state, position = [], NOTHING, 0
        for (part, chunk, reach), label in zip(chunks, labels):
            to = reach[state, label]
            path.append({"part": part, "chunk": chunk, "state": state, "to": to, "tail": 0, "position": position})
            position += len(label) - label.count("D")
            state = to
        path[-1]["tail"] = len(rest[-1])
        return {"conv_id": conv, "cost": cost, "audit": "".join(labels) + rest[-1], "path": path} | tally.report()

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        current = None
        for batch in batches:
            for row in batch.to_pylist():
                if current is None or current[0] != row["conv_id"]:
                    if current is not None:
                        yield close(*current)
                    decided: list[str] = []
                    current = (row["conv_id"], Tally(), [], decided, Survivors(NOTHING, decided.append, CATCH_UP))
                _, tally, chunks, _, found = current
                ways = [[(to, row["costs"][4 * s + to], row["audits"][4 * s + to]) for to in STATES if row["costs"][4 * s + to] != NONE] for s in STATES]
                chunks.append((row["part"], row["chunk"], {(s, label): to for s in STATES for to, _, label in ways[s]}))
                found.step(ways)
                tally.follow(row)
        if current is not None:
            yield close(*current)

    def run(batches):
        yield from batched(pieces(batches), schema, lambda r: len(r["audit"]))

    return run


def replayed(schema: pa.Schema):
    """A chunk with its decided states -> its repaired rows."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                audit = row["audits"][4 * row["state"] + row["to"]] + "I" * row["tail"]
                done = list(applied(audit, row["state"], zip(row["roles"], row["texts"])))
                out.append({n: row[n] for n in ("conv_id", "part", "chunk", "position")} | {"roles": [r for r, _ in done], "texts": [t for _, t in done]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def hashed(schema: pa.Schema):
    """Repaired chunks in order -> a hash for each conversation, fed as they come."""

    def pieces(batches):
        current = None
        for batch in batches:
            for row in batch.to_pylist():
                if current is None or current[0] != row["conv_id"]:
                    if current is not None:
                        yield {"conv_id": current[0], "sha": current[1].hexdigest()}
                    current = [row["conv_id"], hashlib.sha256(), False]
                if row["roles"]:
                    current[1].update((b"\n" if current[2] else b"") + joined(zip(row["roles"], row["texts"])))
                    current[2] = True
        if current is not None:
            yield {"conv_id": current[0], "sha": current[1].hexdigest()}

    return lambda batches: batched(pieces(batches), schema, lambda r: 0)


def _same(left: str, right: str, *names: str) -> Column:
    same = F.lit(True)
    for name in names:
        same = same & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return same


def ordered_rows(turns: DataFrame) -> DataFrame:
    """Rows with their hashes and copies, and marks for rows whose role and text stand in an earlier turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("int").alias("copies"))
    hashes = [F.xxhash64(F.lit(seed), "role", "text").alias(f"k{seed}") for seed in (1, 2)]
    rows = rows.select("*", *hashes)
    names = ["conv_id", "turn", "role", "k1", "k2"]
    places = scratch(rows.groupBy(*names).agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("n")), "places")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = places.groupBy("conv_id", "k1", "k2").agg(F.min(turn).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = (
        places.alias("p").join(firsts.alias("f"), _same("p", "f", "conv_id", "k1", "k2"))
        .where(~F.col("f.first.turn").eqNullSafe(F.col("p.turn"))).select(*(F.col(f"p.{n}") for n in names))
    )
    # rows equal in all columns are folded, wherever there are any
    several = places.where("n > 1").select(*names)
    if several.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        several = F.broadcast(several)
    once = rows.alias("r").join(several.alias("p"), _same("r", "p", *names), "left_anti")
    often = (
        rows.alias("r").join(several.alias("p"), _same("r", "p", *names), "left_semi")
        .groupBy(*names).agg(F.first("text").alias("text"), F.sum("copies").cast("int").alias("copies"))
    )
    core = F.rtrim(F.col("text"), F.lit(BLANKS))
    texts = once.select(*names, "text", "copies").unionByName(often.select(*names, "text", "copies")).select(
        *names, F.lit(True).alias("is_row"), "text", "copies", (F.length(core) == 0).alias("blank"),
        (~F.right(core, F.lit(1)).isin(*ENDS)).alias("truncated"),
    )
    marks = later.select(
        *names, F.lit(False).alias("is_row"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"),
        F.lit(False).alias("blank"), F.lit(False).alias("truncated"),
    )
    return texts.unionByName(marks).repartitionByRange(*names).sortWithinPartitions(*names, "is_row")


def _arrow(frame_id: str, fields: str, spark: SparkSession) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = f"conv_id {frame_id}, {fields}"
    return ddl, to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _solve(turns: DataFrame, keep_rows: bool, chunk_rows: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pieces, folded conversations, and the repaired rows of open chunks."""
    spark = turns.sparkSession
    ship(spark)
    id_type = turns.schema["conv_id"].dataType.simpleString()
    ddl, schema = _arrow(id_type, PARTS, spark)
    pieces = scratch(ordered_rows(turns).mapInArrow(searched(keep_rows, schema, chunk_rows, chunk_bytes), ddl), "pieces")
    lean = pieces.where("costs is not null").drop("roles", "texts")
    ddl, schema = _arrow(id_type, FOLDED, spark)
    in_order = lean.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    fold = scratch(in_order.mapInArrow(folded(schema), ddl), "fold")
    path = fold.select("conv_id", F.explode("path").alias("at")).select("at.*")
    chosen = pieces.where("costs is not null").select("conv_id", "part", "chunk", "audits", "roles", "texts").join(path, ["part", "chunk"])
    ddl, schema = _arrow(id_type, "part int, chunk int, position long, roles array<string>, texts array<string>", spark)
    return pieces, fold, chosen.mapInArrow(replayed(schema), ddl)


def repair(turns: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per conversation with rows: faults, cost, audit and the hash of the repaired rows.

    ``turns`` has conv_id, turn, role, text, and may have ``copies``, how often each row stands there.
    """
    pieces, fold, chunks = _solve(turns, False, chunk_rows, chunk_bytes)
    ddl, schema = _arrow(turns.schema["conv_id"].dataType.simpleString(), "sha string", turns.sparkSession)
    shas = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(hashed(schema), ddl)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    opened = fold.alias("a").join(shas.alias("b"), _same("a", "b", "conv_id")).select("a.conv_id", *names, F.col("b.sha"))
    return pieces.where("costs is null").select("conv_id", *names, "sha").unionByName(opened).withColumnRenamed("sha", "repaired_sha256")


def repaired_turns(turns: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The repaired rows: conv_id, position (from 0), role, text."""
    pieces, _, chunks = _solve(turns, True, chunk_rows, chunk_bytes)
    kept = pieces.where("costs is null").select("conv_id", F.lit(0).cast("long").alias("position"), "roles", "texts")
    both = kept.unionByName(chunks.select("conv_id", "position", "roles", "texts"))
    rows = F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text"))
    return both.select("conv_id", "position", F.posexplode(rows).alias("at", "row")).select(
        "conv_id", (F.col("position") + F.col("at")).alias("position"), F.col("row.role"), F.col("row.text")
    )


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults made by a hash of conversation and turn: dropped, emptied, without marks, twice, role user."""
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    fault = F.col("fault")
    return rows.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = documents(spark, sf_dir, "conversations")
    found = repair(damage(conversations))
    everyone = conversations.select("conv_id").distinct()
    zero = F.lit(0).cast("long")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return everyone.alias("a").join(found.alias("b"), _same("a", "b", "conv_id"), "left").select(
        "a.conv_id", *(F.coalesce(F.col(f"b.{c}"), zero).alias(c) for c in counts),
        F.coalesce("b.audit", F.lit("")).alias("audit"),
        F.coalesce("b.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
