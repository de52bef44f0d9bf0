"""Repair of conversation structure: the cheapest edits that give alternating turns.

A conversation is legal if the first letters of its roles spell ``(s?(ua)+)?``.
Turns are kept, given another role, deleted or inserted, each at a price; blank
and repeated turns must go. A backward pass computes, before every turn and for each state of
the grammar, the least cost that is still to come; a forward walk then takes, among the
edits that keep to that cost, the one whose letter is least in ASCII.

Rows are sorted once, by range, so a conversation of any length lies in
consecutive pieces, each as large as a partition. A piece maps the costs behind
it to the costs before it, and an entry state to an exit state; only pieces of
conversations that cross a border, two a partition at most, send these sixteen
numbers to the driver, which chains them. All pieces are then walked
independently. Equal rows are counted before anything is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.plans.workspace import Workspace

_SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system turn, after a user turn, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that a turn may be given, or be inserted with, in each state.
_OPEN = ("user", "user", "assistant", "user")
RETAG, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_NEVER = 1 << 60

#: A turn of the walk: letter of its role, whether it ends without a stop, and how many copies must be deleted (0: a turn to decide on).
Turn = tuple[str, bool, int]


def _after(state: int) -> int:
    return _NEXT[state, _OPEN[state][0]]


def _with_inserts(costs: list[int]) -> list[int]:
    for state in (ASSISTANT, USER, SYSTEM, START, ASSISTANT, USER):
        costs[state] = min(costs[state], INSERT + costs[_after(state)])
    return costs


#: Costs behind the last turn: the states in which a conversation may end are free.
END = tuple(_with_inserts([0, _NEVER, _NEVER, 0]))


def _choices(turn: Turn, state: int, behind: list[int]) -> Iterator[tuple[str, int, int]]:
    """Letter, cost to the end and next state of each edit of a turn, in ASCII order of the letters."""
    letter, truncated, _ = turn
    extra = TRUNCATED if truncated else 0
    yield "D", DELETE + behind[state], state
    kept = _NEXT.get((state, letter))
    if kept is not None:
        yield "K", extra + behind[kept], kept
    yield "R", RETAG + extra + behind[_after(state)], _after(state)


def costs_to_go(turns: list[Turn], end: tuple[int, ...] = END) -> list[list[int]]:
    """Least cost still to come, before each turn and behind the last, by state."""
    out = [list(end)]
    for turn in reversed(turns):
        behind = out[-1]
        if turn[2]:
            out.append([c + DELETE * turn[2] for c in behind])
        else:
            out.append(_with_inserts([min(cost for _, cost, _ in _choices(turn, state, behind)) for state in range(4)]))
    out.reverse()
    return out


def walk(turns: list[Turn], entry: int = START, end: tuple[int, ...] = END, last: bool = True) -> tuple[list[tuple[str, int, str]], int]:
    """Edits as (letter, number of the turn, role given) and the exit state; a last piece may insert behind its turns."""
    to_go = costs_to_go(turns, end)
    state, edits, i = entry, [], 0
    while True:
        now = to_go[i][state]
        here = []
        if i < len(turns):
            here = [("D", now, state)] if turns[i][2] else list(_choices(turns[i], state, to_go[i + 1]))
        elif not last or (now == 0 and state in (START, ASSISTANT)):
            return edits, state
        options = [*here, ("I", INSERT + to_go[i][_after(state)], _after(state))]
        letter, _, target = min(o for o in options if o[1] == now)
        edits.append((letter, i, _OPEN[state] if letter in "IR" else ""))
        state, i = target, i + (letter != "I")


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Consecutive rows with equal keys, as a stream within the stream."""
    rows = chain.from_iterable(batch.to_pylist() for batch in batches)
    ahead = next(rows, None)

    def same(key: tuple) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and tuple(ahead[k] for k in keys) == key:
            now, ahead = ahead, next(rows, None)
            yield now

    while ahead is not None:
        key = tuple(ahead[k] for k in keys)
        run = same(key)
        yield key, run
        for _ in run:
            pass


def _turns(rows: list[dict]) -> list[tuple[int, Turn, str]]:
    """Number of the row, turn, fault; copies behind the first become one turn to delete."""
    out = []
    for i, r in enumerate(rows):
        letter = r["role"][:1]
        if r["blank"]:
            out.append((i, (letter, False, r["copies"]), "blank"))
            continue
        if r["first"]:
            out.append((i, (letter, r["truncated"], 0), "truncated" if r["truncated"] else ""))
        again = r["copies"] - r["first"]
        if again:
            out.append((i, (letter, False, again), "duplicate"))
    return out


def _piece_maps(end: dict | None, conv_type: pa.DataType):
    """For pieces that cross a border: costs from each entry to each exit, or, with the costs behind known, the exit of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, _), rows in _runs(batches, "conv", "piece"):
            rows = list(rows)
            turns = [t for _, t, _ in _turns(rows)]
            if end is None:
                columns = [costs_to_go(turns, tuple(0 if s == out else _NEVER for s in range(4)))[0] for out in range(4)]
                found = [min(_NEVER, columns[out][entry]) for entry in range(4) for out in range(4)]
            else:
                found = [walk(turns, entry, end[rows[0]["place"]], last=False)[1] for entry in range(4)]
            yield pa.RecordBatch.from_pydict({"conv": pa.array([conv], conv_type), "place": pa.array([rows[0]["place"]], pa.int64()), "found": pa.array([found], pa.list_(pa.int64()))})

    return run


_EDITS = "piece long, step long, edit string, times long, fault string, turn long, role string, new_role string, text string"


def _edits(borders: dict, conv_type: pa.DataType):
    """All edits of every piece; ``borders`` has entry state, costs behind and lastness of those that cross."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (conv, piece), rows in _runs(batches, "conv", "piece"):
            rows = list(rows)
            entry, end, last = borders.get(rows[0]["place"], (START, END, True))
            turns = _turns(rows)
            for step, (letter, i, role) in enumerate(walk([t for _, t, _ in turns], entry, end, last)[0]):
                if letter == "I":
                    out.append((conv, piece, step, "I", 1, "", None, None, role, ""))
                else:
                    at, turn, fault = turns[i]
                    row = rows[at]
                    out.append((conv, piece, step, letter, turn[2] or 1, fault, row["turn"], row["role"], role or (row["role"] if letter == "K" else None), row["text"]))
            if len(out) > 5_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (conv_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ["conv", *(c.split(" ")[0] for c in _EDITS.split(", "))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _borders(pieces: DataFrame) -> dict:
    """Entry state, costs behind and lastness of the pieces of conversations that cross a border, by their first place."""
    spark = pieces.sparkSession
    kind = pieces.schema["conv"].dataType
    ends = pieces.groupBy("piece").agg(F.min_by("conv", "place").alias("low"), F.max_by("conv", "place").alias("high")).orderBy("piece").collect()  # a row for each partition
    crossing = {(a["high"], p) for a, b in zip(ends, ends[1:], strict=False) if a["high"] == b["low"] for p in (a["piece"], b["piece"])}
    if not crossing:
        return {}
    keys = spark.createDataFrame(sorted(crossing, key=lambda k: k[1]), f"of {kind.simpleString()}, part long")
    cut = pieces.join(F.broadcast(keys), F.col("conv").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("part")), "left_semi")
    cut = cut.repartition("piece").sortWithinPartitions("piece", "place")
    maps = lambda end: cut.mapInArrow(_piece_maps(end, _arrow(kind)), f"conv {kind.simpleString()}, place long, found array<long>").collect()
    links: dict = {}
    for r in sorted(maps(None), key=lambda r: r["place"]):
        links.setdefault(r["conv"], []).append(r)
    behind: dict[int, tuple] = {}
    for chain_ in links.values():
        costs = END
        for r in reversed(chain_):
            behind[r["place"]] = costs
            costs = tuple(min(_NEVER, *(r["found"][4 * entry + out] + costs[out] for out in range(4))) for entry in range(4))
    exits = {r["place"]: r["found"] for r in maps(behind)}
    borders = {}
    for chain_ in links.values():
        state = START
        for r in chain_:
            borders[r["place"]] = (state, behind[r["place"]], r is chain_[-1])
            state = exits[r["place"]][state]
    return borders


def repair_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The cheapest edits of every conversation, one row each.

    A conversation's rows go by turn (null first), then role and text, so that equal rows are
    neighbours; null roles and texts count as one space. A row is *blank* without
    a character other than white space (``[\\x20\\x09-\\x0D]``), else *duplicate* if an earlier row has
    its role and text, else *truncated* if its last such character is none of ``.!?``.
    Keep costs 0, giving the role user or assistant 1, delete 2, an inserted empty turn 5; a truncated
    row that stays costs 5 more; blank and duplicate rows must be deleted. Of the
    cheapest edits that make the roles' first letters spell ``(s?(ua)+)?`` those whose letters
    (D, I, K, R) are least in ASCII are returned.

    Columns: ``conv``, ``piece`` and ``step`` (their order is the order of the edits), ``edit``, ``times``
    (equal deletions in a row), ``fault``, ``turn``, ``role``, ``new_role`` (null if deleted) and ``text``
    (of the row; empty if inserted). An empty table gives an empty result; a null id is one conversation.
    """
    spark = turns.sparkSession
    space = Workspace(spark, "repair")
    blank = F.lit(" ")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), blank).alias("role"), F.coalesce(F.col(text_col).cast("string"), blank).alias("text"))
    counted = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    counted = space.table("counted", counted)
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    earliest = counted.groupBy("conv", "role", "text").agg(F.min(order).alias("least")).select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), F.col("least.at").alias("first_turn"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")) & F.col("turn").eqNullSafe(F.col("first_turn"))
    ended = F.rtrim("text", F.lit(_SPACE))
    marked = counted.join(earliest, same, "left").select("conv", "turn", "role", "text", "copies", F.col("r").isNotNull().cast("int").alias("first"), (ended == "").alias("blank"), (~F.substring(ended, -1, 1).isin(".", "!", "?")).alias("truncated"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ("conv", "turn", "role", "text")
    sorted_ = marked.repartitionByRange(tasks, *by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()).withColumn("piece", F.shiftright("place", 33))
    pieces = space.table("pieces", sorted_)
    space.drop("counted")
    borders = _borders(pieces.select("conv", "piece", "place", "role", "copies", "first", "blank", "truncated"))
    dealt = pieces.repartition("piece", "conv").sortWithinPartitions("piece", "place")
    kind = pieces.schema["conv"].dataType
    return dealt.mapInArrow(_edits(borders, _arrow(kind)), f"conv {kind.simpleString()}, {_EDITS}")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


_PRICE = {"K": 0, "R": RETAG, "D": DELETE, "I": INSERT}
_LEGAL = {"su", "ua", "au"}


def _summaries(conv_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), rows in _runs(batches, "conv"):
            counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
            audit, digest, illegal, cost, before, lines = [], sha256(), 0, 0, None, 0
            turns, low, high = 0, None, None
            for r in rows:
                audit.append(r["edit"] * r["times"])
                cost += _PRICE[r["edit"]] * r["times"]
                if r["edit"] != "I":
                    letter = r["role"][:1]
                    illegal += r["times"] - 1 + (before is not None and before + letter not in _LEGAL)
                    before = letter
                    if r["turn"] is not None and r["turn"] != high:
                        turns, low, high = turns + 1, r["turn"] if low is None else low, r["turn"]
                    if r["fault"]:
                        counts[r["fault"]] += r["times"]
                        cost += TRUNCATED if r["fault"] == "truncated" and r["edit"] != "D" else 0
                if r["edit"] != "D":
                    digest.update(f"{chr(10) if lines else ''}{r['new_role']}:{r['text']}".encode())
                    lines += 1
            gaps = high - low + 1 - turns if turns else 0
            values = {"conv": pa.array([conv], conv_type)} | {k: pa.array([v], pa.int64()) for k, v in {"gaps": gaps, **counts, "illegal": illegal, "cost": cost}.items()}
            yield pa.RecordBatch.from_pydict(values | {"audit": pa.array(["".join(audit)], pa.string()), "repaired_sha256": pa.array([digest.hexdigest()], pa.string())})

    return run


def summarise_repairs(edits: DataFrame) -> DataFrame:
    """For each conversation of ``repair_turns``: ``gaps`` in its turn numbers, faults, ``illegal`` neighbours, ``cost``, ``audit`` and a digest.

    A digest of a whole conversation runs through its turns in order, so its rows pass
    one task as a stream; only the audit's letters are held.
    """
    kind = edits.schema["conv"].dataType
    dealt = edits.repartition("conv").sortWithinPartitions("conv", "piece", "step")
    return dealt.mapInArrow(_summaries(_arrow(kind)), f"conv {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damage_turns(turns: DataFrame) -> DataFrame:
    """``conversations`` with faults that a hash of ``conv_id:turn`` chooses (nulls count as one space).

    Of twenty values 0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it and 4 makes it the user's.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    role = F.when(F.col("_fate") == 4, "user").otherwise(text_of("role"))
    rows = turns.select("conv_id", "turn", "role", "text", fate.alias("_fate")).where("_fate <> 0")
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return rows.drop("_copy")


def repaired_conversations(turns: DataFrame, faults: DataFrame | None = None) -> DataFrame:
    """A summary row for every ``conv_id`` of ``turns``; ``faults`` (default: ``turns``) has the rows to repair.

    Conversations without rows in ``faults`` have zeros, an empty audit and the digest of nothing.
    """
    done = summarise_repairs(repair_turns(turns if faults is None else faults))
    every = turns.select("conv_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    joined = every.join(done, every["conv_id"].eqNullSafe(done["conv"]), "left")
    nothing = sha256(b"").hexdigest()
    return joined.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
