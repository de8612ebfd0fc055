"""Conversation structure repair: generalised LR parsing over a grammar of roles, with weighted edits.

A conversation's rows, by turn, are read as terminals, the initials of their roles. The parser keeps all stacks that the rows so far may have led to as one graph:
stacks share their lower parts, and equal stacks are one. For every top of the graph a row is kept (0), given another role (``REROLE``) or deleted
(``DELETE``), and terminals are inserted before any row and at the end (``INSERT``). Of edits that lead to equal stacks, those
with the smallest (cost, audit) stay, audit being the initials of the edits in order: edits of one cost that read the same number of rows are no prefixes of each other, so
what is smallest now stays smallest. At the end the best stack that the grammar accepts gives the repair.

Rows are put in order by ranges of (conversation, turn, role, text) and written in segments of bounded size, so a conversation of any length is many of them.
One that is a single segment is parsed at once. Of others each segment is parsed from every stack that the grammar can reach; what they cost is put together
in order, the edits of each segment follow, and segments are edited side by side; only their bytes run through one hash. Rows seen earlier come
from counts by (conversation, role, text), summed up before they are shuffled; those of a row that repeats very often are dealt to many tasks.

Null roles and texts are one space, and so are null ids and turns where the damage is drawn. A null conv_id is a conversation of its own. Rows of one turn, null turns
first, are ordered by role, then text, so equal rows are neighbours and results don't depend on the partitions; a repeated row is a duplicate. A role that is no
terminal, the empty one included, can't be kept. A conversation of which no row is left is repaired by nothing. Very long texts are one segment each at most.
An empty table gives an empty result. Only conv_id, turn, role and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratascan.llm.common import join_repeated, materialize, shuffle_partitions, table, tune

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Left side and right side; the first rule is the start. The empty right side is the empty conversation.
GRAMMAR = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "ua"), ("P", "Pua"))
#: Terminals that rows may be given and that may be inserted, and their roles.
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
#: A segment is closed after so many rows, or so many characters.
SEGMENT_ROWS, SEGMENT_CHARS = 2000, 1 << 22

Best = dict[int, tuple[int, str]]


class Parser:
    """LR(0) tables of a grammar and the graph of stacks. A stack is a number; equal stacks have the same."""

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR, editable: Iterable[str] = tuple(ROLES)) -> None:
        self.rules = (("^", grammar[0][0]), *grammar)
        self.names = {left for left, _ in self.rules}
        self.editable = tuple(editable)
        self.states: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        self.nodes: dict[tuple[int, int], int] = {}
        self.stacks: list[tuple[int, int]] = []  # (state, stack below)
        self._shifts: dict[tuple[int, str], tuple[int, ...]] = {}
        self._accepts: dict[int, bool] = {}
        self.bottom = self._node(self._state({(0, 0)}), -1)

    def _state(self, kernel: Iterable[tuple[int, int]]) -> int:
        items, todo = set(), list(kernel)
        while todo:
            rule, dot = item = todo.pop()
            if item not in items:
                items.add(item)
                rest = self.rules[rule][1][dot:]
                todo += [(i, 0) for i, (left, _) in enumerate(self.rules) if rest[:1] == left]
        key = frozenset(items)
        if key not in self.states:
            self.states[key] = len(self.items)
            self.items.append(key)
        return self.states[key]

    def _node(self, state: int, below: int) -> int:
        if (state, below) not in self.nodes:
            self.nodes[state, below] = len(self.stacks)
            self.stacks.append((state, below))
        return self.nodes[state, below]

    def _go(self, stack: int, symbol: str) -> int | None:
        moved = [(r, d + 1) for r, d in self.items[self.stacks[stack][0]] if self.rules[r][1][d : d + 1] == symbol]
        return self._node(self._state(moved), stack) if moved else None

    def _reduced(self, stack: int) -> set[int]:
        """The stack and all that reductions make of it."""
        found, todo = set(), [stack]
        while todo:
            top = todo.pop()
            if top in found:
                continue
            found.add(top)
            for rule, dot in self.items[self.stacks[top][0]]:
                left, right = self.rules[rule]
                if dot == len(right) and left != "^":
                    below = top
                    for _ in right:
                        below = self.stacks[below][1]
                    after = self._go(below, left)
                    todo += [] if after is None else [after]
        return found

    def shift(self, stack: int, terminal: str) -> tuple[int, ...]:
        """Stacks after a terminal."""
        key = stack, terminal
        if key not in self._shifts:
            moved = {self._go(s, terminal) for s in self._reduced(stack)} if len(terminal) == 1 and terminal not in self.names else set()
            self._shifts[key] = tuple(sorted(m for m in moved if m is not None))
        return self._shifts[key]

    def settled(self, stack: int) -> int:
        """Of a stack whose top is a whole right side what one reduction makes of it, where nothing else can be done with it; so equal stacks are found equal sooner."""
        while True:
            items = self.items[self.stacks[stack][0]]
            if len(items) != 1:
                return stack
            ((rule, dot),) = items
            left, right = self.rules[rule]
            if dot < len(right) or left == "^" or left == self.rules[0][1]:
                return stack
            below = stack
            for _ in right:
                below = self.stacks[below][1]
            stack = self._go(below, left)

    def accepts(self, stack: int) -> bool:
        if stack not in self._accepts:
            self._accepts[stack] = any((0, 1) in self.items[self.stacks[s][0]] for s in self._reduced(stack))
        return self._accepts[stack]

    def reachable(self) -> list[int]:
        """All stacks that terminals lead to, each settled. They are few where the grammar is regular, as that of roles is."""
        terminals = {c for _, right in self.rules for c in right if c not in self.names}
        found, todo = [], [self.bottom]
        while todo:
            at = todo.pop(0)
            if at not in found:
                found.append(at)
                todo += [self.settled(s) for t in sorted(terminals) for s in self.shift(at, t)]
        return found

    def inserted(self, tops: Best) -> Best:
        """With all insertions that pay."""
        best, todo = dict(tops), list(tops)
        while todo:
            at = todo.pop()
            cost, audit = best[at]
            self._move(best, at, self.editable, (cost + INSERT, audit + "I"), todo)
        return best

    def _move(self, best: Best, at: int, terminals: Iterable[str], value: tuple[int, str], changed: list[int] | None = None) -> None:
        for t in terminals:
            for s in self.shift(at, t):
                to = self.settled(s)
                if to not in best or value < best[to]:
                    best[to] = value
                    if changed is not None:
                        changed.append(to)

    def read(self, tops: Best, initial: str, must_go: bool, extra: int) -> Best:
        """After one row, which has to go or costs ``extra`` where it stays."""
        best: Best = {}
        for at, (cost, audit) in self.inserted(tops).items():
            value = (cost + DELETE, audit + "D")
            if at not in best or value < best[at]:
                best[at] = value
            if not must_go:
                self._move(best, at, (initial,), (cost + extra, audit + "K"))
                self._move(best, at, self.editable, (cost + REROLE + extra, audit + "R"))
        return best

    def final(self, tops: Best) -> tuple[int, str]:
        """Smallest (cost, audit) of what the grammar accepts."""
        return min(v for s, v in self.inserted(tops).items() if self.accepts(s))

    def edited(self, at: int, audit: str, rows: list[dict]) -> tuple[list[tuple[str, str]], int]:
        """(role, text) of what the edits make of rows from a stack on, and the stack after them."""
        out, left = [], iter(rows)
        for edit in audit:
            row = next(left) if edit != "I" else None
            if edit == "D":
                continue
            terminal = row["role"][:1] if edit == "K" else next(t for t in self.editable if self.shift(at, t))
            at = self.settled(self.shift(at, terminal)[0])
            out.append((row["role"] if edit == "K" else ROLES[terminal], row["text"] if row else ""))
        return out, at


def fault(row: dict) -> str:
    """The first fault of a row."""
    text = row["text"].rstrip(BLANKS)
    if not text:
        return "blank"
    if row["again"]:
        return "duplicate"
    return "" if text[-1] in ".!?" else "truncated"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage drawn by the checksum of conversation and turn."""
    space = F.lit(" ")
    named = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")])
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    drawn = named.withColumn("_draw", F.pmod(F.crc32(key.cast("binary")), F.lit(20))).where("_draw <> 0")
    text = F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_draw") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def with_earlier(rows: DataFrame) -> DataFrame:
    """``first_turn``: for rows whose role and text their conversation has more than once, the turn where they are first."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.md5(F.col("role").cast("binary")), F.md5(F.col("text").cast("binary"))).cast("binary"))
    rows = rows.withColumn("_key", key).withColumn("_row", F.monotonically_increasing_id())
    order = F.struct(F.col("turn").isNotNull().alias("named"), F.col("turn").alias("turn"))
    again = rows.groupBy("_key").agg(F.min(order).alias("first_turn"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return join_repeated(rows, materialize(again, "conv-again"), "_key", ["_row"], "left").drop("_key", "_row", "n")


_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("again", pa.bool_())]))
_SEGMENT = "key string, conv_id long, part int, nth int, whole boolean, turns long, first_turn long, last_turn long, rows array<struct<role:string,text:string,again:boolean>>"


def segments(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) in order, as segments (key, conv_id, part, nth, whole, turns, first_turn, last_turn, rows): in the order of part and nth they are
    their conversation. ``whole`` marks those that are certain to be alone; turns are distinct ones, nulls left out."""
    tune(rows.sparkSession)
    known = with_earlier(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    n = shuffle_partitions(rows.sparkSession)
    ranged = known.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[dict] = []
        conv, turns, seen, chars, nth, starts, before = None, [None, None], 0, 0, 0, True, None

        def close(whole: bool) -> pa.RecordBatch:
            columns = [pa.array([f"{part}:{nth}:{conv}"]), pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([whole]), pa.array([seen], pa.int64()), *[pa.array([t], pa.int64()) for t in turns], pa.array([held], _ROWS)]
            return pa.RecordBatch.from_arrays(columns, ["key", "conv_id", "part", "nth", "whole", "turns", "first_turn", "last_turn", "rows"])

        for b in batches:
            for row in b.to_pylist():
                if held and (row["conv_id"] != conv or len(held) >= SEGMENT_ROWS or chars + len(row["text"]) > SEGMENT_CHARS):
                    ends = row["conv_id"] != conv
                    yield close(ends and not starts and nth == 0)
                    nth = 0 if ends else nth + 1
                    starts = starts and not ends
                    held, chars, seen, turns = [], 0, 0, [None, None]
                conv = row["conv_id"]
                turn, same = row["turn"], (row["conv_id"], row["turn"], row["role"], row["text"])
                if turn is not None:
                    seen += turn != turns[1]
                    turns = [turn if turns[0] is None else turns[0], turn]
                first = row["first_turn"]
                later = first is not None and (turn is not None, turn or 0) > (first["named"], first["turn"] or 0)
                held.append({"role": row["role"], "text": row["text"], "again": later or same == before})
                chars, before = chars + len(row["text"]), same
        if held:
            yield close(False)

    return materialize(ranged.mapInArrow(run, _SEGMENT), "conv-segments")


def facts(rows: list[dict]) -> dict:
    """Counts of faults and of adjacent roles that the grammar has nowhere, and the initials at both ends."""
    faults = [fault(r) for r in rows]
    initials = [r["role"][:1] for r in rows]
    return {
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(illegal(x, y) for x, y in zip(initials[:-1], initials[1:], strict=True)), "left": initials[0], "right": initials[-1],
    }


def illegal(x: str, y: str) -> bool:
    return x + y not in ("su", "ua", "au")


def parsed(parser: Parser, rows: list[dict], start: int) -> Best:
    """Tops after a segment's rows, read from one stack."""
    tops: Best = {start: (0, "")}
    for r in rows:
        f = fault(r)
        tops = parser.read(tops, r["role"][:1], f in ("blank", "duplicate"), TRUNCATED if f == "truncated" else 0)
    return tops


def written(turns: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in turns).encode()


def ready() -> Parser:
    """A parser whose stacks have the same numbers in every task."""
    parser = Parser()
    parser.reachable()
    return parser


def gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def repaired_whole(found: DataFrame) -> DataFrame:
    """Results of conversations that are one segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = ready()
        for b in batches:
            out = []
            for s in b.to_pylist():
                cost, audit = parser.final(parsed(parser, s["rows"], parser.bottom))
                turns, _ = parser.edited(parser.bottom, audit, s["rows"])
                f = facts(s["rows"])
                out.append([s["conv_id"], gaps(s["first_turn"], s["last_turn"], s["turns"]), *(f[k] for k in _COUNTS), cost, audit, hashlib.sha256(written(turns)).hexdigest()])
            yield _batch(out, _RESULT)

    return found.where("whole").mapInArrow(run, _RESULT)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[list], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


_MOVES = pa.list_(pa.struct([("start", pa.int32()), ("top", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_SLICE = "key string, conv_id long, part int, nth int, at int, audit string, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


class Fold:
    """Segments of one conversation put together in order: the best way to every top, with what all ways have in common set aside."""

    def __init__(self, parser: Parser, conv: int | None) -> None:
        self.parser, self.conv = parser, conv
        self.tops: dict[int, tuple[int, str, tuple]] = {parser.bottom: (0, "", ())}
        self.keys: list[tuple[str, int, int]] = []
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = self.right = None
        self.turns = 0

    def add(self, s: dict) -> None:
        best: dict[int, tuple[int, str, tuple]] = {}
        for m in s["moves"]:
            if m["start"] in self.tops:
                cost, audit, way = self.tops[m["start"]]
                cost, audit = cost + m["cost"], audit + m["audit"]
                if m["top"] not in best or (cost, audit) < best[m["top"]][:2]:
                    best[m["top"]] = cost, audit, (way, m["start"], m["audit"])
        audits = [a for _, a, _ in best.values()]
        low, high = min(audits), max(audits)
        n = next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
        self.tops = {t: (c, a[n:], w) for t, (c, a, w) in best.items()}
        self.keys.append((s["key"], s["part"], s["nth"]))
        for k in _COUNTS:
            self.counts[k] += s[k]
        if self.right is not None:
            self.counts["illegal"] += illegal(self.right, s["left"])
        self.right = s["right"]
        if s["first_turn"] is not None:
            self.turns += s["turns"] - (s["first_turn"] == self.last)
            self.first, self.last = s["first_turn"] if self.first is None else self.first, s["last_turn"]

    def slices(self) -> Iterator[list]:
        """A row of _SLICE for each segment; insertions at the end are in the last."""
        ends = {}
        for top, (cost, audit, way) in self.tops.items():
            for to, (more, inserts) in self.parser.inserted({top: (0, "")}).items():
                if self.parser.accepts(to) and (not ends or (cost + more, audit + inserts) < ends["best"]):
                    ends = {"best": (cost + more, audit + inserts), "way": way, "inserts": inserts}
        way, pieces = ends["way"], []
        while way:
            way, start, audit = way
            pieces.append((start, audit))
        for i, ((key, part, nth), (start, audit)) in enumerate(zip(self.keys, reversed(pieces), strict=True)):
            last = i == len(self.keys) - 1
            yield [key, self.conv, part, nth, start, audit + ends["inserts"] * last, last, gaps(self.first, self.last, self.turns), *self.counts.values(), ends["best"][0]]


def slices(found: DataFrame) -> DataFrame:
    """(key, conv_id, part, nth, at, audit, last, ..): of conversations in several segments the edits of each segment, and the stack they start from.

    Segments are parsed side by side from every stack; what is put together in order are their costs and edits, one segment after the other.
    """
    schema = "key string, conv_id long, part int, nth int, turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, left string, right string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = ready()
        starts = parser.reachable()
        for b in batches:
            out, moves = [], []
            for s in b.to_pylist():
                f = facts(s["rows"])
                out.append([*(s[k] for k in ("key", "conv_id", "part", "nth", "turns", "first_turn", "last_turn")), *(f[k] for k in (*_COUNTS, "left", "right"))])
                moves.append([{"start": a, "top": t, "cost": c, "audit": x} for a in starts for t, (c, x) in parsed(parser, s["rows"], a).items()])
            part = _batch(out, schema)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(moves, _MOVES)], [*part.schema.names, "moves"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, held = ready(), None
        for b in batches:
            for s in b.to_pylist():
                if held is None or held.conv != s["conv_id"]:
                    if held:
                        yield from (_batch([r], _SLICE) for r in held.slices())
                    held = Fold(parser, s["conv_id"])
                held.add(s)
        if held:
            yield from (_batch([r], _SLICE) for r in held.slices())

    moved = found.where("not whole").mapInArrow(parse, schema + ", moves array<struct<start:int,top:int,cost:long,audit:string>>")
    order = ["conv_id", "part", "nth"]
    return materialize(moved.repartition(shuffle_partitions(found.sparkSession), "conv_id").sortWithinPartitions(*order).mapInArrow(fold, _SLICE), "conv-slices")


def edited_pieces(found: DataFrame, cut: DataFrame) -> DataFrame:
    """(conv_id, part, nth, piece) of conversations in several segments: what each segment becomes, as bytes without the line end after it, null where nothing is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = ready()
        for b in batches:
            for s in b.to_pylist():
                turns, _ = parser.edited(s["at"], s["audit"], s["rows"])
                yield _batch([[s["conv_id"], s["part"], s["nth"], written(turns) if turns else None]], "conv_id long, part int, nth int, piece binary")

    rows = found.where("not whole").select("key", "rows").join(cut.select("key", "conv_id", "part", "nth", "at", "audit"), "key")
    return rows.mapInArrow(run, "conv_id long, part int, nth int, piece binary")


def repaired_cut(found: DataFrame) -> DataFrame:
    """Results of conversations in several segments."""
    cut = slices(found)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = conv = None
        audit, empty = [], True

        def end(s: dict) -> list:
            return [s["conv_id"], *(s[k] for k in ("gaps", *_COUNTS, "cost")), "".join(audit), held.hexdigest()]

        for b in batches:
            for s in b.to_pylist():
                if held is None or s["conv_id"] != conv:
                    held, conv, audit, empty = hashlib.sha256(), s["conv_id"], [], True
                audit.append(s["audit"])
                if s["piece"] is not None:
                    held.update(s["piece"] if empty else b"\n" + s["piece"])
                    empty = False
                if s["last"]:
                    yield _batch([end(s)], _RESULT)

    pieces = edited_pieces(found, cut).select("part", "nth", F.col("conv_id").alias("_conv"), "piece")
    near = F.col("conv_id").eqNullSafe(F.col("_conv")) & (cut["part"] == pieces["part"]) & (cut["nth"] == pieces["nth"])
    rows = cut.join(pieces, near).select("conv_id", cut["part"], cut["nth"], "audit", "last", "gaps", *_COUNTS, "cost", "piece")
    return rows.repartition(shuffle_partitions(found.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "nth").mapInArrow(digest, _RESULT)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of the conversations among rows (conv_id, turn, role, text)."""
    found = segments(rows)
    return repaired_whole(found).unionByName(repaired_cut(found))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, place counting from 0 in each."""
    found = segments(rows)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = ready()
        for b in batches:
            for s in b.to_pylist():
                audit = parser.final(parsed(parser, s["rows"], parser.bottom))[1] if s["audit"] is None else s["audit"]
                turns, _ = parser.edited(parser.bottom if s["at"] is None else s["at"], audit, s["rows"])
                yield _batch([[s["conv_id"], s["part"], s["nth"], i, *t] for i, t in enumerate(turns)], schema)

    schema = "conv_id long, part int, nth int, i long, role string, text string"
    done = found.join(slices(found).select("key", "at", "audit"), "key", "left").select("conv_id", "part", "nth", "rows", "at", "audit").mapInArrow(edit, schema)
    done = materialize(done, "conv-turns")
    sizes = done.groupBy("conv_id", "part", "nth").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part", "nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per segment
    starts = sizes.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("nth").alias("_nth"), before.alias("before"))
    near = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("nth") == F.col("_nth"))
    return done.join(starts, near).select("conv_id", (F.col("before") + F.col("i")).alias("place"), "role", "text")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    rows = table(spark, sf_dir, "conversations")
    done = repair(damaged(rows))
    every = rows.select(F.col("conv_id").cast("long").alias("_conv")).distinct()
    zero = F.lit(0).cast("long")
    numbers = [F.coalesce(c, zero).alias(c) for c in ("gaps", *_COUNTS, "cost")]
    return every.join(done, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_conv").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
