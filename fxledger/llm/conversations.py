"""Conversation structure repair: the cheapest edits after which the roles read
``(system? (user assistant)+)?``, by initials, ties to the least audit text.

Every edit path is one integer.  Its high digits are the cost; below them stands a
fixed number of octal digits, one for each edit in order (D 1, I 2, K 3, R 4, in the
order of their letters) with zeros after the last.  So the ordinary minimum of
integers over the paths of a DAG (a node for each row and state of the role pattern)
finds the least cost and, among equals, the least audit, a shorter one before its
extensions.  The program runs from the last row to the first: an edge adds its cost
and its digit in front and moves the digits behind it one place on.

Rows are sorted by range, and a conversation that lies inside one task with at most
``PART_ROWS`` rows is repaired there.  The others (those at the edges of a task, and
long ones, of which one may hold a third of all rows) go on as parts of that many rows:
the (min, +) matrix of a part gives the costs from each state before it to each
state after it, so a pass over these small matrices gives every part the costs behind
it, and the parts are solved on their own, for each state they may begin in.  From
different states or at different places equal costs never meet with the same first
letter, so costs alone decide across parts.  Rows that are equal in every column are
counted before they move, and the earliest row of each (role, text) is found by an
aggregation.

Defined results: null ids make one conversation; null roles and texts are one space
(so the text is blank), and so is a null id or turn in the key of ``damage``;
null turns come first; rows of one turn go by role, then text, byte for byte, so
repeated rows lie together and all but the first are duplicates; a role without one of
the three initials is never kept; an empty table gives an empty result; other columns
are ignored; texts may have any length (a part holds one whole).
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fxledger.llm.memory import freed
from fxledger.session import write_scratch

PART_ROWS = 4096
PART_CHARS = 4 << 20

# Edit costs and the digits of their letters, in ascending order of the letters.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = str.maketrans({str(d): c for c, d in DIGIT.items()})

# States of the pattern: nothing yet, after system, after user, after assistant.  The
# next role that a state takes, but for system at the start, is NEXT; a conversation
# may end at the start or after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ENDS = (0, None, None, 0)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
FINE, CUT, GONE = range(3)  # what a row's fault asks for: nothing, a charge, its deletion

STATS = ("blank", "duplicate", "truncated", "illegal", "cost", "turns")
LINES = "array<struct<role:string,text:string>>"


# -- damage (a query's input, not a part of the repair) ------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``alive``: a fifth of the rows damaged by the
    crc32 of ``conv_id:turn``.  A dropped row stays, as a mark of its conversation
    that is not alive."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    hit = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text, live = shown("text"), hit != 0

    def of_live(c: Column) -> Column:
        return F.when(live, c)

    return rows.select(
        "conv_id", of_live(F.col("turn").cast("long")).alias("turn"),
        of_live(F.when(hit == 4, "user").otherwise(shown("role"))).alias("role"),
        of_live(F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
        .alias("text"), live.alias("alive"),
        F.explode(F.array_repeat(F.lit(0), F.when(hit == 3, 2).otherwise(1))).alias("copy")).drop("copy")


# -- the integer program ----------------------------------------------------------------

def _backward(codes: Sequence[int], v: list[int], width: int) -> list[int]:
    """Least weights from each state before the rows to their end, where they are
    ``v``; ``width`` bits of a weight hold the letters (0: costs alone)."""
    low = (1 << width) - 1

    def weight(cost: int, letter: str) -> int:
        return (cost << width) + (DIGIT[letter] << width - 3 if width else 0)

    delete, insert = weight(DELETE, "D"), weight(INSERT, "I")
    keep = [weight(KEEP, "K"), weight(KEEP + TRUNCATED, "K")]
    rerole = [weight(REROLE, "R"), weight(REROLE + TRUNCATED, "R")]

    def then(edge: int, rest: int) -> int:
        digits = rest & low
        return rest - digits + edge + (digits >> 3)

    for code in reversed(codes):
        who, fault = code & 3, code >> 2
        row = [then(delete, x) for x in v]
        if fault != GONE:
            for x, y in enumerate(NEXT):
                row[x] = min(row[x], then(keep[fault] if who == y else rerole[fault], v[y]))
            if who == SYSTEM:
                row[START] = min(row[START], then(keep[fault], v[SYSTEM]))
        v = _inserts(row, lambda x: then(insert, x))
    return v


def _inserts(v: list[int], insert) -> list[int]:
    """Up to two insertions before what ``v`` weighs (a third only repeats a state)."""
    once = [min(v[x], insert(v[y])) for x, y in enumerate(NEXT)]
    return [min(v[x], insert(once[y])) for x, y in enumerate(NEXT)]


def _behind_last(width: int) -> list[int]:
    """Weights behind the last row: the end, after insertions if need be."""
    far = 1 << width + 60
    top = DIGIT["I"] << width - 3 if width else 0
    low = (1 << width) - 1
    return _inserts([far if e is None else e for e in ENDS],
                    lambda x: x - (x & low) + (INSERT << width) + top + ((x & low) >> 3))


def solve(codes: Sequence[int], behind: Sequence[int] | None = None) -> list[tuple[int, str]]:
    """(cost, audit) of the cheapest edits of the rows, for each state they may begin
    in; ``behind`` are the costs of what follows (none: the end follows)."""
    width = 3 * (3 * len(codes) + 3)
    v = _behind_last(width) if behind is None else [b << width for b in behind]
    return [(x >> width, f"{x & (1 << width) - 1:0{width // 3}o}".rstrip("0").translate(LETTERS))
            for x in _backward(codes, v, width)]


def matrix(codes: Sequence[int]) -> list[list[int]]:
    """Costs from each state before the rows (row) to each one after them (column)."""
    far = 1 << 60
    columns = [_backward(codes, [0 if x == y else far for x in range(4)], 0) for y in range(4)]
    return [[min(c[x], far) for c in columns] for x in range(4)]


def follow(codes: Sequence[int], rows: Sequence[tuple[str, str]], audit: str, state: int):
    """The repaired lines, their cost and the state after the edits."""
    lines, cost, at = [], 0, 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            lines.append((ROLE[state], ""))
            cost += INSERT
            continue
        who, fault = codes[at] & 3, codes[at] >> 2
        if letter == "D":
            cost += DELETE
        else:
            state = SYSTEM if letter == "K" and who == SYSTEM else NEXT[state]
            lines.append((rows[at][0] if letter == "K" else ROLE[state], rows[at][1]))
            cost += (KEEP if letter == "K" else REROLE) + (TRUNCATED if fault == CUT else 0)
        at += 1
    return lines, cost, state


# -- rows of one conversation or part ---------------------------------------------------

_SPACE = " \t\n\x0b\x0c\r"


class Part:
    """Rows in order with what is counted of them."""

    def __init__(self):
        self.codes = bytearray()
        self.rows: list[tuple[str, str]] = []
        self.chars = 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.least = self.most = None

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        said = text.rstrip(_SPACE)
        who = INITIAL.get(role[:1], 0)
        if not said:
            fault, self.blank = GONE, self.blank + 1
        elif seen:
            fault, self.duplicate = GONE, self.duplicate + 1
        elif said[-1] not in ".!?":
            fault, self.truncated = CUT, self.truncated + 1
        else:
            fault = FINE
        if self.last is not None and (self.last, who) not in LEGAL:
            self.illegal += 1
        if self.first is None:
            self.first = who
        self.last = who
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.codes.append(who + 4 * fault)
        self.rows.append((role, text))
        self.chars += len(text)

    def full(self, limit: int) -> bool:
        return len(self.rows) >= limit or self.chars >= PART_CHARS


_LINES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_DONE = [*[(n, pa.int64()) for n in STATS], ("least", pa.int64()), ("most", pa.int64()),
         ("audit", pa.string()), ("lines", _LINES)]
DONE = ", ".join([f"{n} long" for n in (*STATS, "least", "most")] + ["audit string", f"lines {LINES}"])


def _done(part: Part, audit: str, lines: list, cost: int) -> tuple:
    return (part.blank, part.duplicate, part.truncated, part.illegal, cost, part.turns, part.least,
            part.most, audit, [{"role": r, "text": t} for r, t in lines])


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _out(rows: Iterator[tuple], fields: list[tuple], chars) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += chars(r) + 100
        if size >= PART_CHARS or len(held) >= 2000:
            yield _batch(held, fields)
            held, size = [], 0
    if held:
        yield _batch(held, fields)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, 1000).columns], strict=True)


# -- the operator -------------------------------------------------------------------------

def repair(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Repaired conversations of ``conv_id, turn, role, text`` (and, if there, ``alive``:
    rows that only name their conversation where false).

    One row for a conversation (``part`` null), or for each part of one that had
    to be split (``part`` ascending; at most ``part_rows`` rows each): its counts, the audit of its edits, and
    ``lines``, the repaired turns.
    """
    kind = rows.schema["conv_id"].dataType
    if "alive" not in rows.columns:
        rows = rows.withColumn("alive", F.lit(True))
    space = F.lit(" ")
    given = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        *[F.when(F.col("alive"), F.coalesce(F.col(c), space)).alias(c) for c in ("role", "text")])
    counted = given.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    # bounded keys that agree with the order of the rows, so that a turn can be split too
    start = [F.substring(c, 1, 32) for c in ("role", "text")]
    ordered = (counted.repartitionByRange("conv_id", "turn", *start)
               .sortWithinPartitions("conv_id", "turn", "role", "text"))

    arrow = _arrow(kind)
    fields = [("conv_id", arrow), ("open", pa.bool_()), ("at", pa.int64()), ("turn", pa.int64()),
              ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), *_DONE]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        place = (context.partitionId() if context else 0) << 40
        none = (None,) * len(_DONE)

        def conversations() -> Iterator[tuple]:
            held, chars, copies, now, first, whole = [], 0, 0, None, True, False
            n = place

            def opened_rows(rs):
                for at, r in rs:
                    yield (r[0], True, at, *r[1:], *none)

            for r in _rows(batches):
                if n > place and r[0] != now:
                    if whole and not first:
                        yield _whole(now, held)
                    else:
                        yield from opened_rows(held)
                        first = False
                    held, chars, copies = [], 0, 0
                if n == place or r[0] != now:
                    now, whole = r[0], True
                held.append((n, r))
                chars += len(r[2] or "") + len(r[3] or "")
                copies += r[4]
                n += 1
                if whole and (copies > part_rows or chars > PART_CHARS):
                    whole = False
                if not whole:
                    yield from opened_rows(held)
                    held = []
            yield from opened_rows(held)  # the last one may go on in the next task

        yield from _out(conversations(), fields,
                        lambda r: len(r[5] or "") + sum(len(x["text"]) for x in r[-1] or ()))

    key = f"conv_id {kind.simpleString()}"
    found = write_scratch(ordered.mapInArrow(
        freed(local), f"{key}, open boolean, at long, turn long, role string, text string, copies long, {DONE}"),
        "conversations")
    done = [n for n, _ in _DONE]
    whole = found.where(~F.col("open")).select("conv_id", F.lit(None).cast("long").alias("part"), *done)
    split = _split(found.where("open").select("conv_id", "at", "turn", "role", "text", "copies"), kind, arrow,
                   part_rows)
    return whole.unionByName(split.select("conv_id", "part", *done))


def _whole(conv, held: list[tuple]) -> tuple:
    part, seen = Part(), set()
    for _, (_, turn, role, text, copies) in held:
        if role is None:
            continue
        for _ in range(copies):
            part.add(turn, role, text, (role, text) in seen)
            seen.add((role, text))
    cost, audit = solve(part.codes)[START]
    lines, paid, _ = follow(part.codes, part.rows, audit, START)
    assert paid == cost
    return (conv, False, None, None, None, None, None, *_done(part, audit, lines, cost))


def _split(rows: DataFrame, kind: T.DataType, arrow: pa.DataType, part_rows: int) -> DataFrame:
    """The parts of the conversations that no single task holds."""
    key = f"conv_id {kind.simpleString()}"
    name = F.sha2(F.col("text").cast("binary"), 256)
    rows = rows.withColumn("name", F.when(F.col("text").isNotNull(), F.unhex(name)))
    first = (rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("name").alias("m"))
             .agg(F.min("at").alias("first")))
    known = rows.join(first, rows["conv_id"].eqNullSafe(first["c"]) & rows["role"].eqNullSafe(first["r"])
                      & rows["name"].eqNullSafe(first["m"]))
    ordered = (known.select("conv_id", "at", "turn", "role", "text", "copies",
                            (F.col("at") > F.col("first")).alias("seen"))
               .repartitionByRange("at").sortWithinPartitions("at"))

    fields = [("conv_id", arrow), ("part", pa.int64()), ("codes", pa.binary()), ("rows", _LINES),
              ("matrix", pa.list_(pa.int64())),
              *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "turns", "first",
                                          "last", "least", "most")]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        count = itertools.count((context.partitionId() if context else 0) << 40)

        def number() -> int:  # ascending over the tasks too: they hold ranges of ``at``
            return next(count)

        def parts() -> Iterator[tuple]:
            part, conv, begin = None, None, number()

            def close() -> tuple:
                costs = [c for line in matrix(part.codes) for c in line]
                return (conv, begin, bytes(part.codes), [{"role": r, "text": t} for r, t in part.rows], costs,
                        part.blank, part.duplicate, part.truncated, part.illegal, part.turns, part.first,
                        part.last, part.least, part.most)

            for c, at, turn, role, text, copies, seen in _rows(batches):
                if part is not None and c != conv:
                    yield close()
                    part = None
                for k in range(copies if role is not None else 0):
                    if part is not None and part.full(part_rows):
                        yield close()
                        part = None
                    if part is None:
                        part, conv, begin = Part(), c, number()
                    part.add(turn, role, text, seen or k > 0)
                if part is None:  # a mark alone: an empty part
                    part, conv, begin = Part(), c, number()
            if part is not None:
                yield close()

        yield from _out(parts(), fields, lambda r: sum(len(x["text"]) for x in r[3]))

    kept = ("blank long, duplicate long, truncated long, illegal long, turns long, first long, last long, "
            "least long, most long")
    parts = write_scratch(ordered.mapInArrow(
        freed(cut), f"{key}, part long, codes binary, rows {LINES}, matrix array<long>, {kept}"),
        "conversation-parts")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def costs() -> Iterator[tuple]:
            conv, v = None, None
            for c, part, m in _rows(batches):
                last = v is None or c != conv
                if last:
                    conv, v = c, _behind_last(0)
                yield c, part, None if last else v
                v = [min(m[4 * x + y] + v[y] for y in range(4)) for x in range(4)]

        yield from _out(costs(), [("c", arrow), ("p", pa.int64()), ("behind", pa.list_(pa.int64()))],
                        lambda r: 0)

    behind = (parts.select("conv_id", "part", "matrix").repartition("conv_id")
              .sortWithinPartitions("conv_id", F.desc("part"))
              .mapInArrow(freed(back), f"c {kind.simpleString()}, p long, behind array<long>"))
    ready = (parts.join(behind, (parts["part"] == behind["p"]) & parts["conv_id"].eqNullSafe(behind["c"]))
             .select(*parts.columns, "behind"))
    solved_fields = [*fields[:4], *fields[5:], ("audits", pa.list_(pa.string()))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _out(((*r[:4], *r[5:-1], [a for _, a in solve(r[2], r[-1])]) for r in _rows(batches)),
                        solved_fields, lambda r: sum(len(x["text"]) for x in r[3]))

    solved = (ready.mapInArrow(freed(each), f"{key}, part long, codes binary, rows {LINES}, {kept}, "
                                            "audits array<string>")
              .repartition("conv_id").sortWithinPartitions("conv_id", "part"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen() -> Iterator[tuple]:
            conv, state, before, most = None, None, None, None
            for (c, at, codes, rs, blank, duplicate, truncated, illegal, turns, first, last, least, top,
                 audits) in _rows(batches):
                if state is None or c != conv:
                    conv, state, before, most = c, START, None, None
                audit = audits[state]
                lines, cost, state = follow(codes, [(r["role"], r["text"]) for r in rs], audit, state)
                if before is not None and first is not None and (before, first) not in LEGAL:
                    illegal += 1
                if most is not None and most == least:
                    turns -= 1
                before, most = (last if last is not None else before), (top if top is not None else most)
                yield (c, at, blank, duplicate, truncated, illegal, cost, turns, least, top, audit,
                       [{"role": r, "text": t} for r, t in lines])

        yield from _out(chosen(), [("conv_id", arrow), ("part", pa.int64()), *_DONE],
                        lambda r: sum(len(x["text"]) for x in r[-1]))

    return solved.mapInArrow(freed(choose), f"{key}, part long, {DONE}")


def turns(repaired: DataFrame) -> DataFrame:
    """The repaired conversations, a row for each turn: conv_id, part, pos (from 0 in
    its part), role, text."""
    return repaired.select("conv_id", "part", F.posexplode("lines").alias("pos", "line")).select(
        "conv_id", "part", "pos", "line.role", "line.text")


def digest(repaired: DataFrame) -> DataFrame:
    """One row for each conversation: gaps, counts, cost, audit and the SHA-256 of
    its repaired lines.  The parts of a split conversation stream through one hash, in
    order, as SHA-256 asks; a task holds one part at a time."""
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0).cast("long"))
    joined = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
               "repaired_sha256"]
    whole = repaired.where(F.col("part").isNull()).select(
        *[gaps.alias(c) if c == "gaps" else F.sha2(joined.cast("binary"), 256).alias(c)
          if c == "repaired_sha256" else F.col(c) for c in columns])
    kind = repaired.schema["conv_id"].dataType
    split = (repaired.where(F.col("part").isNotNull()).repartition("conv_id")
             .sortWithinPartitions("conv_id", "part"))
    names = split.columns

    arrow = _arrow(kind)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one() -> Iterator[tuple]:
            conv, now = None, None

            def end() -> tuple:
                gap = 0 if now["most"] is None else now["most"] - now["least"] + 1 - now["turns"]
                return (conv, gap, *[now[c] for c in columns[2:7]], "".join(now["audits"]),
                        now["hash"].hexdigest())

            for values in _rows(batches):
                r = dict(zip(names, values, strict=True))
                if now is None or r["conv_id"] != conv:
                    if now is not None:
                        yield end()
                    conv = r["conv_id"]
                    now = dict.fromkeys(STATS, 0) | {"least": None, "most": None, "audits": [], "any": False,
                                                     "hash": hashlib.sha256()}
                for c in STATS:
                    now[c] += r[c]
                if now["least"] is None:
                    now["least"] = r["least"]
                if r["most"] is not None:
                    now["most"] = r["most"]
                now["audits"].append(r["audit"])
                if r["lines"]:
                    text = "\n".join(f"{x['role']}:{x['text']}" for x in r["lines"])
                    now["hash"].update(("\n" * now["any"] + text).encode())
                    now["any"] = True
            if now is not None:
                yield end()

        yield from _out(one(), [("conv_id", arrow), *[(c, pa.int64()) for c in columns[1:7]],
                                ("audit", pa.string()), ("repaired_sha256", pa.string())],
                        lambda r: len(r[-2]))

    schema = (f"conv_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in columns[1:7])
              + ", audit string, repaired_sha256 string")
    return whole.unionByName(split.mapInArrow(freed(fold), schema))
