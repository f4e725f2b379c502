"""Conversation structure repair: faults, the cheapest edits by a run-length min-plus program, and the repaired turns."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm import common

REROLE, DELETE, INSERT, LATE = 3, 4, 3, 3
#: Fault of a row, the second half of its symbol; the first half is its role.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
ROLES = "sua"
FAR = 1 << 60
#: States: nothing yet, after system, after user, after assistant.
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The one role that may be inserted or given in each state.
NEXT = "uuau"
NAMES = {"u": "user", "a": "assistant"}
#: Symbols whose costs to go are held at once while choices are unrolled.
BLOCK = 65_536
FIRST = 65  # symbols are letters from A on

Matrix = tuple[tuple[int, ...], ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(x + y for x, y in zip(row, col)), FAR) for col in zip(*b)) for row in a)


def _inserts() -> Matrix:
    """The cheapest way from state to state by insertions alone."""
    out = []
    for state in range(4):
        row, at, cost = [FAR] * 4, state, 0
        while row[at] == FAR:
            row[at] = cost
            at, cost = AFTER[at, NEXT[at]], cost + INSERT
        out.append(tuple(row))
    return tuple(out)


_INSERTS = _inserts()
#: Cost to go behind the last row: insertions until nothing at all or an assistant's turn stands last.
_END = tuple(min(row[0], row[3]) for row in _INSERTS)


def _moves(symbol: int) -> list[dict[str, tuple[int, int]]]:
    """For each state {letter: (next state, cost)} of the edits that this row allows there."""
    role, fault = divmod(symbol, 4)
    if fault in (BLANK, DUPLICATE):
        return [{"D": (state, DELETE)} for state in range(4)]
    late, out = LATE * (fault == TRUNCATED), []
    for state in range(4):
        ways = {"D": (state, DELETE), "R": (AFTER[state, NEXT[state]], REROLE + late)}
        if role < 3 and (state, ROLES[role]) in AFTER:
            ways["K"] = (AFTER[state, ROLES[role]], late)
        out.append(ways)
    return out


MOVES = [_moves(symbol) for symbol in range(16)]


@functools.lru_cache(1024)
def _power(symbol: int, bit: int) -> Matrix:
    """The min-plus transition of 2**bit rows of one symbol, insertions before each row included."""
    if bit:
        half = _power(symbol, bit - 1)
        return _times(half, half)
    rows = [[FAR] * 4 for _ in range(4)]
    for state, ways in enumerate(MOVES[symbol]):
        for to, cost in ways.values():
            rows[state][to] = min(rows[state][to], cost)
    return _times(_INSERTS, tuple(map(tuple, rows)))


def _before(matrix: Matrix, go: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(x + y for x, y in zip(row, go)) for row in matrix)


def _back(symbols: bytes, go: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before these rows, from those behind them: each run advances by powers of its transition."""
    for symbol, run in itertools.groupby(reversed(symbols)):
        length = sum(1 for _ in run)
        for bit in range(length.bit_length()):
            if length >> bit & 1:
                go = _before(_power(symbol, bit), go)
    return go


def _unroll(symbols: bytes, go: tuple[int, ...], state: int, last: bool) -> tuple[str, int]:
    """The least letters of the cheapest edits of a block, and the state behind it."""
    costs = [go]
    for symbol in reversed(symbols):
        costs.append(_before(_power(symbol, 0), costs[-1]))
    costs.reverse()
    letters, at = [], 0
    while at < len(symbols) or last and (state not in (0, 3) or costs[at][state]):
        left = costs[at][state]
        ways = MOVES[symbols[at]][state] if at < len(symbols) else {}
        added = AFTER[state, NEXT[state]]
        for letter in "DIKR":
            if letter == "I" and left == INSERT + costs[at][added]:
                state = added
            elif letter in ways and left == ways[letter][1] + costs[at + 1][ways[letter][0]]:
                state, at = ways[letter][0], at + 1
            else:
                continue
            letters.append(letter)
            break
    return "".join(letters), state


def cheapest_edits(symbols: bytes) -> tuple[int, str]:
    """(cost, letters) of the cheapest edits of rows with these symbols, 4 * role + fault, in their order; of equally
    cheap ones the least string.  Costs to go are kept once a block of BLOCK rows, so memory beyond the rows' bytes
    and the letters themselves doesn't grow."""
    starts = range(0, len(symbols), BLOCK)
    ends = [_END]
    for at in reversed(starts):
        ends.append(_back(symbols[at : at + BLOCK], ends[-1]))
    ends.reverse()
    parts, state = [], 0
    for k, at in enumerate(starts):
        part, state = _unroll(symbols[at : at + BLOCK], ends[k + 1], state, at + BLOCK >= len(symbols))
        parts.append(part)
    return (ends[0][0], "".join(parts)) if len(symbols) else (0, "")


_remembered = functools.lru_cache(1 << 16)(cheapest_edits)


def _legal() -> np.ndarray:
    out = np.zeros((16, 16), bool)
    for a, b in ("su", "ua", "au"):
        i, j = 4 * ROLES.index(a), 4 * ROLES.index(b)
        out[i : i + 4, j : j + 4] = True
    return out


LEGAL = _legal()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as the drill damages them, by crc32 of ``conv_id:turn`` modulo 20:
    0 drops a row (it stays with no copies), 1 empties its text, 2 takes its marks ``.!?`` out, 3 repeats it, 4 makes
    its role user.  Nulls in the key, roles and texts are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(blank("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint")
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds what stands for a text where only equality counts: two hashes."""
    return rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})


ORDER = ["turn", "role", "h1", "h2"]
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h1, h2, symbols): equal rows of a turn together, a letter for each copy."""
    end = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    initial = F.substring("role", 1, 1)
    looks = rows.select("conv_id", *ORDER, "copies", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    equal = looks.groupBy("conv_id", *ORDER).agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    said = ["conv_id", "role", "h1", "h2"]
    # the first of several rows with the same role and text; rows without a turn come before all others
    first = looks.filter("copies > 0").groupBy(*said).agg(F.max(F.col("turn").isNull()).alias("anon"), F.min("turn").alias("least"))
    names = {c: f"_{c}" for c in said}
    first = first.withColumnsRenamed(names)
    both = equal.join(first, [F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "conv_id" else F.col(c) == F.col(f"_{c}") for c in said], "left")
    new = F.when(F.col("anon"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    role = F.coalesce(*[F.when(initial == r, 4 * i) for i, r in enumerate(ROLES)], F.lit(12))
    head = F.when(F.col("blank"), BLANK).when(~new, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    rest = F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)
    letter = lambda fault: F.char(F.lit(FIRST) + role + fault)
    symbols = F.when(F.col("copies") == 0, F.lit("")).otherwise(F.concat(letter(head), F.repeat(letter(rest), (F.col("copies") - 1).cast("int"))))
    return both.select("conv_id", *ORDER, symbols.alias("symbols"))


class _Conversation:
    """Sums of one conversation while its rows pass by in order."""

    def __init__(self, conv: object):
        self.conv, self.letters = conv, []
        self.least = self.last = None
        self.turns = 0

    def add(self, turns: list[int | None], symbols: list[str]) -> None:
        for turn, letters in zip(turns, symbols):
            if letters and turn is not None and turn != self.last:
                self.least = turn if self.least is None else self.least
                self.last, self.turns = turn, self.turns + 1
        self.letters.append("".join(symbols))

    def report(self) -> tuple:
        codes = np.frombuffer("".join(self.letters).encode(), np.uint8) - np.uint8(FIRST)
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        faults = np.bincount(codes % 4, minlength=4).tolist()
        illegal = int((~LEGAL[codes[:-1], codes[1:]]).sum())
        # what must go looks the same whatever its role
        plain = np.where(codes % 4 >= BLANK, 12 + BLANK, codes).astype(np.uint8).tobytes()
        cost, audit = (_remembered if len(plain) <= 64 else cheapest_edits)(plain)
        return self.conv, gaps, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost, audit


def _runs(values: list) -> Iterator[tuple[object, int, int]]:
    """(value, start, end) of neighbouring equal values."""
    at = 0
    for value, run in itertools.groupby(values):
        end = at + sum(1 for _ in run)
        yield value, at, end
        at = end


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def repairs(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit.

    ``rows`` has conv_id, turn, role, text and copies (how often a row stands there; a conversation whose rows all
    have none is listed with zeros and an empty audit); other columns are ignored.  Rows are taken by turn, nulls
    first; different rows of one turn by role and a hash of the text.  A null conv_id is one conversation; null turns
    count for nothing in gaps; equal rows are duplicates of the first; an empty table gives no rows.  Texts, however
    long, don't travel: equality is that of two 64-bit hashes.  A conversation's rows come to one task in sorted order
    as one letter each, no more than its audit must hold anyway, and costs are kept by blocks."""
    kind = rows.schema["conv_id"].dataType
    dealt = _symbols(_keyed(rows)).repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    schema = T.StructType([T.StructField("conv_id", kind), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType())])
    arrow = to_arrow_schema(schema)

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done, turns, symbols = [], batch.column("turn").to_pylist(), batch.column("symbols").to_pylist()
            for value, a, b in _runs(batch.column("conv_id").to_pylist()):
                if now is None or now.conv != value:
                    done += [now.report()] if now else []
                    now = _Conversation(value)
                now.add(turns[a:b], symbols[a:b])
            if done:
                yield _table(done, arrow)
        if now:
            yield _table([now.report()], arrow)

    return dealt.mapInArrow(reports, schema)


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple | None, tuple[str, str] | None]]:
    """(report, None) where a conversation begins, then (None, (role, text)) for each turn of the repaired one."""
    letters, at, state = "", 0, 0

    def inserted() -> Iterator[tuple[None, tuple[str, str]]]:
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            yield None, (NAMES[NEXT[state]], "")
            state, at = AFTER[state, NEXT[state]], at + 1

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "copies", *COUNTS)]
        for conv, audit, role, text, copies, *counts in zip(*columns):
            if audit is not None:
                yield from inserted()
                letters, at, state = audit, 0, 0
                yield (conv, *counts, audit), None
                continue
            for _ in range(copies):
                yield from inserted()
                letter, at = letters[at], at + 1
                if letter == "D":
                    continue
                given = NEXT[state] if letter == "R" else role[:1]
                yield None, (NAMES[given] if letter == "R" else role, text)
                state = AFTER[state, given]
    yield from inserted()


def _beside(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Each conversation's report in front of its rows, in the order in which the report took them."""
    texts = _keyed(rows.filter("copies > 0")).withColumn("audit", F.lit(None).cast("string"))
    both = texts.unionByName(reports, allowMissingColumns=True)
    ahead = F.col("audit").isNull()
    return both.repartition("conv_id").sortWithinPartitions("conv_id", ahead, *ORDER).select("conv_id", "audit", "role", "text", "copies", *COUNTS)


def repaired(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns of the repaired conversations; ``rows`` and odd values as in
    ``repairs``.  Rows stream through a task in order, so a conversation of any length holds only its audit there."""
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *[T.StructField(c, t) for c, t in (("place", T.LongType()), ("role", T.StringType()), ("text", T.StringType()))]])
    arrow = to_arrow_schema(schema)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, done, size = None, 0, [], 0
        for report, turn in _replayed(batches):
            if report:
                conv, place = report[0], 0
                continue
            done.append((conv, place, *turn))
            place, size = place + 1, size + len(turn[1]) + 64
            if size > 4_000_000:
                yield _table(done, arrow)
                done, size = [], 0
        if done:
            yield _table(done, arrow)

    return _beside(rows, reports).mapInArrow(turns, schema)


def digests(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """The reports with ``repaired_sha256``: the hash of each repaired conversation's ``role:text`` lines."""
    fields = [reports.schema["conv_id"], *[reports.schema[c] for c in COUNTS], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, hash_, first, done = None, None, True, []
        for begun, turn in _replayed(batches):
            if begun:
                done += [(*report, hash_.hexdigest())] if report else []
                if len(done) >= 1024:
                    yield _table(done, arrow)
                    done = []
                report, hash_, first = begun, hashlib.sha256(), True
                continue
            hash_.update(f"{'' if first else chr(10)}{turn[0]}:{turn[1]}".encode())
            first = False
        if report:
            done.append((*report, hash_.hexdigest()))
        if done:
            yield _table(done, arrow)

    return _beside(rows, reports).mapInArrow(hashed, schema)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "conversation_repair")
    rows = damaged(common.table(spark, sf_dir, "conversations"))
    return digests(rows, scratch.keep(repairs(rows), "reports"))
