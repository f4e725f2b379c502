"""Conversation repair against exhaustive search and a plain reading of the rules."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from quire.llm import common, convrepair, queries

SOUND = re.compile(r"(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"


def every_way(symbols, most_inserts=3):
    """(cost, letters, roles) of all edits with up to so many insertions in each gap, unsound ones left out."""
    def options(symbol):
        role, fault = divmod(symbol, 4)
        if fault >= 2:
            return [(4, "D", "")]
        late = 3 * (fault == 1)
        return [(4, "D", ""), (late, "K", "suax"[role]), (3 + late, "R", "u"), (3 + late, "R", "a")]

    gap = [(3 * n, "I" * n, "".join(roles)) for n in range(most_inserts + 1) for roles in itertools.product("ua", repeat=n)]
    pools = [gap]
    for symbol in symbols:
        pools += [options(symbol), gap]
    best = {(0, "", "")}
    for pool in pools:
        best = {(c + d, s + t, r + q) for c, s, r in best for d, t, q in pool}
    return min((c, s, r) for c, s, r in best if SOUND.fullmatch(r))


def test_edits_are_the_least_of_all():
    rng = random.Random(5)
    for n in range(4):
        cases = itertools.product(range(16), repeat=n) if n < 2 else [[rng.randrange(16) for _ in range(n)] for _ in range(120 if n == 2 else 25)]
        for symbols in cases:
            assert convrepair.cheapest_edits(bytes(symbols)) == every_way(symbols, 2 if n < 3 else 1)[:2]


def by_suffix(symbols):
    """(cost, letters) by the rules on suffixes, one row at a time."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    after = [(0, "") if q in (0, 3) else None for q in range(4)]

    def with_inserts(table):
        for _ in range(4):
            for q in range(4):
                for (p, role), to in step.items():
                    if p == q and role != "s" and table[to] is not None:
                        way = (table[to][0] + 3, "I" + table[to][1])
                        table[q] = min(filter(None, [table[q], way]))
        return table

    after = with_inserts(after)
    for symbol in reversed(symbols):
        role, fault = "suax"[symbol // 4], symbol % 4
        now = []
        for q in range(4):
            ways = [(after[q][0] + 4, "D" + after[q][1])] if after[q] else []
            if fault < 2:
                for (p, given), to in step.items():
                    if p == q and after[to] and given == role:
                        ways.append((after[to][0] + 3 * fault, "K" + after[to][1]))
                    if p == q and after[to] and given != "s":
                        ways.append((after[to][0] + 3 * fault + 3, "R" + after[to][1]))
            now.append(min(ways) if ways else None)
        after = with_inserts(now)
    return after[0]


def test_runs_and_blocks_change_nothing(monkeypatch):
    rng = random.Random(6)
    for block in (convrepair.BLOCK, 7):
        monkeypatch.setattr(convrepair, "BLOCK", block)
        for _ in range(60):
            symbols = list(itertools.chain.from_iterable([rng.randrange(16)] * rng.choice([1, 1, 2, 5, 37]) for _ in range(rng.randrange(12))))
            assert convrepair.cheapest_edits(bytes(symbols)) == by_suffix(symbols)


def by_hand(rows):
    """The answer for a list of (conv_id, turn, role, text)."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = found[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, kept in found.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = {r[0] for r in kept} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, symbols = set(), []
        for _, role, text in kept:
            words = text.strip(SPACES)
            fault = 2 if not words else 3 if (role, text) in seen else 1 if words[-1] not in ".!?" else 0
            seen.add((role, text))
            symbols.append(4 * ("sua".index(role[:1]) if role[:1] and role[0] in "sua" else 3) + fault)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = by_suffix(symbols)
        lines, state, rest = [], "", iter(kept)
        for letter in audit:
            given = "a" if state == "u" else "u"
            if letter == "D":
                next(rest)
                continue
            _, role, text = next(rest) if letter != "I" else (0, "", "")
            role = role if letter == "K" else {"u": "user", "a": "assistant"}[given]
            state = role[0]
            lines.append(f"{role}:{text}")
        count = [sum(s % 4 == f for s in symbols) for f in (2, 3, 1)]
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def answer(frame):
    rows = frame.collect()
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_query_is_the_plain_reading(spark, size):
    folder = f"/root/testdata/{size}"
    rows = [tuple(r) for r in common.table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert answer(queries.QUERIES["op13_conversation_repair"](spark, folder)) == by_hand(rows)


def test_odd_conversations(spark):
    """Nulls anywhere, empty and very long texts, repeated rows, odd roles, extra columns with clashing names."""
    long = "so long. " * 300_000
    rows = [(None, 0, "user", "a."), (None, 1, None, "b."), (1, None, "user", None), (1, None, "assistant", "ok."), (1, 5, "system", "late."), (1, 9, "user", long)]
    rows += [(2, 0, "", "x."), (2, 1, "tool", "x."), (2, 2, "User", "x."), (2, 3, "u", "é…"), (2, 4, "assistant", " ."), (2, 5, "assistant", " \t\n")]
    rows += [(3, 0, "user", "same."), (3, 0, "user", "same."), (3, 0, "user", "same."), (3, 7, "user", "same."), (3, -4, "assistant", "x?\n\n")]
    rows += [(4, t, "user", "") for t in range(40)] + [(5, t, "user" if t % 2 else "system", f"{t}") for t in range(300)] + [(6, t, "assistant", "again!") for t in range(300)]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, copies int, audit string")
    damaged = convrepair.damaged(frame)
    reports = convrepair.repairs(damaged)
    want = by_hand(rows)
    assert answer(convrepair.digests(damaged, reports)) == want
    turns = defaultdict(list)
    for r in convrepair.repaired(damaged, reports).orderBy("conv_id", "place").collect():
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}
    none = convrepair.damaged(frame.limit(0))
    assert convrepair.digests(none, convrepair.repairs(none)).count() == 0


def test_a_conversation_without_rows_is_listed(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    damaged = convrepair.damaged(spark.createDataFrame([(conv, 0, "user", "gone.")], "conv_id bigint, turn bigint, role string, text string"))
    assert answer(convrepair.digests(damaged, convrepair.repairs(damaged))) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
