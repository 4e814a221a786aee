"""Conversation repair against a plain recursion over whole audit texts."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from oracle_check import compare, duck

from fxledger.llm import conversations as C
from fxledger.llm.queries import op13_conversation_repair, oracle_sql
from fxledger.llm.shipping import ship

sys.setrecursionlimit(20_000)
SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}


def damaged(rows):
    """(conv, turn, role, text) after damage, and every conversation."""
    out, convs = [], set()
    for conv, turn, role, text in rows:
        convs.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        hit = zlib.crc32(name.encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0, 1, 1, 2)[min(hit, 3)] if hit < 4 else [(conv, turn, role, text)]
    return out, convs


def best(rows):
    """(cost, audit, lines): all edits tried, whole audits compared as texts."""
    faults, seen = [], set()
    for role, text in rows:
        said = text.rstrip(SPACE)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen
                      else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    full = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def go(i, state, inserted):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            for who in "ua":
                if (state, who) in move:
                    c, a, t = go(i, who, inserted + 1)
                    found.append((c + 3, "I" + a, ((full[who], ""), *t)))
        if i < len(rows):
            c, a, t = go(i + 1, state, 0)
            found.append((c + 4, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                who = rows[i][0][:1]
                if (state, who) in move:
                    c, a, t = go(i + 1, who, 0)
                    found.append((c + extra, "K" + a, (rows[i], *t)))
                for to in "ua":
                    if (state, to) in move:
                        c, a, t = go(i + 1, to, 0)
                        found.append((c + 3 + extra, "R" + a, ((full[to], rows[i][1]), *t)))
        return min(found) if found else (10**9, "", ())

    return go(0, "", 0), faults


def brute(rows, damage=True):
    rows, convs = damaged(rows) if damage else (rows, {r[0] for r in rows})
    out = {}
    for conv in convs:
        mine = sorted((r[1:] for r in rows if r[0] == conv),
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in mine if t is not None]
        (cost, audit, lines), faults = best([r[1:] for r in mine])
        first = [r[1][:1] for r in mine]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(a + b not in LEGAL for a, b in zip(first, first[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


def awkward(seed=3, n=160):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "assist", "Uncle"]
    texts = ["Yes.", "No!", "So?", "cut off", "", " \t", "trail. \n", "é日.", None, "a.\x85"]
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([None, *range(7)]), rng.choice(roles), rng.choice(texts)))
    rows += rows[:60]  # repeated rows
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows, damage=True, parts=None, schema=SCHEMA, **limits):
    df = ship(spark).createDataFrame(rows, schema).repartition(5)
    fixed = C.repair(C.damage(df) if damage else df, **limits)
    assert fixed.where("part is not null").count() >= (parts or 0)
    got = C.digest(fixed).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                                               "audit", "repaired_sha256")) for r in got}


def test_weights_find_the_least_audit():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b.", "c", "", "d!"]))
                for _ in range(rng.randint(0, 8))]
        (cost, audit, lines), _ = best(rows)
        part, seen = C.Part(), set()
        for role, text in rows:
            part.add(None, role, text, (role, text) in seen)
            seen.add((role, text))
        assert C.solve(part.codes)[C.START] == (cost, audit), rows
        assert tuple(C.follow(part.codes, part.rows, audit, C.START)[0]) == lines


def test_costs_behind_a_part_decide_as_the_whole():
    rng = random.Random(2)
    for _ in range(200):
        codes = [rng.choice([0, 1, 2, 3, 2, 3, 6, 7, 8]) for _ in range(rng.randint(2, 12))]
        k = rng.randint(1, len(codes) - 1)
        m = C.matrix(codes[k:])
        end = C._behind_last(0)
        behind = [min(m[x][y] + end[y] for y in range(4)) for x in range(4)]
        rows = [("r", "t")] * len(codes)
        head, tail = C.solve(codes[:k], behind), C.solve(codes[k:])
        for x in range(4):
            cost, audit = head[x]
            _, _, state = C.follow(codes[:k], rows, audit, x)
            assert (cost, audit + tail[state][1]) == C.solve(codes)[x]


def test_matches_brute_force(spark):
    rows = awkward()
    assert run(spark, rows) == brute(rows)


def test_without_damage_and_with_other_columns(spark):
    rows = [r for r in awkward(8, 40)]
    wide = [(*r, "x", 1, "y") for r in rows]
    got = run(spark, wide, False, schema=SCHEMA + ", part string, cost int, audit string")
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == brute(plain, False)


def test_hot_conversation_is_split(spark):
    rng = random.Random(4)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", f"c{i % 90}.", ""]))
            for i in range(400)]
    rows += [(7, None, "user", "again.")] * 50 + [(i, 0, "user", "hello.") for i in range(30)]
    want = brute(rows, False)
    assert run(spark, rows, False, parts=20, part_rows=16) == want


def test_empty_table_dropped_rows_and_long_text(spark):
    df = ship(spark).createDataFrame([], SCHEMA)
    assert C.digest(C.repair(C.damage(df))).count() == 0
    dropped = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(*dropped, "user", "gone."), (1001, 1, "user", "word " * 200_000 + "."),
            (1001, 2, "assistant", "x" * 300_000)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert got[dropped[0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_turns_are_legal(spark):
    rows = [(c, t, r, x) for c, t, r, x in awkward(9, 60)]
    fixed = C.repair(ship(spark).createDataFrame(rows, SCHEMA)).cache()
    roles = {}
    for r in sorted(C.turns(fixed).collect(), key=lambda r: (str(r["conv_id"]), r["part"] or 0, r["pos"])):
        roles.setdefault(r["conv_id"], []).append(r["role"][0])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in roles.values())


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in ship(spark).read.parquet(f"{SF}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                                              "audit", "repaired_sha256"))
           for r in op13_conversation_repair(spark, SF).collect()}
    assert got == brute(rows)


@pytest.mark.skipif("op13_conversation_repair" not in oracle_sql(), reason="no SQL")
def test_query_matches_sql(spark):
    assert compare(spark, duck(SF), op13_conversation_repair, oracle_sql()["op13_conversation_repair"], SF) > 0
