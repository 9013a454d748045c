"""Tests of the repair of conversations, against every derivation and against a plain walk over the table."""

import hashlib
import random
import re
import zlib

import pytest

from quarry.llm import repair

SF = "/root/testdata/sf0.001"
COLS = "conv_id long, turn long, role string, text string, edit string, part int, copies string"


def cheapest(rows, costs=repair.Costs()):
    """(cost, audit) over all sequences of edits, row by row, with up to two inserts before each."""
    best = {repair.START: (0, "")}
    for initial, extra, goes in [*rows, (None, 0, False)]:
        for _ in range(2):
            for state, (cost, audit) in list(best.items()):
                for to in "ua":
                    if (after := repair.STEPS.get((state, to))) is not None:
                        best[after] = min(best.get(after, (1 << 30, "")), (cost + costs.insert, audit + "I"))
        if initial is None:
            return min(best[s] for s in repair.ENDS if s in best)
        then = {}
        for state, (cost, audit) in best.items():
            nexts = [(state, cost + costs.delete, audit + "D")]
            if not goes:
                nexts += [(repair.STEPS.get((state, to)), cost + more + extra, audit + letter) for to, more, letter in [(initial, 0, "K"), ("u", costs.rerole, "R"), ("a", costs.rerole, "R")]]
            for after, c, x in nexts:
                if after is not None:
                    then[after] = min(then.get(after, (1 << 30, "")), (c, x))
        best = then


def plain(table):
    """The query by a loop over conversations. table: (conv_id, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in table:
        own = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for turn, role, text in rows:
            words = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {r[0] for r in rows} - {None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        cost, audit = cheapest([(r[1][:1], 3 * (f == "truncated"), f in ("blank", "duplicate")) for r, f in zip(rows, faults)])
        kept = [f"{role}:{text}" for _, role, text in repair.edited([r[1:] for r in rows], repair.START, audit)]
        out[conv] = {
            "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        }
    return out


def test_agenda_finds_the_cheapest_and_least_audit_in_any_blocks():
    rng = random.Random(5)
    costs = repair.Costs()
    for _ in range(400):
        rows = [(rng.choice("suaauax"), 3 * (rng.random() < 0.3), rng.random() < 0.2) for _ in range(rng.randint(0, 9))]
        cuts = sorted(rng.choices(range(len(rows) + 1), k=rng.randint(0, 3)))
        blocks = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        moves = [[(s, to, c, a) for s in range(4) for to, (c, a) in repair.derivations(b, s, costs).items()] for b in blocks]
        cost, path = repair.lightest(moves)
        assert (cost, "".join(a for _, a in path)) == cheapest(rows)


def test_audits_and_what_they_leave():
    assert cheapest([("u", 0, False)]) == (3, "KI")
    assert cheapest([("s", 0, False)]) == (4, "D")
    assert cheapest([("t", 0, False), ("a", 0, False)]) == (3, "RK")
    assert list(repair.edited([("system", "x"), ("tool", "y")], repair.START, "KRI")) == [("K", "system", "x"), ("R", "user", "y"), ("I", "assistant", "")]


def odd_rows():
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["One.", "two", " \n", "", None, "Three!", "vier "])) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += rows[:40]  # repeated rows
    rows += [(None, t, "user", f"text {t}.") for t in (None, 0, 1, 5)] + [(61, None, "user", "a."), (61, None, "assistant", "b.")]
    rows += [(62, 3, "user", "w " * 300_000 + "end."), (63, 2**40, "assistant", "far."), (63, -5, "user", "Near?")]
    rows += [(64, t, "user" if t % 2 else "assistant", f"turn {t // 9}.") for t in range(1500)]  # most of all rows
    return rows


def test_query_against_a_plain_walk(spark, tmp_path):
    rows = odd_rows()
    wide = [(*r, "x", 1, "y") for r in rows]
    spark.createDataFrame(wide, COLS).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r.asDict() for r in repair.op12_conversation_repair(spark, str(tmp_path)).collect()}
    want = plain(rows)
    assert len(got) == len(want)
    for conv in want:
        assert got[conv] == want[conv], conv


def test_query_on_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: r.asDict() for r in repair.op12_conversation_repair(spark, SF).collect()} == plain(rows)


def test_small_blocks_give_the_same(spark):
    rows = [r for r in odd_rows() if r[0] in (1, 5, 64)]
    df = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole, turned = repair.repair(df, block_rows=7, block_chars=50)
    want = plain(rows)
    assert {r.conv_id: (r.cost, r.audit, r.gaps, r.illegal) for r in whole.collect()} == {c: (w["cost"], w["audit"], w["gaps"], w["illegal"]) for c, w in want.items()}
    assert {r.conv_id: r.repaired_sha256 for r in repair.digests(turned).collect()} == {c: w["repaired_sha256"] for c, w in want.items() if set(w["audit"]) - {"D"}}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLS).write.parquet(str(tmp_path / "conversations.parquet"))
    assert repair.op12_conversation_repair(spark, str(tmp_path)).count() == 0
