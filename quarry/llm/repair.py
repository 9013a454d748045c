"""Conversation repair: edits of a conversation's turns as weighted deductions, the lightest derivation by an agenda."""

from __future__ import annotations

import hashlib
import heapq
import itertools
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, scratch, settle, table

#: What the role initials read so far allow: nothing yet, a system turn, a user turn, whole pairs.
START, SYSTEM, USER, PAIRS = range(4)
#: (state, initial) -> state: the grammar (s?(ua)+)?, whose derivations end in START or PAIRS.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (PAIRS, "u"): USER, (USER, "a"): PAIRS}
ENDS = (START, PAIRS)
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"


@dataclass
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


class Agenda:
    """Knuth's agenda: items leave it in order of their weight (cost, audit), each once, with its lightest derivation.

    A deduction makes of finished items a new one that is not lighter than any of them, and no lighter for heavier
    ones: costs add up, and letters go behind the audit of the first antecedent; the others have no audit, or are
    given from the start. Two audits of one item and one cost are never the beginning of each other, as what they
    could differ by, inserts, has a cost; so what follows cannot turn their order around.
    """

    def __init__(self):
        self.waiting, self.weight, self.maker, self.nth = [], {}, {}, itertools.count()

    def offer(self, cost: int, audit: str, item, maker=None) -> None:
        if item not in self.weight:
            heapq.heappush(self.waiting, (cost, audit, next(self.nth), item, maker))

    def finish(self):
        """The next item that has its final weight, or None."""
        while self.waiting:
            cost, audit, _, item, maker = heapq.heappop(self.waiting)
            if item not in self.weight:
                self.weight[item], self.maker[item] = (cost, audit), maker
                return item
        return None


def readings(row: tuple[str, int, bool], costs: Costs):
    """(cost, initial, letter) of what one row may become: nothing, or a turn."""
    initial, extra, goes = row
    yield costs.delete, "", DELETE
    if not goes:
        yield extra, initial, KEEP
        for to in NAMES:
            yield costs.rerole + extra, to, REROLE


def derivations(rows: list[tuple[str, int, bool]], start: int, costs: Costs) -> dict[int, tuple[int, str]]:
    """The lightest (cost, audit) of reading all rows from state start, for each state that it can end in.

    rows: (role initial, surcharge of a row that stays, whether it must go). Items are prefixes (rows read, state),
    and readings of a row, whose weight is a cost alone; a prefix and a reading of the row behind it deduce a longer
    prefix, and an insert deduces the next state of a prefix.
    """
    agenda = Agenda()
    agenda.offer(0, "", (0, start, ""))
    for i, row in enumerate(rows):
        for cost, initial, letter in readings(row, costs):
            agenda.offer(cost, "", (i, initial, letter))
    read, reached, ends = [[] for _ in rows], [[] for _ in rows], {}

    def longer(i: int, state: int, initial: str, letter: str) -> None:
        after = state if letter == DELETE else STEPS.get((state, initial))
        if after is not None:
            cost, audit = agenda.weight[i, state, ""]
            agenda.offer(cost + agenda.weight[i, initial, letter][0], audit + letter, (i + 1, after, ""))

    while (item := agenda.finish()) is not None:
        i, what, letter = item
        if letter:
            read[i].append((what, letter))
            for state in reached[i]:
                longer(i, state, what, letter)
            continue
        cost, audit = agenda.weight[item]
        if i < len(rows):
            reached[i].append(what)
            for reading in read[i]:
                longer(i, what, *reading)
        else:
            ends[what] = (cost, audit)
        for to in NAMES:
            if (what, to) in STEPS:
                agenda.offer(cost + costs.insert, audit + INSERT, (i, STEPS[what, to], ""))
    return ends


def lightest(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """(cost, [(state before, audit) of each block]) of the lightest derivation of a conversation.

    blocks: (from, to, cost, audit) of derivations(), for each block in order. Items are (blocks read, state); a block
    that may be read from its state deduces the next item. The agenda runs until the goal, an item with all blocks
    read and a state that the conversation may end in, has its final weight.
    """
    agenda = Agenda()
    agenda.offer(0, "", (0, START))
    while (item := agenda.finish()) is not None:
        i, state = item
        cost, audit = agenda.weight[item]
        if i == len(blocks):
            if state in ENDS:
                break
            continue
        for before, after, c, letters in blocks[i]:
            if before == state:
                agenda.offer(cost + c, audit + letters, (i + 1, after), (state, letters))
    path = []
    for b in range(len(blocks), 0, -1):
        before, letters = agenda.maker[b, state]
        path.append((before, letters))
        state = before
    return cost, path[::-1]


def edited(rows: list[tuple[str, str]], state: int, audit: str):
    """(edit, role, text) of the repaired turns of one block, read from state by its audit; rows: (role, text)."""
    at = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == INSERT else next(at)
        if letter == DELETE:
            continue
        if letter != KEEP:
            role = next(name for to, name in NAMES.items() if (state, to) in STEPS)
        state = STEPS[state, role[:1]]
        yield letter, role, text


PART = "conv_id long, task int, part int, rows array<struct<role:string,text:string>>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, moves array<struct<before:int,after:int,cost:long,audit:string>>"
CONVERSATION = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, path array<struct<task:int,part:int,state:int,audit:string>>"


def _legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


def _part(conv, rows, task: int, part: int, starts, costs: Costs) -> dict:
    """The row of PART for one block. rows: (turn, role, text, fault)."""
    initials = [role[:1] for _, role, _, _ in rows]
    known = [turn for turn, *_ in rows if turn is not None]
    count = lambda fault: sum(f == fault for *_, f in rows)
    facts = [(i, costs.truncated * (f == "truncated"), f in ("blank", "duplicate")) for i, (*_, f) in zip(initials, rows)]
    moves = [{"before": s, "after": to, "cost": c, "audit": a} for s in starts for to, (c, a) in derivations(facts, s, costs).items()]
    return {
        "conv_id": conv, "task": task, "part": part, "rows": [{"role": r, "text": x} for _, r, x, _ in rows],
        "blank": count("blank"), "duplicate": count("duplicate"), "truncated": count("truncated"), "illegal": sum(not _legal(a + b) for a, b in zip(initials, initials[1:])),
        "first": initials[0], "last": initials[-1], "low": known[0] if known else None, "high": known[-1] if known else None, "turns": len(set(known)), "moves": moves,
    }


def _whole(conv, parts: list[dict]) -> dict:
    """The row of CONVERSATION for the parts of one conversation, in order."""
    total = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    total["illegal"] += sum(not _legal(a["last"] + b["first"]) for a, b in zip(parts, parts[1:]))
    known = [p for p in parts if p["turns"]]
    distinct = total.pop("turns") - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
    gaps = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
    cost, path = lightest([[(m["before"], m["after"], m["cost"], m["audit"]) for m in p["moves"]] for p in parts])
    steps = [{"task": p["task"], "part": p["part"], "state": s, "audit": a} for p, (s, a) in zip(parts, path)]
    return {"conv_id": conv, "gaps": gaps, **total, "cost": cost, "audit": "".join(a for _, a in path), "path": steps}


def faulty(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault) of turns (conv_id, turn, role, text, copies): equal rows are one,
    whose copies add up; fault is that of the first copy: blank, duplicate, truncated or null. The other copies of a
    row that is not blank are duplicates."""
    key = F.md5(F.to_json(F.struct("conv_id", "role", "text"), {"ignoreNullFields": "false"}))
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("__q_k", key)
    rows = settle(rows)
    order = F.struct(F.col("turn").isNotNull(), "turn")
    again = settle(rows.groupBy("__q_k").agg(F.count("*").alias("__q_n"), F.min(order).alias("__q_first")).where("__q_n > 1"))
    known = join_hot(rows, again, ["__q_k"], "__q_n", how="left")
    word = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(word == "", "blank").when(order != F.col("__q_first"), "duplicate").when(~word.isin(".", "!", "?"), "truncated")
    return known.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def repair(turns: DataFrame, costs: Costs = Costs(), block_rows: int = 1024, block_chars: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired turns) of turns: conv_id, turn, role, text, copies (how often a row stands there).

    Conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, as the cheapest edits make its
    role initials (s?(ua)+)? or leave nothing. Repaired turns: conv_id, task, part, n, by which they are in order, edit
    (K, R or I), role, text. Turns are read in order of turn (nulls first), role, text; equal rows are copies. role
    and text must not be null; a null conv_id is a conversation of its own; an empty table gives no rows.

    Rows are sorted over all conversations by ranges, so a long conversation lies in several tasks, in blocks of at
    most block_rows rows and about block_chars characters (one row at least). Each block is one set of deductions
    from any state that it may be read from; blocks, without their texts, meet by conversation, where the agenda
    finds the lightest way through them. An audit is as long as its conversation, so that much is held there.
    """
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = settle(faulty(turns))
    head = F.substring("text", 1, 100)
    placed = rows.repartitionByRange(n, "conv_id", "turn", "role", head).sortWithinPartitions("conv_id", "turn", "role", "text")

    def cut(batches):
        from pyspark import TaskContext

        task, part, held, chars, conv, out = TaskContext.get().partitionId(), 0, [], 0, None, []
        # whether any row was seen, and whether the held block is its conversation's first: it is behind another one in
        # this task, while the first conversation here may go on from the task before
        begun, fresh = False, False

        def close(first: bool):
            out.append(_part(conv, held, task, part, (START,) if first else range(4), costs))

        for batch in batches:
            for c, turn, role, text, copies, fault in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "copies", "fault"))):
                if not begun or c != conv:
                    if held:
                        close(fresh)
                        held, chars, part = [], 0, part + 1
                    fresh, begun, conv = begun, True, c
                for k in range(copies):
                    if held and (len(held) == block_rows or chars + len(text) > block_chars):
                        close(fresh)
                        held, chars, part, fresh = [], 0, part + 1, False
                    held.append((turn, role, text, fault if k == 0 or fault == "blank" else "duplicate"))
                    chars += len(text)
                    if len(out) >= 64 or chars > block_chars // 2 and out:
                        yield pa.RecordBatch.from_pylist(out, schema=kind)
                        out.clear()
        if held:
            close(fresh)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(spark.createDataFrame([], PART).schema)
    path = scratch(spark, "repair")
    placed.mapInArrow(cut, PART).write.parquet(path)
    parts = spark.read.parquet(path)

    def choose(batches):
        for batch in batches:
            found = [_whole(c, p) for c, p in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist())]
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=told)

    told = to_arrow_schema(spark.createDataFrame([], CONVERSATION).schema)
    own = F.struct("task", "part", *[c for c in parts.columns if c not in ("conv_id", "task", "part", "rows")])
    whole = settle(parts.drop("rows").groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("parts")).mapInArrow(choose, CONVERSATION))

    def render(batches):
        for batch in batches:
            out = {c: [] for c in ("conv_id", "task", "part", "n", "edit", "role", "text")}
            for conv, task, part, held, state, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "task", "part", "rows", "state", "audit"))):
                for i, (edit, role, text) in enumerate(edited([(r["role"], r["text"]) for r in held], state, audit)):
                    for c, v in zip(out, (conv, task, part, i, edit, role, text)):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()))], list(out))

    steps = whole.select(F.explode("path").alias("p")).select("p.*")
    turned = parts.select("conv_id", "task", "part", "rows").join(steps, ["task", "part"]).select("conv_id", "task", "part", "rows", "state", "audit")
    return whole.drop("path"), turned.mapInArrow(render, "conv_id long, task int, part int, n int, edit string, role string, text string")


def digests(turned: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired turns: SHA-256 of `role:text` of each, joined by line feeds.

    A digest is one chain over a conversation, so its turns pass through one task, sorted; no more than a batch of
    them is held.
    """

    def run(batches):
        conv, h = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([h.hexdigest()])], ["conv_id", "repaired_sha256"])
        for batch in batches:
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if h is None or c != conv:
                    if h is not None:
                        yield done()
                    conv, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if h is not None:
            yield done()

    n = int(turned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("conv_id", "task", "part", "n")
    return turned.repartition(n, "conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): turns damaged by a checksum of their place; a null stands for one space.

    Of the checksum's twenty remainders 0 drops a row, 1 empties its text, 2 takes its sentence ends away, 3 repeats
    it, 4 makes it the user's.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn"))) % 20
    at = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), some("role").alias("role"), some("text").alias("text"), fate.alias("fate")).where("fate != 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return at.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation after damage and repair: what was wrong, the cheapest edits, and a digest of what they leave.

    Nulls, ties and repeats as in damaged() and repair(); a conversation of which nothing is left has zeros, an empty
    audit and the digest of nothing.
    """
    rows = table(spark, sf_dir, "conversations")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    whole, turned = repair(damaged(rows))
    counts = [c for c in whole.columns if c not in ("conv_id", "audit")]
    told = whole.join(digests(turned).withColumnRenamed("conv_id", "__q_id"), F.col("conv_id").eqNullSafe(F.col("__q_id")), "left").drop("__q_id")
    out = every.withColumnRenamed("conv_id", "__q_id").join(told, F.col("conv_id").eqNullSafe(F.col("__q_id")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts]
    return out.select(F.col("__q_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
