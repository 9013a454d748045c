"""Preference formatting: the common turns of a chosen and a rejected conversation once, then both endings, masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_row_number, settle, table

#: Null turns come before all others.
FIRST = -(2**63)


def pair_conversations(turns: DataFrame) -> DataFrame:
    """(pair_id, conv_id, side, answer_turn, answer) for every conversation; for tables that name no pairs themselves.

    Conversations that open alike, by a digest of their first turn, are paired two by two in order of conv_id; the
    smaller one is the chosen one. Whoever is left over, the last of each opening of odd size, is the chosen side of a
    pair of its own: its rejected side is the same conversation with another text for its last assistant turn
    (answer_turn), that of the next one left over in order of opening. Where that says the same, or there is no other,
    answer is null: the rejected side ends without the turn. A conversation left over without an assistant turn has
    no rejected side. A null role or text counts as empty in a digest, a null conv_id is a conversation, repeated rows
    change nothing, and an empty table gives no pairs.
    """
    place = F.coalesce(F.col("turn").cast("long"), F.lit(FIRST))
    spoken = F.when(F.col("role") == "assistant", F.struct(place.alias("turn"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    each = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("t"), F.max(spoken).alias("said"))
    opening = F.md5(F.concat_ws(":", F.coalesce("t.role", F.lit("")), F.coalesce("t.text", F.lit(""))))
    each = settle(each.select("conv_id", opening.alias("opening"), "said"))
    # one row for each opening, counted before the shuffle; a null conv_id is never the largest unless it is alone
    odd = each.groupBy("opening").agg(F.count("*").alias("size"), F.max("conv_id").alias("last")).where("size % 2 = 1").select("last")
    is_last = each.conv_id.eqNullSafe(odd["last"])
    alike, alone = settle(each.join(odd, is_last, "left_anti").select("conv_id", "opening")), settle(each.join(odd, is_last, "left_semi"))
    order = ["opening", "conv_id"]
    none = [F.lit(None).cast("long").alias("answer_turn"), F.lit(None).cast("string").alias("answer")]
    two = global_row_number(alike, order, "n").select(F.expr("n div 2").alias("pair_id"), "conv_id", F.when(F.col("n") % 2 == 0, "chosen").otherwise("rejected").alias("side"), *none)
    own = settle(global_row_number(alone, order, "n").withColumn("pair_id", F.col("n") + alike.count() // 2).drop("n"))
    asked = own.where("said is not null")
    placed = settle(global_row_number(asked, order, "n"))
    size = placed.count()
    after = placed.select(F.pmod(F.col("n") - 1, F.lit(max(size, 1))).alias("n"), F.col("said.text").alias("other"))
    swapped = placed.join(after, "n").select("pair_id", "conv_id", F.lit("rejected").alias("side"), F.col("said.turn").alias("answer_turn"), F.when(F.col("other") != F.col("said.text"), F.col("other")).alias("answer"))
    return two.unionByName(own.select("pair_id", "conv_id", F.lit("chosen").alias("side"), *none)).unionByName(swapped)


def segments(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (pair_id, segment, turn, part, text, mask_start, mask_length, prompt_turns), one for each rendered turn.

    turns: conv_id, turn, role, text. pairs: pair_id, conv_id, side ('chosen' or 'rejected'), and, if it has them,
    answer_turn and answer as pair_conversations() gives them.

    The prompt of a pair is its longest common prefix of turns: turn numbers, roles and texts alike. It is
    rendered once (segment prompt, no loss); the turns after it are the pair's completions (segments chosen and
    rejected). mask_start and mask_length give the code points of a rendered turn that bear loss: an assistant's
    text and end mark in a completion, else none. Read in order of turn and part, a pair's prompt and one of its
    segments make up a training text.

    Turns stay rows and meet by pair and turn; a pair's first difference is a minimum that is aggregated before the
    shuffle and joined back, where adaptive execution splits a pair of very many turns. A null role or text is
    rendered as empty; a null turn comes first; several rows of one turn are its parts, in order of role and text,
    and repeated rows are one. A pair without a partner has no prompt and only its own side; conversations in no
    pair are left out; a null conv_id is a conversation. Empty tables give no rows; other columns are left out.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    given = [F.col(c) if c in pairs.columns else F.lit(None).cast(k).alias(c) for c, k in (("answer_turn", "long"), ("answer", "string"))]
    p = pairs.select("pair_id", F.col("conv_id").alias("__q_conv"), "side", *given)
    sides = t.join(p, t.conv_id.eqNullSafe(p["__q_conv"])).drop("conv_id", "__q_conv")
    place = F.coalesce("turn", F.lit(FIRST))
    swap = F.coalesce((F.col("role") == "assistant") & (place == F.col("answer_turn")), F.lit(False))
    said = F.struct("role", F.when(swap, F.col("answer")).otherwise(F.col("text")).alias("text"))
    sides = sides.select("pair_id", "side", "turn", said.alias("said")).where("said.text is not null")
    of = lambda side: F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("said"))))
    both = sides.groupBy("pair_id", "turn").agg(of("chosen").alias("chosen"), of("rejected").alias("rejected"))
    differ = F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), place))
    common = F.count(F.when(F.col("chosen").eqNullSafe(F.col("rejected")), 1))
    cut = both.groupBy("pair_id").agg(differ.alias("cut"), common.alias("same"))
    at = both.join(cut, "pair_id").withColumn("common", F.col("cut").isNull() | (place < F.col("cut")))
    prompt = at.groupBy("pair_id").agg(F.count(F.when(F.col("common"), 1)).alias("prompt_turns"))
    segment = lambda name, col: F.struct(F.lit(name).alias("segment"), F.col(col).alias("said"))
    parts = F.when(F.col("common"), F.array(segment("prompt", "chosen"))).otherwise(F.array(segment("chosen", "chosen"), segment("rejected", "rejected")))
    rows = at.select("pair_id", "turn", F.explode(parts).alias("s")).select("pair_id", "turn", "s.segment", F.posexplode("s.said").alias("part", "said"))
    head = F.concat(F.lit("<|im_start|>"), F.col("said.role"), F.lit("\n"))
    text = F.concat(head, F.col("said.text"), F.lit("<|im_end|>\n"))
    loss = (F.col("segment") != "prompt") & (F.col("said.role") == "assistant")
    start = F.when(loss, F.length(head)).otherwise(0).cast("long")
    length = F.when(loss, F.length("said.text") + len("<|im_end|>")).otherwise(0).cast("long")
    rows = rows.select("pair_id", "segment", "turn", F.col("part").cast("long").alias("part"), text.alias("text"), start.alias("mask_start"), length.alias("mask_length"))
    return rows.join(prompt, "pair_id")


def records(rows: DataFrame) -> DataFrame:
    """One row for each pair of segments(): the prompt, both completions, and where each completion bears loss.

    pair_id, prompt_turns, prompt, chosen, rejected, and for each completion the starts and lengths of its loss, in
    code points of the completion. usable: the prompt and both completions hold something and the completions' loss is
    not empty; other pairs stay in the result, marked. A record is as long as its two conversations; for those that
    do not fit a row, segments() has the same by turn. A pair without rows has no record; an empty table gives none.
    """
    item = F.struct(F.coalesce("turn", F.lit(FIRST)).alias("place"), "part", "text", "mask_start", "mask_length")
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("segment") == s, item))).alias(s)
    got = rows.groupBy("pair_id", "prompt_turns").agg(of("prompt"), of("chosen"), of("rejected"))

    def text(s: str) -> Column:
        return F.array_join(F.transform(s, lambda x: x["text"]), "").alias(s)

    def masks(s: str) -> Column:
        # a running sum of rendered lengths: where each turn begins
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("out"))

        def add(done: Column, x: Column) -> Column:
            loss = F.when(x["mask_length"] > 0, F.array(F.struct((done["at"] + x["mask_start"]).alias("start"), x["mask_length"].alias("length")))).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>"))
            return F.struct((done["at"] + F.length(x["text"])).alias("at"), F.concat(done["out"], loss).alias("out"))

        return F.aggregate(s, zero, add, lambda done: done["out"])

    got = got.withColumn("cm", masks("chosen")).withColumn("rm", masks("rejected"))
    list_of = lambda m, f, name: F.transform(m, lambda x: x[f]).alias(name)
    usable = (F.col("prompt_turns") > 0) & (F.size("cm") > 0) & (F.size("rejected") > 0)
    return got.select(
        "pair_id", "prompt_turns", text("prompt"), text("chosen"), text("rejected"),
        list_of("cm", "start", "chosen_starts"), list_of("cm", "length", "chosen_lengths"), list_of("rm", "start", "rejected_starts"), list_of("rm", "length", "rejected_lengths"),
        usable.alias("usable"),
    )


def op8_preference_format(spark, sf_dir: str) -> DataFrame:
    """A record for each pair that pair_conversations() makes of all conversations; null and empty cases as there."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return records(segments(turns, pair_conversations(turns)))


OP8_SQL = """
WITH each_one AS (
  SELECT conv_id, md5(coalesce(arg_min(role, (turn, role, text)), '') || ':' || coalesce(arg_min(text, (turn, role, text)), '')) AS opening,
         max(turn) FILTER (role = 'assistant') AS answer_turn, arg_max(text, (turn, text)) FILTER (role = 'assistant') AS said
  FROM conversations GROUP BY conv_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY opening ORDER BY conv_id) AS i, count(*) OVER (PARTITION BY opening) AS size FROM each_one),
alike AS (
  SELECT conv_id, row_number() OVER (ORDER BY opening, conv_id) - 1 AS n FROM placed WHERE NOT (i = size AND size % 2 = 1)),
alone AS (
  SELECT *, row_number() OVER (ORDER BY opening, conv_id) - 1 + (SELECT count(*) FROM alike) // 2 AS pair_id
  FROM placed WHERE i = size AND size % 2 = 1),
asked AS (
  SELECT *, row_number() OVER (ORDER BY opening, conv_id) - 1 AS n, count(*) OVER () AS all_of FROM alone WHERE answer_turn IS NOT NULL),
pairs AS (
  SELECT n // 2 AS pair_id, conv_id, CASE WHEN n % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, NULL AS answer_turn, NULL AS answer FROM alike
  UNION ALL SELECT pair_id, conv_id, 'chosen', NULL, NULL FROM alone
  UNION ALL SELECT a.pair_id, a.conv_id, 'rejected', a.answer_turn, CASE WHEN b.said != a.said THEN b.said END
  FROM asked a JOIN asked b ON b.n = (a.n + 1) % a.all_of),
said AS (
  SELECT DISTINCT pair_id, side, turn, coalesce(role, '') AS role,
         CASE WHEN role = 'assistant' AND turn = answer_turn THEN answer ELSE coalesce(text, '') END AS text
  FROM conversations JOIN pairs USING (conv_id)),
kept AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, turn ORDER BY role, text) - 1 AS part FROM said WHERE text IS NOT NULL),
whole AS (SELECT pair_id, side, turn, list((role, text) ORDER BY role, text) AS said FROM kept GROUP BY ALL),
differ AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.turn, b.turn) AS turn, a.said IS DISTINCT FROM b.said AS off
  FROM (SELECT * FROM whole WHERE side = 'chosen') a FULL JOIN (SELECT * FROM whole WHERE side = 'rejected') b
  ON a.pair_id = b.pair_id AND a.turn = b.turn),
cuts AS (SELECT pair_id, min(turn) FILTER (off) AS cut FROM differ GROUP BY pair_id),
marked AS (SELECT p.*, cut IS NULL OR turn < cut AS common FROM kept p JOIN cuts USING (pair_id)),
shown AS (
  SELECT pair_id, turn, part, common, CASE WHEN common THEN 'prompt' ELSE side END AS segment, role,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS text, length(text) AS n
  FROM marked WHERE NOT common OR side = 'chosen'),
spots AS (
  SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY pair_id, segment ORDER BY turn, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + length('<|im_start|>' || role) + 1 AS start, NOT common AND role = 'assistant' AS loss FROM shown)
SELECT pair_id, count(DISTINCT turn) FILTER (common) AS prompt_turns,
       coalesce(string_agg(text, '' ORDER BY turn, part) FILTER (segment = 'prompt'), '') AS prompt,
       coalesce(string_agg(text, '' ORDER BY turn, part) FILTER (segment = 'chosen'), '') AS chosen,
       coalesce(string_agg(text, '' ORDER BY turn, part) FILTER (segment = 'rejected'), '') AS rejected,
       coalesce(list(start::BIGINT ORDER BY turn, part) FILTER (segment = 'chosen' AND loss), []) AS chosen_starts,
       coalesce(list((n + 10)::BIGINT ORDER BY turn, part) FILTER (segment = 'chosen' AND loss), []) AS chosen_lengths,
       coalesce(list(start::BIGINT ORDER BY turn, part) FILTER (segment = 'rejected' AND loss), []) AS rejected_starts,
       coalesce(list((n + 10)::BIGINT ORDER BY turn, part) FILTER (segment = 'rejected' AND loss), []) AS rejected_lengths,
       prompt_turns > 0 AND len(chosen_starts) > 0 AND count(*) FILTER (segment = 'rejected') > 0 AS usable
FROM spots GROUP BY pair_id
"""
