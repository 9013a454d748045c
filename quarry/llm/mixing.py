"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, exclusive_sum, global_row_number, key_of, settle, table

#: Buckets of the shuffled order and of finish times, each of them summed on its own: one for so many rows, within bounds,
#: so that no task has many and the buckets' totals, which are broadcast once, stay below some 50 MB.
ROWS_A_BUCKET, BUCKETS = 50_000, (4096, 1 << 20)


def targets(sources: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """source, source_size -> and its ordinal and target: weights in turn by code point (null last) share all sizes.

    A target stops at repeats times its source's size; what is left over is shared by weight among the others
    until none is above. Only sums go to the driver.
    """
    ranked = global_row_number(sources, [F.col("source").isNull(), F.col("source")], "ordinal")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = settle(ranked.withColumn("weight", F.element_at(cycle, (F.col("ordinal") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * repeats))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = 0.0, F.lit(False)
    while True:
        capped, weight = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if not weight:
            break
        level = float(total - capped) / float(weight)
        above = full | (F.col("weight") * F.lit(level) > F.col("cap"))
        if not ranked.where(above & ~full).limit(1).count():
            break
        full = above
    return ranked.select("source", "source_size", "ordinal", F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, __q_text, size, source_size, target and taken for every row of docs.

    Each source's documents stand in a shuffled order (by a digest of id and text), up to repeats times over; a
    copy's virtual finish time is the words of its source up to its end, divided by the source's target. All
    copies, sorted by finish time, are taken until the budget, the words of all documents, is used up; the copy
    that crosses it is cut there. taken is the words taken over all copies of a document.

    A null or blank text has size 0 and gives no words; null sources are one source, the last; null doc_ids and
    repeated rows count like others (each repeated row may be taken repeats times); ties of finish time go by the
    source's place and the shuffled order; other columns are left out; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__q_text"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("h"),
    )
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    by_source = settle(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats))
    same = rows.source.eqNullSafe(by_source.source)
    rows = rows.join(by_source, same).select(rows["*"], "source_size", "ordinal", "target")
    buckets = max(BUCKETS[0], min(BUCKETS[1], 1 << (rows.count() // ROWS_A_BUCKET).bit_length()))
    step = (1 << 60) // buckets
    rows = exclusive_sum(rows, ["ordinal"], F.floor(F.col("h") / step), ["h", "doc_id", "size", "row"], "size", "before")
    copies = rows.select("row", "ordinal", "h", "size", "doc_id", "target", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy"), "before", "source_size")
    end = F.col("copy") * F.col("source_size") + F.col("before") + F.col("size")
    copies = copies.where("target > 0").withColumn("finish", end.cast("double") / F.col("target"))
    order = ["finish", "ordinal", "copy", "h", "doc_id", "size", "row"]
    total = by_source.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("long")).first()[0]
    # buckets that begin after the budget is used up take nothing; few copies finish late within it
    copies = exclusive_sum(copies, [], F.floor(F.least(F.col("finish"), F.lit(2.0)) * buckets), order, "size", "used", total)
    got = copies.withColumn("got", F.greatest(F.lit(0), F.least(F.col("size"), F.lit(total) - F.col("used")))).groupBy("row").agg(F.sum("got").alias("taken"))
    return rows.join(got, "row", "left").select("doc_id", "__q_text", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with docs' columns: taken / size whole copies of a document, then one cut to what is left.

    n_chars, if there is one, follows the text. Documents of which nothing is taken are left out, so are texts
    without words. Rows equal in id and text are told apart by nothing: each stands for its own copies.
    """
    taken = mix(docs, **how).where("taken > 0").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__q_id"), "__q_text", "size", "taken")
    once = taken.groupBy("__q_id", "__q_text").agg(F.sort_array(F.collect_list(F.struct("size", "taken"))).alias("__q_all"))
    keyed = docs.select("*", *key_of()).join(once, ["__q_id", "__q_text"])
    nth = F.row_number().over(W.partitionBy("__q_id", "__q_text").orderBy("__q_id"))
    keyed = keyed.withColumn("__q_one", F.get(F.col("__q_all"), nth - 1)).where("__q_one is not null")
    whole = F.expr("__q_one.taken div __q_one.size")
    rest = F.expr("__q_one.taken % __q_one.size")
    sizes = F.concat(F.array_repeat(F.col("__q_one.size"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    out = keyed.withColumn("__q_words", F.explode(sizes))
    # pieces that end with a word: the text is split before the white space that follows one
    head = F.array_join(F.slice(F.split("text", "(?<=[^ \\t-\\r])(?=[ \\t-\\r])"), F.lit(1), F.col("__q_words").cast("int")), "")
    out = out.withColumn("text", F.when(F.col("__q_words") < F.col("__q_one.size"), head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; nulls, ties and repeats as in mix()."""
    return mix(table(spark, sf_dir, "documents")).drop("__q_text")


OP2_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  , row_number() OVER () AS rid FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ordinal FROM sums),
weighed AS (SELECT *, (ordinal % 3 + 1)::BIGINT AS weight FROM ranked),
steps AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
         row_number() OVER w AS n
  FROM weighed WINDOW w AS (ORDER BY cap::DOUBLE / weight, ordinal)),
free AS (SELECT min(n) AS n, arg_min(level, n) AS level FROM steps WHERE weight * level <= cap),
aims AS (
  SELECT s.source, s.source_size, s.ordinal,
         CASE WHEN s.n < f.n OR f.n IS NULL THEN s.cap::DOUBLE ELSE s.weight * f.level END AS target
  FROM steps s CROSS JOIN free f),
placed AS (
  SELECT d.*, a.source_size, a.ordinal, a.target,
         coalesce(sum(d.size) OVER (PARTITION BY a.ordinal ORDER BY h, doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source),
copies AS (
  SELECT p.*, c.copy, (c.copy * source_size + before + size)::DOUBLE / target AS finish
  FROM placed p CROSS JOIN (VALUES (0), (1), (2)) c(copy) WHERE target > 0),
queued AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY finish, ordinal, copy, h, doc_id, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM copies),
got AS (
  SELECT rid, sum(greatest(0, least(size, (SELECT sum(size) FROM docs) - used))) AS taken FROM queued GROUP BY rid)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(g.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN got g USING (rid)
"""
