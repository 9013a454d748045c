"""Cover density: how often, and how close together, a query's terms stand in a chunk, by the positions of its tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import Lexical, Weights
from .shared import let, sent, settle

# A text-search vector keeps positions up to this one, and so many of each word.
LAST_POSITION, MOST_POSITIONS = 16383, 255
# Fixed value: the weight of a position without a label.
WEIGHT = 0.1


def positions(chunks: DataFrame, terms: DataFrame | None = None, scope: list[str] | None = None) -> DataFrame:
    """(*scope, chunk_id, ord, term, at): where each term stands, from 1, ascending; of `terms` only, if they are given.

    Positions beyond LAST_POSITION count as that one, and a term keeps its first MOST_POSITIONS of a chunk.
    """
    keys = [*(scope or []), "chunk_id", "ord"]
    rows = chunks.select(*keys, F.posexplode("tokens").alias("pos", "term"))
    if terms is not None:
        rows = rows.join(terms, [*(scope or []), "term"], "left_semi")
    at = F.slice(F.array_sort(F.collect_set(F.least(F.col("pos") + 1, F.lit(LAST_POSITION)))), 1, MOST_POSITIONS)
    return rows.groupBy(*keys, "term").agg(at.alias("at"))


def covers(lists: Column) -> Column:
    """The covers of several ascending lists of positions, one a term: (begin, end, held) of each stretch that has a
    position of every list and no shorter such stretch within it; held counts the positions of any list in it.

    The stretch that ends at a position begins at the earliest of the lists' last positions up to there; of those that
    begin at one position the first to end is a cover.
    """
    last = lambda p: F.array_min(F.transform(lists, lambda at: F.coalesce(F.array_max(F.filter(at, lambda x: x <= p)), F.lit(0))))

    def sweep(every: Column) -> Column:
        ends = F.transform(F.array_distinct(every), lambda p: F.struct(last(p).alias("begin"), p.alias("end")))
        moved = let(ends, lambda e: F.filter(e, lambda x, i: (x["begin"] > 0) & ((i == 0) | (F.get(e, F.greatest(i - 1, F.lit(0)))["begin"] != x["begin"]))))
        held = lambda x: F.size(F.filter(every, lambda p: (p >= x["begin"]) & (p <= x["end"])))
        return F.transform(moved, lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), held(x).alias("held")))

    return let(F.array_sort(F.flatten(lists)), sweep)


def density(found: Column) -> Column:
    """The rank of covers: each gives WEIGHT over one more than the other words that stand in it."""
    noise = lambda c: (c["end"] - c["begin"]) - (c["held"] - 1)
    # several words at the last position make a cover shorter than what it holds
    other = lambda c: F.when(noise(c) < 0, F.floor((c["held"] - 1) / 2)).otherwise(noise(c))
    return F.aggregate(found, F.lit(0.0), lambda s, c: s + F.lit(WEIGHT) / (other(c) + 1))


def cover_density(chunks: DataFrame, queries: DataFrame, need: str = "any", scope: list[str] | None = None) -> DataFrame:
    """(query_id, chunk_id, ord, score) of every chunk that holds any of a query's distinct terms, or all of them.

    Of alternatives (need "any") every kept position is a cover of its own, so the rank is WEIGHT for each; of terms
    that must all be there ("all") covers are the shortest stretches that have each. scope names columns that chunks and
    queries share. Queries without terms, and chunks without tokens, give no rows.
    """
    if need not in ("any", "all"):
        raise ValueError(f"unknown need {need}")
    by = scope or []
    asked = settle(queries.select("query_id", *by, F.explode(F.array_distinct("terms")).alias("term")))
    found = settle(positions(chunks, sent(asked.select(*by, "term").distinct()), by))
    both = found.join(sent(asked), [*by, "term"])
    if need == "any":
        return both.groupBy("query_id", "chunk_id").agg(F.min("ord").alias("ord"), (F.sum(F.size("at")) * WEIGHT).alias("score"))
    wanted = asked.groupBy("query_id").agg(F.count("*").alias("terms"))
    whole = both.groupBy("query_id", "chunk_id").agg(F.min("ord").alias("ord"), F.collect_list("at").alias("lists"))
    whole = whole.join(sent(wanted), "query_id").where(F.size("lists") == F.col("terms"))
    return whole.select("query_id", "chunk_id", "ord", density(covers(F.col("lists"))).alias("score"))


class Spots(Weights):
    """A term weighs as many positions as are kept of it."""

    UNIT = WEIGHT

    def counts(self, batch):
        return self.terms.spots(batch, LAST_POSITION, MOST_POSITIONS)

    def weight(self, idf, tf, length, mean):
        return tf


class Matches(Lexical):
    """cover_density() of alternatives (need "any"), scored where chunks are read: positions, and the scores of all chunks
    that hold a term, are never shuffled or written. Ties go to the smaller chunk_id."""

    TIE, WEIGHTS = "chunk_id", Spots

    def _known(self) -> DataFrame:
        return self.asked.select("scope", "term").distinct().withColumns({"idf": F.lit(1.0), "mean": F.lit(1.0)})

    def _scored(self, held: DataFrame) -> DataFrame:
        kept = positions(held.withColumn("ord", F.lit(0)), sent(self.asked), ["query_id", "scope"])
        return kept.groupBy("query_id", "chunk_id").agg((F.sum(F.size("at")) * WEIGHT).alias("score"))
