"""Substring dedup by line hashing: the earliest occurrence of a unit stays, the others go, offsets are kept."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_hot, key_of, settle, table

#: What the query and the pipeline leave alone: lines of under five words, and runs of under 25 within other lines.
PRODUCTION = {"min_words": 5, "min_run": 25}
PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
SENTENCE = re.compile(r"[.!?\u2026][\"'\u201d\u00bb)\]]*\s+")


def units(text: str, by: str, min_words: int, min_run: int | None) -> list[tuple[int, int, int, int, bool, bytes]]:
    """(line, start, end, words, whole, digest) of the units of a text; positions are code points.

    Whole units are the lines or paragraphs of min_words words (one at least) or more; end takes in the separator. With
    min_run, those of over min_run words are also cut into parts, each of which ends with a sentence of min_words words or more (shorter
    sentences belong to the next one, so where parts begin does not depend on what stands before a passage).
    line is the start of the line or paragraph. A unit is normalised by case folding and joining its words with
    single spaces; equal parts and whole units have equal digests.
    """
    from xxhash import xxh3_128_digest

    out, start = [], 0
    while start < len(text):
        if by == "line":
            stop = text.find("\n", start)
            stop = end = len(text) if stop < 0 else stop
            end += stop < len(text)
        else:
            m = PARAGRAPH.search(text, start)
            stop, end = (m.start(), m.end()) if m else (len(text), len(text))
        body = text[start:stop]
        words = body.casefold().split()
        if len(words) >= max(1, min_words):
            out.append((start, start, end, len(words), True, xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))))
        if min_run is not None and len(words) > min_run:
            at, held, held_at = 0, [], 0
            for to in [m.end() for m in SENTENCE.finditer(body)] + [len(body)]:
                sentence = body[at:to].casefold().split()
                held += sentence
                if len(sentence) >= min_words or to == len(body) and len(held) >= min_words:
                    if to - held_at < len(body):
                        out.append((start, start + held_at, start + to, len(held), False, xxh3_128_digest(" ".join(held).encode("utf-8", "surrogatepass"))))
                    held, held_at = [], to
                at = to
        start = end
    return out


def repeated_spans(docs: DataFrame, by: str = "line", min_words: int = 1, min_run: int | None = None) -> DataFrame:
    """(__q_id, __q_text, spans): for each document that repeats units of earlier ones, where they lie.

    spans: array of struct<start, end, kept_id, kept_start>, in order and without overlaps: code points of the
    original text, and the occurrence that stays. Occurrences are ranked by doc_id (null last), text hash and
    start. Every line that holds a word is a unit; min_words leaves shorter ones alone. With min_run, repeated parts
    of a line that is not repeated as a whole go too, where parts in a row have min_run words or more between them,
    so a passage is found in the midst of another line and a lone short sentence stays.

    Counts and first occurrences are aggregated before the shuffle, so a unit that a third of all rows holds is one
    row a task; digests that more than one row in a thousand holds are fewer than a thousand and are broadcast, so
    their rows are not shuffled at all. Only units that occur more than once go on from there.
    """

    def run(batches):
        for batch in batches:
            found = [units(t.as_py() or "", by, min_words, min_run) for t in batch.column("text")]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(u) for u in found]))
            line, start, end, words, whole, digest = zip(*[u for us in found for u in us]) if len(owner) else ((),) * 6
            h = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            ints = [pa.array(x, pa.int32()) for x in (line, start, end, words)]
            yield pa.RecordBatch.from_arrays([batch.column("__q_id").take(owner), batch.column("__q_text").take(owner), *ints, pa.array(whole, pa.bool_()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["__q_id", "__q_text", "line", "start", "end", "words", "whole", "h1", "h2"])

    schema = "__q_id long, __q_text long, line int, start int, end int, words int, whole boolean, h1 long, h2 long"
    rows = settle(docs.select(F.col("text").cast("string").alias("text"), *key_of()).mapInArrow(run, schema))
    digest = ["h1", "h2"]
    rank = F.struct((F.col("__q_id") == -(2**63)).alias("no_id"), "__q_id", "__q_text", "start")
    first = settle(rows.groupBy(*digest).agg(F.count("*").alias("n"), F.min(rank).alias("keep")).where("n > 1"))
    doc = ["__q_id", "__q_text"]
    # repeated rows of one document say the same twice
    again = join_hot(rows, first, digest, "n").where(rank != F.col("keep")).dropDuplicates([*doc, "start", "end"])
    line = W.partitionBy(*doc, "line")
    again = again.withColumn("gone", F.max("whole").over(line)).where("whole or not gone")
    again = again.withColumn("new", F.coalesce(F.col("start") != F.lag("end").over(line.orderBy("start")), F.lit(True)).cast("int"))
    again = again.withColumn("run", F.sum("new").over(line.orderBy("start")))
    again = again.withColumn("together", F.sum("words").over(W.partitionBy(*doc, "line", "run"))).where(F.col("whole") | (F.col("together") >= (min_run or 0)))
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.when(~F.col("keep.no_id"), F.col("keep.__q_id")).alias("kept_id"), F.col("keep.start").cast("long").alias("kept_start"))
    return again.groupBy(*doc).agg(F.array_sort(F.collect_list(span)).alias("spans"))


def deduplicated(docs: DataFrame, by: str = "line", min_words: int = 1, min_run: int | None = None) -> DataFrame:
    """docs with repeated units cut out of text, and the column spans of repeated_spans (empty where nothing goes).

    Null texts stay null, empty ones empty; a text may become empty. Repeated rows (same doc_id and text) are one
    document and get one result each. Null doc_ids rank last. An empty table gives no rows. An input column named
    spans is replaced.
    """
    found = repeated_spans(docs, by, min_words, min_run).withColumnRenamed("spans", "__q_spans")
    keyed = docs.select("*", *key_of()).join(found, ["__q_id", "__q_text"], "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint,kept_id:bigint,kept_start:bigint>>")
    out = keyed.withColumn("text", F.when(F.col("__q_spans").isNull() | F.col("text").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("__q_spans"))))
    return out.select(*[c for c in docs.columns if c != "spans"], F.coalesce("__q_spans", none).alias("spans"))


@F.udf(T.StringType(), useArrow=True)
def _without(text, spans):
    """What lies between the spans; a column function finds each place anew from the start of the text."""
    if text is None or spans is None:
        return text
    return "".join([text[a:b] for a, b in zip([0, *[s["end"] for s in spans]], [*[s["start"] for s in spans], len(text)])])


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, the original offsets removed, their number and characters, and the text that stays."""
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), **PRODUCTION)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", F.size("spans").cast("long").alias("removed_units"), gone.alias("removed_chars"), F.expr("transform(spans, s -> s.start)").alias("removed_starts"), F.expr("transform(spans, s -> s.end)").alias("removed_ends"), "text")
