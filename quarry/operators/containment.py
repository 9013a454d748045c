"""Which documents contain an item's text: one pass over the texts, which are neither moved nor exploded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sent, settle


class Heads:
    """Items by three words in a row of theirs, which stand between white space in whatever contains them."""

    def __init__(self, items: pa.Table):
        self.ids, texts = items["query_id"].combine_chunks(), items["query"].combine_chunks()
        self.texts = texts.to_pylist()
        words = pc.utf8_split_whitespace(texts).to_pylist()
        long = [i for i, w in enumerate(words) if len(w) >= 5]
        self.short = [i for i, w in enumerate(words) if len(w) < 5]
        self.vocabulary = pa.array(sorted({w for i in long for w in words[i][1:4]}), pa.string())
        at = {w: j for j, w in enumerate(self.vocabulary.to_pylist())}
        keys = np.array([self.key(*(np.int64(at[w]) for w in words[i][1:4])) for i in long], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], np.array(long, np.int64)[order]

    def key(self, a, b, c):
        n = len(self.vocabulary)
        return (a * n + b) * n + c

    def found(self, texts: pa.Array) -> set:
        """(row, item) where the text of the row contains that of the item."""
        lists = pc.utf8_split_whitespace(texts)
        code = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        at = np.flatnonzero((code[:-2] >= 0) & (code[1:-1] >= 0) & (code[2:] >= 0) & (row[:-2] == row[2:]))
        key = self.key(code[at], code[at + 1], code[at + 2])
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        maybe = {(int(row[p]), int(i)) for p, a, b in zip(at[high > low], low[high > low], high[high > low]) for i in self.items[a:b]}
        out = {(r, i) for r, i in maybe if self.texts[i] in texts[r].as_py()}
        for i in self.short:
            out.update((int(r), i) for r in np.flatnonzero(pc.fill_null(pc.match_substring(texts, self.texts[i]), False).to_numpy(zero_copy_only=False)))
        return out


def containing(docs: DataFrame, items: DataFrame, most: int = 100_000, step: int = 512) -> DataFrame:
    """(query_id, doc_id) for each row of docs (doc_id, text) that contains the text of an item (query_id, query).

    An item's second to fourth words are looked for first; items of under five words are few and tried on every text.
    At most `most` items go to every task; more are joined to the three-word runs of the texts. Nulls contain nothing.
    """
    items = settle(items.where("query is not null").select("query_id", "query"))
    if items.count() > most:
        return _joined(docs, items)
    held = items.toArrow()
    if not len(held):
        return items.select("query_id").crossJoin(docs.select("doc_id")).limit(0)
    heads = Heads(held)

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), step):  # a few texts at a time: their words are held
                part = batch.slice(a, step)
                pairs = sorted(heads.found(part.column("text")))
                yield pa.RecordBatch.from_arrays([heads.ids.take(pa.array([i for _, i in pairs], pa.int64())), part.column("doc_id").take(pa.array([r for r, _ in pairs], pa.int64()))], ["query_id", "doc_id"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"query_id {kind(items, 'query_id')}, doc_id {kind(docs, 'doc_id')}")


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    words = lambda c: F.regexp_extract_all(F.col(c), F.lit("(?U)\\S+"), F.lit(0))
    three = lambda w, i: F.concat_ws(" ", F.slice(w, i, 3))
    docs = docs.select("doc_id", "text")
    heads = settle(items.withColumn("w", words("query")).select("query_id", "query", F.when(F.size("w") >= 5, three(F.col("w"), F.lit(2))).alias("head")))
    rows = docs.withColumn("w", words("text")).where(F.size("w") >= 5)
    grams = rows.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: three(F.col("w"), i)))).alias("head"))
    pairs = settle(grams.join(sent(heads.select("query_id", "head").where("head is not null")), "head").select("query_id", "doc_id"))
    pairs = sent(pairs).join(docs, "doc_id").join(sent(heads), "query_id").where(F.contains("text", "query")).select("query_id", "doc_id")
    short = heads.where("head is null").select("query_id", "query")
    if not short.isEmpty():
        pairs = pairs.unionByName(docs.join(sent(short), F.contains("text", "query")).select("query_id", "doc_id"))
    return pairs.distinct()
