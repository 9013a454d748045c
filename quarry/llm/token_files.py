"""Token-ID output: ORC files of ids in doc_id order, with row indexes and Bloom filters, and their reader."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import encoder, slices
from .common import scratch, settle, table


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", kind: str = "word", end_id: int = 1, stripe_bytes: int = 64 << 20, index_stride: int = 1000, files: int | None = None, room: int = 800_000) -> None:
    """Encode each whole text, append end_id, and write (doc_id, seq, ids) as ORC in ascending doc_id order.

    A range shuffle on doc_id, then a hash of the text, gives each task one run of ids, so file numbers follow doc_id, every task
    writes on its own, and many rows of one doc_id are split by their texts. seq numbers the rows of a file. ORC packs the integers with its run-length encoding; stripes can
    be read in parallel, the row index and the Bloom filter on doc_id let a reader skip what it does not look for.

    A null text is an empty one (its row holds end_id only); null doc_ids come first; rows of one doc_id are
    ordered by that hash and text; repeated rows are all written; other columns of docs are left out; an empty table gives no
    rows.
    """
    n = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches):
        enc, seq = encoder(tokenizer, kind, room), 0
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for a, b in slices(texts, 4_000_000):
                offsets, tokens = enc.encode(texts.slice(a, b - a))
                k = b - a
                ends = np.insert(tokens.astype(np.int32), offsets[1:], end_id)
                lists = pa.ListArray.from_arrays(pa.array((offsets + np.arange(k + 1)).astype(np.int32)), pa.array(ends))
                yield pa.RecordBatch.from_arrays([ids.slice(a, k), pa.array(np.arange(seq, seq + k, dtype=np.int64)), lists], ["doc_id", "seq", "ids"])
                seq += k

    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    rows = placed.mapInArrow(encode, "doc_id long, seq long, ids array<int>")
    options = {"orc.compress": "ZSTD", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": str(index_stride), "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    rows.write.options(**options).orc(path)


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, file, seq, ids) of files that write_token_files wrote; filters on doc_id reach the ORC reader."""
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    return spark.read.schema("doc_id long, seq long, ids array<int>").orc(path).select("doc_id", number.alias("file"), "seq", "ids")


def digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of read_token_files.

    start is the file's first id, from one total per file, and the ids before the row in its own file.
    """

    def digest(batches):
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("seq"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "file", "seq", "n_tokens", "ids_crc32"])

    # five numbers a row are written once, so the files are read once for the totals and the rows
    rows = settle(files.mapInArrow(digest, "doc_id long, file long, seq long, n_tokens long, ids_crc32 long"))
    inner = F.coalesce(F.sum("n_tokens").over(W.partitionBy("file").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    base = F.coalesce(F.sum("total").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = totals.select("file", base.alias("base"))
    return rows.withColumn("inner", inner).join(first, "file").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    """The token files of all documents, read back: doc_id, start, n_tokens, ids_crc32; null texts hold the end id only."""
    path = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return digests(read_token_files(spark, path))
