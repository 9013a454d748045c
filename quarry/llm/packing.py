"""Harmonic packing: documents by reciprocal classes of the capacity, a fixed number of documents in each bin of a class."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import encoder, slices
from .common import table

#: Sequences of a task have ids from its number times this on.
TASK = 1 << 33


def fillers_needed(lengths: np.ndarray, spare: int, capacity: int) -> int:
    """How many of the pieces, from the first on, must top up the bins of the others beside `spare` tokens."""
    classes, upto = capacity // lengths, np.concatenate(([0], np.cumsum(lengths)))

    def short(k: int) -> float:
        bins = (np.bincount(classes[k:], minlength=1) / np.maximum(1, np.arange(max(1, classes[k:].max(initial=0) + 1)))).sum()
        return bins * capacity - (upto[-1] - upto[k]) - spare - upto[k]

    low, high = 0, len(lengths)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if short(mid) > 0 else (low, mid)
    return low


class Packer:
    """Packs one task's documents, window after window. A piece is (owner, start, length, at): a document's number in
    the window, the ids of the document before it, its ids' number, and where they lie in the window's ids."""

    def __init__(self, capacity: int):
        self.capacity, self.sequence = capacity, 0
        self.kept: list[tuple] = []  # (doc_id, doc_tokens, start, ids) of pieces that wait for the next window

    def window(self, doc_ids: list, offsets: np.ndarray, ids: np.ndarray, last: bool = False):
        """(doc_id, doc_tokens, start, sequence, offset, ids) of the pieces that are placed now; all of them at last.

        Pieces of capacity // (j + 1) < length <= capacity // j tokens are class j, and its bins take j of them. What
        a bin lacks is topped up by the whole capacities of longer documents, or where they are too few by what is
        left of those and then by the shortest documents; only these are cut. Classes' open bins wait.
        """
        c = self.capacity
        held, self.kept = self.kept, []
        owners = [(d, n) for d, n, _, _ in held] + list(zip(doc_ids, np.diff(offsets).tolist()))
        ids = np.concatenate([*(x for _, _, _, x in held), ids])
        sizes = np.array([len(x) for _, _, _, x in held], np.int64)
        ends = np.cumsum(sizes)
        lengths, base = np.diff(offsets), int(ends[-1]) if len(ends) else 0
        chunks = lengths // c
        at = np.concatenate([ends - sizes, offsets[:-1] + base + chunks * c])
        start = np.concatenate([np.array([s for _, _, s, _ in held], np.int64), chunks * c])
        rest = np.concatenate([sizes, lengths - chunks * c])
        doc = np.arange(len(owners))
        whole = np.array([n <= c for _, n in owners], bool)
        # whole capacities
        i = np.repeat(np.arange(len(lengths)), chunks)
        nth = np.arange(len(i)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        units = np.stack([i + len(held), nth * c, np.full(len(i), c), offsets[:-1][i] + base + nth * c])
        pieces = np.stack([doc, start, rest, at])[:, rest > 0]
        pieces = pieces[:, np.lexsort((pieces[2], whole[pieces[0]]))]
        k = fillers_needed(pieces[2], units.shape[1] * c, c)
        fill, pieces = pieces[:, :k], pieces[:, k:]

        # bins: each class's pieces in turn, as many to a bin as its number says
        classes = c // pieces[2]
        pieces = pieces[:, np.argsort(classes, kind="stable")]
        classes = c // pieces[2]
        turn = np.arange(len(classes)) - np.searchsorted(classes, classes)
        count = np.searchsorted(classes, classes, "right") - np.searchsorted(classes, classes)
        ready = np.full(len(classes), True) if last else turn < count // np.maximum(classes, 1) * classes
        waiting, pieces, classes, turn = pieces[:, ~ready], pieces[:, ready], classes[ready], turn[ready]
        first = turn % np.maximum(classes, 1) == 0
        bins = np.cumsum(first) - 1
        used = np.bincount(bins, pieces[2], minlength=int(first.sum())).astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(pieces[2])))[:-1]
        offset = upto - upto[first][bins] if len(bins) else upto
        placed = [np.vstack([pieces, bins, offset])]

        # the fillers' ids as one line, cut where a filler or a gap ends
        gaps = c - used
        lack = int(gaps.sum()) - int(fill[2].sum())
        take = min(units.shape[1], max(0, lack // c))
        fill, units = np.concatenate([fill, units[:, :take]], axis=1), units[:, take:]
        ends_f, ends_g = np.cumsum(fill[2]), np.cumsum(gaps)
        line = min(int(ends_f[-1]) if len(ends_f) else 0, int(ends_g[-1]) if len(ends_g) else 0)
        stops = np.unique(np.concatenate([ends_f[ends_f <= line], ends_g[ends_g <= line], [line]]))
        stops = stops[stops > 0]
        begins = np.concatenate(([0], stops[:-1])).astype(np.int64) if len(stops) else stops.astype(np.int64)
        f, g = np.searchsorted(ends_f, begins, "right"), np.searchsorted(ends_g, begins, "right")
        inner = begins - (ends_f - fill[2])[f]
        cut = np.stack([fill[0][f], fill[1][f] + inner, stops - begins, fill[3][f] + inner])
        placed.append(np.vstack([cut, g, used[g] + begins - (ends_g - gaps)[g]]))
        # what no gap took, and bins that stay short
        left = np.flatnonzero(ends_f > line)
        skip = np.maximum(0, line - (ends_f - fill[2])[left])
        over = np.stack([fill[0][left], fill[1][left] + skip, fill[2][left] - skip, fill[3][left] + skip])
        got = np.concatenate(placed, axis=1)
        short = ends_g > line
        back = short[got[4]] if got.shape[1] else np.zeros(0, bool)
        spare = np.concatenate([over, waiting, got[:4, back]], axis=1)
        got = got[:, ~back]
        number = np.cumsum(~short) - 1
        got[4] = number[got[4]]
        done = int((~short).sum())
        got = np.concatenate([got, np.vstack([units, done + np.arange(units.shape[1]), np.zeros(units.shape[1], np.int64)])], axis=1)
        done += units.shape[1]
        if last:
            tail = self.tail(spare)
            got = np.concatenate([got, np.vstack([tail[:4], done + tail[4], tail[5]])], axis=1)
            done += int(tail[4].max(initial=-1)) + 1
        else:
            self.kept = [(*owners[d], s, ids[a : a + n]) for d, s, n, a in spare.T.tolist()]
        base, self.sequence = self.sequence, self.sequence + done
        data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        for d, s, n, a, q, o in got.T.tolist():
            yield *owners[d], s, base + q, o, data[4 * a : 4 * (a + n)]

    def tail(self, pieces: np.ndarray) -> np.ndarray:
        """The last pieces in a row, cut into sequences of the capacity and then of falling powers of two."""
        total = int(pieces[2].sum())
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if (total % self.capacity) >> b & 1]
        ends_p, ends_s = np.cumsum(pieces[2]), np.cumsum(np.array(sizes, np.int64))
        stops = np.unique(np.concatenate([ends_p, ends_s]))
        begins = np.concatenate(([0], stops[:-1])).astype(np.int64) if len(stops) else stops
        p, s = np.searchsorted(ends_p, begins, "right"), np.searchsorted(ends_s, begins, "right")
        inner = begins - (ends_p - pieces[2])[p]
        return np.stack([pieces[0][p], pieces[1][p] + inner, stops - begins, pieces[3][p] + inner, s, begins - np.concatenate(([0], ends_s))[s]])


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", kind: str = "byte", end_id: int = 0, capacity: int = 1024, room: int = 300_000, digest: bool = False) -> DataFrame:
    """Pack all documents' ids, each with end_id after it, into sequences of at most capacity (a power of two) tokens.

    room: distinct chunks whose ids a worker keeps for later texts; it bounds memory and changes no result.
    Returns a row for each piece: doc_id, start (ids of its document before it), length, doc_tokens, sequence_id,
    offset (its place in the sequence), ids (little-endian unsigned 32-bit integers). digest: ids_crc32, the ids'
    unsigned checksum, stands in place of ids, so that they need not leave the worker.

    Each task packs its own documents and needs nothing of others: no shuffle, no count over all. It goes on in
    windows of some megabytes of text and holds one window's ids. A document of at most capacity tokens stays whole
    in a bin of its harmonic class, unless there are too few longer ones to top up the bins. No sequence is padded:
    a task's last ones have lengths of powers of two. sequence_id is unique, and ascends within a task.

    A null or empty text is a document of end_id alone; null doc_ids and repeated rows are packed like others;
    other columns are left out; an empty table gives no rows.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32" if digest else "ids"]

    def run(batches):
        enc, packer, part = encoder(tokenizer, kind, room), Packer(capacity), 0

        def rows(found):
            got = list(found)
            if got:
                doc, n, start, seq, at, ids = zip(*got)
                ints = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays([ints(doc), ints(start), ints([len(x) // 4 for x in ids]), ints(n), ints([part * TASK + s for s in seq]), ints(at), ints([zlib.crc32(x) for x in ids]) if digest else pa.array(ids, pa.binary())], names)

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            ids, texts = batch.column("doc_id"), batch.column("text")
            for a, b in slices(texts, 2_000_000):
                offsets, tokens = enc.encode(texts.slice(a, b - a))
                tokens = np.insert(tokens.astype("<u4"), offsets[1:], end_id)
                yield from rows(packer.window(ids.slice(a, b - a).to_pylist(), offsets + np.arange(b - a + 1), tokens))
        yield from rows(packer.window([], np.zeros(1, np.int64), np.zeros(0, "<u4"), last=True))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().cast("long").alias("part"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, " + ("ids_crc32 long" if digest else "ids binary"))


def op7_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their checksums; nulls, empty texts and repeats as in pack()."""
    return pack(table(spark, sf_dir, "documents"), digest=True)
