"""SimHash near-duplicates: a binary trie of fingerprints joined with itself under a Hamming error budget.

near_duplicates() links fingerprints of three-word shingles by their differing bits alone. near_copies() takes the
links that the trie join proposes as candidates and settles what they connect by the texts: five words, a similarity of 0.8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, join_hot, key_of, settle, table

ONE = np.uint64(1)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles; zero for a text without words.

    A-Z are lower-cased, words lie between ASCII white space, repeats count, fewer words than width are one shingle.
    """
    import xxhash

    joined, starts, ends = shingles(text, width)
    if not ends:
        return 0
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for i in range(0, len(ends), 1 << 16):
        part = ends[i : i + (1 << 16)]
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[i : i + len(part)], part)), np.uint64, len(part))
        total += _ones(h)
    on = np.flatnonzero(2 * total > len(ends))
    return int(sum(1 << int(b) for b in on))


def shingles(text: str | None, width: int) -> tuple[bytes, list[int], list[int]]:
    """(words joined by spaces, starts, ends) of a text's shingles; one of all words if they are fewer, none if none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return b"", [], []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    return b" ".join(words), starts, ends.tolist()[min(width, len(words)) - 1 :]


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, __q_id, __q_text, fp) for every row; fp is the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__q_id"), batch.column("__q_text"), pa.array(fps)], ["doc_id", "__q_id", "__q_text", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", "text", *key_of()).mapInArrow(run, "doc_id long, __q_id long, __q_text long, fp long")


def descend(fps: np.ndarray, roots: np.ndarray, budget: int, bits: int, alike, most: int):
    """Pairs of leaf runs (a, b, c, e) whose fingerprints differ in budget or fewer of their highest bits.

    fps: uint64, sorted within each group; group i is fps[roots[i] : roots[i + 1]], the leaves of one binary trie.
    A trie node is a run of leaves. Pairs of nodes go down the trie together, the differing bits add up, and a
    pair over the budget is cut off, as is one of which alike(a, b, c, e) holds. Pairs wait on a stack in parts of
    bounded size.
    """
    lo, hi = roots[:-1], roots[1:]
    wide = hi - lo > 1
    stack = [(0, np.stack([lo[wide], hi[wide], lo[wide], hi[wide], np.zeros(int(wide.sum()), np.int64)]))]
    # from high to low bits: prefix counts of ones split a run into its two children
    ones = [np.concatenate(([0], np.cumsum(((fps >> np.uint64(63 - d)) & ONE).astype(np.int64)))) for d in range(bits)]
    while stack:
        depth, pairs = stack.pop()
        if not pairs.shape[1]:
            continue
        if pairs.shape[1] > most:
            for i in range(0, pairs.shape[1], most):
                stack.append((depth, pairs[:, i : i + most]))
            continue
        pairs = pairs[:, ~alike(*pairs[:4])]
        a, b, c, e, diff = pairs
        if depth == bits:
            if len(a):
                yield a, b, c, e
            continue
        count = ones[depth]
        mid, mid2 = b - (count[b] - count[a]), e - (count[e] - count[c])
        other = ~((a == c) & (b == e))
        parts = [
            np.stack([a, mid, c, mid2, diff]),
            np.stack([mid, b, mid2, e, diff]),
            np.stack([a, mid, mid2, e, diff + 1]),
            np.stack([mid, b, c, mid2, diff + 1])[:, other],
        ]
        nxt = np.concatenate(parts, axis=1)
        size_a, size_b = nxt[1] - nxt[0], nxt[3] - nxt[2]
        own = (nxt[0] == nxt[2]) & (nxt[1] == nxt[3])
        stack.append((depth + 1, nxt[:, (size_a > 0) & (size_b > 0) & (nxt[4] <= budget) & ~(own & (size_a == 1))]))


def trie_links(fps: np.ndarray, roots: np.ndarray, budget: int = 3, most: int = 200_000, bits: int = 64) -> np.ndarray:
    """Labels of fps such that members of a group with budget or fewer differing bits, and what they link, share one.

    fps are distinct and sorted within each group, as descend() takes them. A pair of nodes whose leaves all carry
    one label already has nothing more to say and is cut off.
    """
    label = np.arange(len(fps))
    changes = None

    def alike(a, b, c, e):
        nonlocal changes
        if changes is None:
            changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        return (changes[b - 1] == changes[a]) & (changes[e - 1] == changes[c]) & (label[a] == label[c])

    for a, _, c, _ in descend(fps, roots, budget, bits, alike, most):
        label, changes = _merge(label, a, c), None
    return label


def trie_pairs(fps: np.ndarray, roots: np.ndarray, label: np.ndarray, budget: int, bits: int, most: int = 200_000):
    """(i, k) arrays of all places of a group with budget or fewer differing bits and different labels.

    fps may repeat within a group and are sorted there. Pairs of nodes whose leaves all carry one label are cut off.
    """
    changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))

    def alike(a, b, c, e):
        return (changes[b - 1] == changes[a]) & (changes[e - 1] == changes[c]) & (label[a] == label[c])

    for a, b, c, e in descend(fps, roots, budget, bits, alike, most):
        size = (b - a) * (e - c)
        upto = np.cumsum(size)
        for start in range(0, int(upto[-1]), most):
            at = np.arange(start, min(start + most, int(upto[-1])))
            which = np.searchsorted(upto, at, "right")
            left = at - (upto[which] - size[which])
            i, k = a[which] + left // (e - c)[which], c[which] + left % (e - c)[which]
            keep = (label[i] != label[k]) & ((a[which] != c[which]) | (i < k))
            if keep.any():
                yield i[keep], k[keep]


def _merge(label: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Labels after linking a with c: each class takes its smallest label."""
    x, y = label[a], label[c]
    parent = np.arange(len(label))
    while True:
        low = np.minimum(parent[x], parent[y])
        before = parent.copy()
        np.minimum.at(parent, parent[x], low)
        np.minimum.at(parent, parent[y], low)
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
        if np.array_equal(before, parent):
            return parent[label]


def dealt(rows: DataFrame, budget: int, hot: int, rounds: int = 2) -> DataFrame:
    """rows (fp, group and more) once for each trie that they are in: with the column key.

    budget differing bits leave one of budget + 1 bit blocks equal, so each fingerprint of a group goes to a trie for
    each of its blocks. A trie of over hot rows is dealt out again by the blocks of its remaining bits, at most so many
    times: each makes four of a row, and fingerprints that are still together then differ in few bits.
    """
    parts = budget + 1
    edge = [64 * i // parts for i in range(parts + 1)]
    own = rows.columns
    rows = rows.select(*own, F.posexplode(F.array(*[F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edge, edge[1:])])).alias("i", "v"))
    rows = rows.select(*own, F.concat(F.col("i"), F.lit(":"), F.col("group"), F.lit("."), F.col("v")).alias("key"))
    done = []
    spans = {str(i): [x for x in range(64) if not edge[i] <= x < edge[i + 1]] for i in range(parts)}
    for _ in range(rounds):
        big = settle(rows.groupBy("key").count().where(F.col("count") > hot).select("key"))
        if big.isEmpty():
            break
        done.append(rows.join(big, "key", "left_anti"))
        rows = rows.join(big, "key", "left_semi")
        # the bits that the key holds already are named by its block numbers: cut the rest into blocks again
        split, spans = _split(spans, parts)
        at = F.regexp_replace(F.col("key"), r":[^/]*", "")
        subkeys = F.create_map(*[x for path, kids in split.items() for x in (F.lit(path), F.array(*[_bits("fp", k) for k in kids]))])
        rows = rows.select(*own, "key", F.posexplode(subkeys[at]).alias("i", "v")).select(*own, F.concat("key", F.lit("/"), "i", F.lit(":"), "v").alias("key"))
    for d in done:
        rows = rows.unionByName(d)
    return rows


def _sorted(t: pa.Table) -> tuple:
    """(order, fps, roots): rows of whole keys by key, then fingerprint; roots are where keys begin, and the end."""
    codes = t.column("key").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    fp = t.column("fp").to_numpy().view(np.uint64)
    order = np.lexsort((fp, codes))
    codes = codes[order]
    return order, fp[order], np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]))


def links(fps: DataFrame, budget: int = 3, hot: int = 200_000) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (column fp) as their links of budget or fewer bits do."""

    def solve(t):
        if not t.num_rows:
            return
        _, fp, roots = _sorted(t)
        label = trie_links(fp, roots, budget)
        moved = np.flatnonzero(label != np.arange(len(label)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[label[moved]].view(np.int64))], ["a", "b"])

    return by_key(dealt(fps.select("fp", F.lit(0).alias("group")), budget, hot).select("fp", "key"), solve, "a long, b long")


def by_key(rows: DataFrame, solve, schema: str) -> DataFrame:
    """What solve(table) yields for whole keys of rows (column key), some keys at a time."""

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = t.column("key").combine_chunks()
            first = _first(keys, keys[len(keys) - 1].as_py())
            held = t.slice(first)
            yield from solve(t.slice(0, first))
        if held is not None:
            yield from solve(held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, schema)


def _first(keys, last) -> int:
    import pyarrow.compute as pc

    return pc.index(keys, last).as_py()


def _bits(col: str, bits: list[int]):
    """The named bits of col, packed into a long."""
    out = F.lit(0).cast("long")
    for i, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(col, b).bitwiseAND(F.lit(1)), i))
    return out


def _split(spans: dict, parts: int) -> tuple[dict, dict]:
    kids = {path: [free[len(free) * i // parts : len(free) * (i + 1) // parts] for i in range(parts)] for path, free in spans.items()}
    return kids, {f"{path}/{i}": [x for x in spans[path] if x not in set(k)] for path, own in kids.items() for i, k in enumerate(own)}


def near_duplicates(docs: DataFrame, budget: int = 3) -> DataFrame:
    """(doc_id, __q_id, __q_text, fp, root, component_id) for every row of docs.

    Rows whose fingerprints are linked by budget or fewer differing bits, directly or over others, share a root;
    component_id is its smallest doc_id. A null or blank text has fingerprint zero and is linked like any other;
    null doc_ids take part but are never the smallest (null if there is no other); repeated rows share a
    component; other columns are left out; an empty table gives no rows.
    """
    rows = settle(fingerprints(docs))
    each = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = components(links(each, budget))
    roots = each.join(found, each.fp == found.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    # one row for each fingerprint; those that very many documents have are few and broadcast
    named = settle(roots.join(lows, "root").join(rows.groupBy("fp").agg(F.count("*").alias("__q_n")), "fp").select("fp", "root", "component_id", "__q_n"))
    return join_hot(rows, named, ["fp"], "__q_n")


#: Odd multipliers: multiples of 2**64 over the golden ratio.
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x9E3779B97F4A7C15 * 3 % 2**64)
#: Orders of a text's shingles; one byte of the smallest shingle in each is its sketch, and eight of these are a word.
MINS, WORDS, ERRORS = 128, 16, 3
ORDERS = MIX[0] * (np.arange(MINS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def hashes(text: str | None, width: int) -> tuple[bytes, np.ndarray]:
    """(128-bit digest of a text's words, its distinct shingles as sorted 64-bit hashes)."""
    import xxhash

    joined, starts, ends = shingles(text, width)
    digest = xxhash.xxh64_intdigest
    return xxhash.xxh3_128_digest(joined), np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends)), "<u8", len(ends)))


def sketch(h: np.ndarray) -> bytes:
    """One byte of the smallest of some hashes in each of MINS orders: two sets agree in a byte as often as they share."""
    least = np.full(MINS, np.uint64(2**64 - 1))
    for i in range(0, len(h), 1 << 12):
        x = (h[i : i + (1 << 12), None] ^ ORDERS) * MIX[0]
        x = (x ^ (x >> np.uint64(32))) * MIX[1]
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
    # the smallest have few high bits set: a product's high byte tells them apart
    return ((least * MIX[0]) >> np.uint64(56)).astype(np.uint8).tobytes()


def similarity(a: bytes, b: bytes) -> float:
    """Shingles that both sets have over those that either has."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _words(texts: DataFrame) -> DataFrame:
    """(n, root, group, fp): each word of the sketches of texts (n, mins, root); group is the word's number."""

    def run(batches):
        for batch in batches:
            n, root = (batch.column(c).to_numpy() for c in ("n", "root"))
            w = np.frombuffer(b"".join(batch.column("mins").to_pylist()), "<i8").reshape(-1, WORDS)
            for p in range(WORDS):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (n, root, np.full(len(n), p, np.int32), w[:, p])], ["n", "root", "group", "fp"])

    return texts.select("n", "mins", "root").mapInArrow(run, "n long, root long, group int, fp long")


def _forest(texts: DataFrame, hot: int = 200_000) -> DataFrame:
    """(a, b): candidates that span what each trie links; every text with a candidate is in one of them.

    Texts of one word go to the first of them; the tries hold each word once.
    """
    words = settle(_words(texts).select("n", "group", "fp"))
    heads = settle(words.groupBy("group", "fp").agg(F.min("n").alias("head"), F.count("*").alias("__q_n")))

    def solve(t):
        if not t.num_rows:
            return
        order, fp, roots = _sorted(t)
        head = t.column("head").to_numpy()[order]
        label = trie_links(fp, roots, ERRORS)
        moved = np.flatnonzero(label != np.arange(len(label)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(head[moved]), pa.array(head[label[moved]])], ["a", "b"])

    near = by_key(dealt(heads.select("fp", "group", "head"), ERRORS, hot).select("key", "fp", "head"), solve, "a long, b long")
    same = join_hot(words, heads.where("__q_n > 1"), ["group", "fp"], "__q_n").select(F.col("n").alias("a"), F.col("head").alias("b"))
    return near.unionByName(same).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _candidates(texts: DataFrame, hot: int = 200_000) -> DataFrame:
    """(a, b): all pairs of texts with different roots that have ERRORS or fewer differing bits in one of their words.

    For counts of proposals: near_copies() needs only what they connect, as their number may be the square of a group's.
    The tries hold each word once for every root that has it; only pairs of these are made into pairs of texts.
    """
    words = settle(_words(texts))
    each = words.select("group", "fp", "root").distinct()

    def solve(t):
        if not t.num_rows:
            return
        order, fp, roots = _sorted(t)
        group, root = (t.column(c).to_numpy()[order] for c in ("group", "root"))
        for i, k in trie_pairs(fp, roots, root, ERRORS, 64):
            cols = (group[i], fp[i].view(np.int64), root[i], fp[k].view(np.int64), root[k])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["group", "fp", "root", "fp2", "root2"])

    near = settle(by_key(dealt(each, ERRORS, hot).select("key", "fp", "group", "root"), solve, "group int, fp long, root long, fp2 long, root2 long").distinct())
    left = near.join(words.withColumnRenamed("n", "a"), ["group", "fp", "root"])
    both = left.join(words.select(F.col("n").alias("b"), "group", F.col("fp").alias("fp2"), F.col("root").alias("root2")), ["group", "fp2", "root2"])
    return both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of pairs whose shingle sets, of sets (n, size, mins, shingles), have a similarity of least or more.

    Before any set is moved, a pair goes if its sizes rule the similarity out, or if fewer than least - 0.2 of its
    sketch's bytes agree. That share is the similarity give or take 0.035 at 0.8, so hardly a link is lost.
    """
    enough = int(MINS * (least - 0.2))

    def run(batches):
        for batch in batches:
            keep = [similarity(x.as_py(), y.as_py()) >= least for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def likely(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, MINS) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= enough))

    def side(n, size, value, of):
        return sets.select(F.col("n").alias(n), F.col("size").alias(size), F.col(of).alias(value))

    fit = F.least("s", "t") >= F.lit(least) * F.greatest("s", "t") - F.lit(1e-6)
    sized = pairs.join(side("a", "s", "x", "mins"), "a").join(side("b", "t", "y", "mins"), "b").where(fit)
    left = settle(sized.select("a", "b", "x", "y").mapInArrow(likely, "a long, b long"))
    both = left.join(side("a", "s", "x", "shingles"), "a").join(side("b", "t", "y", "shingles"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _met(members: DataFrame, sets: DataFrame, texts: int, most: int) -> DataFrame:
    """(key, side, n, root, shingles): texts of members (n, clump, root, size) once for each two blocks that they are in.

    A clump is dealt into blocks of about `texts` texts and `most` shingles at most; each two blocks of it, and each
    with itself, are a key. Clumps of one root, and of two texts, which met before, are left out.
    """
    stats = members.groupBy("clump").agg(F.count("*").alias("__q_n"), F.sum("size").alias("s"), F.min("root").alias("low"), F.max("root").alias("high"))
    blocks = F.greatest(F.ceil(F.col("__q_n") / texts), F.ceil(F.col("s") / most)).cast("int").alias("blocks")
    open_ = settle(stats.where("__q_n > 2 and low != high").select("clump", blocks, "__q_n"))
    placed = join_hot(members, open_, ["clump"], "__q_n").withColumn("side", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int"))
    rows = placed.select("n", "clump", "root", "side", "blocks").join(sets.select("n", "shingles"), "n")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.concat_ws(":", "clump", F.least("side", "other"), F.greatest("side", "other"))
    return rows.select(key.alias("key"), "side", "n", "root", "shingles")


def _within(members: DataFrame, sets: DataFrame, least: float, texts: int = 512, most: int = 1 << 20) -> DataFrame:
    """(a, b): edges that connect members (n, clump, root, size) of a clump as all links between its roots do.

    All pairs of different roots are judged by their shingles, in tasks of two blocks of a clump each; a task hands on
    fewer edges than it has texts, so no pair is a row.
    """

    def solve(t):
        key = t.column("key").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        side, n, root = (t.column(c).to_numpy() for c in ("side", "n", "root"))
        order = np.lexsort((side, key))
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        held = t.column("shingles")
        for own in np.split(order, cuts) if len(order) else []:
            found = linked([np.frombuffer(held[int(i)].as_py(), "<u8") for i in own], side[own], root[own], least)
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(n[own[a]]), pa.array(n[own[b]])], ["a", "b"])

    return by_key(_met(members, sets, texts, most), solve, "a long, b long")


def linked(sets: list[np.ndarray], side: np.ndarray, root: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Places (i, k) that connect the roots as all pairs with a similarity of least or more do: at most one for each set.

    sets are sorted by side; of two sides only pairs across them are judged. Sets are of distinct hashes.
    """
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    starts = ends - size
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
    across = int(np.searchsorted(side, side[0], "right"))
    label, out = root.copy(), []
    for i in range(across if across < len(sets) else len(sets)):
        k = np.arange(across if across < len(sets) else i + 1, len(sets))
        k = k[(label[k] != label[i]) & (np.minimum(size[k], size[i]) >= least * np.maximum(size[k], size[i]) - 1e-6) & (size[k] > 0)]
        if not len(k):
            continue
        mark[code[starts[i] : ends[i]]] = 1
        first = np.cumsum(size[k]) - size[k]
        both = np.add.reduceat(mark[code[np.repeat(starts[k] - first, size[k]) + np.arange(int(size[k].sum()))]], first)
        mark[code[starts[i] : ends[i]]] = 0
        near = k[both / (size[i] + size[k] - both) >= least]
        roots, at = np.unique(label[near], return_index=True)
        out += [(i, int(near[j])) for j in at]
        label[np.isin(label, roots)] = label[i]
    return out


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(__q_id, __q_text, digest, root) for every row of docs; rows of one near-duplicate group share a root.

    Texts of equal words are one text. Two texts are linked if the trie join of their sketches proposes them and their
    shingles of `width` words (all words, if fewer) have a similarity of `least` or more: proposals may miss a link,
    none is wrong. A sketch is cut into WORDS words of eight bytes; at a similarity of 0.8 two texts agree in a word, but
    for ERRORS bits, with a chance of 0.29, so of all 16 in one at least with 0.995, whatever the edit; texts that share
    nothing do in one of 10^13 pairs, so proposals follow the number of texts and not its square. Groups are what links
    connect. First each text is checked against some of its proposals, at most two for each trie that it is in, so that
    a large group of copies becomes one. What proposals connect is a clump, which holds both texts of every proposal;
    then all pairs of a clump between different groups are judged, proposed or not, in tasks of two blocks of texts.
    Null and blank texts are one group; repeated rows share a group; an empty table gives no rows.
    """

    def read(batches):
        for batch in batches:
            both = [hashes(t.as_py(), width) for t in batch.column("text")]
            digest, mins = pa.array([d for d, _ in both], pa.binary()), pa.array([sketch(h) for _, h in both], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("__q_id"), batch.column("__q_text"), digest, mins], ["__q_id", "__q_text", "digest", "mins"])

    def hashed(batches):
        for batch in batches:
            held = [hashes(t.as_py(), width)[1] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("mins"), pa.array([len(h) for h in held], pa.int64()), pa.array([h.tobytes() for h in held], pa.binary())], ["n", "mins", "size", "shingles"])

    keyed = docs.select(*key_of(), F.col("text").cast("string").alias("text"))
    rows = settle(keyed.mapInArrow(read, "__q_id long, __q_text long, digest binary, mins binary"))
    each = rows.groupBy("digest").agg(F.min(F.struct("__q_id", "__q_text")).alias("k"), F.min("mins").alias("mins"), F.count("*").alias("__q_n"))
    texts = settle(each.select(F.monotonically_increasing_id().alias("n"), "digest", "k.*", "mins", "__q_n"))
    alone = texts.withColumn("root", F.col("n"))

    forest = settle(_forest(alone))
    touched = forest.select(F.explode(F.array("a", "b")).alias("n")).distinct()
    asked = settle(texts.join(touched, "n").select("n", "__q_id", "__q_text", "mins", "__q_n"))
    found = join_hot(keyed, asked, ["__q_id", "__q_text"], "__q_n")
    sets = settle(found.groupBy("n").agg(F.min("text").alias("text"), F.min("mins").alias("mins")).mapInArrow(hashed, "n long, mins binary, size long, shingles binary"))

    first = settle(_alike(forest, sets, least))
    group = components(first)
    clump = components(forest).select(F.col("node").alias("n"), F.col("root").alias("clump"))
    members = clump.join(sets.select("n", "size"), "n").join(group, F.col("n") == F.col("node"), "left")
    rest = settle(_within(settle(members.select("n", "clump", "size", F.coalesce("root", "n").alias("root"))), sets, least))
    group = components(first.unionByName(rest))
    named = texts.join(group, texts.n == group.node, "left").select("digest", F.coalesce("root", "n").alias("root"), "__q_n")
    return join_hot(rows.drop("mins"), settle(named), ["digest"], "__q_n")


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one document of each group of near_copies(): that of the smallest doc_id, then text hash.

    Of repeated rows one stays, any of them, as they are equal in id and text; null texts are one group with blank
    ones; a null doc_id ranks before all others, and a document without one stays if it is in no other group. An
    empty table gives no rows. Columns are those of docs.
    """
    rows = near_copies(docs, width, least)
    best = rows.groupBy("root").agg(F.min(F.struct("__q_id", "__q_text")).alias("k")).select("k.*")
    order = W.partitionBy("__q_id", "__q_text").orderBy("__q_id")
    keyed = docs.select("*", *key_of())
    return keyed.join(best, ["__q_id", "__q_text"], "left_semi").withColumn("__q_n", F.row_number().over(order)).where("__q_n = 1").select(*docs.columns)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; nulls, blanks and repeats as in near_duplicates()."""
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
