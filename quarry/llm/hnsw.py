"""Near-duplicate vectors: a hierarchical navigable small-world graph for each shard, all shards asked by every vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_hot, settle, table
from .simhash import _merge
from .vectors import matrix, scan_blocks

FOUND = "n long, links long, roots array<long>"


class Graph:
    """A hierarchical navigable small-world graph of unit vectors, by inner product; built and searched in batches.

    Rows are ordered by level, the highest first, so the members of a layer are its first rows. Layers are built from
    the top; a row enters a layer where the layer above found it, takes `links` diverse neighbours (2 * links at most
    in the lowest layer, with those that take it), and every row of the lowest layer can be reached.
    """

    def __init__(self, x: np.ndarray, links: int = 16, ef: int = 64, batch: int = 512, seed: int = 7):
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(links)).astype(int)
        self.order = np.argsort(-level, kind="stable")  # place -> row of x
        self.x = np.ascontiguousarray(x[self.order], np.float32)
        self.sizes = [int((level >= i).sum()) for i in range(level.max() + 1)] if len(x) else []
        self.layers: list[np.ndarray] = [None] * len(self.sizes)
        for at in range(len(self.sizes) - 1, -1, -1):
            self._build(at, links, ef, batch)
        if self.sizes:
            self._reach()

    def _build(self, at: int, links: int, ef: int, batch: int) -> None:
        size, cap = self.sizes[at], links * (2 if at == 0 else 1)
        net = self.layers[at] = np.full((size, cap + 2), -1, np.int32)  # the last two are for rows that nothing reaches
        degree, first = np.zeros(size, np.int64), 0
        above = self.sizes[at + 1] if at + 1 < len(self.sizes) else 0
        while first < size:
            end = min(size, first + min(batch, max(64, first)))
            if first < above < end:
                end = above
            own = self.x[first:end]
            near = own @ own.T
            np.fill_diagonal(near, -np.inf)
            k = min(ef, end - first)
            at_own = np.argpartition(-near, k - 1, axis=1)[:, :k]
            ids, sims = at_own + first, np.take_along_axis(near, at_own, axis=1)
            if first:
                entry = self._entry(own, at) if first >= above > 0 else np.zeros(len(own), np.int64)
                more, s = self._beam(at, own, entry, ef, first)
                ids, sims = np.concatenate([ids, more], axis=1), np.concatenate([sims, s], axis=1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
            ids, sims = np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)
            chosen = self._diverse(ids, sims, links)
            row, col = np.nonzero(chosen)
            to = ids[row, col]
            net[row + first, _nth(row)] = to
            degree[first:end] = np.bincount(row, minlength=end - first)
            self._link_back(net, degree, to, row + first, sims[row, col], cap)
            first = end

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Which candidates (sorted by sims, -inf for none) to take: those nearer to the row than to a taken one, then
        the nearest of the others."""
        fine = np.isfinite(sims)
        v = self.x[np.where(fine, ids, 0)]
        pair = v @ v.transpose(0, 2, 1)
        taken, count = np.zeros(ids.shape, bool), np.zeros(len(ids), np.int64)
        for j in range(ids.shape[1]):
            taken[:, j] = fine[:, j] & (count < most) & ~(taken & (pair[:, j] > sims[:, j, None])).any(axis=1)
            count += taken[:, j]
        rest = fine & ~taken
        return taken | (rest & (np.cumsum(rest, axis=1) <= (most - count)[:, None]))

    def _link_back(self, net: np.ndarray, degree: np.ndarray, to: np.ndarray, frm: np.ndarray, sims: np.ndarray, cap: int) -> None:
        order = np.lexsort((-sims, to))
        to, frm, sims = to[order], frm[order], sims[order]
        nth = _nth(to)
        whole, new = np.unique(to, return_counts=True)
        full = whole[degree[whole] + new > cap]
        room = ~np.isin(to, full)
        net[to[room], degree[to[room]] + nth[room]] = frm[room]
        for i in range(0, len(full), 256):
            t = full[i : i + 256]
            mine = np.isin(to, t) & (nth < 64)  # a hub takes the nearest of very many
            ids = np.full((len(t), cap + 64), -1, np.int64)
            ids[:, :cap] = net[t, :cap]
            ids[np.searchsorted(t, to[mine]), cap + nth[mine]] = frm[mine]
            s = np.einsum("ijk,ik->ij", self.x[np.maximum(ids, 0)], self.x[t])
            s[ids < 0] = -np.inf
            best = np.argsort(-s, axis=1, kind="stable")
            ids, s = np.take_along_axis(ids, best, axis=1), np.take_along_axis(s, best, axis=1)
            row, col = np.nonzero(self._diverse(ids, s, cap))
            net[t, :cap] = -1
            net[t[row], _nth(row)] = ids[row, col]
            degree[t] = np.bincount(row, minlength=len(t))
        some = degree[whole] + new <= cap
        degree[whole[some]] += new[some]

    def _reach(self) -> None:
        """Link rows of the lowest layer that cannot be reached from its first row to near rows that can."""
        net, size = self.layers[0], self.sizes[0]
        known = np.zeros(size, bool)

        def spread(front):
            while len(front):
                known[front] = True
                front = np.unique(net[front])
                front = front[front >= 0]
                front = front[~known[front]]

        spread(np.arange(1))
        while not known.all():
            lost = np.flatnonzero(~known)[0]
            near = self._beam(0, self.x[[lost]], np.zeros(1, np.int64), min(64, size), size)[0][0]
            near = near[near >= 0]
            free = near[(net[near, -2:] < 0).any(axis=1)]
            host = free[0] if len(free) else np.flatnonzero(known & (net[:, -2:] < 0).any(axis=1))[0]
            net[host, -2 if net[host, -2] < 0 else -1] = lost
            spread(np.array([lost]))

    def _entry(self, q: np.ndarray, at: int) -> np.ndarray:
        """The row nearest to each query that a greedy walk finds in the layers above `at`."""
        entry = np.zeros(len(q), np.int64)
        for i in range(len(self.sizes) - 1, at, -1):
            entry = self._beam(i, q, entry, 1, self.sizes[i])[0][:, 0]
        return entry

    def _beam(self, at: int, q: np.ndarray, entry: np.ndarray, ef: int, upto: int, width: int = 4):
        """(places, similarities) of the ef best rows met from entry, best first; -1 and -inf for none.

        Each step opens the best `width` rows of every beam that were not opened yet, until all of a beam's are.
        """
        net, n = self.layers[at], len(q)
        ids, sims, fresh = np.full((n, ef), -1, np.int64), np.full((n, ef), -np.inf, np.float32), np.zeros((n, ef), bool)
        ids[:, 0], sims[:, 0], fresh[:, 0] = entry, np.einsum("ij,ij->i", self.x[entry], q), True
        seen = np.zeros(n * upto, bool)
        seen[np.arange(n) * upto + entry] = True
        live = np.arange(n)
        while len(live):
            mine = fresh[live]
            row, col = np.nonzero(mine & (np.cumsum(mine, axis=1) <= width))
            row = live[row]
            fresh[row, col] = False
            to = net[ids[row, col]]
            flat = (row[:, None] * upto + to)[to >= 0]
            flat = np.unique(flat[~seen[flat]])
            seen[flat] = True
            row, to = np.divmod(flat, upto)
            s = np.einsum("ij,ij->i", self.x[to], q[row])
            better = s > sims[row, -1]
            row, to, s = row[better], to[better], s[better]
            if len(row):
                who, code, many = np.unique(row, return_inverse=True, return_counts=True)
                new_i, new_s = np.full((len(who), many.max()), -1, np.int64), np.full((len(who), many.max()), -np.inf, np.float32)
                nth = _nth(row)
                new_i[code, nth], new_s[code, nth] = to, s
                all_s = np.concatenate([sims[who], new_s], axis=1)
                best = np.argsort(-all_s, axis=1, kind="stable")[:, :ef]
                sims[who] = np.take_along_axis(all_s, best, axis=1)
                ids[who] = np.take_along_axis(np.concatenate([ids[who], new_i], axis=1), best, axis=1)
                fresh[who] = np.take_along_axis(np.concatenate([fresh[who], new_i >= 0], axis=1), best, axis=1)
            live = live[fresh[live].any(axis=1)]
        return ids, sims

    def search(self, q: np.ndarray, ef: int):
        """(rows, similarities) of the ef best rows that a beam of ef finds for each query; -1 and -inf for none."""
        q = np.ascontiguousarray(q, np.float32)
        ids, sims = self._beam(0, q, self._entry(q, 0), min(ef, len(self.x)), len(self.x))
        return np.where(ids < 0, -1, self.order[ids]), sims


def _nth(group: np.ndarray) -> np.ndarray:
    """The place of each element among those of its group; equal groups stand together."""
    if not len(group):
        return np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return np.arange(len(group)) - np.repeat(new, np.diff(np.concatenate((new, [len(group)]))))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths, in doubles; components of any finite size."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Shard:
    """One shard's vectors (n, vector, copies): its graph, the links within it, and those of the queries it is asked.

    The beam starts at `ef` and is doubled until an audit finds the share `recall` of what a scan of the shard finds.
    The audit's queries are `probes` rows turned away from themselves to just the least cosine, the hardest links
    there can be, so it says as much where links are few. A beam of a quarter of the shard gives way to the scan.
    """

    def __init__(self, t: pa.Table, least: float, ef: int, recall: float, probes: int):
        self.n, self.copies = t.column("n").to_numpy(), t.column("copies").to_numpy()
        self.x, self.least = unit(matrix(t.column("vector").combine_chunks())), least
        self.graph, self.small = Graph(self.x), self.x.astype(np.float32)
        self.ef = self._audited(ef, recall, probes)
        self.links, self.label = np.zeros(len(self.n), np.int64), np.arange(len(self.n))
        for q in self._portions(len(self.n)):
            for i, p in self._near(self.x[q], self.ef):
                i, p = q[i][p < q[i]], p[p < q[i]]  # each pair once, by its later row
                np.add.at(self.links, i, self.copies[p])
                np.add.at(self.links, p, self.copies[i])
                if len(i):
                    self.label = _merge(self.label, i, p)

    def _portions(self, count: int):
        step = int(max(16, min(512, (1 << 26) // max(1, len(self.n)))))
        return (np.arange(i, min(i + step, count)) for i in range(0, count, step))

    def _audited(self, ef: int, recall: float, probes: int) -> int:
        rng = np.random.default_rng(len(self.n))
        rows = rng.choice(len(self.n), min(probes, len(self.n)), replace=False)
        u, away = self.x[rows], rng.normal(size=(len(rows), self.x.shape[1]))
        away -= (away * u).sum(axis=1, keepdims=True) * u
        cosine = min(1.0, self.least + 1e-4)
        q = unit(cosine * u + np.sqrt(1 - cosine**2) * away / np.maximum(1e-300, np.sqrt((away**2).sum(axis=1, keepdims=True))))
        true = sum(int((q[i] @ self.x.T >= self.least).sum()) for i in self._portions(len(q)))
        while ef * 4 < len(self.n):
            if sum(len(p) for i in self._portions(len(q)) for _, p in self._near(q[i], ef)) >= recall * true:
                return ef
            ef *= 2
        return len(self.n)

    def _near(self, q: np.ndarray, ef: int):
        """(query, row) arrays of the rows found whose cosine is least or more, checked in doubles.

        A query whose beam is more than half full of them is asked again with a beam twice as wide.
        """
        todo = np.arange(len(q))
        while len(todo):
            if ef * 4 >= len(self.n):
                i, p = np.nonzero(q[todo].astype(np.float32) @ self.small.T >= self.least - 1e-4)
                again = todo[:0]
            else:
                ids, sims = self.graph.search(q[todo], ef)
                hit = sims >= self.least - 1e-4
                wide = 2 * hit.sum(axis=1) > ef
                again = todo[wide]
                i, c = np.nonzero(hit & ~wide[:, None])
                p = ids[i, c]
            i = todo[i]
            for a in range(0, len(i), 1 << 14):
                x, y = i[a : a + (1 << 14)], p[a : a + (1 << 14)]
                sure = np.einsum("ij,ij->i", q[x], self.x[y]) >= self.least
                yield x[sure], y[sure]
            todo, ef = again, ef * 2

    def ask(self, t: pa.Table):
        q, n, copies = unit(matrix(t.column("vector").combine_chunks())), t.column("n").to_numpy(), t.column("copies").to_numpy()
        for part in self._portions(len(n)):
            links, roots = np.zeros(len(part), np.int64), [set() for _ in part]
            for i, p in self._near(q[part], self.ef):
                np.add.at(links, i, self.copies[p])
                np.add.at(self.links, p, copies[part[i]])
                for a, b in np.unique(np.stack([i, self.label[p]]), axis=1).T.tolist():
                    roots[a].add(int(self.n[b]))
            some = np.flatnonzero(links)
            if len(some):
                yield self._rows(n[part[some]], links[some], [sorted(roots[i]) for i in some])

    def end(self):
        some = np.flatnonzero(self.links)
        if len(some):
            yield self._rows(self.n[some], self.links[some], self.n[self.label[some], None].tolist())

    @staticmethod
    def _rows(n, links, roots):
        return pa.RecordBatch.from_arrays([pa.array(n), pa.array(links), pa.array(roots, pa.list_(pa.int64()))], ["n", "links", "roots"])


def near_vectors(rows: DataFrame, least: float = 0.9, shards: int = 8, shard_rows: int = 131072, ef: int = 32, recall: float = 0.998, probes: int = 512) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of rows (id, vector as array<double>).

    n_links counts the other rows whose cosine is found to be `least` or more; component_id is the smallest id that
    links reach, the row's own included; kept is whether it is the row's own. A vector that is null, empty or all zero,
    or holds a null, NaN or infinite component, links with nothing; a vector meets only those of its own length; rows
    with equal vectors are linked, and those of one id are rows of their own; a null id is never a component's
    smallest; an empty table gives no rows.

    Equal vectors are one, with their number. Vectors are dealt into `shards` shards by hash (fewer of under 1,024
    vectors, more of over shard_rows); each builds its graph in one task and widens its beam as Shard says. Each two
    shards meet once: a vector goes to half of the others, and both of a pair count the link. Of a group of copies
    no list of pairs is made: a shard unites its own links, and a query names the united ones that it touches.
    """
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(F.col("vector").isNotNull() & (F.size("vector") > 0) & fine, F.lit(False))
    keyed = rows.select(F.col("id").cast("long").alias("id"), "vector", F.when(usable, F.md5(F.concat_ws(",", F.col("vector").cast("array<string>")))).alias("__q_k"))
    same = keyed.where("__q_k is not null").groupBy("__q_k").agg(F.count("*").alias("copies"), F.min("id").alias("low"), F.first("vector").alias("vector"))
    each = settle(same.withColumn("n", F.monotonically_increasing_id()))
    count = each.count()
    shards = max(1, min(shards, count // 1024), -(-count // shard_rows))
    name = lambda i: F.concat_ws(":", F.size("vector"), i)
    dealt = each.select("n", "vector", "copies", F.pmod(F.xxhash64("__q_k"), F.lit(shards)).alias("i"))
    steps = F.array(*[F.lit(i) for i in range(1, (shards - 1) // 2 + 1)]).cast("array<int>")
    if shards % 2 == 0:  # the shard opposite is met from one side
        steps = F.when(F.col("i") < shards // 2, F.concat(steps, F.array(F.lit(shards // 2)))).otherwise(steps)
    asked = dealt.withColumn("i", F.explode(F.transform(steps, lambda s: (F.col("i") + s) % shards)))
    block = lambda df: df.select(name(F.col("i")).alias("block"), "n", "vector", "copies")
    found = settle(scan_blocks(block(dealt), block(asked), lambda t: Shard(t, least, ef, recall, probes), FOUND))

    group = components(found.select(F.col("n").alias("a"), F.explode("roots").alias("b")).where("a != b"))
    links = found.groupBy("n").agg(F.sum("links").alias("links"))
    at = each.select("__q_k", "n", "low", "copies").join(links, "n", "left").join(group, F.col("n") == F.col("node"), "left")
    at = settle(at.select("__q_k", F.coalesce("root", "n").alias("root"), "low", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    lows = at.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("__q_n"))
    named = settle(join_hot(at, settle(lows), ["root"], "__q_n").select("__q_k", "n_links", "component_id", F.col("copies").alias("__q_n")))
    linked = join_hot(keyed.where("__q_k is not null").select("id", "__q_k"), named, ["__q_k"], "__q_n").select("id", "n_links", "component_id")
    alone = keyed.where("__q_k is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op11_vector_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and component of every vector by cosine 0.9, whatever its label; odd rows as near_vectors() says."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return near_vectors(rows).withColumnRenamed("id", "vec_id")
