"""Approximate nearest neighbours: one hierarchical navigable small-world graph for each shard.

A shard's graph is stored as flat arrays: for each layer the numbers of its nodes and a (nodes, links) array of
neighbour numbers, padded with -1. Layers are built from the top; within a layer, nodes are inserted in batches: each
batch looks for neighbours in the graph so far (and among itself), keeps a diverse selection, and links back, pruning
lists that overflow by the same selection. A search descends the upper layers greedily and runs a best-first search
with `ef` candidates on the lowest; all queries of a batch advance together.

Equal vectors are one node, so that any number of copies can't fill a neighbour list; answers name the copies by their
smallest ids, and a vector is asked once, however many copies of it are.

Vectors are put in cells by the nearest of centroids, which spherical k-means finds in a bounded sample; a cell has as
many shards as its number of vectors takes, by a hash. A query goes to the shards of the nearest cells, and their lists
are merged by distance. How many cells: as many as hold `target` of the true neighbours of a bounded sample of vectors,
which are compared with all rows. So vectors in clusters are looked for in a few shards, however many there are, and
vectors without any in nearly all. A shard is a task: its vectors come first and become the graph, which stays there;
the queries then stream past it. Graphs are never copied or sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import cut

INF = np.float32(np.inf)
Found = tuple[np.ndarray, np.ndarray]


def _top(d: np.ndarray, ids: np.ndarray, width: int, *more: np.ndarray) -> list[np.ndarray]:
    """The `width` smallest of each row, ascending, with what belongs to them."""
    order = np.argsort(d, axis=1, kind="stable")[:, :width]
    return [np.take_along_axis(x, order, axis=1) for x in (d, ids, *more)]


def diverse(x: np.ndarray, ids: np.ndarray, d: np.ndarray, keep: int) -> np.ndarray:
    """From each row of candidates (ids, -1 for none, with their distances), at most `keep`: nearest first, one only if
    it's nearer to the row's node than to those kept before; free places go to the nearest of the others."""
    d, ids = _top(np.where(ids < 0, INF, d), ids, ids.shape[1])
    if ids.shape[1] <= 1:
        return ids[:, :keep]
    v = x[np.maximum(ids, 0)]
    between = 2 - 2 * np.einsum("qid,qjd->qij", v, v, optimize=True)
    taken = np.zeros(ids.shape, dtype=bool)
    count = np.zeros(len(ids), dtype=np.int64)
    for c in range(ids.shape[1]):
        nearest = np.where(taken[:, :c], between[:, c, :c], INF).min(axis=1, initial=INF)
        taken[:, c] = (ids[:, c] >= 0) & (count < keep) & (d[:, c] < nearest)
        count += taken[:, c]
    rank = np.where(taken, 0, np.where(ids >= 0, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    order = np.argsort(rank, axis=1)[:, :keep]
    return np.take_along_axis(ids, order, axis=1)


class Graph:
    """Layers over unit (or zero) vectors x; layers[0] is the lowest. `nodes` are sorted by insertion, `links` are node
    numbers of x, `row` gives a node's row in a layer."""

    def __init__(self, x: np.ndarray, m: int = 16, ef_build: int = 64, seed: int = 3, batch: int = 256):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(int), 8)
        self.layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(int(level.max(initial=0)), -1, -1):
            nodes = np.flatnonzero(level >= at)
            nodes = nodes[np.argsort(-level[nodes], kind="stable")]
            row = np.full(n, -1, dtype=np.int32)
            row[nodes] = np.arange(len(nodes))
            links = np.full((len(nodes), 2 * m if at == 0 else m), -1, dtype=np.int32)
            self.layers = [(nodes, links, row), *made]
            self._insert(nodes, links, row, ef_build, batch, len(made[0][0]) if made else 0)
            made = self.layers
        self.layers = made

    def _insert(self, nodes: np.ndarray, links: np.ndarray, row: np.ndarray, ef: int, batch: int, above: int) -> None:
        """Inserts the layer's nodes, first the `above` ones that are in the next layer too. These start their searches
        at the first node, as a descent would end at themselves or at nodes still to come."""
        width, done = links.shape[1], 0
        while done < len(nodes):
            stop = above if done < above else len(nodes)
            new = nodes[done : min(stop, done + min(batch, max(32, done)))]
            among = 2 - 2 * self.x[new] @ self.x[new].T
            np.fill_diagonal(among, INF)
            ids, d = np.where(np.isfinite(among), new[None, :], -1), among
            d, ids = _top(d, ids, min(ef, len(new)))
            if done:
                enter = np.full(len(new), nodes[0]) if done < above else self._descend(self.x[new], 1)
                fd, found = self._search(self.x[new], enter, 0, ef)
                d, ids = np.concatenate([d, fd], axis=1), np.concatenate([ids, found], axis=1)
            chosen = diverse(self.x, ids.astype(np.int32), d, width)
            links[done : done + len(new), : chosen.shape[1]] = chosen
            own, other = np.nonzero(chosen >= 0)
            self._link_back(chosen[own, other], new[own], links, row)
            done += len(new)

    def _link_back(self, to: np.ndarray, new: np.ndarray, links: np.ndarray, row: np.ndarray) -> None:
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        targets, first, counts = np.unique(to, return_index=True, return_counts=True)
        for s in range(0, len(targets), 1024):
            part = slice(s, s + 1024)
            most = int(counts[part].max())
            extra = np.full((len(targets[part]), most), -1, dtype=np.int32)
            for i, (f, c) in enumerate(zip(first[part], counts[part])):
                extra[i, :c] = new[f : f + c]
            held = links[row[targets[part]]]
            extra[(extra[:, :, None] == held[:, None, :]).any(axis=2)] = -1
            both = np.concatenate([held, extra], axis=1)
            used = (both >= 0).sum(axis=1)
            fits = used <= links.shape[1]
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, : links.shape[1]]
            out = packed
            if not fits.all():
                ids = both[~fits]
                d = 2 - 2 * np.einsum("qcd,qd->qc", self.x[np.maximum(ids, 0)], self.x[targets[part][~fits]])
                cut_ids = diverse(self.x, ids, np.where(ids < 0, INF, d), links.shape[1])
                out[~fits] = cut_ids
            links[row[targets[part]]] = out

    def _descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """Entry points for layer to - 1: the best node that a greedy walk finds in layers above."""
        enter = np.full(len(q), self.layers[-1][0][0], dtype=np.int64)
        for at in range(len(self.layers) - 1, to - 1, -1):
            enter = self._search(q, enter, at, 4)[1][:, 0].astype(np.int64)
        return enter

    def _search(self, q: np.ndarray, enter: np.ndarray, at: int, ef: int, step: int = 2) -> Found:
        """(distances, nodes) of the ef best nodes found from the entries, ascending; -1 and inf where there are fewer."""
        nodes, links, row = self.layers[at]
        n = len(q)
        seen = np.zeros((n, len(nodes)), dtype=bool)
        best = np.full((n, ef), INF, dtype=np.float32)
        ids = np.full((n, ef), -1, dtype=np.int32)
        open_ = np.zeros((n, ef), dtype=bool)
        ids[:, 0], open_[:, 0] = enter, True
        best[:, 0] = 2 - 2 * np.einsum("ij,ij->i", q, self.x[enter])
        seen[np.arange(n), row[enter]] = True
        going = np.arange(n)
        while len(going):
            rank = np.where(open_[going], np.arange(ef), ef)
            heads = np.sort(rank, axis=1)[:, :step] if step > 1 else rank.min(axis=1)[:, None]
            live = heads[:, 0] < ef
            going, heads = going[live], heads[live]
            if not len(going):
                break
            near, who = [], []
            for c in range(heads.shape[1]):
                have = np.flatnonzero(heads[:, c] < ef)
                g, h = going[have], heads[have, c]
                open_[g, h] = False
                nb = links[row[ids[g, h]]]
                rows = row[nb]
                fresh = (nb >= 0) & ~seen[g[:, None], rows]
                r, k = np.nonzero(fresh)
                seen[g[r], rows[r, k]] = True
                wide = np.full((len(going), nb.shape[1]), -1, dtype=np.int32)
                dist = np.full((len(going), nb.shape[1]), INF, dtype=np.float32)
                picked = nb[r, k]
                wide[have[r], k] = picked
                dist[have[r], k] = 2 - 2 * np.einsum("ij,ij->i", q[g[r]], self.x[picked])
                near.append(dist)
                who.append(wide)
            d = np.concatenate([best[going], *near], axis=1)
            i = np.concatenate([ids[going], *who], axis=1)
            o = np.concatenate([open_[going], *(w >= 0 for w in who)], axis=1)
            best[going], ids[going], open_[going] = _top(d, i, ef, o)
        return best, ids

    def nearest(self, q: np.ndarray, k: int, ef: int, batch: int = 512) -> Found:
        """(distances, nodes) of the k nearest found for each query, -1 where there are fewer."""
        got = []
        for s in range(0, len(q), batch):
            part = np.ascontiguousarray(q[s : s + batch], dtype=np.float32)
            got.append([x[:, :k] for x in self._search(part, self._descend(part, 1), 0, max(ef, k))])
        return (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else (np.zeros((0, k), np.float32), np.zeros((0, k), np.int32))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(vectors.flatten(), dtype=np.float32).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel(), pa.float32()))


def centroids(x: np.ndarray, n: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means of unit vectors; an empty cell takes the vector that is worst served."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:n]]
    for _ in range(rounds):
        near = x @ c.T
        cell = near.argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, cell, x)
        for i, worst in zip(np.flatnonzero(np.bincount(cell, minlength=len(c)) == 0), np.argsort(near.max(axis=1))):
            total[i] = x[worst]
        c = _unit(total)
    return c


def _copies(dim: int, most: int, held: int = 100_000):
    """Of (id, v): each unit vector of a partition with its `most` smallest ids; sent on when `held` are there."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(found), dtype=np.float32).reshape(-1, dim)
            batch = pa.RecordBatch.from_arrays([_lists(x), pa.array(found.values(), pa.list_(pa.int64()))], names=["v", "ids"])
            found.clear()
            return batch

        for batch in batches:
            x = _unit(_matrix(batch.column(1), dim)) + np.float32(0)  # no negative zeros
            for id_, row in zip(batch.column(0).to_pylist(), x):
                ids = found.setdefault(row.tobytes(), [])
                ids.append(id_)
                if len(ids) >= 4 * most:
                    ids[:] = sorted(ids)[:most]
            if len(found) > held:
                yield flush()
        if found:
            yield flush()

    return merged


def _enough(nodes: DataFrame, x: np.ndarray, ranks: np.ndarray, k: int, target: float) -> int:
    """How many of its nearest cells a query needs so that they hold `target` of the k nearest vectors: those of the
    vectors x (their order of cells in `ranks`) are looked for by brute force in all of `nodes` (v, c)."""
    if ranks.shape[1] == 1:
        return 1
    sent, dim = nodes.sparkSession.sparkContext.broadcast(x), x.shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, cell = np.zeros((len(x), 0), dtype=np.float32), np.zeros((len(x), 0), dtype=np.int32)
        for batch in batches:
            near = np.concatenate([near, sent.value @ _matrix(batch.column(0), dim).T], axis=1)
            cell = np.concatenate([cell, np.broadcast_to(batch.column(1).to_numpy(), (len(x), batch.num_rows))], axis=1)
            order = np.argsort(-near, axis=1)[:, : k + 1]
            near, cell = np.take_along_axis(near, order, axis=1), np.take_along_axis(cell, order, axis=1)
        w = near.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(x), dtype=np.int32), w)), pa.array(near.ravel()), pa.array(cell.ravel())], names=["q", "near", "c"])

    top = nodes.select("v", "c").mapInArrow(best, "q int, near float, c int").groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("near", "c")), asc=False), 2, k).alias("n"))
    place = np.argsort(ranks, axis=1)
    need = np.sort([place[r["q"], e["c"]] for r in top.collect() for e in r["n"]])  # the first is the vector itself
    return int(need[max(0, int(np.ceil(target * len(need))) - 1)]) + 1 if len(need) else 1


def neighbours(
    vectors: DataFrame, k: int = 10, shard_rows: int = 16_384, m: int = 16, ef_build: int = 80, ef: int = 120, slice_rows: int = 16_384,
    id_column: str = "vec_id", vector_column: str = "embedding", asked: Column | None = None, probes: int | None = None, cells: int = 4096, sample_rows: int = 64,
    target: float = 0.98, trials: int = 128,
) -> DataFrame:
    """(id, neighbours) for every row with a usable vector for which `asked` is true (all by default): the k other ids
    nearest by cosine, of all rows, with their distances (1 - cosine), nearest first, ties by id.

    Centroids are fitted on `sample_rows` vectors for each of at most `cells` cells, chosen by hash; of these vectors,
    `trials` decide about the number of cells that a query looks in, unless `probes` gives it. Queries are answered
    `slice_rows` at a time. Rows with a null id, or a null, empty or non-finite vector or one of another length than most
    have, are neither asked nor found; a zero vector is at distance 1 of all others; equal vectors (and multiples of one)
    are found as neighbours at distance 0; rows that share id and vector count once, and of an id with several vectors
    the smallest counts; a table with fewer than k + 1 usable rows gives shorter lists; an empty one no rows. Other
    columns aren't read, but by `asked`."""
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<float>").alias("v"), F.coalesce(F.lit(True) if asked is None else asked, F.lit(False)).alias("asked")
    )
    rows = rows.where("id IS NOT NULL AND size(v) > 0 AND forall(v, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < float('inf'))")
    rows = cut(rows.groupBy("id").agg(F.min("v").alias("v"), F.some("asked").alias("asked")))
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = f"{id_column} bigint, neighbours array<struct<id:bigint,distance:float>>"
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = common["dim"]
    rows = rows.where(F.size("v") == dim)
    copies = lambda df: df.select("id", "v").mapInArrow(_copies(dim, k + 1), "v array<float>, ids array<bigint>")
    few = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1)  # of each partition at most k + 1, whatever the copies
    nodes = cut(copies(rows).groupBy("v").agg(few.alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids"))
    count = nodes.count()
    n = min(cells, -(-count // shard_rows))
    bound = min(1.0, 2 * n * sample_rows / count)  # of the hashes, so that a partition sends no more than it has to
    some = nodes.where(F.xxhash64("rep").cast("double") <= (2 * bound - 1) * 2.0**63).orderBy(F.xxhash64("rep"), "rep").limit(n * sample_rows)
    some_x = np.stack([np.asarray(r["v"], dtype=np.float32) for r in some.select("v").collect()])
    mean = centroids(some_x, n)
    sent = vectors.sparkSession.sparkContext.broadcast(mean)  # at most `cells` vectors

    def ranked(x: np.ndarray) -> np.ndarray:
        return np.argsort(-(x @ sent.value.T), axis=1, kind="stable").astype(np.int32)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (_matrix(batch.column(1), dim) @ sent.value.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["rep", "v", "ids", "c"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.ascontiguousarray(ranked(_matrix(batch.column(1), dim))[:, :probes])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=["rep", "v", "near"])

    placed_nodes = cut(nodes.mapInArrow(placed, "rep bigint, v array<float>, ids array<bigint>, c int"))
    sizes = {r["c"]: r["count"] for r in placed_nodes.groupBy("c").count().collect()}  # a row for each cell
    if probes is None:
        probes = _enough(placed_nodes, some_x[:trials], ranked(some_x[:trials]), k, target)
    pieces = [-(-sizes.get(c, 0) // shard_rows) for c in range(n)]
    bases = np.concatenate([[0], np.cumsum(pieces)]).tolist()
    shards = bases[-1]
    layout = vectors.sparkSession.createDataFrame([(c, bases[c], pieces[c]) for c in range(n) if pieces[c]], "c int, base int, pieces int")  # at most `cells` rows
    wanted = rows.where("asked").select("id", "v").mapInArrow(_named(dim), "asked_id bigint, v array<float>")
    asked_nodes = cut(wanted.join(nodes.select("v", "rep"), "v").select("asked_id", "rep"))
    index = placed_nodes.join(F.broadcast(layout), "c").select(
        (F.col("base") + F.pmod(F.xxhash64("rep"), "pieces")).cast("int").alias("shard"), F.lit(0).alias("kind"), "rep", "v", "ids"
    )
    queries = placed_nodes.join(asked_nodes.select("rep").distinct(), "rep", "left_semi").select("rep", "v").mapInArrow(routed, "rep bigint, v array<float>, near array<int>")
    queries = queries.select("rep", "v", F.explode("near").alias("c"))
    queries = queries.join(F.broadcast(layout), "c").select(
        F.explode(F.expr("sequence(base, base + pieces - 1)")).alias("shard"), F.lit(1).alias("kind"), "rep", "v", F.array().cast("array<bigint>").alias("ids")
    )
    found_type = pa.list_(pa.struct([("distance", pa.float32()), ("id", pa.int64())]))

    def answered(graph: Graph, ids: list[list[int]], part: pa.RecordBatch) -> pa.RecordBatch:
        d, node = graph.nearest(_matrix(part.column(3), dim), k + 1, ef)
        lists = []
        for ds, ns in zip(d.tolist(), node.tolist()):
            out = []
            for dist, i in zip(ds, ns):
                if i >= 0 and len(out) <= k:
                    out += [{"distance": max(0.0, dist / 2), "id": j} for j in ids[i]]
            lists.append(sorted(out, key=lambda e: (e["distance"], e["id"]))[: k + 1])
        return pa.RecordBatch.from_arrays([part.column(2), pa.array(lists, found_type)], names=["rep", "found"])

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        ids: list[list[int]] = []
        graph = None
        for batch in batches:
            first = int(np.searchsorted(batch.column(1).to_numpy(), 1))  # vectors come before queries
            if first:
                held.append(_matrix(batch.column(3).slice(0, first), dim))
                ids += batch.column(4).slice(0, first).to_pylist()
            if first < batch.num_rows:
                graph = graph or Graph(np.concatenate(held), m, ef_build)
                for s in range(first, batch.num_rows, slice_rows):
                    yield answered(graph, ids, batch.slice(s, slice_rows))

    both = index.unionByName(queries).repartitionById(shards, F.col("shard")).sortWithinPartitions("kind", "rep")
    found = both.mapInArrow(serve, "rep bigint, found array<struct<distance:float,id:bigint>>")
    merged = found.groupBy("rep").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k + 1).alias("n"))
    others = F.slice(F.filter("n", lambda e: e["id"] != F.col("asked_id")), 1, k)
    return asked_nodes.join(merged, "rep").select(
        F.col("asked_id").alias(id_column), F.transform(others, lambda e: F.struct(e["id"].alias("id"), e["distance"].alias("distance"))).alias("neighbours")
    )


def _named(dim: int):
    """(id, v) with v as _copies() makes it."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(_unit(_matrix(batch.column(1), dim)) + np.float32(0))], names=["asked_id", "v"])

    return made
