"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard, as flat arrays.

Distinct vectors are dealt to shards by length and direction: first by the power of two of their length (so that one long
vector does not drown all others in a shard's arithmetic), then by the nearest of some pivots, which are fitted on a
bounded sample; a crowded cell has several shards. A shard's graph has levels as usual: level 0 holds all its vectors with
up to 2 M neighbours each, a higher level one in M of the level below with up to M neighbours, all in flat int32 arrays.
Vectors are scaled by their power of two and get one more component so that all have the same length, which turns the
largest inner product into the smallest distance; they are put in batches, each found its neighbours by searching the
graph so far (and the batch itself), spread out by the usual heuristic. Search runs all queries of a block at once in numpy.

A query goes to the cells that promise most. How many is measured: SAMPLE_QUERIES queries are compared with all vectors,
and as many cells are asked as hold COVER of their true neighbours. So the work for a query does not grow with the number
of shards, unless the data have no structure that cells could follow. Results are merged by exact scores in double precision.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import remove, written

K, M, BUILD, SEARCH = 20, 24, 96, 320
#: Vectors of a shard on average; queries of a block.
SHARD_ROWS, BLOCK = 16_384, 512
#: Vectors that pivots are fitted on, at most; vectors of the sample for each pivot, at least; rounds of the fit.
SAMPLE, PER_PIVOT, ROUNDS = 65_536, 16, 6
#: Queries on which the number of cells is measured; the share of their true neighbours to be reached; up to so many cells all are asked.
SAMPLE_QUERIES, COVER, FEW_CELLS = 256, 0.99, 4


class Graph:
    """One shard: vectors (n, d) of similar lengths, none over 1, and per level the members and their neighbours (-1 pads)."""

    def __init__(self, vectors: np.ndarray, m: int = M, build: int = BUILD, seed: int = 11):
        self.m, self.build = m, build
        norm = np.einsum("ij,ij->i", vectors.astype(np.float64), vectors.astype(np.float64))
        more = np.sqrt(np.maximum(norm.max(initial=0.0) - norm, 0))
        self.x = np.concatenate((vectors, more[:, None]), axis=1).astype(np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        top = np.minimum((-np.log(1 - rng.random(n)) / math.log(m)).astype(np.int64), 6)
        order = rng.permutation(n)
        self.levels = int(top.max(initial=0)) + 1
        self.links = [np.full((n if lev == 0 else 0, 2 * m), -1, np.int32) if lev == 0 else np.full((n, m), -1, np.int32) for lev in range(self.levels)]
        self.top = top
        done = min(n, 4 * build)
        first = order[:done]
        self.entry = int(first[top[first].argmax()]) if n else -1
        for lev in range(self.levels):
            ids = first[top[first] >= lev]
            self._connect(lev, ids, [ids] * 1 if len(ids) else [])
        while done < n:
            part = order[done : done + min(1024, max(build, done // 4))]
            self._insert(part)
            done += len(part)

    def _connect(self, lev: int, ids: np.ndarray, pools: list[np.ndarray], found: np.ndarray | None = None) -> None:
        """Links ids on a level to the best of found (ids by -1-padded candidates) and of themselves."""
        if not len(ids):
            return
        width = self.links[lev].shape[1]
        sims = self.x[ids] @ self.x[ids].T
        np.fill_diagonal(sims, -np.inf)
        near = min(len(ids) - 1, self.build)
        own = np.argpartition(-sims, near - 1, axis=1)[:, :near] if near > 0 else np.zeros((len(ids), 0), int)
        cand = ids[own].astype(np.int32)
        if found is not None:
            cand = np.concatenate((found, cand), axis=1)
        chosen = self._spread(ids, cand, width // 2 if lev == 0 else width)
        self.links[lev][ids, : chosen.shape[1]] = chosen
        a, b = np.repeat(ids, chosen.shape[1]), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        self._back(lev, b.astype(np.int64), a)

    def _back(self, lev: int, to: np.ndarray, new: np.ndarray) -> None:
        """Adds new[i] to the neighbours of to[i]; where there is no room, the neighbours are chosen anew."""
        links = self.links[lev]
        width = links.shape[1]
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        who, cuts, counts = np.unique(to, return_index=True, return_counts=True)
        most = int(counts.max(initial=0))
        extra = np.full((len(who), most), -1, np.int32)
        extra[np.repeat(np.arange(len(who)), counts), np.arange(len(to)) - np.repeat(cuts, counts)] = new
        extra[(extra[:, :, None] == links[who][:, None, :]).any(axis=2)] = -1
        both = np.concatenate((links[who], extra), axis=1)
        size = (both >= 0).sum(axis=1)
        room = size <= width
        packed = np.take_along_axis(both[room], np.argsort(both[room] < 0, axis=1, kind="stable"), axis=1)[:, :width]
        links[who[room]] = packed
        full = np.flatnonzero(~room)
        for at in range(0, len(full), 512):
            part = full[at : at + 512]
            chosen = self._spread(who[part], both[part], width)
            links[who[part]] = -1
            links[who[part], : chosen.shape[1]] = chosen

    def _spread(self, ids: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
        """The usual choice: nearest first, passing over who is nearer to one chosen than to the node; then the nearest of those passed over."""
        out = np.full((len(ids), most), -1, np.int32)
        for at in range(0, len(ids), 256):
            i, c = ids[at : at + 256], cand[at : at + 256]
            s = np.einsum("ijk,ik->ij", self.x[np.maximum(c, 0)], self.x[i])
            s[(c < 0) | (c == i[:, None])] = -np.inf
            order = np.argsort(-s, axis=1, kind="stable")[:, : self.build]
            c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
            twice = np.zeros(c.shape, bool)
            sorted_ = np.sort(c, axis=1)
            if (sorted_[:, 1:] == sorted_[:, :-1]).any():
                for j in range(1, c.shape[1]):
                    twice[:, j] = (c[:, :j] == c[:, j : j + 1]).any(axis=1)
            s[twice] = -np.inf
            v = self.x[np.maximum(c, 0)]
            among = np.matmul(v, v.transpose(0, 2, 1))
            taken = np.zeros(c.shape, bool)
            count = np.zeros(len(i), int)
            for j in range(c.shape[1]):
                good = (s[:, j] > -np.inf) & (count < most) & ~((among[:, j, :] > s[:, j : j + 1]) & taken).any(axis=1)
                taken[good, j] = True
                count += good
            rank = np.where(taken, 0, np.where(s > -np.inf, 1, 2)) * c.shape[1] + np.arange(c.shape[1])
            best = np.argsort(rank, axis=1)[:, :most]
            out[at : at + 256, : best.shape[1]] = np.where(np.take_along_axis(s, best, 1) > -np.inf, np.take_along_axis(c, best, 1), -1)
        return out

    def _insert(self, ids: np.ndarray) -> None:
        q = self.x[ids]
        enter = self._down(q, self.levels - 1, self.top[ids])
        for lev in range(min(self.levels - 1, int(self.top[ids].max())), -1, -1):
            some = np.flatnonzero(self.top[ids] >= lev)
            found, _ = self.beam(q[some], enter[some], lev, self.build)
            enter[some] = np.where(found[:, 0] >= 0, found[:, 0], enter[some])
            self._connect(lev, ids[some], [], found)
        if self.top[ids].max() > self.top[self.entry]:
            self.entry = int(ids[self.top[ids].argmax()])

    def _down(self, q: np.ndarray, level: int, until: np.ndarray | int) -> np.ndarray:
        """Greedy walk from the entry through the levels above `until`."""
        at = np.full(len(q), self.entry, np.int64)
        best = np.einsum("ij,ij->i", q, self.x[at])
        for lev in range(level, 0, -1):
            go = np.flatnonzero(np.broadcast_to(until, len(q)) < lev)
            while len(go):
                near = self.links[lev][at[go]]
                s = np.einsum("ijk,ik->ij", self.x[np.maximum(near, 0)], q[go])
                s[near < 0] = -np.inf
                j = s.argmax(axis=1)
                top = s[np.arange(len(go)), j]
                up = top > best[go]
                go, j, top, near = go[up], j[up], top[up], near[up]
                at[go], best[go] = near[np.arange(len(go)), j], top
        return at

    def beam(self, q: np.ndarray, enter: np.ndarray, lev: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest found from `enter` on a level, nearest first: places (-1 pads) and products."""
        n, links = len(q), self.links[lev]
        ids = np.full((n, width), -1, np.int32)
        sims = np.full((n, width), -np.inf, np.float32)
        open_ = np.zeros((n, width), bool)
        seen = np.zeros((n, len(self.x)), bool)
        ids[:, 0], open_[:, 0] = enter, True
        sims[:, 0] = np.einsum("ij,ij->i", q, self.x[enter])
        seen[np.arange(n), enter] = True
        live = np.arange(n)
        while len(live):
            s = np.where(open_[live], sims[live], -np.inf)
            j = s.argmax(axis=1)
            live, j = (x[s[np.arange(len(live)), j] > -np.inf] for x in (live, j))
            if not len(live):
                break
            open_[live, j] = False
            near = links[ids[live, j]]
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            row, col = np.nonzero(fresh)
            there = near[row, col]
            seen[live[row], there] = True
            got = np.full(near.shape, -np.inf, np.float32)
            got[row, col] = np.einsum("ij,ij->i", self.x[there], q[live[row]])
            some = np.flatnonzero(got.max(axis=1) > sims[live].min(axis=1))
            if not len(some):
                continue
            rows = live[some]
            s = np.concatenate((sims[rows], got[some]), axis=1)
            c = np.concatenate((ids[rows], near[some]), axis=1)
            o = np.concatenate((open_[rows], np.ones((len(rows), near.shape[1]), bool)), axis=1)
            best = np.argpartition(-s, width - 1, axis=1)[:, :width]
            sims[rows], ids[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(c, best, 1)
            open_[rows] = np.take_along_axis(o, best, 1) & (sims[rows] > -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        sims = np.take_along_axis(sims, order, 1)
        return np.where(sims > -np.inf, np.take_along_axis(ids, order, 1), -1), sims

    def search(self, queries: np.ndarray, width: int = SEARCH) -> np.ndarray:
        """Places of the nearest found for each query (d components), -1 pads."""
        if not len(self.x):
            return np.full((len(queries), 0), -1, np.int32)
        q = np.concatenate((queries, np.zeros((len(queries), 1), np.float32)), axis=1).astype(np.float32)
        return self.beam(q, self._down(q, self.levels - 1, 0), 0, min(width, len(self.x)))[0]

    def dump(self) -> bytes:
        return pickle.dumps((self.x, self.links, self.top, self.entry, self.m, self.build), protocol=5)

    @classmethod
    def load(cls, data: bytes) -> Graph:
        g = cls.__new__(cls)
        g.x, g.links, g.top, g.entry, g.m, g.build = pickle.loads(data)
        g.levels = len(g.links)
        return g


def usable(vector: Column) -> Column:
    """No null, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def band_of(vector: Column) -> Column:
    """The power of two below a vector's length (its length is at least 2**band and less than twice that)."""
    most = F.array_max(F.transform(vector, F.abs))
    square = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + (x / most) * (x / most))
    return F.floor(F.log2(most) + F.log2(square) / 2).cast("int")


def _floats(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def directions(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, however long they were."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def fit_pivots(x: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """n directions (or fewer) around which the rows of x, themselves directions, lie."""
    pivots = x[np.random.default_rng(seed).permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[at : at + 4096] @ pivots.T).argmax(axis=1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(size > 0, sums / np.maximum(size, 1e-30), pivots)
    return pivots


class Cells:
    """Pivots of each band of one dimension: bands (cells,) and pivots (cells, dim)."""

    def __init__(self, bands: np.ndarray, pivots: np.ndarray):
        self.bands, self.pivots = bands, pivots

    def cell(self, x: np.ndarray, bands: np.ndarray) -> np.ndarray:
        """The cell of each vector: of those of its band the one with the nearest pivot."""
        out, u = np.zeros(len(x), np.int64), directions(x)
        for band in np.unique(bands):
            mine, rows = np.flatnonzero(self.bands == band), np.flatnonzero(bands == band)
            out[rows] = mine[(u[rows] @ self.pivots[mine].T).argmax(axis=1)]
        return out

    def ranked(self, q: np.ndarray) -> np.ndarray:
        """Cells by what they promise each query, best first: long vectors and near directions."""
        promise = np.log2(1.0001 + directions(q) @ self.pivots.T) + self.bands
        return np.argsort(-promise, axis=1, kind="stable")


def _cells(places: DataFrame, shard_rows: int) -> dict[int, Cells]:
    """Cells of each dimension, fitted on at most about SAMPLE vectors (those with the smallest hashes)."""
    sizes = places.groupBy("dim", "band").count().collect()  # a row for each power of two that occurs: some 2,100 a dimension at most
    total = sum(r["count"] for r in sizes)
    share = min(1.0, SAMPLE / max(total, 1))
    sample: dict[tuple[int, int], np.ndarray] = {}
    if any(r["count"] > shard_rows for r in sizes):
        rows = places.filter(F.pmod(F.xxhash64("h", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20))).select("dim", "band", "v").toArrow()
        dims, bands = rows.column("dim").to_numpy(), rows.column("band").to_numpy()
        for dim, band in {(r["dim"], r["band"]) for r in sizes if r["count"] > shard_rows}:
            sample[dim, band] = directions(_floats(rows.filter(pa.array((dims == dim) & (bands == band))).column("v"), dim))
    found: dict[int, tuple[list, list]] = {}
    for r in sorted(sizes, key=lambda r: (r["dim"], r["band"])):
        x = sample.get((r["dim"], r["band"]))
        n = 0 if x is None else min(math.ceil(r["count"] / shard_rows), len(x) // PER_PIVOT)
        pivots = fit_pivots(x, n) if n > 1 else np.zeros((1, r["dim"]), np.float32)
        bands, every = found.setdefault(r["dim"], ([], []))
        bands += [r["band"]] * len(pivots)
        every.append(pivots)
    return {dim: Cells(np.array(bands), np.concatenate(every)) for dim, (bands, every) in found.items()}


def _asked_cells(placed: DataFrame, wanted: DataFrame, cells: dict[int, Cells], k: int) -> int:
    """To how many cells a query has to go, so that COVER of the true k neighbours of a sample of queries are reached."""
    most = max((len(c.bands) for c in cells.values()), default=1)
    if most <= FEW_CELLS:
        return most
    rows = wanted.orderBy(F.xxhash64("h", F.lit("queries")), "h").limit(SAMPLE_QUERIES).select("dim", "v").toArrow()
    asked = {}
    for dim in set(rows.column("dim").to_pylist()) & set(cells):
        q = _floats(rows.filter(pa.array(rows.column("dim").to_numpy() == dim)).column("v"), dim)
        place = np.argsort(cells[dim].ranked(q), axis=1)  # of each cell in each query's order
        asked[dim] = (directions(q).astype(np.float64), place)

    def run(it):
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in it:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in asked:
                    continue
                part = b.filter(pa.array(dims == dim))
                q, place = asked[dim]
                cell = part.column("cell").to_numpy()
                scores, ranks = q @ _floats(part.column("v"), dim).T, place[:, cell]
                if dim in kept:
                    scores, ranks = (np.concatenate(x, axis=1) for x in ((kept[dim][0], scores), (kept[dim][1], ranks)))
                best = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
                kept[dim] = np.take_along_axis(scores, best, 1), np.take_along_axis(ranks, best, 1)
        for dim, (scores, ranks) in kept.items():
            n = scores.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(scores.size, dim), pa.int32()), pa.array(np.repeat(np.arange(len(scores)), n)), pa.array(scores.ravel()), pa.array(ranks.ravel(), pa.int64())], ["dim", "q", "score", "rank"])

    near = placed.select("dim", "cell", "v").mapInArrow(run, "dim int, q long, score double, rank long")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("dim", "q").orderBy(F.desc("score")))).filter(F.col("r") <= k + 1)
    counts = dict(best.groupBy("rank").count().collect())
    reached, total = 0, sum(counts.values())
    for rank in range(most):
        reached += counts.get(rank, 0)
        if reached >= COVER * total:
            return max(rank + 1, FEW_CELLS)
    return most


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, width: int = SEARCH, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k rows of `vectors` found nearest to each row of `queries`.

    Both have the columns `key` and `vector`. Score is the inner product in double precision of the vectors as they
    are; ties go to the smaller id. A row is no candidate for a query with its own id. Vectors that are null, zero or
    hold a null or non-finite component, and rows with a null id, take no part; rows equal in id and vector count once.
    Vectors of different lengths are not compared. Fewer than k candidates: all of them. Equal vectors are one place of
    the graph with their k + 1 smallest ids: a query can return no more of them.
    """
    held = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("h", F.xxhash64("v"))
    asked = written(queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("query_id").isNotNull() & usable(F.col("v"))).withColumn("h", F.xxhash64("v")).distinct(), "queries")
    first = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))  # Spark limits each partition's ranks before the shuffle
    equal = held.distinct().withColumn("r", first).filter(F.col("r") <= k + 1).groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    places = written(equal.withColumn("dim", F.size("v")).withColumn("band", band_of(F.col("v"))), "places")
    cells = _cells(places, shard_rows)

    def put(it):
        for b in it:
            dims, bands = b.column("dim").to_numpy(), b.column("band").to_numpy()
            cell = np.zeros(b.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                cell[rows] = cells[dim].cell(_floats(b.column("v").take(pa.array(rows)), dim), bands[rows])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    schema = "h long, v array<double>, ids array<long>, dim int, band int"
    placed = written(places.select("h", "v", "ids", "dim", "band").mapInArrow(put, schema + ", cell int"), "placed")
    remove(places)
    #: Shards of each cell: one, or more where it is crowded.
    shards = {(r["dim"], r["cell"]): math.ceil(r["count"] / (2 * shard_rows)) for r in placed.groupBy("dim", "cell").count().collect()}
    wanted = written(asked.select("h", "v").distinct().withColumn("dim", F.size("v")), "wanted")
    probes = _asked_cells(placed, wanted, cells, k)

    def build(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        x = _floats(t.column("v"), dim)
        ids = t.column("ids").combine_chunks()
        graph = Graph(np.ldexp(x, -1 - t.column("band")[0].as_py()).astype(np.float32))
        return pa.table(
            [pa.array([dim], pa.int32()), t.column("cell").slice(0, 1), t.column("shard").slice(0, 1), pa.array([graph.dump()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([ids.flatten().to_numpy().tobytes()], pa.binary()), pa.array([ids.value_lengths().to_numpy().astype(np.int64).tobytes()], pa.binary())],
            names=["dim", "cell", "shard", "graph", "x", "ids", "sizes"],
        )

    spread = F.create_map(*(F.lit(x) for (dim, cell), n in shards.items() if n > 1 for x in (f"{dim}/{cell}", n)))
    shard = F.pmod("h", F.coalesce(F.try_element_at(spread, F.concat_ws("/", "dim", "cell")), F.lit(1))) if any(n > 1 for n in shards.values()) else F.lit(0)
    index = written(placed.withColumn("shard", shard.cast("int")).groupBy("dim", "cell", "shard").applyInArrow(build, "dim int, cell int, shard int, graph binary, x binary, ids binary, sizes binary"), "graphs")

    def route(it):  # a row for each shard that a query goes to
        for b in it:
            dims = b.column("dim").to_numpy()
            rows, to, of = [], [], []
            for dim in np.unique(dims).tolist():
                if dim not in cells:
                    continue
                mine = np.flatnonzero(dims == dim)
                for at in range(0, len(mine), 2048):
                    some = mine[at : at + 2048]
                    for i, best in zip(some.tolist(), cells[dim].ranked(_floats(b.column("v").take(pa.array(some)), dim))[:, :probes].tolist(), strict=True):
                        for c in best:
                            for n in range(shards.get((dim, c), 0)):
                                rows.append(i)
                                to.append(c)
                                of.append(n)
            for at in range(0, len(rows), 4096):
                x = slice(at, at + 4096)
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows[x], pa.int64())).columns, pa.array(to[x], pa.int32()), pa.array(of[x], pa.int32())], [*b.schema.names, "at", "piece"])

    routed = written(wanted.select("h", "v", "dim").mapInArrow(route, "h long, v array<double>, dim int, at int, piece int"), "routed")
    parts = routed.groupBy("dim", "at", "piece").agg(F.ceil(F.count(F.lit(1)) / (8 * BLOCK)).cast("int").alias("parts")).withColumnRenamed("dim", "size")

    def search(graph: pa.Table, block: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if graph.num_rows and block.num_rows:
            g, dim = Graph.load(graph.column("graph")[0].as_py()), graph.column("dim")[0].as_py()
            x = np.frombuffer(graph.column("x")[0].as_py(), np.float64).reshape(-1, dim)
            ids = np.frombuffer(graph.column("ids")[0].as_py(), np.int64)
            sizes = np.frombuffer(graph.column("sizes")[0].as_py(), np.int64)
            starts = np.cumsum(sizes) - sizes
            q, h = _floats(block.column("v"), dim), block.column("h").to_numpy()
            for at in range(0, len(q), BLOCK):
                part = q[at : at + BLOCK]
                found = g.search(directions(part), max(width, k + 1))
                for i, near in enumerate(found):
                    near = near[near >= 0]
                    score = np.einsum("ij,j->i", x[near], part[i])
                    each = sizes[near]
                    every = np.concatenate([ids[s : s + c] for s, c in zip(starts[near].tolist(), each.tolist(), strict=True)]) if len(near) else np.zeros(0, np.int64)
                    score = np.repeat(score, each)
                    best = np.lexsort((every, -score))[: k + 1]
                    rows.append((h[at + i], part[i], every[best], score[best]))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.float64()))], names=["h", "v", "ids", "scores"])

    there = [F.col("dim") == F.col("size"), F.col("cell") == F.col("at"), F.col("shard") == F.col("piece")]
    copies = parts.select(*(F.col(c).alias(c) for c in ("size", "at", "piece")), F.col("parts").alias("copies"))
    left = index.join(copies, there).drop("size", "at", "piece").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")  # a graph once for each few thousand of its queries
    right = routed.withColumnRenamed("dim", "size").join(parts, ["size", "at", "piece"]).withColumn("into", F.pmod(F.xxhash64("h"), "parts").cast("int")).drop("parts")
    found = left.groupBy("dim", "cell", "shard", "part").cogroup(right.groupBy("size", "at", "piece", "into")).applyInArrow(search, "h long, v array<double>, ids array<long>, scores array<double>")
    each = found.select("h", "v", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("h", "v", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    nearest_first = Window.partitionBy("h", "v").orderBy(F.desc("score"), "vec_id")
    merged = each.withColumn("r", F.row_number().over(nearest_first)).filter(F.col("r") <= k + 1).groupBy("h", "v").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    merged = written(merged, "nearest")
    for done in (placed, wanted, index, routed):
        remove(done)
    mine = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asked.join(merged, ["h", "v"]).select("query_id", F.posexplode(mine).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
