"""Shortest paths: a kernel for graphs of a checked size, files that tasks map for larger ones, and rounds over parts of the graph for any size.

The kernel broadcasts the graph. Pairs are found by bidirectional A* with a consistent potential, many goals of one source by one tree. Beyond
its size the edges are written to shared files once, and each search maps them, so that neither labels nor offers go to disk, however the graph
is connected. Beyond that, or where the shared folder is no file system, the vertices are cut into parts along a space-filling curve; each part is searched as far as its own edges lead, what leaves it is
exchanged, and rounds follow the number of parts that a path crosses, not of its hops.
"""

from __future__ import annotations

import heapq
import math
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspark.functions import expr
from roadspark.operators import build, storage

#: Edges and vertices that the kernel takes: 24 and 16 bytes each in a broadcast, so 160 MB at most. Larger graphs are searched by parts.
KERNEL_EDGES = 4_000_000
#: Goals of one source up to which each is searched for by itself.
FEW_GOALS = 24
#: Goals of one source that one task searches for.
GOALS_A_TASK = 4096
#: Vertices and edges of a part, and sources that one task searches from. None of them changes a result: they bound what a task holds, some 20 MB of
#: labels and 40 MB of edges, each a few times over.
PART_VERTICES, PART_EDGES, SOURCES_AT_A_TIME = 20_000, 600_000, 16
#: Edges that a step of the search within a part looks at together.
EDGES_A_STEP = 300_000
#: Vertices and edges up to which a search maps the graph: it holds some 40 bytes a vertex, and the files 16 or 20 an edge. Edges of a file, on average.
MAPPED_VERTICES, MAPPED_EDGES, FILE_EDGES = 8_000_000, 400_000_000, 1_000_000
#: Edges that are shuffled at once to write these files.
SHUFFLED_EDGES = 8_000_000
#: Distinct edges of paths up to which these are picked out of the graph without shuffling it.
FEW_EDGES = 500_000
COST = {"time": "time_s", "distance": "dist_m"}


class Csr:
    """Out-edges of each vertex, for the kernel."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, cost: np.ndarray, dist: np.ndarray, time: np.ndarray, place: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, fastest: float = 1.0) -> None:
        order = np.lexsort((dst, src))
        self.dst, self.cost, self.dist, self.time = dst[order].tolist(), cost[order].tolist(), dist[order].tolist(), time[order].tolist()
        self.size = int(max(src.max(), dst.max())) + 1 if len(src) else 0
        self.src = src[order].tolist()
        self.begin = np.searchsorted(src[order], np.arange(self.size + 1)).tolist()
        back = np.argsort(dst[order], kind="stable")
        self.into, self.into_begin = back.tolist(), np.searchsorted(dst[order][back], np.arange(self.size + 1)).tolist()
        self.fastest, self.place = fastest, {}
        if place is not None:
            self.place = dict(zip(place[0].tolist(), zip(np.radians(place[1]).tolist(), np.radians(place[2]).tolist(), strict=True), strict=True))

    def tree(self, source: int, goals: set[int] | None = None) -> tuple[dict[int, float], dict[int, int]]:
        """Settled cost of each vertex reached, and the edge by which; stops when all goals are settled. Ties go to the smaller vertex."""
        best, via, done, left = {source: 0.0}, {source: -1}, {}, set(goals) if goals is not None else None
        heap = [(0.0, source)]
        while heap and (left is None or left):
            g, u = heapq.heappop(heap)
            if u in done:
                continue
            done[u] = g
            if left is not None:
                left.discard(u)
            if u >= self.size:
                continue
            for e in range(self.begin[u], self.begin[u + 1]):
                v, h = self.dst[e], g + self.cost[e]
                if h < best.get(v, math.inf):
                    best[v], via[v] = h, e
                    heapq.heappush(heap, (h, v))
        return done, via

    def _metres(self, a: int, b: int) -> float:
        (lat1, lon1), (lat2, lon2) = self.place[a], self.place[b]
        x = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
        return 2 * expr.EARTH_M * math.asin(min(1.0, math.sqrt(x)))

    def meet(self, source: int, goal: int, metric: str) -> list[int] | None:
        """The edges of a shortest path between two vertices by bidirectional A*; null where there is none.

        Both searches use one potential, half the difference of the bounds to the goal and from the source, forwards with one sign and
        backwards with the other. The bounds are great circles, over the highest speed of the graph for time, so reduced costs aren't
        negative, and the search ends when the least keys of both sides together reach the best meeting. Ties go forwards, then to the smaller vertex.
        """
        if source == goal:
            return []
        if source >= self.size or goal >= self.size:
            return None
        bound = (lambda a, b: self._metres(a, b)) if metric == "distance" else (lambda a, b: self._metres(a, b) / self.fastest)
        known: dict[int, float] = {}

        def potential(v: int) -> float:
            if v not in known:
                known[v] = (bound(v, goal) - bound(source, v)) / 2 if self.place else 0.0
            return known[v]

        best = ({source: 0.0}, {goal: 0.0})
        via: tuple[dict[int, int], dict[int, int]] = ({source: -1}, {goal: -1})
        done: tuple[set[int], set[int]] = (set(), set())
        heaps = ([(potential(source), source)], [(-potential(goal), goal)])
        length, middle = math.inf, -1
        while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] < length:
            side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
            _, u = heapq.heappop(heaps[side])
            if u in done[side]:
                continue
            done[side].add(u)
            g, sign = best[side][u], 1 - 2 * side
            ends, begin = (self.dst, self.begin) if side == 0 else (self.src, self.into_begin)
            for k in range(begin[u], begin[u + 1]):
                e = k if side == 0 else self.into[k]
                v, h = ends[e], g + self.cost[e]
                if h < best[side].get(v, math.inf):
                    best[side][v], via[side][v] = h, e
                    heapq.heappush(heaps[side], (h + sign * potential(v), v))
                    if (whole := h + best[1 - side].get(v, math.inf)) < length:
                        length, middle = whole, v
        if middle < 0:
            return None
        edges, v = [], middle
        while (e := via[0][v]) >= 0:
            edges.append(e)
            v = self.src[e]
        edges, v = edges[::-1], middle
        while (e := via[1][v]) >= 0:
            edges.append(e)
            v = self.dst[e]
        return edges

    def edges_to(self, via: dict[int, int], goal: int) -> list[int]:
        edges = []
        while (e := via[goal]) >= 0:
            edges.append(e)
            goal = self.src[e]
        return edges[::-1]

    def totals(self, edges: list[int]) -> tuple[float, float]:
        return sum((self.time[e] for e in edges), 0.0), sum((self.dist[e] for e in edges), 0.0)

    def found(self, source: int, goals: list[int], metric: str) -> dict[int, list[int]]:
        """The edges to each goal that is reached."""
        if len(goals) <= FEW_GOALS:
            return {g: e for g in goals if (e := self.meet(source, g, metric)) is not None}
        done, via = self.tree(source, set(goals))
        return {g: self.edges_to(via, g) for g in goals if g in done}

    def answers(self, source: int, goals: list[int], metric: str) -> dict[int, tuple[float, float, list[int]]]:
        """Both totals and the vertices of the path to each goal that is reached."""
        return {g: (*self.totals(edges), [source, *(self.dst[e] for e in edges)]) for g, edges in self.found(source, goals, metric).items()}


def _broadcast_graph(costed: DataFrame, metric: str, vertex: DataFrame | None = None):
    edges = costed.filter("src <> dst").select("src", "dst", "dist_m", "time_s").toArrow()
    arrays = [edges.column(c).to_numpy() for c in ("src", "dst", COST[metric], "dist_m", "time_s")]
    if vertex is not None:
        place = vertex.select("vid", "lat", "lon").toArrow()
        timed = arrays[4] > 0
        fastest = float((arrays[3][timed] / arrays[4][timed]).max(initial=expr.MIN_SPEED_MPS)) * (1 + 1e-9)
        arrays += [tuple(place.column(c).to_numpy() for c in ("vid", "lat", "lon")), fastest]
    return uuid.uuid4().hex, costed.sparkSession.sparkContext.broadcast(arrays)


_READY: dict = {}


def _graph(shared) -> Csr:
    """The graph of a broadcast, built once in each Python worker."""
    key, arrays = shared
    if key not in _READY:
        _READY.clear()
        _READY[key] = Csr(*arrays.value)
    return _READY[key]


def _bare(costed: DataFrame) -> DataFrame:
    """The written edges of costed, to be read where costs don't matter."""
    return getattr(costed, "bare", costed)


def fits_kernel(costed: DataFrame, vertex: DataFrame | None = None) -> bool:
    costed = _bare(costed)
    return costed.limit(KERNEL_EDGES + 1).count() <= KERNEL_EDGES and (vertex is None or vertex.limit(KERNEL_EDGES + 1).count() <= KERNEL_EDGES)


def stored(costed: DataFrame, metric: str) -> DataFrame:
    """costed written once, as it is counted and read several times; what is written already stays as it is. Times need speeds: an edge without one makes a search by time an error."""
    if metric not in COST:
        raise ValueError("metric is time or distance")
    if not hasattr(costed, "kept_in"):
        speed = ["speed_mps"] if "speed_mps" in costed.columns else []
        costed = storage.keep(costed.select("src", "dst", "dist_m", "time_s", *speed))
    if metric == "time" and "speed_mps" in costed.columns and not _bare(costed).filter("speed_mps is null").isEmpty():
        raise ValueError("the graph has edges without speed, so only distance can be searched")
    return costed


def from_sources(costed: DataFrame, sources: DataFrame, metric: str = "time", method: str = "auto", goals: DataFrame | None = None) -> DataFrame:
    """(src, v, cost, time_s, dist_m): the least cost from each of sources(src) to every vertex it reaches, or to goals(v) alone, and both totals of the same path."""
    costed = stored(costed, metric)
    wanted = None if goals is None else goals.select("v").distinct()
    many = wanted is not None and wanted.limit(GOALS_A_TASK + 1).count() > GOALS_A_TASK
    if method == "parts" or method == "auto" and (many or not fits_kernel(costed)):
        if method == "auto" and (files := mapped(costed)):
            state = _trees(files, sources, metric, None if wanted is None or many else [r.v for r in wanted.collect()])  # GOALS_A_TASK at most
        else:
            state, many = by_parts(costed, sources, metric), wanted is not None
        return (state.join(wanted, "v", "left_semi") if many else state).select("src", "v", "cost", "time_s", "dist_m")
    shared = _broadcast_graph(costed, metric)
    targets = None if wanted is None else [r.v for r in wanted.collect()]  # GOALS_A_TASK at most

    def run(batches):
        graph = None
        for pdf in batches:
            graph = graph or _graph(shared)
            for source in pdf["src"].tolist():
                done, via = graph.tree(source, None if targets is None else set(targets))
                time, dist = {source: 0.0}, {source: 0.0}
                for v in done:  # in the order in which they were settled
                    if (e := via[v]) >= 0:
                        time[v], dist[v] = time[graph.src[e]] + graph.time[e], dist[graph.src[e]] + graph.dist[e]
                out = list(done) if targets is None else [v for v in targets if v in done]
                yield pd.DataFrame({"src": source, "v": out, "cost": [done[v] for v in out], "time_s": [time[v] for v in out], "dist_m": [dist[v] for v in out]})

    return _a_task_each(sources).mapInPandas(run, TREE)


TREE = "src long, v long, cost double, time_s double, dist_m double"


def _a_task_each(sources: DataFrame) -> DataFrame:
    spread = sources.select("src").distinct()
    return spread.repartition(max(1, min(spread.count(), 4096)), "src")


def _trees(files: Files, sources: DataFrame, metric: str, goals: list[int] | None) -> DataFrame:
    def run(batches):
        graph = None
        for batch in batches:
            for source in batch["src"].drop_null().to_pylist():
                graph = graph or files.open()
                yield from graph.tree(source, metric, goals).to_batches(100_000)
        pa.default_memory_pool().release_unused()  # the worker process goes on to other tasks

    return _a_task_each(sources).mapInArrow(run, TREE)


def _parts(costed: DataFrame, vertex: DataFrame | None):
    """A function that adds to rows the parts of the vertices in their columns, {column: name of the part}.

    Parts are of PART_VERTICES vertices, or fewer where these have more than PART_EDGES edges on average, along the Z-order of their places, or of
    their numbers where no places are given.
    """
    costed = _bare(costed)
    n, edges = (costed.agg(F.greatest(F.max("src"), F.max("dst"))).first()[0] or 0) + 1, costed.count()
    size = max(1, min(PART_VERTICES, PART_EDGES * n // max(1, edges)))
    if vertex is None:
        return lambda rows, ends: rows.withColumns({name: F.floor(F.col(end) / size).cast("long") for end, name in ends.items()})
    ranked = build.numbered(vertex.select("vid", expr.z_order(F.col("lat"), F.col("lon")).alias("z")), "z", "rank")
    parts = storage.keep(ranked.select("vid", F.floor(F.col("rank") / size).cast("long").alias("part")))
    return lambda rows, ends: build.looked_up(rows, parts, "vid", {end: {"part": name} for end, name in ends.items()})


def _parted(costed: DataFrame, metric: str, vertex: DataFrame | None):
    """The function of _parts(), the edges with the parts of their ends, and a function that adds cost and other to some of them; made once for a written graph and metric.

    Where costs are not written with the graph, they are not written here either, so that a round adds them to the edges of its parts alone.
    """
    made, late = costed.__dict__.setdefault("parted", {}), hasattr(costed, "cost")
    key = None if late else metric
    if key not in made:
        at = _parts(costed, vertex)
        columns = ["src", "dst", *(["speed_mps"] if late else COST.values())]
        edges, ends = _bare(costed).select(*columns).filter("src <> dst"), {"src": "part", "dst": "to"}
        # Whole parts in a file, so that a round reads few. Parts by number are told again behind the shuffle, which doesn't carry them.
        edges = at(edges, ends).repartition("part") if vertex is not None else at(at(edges, {"src": "part"}).repartition("part").drop("part"), ends)
        made[key] = at, storage.keep(edges)
    other = next(c for m, c in COST.items() if m != metric)
    named = lambda rows: rows.withColumnsRenamed({COST[metric]: "cost", other: "other"}).drop("speed_mps")
    return *made[key], (lambda rows: named(costed.cost(rows))) if late else named


@dataclass
class Files:
    """Edges in files of `size` vertices each, by their first ends: where those of a vertex begin, then the edges. Nothing is kept between tasks, so that deleted files leave the disk."""

    folder: str
    vertices: int
    size: int
    kind: list[tuple[str, str]]

    def write(self, batches):
        """All edges of some files, which come together."""
        tables = list(batches)
        if not tables:
            return
        rows = pa.Table.from_batches(tables)
        src = rows["src"].to_numpy()
        order = np.argsort(src, kind="stable")
        edges, src = np.empty(len(order), self.kind), src[order]
        for name, _ in self.kind:
            edges[name] = rows[name].to_numpy()[order]
        for k in np.unique(src // self.size).tolist():
            begin = np.searchsorted(src, np.arange(k * self.size, (k + 1) * self.size + 1))
            part = f"{self.folder}/_{k}.{uuid.uuid4().hex}"
            with open(part, "wb") as out:
                (begin - begin[0]).astype(np.int64).tofile(out)
                edges[begin[0] : begin[-1]].tofile(out)
            os.replace(part, f"{self.folder}/{k}")  # repeated or lost attempts leave whole files only
            yield pa.RecordBatch.from_pydict({"file": pa.array([k], pa.int64()), "edges": pa.array([int(begin[-1] - begin[0])], pa.int64())})

    def open(self) -> Mapped:
        return Mapped(self)


class Mapped:
    """Searches over mapped files. A search holds labels of all vertices in arrays, and looks at EDGES_A_STEP edges together."""

    def __init__(self, files: Files) -> None:
        self.n, self.size, self.files = files.vertices, files.size, []
        self.first, self.degree = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for k in range(-(-self.n // self.size)):
            path, edges = f"{files.folder}/{k}", None
            if os.path.exists(path):
                begin = np.fromfile(path, np.int64, self.size + 1)[: self.n - k * self.size + 1]
                self.first[k * self.size : (k + 1) * self.size], self.degree[k * self.size : (k + 1) * self.size] = begin[:-1], np.diff(begin)
                edges = np.memmap(path, files.kind, "r", 8 * (self.size + 1))
            self.files.append(edges)

    def _out(self, front: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The edges that leave vertices in ascending order: which of them, the other end, the cost by the metric and the other one."""
        which, edges, at = [], [], 0
        cuts = np.searchsorted(front, np.arange(1, len(self.files)) * self.size)
        for k, some in enumerate(np.split(front, cuts)):
            if len(some) and self.files[k] is not None:
                begin = self.first[some]
                owner, e = _out_of(begin, begin + self.degree[some])
                which.append(owner + at)
                edges.append(self.files[k][e])
            at += len(some)
        edges = np.concatenate(edges)
        dist = edges["dist_m"]
        time = edges["time_s"] if "time_s" in edges.dtype.names else dist / np.maximum(edges["speed_mps"], np.float32(expr.MIN_SPEED_MPS)).astype(float)
        return np.concatenate(which), edges["dst"], *((time, dist) if metric == "time" else (dist, time))

    def labels(self, source: int, metric: str, goals: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cost of each vertex, the vertex before it and the other total, as far as goals need them.

        Vertices with improved labels wait; of them the nearest go first, and what is above the farthest goal's label goes no further. Of equal
        costs the one with the lesser other total stays, so that what is asked for besides doesn't change it.
        """
        best, via, rest, waiting = np.full(self.n, np.inf), np.full(self.n, -1, np.int32), np.zeros(self.n), np.zeros(self.n, bool)
        best[source], waiting[source], bound = 0, True, np.inf
        while True:
            front = np.flatnonzero(waiting)
            if goals is not None:
                bound = best[goals].max(initial=0)
                front = front[best[front] <= bound]
            if not len(front):
                return best, via, rest
            edges = np.cumsum(self.degree[front])
            if edges[-1] > EDGES_A_STEP and len(front) > 1:
                few = max(1, int(len(front) * EDGES_A_STEP / edges[-1]))
                front = np.sort(front[np.argpartition(best[front], few - 1)[:few]])
            waiting[front] = False
            front = front[self.degree[front] > 0]
            step = np.cumsum(self.degree[front]) // EDGES_A_STEP
            for some in np.split(front, np.flatnonzero(np.diff(step)) + 1):
                if not len(some):
                    continue
                which, dst, cost, other = self._out(some, metric)
                new = best[some][which] + cost
                better = np.flatnonzero((new <= best[dst]) & (new <= bound))
                end, old, new = dst[better], some[which[better]], new[better]
                more = rest[old] + other[better]
                better = np.flatnonzero((new < best[end]) | (more < rest[end]) | (via[end] == old) & (more != rest[end]))  # the last: its path changed within rounding
                better = better[_least(end[better], new[better], more[better])]
                end = end[better]
                best[end], via[end], rest[end] = new[better], old[better], more[better]
                waiting[end] = True

    def tree(self, source: int, metric: str, goals: list[int] | None = None) -> pa.Table:
        """(src, v, cost, time_s, dist_m) of what is reached, or of those goals that are."""
        if not 0 <= source < self.n:
            v, cost, other = np.array([source] if goals is None or source in goals else [], np.int64), np.zeros(1), np.zeros(1)
            cost, other = cost[: len(v)], other[: len(v)]
        else:
            wanted = None if goals is None else np.array([g for g in goals if 0 <= g < self.n], np.int64)
            best, _, rest = self.labels(source, metric, wanted)
            v = np.flatnonzero(np.isfinite(best)) if goals is None else wanted[np.isfinite(best[wanted])]
            cost, other = best[v], rest[v]
        time, dist = (cost, other) if metric == "time" else (other, cost)
        return pa.table({"src": np.full(len(v), source), "v": v, "cost": cost, "time_s": time, "dist_m": dist})

    def answers(self, source: int, goals: list[int], metric: str) -> dict[int, tuple[float, float, list[int]]]:
        """Both totals and the vertices of the path to each goal that is reached."""
        if not 0 <= source < self.n:
            return {source: (0.0, 0.0, [source])} if source in goals else {}
        wanted = np.array([g for g in goals if 0 <= g < self.n], np.int64)
        best, via, rest = self.labels(source, metric, wanted)
        out = {}
        for g in wanted[np.isfinite(best[wanted])].tolist():
            path = [g]
            while path[-1] != source:
                path.append(int(via[path[-1]]))
            cost, other = float(best[g]), float(rest[g])
            out[g] = (*((cost, other) if metric == "time" else (other, cost)), path[::-1])
        return out


def mapped(costed: DataFrame) -> Files | None:
    """The edges of a written graph in files to be mapped, written once for both metrics; none beyond MAPPED_VERTICES or MAPPED_EDGES, or where tasks can't open files of the shared folder."""
    if "mapped" not in costed.__dict__:
        bare, costed.mapped = _bare(costed), None
        least, n, edges = bare.agg(F.least(F.min("src"), F.min("dst")), F.greatest(F.max("src"), F.max("dst")) + 1, F.count("*")).first()
        store = storage.Store(costed.sparkSession)
        if edges and least >= 0 and n <= MAPPED_VERTICES and edges <= MAPPED_EDGES and (folder := store.local()):
            # Where times follow from speeds these are kept, in half the bytes.
            slim = hasattr(costed, "cost") and dict(bare.dtypes).get("speed_mps") == "float"
            last = ("speed_mps", "<f4") if slim else ("time_s", "<f8")
            files = Files(folder, n, max(1, n * FILE_EDGES // max(edges, FILE_EDGES)), [("dst", "<i4"), ("dist_m", "<f8"), last])
            value = F.coalesce("speed_mps", F.lit(1.0).cast("float")).alias("speed_mps") if slim else F.col("time_s")
            some = max(1, SHUFFLED_EDGES // FILE_EDGES)
            for k in range(0, -(-n // files.size), some):
                of = F.floor(F.col("src") / files.size)
                rows = bare.filter((F.col("src") >= k * files.size) & (F.col("src") < (k + some) * files.size) & (F.col("src") != F.col("dst"))).repartitionById(some, (of - k).cast("int"))
                rows = costed.cost(rows) if hasattr(costed, "cost") else rows
                storage.keep(rows.select("src", "dst", "dist_m", value).mapInArrow(files.write, "file long, edges long"))
            costed.mapped = files
    return costed.mapped


EDGES = ["src", "dst", "to", "cost", "other"]
STATE = "part long, src long, v long, u long, cost double, other double, hops int, inner boolean"


def _least(at: np.ndarray, cost: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """The row of least cost of each place, and of equal ones that with the least of what follows."""
    order = np.lexsort((*then, cost, at))
    return order[np.append(True, at[order][1:] != at[order][:-1])] if len(order) else order


def _out_of(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number of the ranges, the range and the number."""
    sizes = end - begin
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - (np.cumsum(sizes) - sizes - begin)[which]


def _search_part(key: tuple, state: pa.Table, edges: pa.Table) -> pa.Table:
    """Labels of a part after its own edges are used up, and the offers to other parts that better labels give.

    state holds known labels (inner) and offers; an offer that is no better than a known label brings nothing. Labels are tables of
    sources and vertices, and each step improves the ends of all edges that leave labels improved by the step before.
    """
    part = key[0].as_py()
    src, dst, to, cost, other = (edges[c].to_numpy() for c in EDGES)
    order = np.argsort(src, kind="stable")
    src, dst, to, cost, other = (c[order] for c in (src, dst, to, cost, other))
    inside = to == part
    s_src, s_v, s_cost, s_other, s_hops, s_inner = (state[c].to_numpy() for c in ("src", "v", "cost", "other", "hops", "inner"))
    s_u = state["u"].fill_null(-1).to_numpy()
    verts, sources = np.unique(np.concatenate([src, dst[inside], s_v])), np.unique(s_src)
    n = len(verts)
    best, via = np.full(len(sources) * n, np.inf), np.full(len(sources) * n, -1)
    rest, hops, fresh = np.zeros(len(best)), np.zeros(len(best), np.int32), np.zeros(len(best), bool)

    def put(at, c, u, o, h):
        best[at], via[at], rest[at], hops[at] = c, u, o, h

    at = np.searchsorted(sources, s_src) * n + np.searchsorted(verts, s_v)
    put(at[s_inner], s_cost[s_inner], s_u[s_inner], s_other[s_inner], s_hops[s_inner])
    offered = np.flatnonzero(~s_inner)
    offered = offered[s_cost[offered] < best[at[offered]]]
    offered = offered[_least(at[offered], s_cost[offered])]
    put(at[offered], s_cost[offered], s_u[offered], s_other[offered], s_hops[offered])
    front = at[offered]
    fresh[front] = True
    i_dst, i_cost, i_other = np.searchsorted(verts, dst[inside]), cost[inside], other[inside]
    begin, end = (np.searchsorted(src[inside], verts, side) for side in ("left", "right"))
    while len(front):
        found = []
        step = np.cumsum((end - begin)[front % n]) // EDGES_A_STEP
        for some in np.split(front, np.flatnonzero(np.diff(step)) + 1):
            which, e = _out_of(begin[some % n], end[some % n])
            target, new = (some // n * n)[which] + i_dst[e], best[some][which] + i_cost[e]
            better = np.flatnonzero(new < best[target])
            better = better[_least(target[better], new[better])]
            which, e, target = which[better], e[better], target[better]
            old = some[which]
            put(target, new[better], verts[old % n], rest[old] + i_other[e], hops[old] + 1)
            found.append(target)
        front = np.unique(np.concatenate(found))
        fresh[front] = True
    label = np.flatnonzero(np.isfinite(best))
    made = [(np.full(len(label), part), sources[label // n], verts[label % n], via[label], best[label], rest[label], hops[label], True)]
    o_dst, o_to, o_cost, o_other = (c[~inside] for c in (dst, to, cost, other))
    begin, end = (np.searchsorted(src[~inside], verts, side) for side in ("left", "right"))
    fresh = np.flatnonzero(fresh)
    step = np.cumsum((end - begin)[fresh % n]) // EDGES_A_STEP
    ends = np.unique(o_dst)
    for some in np.split(fresh, np.flatnonzero(np.diff(step)) + 1):
        which, e = _out_of(begin[some % n], end[some % n])
        new = best[some][which] + o_cost[e]
        least = _least((some // n)[which] * len(ends) + np.searchsorted(ends, o_dst[e]), new)
        old, e = some[which[least]], e[least]
        made.append((o_to[e], sources[old // n], o_dst[e], verts[old % n], new[least], rest[old] + o_other[e], hops[old] + 1, False))
    out = []
    for p, s, v, u, c, o, h, inner in made:
        columns = [pa.array(p, pa.int64()), pa.array(s), pa.array(v), pa.array(u, pa.int64(), mask=u < 0), pa.array(c), pa.array(o), pa.array(h, pa.int32()), pa.array(np.full(len(s), inner))]
        out.append(pa.table(columns, ["part", "src", "v", "u", "cost", "other", "hops", "inner"]))
    pa.default_memory_pool().release_unused()  # the worker process goes on to other tasks
    return pa.concat_tables(out)


def by_parts(costed: DataFrame, sources: DataFrame, metric: str = "time", vertex: DataFrame | None = None) -> DataFrame:
    """(src, v, u, cost, time_s, dist_m, hops): the least cost from each of sources(src) to every vertex it reaches, the vertex before it, both totals and the number of edges.

    Each round searches every part that got offers, and writes its labels; a part without offers is carried over as it is.
    """
    costed = stored(costed, metric)
    store = storage.Store(costed.sparkSession)
    at, edges, priced = _parted(costed, metric, vertex)
    first = sources.select("src").distinct()
    first = first.join(at(first, {"src": "part"}), "src", "left").withColumn("part", F.coalesce("part", F.lit(-1)))
    zero = F.lit(0.0)
    start = first.select("part", "src", F.col("src").alias("v"), F.lit(None).cast("long").alias("u"), zero.alias("cost"), zero.alias("other"), F.lit(0).alias("hops"), F.lit(False).alias("inner"))
    chunk = F.pmod(F.xxhash64("src"), F.lit(max(1, -(-start.count() // SOURCES_AT_A_TIME))))
    state = store.keep(start)
    offers = store.keep(start)
    while not offers.isEmpty():
        labels = state.filter("inner")
        open_parts = store.keep(offers.select("part", chunk.alias("chunk")).distinct())
        work = labels.unionByName(offers).withColumn("chunk", chunk)
        searched = open_parts.count()
        tasks = max(1, min(4096, searched))  # work is much for its bytes, so tasks aren't put together by size
        near = F.broadcast(open_parts) if searched <= 100_000 else open_parts
        busy = work.join(near, ["part", "chunk"], "left_semi").repartition(tasks, "part", "chunk")
        idle = labels.withColumn("chunk", chunk).join(near, ["part", "chunk"], "left_anti").drop("chunk")
        spread = priced(edges.withColumnRenamed("part", "of").join(near.select(F.col("part").alias("of"), F.col("chunk").alias("of_chunk")), "of")).repartition(tasks, "of", "of_chunk")
        done = busy.groupBy("part", "chunk").cogroup(spread.groupBy("of", "of_chunk")).applyInArrow(_search_part, STATE)
        state = store.keep(idle.unionByName(done), instead_of=state)
        # Offers that are no better than what is known go now, so that their parts aren't searched.
        least = state.filter("not inner").groupBy("src", "v").agg(F.min("cost").alias("cost")).join(state.filter("inner").select("src", "v", F.col("cost").alias("known")), ["src", "v"], "left")
        least = least.filter("known is null or cost < known").select("src", "v", "cost")
        offers = store.keep(state.filter("not inner").join(least, ["src", "v", "cost"], "left_semi"), instead_of=offers)
    one, two = (COST[metric], next(c for m, c in COST.items() if m != metric))
    totals = {one: F.col("cost"), two: F.col("other")}
    return state.filter("inner").select("src", "v", "u", "cost", *[totals[c].alias(c) for c in ("time_s", "dist_m")], "hops")


def _far_routes(costed: DataFrame, known: DataFrame, metric: str, full: bool, vertex: DataFrame) -> DataFrame:
    """(qid, time_s, dist_m, n_nodes, path) by parts, then with full steps back from the goals, of each pair of ends once."""
    state = by_parts(costed, known.select("src"), metric, vertex)
    pairs = known.select("src", "dst").distinct().join(state.select("src", F.col("v").alias("dst"), "time_s", "dist_m", "hops"), ["src", "dst"])
    pairs = storage.keep(pairs.select("src", "dst", "time_s", "dist_m", (F.col("hops") + 1).alias("n_nodes")))
    if not full:
        return known.join(pairs, ["src", "dst"]).select("qid", "time_s", "dist_m", "n_nodes", F.lit(None).cast("array<long>").alias("path"))
    store = storage.Store(costed.sparkSession)
    at = store.keep(pairs.select("src", "dst", F.col("dst").alias("v"), F.lit(0).alias("step")))
    steps = at
    while not at.isEmpty():
        before = at.join(state.select("src", "v", "u"), ["src", "v"]).filter("u is not null")
        at = store.keep(before.select("src", "dst", F.col("u").alias("v"), (F.col("step") + 1).alias("step")))
        steps = steps.unionByName(at)
    path = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("step", "v")))), lambda h: h["v"])
    found = store.keep(pairs.join(steps.groupBy("src", "dst").agg(path.alias("path")), ["src", "dst"]))
    return known.join(found, ["src", "dst"]).select("qid", "time_s", "dist_m", F.size("path").alias("n_nodes"), "path")


def routes(costed: DataFrame, vertex: DataFrame, queries: DataFrame, metric: str = "time", full: bool = True) -> DataFrame:
    """(qid, src, dst, time_s, dist_m, n_nodes, path) for queries(qid, src, dst); nulls where there is no route or an id is unknown."""
    costed = stored(costed, metric)
    known = queries.join(vertex.select(F.col("vid").alias("src")), "src", "left_semi").join(vertex.select(F.col("vid").alias("dst")), "dst", "left_semi")
    kernel = fits_kernel(costed, vertex)
    files = None if kernel else mapped(costed)
    if not kernel and not files:
        found = _far_routes(costed, known, metric, full, vertex)
        return queries.join(found, "qid", "left").select("qid", "src", "dst", "time_s", "dist_m", "n_nodes", "path")
    shared = None if files else _broadcast_graph(costed, metric, vertex)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        graph, source = files.open() if files else _graph(shared), int(pdf["src"].iloc[0])
        found, out = graph.answers(source, sorted(set(pdf["dst"].tolist())), metric), []
        for qid, goal in zip(pdf["qid"].tolist(), pdf["dst"].tolist(), strict=True):
            if goal in found:
                time, dist, path = found[goal]
                out.append((qid, time, dist, len(path), path if full else None))
        return pd.DataFrame(out, columns=["qid", "time_s", "dist_m", "n_nodes", "path"])

    # A source with very many goals is split by goals; few goals of one source stay together.
    many = known.groupBy("src").agg(F.ceil(F.count("*") / GOALS_A_TASK).cast("int").alias("splits"))
    dealt = known.join(many, "src").withColumn("split", F.pmod(F.xxhash64("dst"), F.col("splits")).cast("int"))
    tasks = min(4096, max(1, many.agg(F.sum("splits")).first()[0] or 0))  # rows are few and work is much, so tasks aren't put together by size
    found = dealt.repartition(tasks, "src", "split").groupBy("src", "split").applyInPandas(run, "qid long, time_s double, dist_m double, n_nodes int, path array<long>")
    return queries.join(found, "qid", "left").select("qid", "src", "dst", "time_s", "dist_m", "n_nodes", "path")


def path_totals(found: DataFrame, costed: DataFrame) -> DataFrame:
    """(qid, time_s, dist_m) of paths(qid, path), added up from the edges again."""
    hops = found.filter(F.size("path") > 0).select("qid", F.explode(F.when(F.size("path") > 1, F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).alias("src"), F.get("path", i).alias("dst"))))).alias("h"))
    hops = hops.select("qid", "h.src", "h.dst")
    used = storage.keep(hops.select("src", "dst").distinct())
    few = used.limit(FEW_EDGES + 1).count() <= FEW_EDGES
    edges = _bare(costed).join(F.broadcast(used) if few else used, ["src", "dst"], "left_semi")
    edges = (costed.cost(edges) if hasattr(costed, "cost") else edges).select("src", "dst", "time_s", "dist_m")
    sums = hops.join(edges, ["src", "dst"]).groupBy("qid").agg(F.sum("time_s").alias("time_s"), F.sum("dist_m").alias("dist_m"))
    return found.filter(F.size("path") > 0).select("qid").join(sums, "qid", "left").na.fill(0.0)


def k_hops(edges: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """(src, v, hops): vertices within k edges of each source, with the least number."""
    reached = sources.select("src", F.col("src").alias("v"), F.lit(0).alias("hops"))
    front = reached
    step = edges.filter("src <> dst").select(F.col("src").alias("v"), F.col("dst").alias("w"))
    for i in range(1, k + 1):
        front = front.join(step, "v").select("src", F.col("w").alias("v"), F.lit(i).alias("hops")).distinct()
        reached = reached.unionByName(front)
    return reached.groupBy("src", "v").agg(F.min("hops").alias("hops"))


def milli(value: Column) -> Column:
    """Thousandths, truncated, of a number with six decimals."""
    return F.floor(F.round(value * 1e6) / 1000).cast("long")


def matrix(costed: DataFrame, stops: DataFrame, metric: str = "time", compat_unreachable: bool = False) -> DataFrame:
    """(i, j, time_ms, dist_mm) between all stops(i, vid): both totals of the path that is least by the metric, in thousandths, truncated; null where there is no route, or -1000 if asked for."""
    sources = stops.select(F.col("vid").alias("src"))
    least = from_sources(costed, sources, metric, goals=stops.select(F.col("vid").alias("v")))
    a, b = stops.select("i", F.col("vid").alias("src")), stops.select(F.col("i").alias("j"), F.col("vid").alias("v"))
    pairs = a.join(least, "src").join(b, "v").select("i", "j", "time_s", "dist_m")
    every = a.select("i").join(b.select("j"), F.lit(True))  # stops are few: a matrix has a cell for each pair by definition
    none = F.lit(-1000) if compat_unreachable else F.lit(None).cast("long")
    cell = lambda c: F.when(F.col("i") == F.col("j"), 0).otherwise(F.coalesce(milli(F.col(c)), none)).cast("long")
    return every.join(pairs, ["i", "j"], "left").select("i", "j", cell("time_s").alias("time_ms"), cell("dist_m").alias("dist_mm"))


def nearest(points: DataFrame, vertex: DataFrame, cell: float = 0.002) -> DataFrame:
    """(id, vid, d2): the vertex nearest to each point in squared degrees, the smallest vid on ties.

    Vertices are bucketed in a grid, and each point looks at the ring of cells around it; points for which the ring holds no
    vertex closer than its own edge look again with cells sixteen times as wide, until all are found. Points without coordinates have no row.
    """
    if vertex.isEmpty():
        return points.select("id", F.lit(0).cast("long").alias("vid"), F.lit(None).cast("double").alias("d2"))
    store, found = storage.Store(points.sparkSession), None
    left, width = points.select("id", "lat", "lon"), cell
    while True:
        at = lambda c, w=width: F.floor(F.col(c) / w)
        grid = vertex.select("vid", F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"), at("lat").alias("gy"), at("lon").alias("gx"))
        near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
        probe = left.withColumn("dy", F.explode(near)).withColumn("dx", F.explode(near)).withColumn("gy", at("lat") + F.col("dy")).withColumn("gx", at("lon") + F.col("dx"))
        d2 = expr.degrees_squared(F.col("lat"), F.col("lon"), F.col("v_lat"), F.col("v_lon"))
        best = probe.join(grid, ["gy", "gx"]).groupBy("id").agg(F.min(F.struct(d2.alias("d2"), F.col("vid"))).alias("m")).select("id", "m.vid", "m.d2")
        sure = store.keep(best.filter(F.sqrt("d2") <= width))
        found = sure if found is None else found.unionByName(sure)
        left = store.keep(left.join(sure.select("id"), "id", "left_anti"))
        if width > 720 or left.isEmpty():
            return found
        width *= 16
