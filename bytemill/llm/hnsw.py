"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one class from the start. Classes are dealt to shards by a hash; each shard builds a graph of its members once, audits it
and writes it to the shared folder. Every class queries every shard of vectors of its length: a task holds one graph and a slice of
SLICE queries (up to MOST times as many where there are TASKS tasks without that, so that graphs are not sent more often than needed), so
neither a large table nor a hot shard is one task's. Insertion and search run in NumPy for a whole batch of vectors in lock step. A query descends the layers, searches the bottom one with a beam, and then
follows links from every member at the threshold or above to further such members, so a dense group of any size
is found whole without a beam of its size. What is found comes in pieces of at most CELLS links, and what has been seen is a bit map of at most SEEN
queries times members at once, so a task's memory does not grow with its groups. Cosines that look like links are verified in double precision.

A shard's audit has two parts, and both must reach a recall of RECALL: AUDIT members are turned by a random direction to the very
threshold and must be found again, and for AUDIT members all links, as brute force finds them, must be found. The beam is doubled until
they are; where WIDEST does not do (a dense group in which members lack links to each other, say), the shard is searched by brute force, in blocks. The result names the least recall of any shard.

Links are not emitted as pairs: a query returns how many members of a shard it links to and one of them; the task unites
the members that one query links. Components of those edges are the result. Rows whose vector is null,
empty, zero or holds null or non-finite components, or whose id is null, have no links; vectors of different lengths
are not compared. Repeated rows are vectors of their own, linked to each other; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytemill.llm.arrow import groups, mapped
from bytemill.llm.graph import components
from bytemill.llm.shared import kept

#: Links a node keeps (twice as many in the bottom layer), beam while building, at first in search and at most, batch sizes.
M, BUILD, BEAM, WIDEST, BATCH = 12, 48, 32, 256, 512
AUDIT, RECALL, NEAREST = 256, 0.995, 4
#: Least number of shards, most classes and bytes of vectors of a shard, queries that share a task, bytes of a row that holds a part of a graph.
SHARDS, MEMBERS, BYTES, SLICE, PART = 2, 50_000, 64 << 20, 8192, 4 << 20
#: Tasks from which on they get up to MOST slices of queries each; links looked at together, queries times members whose state is held, bytes of vectors multiplied at once.
TASKS, MOST, CELLS, SEEN, HELD = 64, 8, 1 << 18, 4 << 20, 16 << 20


def products(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of x[i] and y[j], row by row, HELD bytes at a time."""
    n = max(1, HELD // (x.itemsize * max(1, x.shape[1])))
    return np.concatenate([np.einsum("id,id->i", x[i[k : k + n]], y[j[k : k + n]]) for k in range(0, len(i), n)] or [np.zeros(0, x.dtype)])


class Graph:
    """A layered graph over the rows of x (unit vectors)."""

    def __init__(self, x: np.ndarray, seed: int = 1, links: list[np.ndarray] | None = None):
        """links: those of a graph of the same x and seed that was built before."""
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        n = len(x)
        level = np.minimum(8, (-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(M)).astype(int))
        order = np.argsort(-level, kind="stable")
        self.x, self.row, level = self.x[order], order, level[order]  # nodes are numbered from the highest layer down
        self.sizes = [int((level >= k).sum()) for k in range(int(level[0]) + 1 if n else 0)]
        if links is not None:
            self.links = links
            return
        self.links = [np.full((s, 2 * M if not k else M), -1, dtype=np.int32) for k, s in enumerate(self.sizes)]
        done = 0
        while done < n:
            end = min(n, done + max(1, min(BATCH, done)))
            self._insert(done, end)
            done = end
        if n > 1:
            self._adopt()

    def _insert(self, a: int, b: int) -> None:
        q = self.x[a:b]
        for k in range(len(self.links)):
            end = min(b, self.sizes[k])
            if end <= a:
                break
            mine = q[: end - a]
            own = mine @ mine.T
            own[np.triu_indices(len(mine))] = -2  # only nodes with smaller numbers
            ids = np.broadcast_to(np.arange(a, end), own.shape)
            if a:
                found, sims = self.search(mine, BUILD, bottom=k, known=a)
                ids, own = np.concatenate([found, ids], axis=1), np.concatenate([sims, own], axis=1)
            ids = np.where(own > -2, ids, -1)
            self._connect(k, np.arange(a, end), ids, own)

    def _adopt(self) -> None:
        """Sees to it that each node of the bottom layer is linked from one of its NEAREST nearest: where dense groups have crowded its links out, the one of these with fewest such additions gets one."""
        links = self.links[0]
        extra: dict[int, list[int]] = {}
        for i in range(0, len(links), 4 * BATCH):
            rows = np.arange(i, min(len(links), i + 4 * BATCH))
            sims = np.where(links[rows] >= 0, np.einsum("bcd,bd->bc", self.x[links[rows]], self.x[rows]), -2)
            near = np.take_along_axis(links[rows], np.argsort(-sims, axis=1, kind="stable")[:, :NEAREST], 1)
            back = ((links[near] == rows[:, None, None]) & (near >= 0)[:, :, None]).any(axis=(1, 2))
            for o, own in zip(rows[~back].tolist(), near[~back].tolist(), strict=True):
                if own := [p for p in own if p >= 0]:
                    extra.setdefault(min(own, key=lambda p: len(extra.get(p, ()))), []).append(o)
        if extra:
            more = np.full((len(links), max(map(len, extra.values()))), -1, dtype=np.int32)
            for p, own in extra.items():
                more[p, : len(own)] = own
            self.links[0] = np.concatenate([links, more], axis=1)

    def _connect(self, k: int, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        width = self.links[k].shape[1]
        self.links[k][nodes] = self._chosen(ids, sims, width if not k else M)[:, :width]
        chosen = self.links[k][nodes]
        r, c = np.nonzero(chosen >= 0)
        to, new = chosen[r, c], nodes[r]
        by = np.argsort(to, kind="stable")
        to, new = to[by], new[by]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        for i in range(0, len(targets), BATCH):
            t, f, n = targets[i : i + BATCH], first[i : i + BATCH], count[i : i + BATCH]
            extra = np.full((len(t), int(n.max())), -1, dtype=np.int64)
            at = np.arange(extra.shape[1])
            inside = at < n[:, None]
            extra[inside] = new[(f[:, None] + at)[inside]]
            ids = np.concatenate([self.links[k][t], extra], axis=1)
            sims = np.where(ids >= 0, np.einsum("bcd,bd->bc", self.x[ids], self.x[t]), -2)
            self.links[k][t] = self._chosen(ids, sims, width)

    def _chosen(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """For each row up to `most` of ids: first those nearer to it than to any chosen before, then the nearest others."""
        top = min(ids.shape[1], 4 * M)
        by = np.argsort(-sims, axis=1)[:, :top]
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        near = self.x[ids]
        closest = np.full(ids.shape, -2, dtype=np.float32)  # to a chosen one
        chosen = np.zeros(ids.shape, dtype=bool)
        for j in range(top):
            take = (ids[:, j] >= 0) & (sims[:, j] > closest[:, j])
            chosen[:, j] = take
            rows = np.flatnonzero(take)
            if len(rows) and j + 1 < top:
                s = np.einsum("bcd,bd->bc", near[rows, j + 1 :], near[rows, j])
                closest[rows, j + 1 :] = np.maximum(closest[rows, j + 1 :], s)
        rank = np.where(ids >= 0, np.where(chosen, 0, 1), 2) * top + np.arange(top)
        by = np.argsort(rank, axis=1)[:, :most]
        out = np.take_along_axis(ids, by, 1)
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out

    def search(self, q: np.ndarray, beam: int, bottom: int = 0, known: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of up to `beam` near nodes of each query, in no order; -1 and -2 fill up. known: only the nodes below this number are in the graph."""
        known = len(self.x) if known is None else known
        ids = np.zeros((len(q), 1), dtype=np.int64)
        sims = (q @ self.x[:1].T).astype(np.float32)
        for k in range(len(self.links) - 1, bottom - 1, -1):
            if k > bottom and min(known, self.sizes[k]) <= 1:
                continue
            ids, sims = self._beam(q, k, ids, sims, beam if k == bottom else 4, known)
        return ids, sims

    def _beam(self, q: np.ndarray, k: int, ids: np.ndarray, sims: np.ndarray, beam: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        links, n = self.links[k], len(q)
        seen = np.zeros((n, min(known, self.sizes[k]) + 1), dtype=bool)
        seen[:, -1] = True  # where -1 points
        rows = np.arange(n)
        seen[rows[:, None], ids] = True
        open_ = ids >= 0
        active = rows
        while len(active):
            best = np.where(open_[active], sims[active], -3)
            at = np.argpartition(-best, min(2, best.shape[1] - 1), axis=1)[:, :3]
            go = np.take_along_axis(best, at, 1) > -3
            alive = go.any(axis=1)
            active, at, go = active[alive], at[alive], go[alive]
            if not len(active):
                break
            node = np.where(go, ids[active[:, None], at], -1)
            open_[active[:, None], at] = False
            near = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(active), -1)
            near = np.where(near < known, near, -1)
            fresh = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            near = np.where(fresh, near, -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1  # the same neighbour of two nodes
            r, c = np.nonzero(near >= 0)
            s = np.full(near.shape, -2, dtype=np.float32)
            s[r, c] = products(self.x, near[r, c], q, active[r])
            all_ids, all_s = np.concatenate([ids[active], near], axis=1), np.concatenate([sims[active], s], axis=1)
            all_open = np.concatenate([open_[active], near >= 0], axis=1)
            if all_ids.shape[1] > beam:
                by = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
                all_ids, all_s, all_open = (np.take_along_axis(v, by, 1) for v in (all_ids, all_s, all_open))
            if all_ids.shape[1] != ids.shape[1]:
                grow = all_ids.shape[1] - ids.shape[1]
                ids, sims, open_ = (np.pad(v, ((0, 0), (0, grow)), constant_values=z) for v, z in ((ids, -1), (sims, -2), (open_, False)))
            ids[active], sims[active], open_[active] = all_ids, all_s, all_open
        return ids, sims

    def near(self, q: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces (query, node) of the nodes with a similarity of `least` or more: those the beam meets, and what links lead to from them. No pair comes twice."""
        ids, sims = self.search(q, beam)
        met = (sims >= least) & (ids >= 0)
        some, n, links = np.flatnonzero(met.any(axis=1)), len(self.x), self.links[0]
        step = max(1, CELLS // links.shape[1])
        for a in range(0, len(some), rows := max(1, SEEN // (n + 1))):
            at = some[a : a + rows]
            seen = np.zeros((len(at), n + 1), dtype=bool)
            seen[np.arange(len(at))[:, None], ids[at]] = True
            seen[:, -1] = True
            query, c = np.nonzero(met[at])
            node = ids[at][query, c]
            yield at[query], self.row[node]
            query, node = query.astype(np.int32), node.astype(np.int32)
            while len(query):
                found = []
                for i in range(0, len(query), step):
                    to = links[node[i : i + step]]
                    who = np.repeat(query[i : i + step], to.shape[1])
                    to = to.ravel()
                    fresh = ~seen[who, to]
                    pair = np.unique(who[fresh].astype(np.int64) * n + to[fresh])
                    who, to = pair // n, pair % n
                    seen[who, to] = True
                    hit = products(self.x, to, q, at[who]) >= least
                    who, to = who[hit], to[hit]
                    yield at[who], self.row[to]
                    found.append((who.astype(np.int32), to.astype(np.int32)))
                query, node = (np.concatenate(f) for f in zip(*found, strict=True))

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """All that near() finds at once."""
        found = list(self.near(q, least, beam))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def brute(x: np.ndarray, q: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces (query, row of x) of all pairs with a product of `least` or more."""
    n = max(1, 4 * CELLS // max(1, len(q)))
    for i in range(0, len(x), n):
        r, c = np.nonzero(q @ x[i : i + n].T >= least)
        yield r, c + i


def audited(graph: Graph, x: np.ndarray, least: float, beam: int = BEAM) -> tuple[int, float]:
    """The beam with which planted members and all links of some members are found, and the recall (the lower of both) then; a beam of 0 if none does."""
    r = np.random.default_rng(7)
    some = r.permutation(len(x))[:AUDIT]
    v = x[some]
    aside = r.normal(size=v.shape)
    aside -= (aside * v).sum(axis=1, keepdims=True) * v
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    planted = np.where(length > 1e-9, least * v + np.sqrt(1 - least * least) * aside / np.maximum(length, 1e-9), v)
    links = np.zeros((len(some), len(x)), dtype=bool)
    for query, node in brute(x, v, least):
        links[query, node] = True
    while True:
        again, met = np.zeros(len(some), dtype=bool), np.zeros_like(links)
        for query, node in graph.near(planted.astype(np.float32), least - 1e-4, beam):
            again[query[node == some[query]]] = True
        for query, node in graph.near(v.astype(np.float32), least - 1e-4, beam):
            met[query, node] = True
        recall = min(again.sum() / max(1, len(some)), (links & met).sum() / links.sum() if links.any() else 1.0)
        if recall >= RECALL:
            return beam, float(recall)
        if beam >= WIDEST:
            return 0, float(recall)
        beam *= 2


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _vectors(batch: pa.RecordBatch, a: int, b: int) -> np.ndarray:
    column = batch.column("v")
    at = column.offsets.to_numpy().astype(np.int64)
    return _unit(column.values.to_numpy(zero_copy_only=False)[at[a] : at[b]].reshape(b - a, -1).astype(np.float64))


def _build(least: float):
    """Rows (shard, part, blob, recall): each shard's members and graph in parts of PART bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "shard"):
            whole = table.combine_chunks().to_batches()[0]
            x = _vectors(whole, 0, whole.num_rows)
            graph = Graph(x)
            beam, recall = audited(graph, x, least)
            blob = _packed({"ids": whole.column("rep").to_numpy(), "weight": whole.column("weight").to_numpy(), "x": x, "beam": np.array(beam), **{f"links{k}": v for k, v in enumerate(graph.links)}})
            for i in range(0, len(blob), PART):
                yield pa.RecordBatch.from_arrays([whole.column("shard").slice(0, 1), pa.array([i // PART]), pa.array([blob[i : i + PART]], pa.binary()), pa.array([recall if beam else 1.0])], names=["shard", "part", "blob", "recall"])

    return run


class _Shard:
    """One shard's graph as it was written, and which of its members queries have united."""

    def __init__(self, blob: bytes, least: float):
        held = np.load(io.BytesIO(blob))
        self.ids, self.weight, self.x, self.beam, self.least = held["ids"], held["weight"], held["x"], int(held["beam"]), least
        self.graph = Graph(self.x, links=[held[f"links{k}"] for k in range(sum(n.startswith("links") for n in held.files))])
        self.up = np.arange(len(self.ids))

    def roots(self, i: np.ndarray) -> np.ndarray:
        while (self.up[up := self.up[i]] != up).any():
            i = up
        return up

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.roots(a), self.roots(b)
        pairs = np.unique(a[differ] * len(self.up) + b[differ]) if (differ := a != b).any() else np.zeros(0, np.int64)
        nodes, at = np.unique(np.concatenate([pairs // len(self.up), pairs % len(self.up)]), return_inverse=True)
        up = list(range(len(nodes)))
        for a, b in zip(at[: len(pairs)].tolist(), at[len(pairs) :].tolist(), strict=True):
            while up[a] != a:
                up[a] = a = up[up[a]]
            while up[b] != b:
                up[b] = b = up[up[b]]
            up[a] = b
        if len(nodes):
            self.up[nodes] = nodes[up]
            self.up = self.roots(np.arange(len(self.up)))

    def answer(self, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the queries with links here: their ids, how many vectors they link to, and one of these."""
        out = []
        for i in range(0, len(ids), BATCH):
            q, some = x[i : i + BATCH], ids[i : i + BATCH]
            count, head = np.zeros(len(q), np.int64), np.full(len(q), -1)
            for query, member in self.graph.near(q.astype(np.float32), self.least - 1e-4, self.beam) if self.beam else brute(self.x, q, self.least - 1e-4):
                keep = (products(self.x, member, q, query) >= self.least) & (self.ids[member] != some[query])
                query, member = query[keep], member[keep]
                count += np.bincount(query, self.weight[member], len(q)).astype(np.int64)
                new = head[query] < 0
                head[query[new]] = member[new]
                self.unite(head[query], member)
            own = np.flatnonzero(head >= 0)
            out.append((some[own], count[own], self.ids[head[own]]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _search(least: float):
    """Rows (rep, links, other) from rows sorted by shard, slice and part: the parts of a graph, then the queries (part null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "links", "other"]
        now, shard, blob = None, None, []

        def united() -> Iterator[pa.RecordBatch]:
            if shard:
                i = np.flatnonzero(shard.up != np.arange(len(shard.up)))
                yield pa.RecordBatch.from_arrays([pa.array(shard.ids[i]), pa.array(np.zeros(len(i), np.int64)), pa.array(shard.ids[shard.roots(i)])], names=names)

        for batch in batches:
            key = list(zip(batch.column("shard").to_pylist(), batch.column("slice").to_pylist(), batch.column("blob").is_null().to_pylist(), strict=True))
            cuts = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)] if key else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if key[a][:2] != now:
                    yield from united()
                    now, shard, blob = key[a][:2], None, []
                if not key[a][2]:
                    blob += batch.column("blob").slice(a, b - a).to_pylist()
                    continue
                if shard is None:
                    shard, blob = _Shard(b"".join(blob), least), []
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in shard.answer(batch.column("rep").slice(a, b - a).to_numpy(), _vectors(batch, a, b))], names=names)
        yield from united()

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """One row per row of df: id_col, n_links, component_id (least id reachable), kept, recall (the least audited in any shard). Ids are integers."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = kept(rows.withColumn("mark", F.when(F.col("id").isNotNull() & fine, F.sha2(F.to_json(F.struct("v")), 256))))
    classes = kept(rows.where("mark is not null").groupBy("mark").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")))
    n, wide = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    shards = max(SHARDS, -(-n // max(1000, min(MEMBERS, BYTES // (12 * wide)))))
    slices = max(1, min(-(-n // SLICE), max(-(-n // (MOST * SLICE)), -(-TASKS // shards))))
    base = F.size("v") * shards
    members = classes.select((base + F.pmod(F.xxhash64("mark"), F.lit(shards)).cast("int")).cast("long").alias("shard"), "rep", "weight", "v")
    graphs = kept(mapped(members.repartition("shard").sortWithinPartitions("shard"), _build(least), "shard long, part long, blob binary, recall double"))
    each = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    parts = graphs.select("shard", each.alias("slice"), "part", "blob", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("array<double>").alias("v"))
    queries = classes.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: (base + i).cast("long"))).alias("shard"), F.pmod(F.xxhash64("mark", F.lit(1)), F.lit(slices)).cast("int").alias("slice"), F.lit(None).cast("long").alias("part"), F.lit(None).cast("binary").alias("blob"), "rep", "v")
    queries = queries.join(F.broadcast(graphs.where("part = 0").select("shard")), "shard", "left_semi").select(parts.columns)  # a query asks no empty shard
    dealt = parts.union(queries).repartition(shards * slices, "shard", "slice").sortWithinPartitions("shard", "slice", F.asc_nulls_last("part"))
    found = kept(mapped(dealt, _search(least), "rep long, links long, other long"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    own = classes.select("mark", "rep", "weight").join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    own = own.select("mark", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id", "mark").join(own, "mark", "left").join(F.broadcast(graphs.agg(F.min("recall").alias("recall"))))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "recall")
