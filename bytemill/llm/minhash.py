"""Near-duplicate documents by a MinHash LSH forest, with every link confirmed on full shingle sets.

Words are the runs of bytes other than white space, after A-Z became a-z. A set holds the distinct shingles of
`width` words (a shorter text: all its words as one); each shingle is a 64-bit hash. Two documents are linked if
100 * |A and B| >= percent * |A or B|. A text without words, or null, has the empty set and no links. A row
whose id is null takes no part: it stays, with no component. Equal rows and equal sets are one class from the start.

1. One scan gives each document its set's size and 128-bit fingerprint and K MinHash values of 16 bits.
2. Classes of equal fingerprints are aggregated to their least id, so copies cost nothing further on.
3. The forest: TREES orders of the K values. A region is a group of classes with the same first DEPTH values of one
   order. Within a region a search from each unvisited member over the rest finds
   those whose values agree often enough for the threshold (LIKELY, five deviations below it).
   A region with more than REGION members is searched whole as well, in pairs of blocks, so no task sees more than two blocks.
   Members that agree with the region's least member are connected by that; pairs of them need no search, and all other pairs get one.
   A pair at the threshold meets in a given tree with probability 0.8**3, and in none of 16 with 1e-5.
4. Components of these candidates are clusters. The texts of a cluster meet in one task, or where they
   are many, in one task per pair of its blocks, and there links are confirmed by exact intersection sizes out of an
   inverted index over the members not yet reached; links between members that are connected already are skipped.
5. Components of confirmed links give the result. No step lists the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytemill.llm.arrow import LOWER, U64, constants, groups, hash_spans, mapped, mix, slices, utf8, words
from bytemill.llm.graph import components
from bytemill.llm.shared import kept

TREES, PER_TREE = 16, 6
#: How many values of a tree's order make a region's key.
DEPTH = 3
K = TREES * PER_TREE
REGION, PIECE = 1024, 2 << 20
#: Share of equal MinHash values from which a pair becomes a candidate, for the threshold 0.8.
LIKELY = 0.6
#: A cluster is cut into blocks of about so many members, or shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 1500, 3_000_000
#: Rows of ids that may be broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000
_MINHASH, _SHINGLE = constants(K, 21), constants(64, 22)


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin (one more at the end)."""
    data, offsets = utf8(column)
    data = LOWER[data]
    start, end, row = words(data, offsets)
    word, n = hash_spans(data, start, end), len(offsets) - 1
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    made = np.zeros(len(word), dtype=U64)
    rank = np.arange(len(word)) - first[row]
    for j in range(width):
        reach = rank + j < count[row]
        made[reach] += word[np.flatnonzero(reach) + j] * _SHINGLE[j]
    keep = (rank + width <= count[row]) | ((rank == 0) & (count[row] < width))
    made, row = mix(made[keep] + np.minimum(count[row[keep]], width).astype(U64)), row[keep]
    by = np.lexsort((made, row)) if len(made) < 2 else _by_row(made, row, n)
    made, row = made[by], row[by]
    fresh = np.ones(len(made), dtype=bool)
    fresh[1:] = (made[1:] != made[:-1]) | (row[1:] != row[:-1])
    made, row = made[fresh], row[fresh]
    return made, np.searchsorted(row, np.arange(n + 1))


def _by_row(made: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Order by row and, within it, by hash; rows are ascending already."""
    cuts = np.searchsorted(row, np.arange(n + 1)).tolist()
    out = np.empty(len(made), dtype=np.int64)
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = np.argsort(made[a:b]) + a
    return out


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def signatures(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, h, n, f1, f2, sig): hash of the text, set size, fingerprint, and K values of 16 bits as binary (null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", PIECE):
            made, cut = shingles(part.column("t"), width)
            n, size = part.num_rows, np.diff(cut)
            full = np.flatnonzero(size)
            sig, f1, f2 = np.zeros((n, K), dtype=np.uint16), np.zeros(n, dtype=U64), np.zeros(n, dtype=U64)
            if len(full):
                starts = cut[:-1][full]
                for j in range(K):
                    sig[full, j] = (mix(np.minimum.reduceat(made * _MINHASH[j], starts)) >> U64(48)).astype(np.uint16)
                f1[full] = np.add.reduceat(mix(made), starts)
                f2[full] = np.add.reduceat(mix(made * _SHINGLE[63]), starts)
            raw = [x.tobytes() if k else None for x, k in zip(sig, size, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array(size.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(raw, type=pa.binary())], names=["id", "h", "n", "f1", "f2", "sig"])

    return mapped(df.select(F.col(id_col).alias("id"), _text_hash(text_col).alias("h"), F.col(text_col).alias("t")), run, f"id {df.schema[id_col].dataType.simpleString()}, h long, n long, f1 long, f2 long, sig binary")


def _spanning(values: np.ndarray, likely: int) -> list[tuple[int, int]]:
    """Edges that connect the rows whose values agree in at least `likely` places: a forest."""
    edges, left, queue = [], np.arange(1, len(values)), [0]
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        x = queue.pop()
        hit = (values[left] == values[x]).sum(axis=1) >= likely
        found = left[hit]
        edges += [(x, y) for y in found.tolist()]
        queue += found.tolist()
        left = left[~hit]
    return edges


def _candidates(likely: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(_whole(batches, "key"), "part"):
            keys = table["key"].to_numpy()
            rep = table["rep"].to_numpy()
            values = np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint16).reshape(-1, K)
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            sizes = np.diff(cuts)
            two = cuts[:-1][sizes == 2]
            two = two[(values[two] == values[two + 1]).sum(axis=1) >= likely]
            a, b = [rep[two]], [rep[two + 1]]
            for at, size in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if e := _spanning(values[at : at + size], likely):
                    x, y = np.array(e).T
                    a.append(rep[at + x])
                    b.append(rep[at + y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows again, dealt so that no key is in two parts; a part has a number of its own in the column part."""
    held: list[pa.RecordBatch] = []
    number = 0

    def out(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in pa.Table.from_batches(tables).combine_chunks().to_batches():
            yield t.append_column("part", pa.array(np.full(t.num_rows, number)))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield from out(held)
            held, number = [], number + 1
        if len(cuts):
            yield from out([*held, batch.slice(0, int(cuts[-1]))])
            held, number = [batch.slice(int(cuts[-1]))], number + 1
        else:
            held.append(batch)
    if held:
        yield from out(held)


def candidates(classes: DataFrame, likely: float = LIKELY) -> DataFrame:
    """Edges (a, b) between classes (rep, sig) that the forest finds alike; repeats possible."""
    level = classes.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    keyed = level.select("rep", F.expr(f"xxhash64(tree, substring(sig, tree * {2 * PER_TREE} + 1, {2 * DEPTH}))").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("least")).where("size > 1")
    met = kept(keyed.join(shared.hint("merge"), "key"))
    found = met.where(F.col("size") <= REGION).select("key", "rep")
    large, edges = met.where(F.col("size") > REGION), None
    if not large.isEmpty():
        marked = kept(_marked(large, classes, round(likely * K)))
        edges = marked.where("not loose and rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b"))
        found = found.union(_blocks(marked))
    rows = found.join(classes.hint("merge"), "rep").select("key", "rep", "sig")
    # `key` is sorted within a partition, so each region's rows are neighbours
    met_in = mapped(rows.repartition("key").sortWithinPartitions("key"), _candidates(round(likely * K)), "a long, b long")
    return met_in if edges is None else met_in.union(edges)


def _marked(large: DataFrame, classes: DataFrame, likely: int) -> DataFrame:
    """(key, rep, least, loose) for the members of large regions; loose: agrees with the region's least member in fewer than `likely` places."""
    rows = large.join(classes.hint("merge"), "rep").select("key", "rep", "least", "sig")
    hubs = kept(rows.where("rep = least").select("key", F.col("sig").alias("hub")))
    if hubs.count() <= BROADCAST_ROWS // 10:
        hubs = F.broadcast(hubs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, hub = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, K) for c in ("sig", "hub"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "rep", "least")), pa.array((sig == hub).sum(axis=1) < likely)], names=["key", "rep", "least", "loose"])

    return mapped(rows.join(hubs, "key").select("key", "rep", "least", "sig", "hub"), run, "key long, rep long, least long, loose boolean")


def _blocks(marked: DataFrame) -> DataFrame:
    """(key, rep): large regions cut into blocks, with a key for each pair of blocks that has loose members."""
    count = lambda of: F.ceil(F.count(F.when(of, 1)) / F.lit(REGION / 2)).cast("int")
    sizes = marked.groupBy("key").agg(count(F.col("loose")).alias("l"), count(~F.col("loose")).alias("m")).where("l > 0")
    at = F.when(F.col("loose"), F.pmod(F.xxhash64("rep"), F.col("l"))).otherwise(F.col("l") + F.pmod(F.xxhash64("rep"), F.col("m"))).cast("int")
    last = F.when(F.col("loose"), F.col("l") + F.col("m")).otherwise(F.col("l")) - 1
    dealt = marked.join(sizes.hint("merge"), "key").select("key", "rep", at.alias("p"), F.explode(F.sequence(F.lit(0), last)).alias("q")).where("p <> q")
    return dealt.select(F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q")).alias("key"), "rep")


def _linked(cut: np.ndarray, made: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the exact links between sets made[cut[i]:cut[i + 1]]."""
    size = np.diff(cut)
    n = len(size)
    if n == 2:
        both = len(np.intersect1d(made[: cut[1]], made[cut[1] :], assume_unique=True))
        return [(0, 1)] if both and 100 * both >= percent * (size.sum() - both) else []
    ids, number = np.unique(made, return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    left = np.ones(n, dtype=bool)
    edges, queue, indexed = [], [], 0
    at = post = None
    for first in range(n):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue and left.any():
            x = queue.pop()
            if at is None or left.sum() * 2 < indexed:  # index anew the members not reached yet
                live = left[owner]
                by = np.argsort(number[live], kind="stable")
                post = owner[live][by]
                at = np.searchsorted(number[live][by], np.arange(len(ids) + 1))
                indexed = int(left.sum())
            mine = number[cut[x] : cut[x + 1]]
            a, k = at[mine], at[mine + 1] - at[mine]
            where = np.repeat(a - (np.cumsum(k) - k), k) + np.arange(k.sum())
            both = np.bincount(post[where], minlength=n)
            hit = np.flatnonzero(left & (both > 0) & (100 * both >= percent * (size + size[x] - both)))
            edges += [(x, y) for y in hit.tolist()]
            queue += hit.tolist()
            left[hit] = False
    return edges


def confirmed(df: DataFrame, clusters: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Edges (a, b): a spanning forest of the exact links within each cluster. clusters: (rep, n, component)."""
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    parts = F.greatest(F.ceil(F.col("m") / F.lit(BLOCK_ROWS)), F.ceil(F.col("w") / F.lit(BLOCK_SHINGLES))).cast("int")
    placed = clusters.join(sizes.select("component", parts.alias("parts")), "component").select("rep", "component", "parts", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("p"))
    placed = kept(placed)
    if placed.count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    texts = df.select(F.col(id_col).alias("rep"), F.col(text_col).alias("t")).join(placed, "rep")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")
    dealt = texts.select("rep", "t", "component", "p", other).select("rep", "t", F.xxhash64("component", F.least("p", "q"), F.greatest("p", "q")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "key"):
            rep = table["rep"].to_numpy()
            one = np.unique(rep, return_index=True)[1]  # repeated rows with one id: the first
            made, cut = shingles(table["t"].combine_chunks().take(pa.array(one)), width)
            if e := _linked(cut, made, percent):
                a, b = np.array(e).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[one][a]), pa.array(rep[one][b])], names=["a", "b"])

    return mapped(dealt.repartition("key").sortWithinPartitions("key"), run, "a long, b long")


def _classified(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, h, n, component, kept) for each row."""
    df = df.select(id_col, text_col)
    marks = kept(signatures(df, id_col, text_col, width))
    classes = kept(marks.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")))
    likely = LIKELY - (0.8 - percent / 100)
    found = components(candidates(classes.select("rep", "sig"), likely)).withColumnRenamed("node", "rep")
    clusters = kept(found.join(classes.select("rep", "n"), "rep"))
    joined = components(confirmed(df, clusters, id_col, text_col, width, percent))
    ends = classes.select("f1", "f2", "n", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    out = marks.select("id", "h", "n", "f1", "f2").join(ends, ["f1", "f2", "n"], "left")
    own = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return out.select("id", "h", "n", own.alias("component")).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of df: id_col, n_shingles, component_id (least id reachable), kept (id is its component's). Ids are integers."""
    out = _classified(df, id_col, text_col, width, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df without near-duplicates: of each component the row with the least id; of rows with equal id and text one."""
    stay = kept(_classified(df, id_col, text_col, width, percent).where("kept").groupBy(F.col("id").alias("i"), F.col("h").alias("g")).agg(F.count(F.lit(1)).alias("k")))
    if stay.count() <= BROADCAST_ROWS:
        stay = F.broadcast(stay)
    names = {f"x{i}": c for i, c in enumerate(df.columns)}
    rows = df.select(*[F.col(c).alias(x) for x, c in names.items()], F.col(id_col).alias("id"), _text_hash(text_col).alias("h"))
    rows = rows.join(stay, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")))
    first = F.row_number().over(Window.partitionBy("id", "h").orderBy(*names))
    more = rows.where("k > 1").withColumn("nr", first).where("nr = 1")
    return rows.where("k = 1").select(*names).union(more.select(*names)).withColumnsRenamed(names)
