"""Byte-level BPE by a rank queue.

Pre-tokens lie in one doubly linked list of tokens. A pair that can merge is put into the bucket of its merge
rank; a three-level bitmap over the ranks finds the first bucket in use; the leftmost position of that
bucket is merged unless the pair there has changed since (a stale entry). New pairs enter their buckets, lower
ones than the present included. A long pre-token of n bytes costs O(n log n) whatever it holds, so megabytes
without a space are no special case. Short ones share a queue: a step then takes the leftmost entry of each
pre-token in the bucket, all at once in NumPy, and puts the rest back.

With the pattern QUICK (the one that ships with the vocabularies) a text is cut at single spaces between visible characters first, where
each match begins anew, and plain words skip the pattern; any other pattern runs over whole texts.

Nulls and empty texts have no ids and decode to an empty text. Rows are neither dropped nor merged, an empty table gives an empty
result; columns other than those named are ignored, and a column that has the name of a result is replaced.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from bytemill.llm.arrow import mapped, slices

#: Segments that a worker remembers, and the bytes of text that it encodes at once.
CACHE, PIECE = 200_000, 8 << 20
#: Pre-tokens of more bytes than this go through the queue one by one; of the others, so many share one.
LONG, TOGETHER = 256, 100_000
#: The pattern for which the short cuts hold, a fixed value.
QUICK = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode White_Space, which `\s` means in the pattern.
_WHITE = r"\t-\r \x85\xa0  -     　"


def white(pattern: str) -> str:
    """The pattern with `\\s` and `\\S` spelled out, so that no engine's own reading of them counts."""
    out, inside = [], False
    for part in regex.findall(r"\\.|.", pattern, flags=regex.DOTALL):
        inside = part == "[" or inside and part != "]"
        out.append(_WHITE if part == r"\s" and inside else f"[{_WHITE}]" if part == r"\s" else f"[^{_WHITE}]" if part == r"\S" and not inside else part)
    return "".join(out)


def read_ranks(lines: list[str]) -> dict[bytes, int]:
    """Token bytes to rank from lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankBitmap:
    """The ranks in use, as bits in three levels of 64-bit words; `first` finds the least."""

    def __init__(self, size: int):
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0

    def add(self, rank: int) -> None:
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def remove(self, rank: int) -> None:
        self.low[rank >> 6] &= ~(1 << (rank & 63))
        if not self.low[rank >> 6]:
            self.mid[rank >> 12] &= ~(1 << (rank >> 6 & 63))
            if not self.mid[rank >> 12]:
                self.top &= ~(1 << (rank >> 12))

    def first(self) -> int:
        """The least rank, or -1."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        return b << 6 | (word & -word).bit_length() - 1


class Recent(dict):
    """A map that keeps what was used lately: when it is full, its entries become the old ones and the former old ones go."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys: set) -> list:
        """The keys that aren't known; old ones that are wanted are taken over."""
        if len(self) + len(keys) > self.most:
            self.old = dict(self)
            self.clear()
        new = []
        for k in keys - self.keys():
            if (v := self.old.get(k)) is None:
                new.append(k)
            else:
                self[k] = v
        return new


class Encoder:
    """Ranks and pattern made ready; the id of a token is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.size, self.quick = ranks, max(ranks.values()) + 1, pattern == QUICK
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pieces = regex.compile(white(pattern)).findall
        self.apart = re.compile(rf"(?<=[^{_WHITE}]) (?=[^{_WHITE}])").split
        #: Left id * size + right id, for each pair whose bytes together are a token, to that token's rank.
        self.pairs = {ranks[t[:i]] * self.size + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.made = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int32)
        self.heads, self.tails = Recent(CACHE), Recent(CACHE)

    def merge(self, parts: list[bytes]) -> list[list[int]]:
        """Ids of each part; no merge crosses the border of two parts."""
        token, nxt, prv, last = [], [], [], []
        for part in parts:
            token += map(self.byte.__getitem__, part)
            last += [False] * (len(part) - 1) + [True] * bool(part)
        n, size, pairs = len(token), self.size, self.pairs
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        bits = RankBitmap(size)
        rank = [-1] * n  # of the pair that starts here
        for i in range(n - 1):
            if not last[i] and (r := pairs.get(token[i] * size + token[i + 1], -1)) >= 0:
                rank[i] = r
                if r in buckets:
                    buckets[r].append(i)  # ascending, so it is a heap
                else:
                    buckets[r] = [i]
                    bits.add(r)
        get = pairs.get
        while (r := bits.first()) >= 0:
            bucket = buckets[r]
            lower = False
            while bucket and not lower:
                i = heappop(bucket)
                if rank[i] != r:
                    continue  # stale
                j = nxt[i]
                token[i], rank[j] = r, -1
                token[j] = -1
                nxt[i] = k = nxt[j]
                if last[j]:
                    last[i] = True
                    rank[i] = -1
                else:
                    prv[k] = i
                    rank[i] = s = get(r * size + token[k], -1)
                    if s >= 0:
                        if s not in buckets:
                            buckets[s] = []
                        if not buckets[s]:
                            bits.add(s)
                        heappush(buckets[s], i)
                        lower = s < r
                h = prv[i]
                if h >= 0 and not last[h]:
                    rank[h] = s = get(token[h] * size + r, -1)
                    if s >= 0:
                        if s not in buckets:
                            buckets[s] = []
                        if not buckets[s]:
                            bits.add(s)
                        heappush(buckets[s], h)
                        lower = lower or s < r
            if not bucket:
                bits.remove(r)
        out, at = [], 0
        for part in parts:
            end = at + len(part)
            out.append([t for t in token[at:end] if t >= 0])
            at = end
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids; -1 where there is none or the left id is -1."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], -1)

    def merge_together(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part as bytes of int32, by one queue for all."""
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        n = int(sizes.sum())
        part = np.append(np.repeat(np.arange(len(parts)), sizes), -1)
        token = np.append(np.array(self.byte, dtype=np.int32)[np.frombuffer(b"".join(parts), dtype=np.uint8)], np.int32(-1))
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)  # position n (and so -1) is the end of all
        rank = np.full(n + 1, -1, dtype=np.int32)
        if n > 1:
            rank[: n - 1] = np.where(part[: n - 1] == part[1:n], self._ranks(token[: n - 1], token[1:n]), -1)
        order = np.argsort(rank[:n], kind="stable")
        order = order[np.searchsorted(rank[order], 0) :]
        used, at = np.unique(rank[order], return_index=True)
        buckets: dict[int, list] = {r: [order[a:b]] for r, a, b in zip(used.tolist(), at.tolist(), [*at.tolist()[1:], len(order)], strict=True)}
        pushed: dict[int, list[int]] = {}
        bits = RankBitmap(self.size)
        for r in buckets:
            bits.add(r)
        while (r := bits.first()) >= 0:
            bits.remove(r)
            held = buckets.pop(r, [])
            if more := pushed.pop(r, None):
                held.append(np.array(more))
            p = held[0] if len(held) == 1 else np.sort(np.concatenate(held))
            if len(held) == 1 and more:
                p = np.sort(p)
            p = p[rank[p] == r]  # the others are stale
            if len(p) > 1:
                owner = part[p]
                first = np.ones(len(p), dtype=bool)
                first[1:] = owner[1:] != owner[:-1]
                if not first.all():
                    buckets[r] = [p[~first]]
                    bits.add(r)
                    p = p[first]
            if not len(p):
                continue
            q = nxt[p]
            after, before = nxt[q], prv[p]
            token[p], token[q], rank[q] = r, -1, -1
            nxt[p] = after
            prv[after] = p
            here = np.concatenate([p, before])
            ahead = np.concatenate([after, p])
            new = np.where(part[here] == part[ahead], self._ranks(token[here], token[ahead]), -1)
            rank[here] = new
            rank[n] = -1
            good = new >= 0
            for s, i in zip(new[good].tolist(), here[good].tolist(), strict=True):
                if s in pushed:
                    pushed[s].append(i)
                else:
                    pushed[s] = [i]
                    bits.add(s)
        alive = np.flatnonzero(token[:n] >= 0)
        ends = np.cumsum(np.bincount(part[alive], minlength=len(parts))) * 4
        out = token[alive].tobytes()
        return [out[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def plain(self, text: str) -> bool:
        """Whether all white space is single spaces and line feeds between visible characters: no more of it than there are gaps between words."""
        words = text.split()
        return len(words) - 1 == text.count(" ") + text.count("\n") == len(text) - sum(map(len, words))

    def segments(self, text: str, plain: bool) -> list[str]:
        """Cuts at single spaces between visible characters; there every match of the pattern begins anew. All but the first lack their space."""
        return text.split(" ") if plain else self.apart(text)

    def cut(self, segment: str, lead: str) -> list[str]:
        """The matches of the pattern in lead + segment; for a word, or a word and one mark, without running the pattern."""
        if segment.isalpha():
            return [lead + segment]
        if segment[-1] in ".,:;!?" and segment[:-1].isalpha():
            return [lead + segment[:-1], segment[-1]]
        return self.pieces(lead + segment)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes of int32."""
        if not self.quick:
            cut = [self.pieces(t) if t else [] for t in texts]
            known = self._known(set().union(*cut), "", self.heads, whole=True)
            return [b"".join(map(known.__getitem__, c)) for c in cut]
        first, rest, plain = set(), set(), []
        for t in texts:
            plain.append(bool(t) and self.plain(t))
            if t:
                a, *b = self.segments(t, plain[-1])
                first.add(a)
                rest.update(b)
        heads, tails = self._known(first, "", self.heads).__getitem__, self._known(rest, " ", self.tails).__getitem__
        out = []
        for t, p in zip(texts, plain, strict=True):
            if t:
                a, *b = self.segments(t, p)  # again, rather than keep them all
                out.append(b"".join([heads(a), *map(tails, b)]))
            else:
                out.append(b"")
        return out

    def _known(self, segments: set[str], lead: str, cache: Recent, whole: bool = False) -> dict[str, bytes]:
        """Ids of lead + segment, for these segments at least; whole: they are matches of the pattern already."""
        todo = cache.missing(segments)
        found = [[s] if whole else self.cut(s, lead) for s in todo]
        ids: dict[str, bytes] = {}
        short, long = [], []
        for p in set().union(*found):
            b = p.encode()
            if b in self.ranks:
                ids[p] = array("i", [self.ranks[b]]).tobytes()
            else:
                (short if len(b) <= LONG else long).append((p, b))
        for i in range(0, len(short), TOGETHER):
            now = short[i : i + TOGETHER]
            ids.update(zip((p for p, _ in now), self.merge_together([b for _, b in now]), strict=True))
        for p, b in long:
            ids[p] = array("i", self.merge([b])[0]).tobytes()
        for s, ps in zip(todo, found, strict=True):
            cache[s] = b"".join(map(ids.__getitem__, ps))
        return cache


@functools.cache
def _encoder(lines: tuple[str, ...], pattern: str) -> Encoder:
    return Encoder(read_ranks(lines), pattern)


@functools.cache
def _tokens(lines: tuple[str, ...]) -> list[bytes]:
    ranks = read_ranks(lines)
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    return tokens


def _decoded(tokens: list[bytes], at: list[int], ids: np.ndarray) -> list[bytes]:
    """The bytes of ids[at[i]:at[i + 1]] for each i."""
    return [b"".join(map(tokens.__getitem__, ids[a:b].tolist())) for a, b in zip(at, at[1:], strict=False)]


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids", carry: list[str] | None = None, decoded_col: str | None = None) -> DataFrame:
    """id_col, the columns carry, and the ids of the whole text (array of int; empty for null). No special tokens.

    With decoded_col also the bytes that the ids decode to, in the same pass: what `decode` would give, without a second
    Python worker and another trip of the ids through Arrow.
    The rank file (a fixed vocabulary, so of bounded size) is read on the driver and broadcast.
    """
    with open(rank_file) as f:
        held = df.sparkSession.sparkContext.broadcast(tuple(f.read().splitlines()))
    keep = [id_col, *(carry or [])]
    names = [f"c{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value, pattern)
        for part in slices(batches, "t", PIECE):
            ids = encoder.encode_many(part.column("t").to_pylist())
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            values = np.frombuffer(b"".join(ids), dtype=np.int32)
            out = [*(part.column(n) for n in names), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
            if decoded_col:
                out.append(pa.array(_decoded(_tokens(held.value), offsets.tolist(), values), type=pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

    made = [StructField(out_col, ArrayType(IntegerType())), *([StructField(decoded_col, BinaryType())] if decoded_col else [])]
    schema = StructType([*(df.schema[c] for c in keep), *made])
    source = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).alias("t"))
    return mapped(source, run, schema)


def decode(df: DataFrame, rank_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for (null ids: null)."""
    with open(rank_file) as f:
        held = df.sparkSession.sparkContext.broadcast(tuple(f.read().splitlines()))
    kept = [f for f in df.schema.fields if f.name != out_col]
    source = df.select(*[F.col(f.name).alias(f"c{i}") for i, f in enumerate(kept)], F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(held.value)
        for batch in batches:
            ids = batch.column("ids")
            found = _decoded(tokens, ids.offsets.to_numpy().tolist(), ids.values.to_numpy(zero_copy_only=False))
            texts = [None if z else t for t, z in zip(found, ids.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, type=pa.binary())], names=[f.name for f in (*kept, made)])

    made = StructField(out_col, BinaryType())
    return mapped(source, run, StructType([*kept, made]))


def digest_of_ids(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
