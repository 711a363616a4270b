"""Language-model scores by prediction by partial matching over bytes.

A text becomes its bytes, A-Z as a-z, and an end. The model is a trie of the contexts of up to ORDER bytes with the counts of
the bytes seen after them, learned from all training texts (each task counts its n-grams, one shuffle sums them); lower orders
count a byte once per longer context. A byte is coded in the longest context seen. If it wasn't seen there the coder escapes
to the next shorter context, where the bytes of the longer one are excluded, and in the end to a uniform choice among
bytes never seen. Escapes are estimated by method D: with n counts and d different bytes left, a byte seen c times
has (2c - 1) / 2n and the escape d / 2n; if no byte is left the escape is certain. The score is the sum of log10
probabilities, so a proper probability of the text as bytes in lower case.

`baseline` is the unigram score with one added to each count. Null and empty texts are one end. Each row is scored on its own;
repeated rows count each in training. With no training text the model is uniform; an empty table gives an empty result. A text of
any length is coded CHUNK bytes at a time. Columns that are carried may have any name, also one of the results' inputs.

Up to NODES n-grams the trie is broadcast. Beyond, it stays cut by the two nearest bytes of context, which decide all its levels but
the lowest two (these have at most 258**2 entries, and are broadcast): texts go in parts of PART bytes, a part asks for its distinct
n-grams, the cut trie answers each asked n-gram once, and the answers are joined back to the parts. Scores are the same, nothing is pruned. The
word counts of the baseline are broadcast up to WORDS words; beyond, documents' words and counts are joined, with the same result.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytemill.llm.arrow import LOWER, U64, groups, hash_spans, mapped, slices, utf8, words
from bytemill.llm.shared import kept

ORDER, NODES, WORDS = 5, 4_000_000, 4_000_000
#: Bytes of text that are taken together, coded at once, and that make a part; n-grams of the cut trie in memory at once.
PIECE, CHUNK, PART, RUN = 2 << 20, 2 << 20, 16 << 20, 1 << 20
#: Symbols are the 256 bytes and the end; what stands before a text is in contexts only. A symbol takes BITS bits.
END, BEFORE, ALPHABET, BITS = 256, 257, 257, 9
END_WORD = np.array([0xE4D0_0000_0000_0001], dtype=U64)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each with its end, and where each text begins (one more at the end)."""
    return np.insert(LOWER[data].astype(np.uint16), offsets[1:], END), offsets + np.arange(len(offsets))


def grams(text: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each symbol, CHUNK at a time: it in the low bits with the ORDER symbols before it above, the nearest lowest; and its row."""
    for a in range(0, len(text), CHUNK):
        b = min(len(text), a + CHUNK)
        first, last = np.searchsorted(bounds, [a, b - 1], side="right") - 1
        inner = bounds[first + 1 : last + 1]
        row = np.repeat(np.arange(first, last + 1), np.diff(np.concatenate([[a], inner, [b]])))
        at = np.arange(a, b) - bounds[row]
        code = text[a:b].astype(U64)
        before = np.concatenate([np.full(max(0, ORDER - a), BEFORE, np.uint16), text[max(0, a - ORDER) : b]])
        for back in range(1, ORDER + 1):
            older = np.where(at < back, np.uint16(BEFORE), before[ORDER - back : ORDER - back + b - a])
            code |= older.astype(U64) << U64(BITS * back)
        yield code, row


def _low(order: int) -> int:
    """The bits of an n-gram of this order."""
    return (1 << (BITS * (order + 1))) - 1


class Trie:
    """Sorted n-grams of each order with counts; for each context its total, its number of bytes, and the total of the same bytes one order below.

    code and count are those of the top order. With base, the trie of the lowest two orders of a larger set of n-grams, code may be
    any part of that set that holds all n-grams of some contexts of order 2.
    """

    def __init__(self, code: np.ndarray, count: np.ndarray, order: int = ORDER, base: Trie | None = None):
        by = np.argsort(code)
        own = [(code[by], count[by].astype(np.float64))]
        for k in range(order - 1, 1 if base else -1, -1):
            low, n = np.unique(own[-1][0] & U64(_low(k)), return_counts=True)
            own.append((low, n.astype(np.float64)))
        self.levels = list(base.levels) if base else []
        lower = self.levels[-1][:2] if base else None
        for k, (low, c) in enumerate(own[::-1], start=len(self.levels)):
            context, first = np.unique(low >> U64(BITS), return_index=True)
            n = np.add.reduceat(c, first) if len(c) else np.zeros(0)
            d = np.diff(np.append(first, len(low))).astype(np.float64)
            below = np.zeros(len(context))
            if k and len(low):
                below = np.add.reduceat(lower[1][np.searchsorted(lower[0], low & U64(_low(k - 1)))], first)
            self.levels.append((low, c, context, n, d, below))
            lower = low, c

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        """log10 of each n-gram's last symbol given the symbols before it."""
        out, open_ = np.zeros(len(code)), np.arange(len(code))
        above_d, above_m = np.zeros(len(code)), np.zeros(len(code))  # of the longer context, if it was seen
        for k in range(len(self.levels) - 1, -1, -1):
            low, c, context, n, d, below = self.levels[k]
            if not len(low) or not len(open_):
                continue
            g = code[open_] & U64(_low(k))
            x = np.minimum(np.searchsorted(context, g >> U64(BITS)), len(context) - 1)
            seen = context[x] == g >> U64(BITS)
            at = np.minimum(np.searchsorted(low, g), len(low) - 1)
            hit = low[at] == g
            left_n, left_d = n[x] - above_m[open_], d[x] - above_d[open_]
            i = open_[hit]
            out[i] += np.log10((2 * c[at[hit]] - 1) / (2 * left_n[hit]))
            e = seen & ~hit & (left_d > 0)
            out[open_[e]] += np.log10(left_d[e] / (2 * left_n[e]))
            above_d[open_] = np.where(seen, d[x], 0)
            above_m[open_] = np.where(seen, below[x], 0)
            open_ = open_[~hit]
        if len(open_):
            out[open_] -= np.log10(np.maximum(1, ALPHABET - len(self.levels[0][0])))
        return out


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams (kind 0) and words (kind 1) of a task's texts, with their counts."""
    held: list[list] = [[], []]

    def add(kind: int, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        held[kind].append(np.unique(x, return_counts=True))
        if sum(len(k) for k, _ in held[kind]) > 2_000_000:
            held[kind] = [_summed(held[kind])]
        if len(held[kind]) == 1 and len(held[kind][0][0]) > 1_500_000:
            yield from _emit(kind, *held[kind].pop())

    for part in slices(batches, "t", PIECE):
        data, offsets = utf8(part.column("t"))
        for code, _ in grams(*symbols(data, offsets)):
            yield from add(0, code)
        data = LOWER[data]
        start, end, _ = words(data, offsets)
        yield from add(1, np.concatenate([hash_spans(data, start, end), np.repeat(END_WORD, part.num_rows)]))
    for kind in (0, 1):
        if held[kind]:
            yield from _emit(kind, *_summed(held[kind]))


def _emit(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), 50_000):
        k, c = keys[i : i + 50_000], counts[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, dtype=np.int32)), pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], names=["kind", "key", "n"])


class Model:
    """What training leaves: the tables of n-grams and of words with their counts, how many n-grams there are, N and V."""

    def __init__(self, grams: DataFrame, words: DataFrame, nodes: int, tokens: int, types: int):
        self.grams, self.words, self.nodes, self.tokens, self.types = grams, words, nodes, tokens, types


def train(df: DataFrame, text_col: str = "text") -> Model:
    """A model of all texts of df."""
    counted = mapped(df.select(F.col(text_col).alias("t")), _count, "kind int, key long, n long")
    table = kept(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    said = {r["kind"]: (r["n"], r["k"]) for r in table.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()}
    tokens, types = said.get(1, (0, 0))
    return Model(table.where("kind = 0").select("key", "n"), table.where("kind = 1").select("key", "n"), said.get(0, (0, 0))[1], tokens, types)


def _arrays(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = table.toArrow()
    k, n = got["key"].to_numpy().view(U64), got["n"].to_numpy()
    by = np.argsort(k)
    return k[by], n[by]


#: The worker's trie and word counts under their model's key.
_HELD: dict[str, tuple] = {}


def _ready(key: str, trie, known) -> tuple:
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Trie(*trie.value) if trie else None, known.value if known else None
    return _HELD[key]


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The values of keys in a table of sorted keys and values; 0 where there is none."""
    if not len(table[0]):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return np.where(table[0][at] == keys, table[1][at], 0)


def _asked(names: list[str]):
    """Rows of kind 0: the texts with their part; of kind 1: the distinct n-grams of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, held = TaskContext.get().partitionId() << 32, 0, []
        kinds: list[pa.DataType] = []

        def rows(n: int, kind: int, key: pa.Array, columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part)), key, *columns], names=["kind", "part", "key", *names, "t"])

        def close() -> Iterator[pa.RecordBatch]:
            keys = np.unique(np.concatenate(held)).view(np.int64)
            for i in range(0, len(keys), 50_000):
                some = keys[i : i + 50_000]
                yield rows(len(some), 1, pa.array(some), [pa.nulls(len(some), k) for k in kinds])

        for batch in slices(batches, "t", PIECE):
            columns = [batch.column(c) for c in [*names, "t"]]
            kinds = [c.type for c in columns]
            held += [np.unique(code) for code, _ in grams(*symbols(*utf8(columns[-1])))]
            yield rows(batch.num_rows, 0, pa.nulls(batch.num_rows, pa.int64()), columns)
            size += batch.get_total_buffer_size()
            if size >= PART:
                yield from close()
                part, size, held = part + 1, 0, []
            elif len(held) > 8:
                held = [np.unique(np.concatenate(held))]
        if held:
            yield from close()

    return run


def _answered(base):
    """(key, p) for n-grams that come with their counts (0 for those not in training), all of a context of order 2 together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, count = base.value
        below = Trie(low, count, order=1)
        held, size = [], 0

        def answer() -> Iterator[pa.RecordBatch]:
            key, n = (np.concatenate([t[c].to_numpy() for t in held]) for c in ("key", "n"))
            key = key.view(U64)
            p = Trie(key[n > 0], n[n > 0], base=below).log_probability(key)
            for i in range(0, len(key), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 50_000].view(np.int64)), pa.array(p[i : i + 50_000])], names=["key", "p"])

        for table in groups(batches, "context"):
            held.append(table)
            size += table.num_rows
            if size >= RUN:
                yield from answer()
                held, size = [], 0
        if held:
            yield from answer()

    return run


def _cut(source: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """The rows of source (names, t) as kind 0 and, ahead of them in each part's order, the part's n-grams with their probabilities as kind 1."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)
    asked = kept(mapped(source, _asked(names), f"kind int, part long, key long, {kinds}"))
    wanted = asked.where("kind = 1").select("part", "key")
    pairs = model.grams.select(F.col("key").bitwiseAND(_low(2)).alias("key")).distinct()
    base = _arrays(pairs.groupBy(F.col("key").bitwiseAND(_low(1)).alias("key")).agg(F.count(F.lit(1)).alias("n")))
    counts = model.grams.union(wanted.select("key", F.lit(0).cast("long"))).groupBy("key").agg(F.sum("n").alias("n"))
    context = F.shiftright("key", BITS).bitwiseAND((1 << (2 * BITS)) - 1)
    by = counts.select(context.alias("context"), "key", "n").repartition("context").sortWithinPartitions("context")
    answers = mapped(by, _answered(source.sparkSession.sparkContext.broadcast(base)), "key long, p double")
    met = wanted.join(answers.hint("merge"), "key").select(F.lit(1).alias("kind"), "part", "key", "p", *[F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema.fields])
    texts = asked.where("kind = 0").select("kind", "part", "key", F.lit(None).cast("double").alias("p"), *names, "t")
    return met.union(texts).repartition("part").sortWithinPartitions("part", F.desc("kind"))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """id_col and carry with n_tokens, n_known, train_tokens, base_score, score, n_bytes (with the end)."""
    carry = {id_col: F.col(id_col)} | (carry or {})
    names = {f"c{i}": c for i, c in enumerate(carry)}
    sc, key = df.sparkSession.sparkContext, uuid.uuid4().hex
    source = df.select(*[c.alias(x) for x, c in zip(names, carry.values(), strict=True)], F.col(text_col).alias("t"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    trie = sc.broadcast(_arrays(model.grams)) if model.nodes <= NODES else None
    known = sc.broadcast(_arrays(model.words)) if model.types <= WORDS else None
    tokens, types = model.tokens, model.types

    def scored(part: pa.RecordBatch, probability, table) -> pa.RecordBatch:
        m = part.num_rows
        data, offsets = utf8(part.column("t"))
        text, bounds = symbols(data, offsets)
        total = np.zeros(m)
        for code, row in grams(text, bounds):
            unique, back = np.unique(code, return_inverse=True)
            total += np.bincount(row, probability(unique)[back], m)
        data = LOWER[data]
        start, end, owner = words(data, offsets)
        word, owner = np.concatenate([hash_spans(data, start, end), np.repeat(END_WORD, m)]), np.concatenate([owner, np.arange(m)])
        size = np.bincount(owner, minlength=m)
        out = [*(part.column(c) for c in names), pa.array(size.astype(np.int64)), pa.array(total), pa.array(np.diff(bounds))]
        if table is not None:
            unique, back = np.unique(word, return_inverse=True)
            count = _found(table, unique)
            out += [pa.array(np.bincount(owner, (count > 0)[back], m).astype(np.int64)), pa.array(np.bincount(owner, np.log10((count + 1) / (tokens + types + 1))[back], m))]
        else:
            by = np.lexsort((word, owner))
            out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(word[by].view(np.int64))))
        return pa.RecordBatch.from_arrays(out, names=[*names, "n_tokens", "score", "n_bytes", *(["n_known", "base_score"] if table is not None else ["words"])])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, table = _ready(key, trie, known)
        for part in slices(batches, "t", PIECE):
            yield scored(part, made.log_probability, table)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = _ready(key, None, known)
        now, held, answers = None, [], (np.zeros(0, U64), np.zeros(0))
        for batch in batches:
            part, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(part)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b > a and kind[a]:
                    if part[a] != now:
                        now, held = part[a], []
                    held.append((batch.column("key").slice(a, b - a).to_numpy(zero_copy_only=False).view(U64), batch.column("p").slice(a, b - a).to_numpy(zero_copy_only=False)))
                elif b > a:
                    if held:
                        k, p = (np.concatenate(c) for c in zip(*held, strict=True))
                        by, held = np.argsort(k), []
                        answers = k[by], p[by]
                    for some in slices(iter([batch.slice(a, b - a)]), "t", PIECE):
                        yield scored(some, lambda code: answers[1][np.searchsorted(answers[0], code)], table)

    out = f"{kinds}, n_tokens long, score double, n_bytes long, " + ("n_known long, base_score double" if known else "words array<long>")
    made = mapped(source, whole, out) if trie else mapped(_cut(source, model, list(names)), parted, out)
    if not known:
        made = kept(made.withColumn("row", F.monotonically_increasing_id()))
        said = made.select("row", F.explode("words").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("k"))
        found = said.join(model.words, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        base = found.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("n_known"), F.sum(F.col("k") * F.log10((F.col("n") + 1) / F.lit(float(tokens + types + 1)))).alias("base_score"))
        made = made.join(base, "row").drop("row", "words")
    return made.select(*[F.col(x).alias(c) for x, c in names.items()], "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes")


def adaptive(text: str | None, order: int = ORDER) -> float:
    """log10 probability of one text under a model that starts empty and learns as it goes: the code length of a text on its own."""
    made, _ = symbols(*utf8(pa.array([text], type=pa.string())))
    counts: dict[tuple, dict[int, int]] = defaultdict(dict)
    past, total = (BEFORE,) * order, 0.0
    for b in made.tolist():
        out: set[int] = set()
        for k in range(order, -1, -1):
            here = counts.get(past[order - k :])
            left = {s: n for s, n in here.items() if s not in out} if here else {}
            if left:
                n = sum(left.values())
                if b in left:
                    total += log10((2 * left[b] - 1) / (2 * n))
                    break
                total += log10(len(left) / (2 * n))
                out |= left.keys()
        else:
            total -= log10(max(1, ALPHABET - len(out)))
        for k in range(order + 1):
            here = counts[past[order - k :]]
            here[b] = here.get(b, 0) + 1
        past = (*past, b)[1:] if order else past
    return total
