"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased; every run of characters other than letters is one border. A symbol's context is at
most ORDER - 1 symbols back and ends at the last border, so it never leaves the word. Each language has its own
model of orders 1 to ORDER: raw counts at the top, counts of distinct predecessors below, one absolute discount an
order (n1 / (n1 + 2 n2)), and a uniform end. It is stored as sorted arrays of 64-bit hashes, n-grams with their
interpolated log probability and contexts with their back-off weight. The language with the least cross-entropy
per symbol wins.

Rejection is calibrated on rows kept out of the fit, up to `calibrate` a language, as far as the models give them their own label (so a wrong
label sets no limit): cross-entropy c of n symbols is compared with mean m of the language, z = (c - m) / sqrt(s2 / n + t2), where s2 is the
variance of a symbol's cost and t2 that of documents. A language's limit is the (1 - FALSE) quantile of its z, so about a share of FALSE of
a language's own documents is rejected (never below FLOOR; the largest z where there are too few rows for the quantile). A text
that is null or has no letter is `und` with score 0 and always rejected. `score` is the language's posterior probability under the models, all alike before.

The fit uses a sample of about `rows_per_language` labelled rows a language, chosen by a hash of the id, of the `languages` most frequent
labels (ties: the smaller name): documented bounds, so the model, and what the driver collects, does not grow with the table. Ties
between languages go to the smaller name. Repeated rows are scored each on its own; a text of any length is coded CHUNK characters at a time;
an empty table gives an empty result, and without labelled rows all is `und`. Carried columns may have any names but those of the results.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytemill.llm.arrow import U64, mapped, mix, slices
from bytemill.llm.shared import kept

ORDER, ROWS, CALIBRATE, LANGUAGES, PIECE, CHUNK, MEMO = 4, 1200, 2000, 1000, 2 << 20, 1 << 20, 1 << 20
#: Share of a language's own documents that may be rejected, and the least limit of z.
FALSE, FLOOR = 0.001, 4.0


@functools.cache
def _symbols() -> np.ndarray:
    """Code point to symbol: 0 for all but letters, else the lower-case letter (those beyond 16 bits are folded into a block of private use)."""
    table = np.zeros(0x110000, dtype=np.uint16)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = ord(x.lower()[0])
            table[c] = low if low < 0x10000 else 0xE000 + low % 0x1900
    return table


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each symbol of each text, CHUNK characters at a time: its n-gram of the top order in 16 bits a symbol, and the text's number."""
    bounds = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])])
    points = np.frombuffer("".join(f"{t or ''}\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for a in range(0, len(points), CHUNK):
        from_ = max(0, a - ORDER)  # a symbol's n-gram is made of no more characters than these before it
        s = _symbols()[points[from_ : a + CHUNK]]
        before = np.concatenate([np.zeros(1, np.uint16), s[:-1]])
        at = np.flatnonzero((s != 0) | (before != 0))
        s = s[at].astype(U64)
        code, context = s.copy(), np.ones(len(s), dtype=bool)
        for back in range(1, ORDER):
            older = np.zeros_like(s)
            older[back:] = s[:-back]
            context = context & (older != 0)
            code |= np.where(context, older, U64(0)) << U64(16 * back)
        own = at >= a - from_
        yield code[own], np.searchsorted(bounds, at[own] + from_, side="right") - 1


def _hash(code: np.ndarray, order: int, context: bool) -> np.ndarray:
    return mix(code + U64(0x9E3779B97F4A7C15 * (2 * order + context) % (1 << 64)))


def _low(code: np.ndarray, order: int) -> np.ndarray:
    return code & U64((1 << (16 * order)) - 1)


@dataclass
class Model:
    """Languages in order; for each, sorted hashes with values, and the calibration (mean, symbol variance, document variance, limit of z)."""

    languages: list[str]
    tables: list[tuple[np.ndarray, np.ndarray]]
    floor: list[float]
    calibration: dict[str, tuple[float, float, float, float]]

    def costs(self, code: np.ndarray) -> np.ndarray:
        """Natural log probability of each n-gram's last symbol under each language."""
        out = np.empty((len(code), len(self.languages)))
        for j, ((keys, values), floor) in enumerate(zip(self.tables, self.floor, strict=True)):
            left, held = np.arange(len(code)), np.zeros(len(code))
            for order in range(ORDER, 0, -1):
                c = _low(code[left], order)
                h = _hash(c, order, False)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                held[left[hit]] += values[at[hit]]
                left, c = left[~hit], c[~hit]
                h = _hash(c >> U64(16), order, True)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                held[left[hit]] += values[at[hit]]
            held[left] += floor
            out[:, j] = held
        return out


def fit(language: str, code: np.ndarray, count: np.ndarray, alphabet: int) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    """Sorted hashes and values of one language's model, and the log of the uniform share at the end."""
    counts = {ORDER: (code, count.astype(np.float64))}
    for order in range(ORDER - 1, 0, -1):
        low, n = np.unique(_low(counts[order + 1][0], order), return_counts=True)
        counts[order] = low, n.astype(np.float64)
    keys, values = [], []
    below = None
    for order in range(1, ORDER + 1):
        c, n = counts[order]
        n1, n2 = (n == 1).sum(), (n == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        context, at = np.unique(c >> U64(16), return_inverse=True)
        total, kinds = np.bincount(at, n), np.bincount(at)
        share = discount * kinds / total
        if order == 1:
            lower = np.full(len(c), 1 / alphabet)
        else:
            lower = below[1][np.searchsorted(below[0], _low(c, order - 1))]
        p = (n - discount) / total[at] + share[at] * lower
        below = c, p
        keys += [_hash(c, order, False), _hash(context, order, True)]
        values += [np.log(p), np.log(share)]
    keys, values = np.concatenate(keys), np.concatenate(values)
    by = np.argsort(keys)
    return (keys[by], values[by]), -float(np.log(alphabet))


class Scorer:
    """Scores texts and remembers up to MEMO n-grams."""

    def __init__(self, model: Model):
        self.model = model
        self.known = np.zeros(0, dtype=U64)
        self.cost = np.zeros((0, len(model.languages)))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of each text, its total log probability under each language, and the sum of squares."""
        m, k = len(texts), len(self.model.languages)
        n, total, squares = np.zeros(m, np.int64), np.zeros((m, k)), np.zeros((m, k))
        for code, rows in grams(texts):
            unique, back = np.unique(code, return_inverse=True)
            new = unique[~np.isin(unique, self.known, assume_unique=True)]
            if len(new):
                if len(self.known) + len(new) > MEMO:
                    self.known, self.cost, new = np.zeros(0, dtype=U64), np.zeros((0, k)), unique
                known = np.concatenate([self.known, new])
                by = np.argsort(known)
                self.known, self.cost = known[by], np.concatenate([self.cost, self.model.costs(new)])[by]
            cost = self.cost[np.searchsorted(self.known, unique)]
            n += np.bincount(rows, minlength=m)
            for j in range(k):
                total[:, j] += np.bincount(rows, cost[:, j][back], m)
                squares[:, j] += np.bincount(rows, (cost[:, j] ** 2)[back], m)
        return n, total, squares


#: The worker's scorer under its model's key; a new model takes the old one's place.
_SCORER: dict[str, Scorer] = {}


def _scorer(key: str, held) -> Scorer:
    if key not in _SCORER:
        _SCORER.clear()
        _SCORER[key] = Scorer(held.value)
    return _SCORER[key]


def _unit(id_col: str) -> Column:
    """A number in [0, 1) from the id alone (null ids share one)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("fit:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS, calibrate: int = CALIBRATE, languages: int = LANGUAGES) -> Model:
    """A model from the labelled rows of df (those with a text and a language)."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang")).where("t is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return Model([], [], [], {})
    # of few rows four in five are for the fit
    fit_rate = [(r["lang"], min(0.8, rows_per_language / r["n"]), min(1.0, min(0.8, rows_per_language / r["n"]) + calibrate / r["n"])) for r in sizes]
    rates = F.broadcast(spark.createDataFrame(fit_rate, "lang string, fit double, most double"))
    sample = kept(rows.join(rates, "lang").withColumn("u", _unit("id")).where("u < most").select("lang", "t", (F.col("u") < F.col("fit")).alias("fit")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", PIECE):
            labels, numbers = np.unique(np.array(part.column("lang").to_pylist(), dtype=str), return_inverse=True)
            for code, rows in grams(part.column("t").to_pylist()):
                own = numbers[rows]
                for j, lang in enumerate(labels.tolist()):
                    c, n = np.unique(code[own == j], return_counts=True)
                    if len(c):  # a chunk need not hold every label of its piece
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), type=pa.string()), pa.array(c.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    counted = mapped(sample.where("fit").select("lang", "t"), count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    code, n, langs = counted["code"].to_numpy().view(U64), counted["n"].to_numpy(), np.asarray(counted["lang"].to_pylist(), dtype=object)
    names = sorted(set(langs.tolist()))
    alphabet = len(np.unique(_low(code, 1))) + 1
    fitted = [fit(x, code[langs == x], n[langs == x], alphabet) for x in names]
    model = Model(names, [f[0] for f in fitted], [f[1] for f in fitted], {})
    if not names:
        return model
    held = spark.sparkContext.broadcast(model)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for part in slices(batches, "t", PIECE):
            n, total, squares = scorer.score(part.column("t").to_pylist())
            j = np.array([names.index(x) if x in names else -1 for x in part.column("lang").to_pylist()])
            at = np.flatnonzero((j == total.argmax(axis=1)) & (n > 0))
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in j[at]], type=pa.string()), pa.array(n[at].astype(np.int64)), pa.array(total[at, j[at]]), pa.array(squares[at, j[at]])], names=["lang", "n", "total", "squares"])

    found = mapped(sample.where("not fit").select("lang", "t"), seen, "lang string, n long, total double, squares double").toPandas()
    for x in names:
        s = found[found.lang == x]
        if len(s):
            c = -s.total / s.n
            m = float(-s.total.sum() / s.n.sum())
            s2 = max(0.0, float(s.squares.sum() / s.n.sum() - m * m))
            t2 = float(max(1e-4, ((c - m) ** 2 - s2 / s.n).mean()))
            z = np.sort(((c - m) / np.sqrt(s2 / s.n + t2)).to_numpy())
            limit = float(z[min(len(z), math.ceil((len(z) + 1) * (1 - FALSE))) - 1])
            model.calibration[x] = m, s2, t2, max(FLOOR, limit)
    return model


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """carry (or id_col alone) with lang_pred, score, n_symbols, cross_entropy (nats a symbol) and rejected."""
    carry = carry or [id_col]
    names = [f"c{i}" for i in range(len(carry))]
    held, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    languages = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, held)
        for part in slices(batches, "t", PIECE):
            m = part.num_rows
            if languages:
                n, total, _ = scorer.score(part.column("t").to_pylist())
                cost = -total / np.maximum(n, 1)[:, None]
                best = cost.argmin(axis=1)
                low = cost[np.arange(m), best]
                score = 1 / np.exp(-(cost - low[:, None]) * n[:, None]).sum(axis=1)
                mean, s2, t2, limit = (np.array([calibration(held.value, x)[i] for x in languages])[best] for i in range(4))
                rejected = (n == 0) | ((low - mean) / np.sqrt(s2 / np.maximum(n, 1) + t2) > limit)
            else:
                n, best, low, score, rejected = np.zeros(m, int), np.zeros(m, int), np.zeros(m), np.zeros(m), np.ones(m, bool)
            lang = ["und" if not k else languages[b] for k, b in zip(n.tolist(), best.tolist(), strict=True)] if languages else ["und"] * m
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(lang), pa.array(np.where(n > 0, score, 0.0)), pa.array(n.astype(np.int64)), pa.array(np.where(n > 0, low, 0.0)), pa.array(rejected)], names=[*names, "lang_pred", "score", "n_symbols", "cross_entropy", "rejected"])

    kinds = [df.schema[c].dataType.simpleString() for c in carry]
    source = df.select(*[F.col(c).alias(x) for c, x in zip(carry, names, strict=True)], F.col(text_col).alias("t"))
    made = mapped(
        source, run, ", ".join([*(f"{x} {k}" for x, k in zip(names, kinds, strict=True)), "lang_pred string, score double, n_symbols long, cross_entropy double, rejected boolean"]))
    return made.withColumnsRenamed(dict(zip(names, carry, strict=True)))


def calibration(model: Model, language: str) -> tuple[float, float, float, float]:
    """Of a language; one that had no row to calibrate on rejects nothing."""
    return model.calibration.get(language, (1e9, 1.0, 1.0, 1.0))
