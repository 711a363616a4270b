import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bytemill.llm import ppm, queries
from bytemill.llm.arrow import utf8


def tokens(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0d]+", low)


def coded(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return (ppm.BEFORE,) * ppm.ORDER + (*low, ppm.END)


def plain(training):
    """The same model by dictionaries: a function from a text to its log10 probability."""
    top = Counter()
    for t in training:
        s = coded(t)
        top.update(s[i - ppm.ORDER : i + 1] for i in range(ppm.ORDER, len(s)))
    counts = defaultdict(dict)
    level = dict(top)
    for k in range(ppm.ORDER, -1, -1):
        for g, n in level.items():
            counts[g[:-1]][g[-1]] = n
        level = Counter(g[1:] for g in level)

    def one(context, b):
        total, out = 0.0, set()
        for k in range(ppm.ORDER, -1, -1):
            here = counts.get(context[ppm.ORDER - k :])
            left = {s: n for s, n in here.items() if s not in out} if here else {}
            if left:
                n = sum(left.values())
                if b in left:
                    return total + math.log10((2 * left[b] - 1) / (2 * n))
                total += math.log10(len(left) / (2 * n))
            out = set(here) if here else out
        return total - math.log10(ppm.ALPHABET - len(counts.get((), {})))

    def text(t):
        s = coded(t)
        return sum(one(s[i - ppm.ORDER : i], s[i]) for i in range(ppm.ORDER, len(s)))

    return text, one


def texts(n, seed):
    r = random.Random(seed)
    w = ["the", "The", "cat", "été", "sat.", "a", "on", "1", "x" * 30]
    return [r.choice([None, "", " ", "zq"]) if i % 9 == 0 else r.choice([" ", "  ", "\n"]).join(r.choices(w, k=r.randrange(1, 30))) for i in range(n)]


def test_probabilities_sum_to_one():
    _, one = plain(texts(40, 1))
    for context in (tuple(b"the c"), (ppm.BEFORE,) * 5, tuple(b"zzzzz"), tuple(b" cat ")):
        assert abs(sum(10 ** one(context, b) for b in range(ppm.ALPHABET)) - 1) < 1e-9


@pytest.mark.parametrize("chunk", [7, ppm.CHUNK])
def test_ngrams_are_the_bytes_and_an_end(monkeypatch, chunk):
    monkeypatch.setattr(ppm, "CHUNK", chunk)
    column = pa.array(["A b\t\nC", None, "", "  É x ", "one and another"])
    found = defaultdict(list)
    for code, row in ppm.grams(*ppm.symbols(*utf8(column))):
        for c, r in zip(code.tolist(), row.tolist(), strict=True):
            found[r].append(tuple(c >> (ppm.BITS * k) & 511 for k in range(ppm.ORDER, -1, -1)))
    for i, t in enumerate(column.to_pylist()):
        s = coded(t)
        assert found[i] == [s[k - ppm.ORDER : k + 1] for k in range(ppm.ORDER, len(s))]


@pytest.mark.parametrize(("most", "nodes"), [(ppm.WORDS, ppm.NODES), (0, 0)])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, most, nodes):
    """Also where words are joined, and where the trie is cut."""
    for name, value in (("WORDS", most), ("NODES", nodes), *([("PIECE", 300), ("PART", 2000), ("RUN", 50), ("CHUNK", 100)] if not nodes else [])):
        monkeypatch.setattr(ppm, name, value)
    rows = [(i, t) for i, t in enumerate(texts(150, 2))] + [(None, "the cat"), (7, "again the cat"), (7, "again the cat")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, words string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    training = [t for d, t in rows if not held(d)]
    c = Counter(w for t in training for w in [*tokens(t), b"\n"])
    n, v = sum(c.values()), len(c)
    text, _ = plain(training)
    want = Counter()
    for d, t in rows:
        w = [*tokens(t), b"\n"]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        want[d, held(d), len(w), sum(c[x] > 0 for x in w), n, round(base, 6), round(text(t), 6)] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in queries.op1_ppm(spark, str(tmp_path)).collect())
    assert got == want


@pytest.mark.parametrize("nodes", [ppm.NODES, -1])
def test_empty_training_and_tables(spark, monkeypatch, nodes):
    monkeypatch.setattr(ppm, "NODES", nodes)
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score(df, ppm.train(df.limit(0))).collect()}
    assert abs(got[1].score + 3 * math.log10(ppm.ALPHABET)) < 1e-9 and got[2].n_tokens == 1 and got[1].train_tokens == 0 and got[1].base_score == 0
    assert ppm.score(df.limit(0), ppm.train(df)).count() == 0


def test_a_long_text_in_several_chunks(spark):
    """Also under clashing names."""
    word = "the cat sat on a mat. "
    df = spark.createDataFrame([(1, word * 200_000, 0), (2, word * 400_000, 0)], "doc_id long, text string, c0 int")
    a, b = (r for r in ppm.score(df, ppm.train(df), carry={"c0": F.col("c0"), "t": F.lit(1)}).sort("doc_id").collect())
    assert a.n_bytes == 200_000 * len(word) + 1 and a.c0 == 0 and a.t == 1
    assert -12 < b.score < a.score < 0  # a text that repeats itself is foreseen


def test_adaptive_learns_within_a_text():
    assert ppm.adaptive("the cat " * 40) > 12 * ppm.adaptive("the cat ")
    assert abs(ppm.adaptive(None) + math.log10(ppm.ALPHABET)) < 1e-9
