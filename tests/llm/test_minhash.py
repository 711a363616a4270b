import random
import re

import numpy as np
import pyarrow as pa

from bytemill.llm import minhash
from bytemill.llm.graph import components


def sets(text, width):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, percent):
    s = [sets(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * len(s[i] | s[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(s[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(n, seed):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["É", "the", "A"]
    base = [[r.choice(vocabulary) for _ in range(r.choice([3, 8, 60, 150]))] for _ in range(n // 4)]
    hub = [r.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(hub if i % 3 == 0 else r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, r.choice([" ", "  ", "\n"]).join(w).upper() if i % 7 == 0 else " ".join(w)))
    return rows


def test_shingles_are_the_distinct_runs_of_words():
    texts = ["a b c d e", "A  B\tC\nD e", "", None, "x", "x y z", "a b c d a b c d a", " lead", "é b c d e"]
    made, cut = minhash.shingles(pa.array(texts), 4)
    assert np.diff(cut).tolist() == [len(sets(t, 4)) for t in texts]
    assert made[cut[0] : cut[1]].tolist() == made[cut[1] : cut[2]].tolist()


def test_same_components_as_brute_force(spark):
    rows = corpus(700, 5)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4, 80)


def test_regions_and_clusters_that_must_be_split(spark, monkeypatch):
    rows = corpus(500, 6)
    for name, value in (("REGION", 8), ("BLOCK_ROWS", 20), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(minhash, name, value)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4, 80)


def test_pairs_at_the_threshold_in_a_family_of_unlike_members(spark, monkeypatch):
    """Members agree where a tree's key begins, in half of their values; each has one partner with 80 of 96 values, that differs early in every tree."""
    monkeypatch.setattr(minhash, "REGION", 16)
    r, n = np.random.default_rng(8), 50
    ones = r.integers(0, 1 << 16, (n, minhash.TREES, minhash.PER_TREE), dtype=np.uint16)
    ones[:, :, :3] = ones[0, :, :3]
    others = ones.copy()
    others[:, :, 4] += 1
    rows = [(2 * i + k, bytearray(x[i].tobytes())) for k, x in enumerate((ones, others)) for i in range(n)]
    met = {(min(e), max(e)) for e in minhash.candidates(spark.createDataFrame(rows, "rep long, sig binary")).collect()}
    assert met == {(2 * i, 2 * i + 1) for i in range(n)}


def test_nulls_empties_repeats_and_clashing_names(spark):
    long = "word " * 200_000
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (None, "a b c d e f", 0), (5, "a b c d e f", 1), (6, "A b c d e  f", 1), (6, "A b c d e  f", 1), (7, long, 2), (8, long + "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component long")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df, width=4).collect()}
    assert got == {(1, 1, True), (2, 2, True), (3, 3, True), (None, None, True), (5, 5, True), (6, 5, False), (7, 7, True), (8, 8, True)}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 150: 150, 200: 150}
