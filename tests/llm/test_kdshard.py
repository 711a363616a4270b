import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from bytemill.llm import kdshard, queries


def plain(rows, shards):
    """The same tree by sorted lists: text to shard."""
    groups = defaultdict(list)
    for _, t, lang, source in rows:
        groups[t or ""].append((lang if lang is not None else "\0", source if source is not None else "\0"))
    made = []
    for t, of in groups.items():
        size = len(t.encode()) + 1
        point = [min((1 << 20) - 1, math.floor(math.log2(size) * (1 << 15))), *(zlib.crc32(min(x[i] for x in of).encode()) >> 12 for i in (0, 1))]
        made.append({"t": t, "w": size * len(of), "p": point, "tie": int(hashlib.md5(t.encode()).hexdigest()[:10], 16)})
    leaf = None
    while True:
        light = [g["w"] for g in made if leaf is None or g["w"] <= leaf]
        if not light:
            leaf = min(g["w"] for g in made)
            break
        now = max(1, math.ceil(sum(light) / (shards - len(made) + len(light))))
        if now == leaf:
            break
        leaf = now
    for g in made:
        g["s"] = next((j for j, s in enumerate(kdshard.STRATA) if g["w"] > s * leaf), len(kdshard.STRATA))
        g["w"] = min(g["w"], leaf)
    spread = lambda gs, i: max(g["p"][i] for g in gs) - min(g["p"][i] for g in gs)
    width = [max(1, spread(made, i)) for i in range(3)]
    out = {}

    def split(gs, a, b):
        if b - a == 1 or not gs:
            out.update((g["t"], a) for g in gs)
            return
        dim = max(range(3), key=lambda i: (spread(gs, i) / width[i], -i))
        half = (a + b) // 2
        sides, seen, left = ([], []), 0, 0
        for j in range(len(kdshard.STRATA) + 1):
            own = sorted((g for g in gs if g["s"] == j), key=lambda g: (g["p"][dim], g["tie"]))
            total = sum(g["w"] for g in own)
            seen += total
            goal = min(max(seen * ((half - a) / (b - a)) - left, 0), total)
            at = 0
            for k, g in enumerate(own):
                if at + g["w"] > goal:
                    if goal - at > at + g["w"] - goal:
                        at, k = at + g["w"], k + 1
                    break
                at += g["w"]
            else:
                k = len(own)
            sides[0].extend(own[:k])
            sides[1].extend(own[k:])
            left += at
        split(sides[0], a, half)
        split(sides[1], half, b)

    split(made, 0, shards)
    return out


def check(rows, got, shards, slack):
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    text = defaultdict(set)
    of = {d: t or "" for d, t, *_ in rows}
    slots, load = defaultdict(list), Counter()
    for r in got:
        text[of[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(len(v) == 1 for v in text.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(load) <= set(range(shards))
    if slack:
        mean = sum(load.values()) / shards
        assert max(load.values()) <= mean * (1 + slack) and min(load.get(i, 0) for i in range(shards)) >= mean * (1 - slack)


def documents(n, seed):
    r = random.Random(seed)
    rows = [(i, "".join(r.choices("abcdé ", k=int(5 * 2 ** r.uniform(0, 10)))), r.choice(["en", "de", None]), r.choice(["src0"] * 3 + ["src1", None])) for i in range(n)]
    return rows + [(n + i, f"copy of text {i % 3}", "en" if i % 2 else "fr", f"src{i % 5}") for i in range(n)] + [(2 * n, None, None, None), (2 * n + 1, "", "en", "src1"), (2 * n + 1, "", "en", "src1")]


@pytest.mark.parametrize(("n", "giant"), [(60, 0), (120, 40_000)])
def test_query_equals_the_tree_by_sorted_lists(spark, tmp_path, monkeypatch, n, giant):
    monkeypatch.setattr(kdshard, "TOLERANCE", 0)
    rows = [*documents(n, 3), (9000, "y" * giant, "de", "b"), (9001, "z" * giant, "de", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_kdshard(spark, str(tmp_path)).collect()
    check(rows, got, 16, None)
    want = plain(rows, 16)
    assert Counter((r.doc_id, r.shard) for r in got) == Counter((d, want[t or ""]) for d, t, _, _ in rows)


def test_more_levels_than_are_kept_in_one_plan(spark, monkeypatch):
    monkeypatch.setattr(kdshard, "TOLERANCE", 0)
    monkeypatch.setattr(kdshard, "LEVELS", 2)
    monkeypatch.setattr(kdshard, "BINS", 8)
    rows = documents(150, 5)
    want = plain(rows, 37)
    got = kdshard.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=37).collect()
    assert Counter((r.doc_id, r.shard) for r in got) == Counter((d, want[t or ""]) for d, t, _, _ in rows)


def test_shards_of_equal_bytes_keep_copies_together(spark, monkeypatch):
    monkeypatch.setattr(kdshard, "SLOTS", 20)
    r = random.Random(1)
    rows = [(i, "".join(r.choices("abcdé ", k=r.randrange(10, 900))), r.choice(["en", "de", None]), r.choice(["src0"] * 3 + ["src1", None])) for i in range(1500)]
    rows += [(2000 + i, "copy of one text", "en" if i % 2 else "fr", f"src{i % 5}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    check(rows, kdshard.shard(df, shards=16).collect(), 16, 0.02)
    n = -(-sum(len((t or "").encode()) + 1 for _, t, *_ in rows) // 100_000)
    check(rows, kdshard.shard(df, target_bytes=100_000).collect(), n, 0.02)


def test_nulls_empties_repeats_and_few_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "x", "en", "a"), (3, "x", "en", "a"), (4, "y" * 500_000, "de", "b")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, shard int")
    check(rows, kdshard.shard(df, shards=16).collect(), 16, None)
    assert kdshard.shard(df.limit(0), shards=4).count() == 0
