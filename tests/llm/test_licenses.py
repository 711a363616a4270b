import random
import re

from bytemill.llm import licenses as L
from bytemill.llm import queries


ALL = L.templates()


def bigrams(part):
    w = re.findall(rb"[a-z0-9\x80-\xff]+", part.lower())
    return list(zip(w, w[1:]))


SETS = {name: set(bigrams(t.encode())) for name, t in ALL.items()}


def spans(data):
    """Lines, paragraphs, the whole, and each template's dense stretches, by loops over strings."""
    lines = [(m.start(), m.end()) for m in re.finditer(rb"[^\n]+", data) if data[m.start() : m.end()].strip()]
    out, group = set(lines), []
    paragraphs = []
    for a, b in lines:
        if group and data[group[-1][1] : a].count(b"\n") > 1:
            paragraphs.append(group)
            group = []
        group.append((a, b))
    paragraphs += [group] if group else []
    out |= {(g[0][0], g[-1][1]) for g in paragraphs}
    if len(paragraphs) > 1:
        out.add((0, len(data)))
    w = [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[a-z0-9\x80-\xff]+", data.lower())]
    made = [(a[2], b[2]) for a, b in zip(w, w[1:])]
    for s in SETS.values():
        at = [i for i, p in enumerate(made) if p in s]
        groups, total, high, last = [], 0, 0, None
        for i in at:
            total -= L.GAP * (i - last - 1) if groups else 0
            if not groups or total <= 0 or total <= high - max(8, len(s) / 5):
                groups.append([i, i])
                total = high = 1
            else:
                total += 1
                if total > high:
                    groups[-1][1], high = i, total
            last = i
        out |= {(w[i][0], w[j + 1][1]) for i, j in groups if len({p for p in made[i : j + 1] if p in s}) >= len(s) * L.LEAST / (2 - L.LEAST) - 1e-9}
    return out


def brute(text):
    """Best licence by comparing every span with every template."""
    data, found = (text or "").encode(), []
    for a, b in spans(data):
        s = set(bigrams(data[a:b]))
        scored = [(-2 * len(s & t) / (len(s) + len(t)), name, len(s & t)) for name, t in SETS.items() if s]
        if scored and -min(scored)[0] >= L.LEAST:
            dice, name, both = min(scored)
            found.append((-both, dice, a, b, name))
    stay = []
    for m in sorted(found):
        if all(m[3] <= x[2] or m[2] >= x[3] for x in stay):
            stay.append(m)
    best = min((m for m in stay if m[4] != "all rights reserved"), default=None)
    return (best[4], round(-best[1], 9), len(stay)) if best else (None, None, len(stay))


def test_scan_equals_brute_force(spark):
    r = random.Random(1)
    prose = ["the cat sat on the mat", "all the rights of the licence", "under the terms of the", "été über 12", ""]
    rows = []
    for i in range(250):
        parts = []
        for _ in range(r.randrange(1, 5)):
            t = r.choice([r.choice(prose), r.choice(list(L.TEMPLATES.values())), f"{r.choice(prose)} {r.choice(list(L.TEMPLATES.values()))} {r.choice(prose)}"])
            w = t.split(" ")
            for _ in range(r.choice([0, 0, 1, 3])):
                w[r.randrange(len(w))] = r.choice(["zzz", "the", ""])
            if r.random() < 0.3 and len(w) > 20:
                w[10] += "\n"
            parts.append((" ".join(w)).upper() if r.random() < 0.2 else " ".join(w))
        rows.append((i, r.choice(["\n", "\n\n", "\r\n"]).join(parts)))
    rows += [(900, None), (901, ""), (902, "MIT"), (None, "Released under the MIT License."), (5, "All rights reserved."), (5, "All rights reserved."), (903, "word " * 100_000 + "\nReleased  under the (MIT) license\n")]
    df = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, license string")
    got = sorted(((x.doc_id, x.license, x.dice and round(x.dice, 9), len(x.matches)) for x in L.scan(df).collect()), key=repr)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=repr)
    assert sum(x[1] is not None for x in got) > 100
    assert L.scan(df.limit(0)).count() == 0
    assert all(x.license is None for x in L.scan(df, texts={}).collect())


def test_licences_in_sentences_and_over_paragraphs(spark):
    wrapped = lambda t: re.sub(r"((?:\S+ ){9})", r"\1\n", t).replace(": ", ":\n\n")
    prose = "a text of the kind that is in the way of the reader and of the rest. " * 30
    rows = [
        ("MIT notice", "This project is Released under the MIT License, as is all of it."), (None, "Copyright (c) 2021 Foo. All rights reserved."),
        ("BSD-2-Clause", f"{prose}\n{wrapped(L.TEMPLATES['BSD-2-Clause'])}\n{prose}"), ("BSD-3-Clause", f"Copyright\n\n{wrapped(L.TEMPLATES['BSD-3-Clause'])}"), ("MIT", f"MIT License\n\n{L.TEMPLATES['MIT']}"),
        *[(name, f"{prose}\n\n{ALL[name]}\n{prose}") for name in ("Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0")],
    ]
    df = spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id long, text string")
    got = {x.doc_id: x for x in L.scan(df).collect()}
    assert [got[i].license for i in range(len(rows))] == [x for x, _ in rows]
    assert [m.license for m in got[1].matches] == ["all rights reserved"]


def test_ties_go_to_the_smaller_name(spark):
    df = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    assert L.scan(df, texts={"b": "one two three four", "a": "one two three four"}).first().license == "a"


def test_query_over_a_table(spark, tmp_path):
    rows = [(1, f"see {ALL['Zlib']}"), (2, None), (3, "nothing")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op6_licenses(spark, str(tmp_path)).collect()))
    assert got == [(d, *brute(t)) for d, t in rows]


def test_spans_are_bytes_of_the_text(spark):
    text = "é\nReleased under the MIT License.\nx y"
    m = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().matches
    assert [text.encode()[x.start : x.end].decode() for x in m] == ["Released under the MIT License"]
