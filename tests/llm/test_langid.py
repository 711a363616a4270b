import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from bytemill.llm import langid, queries


def plain(texts, alphabet):
    """The same model by dictionaries: log probability of every symbol of a text."""
    def spread(text):
        out, before = [], ""
        for c in text.lower() + "\n":
            c = c if c.isalpha() else ""
            if c or before:
                word = out[-1][0] if out and before else ("",) * 3
                out.append(((*word, c)[-3:] if c else ("",) * 3, (*word, c)))
            before = c
        return [x[1] for x in out]

    counts = {4: Counter(g for t in texts for g in spread(t))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = {k: (lambda a, b: a / (a + 2 * b) if a and b else 0.5)(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())) for k, c in counts.items()}
    total, kinds = defaultdict(float), defaultdict(int)
    for c in counts.values():
        for g, n in c.items():
            total[len(g), g[:-1]] += n
            kinds[len(g), g[:-1]] += 1

    def p(g):
        if not g:
            return 1 / alphabet
        at = len(g), g[:-1]
        if at not in total:
            return p(g[1:])
        d = discount[len(g)]
        return max(counts[len(g)].get(g, 0) - d, 0) / total[at] + d * kinds[at] / total[at] * p(g[1:])

    return lambda text: [math.log(p(g)) for g in spread(text)]


def test_model_equals_the_dictionary_form():
    texts = ["the cat sat on the mat.", "A hat, the bat; 12 THE end", "then there were ten"]
    (code, _), = langid.grams(texts)
    c, n = np.unique(code, return_counts=True)
    alphabet = len(np.unique(code & np.uint64(0xFFFF))) + 1
    table, floor = langid.fit("en", c, n, alphabet)
    scorer = langid.Scorer(langid.Model(["en"], [table], [floor], {}))
    want = plain(texts, alphabet)
    for text in [*texts, "the zebra", "", "!!", "x"]:
        k, total, _ = scorer.score([text])
        logs = want(text)
        assert k[0] == len(logs) and abs(total[0, 0] - sum(logs)) < 1e-9


def test_chunks_of_a_text_give_the_same_ngrams(monkeypatch):
    texts = ["the cat sat, on the mat", None, "", "ein Wort " * 40, "y" * 70]
    (code, rows), = langid.grams(texts)
    monkeypatch.setattr(langid, "CHUNK", 7)
    parts = list(langid.grams(texts))
    assert len(parts) > 20 and (np.concatenate([p[0] for p in parts]) == code).all() and (np.concatenate([p[1] for p in parts]) == rows).all()


def unit(doc_id):
    return int(hashlib.md5(f"fit:{doc_id}".encode()).hexdigest()[:8], 16) / 2**32


def test_query_equals_the_dictionary_form(spark, tmp_path):
    """Prediction, score and cross-entropy of every row, ties between equal models included."""
    words = {"aa": ["lor", "mip", "dol", "Sit"], "bb": ["ket", "zuv", "wox", "qah"], "cc": ["mip", "zuv", "été", "nun"]}
    r = np.random.default_rng(3)
    rows = [(i, " ".join(r.choice(words[x], r.integers(1, 9))) + r.choice(["", " 12", ", ok"]), x) for i, x in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(1000 + i, t, None) for i, t in enumerate([None, "", "12", "zzz", "mip zuv", "ket " * 30])]
    spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, lang string, c0 int").write.parquet(f"{tmp_path}/documents.parquet")
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, _, _ in rows}
    fit = {x: [t for d, t, lang in rows if lang == x and not held[d] and unit(d) < 0.8] for x in words}
    alphabet = len({c for ts in fit.values() for t in ts for c in t.lower() if c.isalpha()}) + 2
    model = {x: plain(ts, alphabet) for x, ts in fit.items()}
    got = {x.doc_id: x for x in queries.op10_langid(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        assert got[d].held_out == held[d]
        logs = {x: sum(m(t or "")) for x, m in model.items()}
        n = len(model["aa"](t or ""))
        best = min(logs, key=lambda x: (-logs[x], x))
        assert got[d].lang_pred == (best if n else "und") and got[d].n_symbols == n
        assert abs(got[d].score - (1 / sum(math.exp(v - logs[best]) for v in logs.values()) if n else 0)) < 1e-9
        assert abs(got[d].cross_entropy - (-logs[best] / n if n else 0)) < 1e-9


def test_equal_models_tie_to_the_smaller_name(spark):
    rows = [(i, "lor mip dol", x) for i, x in enumerate(["bb", "aa"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, rows_per_language=10**6)
    counts = {x: sum(lang == x and unit(i) < 0.8 for i, _, lang in rows) for x in ("aa", "bb")}
    found = {r.lang_pred for r in langid.predict(df, model).collect()}
    assert found <= {"aa", "bb"} and (found == {"aa"} or counts["aa"] != counts["bb"])


def test_rejection_rate_and_wrong_labels(spark, monkeypatch):
    """About FALSE of unseen documents are rejected, foreign ones all, though one label in twenty is wrong."""
    monkeypatch.setattr(langid, "FALSE", 0.02)
    monkeypatch.setattr(langid, "FLOOR", 0.0)
    r = np.random.default_rng(5)
    letters = {"aa": "abcdefgh", "bb": "hijklmno", "foreign": "uvwxyz"}
    vocabulary = {x: ["".join(r.choice(list(c), r.integers(2, 7))) for _ in range(200)] for x, c in letters.items()}
    text = lambda x: " ".join(r.choice(vocabulary[x], r.integers(20, 60)))
    rows = [(i, text(x), ("bb" if x == "aa" else "aa") if r.random() < 0.05 else x) for i, x in enumerate(["aa", "bb"] * 700)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_language=300)
    fresh = [(10_000 + i, text(x), x) for i, x in enumerate([*["aa", "bb"] * 400, *["foreign"] * 50])]
    got = {x.doc_id: x for x in langid.predict(spark.createDataFrame(fresh, "doc_id long, text string, truth string"), model).collect()}
    own = [got[d] for d, _, x in fresh if x != "foreign"]
    assert all(got[d].lang_pred == x for d, _, x in fresh if x != "foreign")
    assert 0 < sum(x.rejected for x in own) < 0.05 * len(own)
    assert all(got[d].rejected for d, _, x in fresh if x == "foreign")


def test_only_the_most_frequent_labels_are_learned(spark):
    rows = [(i, "lor mip", "aa" if i % 2 else f"x{i}") for i in range(100)]
    assert langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=1).languages == ["aa"]


def test_a_label_may_be_missing_from_a_chunk(spark):
    """One label has no letters at all, another only the first of a piece's two chunks."""
    long = [(i, "lor mip dol " * 50_000, "bb") for i in range(2)]
    rows = [*long, *[(10 + i, "12 !?", "aa") for i in range(20)], *[(100 + i, "ket zuv", "cc") for i in range(20)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    model = langid.train(df)
    assert model.languages == ["bb", "cc"]
    assert {(r.doc_id, r.lang_pred) for r in langid.predict(df, model).collect()} == {(d, {"aa": "und"}.get(x, x)) for d, _, x in rows}


def test_held_out_accuracy_and_edge_cases(spark):
    words = {"aa": ["lor", "mip", "dol", "sit"], "bb": ["ket", "zuv", "wox", "qah"]}
    r = np.random.default_rng(1)
    rows = [(i, " ".join(r.choice(words[x], 20)), x) for i, x in enumerate(["aa", "bb"] * 150)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !?", None), (1003, "KET, zuv wox", None), (1003, "KET, zuv wox", "aa"), (None, "lor mip dol", "bb"), (1004, "ket zuv " * 100_000, "bb"), (1005, "жщю " * 30, "aa")]
    frame = spark.createDataFrame(odd, "doc_id long, text string, score string")
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in langid.predict(frame, model).collect()}
    assert {(1000, "und", True), (1001, "und", True), (1002, "und", True), (1003, "bb", False), (None, "aa", False), (1004, "bb", False)} <= got
    assert any(x[0] == 1005 and x[2] for x in got)
    assert len(langid.predict(frame, model).collect()) == 8
    empty = frame.limit(0).withColumnRenamed("score", "lang")
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(frame, langid.train(empty)).collect()} == {"und"}
