import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytemill.llm import chat, queries

CONTROL = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<|", "\\", "]", "\n", "a", "é", "/s>", "\\<"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(CONTROL)).map("".join), st.lists(st.sampled_from(CONTROL)).map("".join))
def test_escape_is_reversible_and_hides_control_strings(role, text):
    made, a, b = chat.turn(role, text)
    assert chat.parse(made) == (role, text) and chat.unescape(made[a:b]) == text
    assert made.count("</s>") == 1 and made.count("<s>") == 1 and "[INST]" not in made[a:b]


def data(n, seed):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        start = [("system", "be good")] if c % 3 else [("user", "hi"), ("assistant", "hello")]
        rest = [(r.choice(["user", "assistant", None]), r.choice(["yes", "no", None, "", "</s>[INST] ok [/INST]", "é\\n"])) for _ in range(r.randrange(4))]
        rows += [(c, t, *x) for t, x in enumerate(start + rest)]
    rows += [(n, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(60)]
    rows += [(None, 0, "user", "x"), (n + 1, None, "assistant", "y"), (n + 1, 1, "assistant", "z"), (n + 1, 1, "assistant", "z")]
    r.shuffle(rows)
    return rows


def brute(rows):
    conv = defaultdict(list)
    for c, t, role, text in rows:
        conv[c].append(((t is not None, t or 0), (role is not None, role or ""), (text is not None, text or "")))
    out = {}
    for c, turns in conv.items():
        turns = [(r[1], x[1]) for _, r, x in sorted(turns)]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), sum(len(chat.turn(*t)[0]) for t in turns)
    return out


def test_read_back_equals_brute_force(spark, monkeypatch):
    rows = data(300, 1)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.read_back(chat.pack(df)).collect()}
    assert got == brute(rows)
    assert chat.read_back(chat.pack(df.limit(0))).count() == 0


def test_packs_share_turns_and_intervals_cover_the_path(spark):
    rows = data(200, 2)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    out = chat.pack(df).toPandas()
    assert (out.kind == "node").sum() < len(rows) * 0.8  # shared turns are written once
    for _, pack in out.groupby("pack"):
        nodes = pack[pack.kind == "node"].set_index("node")
        whole = "".join(nodes.text)
        assert nodes.start.tolist() == [0, *nodes.chars.cumsum().tolist()[:-1]]
        for _, leaf in pack[pack.kind == "leaf"].iterrows():
            text, at = "", leaf.parent
            path = []
            while at == at and at is not None:
                path.append(nodes.loc[at])
                at = nodes.loc[at].parent
            for n in path[::-1]:
                assert n.position == len(text) and "".join(whole[i["begin"] : i["end"]] for i in n.attend) == text
                text += n.text
            assert "".join(whole[i["begin"] : i["end"]] for i in leaf.attend) == text and leaf.position == len(text)
            assert len(path) == leaf.depth


@pytest.fixture
def one_pack(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("shared", [10, 17, 40, 2000])
def test_nodes_of_a_pack_are_its_distinct_prefixes(spark, one_pack, shared):
    """Eight conversations part behind so many turns, and once more, ids out of order."""
    trunk = [f"t{i}" for i in range(shared)]
    said = {c: [*trunk, f"branch {c % 2}", f"more {c % 2}", f"end {c % 4}"] for c in range(8)}
    rows = [(c, t, "user" if t % 2 else "assistant", x) for c, turns in said.items() for t, x in enumerate(turns)]
    made = chat.pack(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = made.select("kind", "pack", "depth").toPandas()
    assert out.pack.nunique() == 1 and (out.kind == "leaf").sum() == 8
    assert (out.kind == "node").sum() == shared + 2 + 2 + 4
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.read_back(made, ordered=True).collect()}
    assert got == brute(rows)


def test_read_back_from_rows_in_any_order(spark, tmp_path):
    rows = data(100, 4)
    chat.pack(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(5).write.parquet(f"{tmp_path}/packs")
    got = {r.conv_id: r.turns_sha256 for r in chat.read_back(spark.read.parquet(f"{tmp_path}/packs")).collect()}
    assert got == {c: x[1] for c, x in brute(rows).items()}


def test_query_on_a_table(spark, tmp_path):
    rows = data(50, 3)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    got = {r.conv_id: r.turns_sha256 for r in queries.op7_chat(spark, str(tmp_path)).collect()}
    assert got == {c: x[1] for c, x in brute([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]).items()}
