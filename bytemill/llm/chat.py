"""Chat formatting into prefix trees.

A turn becomes `<s>[role]` + newline + text + `</s>` + newline. In roles and texts a backslash is put before each backslash and into
each control string (in a role, before `]` and behind `[` and `<`), so no text can end a turn and `unescape` gives back the exact
text. Loss covers assistant texts only.

Conversations are ranked by the hashes of all their turns, which is depth-first order of the tree of shared turns. A task reads
its range of that order as a stream: turns that a conversation shares with the one before are not written again,
the others are appended to the task's pack. Each written turn (a node) has its offset in the pack, the position ids
it starts at (its offset in its own conversation), and the intervals of the pack that its ancestors take up, which is what its
characters may attend to besides those before them in the turn. Each conversation ends in a leaf row. A tree
that spans several tasks repeats the path to its first conversation in each, nothing else; so a first turn that a third of all
conversations share costs one copy a task, and equal conversations spread over tasks as well.

Rows go by (turn, role, text), nulls first. A null role or text counts as empty; a null conv_id is a conversation. The
texts of a conversation are never held as a whole; of each turn of the open path 48 bytes are (its hash, node, position), whatever the depth at which
conversations part, and reading back holds two running digests a turn.
Repeated rows are repeated turns. Columns other than the four are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from bytemill.llm.shared import kept

#: Rows of an output batch.
ROWS = 2000
ASSISTANT = "assistant"
_CONTROL = re.compile(r"\\|</?s>|\[/?INST\]|<</?SYS>>|<\|")
_ROLE = re.compile(r"\\|\]|(?<=[<\[])[^\\\]]", re.DOTALL)
_BACK = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>\[((?:[^\\\]]|\\.)*)\]\n(.*)</s>\n", re.DOTALL)
NODES = "kind string, pack long, row long, node long, parent long, conv_id {id}, depth int, text string, start long, position long, chars long, attend array<struct<begin: long, end: long>>, loss_begin long, loss_end long"


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    """A backslash goes before a lone character, and behind the first one of a longer control string."""
    return control.sub(lambda m: "\\" + m[0] if len(m[0]) == 1 else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its text begins and ends in it."""
    head, body = f"<s>[{escape(role, _ROLE)}]\n", escape(text)
    return f"{head}{body}</s>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = _TURN.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


class Path:
    """The turns of the open path: hash, node, and position of the end of each, and the runs of turns that lie together in the pack."""

    def __init__(self):
        self.marks, self.nodes, self.ends = bytearray(), array("q"), array("q")
        self.runs: list[tuple[int, int]] = []  # first turn and offset in the pack

    def mark(self, depth: int) -> bytes:
        return self.marks[32 * depth : 32 * depth + 32]

    def cut(self, depth: int) -> None:
        """Forgets the turns from depth on."""
        del self.marks[32 * depth :], self.nodes[depth:], self.ends[depth:]
        while self.runs and self.runs[-1][0] >= depth:
            self.runs.pop()

    def append(self, mark: bytes, node: int, chars: int, start: int) -> None:
        if not self.runs or self.intervals(len(self.runs) - 1)[-1][1] != start:
            self.runs.append((len(self.nodes), start))
        self.marks += mark
        self.nodes.append(node)
        self.ends.append(self.position() + chars)

    def position(self) -> int:
        return self.ends[-1] if self.ends else 0

    def intervals(self, first: int = 0) -> list[tuple[int, int]]:
        """Where the path lies in the pack, from its run `first` on."""
        out = []
        for i in range(first, len(self.runs)):
            a, begin = self.runs[i]
            last = self.runs[i + 1][0] if i + 1 < len(self.runs) else len(self.ends)
            out.append((begin, begin + self.ends[last - 1] - (self.ends[a - 1] if a else 0)))
        return out


def _write(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, path = TaskContext.get().partitionId(), Path()
        out: list[tuple] = []
        size = nodes = rows = 0
        last = object()
        depth, shared, first = 0, True, True

        def attend() -> list[dict]:
            return [{"begin": a, "end": b} for a, b in path.intervals()]

        def parent() -> int | None:
            return path.nodes[-1] if path.nodes else None

        def leaf() -> tuple:
            path.cut(depth)
            return ("leaf", pack, rows, None, parent(), last, depth, None, size, path.position(), 0, attend(), None, None)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            made = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            out.clear()
            return made

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                role, text = role or "", text or ""
                if first or conv != last:
                    if not first:
                        out.append(leaf())
                        rows += 1
                    first, last, depth, shared = False, conv, 0, True
                mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
                if shared and path.mark(depth) != mark:
                    path.cut(depth)
                    shared = False
                if not shared:
                    made, a, b = turn(role, text)
                    loss = (a, b) if role == ASSISTANT else (None, None)
                    out.append(("node", pack, rows, nodes, parent(), conv, depth, made, size, path.position(), len(made), attend(), *loss))
                    path.append(mark, nodes, len(made), size)
                    size, nodes, rows = size + len(made), nodes + 1, rows + 1
                depth += 1
                if len(out) >= ROWS:
                    yield flush()
        if not first:
            out.append(leaf())
        if out:
            yield flush()

    return run


def pack(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Node and leaf rows (see NODES), each task's in depth-first order.

    A leaf stands behind the nodes of its conversation: parent is its last node, attend the intervals of its whole text,
    position its length.
    """
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = [F.asc_nulls_first(c) for c in ("turn", "role", "text")]
    own = Window.partitionBy("conv_id")
    mark = F.substring(F.md5(F.concat_ws("\0", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))), 1, 16)
    rows = rows.withColumn("nr", F.row_number().over(own.orderBy(*order)))
    marks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nr", mark.alias("m")))).alias("marks"))
    paths = marks.select("conv_id", F.array_join(F.transform("marks", lambda x: x["m"]), "").alias("path"))
    ranks = kept(paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select(F.col("conv_id").alias("c"), F.monotonically_increasing_id().alias("rank")))
    ranked = rows.join(ranks, F.col("conv_id").eqNullSafe(F.col("c")))
    dealt = ranked.repartitionByRange("rank").sortWithinPartitions("rank", "nr").select("conv_id", "role", "text")
    kind = NODES.format(id=df.schema[conv_col].dataType.simpleString())
    schema = to_arrow_schema(df.sparkSession.createDataFrame([], kind).schema)
    return dealt.mapInArrow(_write(schema), kind)


def read_back(packed: DataFrame, ordered: bool = False) -> DataFrame:
    """One row per conversation, with n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    packed: the rows of pack, in any order and partitions; `ordered` says that they come straight from it, and saves a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[tuple] = []  # by depth: hash of turns, hash of loss, loss characters, characters
        names = ("kind", "conv_id", "depth", "text", "loss_begin", "loss_end")
        for batch in batches:
            out = []
            for kind, conv, depth, text, a, b in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                before = path[depth - 1] if depth else (hashlib.sha256(), hashlib.sha256(), 0, 0)
                if kind == "leaf":
                    out.append((conv, depth, before[0].hexdigest(), before[2], before[1].hexdigest(), before[3]))
                    continue
                role, said = parse(text)
                turns, loss, n, chars = before[0].copy(), before[1], before[2], before[3]
                turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    masked = unescape(text[a:b])
                    loss = loss.copy()
                    loss.update(masked.encode("utf-8", "surrogatepass"))
                    n += len(masked)
                del path[depth:]
                path.append((turns, loss, n, chars + len(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate((batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = packed.schema["conv_id"].dataType.simpleString()
    if not ordered:
        packed = packed.repartition("pack").sortWithinPartitions("pack", "row")
    return packed.select("kind", "conv_id", "depth", "text", "loss_begin", "loss_end").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
