"""Mixing to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are aggregated to cells (one per combination of the dimensions' values; a null is a value of its own)
with their tokens. The cells' weights start at their tokens and are scaled, dimension by dimension, to that
dimension's target shares, ROUNDS times over. A document of cell c is kept with probability min(1, s * weight / tokens),
where s is found (again in ROUNDS steps) such that the expected tokens are `share` of all, as far as cells that
are kept whole allow. Whether a document is kept depends on its id and the seed alone, so repeated ids
go together and a rerun gives the same sample.

Where targets name no value, a dimension's target is its own tokens to the power `flatten` (1: as found, 0: all values
alike). A value that a given target lacks has the target 0 (None is the null's name there); target values without documents are
left out and the rest is scaled up. What ROUNDS leave of the difference between weights and targets is returned as mix_residual, and what the bound of 1 on
probabilities costs as mix_shortfall: the largest difference, over all values, between the share that the sample is expected to have and the target.
An empty table gives an empty result. Texts that are null count one token, texts of any length one per four bytes; repeated rows count each; the
input's columns stay, also such as are named like the inner ones (d0, t, w, p, ...).

Cells are few next to documents. Up to FEW of them lie in one partition, where window sums need no exchange, and are
broadcast to the documents. Beyond, every sum is a partial aggregate joined back (a table of one row, or of a dimension's values, which is
broadcast up to FEW), so no task holds the cells of a hot value, and documents meet cells in an ordinary join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytemill.llm.shared import kept

ROUNDS, FEW = 10, 100_000


def tokens(text: Column) -> Column:
    """The estimate of tokens: one per four bytes, and one."""
    return (F.floor(F.coalesce(F.octet_length(text), F.lit(0)) / 4) + 1).cast("long")


def unit(id_col: str, seed: str) -> Column:
    """A number in [0, 1) from the seed and the id (a null id counts as empty)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _summed(df: DataFrame, few: bool, by: list[str], **sums: Column) -> DataFrame:
    """df with the sums of expressions over the rows that agree in the columns by (all rows if there are none)."""
    if few:
        over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        return df.withColumns({k: F.sum(c).over(over) for k, c in sums.items()})
    total = df.groupBy(*[F.col(c).alias(f"{c}_") for c in by]).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    if not by:
        return df.join(F.broadcast(total))  # one row
    total = kept(total)
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by])
    return df.join(F.broadcast(total) if total.count() <= FEW else total, on).drop(*[f"{c}_" for c in by])


def rake(df: DataFrame, dims: list[str], token_col: str, share: float, targets: dict[str, dict] | None = None, flatten: float = 0.5) -> DataFrame:
    """Cells: d0, d1, ... (values of dims), t (tokens), n (documents), all (tokens of all cells), w (raked weight; sums to all tokens), p (probability to keep), residual, shortfall."""
    names = [f"d{i}" for i in range(len(dims))]
    cells = kept(df.groupBy(*[F.col(c).alias(n) for c, n in zip(dims, names, strict=True)]).agg(F.sum(token_col).cast("double").alias("t"), F.count(F.lit(1)).alias("n")))
    few = cells.count() <= FEW
    again = (lambda x: x) if few else kept
    now = _summed((cells.coalesce(1) if few else cells).withColumn("w", F.col("t")), few, [], all=F.col("t"))
    for dim, name in zip(dims, names, strict=True):
        given, g = (targets or {}).get(dim), f"g_{name}"
        now = _summed(now, few, [name], value=F.col("t"), cells=F.lit(1.0))
        if given:
            of = {k: F.lit(float(v)) for k, v in given.items()}
            known = F.element_at(F.create_map(*[x for k, v in of.items() if k is not None for x in (F.lit(k), v)]), F.col(name)) if set(of) - {None} else F.lit(None)
            now = now.withColumn(g, F.when(F.col(name).isNull(), of.get(None, F.lit(0.0))).otherwise(F.coalesce(known, F.lit(0.0))))
        else:
            now = now.withColumn(g, F.pow("value", F.lit(flatten)))
        now = _summed(now, few, [], goals=F.col(g) / F.col("cells"))  # each value once
        now = again(now.withColumn(g, F.col(g) * F.col("all") / F.col("goals")).drop("value", "cells", "goals"))
    for _ in range(ROUNDS):
        for name in names:
            now = _summed(now, few, [name], s=F.col("w"))
            now = again(now.withColumn("w", F.when(F.col("s") > 0, F.col("w") * F.col(f"g_{name}") / F.col("s")).otherwise(0.0)).drop("s"))
    now = _summed(now, few, [], s=F.col("w")).withColumn("s", F.lit(share) * F.col("all") / F.col("s"))
    for _ in range(ROUNDS):
        whole = F.col("s") * F.col("w") >= F.col("t")
        now = _summed(now, few, [], rest=F.when(whole, 0.0).otherwise(F.col("w")), full=F.when(whole, F.col("t")).otherwise(0.0))
        left = F.lit(share) * F.col("all") - F.col("full")
        now = again(now.withColumn("s", F.when((F.col("rest") > 0) & (left > 0), F.greatest(F.col("s"), left / F.col("rest"))).otherwise(F.col("s"))).drop("rest", "full"))
    now = now.withColumn("p", F.least(F.lit(1.0), F.col("s") * F.col("w") / F.col("t"))).withColumn("kept", F.col("p") * F.col("t"))
    now = _summed(now, few, [], sample=F.col("kept"))
    gaps = []
    for name in names:
        now = _summed(now, few, [name], **{f"w_{name}": F.col("w"), f"k_{name}": F.col("kept")})
        goal = F.col(f"g_{name}") / F.col("all")
        gaps.append((F.abs(F.col(f"w_{name}") / F.col("all") - goal), F.abs(F.col(f"k_{name}") / F.col("sample") - goal)))
    most = [F.greatest(*c) if len(c) > 1 else c[0] for c in zip(*gaps, strict=True)] or [F.lit(0.0)] * 2
    ends = now.agg(F.max(most[0]).alias("residual"), F.max(most[1]).alias("shortfall"))
    out = now.select(*names, "t", "n", "w", "all", "p").join(F.broadcast(ends))
    return F.broadcast(out) if few else out


def mix(df: DataFrame, dims: list[str], token_col: str, share: float, targets: dict[str, dict] | None = None, flatten: float = 0.5, id_col: str = "doc_id", seed: str = "mix") -> DataFrame:
    """df with mix_weight (its cell's tokens after raking), mix_total (all tokens), mix_p, mix_kept, mix_residual and mix_shortfall."""
    cells = rake(df, dims, token_col, share, targets, flatten)
    marked = df.select(*[F.col(c).alias(f"x{i}") for i, c in enumerate(df.columns)], *[F.col(c).alias(f"y{i}") for i, c in enumerate(dims)], unit(id_col, seed).alias("u"))
    on = reduce(lambda a, b: a & b, [F.col(f"y{i}").eqNullSafe(F.col(f"d{i}")) for i in range(len(dims))])
    joined = marked.join(cells, on)
    return joined.select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(df.columns)], F.col("w").alias("mix_weight"), F.col("all").alias("mix_total"), F.col("p").alias("mix_p"), (F.col("u") < F.col("p")).alias("mix_kept"), F.col("residual").alias("mix_residual"), F.col("shortfall").alias("mix_shortfall"))


def sql(dims: dict[str, str], token: str, share: float, flatten: float = 0.5, seed: str = "mix") -> str:
    """DuckDB SQL for mix over documents; dims: name to expression."""
    names, steps = list(dims), []
    goals = ", ".join(f"pow(sum(t) OVER (PARTITION BY {d}), {flatten}) AS g_{d}, row_number() OVER (PARTITION BY {d} ORDER BY {', '.join(names)}) AS k_{d}" for d in names)
    steps.append(f"docs AS (SELECT *, {', '.join(f'{e} AS {d}_' for d, e in dims.items())}, {token} AS tokens FROM documents)")
    steps.append(f"cells AS (SELECT {', '.join(f'{d}_ AS {d}' for d in names)}, sum(tokens)::DOUBLE AS t FROM docs GROUP BY ALL)")
    steps.append(f"g0 AS (SELECT *, t AS w, sum(t) OVER () AS total, {goals} FROM cells)")
    scaled = ", ".join(f"g_{d} * total / sum(CASE WHEN k_{d} = 1 THEN g_{d} ELSE 0 END) OVER () AS g_{d}" for d in names)
    steps.append(f"r0 AS MATERIALIZED (SELECT {', '.join(names)}, t, w, total, {scaled} FROM g0)")
    k = 0
    for _ in range(ROUNDS):
        for d in names:
            steps.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * g_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w) FROM r{k})")
            k += 1
    steps.append(f"s0 AS MATERIALIZED (SELECT *, {share} * total / sum(w) OVER () AS s FROM r{k})")
    for i in range(ROUNDS):
        rest, left = "sum(CASE WHEN s * w >= t THEN 0 ELSE w END) OVER ()", f"({share} * total - sum(CASE WHEN s * w >= t THEN t ELSE 0 END) OVER ())"
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {rest} > 0 AND {left} > 0 THEN greatest(s, {left} / {rest}) ELSE s END AS s) FROM s{i})")
    on = " AND ".join(f"docs.{d}_ IS NOT DISTINCT FROM c.{d}" for d in names)
    u = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0"
    return (
        f"WITH {', '.join(steps)} SELECT doc_id, {', '.join(f'docs.{d}_ AS {d}' for d in names)}, tokens AS n_tokens, round(c.w / c.total, 9) AS weight, "
        f"round(least(1.0, c.s * c.w / c.t), 9) AS p, {u} < least(1.0, c.s * c.w / c.t) AS kept FROM docs JOIN s{ROUNDS} c ON {on}"
    )
