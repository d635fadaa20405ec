"""Mixing sources to target weights by iterative proportional fitting.

Documents' tokens are summed in cells of source, language and topic.  Raking
scales the cells' weights to one target marginal after the other until they
settle: all marginals hold, or as far as the caps let them, for a cell never
weighs more than its tokens.  A document is then sampled with its cell's
calibrated probability (weight by tokens), decided by a hash of its id.  Only
the cell table goes through the rounds; its size is the number of distinct
combinations, not of documents.

Everything is Spark column functions.  Rounds until the weights settle may be
hundreds, so a cell table of bounded size becomes one row of arrays, on which
one expression makes a burst of rounds; a larger one goes through them as
Spark tables by the same rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampart.llm.common import bounded_broadcast
from rampart.llm.minhash import let
from rampart.session import write_table

DIMS = ("source", "lang", "topic")
ROUNDS = 100_000    # rounds after which weights that still move are an error
SETTLED = 1e-9      # settled: no cell's rate moves by more than this in a round
LOCAL_CELLS = 200_000       # cells that go through the rounds as one row of arrays
BURST = 64                  # rounds of the first burst; each further one is twice as long
TEMPER = 0.7        # a value's target is its token share to this power
SHARE = 0.5         # tokens to sample, of all tokens


def word_count(text: Column) -> Column:
    """Words of a text: runs without ASCII white space; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.size(F.array_remove(parts, "")).cast("bigint")


def form(text: Column) -> Column:
    """A topic read off a text's form: table, notice, contact or prose."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(t.contains(" | "), "table").when(t.contains("icense") | t.contains("ights reserved"), "notice")
            .when(t.contains("@"), "contact").otherwise("prose"))


def tempered_targets(cells: DataFrame, dim: str, total: Column, temper: float) -> DataFrame:
    """(dim, t_<dim>): token share to the power ``temper``, scaled to sum to ``total``."""
    by = cells.groupBy(dim).agg(F.sum("tokens").alias("own"))
    raised = by.select(dim, F.pow(F.col("own").cast("double"), F.lit(temper)).alias("r"))
    whole = raised.agg(F.sum("r")).first()[0] or 1.0
    return raised.select(dim, (F.col("r") / F.lit(whole) * total).alias(f"t_{dim}"))


def spark_round(cells: DataFrame, dims: tuple) -> DataFrame:
    """Cells after one round, as a written table."""
    for dim in dims:
        sums = cells.groupBy(dim).agg(F.sum("m").alias("s"))
        scaled = F.when(F.col("s") > 0, F.col("m") * F.col(f"t_{dim}") / F.col("s")).otherwise(F.lit(0.0))
        cells = cells.join(sums, dim).withColumn(
            "m", F.least(F.col("tokens").cast("double"), scaled)).drop("s")
    return write_table(cells, "cells")


def cell_arrays(cells: DataFrame, dims: tuple) -> DataFrame:
    """All cells as one row: ``cell`` (dims, tokens and targets in the order of
    the dims), ``tokens`` and ``m`` by place; for each dim the value number of
    each place, each value's places and each value's target."""
    row = cells.withColumn("pos", F.row_number().over(Window.orderBy(*dims)))
    fields = [F.struct("pos", *dims, "tokens", *[f"t_{d}" for d in dims]).alias("cell"),
              F.struct("pos", F.col("tokens").cast("double").alias("v")).alias("tokens"), F.struct("pos", F.col("m").alias("v")).alias("m")]
    for d in dims:
        row = (row.withColumn(f"value_{d}", F.dense_rank().over(Window.orderBy(d)))
               .withColumn(f"order_{d}", F.row_number().over(Window.orderBy(d, "pos")))
               .withColumn(f"first_{d}", F.min(f"order_{d}").over(Window.partitionBy(d)))
               .withColumn(f"n_{d}", F.count(F.lit(1)).over(Window.partitionBy(d))))
        fields += [F.struct("pos", F.col(f"value_{d}").alias("v")).alias(f"value_{d}"),
                   F.struct(F.col(f"order_{d}").alias("pos"), F.col("pos").alias("v")).alias(f"order_{d}"),
                   F.struct(f"value_{d}", f"first_{d}", f"n_{d}", F.col(f"t_{d}").alias("t")).alias(f"span_{d}")]
    names = ["cell", "tokens", "m", *[f"{k}_{d}" for d in dims for k in ("value", "order")]]
    one = row.select(*fields).agg(*[F.array_sort(F.collect_list(n)).alias(n) for n in names],
                                  *[F.array_sort(F.collect_set(f"span_{d}")).alias(f"span_{d}") for d in dims])
    values = [F.transform(n, lambda x: x["v"]).alias(n) for n in names if n != "cell"]
    one = one.select("cell", *values, *[f"span_{d}" for d in dims])

    def places(d: str) -> Column:
        return F.transform(f"span_{d}", lambda s: F.slice(F.col(f"order_{d}"), s[f"first_{d}"], s[f"n_{d}"]))

    return one.select("cell", "tokens", "m", *[f"value_{d}" for d in dims], *[places(d).alias(f"places_{d}") for d in dims],
                      *[F.transform(f"span_{d}", lambda s: s["t"]).alias(f"goal_{d}") for d in dims])


def array_round(m: Column, dims: tuple) -> Column:
    """The weights ``m`` (by place) after one round."""
    def scaled(m: Column, d: str) -> Column:
        sums = F.transform(F.col(f"places_{d}"), lambda at: F.aggregate(at, F.lit(0.0), lambda acc, i: acc + F.get(m, i - 1)))

        def one(s: Column, i: Column) -> Column:
            v = F.get(F.col(f"value_{d}"), i) - 1
            whole = F.get(s, v)
            return F.least(F.get(F.col("tokens"), i), F.when(whole > 0, F.get(m, i) * F.get(F.col(f"goal_{d}"), v) / whole)
                           .otherwise(F.lit(0.0)))
        return let(sums, lambda s: F.transform(m, lambda _, i: one(s, i)))

    def chain(m: Column, left: tuple) -> Column:
        return let(scaled(m, left[0]), lambda x: chain(x, left[1:])) if left else m
    return chain(m, dims)


def settle_arrays(cells: DataFrame, dims: tuple) -> DataFrame:
    """Cells with settled weights; a burst of rounds, up to the one that
    settles them, is one expression over one row."""
    def step(acc: Column, _) -> Column:
        def moved(m: Column) -> Column:
            way = F.zip_with(F.zip_with(m, acc["m"], lambda x, y: F.abs(x - y)), "tokens", lambda x, t: x / F.greatest(t, F.lit(1.0)))
            return F.struct(m.alias("m"), F.array_max(way).alias("moved"))
        return F.when(acc["moved"] <= SETTLED, acc).otherwise(let(array_round(acc["m"], dims), moved))

    state = write_table(cell_arrays(cells, dims).withColumn("moved", F.lit(float("inf"))), "cell-arrays")
    fixed = [c for c in state.columns if c not in ("m", "moved")]
    done, burst = 0, BURST
    while done < ROUNDS:
        zero = F.struct(F.col("m").alias("m"), F.col("moved").alias("moved"))
        got = F.aggregate(F.sequence(F.lit(1), F.lit(burst)), zero, step)
        state = write_table(state.select(*fixed, got.alias("got")).select(*fixed, "got.m", "got.moved"), "cell-arrays")
        done, burst = done + burst, 2 * burst
        if state.select("moved").first()["moved"] <= SETTLED:
            rows = state.select(F.inline(F.zip_with("cell", "m", lambda c, m: F.struct(
                *[c[k].alias(k) for k in (*dims, "tokens", *[f"t_{d}" for d in dims])], m.alias("m")))))
            return write_table(rows, "cells")
    raise RuntimeError(f"weights still move after {done} rounds")


def settle_spark(cells: DataFrame, dims: tuple) -> DataFrame:
    """Cells with settled weights; each round is a Spark table."""
    for _ in range(ROUNDS):
        cells = spark_round(cells.withColumn("before", F.col("m")), dims)
        moved = F.abs(F.col("m") - F.col("before")) / F.greatest(F.col("tokens"), F.lit(1))
        most = cells.agg(F.max(moved)).first()[0]
        cells = cells.drop("before")
        if (most or 0.0) <= SETTLED:
            return cells
    raise RuntimeError(f"weights still move after {ROUNDS} rounds")


def rake(cells: DataFrame, targets: dict[str, DataFrame], share: float, rounds: int | None = None,
         local_cells: int = LOCAL_CELLS) -> DataFrame:
    """Cells with weight ``m``: tokens scaled to the target marginals in turn.

    ``targets[dim]`` has dim and t_<dim>; a value that a target lacks gets
    nothing.  A weight stops at its cell's tokens, so targets that the data
    cannot fill are filled as far as they go.  Rounds are repeated until no
    cell's rate (weight by tokens) moves by more than ``SETTLED``, or exactly
    ``rounds`` times if that is given.
    """
    dims = tuple(targets)
    for dim, t in targets.items():
        cells = cells.join(t, dim, "left").withColumn(f"t_{dim}", F.coalesce(f"t_{dim}", F.lit(0.0)))
    cells = write_table(cells.withColumn("m", F.col("tokens") * F.lit(share)), "cells")
    if rounds is None:
        return (settle_arrays if 0 < cells.count() <= local_cells else settle_spark)(cells, dims)
    for _ in range(rounds):
        cells = spark_round(cells, dims)
    return cells


def residual(dims: tuple) -> Column:
    """How far a cell's marginals are off their targets, as a share of the target, at most."""
    gaps = [F.abs(F.sum("m").over(Window.partitionBy(d)) - F.col(f"t_{d}")) / F.col(f"t_{d}") for d in dims]
    return reduce(lambda a, b: F.greatest(a, b), [F.when(F.col(f"t_{d}") > 0, g).otherwise(F.lit(0.0)) for d, g in zip(dims, gaps)])


def unit_hash(doc_id: Column) -> Column:
    """A number in [0, 1) from the id's text; a null id counts as empty text."""
    text = F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def mix(docs: DataFrame, topic: Column | None = None, dims: tuple = DIMS, targets: dict[str, DataFrame] | None = None,
        temper: float = TEMPER, share: float = SHARE, rounds: int | None = None, keep: tuple = ("doc_id",)) -> DataFrame:
    """Sampling probabilities and decisions of all documents.

    ``topic`` is an expression over ``docs`` (default: the form of the text);
    targets default to tempered token shares; ``rounds`` as in ``rake``.  Returns the columns of
    ``keep`` with the dims, n_tokens, rate (the cell's probability), residual
    (the largest relative gap between the cell's marginals and their targets,
    0 where all hold) and sampled.  Null sources, languages and topics are the category ''; a
    document without words weighs nothing and is sampled at its cell's rate,
    which is 0 in a cell without tokens.  Repeated rows are decided alike; an
    empty table gives an empty result.
    """
    derived = {"topic": topic if topic is not None else form(F.col("text"))}
    names = {d: f"_dim_{d}" for d in dims}
    rows = docs.select(*keep, *[F.coalesce(derived.get(d, F.col(d) if d in docs.columns else F.lit("")).cast("string"), F.lit(""))
                                .alias(names[d]) for d in dims],
                       F.col("doc_id").alias("_id"), word_count(F.col("text")).alias("_tokens"))
    sums = rows.groupBy(*names.values()).agg(F.sum("_tokens").alias("tokens"))
    cells = write_table(sums.select(*[F.col(names[d]).alias(d) for d in dims], "tokens"), "cells")
    if targets is None:
        total = cells.agg(F.sum("tokens")).first()[0] or 0
        targets = {d: tempered_targets(cells, d, F.lit(share * total), temper) for d in dims}
    weighed = rake(cells, targets, share, rounds)
    rates = write_table(weighed.select(*[F.col(d).alias(names[d]) for d in dims], F.when(
        F.col("tokens") > 0, F.col("m") / F.col("tokens")).otherwise(F.lit(0.0)).alias("rate"), residual(dims).alias("residual")), "rates")
    out = rows.join(bounded_broadcast(rates), list(names.values()))
    return out.select(*keep, *[F.col(names[d]).alias(d) for d in dims if d not in keep],
                      F.col("_tokens").alias("n_tokens"), "rate", "residual", (unit_hash(F.col("_id")) < F.col("rate")).alias("sampled"))
