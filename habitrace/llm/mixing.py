"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed per (source, language, topic) cell. Raking finds one
factor per source, language and topic such that the reweighted token totals
meet all three target marginals; a cell's rate is the product of its factors,
and documents are drawn independently with a probability proportional to the
rate (the largest becomes ``top``), so the expected mixture has the target
weights. The draw is a hash of the document id: repeatable, no state, no
shuffle of texts.

The cell table is tiny next to the corpus but never leaves the executors; each
raking step is one small aggregation and join, settled by a checkpoint.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitrace.llm.store import settled

DIMS = ("source", "lang", "topic")
#: Rounds before the residual is looked at first, and at most.
ROUNDS = 6
MOST_ROUNDS = 200
#: The largest difference between a value's target and its share of the expected mixture.
TOLERANCE = 1e-5
#: A cell table up to this size (some MB) is broadcast.
BROADCAST_CELLS = 100_000
SALTS = 64
#: Targets are token shares to this power, normalised: 1 keeps the mixture, 0 makes it even.
SMOOTHING = 0.9


def token_count(text: Column) -> Column:
    """White-space separated words, one for an empty text so that every row has weight."""
    return F.greatest(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(1)).cast("long")


#: Characters that tell a text's register: digits, capitals, symbols of mark-up, tables and code.
_DIGITS, _CAPITALS, _SYMBOLS, _BREAK = "[0-9]", "[A-Z]", "[#$%&*+/<=>@^_`{|}~]", "\\n"


def topic_of(text: Column) -> Column:
    """The topic where the caller names none: a text's register by shares of its characters.

    Texts come without topics, so this stands in for a classifier's column:
    numbers (5 % digits), capitals (20 % A-Z), symbols (4 %), lines (shorter
    than 60 characters on average), else prose.
    """
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda chars: F.regexp_count(text, F.lit(chars))
    return (
        F.when(share(_DIGITS) * 20 > n, "numbers")
        .when(share(_CAPITALS) * 5 > n, "capitals")
        .when(share(_SYMBOLS) * 25 > n, "symbols")
        .when(share(_BREAK) * 60 > n, "lines")
        .otherwise("prose")
    )


def _target(cells: DataFrame, dim: str, smoothing: float) -> DataFrame:
    per = cells.groupBy(dim).agg(F.sum("n").alias("n")).select(dim, F.pow(F.col("n").cast("double"), F.lit(smoothing)).alias("w"))
    whole = per.agg(F.sum("w")).scalar()
    return per.select(dim, (F.col("w") / whole).alias(f"t_{dim}"))


def _given(weights: DataFrame, dim: str) -> DataFrame:
    """A caller's (dim, weight) as shares; weights need not add up to 1, a null value is '(none)'."""
    named = F.coalesce(F.col(dim).cast("string"), F.lit("(none)")).alias(dim)
    per = settled(weights.groupBy(named).agg(F.coalesce(F.sum(F.col("weight").cast("double")), F.lit(0.0)).alias("w")))
    whole, least = per.agg(F.sum("w"), F.min("w")).first()
    if whole is None or not 0 < whole < float("inf") or least < 0:
        raise ValueError(f"the weights of {dim} must be finite, not negative and not all zero")
    return per.select(dim, (F.col("w") / whole).alias(f"t_{dim}"))


def marginals(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(dim, value, target, reached) of cells with weights ``w``; values of either side."""

    def of(dim: str) -> DataFrame:
        whole = raked.agg(F.sum("w").alias("whole"))
        now = raked.groupBy(dim).agg(F.sum("w").alias("w")).crossJoin(whole).select(dim, F.try_divide("w", "whole").alias("reached"))
        both = now.join(targets[dim], dim, "full")
        return both.select(F.lit(dim).alias("dim"), F.col(dim).alias("value"), *(F.coalesce(c, F.lit(0.0)).alias(n) for c, n in ((f"t_{dim}", "target"), ("reached", "reached"))))

    return reduce(DataFrame.unionAll, map(of, DIMS))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE, strict: bool = True) -> DataFrame:
    """``cells`` (source, lang, topic, n) with ``rate``: raked weight over tokens.

    One step fits one dimension: each cell's weight is multiplied by target /
    current total of its value. ``targets[dim]`` holds (dim, t_dim); values
    that are missing there get weight zero. A step is one small aggregation
    and one join on the same key. After ``rounds`` rounds the largest residual
    of ``marginals`` is taken each round, until it is within ``tolerance``.
    Where it no longer falls the targets contradict each other, or values have
    no cell: an error if ``strict``, else a warning and the last fit.
    """
    if cells.isEmpty():
        return cells.select(*DIMS, "n", F.lit(None).cast("double").alias("rate"))
    aimed = reduce(lambda c, d: c.join(targets[d], d, "left"), DIMS, cells)
    work = settled(aimed.withColumn("w", F.col("n").cast("double")))
    before = float("inf")
    for k in range(1, max(rounds, MOST_ROUNDS) + 1):
        for dim in DIMS:
            totals = work.groupBy(dim).agg(F.sum("w").alias("now"))
            share = F.coalesce(F.try_divide(F.col(f"t_{dim}"), F.col("now")), F.lit(0.0))
            work = settled(work.join(totals, dim).withColumn("w", F.col("w") * share).drop("now"))
        if k < rounds:
            continue
        off = F.abs(F.col("target") - F.col("reached"))
        worst = marginals(work, targets).agg(F.max_by(F.struct("dim", "value", "target", "reached", off.alias("off")), off)).first()[0]
        if worst["off"] <= tolerance:
            break
        if worst["off"] > 0.999 * before or k >= MOST_ROUNDS:
            said = f"targets not met after {k} rounds: {worst['dim']} {worst['value']} has {worst['reached']:.6f} of the mixture, its target is {worst['target']:.6f}"
            if strict:
                raise ValueError(said)
            warnings.warn(said, stacklevel=2)
            break
        before = worst["off"]
    return work.select(*DIMS, "n", (F.col("w") / F.col("n")).alias("rate"))


def _looked_up(rows: DataFrame, odds: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``odds``, a cell table.

    A table of at most ``BROADCAST_CELLS`` cells (counted first) goes to all
    executors. A larger one is written ``SALTS`` times, and rows of a hot cell
    are dealt over the copies by a hash of the row (the same if a task is run again).
    """
    if odds.count() <= BROADCAST_CELLS:
        return rows.join(F.broadcast(odds), keys)
    salted = odds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*keys, "_salt"]).drop("_salt")


def uniform(id_col: Column) -> Column:
    """A repeatable number in [0, 1) per id: 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def _cell_of(docs: DataFrame, text_col: str, topic: Column | None) -> list[Column]:
    """source, lang and topic of a row; nulls are '(none)'."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(text) if topic is None else topic}
    return [F.coalesce(given[d].cast("string"), F.lit("(none)")).alias(d) for d in DIMS]


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, smoothing: float = SMOOTHING, rounds: int = ROUNDS, top: float = 1.0, targets: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, chosen) per row of ``docs``.

    ``probability`` is the cell's rate over the largest rate, times ``top``.
    ``targets`` may hold (dim, weight) for any of ``DIMS``; a dimension without
    takes the corpus's token shares ^ ``smoothing``. ``topic`` is a column of
    the caller's, over ``docs``; without one ``topic_of`` stands in.
    Null sources, languages and topics count as a value of their own
    ('(none)'); a null text is empty and weighs one token, a very long one
    counts whole. Rows that share an id share their fate where they share a
    cell. An empty table gives an empty plan. Other columns, whatever they are
    called, are left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = settled(docs.select(F.col(id_col).alias("doc_id"), *_cell_of(docs, text_col, topic), token_count(text).alias("n_tokens")))
    cells = settled(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("n")))
    if unknown := set(targets or ()) - set(DIMS):
        raise ValueError(f"no such dimension: {', '.join(sorted(unknown))}")
    aims = {d: settled(_given(targets[d], d) if targets and d in targets else _target(cells, d, smoothing)) for d in DIMS}
    rates = settled(rake(cells, aims, rounds, tolerance, strict=bool(targets)))
    peak = rates.agg(F.max("rate")).scalar()
    odds = settled(rates.select(*DIMS, (F.col("rate") / peak * top).alias("probability")))
    return _looked_up(rows, odds, list(DIMS)).select("doc_id", *DIMS, "n_tokens", "probability", (uniform(F.col("doc_id")) < F.col("probability")).alias("chosen"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, smoothing: float = SMOOTHING, rounds: int = ROUNDS, top: float = 1.0, targets: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs`` that ``plan`` draws with the same arguments, all columns kept.

    Nulls, repeats and long texts are as in ``plan``: every row is drawn or not
    by its own cell and id, so repeated rows stay or go together, and rows
    without an id share one draw in each cell. An empty table stays empty.
    """
    cols = docs.columns
    planned = plan(docs, id_col, text_col, topic, smoothing, rounds, top, targets, tolerance).groupBy(*DIMS).agg(F.max("probability").alias("_p"))
    odds = settled(planned.select(*(F.col(d).alias(f"_{d}") for d in DIMS), "_p"))
    cell = [c.alias(f"_{d}") for c, d in zip(_cell_of(docs, text_col, topic), DIMS)]
    keyed = docs.select(F.struct(*cols).alias("_row"), F.col(id_col).alias("_id"), *cell)
    return _looked_up(keyed, odds, [f"_{d}" for d in DIMS]).filter(uniform(F.col("_id")) < F.col("_p")).select("_row.*")


def oracle_sql(rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> str:
    """DuckDB SQL for ``plan`` with the same number of raking steps, unrolled."""
    n = "greatest(length(text), 1)"
    share = lambda chars: f"len(regexp_extract_all(text, '{chars}'))"
    topic = f"""case when {share(_DIGITS)} * 20 > {n} then 'numbers' when {share(_CAPITALS)} * 5 > {n} then 'capitals'
      when {share(_SYMBOLS)} * 25 > {n} then 'symbols' when {share(_BREAK)} * 60 > {n} then 'lines' else 'prose' end"""
    ctes = [
        "raw as (select doc_id, coalesce(text, '') as text, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang from documents)",
        f"r as (select doc_id, source, lang, {topic} as topic, cast(greatest(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 1) as bigint) as n_tokens from raw)",
        "cells as (select source, lang, topic, sum(n_tokens)::double as n from r group by all)",
    ]
    for d in DIMS:
        ctes += [f"w_{d} as (select {d}, pow(sum(n), {smoothing}) as w from cells group by all)", f"t_{d} as (select {d}, w / (select sum(w) from w_{d}) as t from w_{d})", f"f0_{d} as (select {d}, 1.0::double as f from t_{d})"]
    last = dict.fromkeys(DIMS, 0)
    for k in range(1, rounds + 1):
        for d in DIMS:
            a, b = (x for x in DIMS if x != d)
            ctes.append(
                f"f{k}_{d} as (select t.{d}, t.t / s.now as f from t_{d} t join (select c.{d}, sum(c.n * x.f * y.f) as now from cells c join f{last[a]}_{a} x on c.{a} = x.{a} join f{last[b]}_{b} y on c.{b} = y.{b} group by c.{d}) s on t.{d} = s.{d})"
            )
            last[d] = k
    ctes.append("p as (select c.source, c.lang, c.topic, x.f * y.f * z.f as rate from cells c " + " ".join(f"join f{last[d]}_{d} {v} on c.{d} = {v}.{d}" for d, v in zip(DIMS, "xyz")) + ")")
    return (
        "with "
        + ",\n".join(ctes)
        + """
select r.doc_id, r.source, r.lang, r.topic, r.n_tokens, round(p.rate / m.peak, 6) as probability,
       cast('0x' || substr(md5(cast(r.doc_id as varchar)), 1, 8) as bigint)::double / 4294967296.0 < p.rate / m.peak as chosen
from r join p on r.source = p.source and r.lang = p.lang and r.topic = p.topic cross join (select max(rate) as peak from p) m"""
    )
