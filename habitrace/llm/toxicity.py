"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its lower-cased words and the beginnings of those (3 to
6 characters, as insults are inflected), hashed to 30 bits; the value of a term
is its share of the words, 1 from a hundredth on. Terms that go with the label
in a bounded sample of labelled rows become features, and so do terms that go
with it only among the texts that hold one of those (a group mention beside an
insult). The machine has a weight and a short vector for each feature; products
of vectors score pairs of terms, which a sum of weights cannot. Spark counts
the terms and scores the corpus; only the sample's features, a few numbers a
row, reach the driver.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitrace.llm.store import written

#: Labelled rows that training takes at most, those with the least hash of the id.
SAMPLE_ROWS = 12_000
#: Features at most, half of them by their own association, the others by that beside one of the first.
FEATURES = 256
#: Least association (twice the log likelihood ratio) of a feature with the label.
LEAST_ASSOCIATION = 20.0

#: Share of the words from which on a term has the value 1.
FULL_SHARE = 0.01
BEGINNINGS = range(3, 7)
#: Words whose features a worker remembers.
REMEMBERED = 200_000

_WORD = re.compile(r"\w+")


def _hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term) >> 34


def terms_of_word(word: str) -> list[int]:
    """A word (lower case) and its beginnings, hashed."""
    return [_hash(word), *(_hash(word[:k] + "*") for k in BEGINNINGS if k < len(word))]


def values_of(text: str, places: Callable[[str], Iterable[int]]) -> dict[int, float]:
    """The value of each term of a text; ``places`` gives those of a word."""
    words = _WORD.findall(text.lower())
    counts: dict[int, int] = {}
    for word, n in Counter(words).items():
        for term in places(word):
            counts[term] = counts.get(term, 0) + n
    return {t: min(1.0, n / len(words) / FULL_SHARE) for t, n in sorted(counts.items())}


@dataclass
class ToxicModel:
    """bias + sum of weights + sum over pairs of the products of their vectors."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def places(self) -> Callable[[str], Iterable[int]]:
        """Gives the features of a word, and remembers them for the words seen of late."""
        known = {int(t): i for i, t in enumerate(self.terms)}
        return lru_cache(maxsize=REMEMBERED)(lambda word: tuple(known[t] for t in terms_of_word(word) if t in known))

    def score(self, values: dict[int, float]) -> float:
        """Of a text with these values of features."""
        if not values:
            return float(1 / (1 + np.exp(-self.bias)))
        at, x = list(values), np.array(list(values.values()))
        v = self.vectors[at] * x[:, None]
        margin = self.bias + self.weights[at] @ x + 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def fit_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int = 6, steps: int = 400, rate: float = 0.05, ridge: float = 1e-4, pair_ridge: float = 2e-2, seed: int = 13) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, vectors) of the weighted log loss by Adam steps over all rows; the bias isn't shrunk."""
    n, features = x.shape
    squares = x**2
    share = weight / weight.sum()
    base = float((share * y).sum() * n + 0.5) / (n + 1)
    bias, w = np.array([np.log(base / (1 - base))]), np.zeros(features)
    v = np.random.default_rng(seed).normal(0, 0.05, (features, width))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (bias, w, v)]
    for step in range(1, steps + 1):
        s = x @ v
        margin = bias + x @ w + 0.5 * (s**2 - squares @ v**2).sum(axis=1)
        lost = share * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        grads = (lost.sum(keepdims=True), x.T @ lost + ridge * w, x.T @ (lost[:, None] * s) - v * (squares.T @ lost)[:, None] + pair_ridge * v)
        for p, g, (m1, m2) in zip((bias, w, v), grads, moments):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g**2 - m2)
            p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return float(bias[0]), w, v


def in_training(id_col: Column) -> Column:
    """Rows whose labels may be learnt from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 != 2


_VALUES = "array<struct<t:bigint,x:double>>"


def _mark(text: str) -> int:
    """One number for the near copies of a text: a hash of the least of its words in three orders."""
    words = {xxhash.xxh3_64_intdigest(w) for w in set(_WORD.findall(text.lower()))}
    return hash(tuple(min((h * odd & (1 << 64) - 1 for h in words), default=0) for odd in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)))


def _sampled_terms(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, y, terms, w): near copies count as one document together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # terms and values of all texts in two flat arrays, a text after the other
            marks, ends, terms, values = array("q"), array("i", [0]), array("q"), array("d")
            for t in batch.column(2):
                text = t.as_py() or ""
                found = values_of(text, terms_of_word)
                marks.append(_mark(text))
                terms.extend(found)
                values.extend(found.values())
                ends.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.frombuffer(values, np.float64))], names=["t", "x"])
            listed = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.frombuffer(marks, np.int64)), listed], names=["id", "y", "mark", "terms"])

    joined = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    each = joined.select("id", "y", "text").mapInArrow(run, f"id string, y double, mark long, terms {_VALUES}").groupBy("id", "y").agg(F.min(F.struct("mark", "terms")).alias("d"))
    each = written(each.select("id", "y", "d.mark", "d.terms"), "terms")
    sizes = each.groupBy("mark").agg(F.count("*").alias("n"))
    return each.join(F.broadcast(sizes), "mark").select("id", "y", "terms", (1.0 / F.col("n")).alias("w"))


def _associated(rows: DataFrame, most: int, least: float) -> list[int]:
    """The terms that go with label 1 most: twice the log likelihood ratio of the 2 x 2 table of weighted values, from 2 documents on."""
    total, toxic = rows.agg(F.sum("w"), F.sum(F.col("w") * F.col("y"))).first()
    if not total or not 0 < toxic < total:
        return []
    each = rows.select(F.explode("terms").alias("v"), "w", "y").select("v.t", (F.col("w") * F.col("v.x")).alias("wx"), "y")
    # sums of whole millionths don't depend on the order in which they are added
    whole = lambda c: F.sum(F.round(c * 1e6).cast("long")) / 1e6
    counts = each.groupBy(F.col("t").alias("term")).agg(whole(F.col("wx")).alias("n"), whole(F.col("wx") * F.col("y")).alias("t"))
    n, t = F.col("n"), F.col("t")
    part = lambda seen, rate: F.when(seen > 1e-9, seen * F.log(seen / rate)).otherwise(0.0)
    base = toxic / total
    ratio = 2 * (
        part(t, n * base) + part(n - t, n * (1 - base)) + part(F.lit(toxic) - t, (F.lit(total) - n) * base) + part(F.lit(total - toxic) - (n - t), (F.lit(total) - n) * (1 - base))
    )
    # a word and its beginnings in the same texts are one term
    apart = counts.filter((n >= 2) & (t > n * base)).groupBy("n", "t").agg(F.min("term").alias("term"))
    kept = apart.select("term", F.round(ratio, 6).alias("g")).filter(F.col("g") >= least)
    return [r.term for r in kept.orderBy(F.desc("g"), "term").limit(most).collect()]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, least: float = LEAST_ASSOCIATION) -> ToxicModel:
    """A model from ``labels`` (id, 0/1); null ids and labels are left out.

    At most ``sample_rows`` labelled ids are taken, by hash; without any, or
    with one label only, every text gets the share of label 1. An id with both
    labels is taken as 1; of rows of ``docs`` that repeat an id, the one with
    the least terms is. Near copies weigh as one document together. Other
    columns, whatever they are called, are left out.
    """
    wanted = labels.filter(F.col(label_col).isNotNull() & in_training(F.col(id_col)))
    labelled = wanted.groupBy(F.col(id_col).cast("string").alias("id")).agg(F.max(F.col(label_col).cast("double")).alias("y"))
    sample = labelled.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = _sampled_terms(docs, sample, id_col, text_col)
    alone = _associated(rows, features // 2, least)
    beside = _associated(rows.filter(F.exists("terms", lambda v: v["t"].isin(alone))), features // 2, least) if alone else []
    terms = np.array(sorted({*alone, *beside}), np.int64)
    held = F.filter("terms", lambda v: v["t"].isin(terms.tolist())) if len(terms) else F.array().cast(_VALUES)
    # ids are sorted so that sums don't depend on the order of arrival
    picked = rows.select("id", "y", "w", F.transform(held, lambda v: v["t"]).alias("at"), F.transform(held, lambda v: v["x"]).alias("x")).toArrow().sort_by("id")
    if not len(picked):
        return ToxicModel(0.0, terms, np.zeros(0), np.zeros((0, 1)))
    flat = lambda c: picked[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    x = np.zeros((len(picked), len(terms)))
    row = np.repeat(np.arange(len(picked)), pc.list_value_length(picked["at"]).to_numpy())
    x[row, np.searchsorted(terms, flat("at"))] = flat("x")
    y, weight = (picked[c].to_numpy() for c in ("y", "w"))
    bias, w, v = fit_machine(x, y, weight, steps=400 if len(terms) else 0)
    return ToxicModel(bias, terms, w, v)


def score_documents(docs: DataFrame, model: ToxicModel, text_col: str = "text", keep: list[str] | None = None, cut: float = 0.3) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` (0 to 1) and ``predicted`` (1 if score >= ``cut``).

    A null text scores as an empty one; very long texts are read whole. Rows
    are scored by their text alone: repeated rows and rows without an id stay,
    an empty table stays empty. Columns of ``docs`` that are called
    ``score`` or ``predicted`` are replaced; other columns pass through.
    """
    own = [c for c in keep or docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = model.places()
        for batch in batches:
            scores = [model.score(values_of(text.as_py() or "", places)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["_row", "score"])

    packed = docs.select(F.struct(*own).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    scored = packed.mapInArrow(run, packed.select("_row").schema.add("score", "double"))
    return scored.select("_row.*", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
