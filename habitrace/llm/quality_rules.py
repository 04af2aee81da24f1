"""Quality classifier as a sparse rule ensemble, compiled into Column expressions.

Text statistics come from a byte histogram and the words of each text, batch
by batch. A bounded sample of labelled rows goes to the driver, boosted trees
are grown on it, every tree path is a rule (a conjunction of thresholds), an
L1-penalised logistic regression gives most rules weight zero, and the rules
that are left become one Column over the statistics. Nothing is shuffled.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitrace.llm.boosting import fit_boosted

#: Labelled rows that training takes at most, those with the least hash of the id.
SAMPLE_ROWS = 12_000

#: Frequent short words of the four languages of the corpus.
STOP_WORDS = "the of and to in that is for it with as was on be by are this from or an at de la le les et des en un une est que qui dans du pour par sur au avec el los las del se por con su para como der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch"


STATISTICS = ("log_chars", "chars_a_word", "upper", "digits", "symbols", "runs", "marks", "ends", "pipes", "stops", "spaces", "words_a_line", "new_lines", "new_words", "repeats")

_STOPS = frozenset(w.encode() for w in STOP_WORDS.split())


def _among(chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars.encode())] = True
    return found


_UPPER, _DIGIT = _among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _among("0123456789")
_SYMBOL = _among("#$%&*+/<=>@[]^_`{|}~" + chr(92))
_MARK, _END, _SPACE = _among("!?"), _among("."), _among(" " + chr(9) + chr(10) + chr(13))


def statistics_of(text: bytes) -> tuple[float, ...]:
    """The statistics of one UTF-8 text from one byte histogram and its words; zeros for an empty one."""
    if not text:
        return (0.0,) * len(STATISTICS)
    raw = np.frombuffer(text, np.uint8)
    seen = np.bincount(raw, minlength=256)
    chars = len(text) - int(seen[128:192].sum())
    lines = text.split(b"\n")
    words = text.lower().split()
    n = max(1, len(words))
    twice = int((_SYMBOL | _MARK)[raw[1:][raw[1:] == raw[:-1]]].sum())
    return (
        math.log1p(chars), chars / n, seen[_UPPER].sum() / chars, seen[_DIGIT].sum() / chars, seen[_SYMBOL].sum() / chars, twice / n, seen[_MARK].sum() / n, seen[_END].sum() / n,
        text.count(b" | ") / n, sum(map(_STOPS.__contains__, words)) / n, seen[_SPACE].sum() / chars, len(words) / len(lines), len(set(lines)) / len(lines), len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / n,
    )


def with_statistics(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(_row, statistics...): the kept columns as a struct, and a column per statistic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics_of(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
            stats = np.array(rows, float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in stats.T)], names=["_row", *STATISTICS])

    packed = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([packed.schema["_row"], *(T.StructField(n, T.DoubleType()) for n in STATISTICS)])
    return packed.mapInArrow(run, schema)


@dataclass
class RuleModel:
    """bias + sum of the weights of the rules that hold; rules name statistics."""

    bias: float
    rules: list[tuple[float, tuple[tuple[str, bool, float], ...]]]

    def score(self) -> Column:
        """Over columns named as the statistics."""
        margin = F.lit(self.bias)
        for weight, path in self.rules:
            holds = F.lit(True)
            for name, upper, cut in path:
                holds = holds & (F.col(name) > cut if upper else F.col(name) <= cut)
            margin = margin + F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-margin))


def _lasso_logistic(rules: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient on the mean log loss; the bias is free."""
    x = np.hstack([np.ones((len(rules), 1)), rules])
    step = 4 / np.linalg.eigvalsh(x.T @ x / len(x))[-1]
    w = z = np.zeros(x.shape[1])
    momentum = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ z, -30, 30)))
        new = z - step * (x.T @ (p - y) / len(y))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 30, depth: int = 3, penalty: float = 2e-4, steps: int = 1500) -> RuleModel:
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel(float(np.log(share / (1 - share))), [])
    model = fit_boosted(x, y, rounds=rounds, depth=depth)
    paths = sorted({tuple(sorted(p)) for t in model.trees for p in t.paths()})
    matrix = np.ones((len(x), len(paths)), np.float64)
    for i, path in enumerate(paths):
        for f, upper, cut in path:
            matrix[:, i] *= (x[:, f] > cut) if upper else (x[:, f] <= cut)
    _, first = np.unique(matrix, axis=1, return_index=True)
    keep = [i for i in sorted(first) if 0 < matrix[:, i].sum() < len(x)]
    bias, weights = _lasso_logistic(matrix[:, keep], y, penalty, steps)
    return RuleModel(bias, [(float(w), tuple((names[f], u, c) for f, u, c in paths[i])) for i, w in zip(keep, weights) if abs(w) > 1e-3])


def in_training(id_col: Column) -> Column:
    """Rows whose labels may be learnt from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """A model from ``labels`` (id, 0/1); null ids and labels are left out.

    At most ``sample_rows`` labelled ids are taken, by hash; without any the
    score is 0.5 everywhere. An id that has both labels is taken as 0; of rows
    of ``docs`` that repeat an id, the one with the least statistics is, so
    that no more than the sample reaches the driver. Other columns, whatever
    they are called, are left out.
    """
    wanted = labels.filter(F.col(label_col).isNotNull() & in_training(F.col(id_col)))
    labelled = wanted.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col).cast("double")).alias("_y"))
    sample = labelled.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    rows = with_statistics(joined, "_text", ["_id", "_y"]).groupBy("_row").agg(F.min(F.struct(*STATISTICS)).alias("_s")).select("_row._y", "_s.*").collect()
    data = np.array(rows, float).reshape(-1, len(STATISTICS) + 1)
    order = np.lexsort(data.T)
    return fit_rules(data[order, 1:], data[order, 0], list(STATISTICS))


def score_documents(docs: DataFrame, model: RuleModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5).

    A null text scores as an empty one; very long texts are read whole. Rows
    are scored by their text alone: repeated rows and rows without an id stay,
    an empty table stays empty. Columns of ``docs`` that are called
    ``score`` or ``predicted`` are replaced; other columns pass through.
    """
    own = [c for c in keep or docs.columns if c not in ("score", "predicted")]
    scored = with_statistics(docs, text_col, own).select("_row", model.score().alias("score"))
    return scored.select("_row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
