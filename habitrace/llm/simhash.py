"""SimHash near-duplicates found through a grid over per-segment bit counts.

A 64-bit fingerprint is cut into 16 segments of 4 bits; the vector of segment
popcounts is its place on an integer grid. Flipping one bit moves a fingerprint
by one step on that grid, so the Manhattan distance of two places never exceeds
the Hamming distance of their fingerprints. Fingerprints within 2 bits
therefore have a grid cell within one step of both ("meeting in the middle"):
each fingerprint is written to its own cell and to the cells around it, and an
equi-join on the cell is the range join. What is alone in a cell is done.

What shares a cell is verified exactly on the 64 bits. Two fingerprints are
within 2 bits exactly if there is a third one within 1 bit of both, and that
one lies in the cell they share. So each fingerprint offers, for each shared
cell, itself (its own cell) or its neighbours by one bit of the segment in
which the cell is a step away, four at most; all that offer the same 64 bits
are hooked to the least of them. A cell costs a few rows a fingerprint however
many it holds, and no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitrace.llm.components import connected_components
from habitrace.llm.store import settled

SEED = 42
SHINGLE = 3
SEGMENTS = 16


def fingerprint_of(text: bytes) -> int:
    """Unsigned fingerprint of one UTF-8 text; without words it is zero."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < SHINGLE:
        hashes = digest(b" ".join(words), SEED)
    else:
        hashes = b"".join([digest(b" ".join(x), SEED) for x in zip(words, words[1:], words[2:])])
    raw = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 15):
        ones += np.unpackbits(raw[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            values = np.fromiter((fingerprint_of(t.as_py() or b"") for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def _cells() -> F.Column:
    """The own cell (seg -1) and those one step away in segment ``seg``; 3 bits of the key per segment."""
    width = 64 // SEGMENTS
    counts = [f"bit_count(shiftrightunsigned(fp, {s * width}) & {2**width - 1})" for s in range(SEGMENTS)]
    own = " + ".join(f"shiftleft(cast({c} as bigint), {3 * s})" for s, c in enumerate(counts))
    at = lambda cell, s, up: f"named_struct('cell', {cell}, 'seg', {s}, 'up', {up})"
    steps = [at("own", -1, "false")]
    for s, c in enumerate(counts):
        steps += [f"if({c} < {width}, {at(f'own + {8**s}L', s, 'true')}, null)", f"if({c} > 0, {at(f'own - {8**s}L', s, 'false')}, null)"]
    return F.expr(own), F.expr(f"array_compact(array({', '.join(steps)}))")


def _links(points: DataFrame, bits: int) -> DataFrame:
    """(a, b) representatives whose components the fingerprints' links join."""
    own, around = _cells()
    cells = points.withColumn("own", own).select("rep", "fp", F.explode(around).alias("c")).select("rep", "fp", "c.*")
    shared = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell")
    met = cells.join(shared, "cell")
    width = 64 // SEGMENTS
    flips = [f"if(((fp & shiftleft(1L, seg * {width} + {k})) = 0L) = up, fp ^ shiftleft(1L, seg * {width} + {k}), null)" for k in range(width)]
    offers = F.expr(f"if(seg < 0, array(fp), array_compact(array({', '.join(flips)})))")
    balls = met.select("rep", "fp", F.explode(offers).alias("point"))
    if bits == 2:
        hubs = balls.groupBy("point").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("point", "hub")
    else:
        # within 1 bit the fingerprint in the middle is one of the two; within none it is both
        hubs = points.filter(F.lit(bits == 1)).select(F.col("fp").alias("point"), F.col("rep").alias("hub"))
    return balls.join(hubs, "point").filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Documents whose fingerprints differ in at most ``bits`` (2 at most: the
    grid meets half-way) bits are linked. Null or blank texts have fingerprint
    zero and are linked like any other; repeated rows stay and share a
    component. A row without an id keeps its fingerprint, links with nothing
    and has a null component. Extra columns are ignored.
    """
    if not 0 <= bits <= 2:
        raise ValueError("bits must be 0, 1 or 2")
    prints = settled(fingerprints(docs, id_col, text_col))
    points = settled(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    labels = connected_components(_links(points, bits), "a", "b")
    of_print = points.join(labels, points.rep == labels.node, "left").select("fp", F.coalesce("component", "rep").alias("class_id"))
    joined = prints.join(of_print, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays: the one with the least id.

    Rows that repeat an id (same text or not) count as copies of one document:
    one of them stays, the first by text. Rows without an id all stay; an empty
    table stays empty; all columns of ``docs`` pass through. Only ids are
    counted and sorted; a row's text moves once, to meet the ids that stay.
    """
    found = simhash_components(docs, id_col, text_col).filter("component_id = doc_id")
    ids = settled(found.groupBy(F.col("doc_id").alias("_keep")).agg(F.count("*").alias("_n")))

    def keep(which: str) -> DataFrame:
        some = ids.filter(which).select("_keep")
        return docs.join(some, docs[id_col] == some["_keep"], "left_semi")

    kept, repeated = keep("_n = 1"), "_n > 1"
    if not ids.filter(repeated).isEmpty():
        row = F.min_by(F.struct(*docs.columns), F.struct(F.col(text_col)))
        # settled first: an aggregation over a union of joins would trust the joins' partitioning
        kept = kept.unionByName(settled(keep(repeated)).groupBy(F.col(id_col).alias("_id")).agg(row.alias("_row")).select("_row.*"))
    return kept.unionByName(docs.filter(docs[id_col].isNull()))
