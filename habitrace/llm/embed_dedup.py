"""Near-duplicate embeddings by random-hyperplane sign hashing.

Equal vectors are merged first. Each different vector is put in one bucket of
each table by the signs of its products with random hyperplanes. Buckets are
cut into blocks; a pair of blocks is compared with one matrix product in double
precision, so no pair of a bucket is ever a row: a block pair emits, for each
vector, how many partners it has there and the least vector of its local
component. A pair that meets in several tables counts in the first only, which
both sides' bucket numbers tell without a shuffle. Components are joined by the
distributed algorithm.

Tables follow from the recall wanted at the threshold: a pair at cosine c
shares a bit with probability 1 - acos(c)/pi. Every bit more than halves the
buckets but takes more tables, and each table is one more copy of the vectors
to shuffle, while a product costs next to nothing. So buckets are large (1,024
vectors) and the tables few: 10 up to 65,536 vectors, 20 at 10^6, 102 at 10^9.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitrace.llm.components import connected_components
from habitrace.llm.store import settled

THRESHOLD = 0.9
RECALL = 0.99
BLOCK = 4096
#: A list of large buckets up to this length (some MB) is broadcast.
BROADCAST_ROWS = 100_000
#: Rows of a block that are multiplied at a time.
STRIP = 256


def bits_for(n: int, per_bucket: int = 1024) -> int:
    """Bits per table: buckets of about ``per_bucket`` vectors, 6 bits at least."""
    return max(6, math.ceil(math.log2(max(1, n) / per_bucket)))


def tables_for(bits: int, threshold: float, recall: float) -> int:
    same = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([7, dim]).standard_normal((dim, bits * tables))


def _hashed(distinct: DataFrame, bits: int, tables: int, kind: str) -> DataFrame:
    """(node, copies, vec, codes): bucket numbers of each vector in all tables.

    ``vec`` travels as ``kind``, single precision where the input is.
    """
    weights = 1 << np.arange(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = [np.array(v, np.float64) for v in batch.column(2).to_pylist()]
            codes = []
            for v in vectors:
                if len(v) not in planes:
                    planes[len(v)] = _planes(len(v), bits, tables)
                codes.append(((v @ planes[len(v)] > 0).reshape(tables, bits) @ weights).astype(np.int32))
            packed = [v.astype(kind).tobytes() for v in vectors]
            out = [batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([c.tolist() for c in codes], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(out, names=["node", "copies", "vec", "codes", "buckets"])

    return distinct.mapInArrow(run, "node long, copies long, vec binary, codes binary, buckets array<int>")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of equal leading ``keys`` columns from a sorted stream, group by group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        cols = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
        edges = [0, *(np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1), len(batch)]
        for a, b in zip(edges, edges[1:]):
            key = tuple(int(x) for x in cols[a])
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hooks the roots of linked members to the lesser root, until all links are within one."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def _compare(threshold: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (table, _, _, bi, bj), group in _groups(batches, 5):
            if len(group) < 2:
                continue
            group = group.sort_by("node")
            sides = group.column("block").to_numpy()
            nodes = group.column("node").to_numpy()
            copies = group.column("copies").to_numpy()
            raw = group.column("vec").to_pylist()
            vec = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
            codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), np.int32).reshape(len(raw), -1)
            unit = vec / np.sqrt((vec * vec).sum(axis=1))[:, None]
            left, right = np.flatnonzero(sides == bi), np.flatnonzero(sides == bj)
            if not len(left) or not len(right):
                continue
            facing = unit[right].T
            partners, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
            for at in range(0, len(left), STRIP):
                rows = left[at : at + STRIP]
                a, b = np.nonzero(unit[rows] @ facing >= threshold)
                a, b = rows[a], right[b]
                if bi == bj:
                    a, b = a[a < b], b[a < b]
                # a pair that met in an earlier table has been counted there
                for k in range(table):
                    new = codes[a, k] != codes[b, k]
                    a, b = a[new], b[new]
                if len(a):
                    partners += (np.bincount(a, copies[b], len(nodes)) + np.bincount(b, copies[a], len(nodes))).astype(np.int64)
                    _join(root, a, b)
            hit = np.flatnonzero(partners > 0)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(partners[hit]), pa.array(nodes[root[hit]])], names=["node", "partners", "hub"])

    return run


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Rows are linked at cosine >= ``threshold``; ``n_links`` counts the other
    rows linked directly, equal vectors among them. Vectors that are null,
    empty, zero or hold null or non-finite parts, and rows without an id, link
    with nothing (a null id has a null component and is not kept). Vectors of
    different length are never linked. Repeated ids are rows of their own; an
    empty table gives no rows; other columns, whatever they are called, are left out.
    """
    parts = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.col(vec_col).isNotNull() & ~F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(parts, lambda x: x != 0) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, parts).alias("v"))
    distinct = settled(rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    # vectors that differ may share an id: nodes are numbers of their own
    nodes = settled(distinct.select(F.col("v"), F.col("node").alias("least"), "copies", F.monotonically_increasing_id().alias("node")))
    n = nodes.count()
    bits = bits_for(n)
    tables = tables_for(bits, threshold, recall)
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"
    hashed = settled(_hashed(nodes.select("node", "copies", "v"), bits, tables, kind))
    spread = hashed.select("node", "copies", "vec", "codes", F.length("vec").alias("dim"), F.posexplode("buckets").alias("tab", "bucket"))
    # only the few buckets beyond one block are cut; their list is counted before it is broadcast, so that vectors move once
    large = settled(spread.groupBy("tab", "bucket", "dim").agg(F.count("*").alias("n")).filter(F.col("n") > block))
    sized = spread.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, ["tab", "bucket", "dim"], "left")
    blocks = sized.withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = paired.select("tab", "bucket", "dim", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "copies", "vec", "codes")
    keys = ["tab", "bucket", "dim", "bi", "bj"]
    grouped = keyed.repartition(*keys).sortWithinPartitions(*keys)
    found = settled(grouped.mapInArrow(_compare(threshold, kind), "node long, partners long, hub long"))
    degrees = found.groupBy("node").agg(F.sum("partners").alias("partners"))
    labels = connected_components(found.filter("node <> hub").select("node", "hub"), "node", "hub").withColumnRenamed("node", "member")
    classed = nodes.join(labels, nodes.node == labels.member, "left").select("v", "node", "least", "copies", F.coalesce("component", "node").alias("class"))
    least = classed.groupBy("class").agg(F.min("least").alias("component_id"))
    of_vector = classed.join(least, "class").join(degrees, "node", "left").select("v", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(of_vector, "v", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
