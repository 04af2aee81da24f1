"""Token-id shards with Elias-Fano document boundaries.

File format (a Parquet table written by Spark, so commits are atomic and any
file system will do). One row is one chunk of consecutive documents in
ascending ``doc_id`` order:

``part, seq``   place of the chunk; documents are ordered by (part, seq)
``n_docs, n_ids, null_docs``   counts; documents without an id come first
``ids``   all token ids of the chunk, one little-endian array of ``id_bytes``
``first``   the least doc_id; the code below holds doc_id - first
``doc_low, doc_high, doc_rank``   Elias-Fano code of the document ids
``end_low, end_high, end_rank``   Elias-Fano code of the documents' end offsets

Elias-Fano keeps the low ``l`` bits of each value in a packed array and the
high bits as a unary bit vector: ``l`` = floor(log2(universe / n)), in all about
``n * (2 + l)`` bits. ``rank`` is the select structure: how many one bits stand
before each block of 512 high bits, one 32-bit number a block. ``select`` finds
a value's block there by bisection and looks at that block alone, so neither
writer nor reader has a table of 64-bit offsets. A chunk closes at
``chunk_ids`` ids (or with the document that passes it), which bounds the
memory of both.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from habitrace.llm.store import new_path

CHUNK_IDS = 1 << 20
#: Bytes of high bits that one number of the select structure stands for.
RANK_BYTES = 64

CHUNK_SCHEMA = "part int, seq int, n_docs long, null_docs long, n_ids long, id_bytes int, ids binary, first long, doc_low binary, doc_high binary, doc_rank binary, end_low binary, end_high binary, end_rank binary"


class EliasFano:
    """A non-decreasing sequence of integers, read through its select structure."""

    def __init__(self, low: bytes, high: bytes, rank: bytes, n: int):
        self.width = low[0] if low else 0
        self.low, self.high, self.rank, self.n = np.frombuffer(low, np.uint8)[1:], np.frombuffer(high, np.uint8), np.frombuffer(rank, "<u4"), n

    @staticmethod
    def encoded(values: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """(low bits, high bits, select structure) of a non-decreasing array."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return b"", b"", b""
        width = max(0, (int(values[-1]) // n).bit_length() - 1)
        high = np.zeros(n + (int(values[-1]) >> width), np.uint8)
        high[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(high, bitorder="little")
        counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
        return bytes([width]) + np.packbits(bits.ravel(), bitorder="little").tobytes(), packed.tobytes(), counts[:-1:RANK_BYTES].astype("<u4").tobytes()

    def _lows(self, i: int, j: int) -> np.ndarray:
        """Low parts of values i to j - 1."""
        at = i * self.width
        bits = np.unpackbits(self.low[at // 8 : (j * self.width + 7) // 8], bitorder="little")[at % 8 :]
        return bits[: (j - i) * self.width].reshape(j - i, self.width).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))

    def select(self, i: int, j: int | None = None) -> np.ndarray:
        """Values i to j - 1 (value i alone without j), from the blocks that hold them."""
        j = i + 1 if j is None else j
        if i >= j:
            return np.zeros(0, np.int64)
        a, b = (int(np.searchsorted(self.rank, k, "right")) - 1 for k in (i, j - 1))
        ones = np.flatnonzero(np.unpackbits(self.high[a * RANK_BYTES : (b + 1) * RANK_BYTES], bitorder="little"))
        at = i - int(self.rank[a])
        places = ones[at : at + j - i] + a * RANK_BYTES * 8
        return ((places - np.arange(i, j)) << self.width) + self._lows(i, j)

    def first_at_least(self, value: int) -> int:
        """How many values are less than ``value``: bisection by select."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            if int(self.select(mid)[0]) < value:
                low = mid + 1
            else:
                high = mid
        return low


def _chunk(part: int, seq: int, doc_ids: list, ends: list[int], ids: list[bytes], id_bytes: int) -> dict:
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    doc, end = EliasFano.encoded((known - first).view(np.uint64)), EliasFano.encoded(np.array(ends))
    return {
        "part": part, "seq": seq, "n_docs": len(doc_ids), "null_docs": len(doc_ids) - len(known), "n_ids": ends[-1], "id_bytes": id_bytes, "ids": b"".join(ids),
        "first": first, **dict(zip(("doc_low", "doc_high", "doc_rank"), doc)), **dict(zip(("end_low", "end_high", "end_rank"), end)),
    }


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in CHUNK_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kinds[kind]) for name, kind in fields], names=[f[0] for f in fields])


def write_shards(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[bytes]]], end_id: int, id_bytes: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk_ids: int = CHUNK_IDS, parts: int | None = None) -> str:
    """Writes ``docs`` in ascending id order and returns the path.

    ``encoder()`` is called in the worker; what it returns maps texts to the
    little-endian bytes of their ids. Texts are dealt to ``parts`` ranges of ids
    (as many as the session's shuffle partitions) and encoded once, in order.
    Ids take about as many bytes as the compressed text, so shuffling them
    instead would save nothing and cost a table of its own.

    A null text is empty (its only id is ``end_id``), a very long one is one
    document of one chunk. Rows that share an id are ordered by a hash of the
    text; rows without one come first. An empty table writes no chunk. Columns
    beside the two, whatever they are called, are left out.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    end = end_id.to_bytes(id_bytes, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, seq = TaskContext.get().partitionId(), encoder(), 0
        doc_ids: list = []
        ends: list[int] = []
        ids: list[bytes] = []
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                for doc, coded in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                    doc_ids.append(doc)
                    ids += (coded, end)
                    ends.append((ends[-1] if ends else 0) + len(coded) // id_bytes + 1)
                    if ends[-1] >= chunk_ids:
                        yield _arrow([_chunk(part, seq, doc_ids, ends, ids, id_bytes)])
                        doc_ids, ends, ids, seq = [], [], [], seq + 1
        if ends:
            yield _arrow([_chunk(part, seq, doc_ids, ends, ids, id_bytes)])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # ties are dealt by a hash of the text: the sampling of ranges never sees texts, and rows of one id needn't share a part
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = source.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    ordered = dealt.sortWithinPartitions(*order, "text")
    ordered.mapInArrow(run, CHUNK_SCHEMA).write.option("compression", "zstd").parquet(path)
    return path


def _bases(chunks: DataFrame) -> DataFrame:
    """(part, seq, base): how many ids stand before each chunk.

    A running sum over parts (one row each) and one over the chunks of a part.
    """
    sizes = chunks.select("part", "seq", "n_ids")
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before("n", Window.orderBy("part")).alias("_part_base"))
    inner = sizes.select("part", "seq", before("n_ids", Window.partitionBy("part").orderBy("seq")).alias("_base"))
    return inner.join(parts, "part").select("part", "seq", (F.col("_part_base") + F.col("_base")).alias("base"))


def read_shards(spark: SparkSession, path: str, digest: bool = False, run_docs: int = 1024) -> DataFrame:
    """(doc_id, start, n_tokens, ids): documents as the files hold them.

    ``start`` counts the ids of all documents before: the base of the chunk
    plus the Elias-Fano boundary, selected for ``run_docs`` documents at a
    time. ``ids`` is little-endian, of the file's width; with ``digest`` the
    column is ``ids_crc32`` instead, the CRC-32 of the ids as little-endian
    32-bit integers.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    last = ("ids_crc32", "long", pa.int64()) if digest else ("ids", "binary", pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                n, nulls, width, held = row["n_docs"], row["null_docs"], row["id_bytes"], memoryview(row["ids"])
                docs = EliasFano(row["doc_low"], row["doc_high"], row["doc_rank"], n - nulls)
                bounds = EliasFano(row["end_low"], row["end_high"], row["end_rank"], n)
                for i in range(0, n, run_docs):
                    j = min(n, i + run_docs)
                    ends = bounds.select(i, j)
                    starts = np.concatenate([bounds.select(i - 1) if i else [0], ends[:-1]]).astype(np.int64)
                    ids = [held[a * width : b * width] for a, b in zip(starts.tolist(), ends.tolist())]
                    if digest:
                        ids = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4")) for x in ids]
                    known = docs.select(max(0, i - nulls), max(0, j - nulls)) + row["first"]
                    out = {
                        "part": pa.array([row["part"]] * (j - i), pa.int32()),
                        "seq": pa.array([row["seq"]] * (j - i), pa.int32()),
                        "doc_id": pa.array([None] * (j - i - len(known)) + known.tolist(), pa.int64()),
                        "at": pa.array(starts, pa.int64()),
                        "n_tokens": pa.array(ends - starts, pa.int64()),
                        last[0]: pa.array(ids if digest else list(map(bytes, ids)), last[2]),
                    }
                    yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    held = ["part", "seq", "n_docs", "null_docs", "id_bytes", "ids", "first", "doc_low", "doc_high", "doc_rank", "end_low", "end_high", "end_rank"]
    docs = chunks.select(*held).mapInArrow(run, f"part int, seq int, doc_id long, at long, n_tokens long, {last[0]} {last[1]}")
    return docs.join(_bases(chunks), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", last[0])


def fetch(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """(doc_id, ids) of one document, by select: chunks that can't hold it are pruned by their first id, the rest bisected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                n, nulls, width = row["n_docs"], row["null_docs"], row["id_bytes"]
                docs = EliasFano(row["doc_low"], row["doc_high"], row["doc_rank"], n - nulls)
                bounds = EliasFano(row["end_low"], row["end_high"], row["end_rank"], n)
                k = docs.first_at_least(doc_id - row["first"])
                while k < docs.n and int(docs.select(k)[0]) == doc_id - row["first"]:
                    a, b = (int(bounds.select(i)[0]) if i >= 0 else 0 for i in (k + nulls - 1, k + nulls))
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([row["ids"][a * width : b * width]], pa.binary())], names=["doc_id", "ids"])
                    k += 1

    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path).filter((F.col("first") <= doc_id) & (F.col("n_docs") > F.col("null_docs")))
    return chunks.mapInArrow(run, "doc_id long, ids binary")
