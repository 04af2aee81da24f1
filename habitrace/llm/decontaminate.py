"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and benchmark items are normalised alike: A-Z lower-cased, words taken,
one space between. Every window of ten item words (or a whole shorter item) is
a pattern between two spaces; a document is scanned once. The scan runs on
UTF-8 bytes, which a 256-entry table normalises, and hits are mapped back to
character offsets of the original text.

The patterns are cut, deduplicated and counted by Spark. Up to ``block_bytes``
of them make one automaton, built once by each worker process; what is sent to
a worker is bounded however many items there are. A larger benchmark has as
many automata as it takes, and the corpus is scanned once for each: a worker
holds one of them at a time, and what one finds meets the rest by document.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitrace.llm.store import settled, written

WINDOW = 10
BLOCK_BYTES = 16 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def patterns_of(text: bytes, window: int = WINDOW) -> set[str]:
    """The windows of one item as the automaton holds them."""
    words = words_of(text)
    count = max(1, len(words) - window + 1) if words else 0
    return {" " + b" ".join(words[i : i + window]).decode("latin-1") + " " for i in range(count)}


def _patterns(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(pattern, items): every window with the items that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sorted(patterns_of((text or "").encode(), window))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([item] * len(found), pa.string())], names=["pattern", "item"])

    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string"), F.col(text_col).cast("string"))
    return items.mapInArrow(run, "pattern string, item string").groupBy("pattern").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """Broadcast blocks of patterns, each of about ``block_bytes`` at most, as (name, block)."""
    patterns = settled(_patterns(benchmark, item_col, text_col, window))
    size = patterns.agg(F.sum(F.length("pattern") + F.aggregate("items", F.lit(0), lambda n, x: n + F.length(x)))).first()[0] or 0
    blocks = -(-size // block_bytes)
    context, found = benchmark.sparkSession.sparkContext, []
    for k in range(blocks):
        rows = patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).collect()
        found.append((uuid.uuid4().hex, context.broadcast({r.pattern: tuple(r["items"]) for r in rows})))
    return found


def _automaton(block: dict[str, tuple[str, ...]]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for pattern, found in block.items():
        built.add_word(pattern, (len(pattern), found))
    # without a word there is nothing to make: a pattern that no text can hold stands in
    if not block:
        built.add_word("\0", (1, ()))
    built.make_automaton()
    return built


_built: dict[str, ahocorasick.Automaton] = {}


def _automaton_of(name: str, block) -> ahocorasick.Automaton:
    """The automaton of a broadcast block; a worker process keeps one."""
    if name not in _built:
        _built.clear()
        _built[name] = _automaton(block.value)
    return _built[name]


class _Hits:
    """What is found in one document."""

    __slots__ = ("items", "marked", "line")

    def __init__(self, line: str):
        self.line, self.items, self.marked = line, set(), None

    def add(self, end: int, length: int, found: tuple[str, ...]) -> None:
        if self.marked is None:
            self.marked = np.zeros(len(self.line) + 1, np.int8)
        self.marked[end + 1 - length : end] = 1
        self.items.update(found)

    def word_mask(self) -> np.ndarray:
        """A word is hit if its characters are marked."""
        spaces = np.flatnonzero(np.frombuffer(self.line.encode("latin-1"), np.uint8) == 32)
        return self.marked[spaces[:-1] + 1] > 0


def _spans(text: bytes, mask: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as character offsets of the original text."""
    lower = text.lower()
    bounds = [m.span() for m in _WORD.finditer(lower)]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": int(chars[bounds[a][0]]), "end": int(chars[bounds[b - 1][1]])} for a, b in edges.reshape(-1, 2)]


def _hits_in(texts: list[bytes], name: str, block) -> tuple[list[int], list[_Hits]]:
    """Number of words and what one automaton finds, per text."""
    automaton, counts, hits = _automaton_of(name, block), [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        hit = _Hits(" " + b" ".join(words).decode("latin-1") + " ")
        for end, (length, found) in automaton.iter(hit.line):
            hit.add(end, length, found)
        hits.append(hit)
    return counts, hits


def _scanned(rows: DataFrame, name: str, block) -> DataFrame:
    """(doc_id, same, n_words, items, words): the words hit as numbers, for one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                counts, hits = _hits_in([t.as_py() or b"" for t in batch.column(2).cast(pa.binary())], name, block)
                out = {
                    "doc_id": batch.column(0),
                    "same": batch.column(1),
                    "n_words": pa.array(counts, pa.int64()),
                    "items": pa.array([sorted(h.items) for h in hits], pa.list_(pa.string())),
                    "words": pa.array([np.flatnonzero(h.word_mask()) if h.items else [] for h in hits], pa.list_(pa.int32())),
                }
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return rows.mapInArrow(run, "doc_id long, same long, n_words long, items array<string>, words array<int>")


def _with_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, items, words) with the words' places in the original text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for text, n, words in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                mask = np.zeros(n, bool)
                mask[words] = True
                spans.append(_spans(text or b"", mask) if words else [])
            lengths = [pa.array([len(x) for x in batch.column(k).to_pylist()], pa.int64()) for k in (4, 3)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lengths, batch.column(3), pa.array(spans, kind)], names=["doc_id", "n_words", "n_hit", "n_items", "items", "spans"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,end:int>>")


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans) per row of ``docs``.

    Words, hit words, the items that occur, and the hits as character offsets
    of the original. Null texts have no words; texts of any length are scanned
    whole. Items without an id or without words match nothing; items that share
    an id count once. Repeated documents give repeated rows, as do rows without
    an id; an empty benchmark hits nothing, an empty table gives no rows. Other
    columns, whatever they are called, are left out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("same"), F.col(text_col).cast("string").alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    if len(blocks) <= 1:
        return _one_scan(rows.select("doc_id", "text"), *(blocks[0] if blocks else ("none", docs.sparkSession.sparkContext.broadcast({}))))
    found = _scanned(rows, *blocks[0]).select("doc_id", "same", "items", "words")
    for more in blocks[1:]:
        found = found.union(_scanned(rows, *more).select("doc_id", "same", "items", "words"))
    # documents with hits are few; rows that repeat an id and a text have equal hits
    pieces = found.filter(F.size("items") > 0).dropDuplicates()
    both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = pieces.groupBy("doc_id", "same").agg(both("items"), both("words")).select(F.col("doc_id").alias("_id"), F.col("same").alias("_same"), "items", "words")
    words = F.size(F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), " "), lambda w: w != "")).cast("long")
    joined = rows.join(merged, rows.doc_id.eqNullSafe(merged["_id"]) & (rows.same == merged["_same"]), "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return _with_spans(joined.select("doc_id", "text", words.alias("n_words"), empty("items", "array<string>"), empty("words", "array<int>")))


def _one_scan(rows: DataFrame, name: str, block) -> DataFrame:
    """``scan`` with one automaton: nothing is joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
                counts, hits = _hits_in(texts, name, block)
                masks = [h.word_mask() if h.items else None for h in hits]
                out = {
                    "doc_id": batch.column(0),
                    "n_words": pa.array(counts, pa.int64()),
                    "n_hit": pa.array([0 if m is None else int(m.sum()) for m in masks], pa.int64()),
                    "n_items": pa.array([len(h.items) for h in hits], pa.int64()),
                    "items": pa.array([sorted(h.items) for h in hits], pa.list_(pa.string())),
                    "spans": pa.array([[] if m is None else _spans(t, m) for t, m in zip(texts, masks)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                }
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return rows.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,end:int>>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, all columns kept.

    A row is judged by its own text, as it is read: nothing is shuffled or
    joined, each automaton is one more filter. Null and empty texts, and rows
    without an id, stay like any other without a hit; repeated rows share their
    fate. An empty benchmark drops nothing.
    """

    def without(name: str, block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), 512):
                    batch = whole.slice(at, 512)
                    automaton = _automaton_of(name, block)
                    lines = (" " + b" ".join(words_of(t.as_py() or b"")).decode("latin-1") + " " for t in batch.column(1).cast(pa.binary()))
                    clean = [next(automaton.iter(line), None) is None for line in lines]
                    yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    for k, (name, block) in enumerate(_blocks(benchmark, item_col, item_text_col, window, block_bytes)):
        # filters in a row would hold an automaton each at the same time
        rows = (written(rows, "clean") if k else rows).mapInArrow(without(name, block), rows.schema)
    return rows.select("_row.*")


def items_digest(items: F.Column) -> F.Column:
    """Lower-case hex SHA-256 of the ids, sorted as strings, comma-joined."""
    return F.sha2(F.concat_ws(",", items), 256)


def brute_force(text: str, items: dict[str, str], window: int = WINDOW) -> tuple[int, int, list[str], str]:
    """The contract word by word, for tests: words, hit words, items, digest."""
    take = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words, hit, found = take.findall(text.translate(low)), set(), []
    for item, body in items.items():
        own = take.findall(body.translate(low))
        size = min(window, len(own))
        wanted = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        at = [i for i in range(len(words) - size + 1) if tuple(words[i : i + size]) in wanted] if own else []
        hit.update(j for i in at for j in range(i, i + size))
        found += [item] if at else []
    found = sorted(set(found))
    return len(words), len(hit), found, hashlib.sha256(",".join(found).encode()).hexdigest()
