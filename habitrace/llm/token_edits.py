"""Edit-aware token counts with stored pre-token segment trees.

A document's text is cut into pre-tokens; up to 64 neighbours form a leaf, and
a segment tree over the leaves keeps characters and tokens of every subtree.
``build_trees`` cuts and encodes each text once and gives its tree as a row, to
be kept as a table; ``apply_edits`` takes such rows and gives them back edited.
An edit descends the tree to the leaf that holds the last boundary at least
three characters before the change (the pattern looks at most that far ahead),
re-cuts the text from there until a new boundary falls on an old one behind the
change, encodes only those pre-tokens, and adds the differences up the path of
each leaf touched. Leaves that grow past twice their size are split again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF = 64
CONTEXT = 3
KEEP = 400_000

#: The white space that the tokenizer's pattern means by \\s.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
_CUT = regex.compile(rf"{_SUFFIXES}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Counter:
    """Tokens of single pre-tokens for one byte-level rank file; remembers what it has seen."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= KEEP:
                self.known.clear()
            n = self.known[piece] = len(self.encoding._encode_single_piece(piece.encode()))
        return n


class _Folded:
    """A leaf of a stored tree that nothing has touched: a stretch of the stored text."""

    __slots__ = ("whole", "ends", "a", "b")

    def __init__(self, whole: str, ends: np.ndarray, a: int, b: int):
        self.whole, self.ends, self.a, self.b = whole, ends, a, b

    def __len__(self) -> int:
        return self.b - self.a

    def _begin(self) -> int:
        return int(self.ends[self.a - 1]) if self.a else 0

    def text(self) -> str:
        return self.whole[self._begin() : int(self.ends[self.b - 1])] if self.b > self.a else ""

    def lengths(self) -> np.ndarray:
        return np.diff(self.ends[self.a : self.b], prepend=self._begin())

    def open(self) -> list[str]:
        stops = [self._begin(), *self.ends[self.a : self.b].tolist()]
        return [self.whole[i:j] for i, j in zip(stops, stops[1:])]


class TokenTree:
    """Token count of one text under edits."""

    def __init__(self, text: str, count: Counter):
        """Cuts and encodes a whole text."""
        self.count, self.encoded = count, 0
        pieces = _CUT.findall(text)
        leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self._replant(leaves, [sum(map(len, leaf)) for leaf in leaves], [sum(map(count, leaf)) for leaf in leaves])

    def _replant(self, leaves: list, chars: list[int], tokens: list[int]) -> None:
        """A tree over leaves whose characters and tokens are known."""
        self.leaves, n = leaves, len(leaves)
        self.size = 1 << (n - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + n], self.tokens[self.size : self.size + n] = chars, tokens
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @classmethod
    def stored(cls, row: dict, count: Counter) -> TokenTree:
        """The tree of a stored row; nothing is cut or encoded, leaves are opened when they are touched."""
        tree = cls.__new__(cls)
        tree.count, tree.encoded = count, 0
        tree.chars, tree.tokens = (np.frombuffer(row[c], "<u4").tolist() for c in ("chars", "tokens"))
        tree.size = len(tree.chars) // 2
        counts = np.frombuffer(row["leaves"], "<u4")
        # lengths of pre-tokens take one byte each, four where one is longer than 255; the first byte tells
        lengths = np.frombuffer(row["pieces"], f"<u{row['pieces'][0]}", offset=1)
        ends, first = np.cumsum(lengths, dtype=np.int64), np.cumsum(counts, dtype=np.int64)
        tree.leaves = [_Folded(row["text"], ends, a, b) for a, b in zip((first - counts).tolist(), first.tolist())]
        return tree

    def row(self) -> dict:
        """The tree as it is stored: text, lengths of pre-tokens, pre-tokens of leaves, sums of subtrees."""
        lengths = [leaf.lengths() if isinstance(leaf, _Folded) else np.array([len(x) for x in leaf], np.int64) for leaf in self.leaves]
        pack = lambda values: np.asarray(values, "<u4").tobytes()
        every = np.concatenate(lengths)
        width = 1 if not len(every) or every.max() < 256 else 4
        return {"text": self.text(), "pieces": bytes([width]) + every.astype(f"<u{width}").tobytes(), "leaves": pack([len(x) for x in lengths]), "chars": pack(self.chars), "tokens": pack(self.tokens)}

    def _open(self, leaf: int) -> list[str]:
        """The pre-tokens of a leaf."""
        if isinstance(self.leaves[leaf], _Folded):
            self.leaves[leaf] = self.leaves[leaf].open()
        return self.leaves[leaf]

    def total(self) -> int:
        return self.tokens[1]

    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(leaf.text() if isinstance(leaf, _Folded) else "".join(leaf) for leaf in self.leaves)

    def _find(self, place: int) -> tuple[int, int]:
        """(leaf, characters before it) for the leaf that holds ``place``."""
        at, before = 1, 0
        while at < self.size:
            at *= 2
            if before + self.chars[at] <= place and self.chars[at + 1]:
                before += self.chars[at]
                at += 1
        return min(at - self.size, len(self.leaves) - 1), before

    def _put(self, leaf: int, pieces: list[str]) -> None:
        """New pieces of one leaf; the differences go up to the root."""
        self.leaves[leaf] = pieces
        at = self.size + leaf
        more_chars = sum(map(len, pieces)) - self.chars[at]
        more_tokens = sum(map(self.count, pieces)) - self.tokens[at]
        while at:
            self.chars[at] += more_chars
            self.tokens[at] += more_tokens
            at //= 2

    def edit(self, at: int, drop: int, put: str) -> None:
        """Replaces ``drop`` characters at ``at`` by ``put``; both are clipped to the text."""
        at = max(0, min(at, self.length()))
        drop = max(0, min(drop, self.length() - at))
        first, begin = self._find(max(0, at - CONTEXT))
        kept = 0
        opened = self._open(first)
        while kept < len(opened) and begin + len(opened[kept]) <= at - CONTEXT:
            begin += len(opened[kept])
            kept += 1
        head = opened[:kept]
        old, bounds, last, last_kept = "", {0}, first, kept
        # old text from the boundary on; boundaries behind the change, by leaf and piece
        places: dict[int, tuple[int, int]] = {}

        def more() -> bool:
            nonlocal old, last, last_kept
            if last >= len(self.leaves):
                return False
            said, here, pieces = [], len(old), self._open(last)
            for k in range(last_kept, len(pieces)):
                places.setdefault(here, (last, k))
                said.append(pieces[k])
                here += len(pieces[k])
            old += "".join(said)
            last, last_kept = last + 1, 0
            return True

        start, end = at - begin, at - begin + drop
        while len(old) < end + 1 and more():
            pass
        while True:
            whole = last >= len(self.leaves)
            new = old[:start] + put + old[end:]
            shift, fresh, stop = len(put) - drop, [], None
            for m in _CUT.finditer(new):
                fresh.append(m[0])
                back = m.end() - shift
                # without the rest of the text, matches near its end aren't final
                if not whole and m.end() > len(new) - CONTEXT - 1:
                    break
                if m.end() >= start + len(put) and back >= end and back in places:
                    stop = places[back]
                    break
            if stop or whole:
                break
            more()
        self.encoded += len(fresh)
        if stop is None:
            stop = (len(self.leaves), 0)
        tail = self._open(stop[0])[stop[1] :] if stop[0] < len(self.leaves) else []
        if stop[0] == first:
            self._put(first, head + fresh + tail)
            self._split(first)
            return
        self._put(first, head + fresh)
        for k in range(first + 1, min(stop[0], len(self.leaves))):
            if self.leaves[k]:
                self._put(k, [])
        if stop[0] < len(self.leaves) and stop[1]:
            self._put(stop[0], tail)
        self._split(first)

    def _split(self, leaf: int) -> None:
        """Cuts a leaf that has grown past twice its size; empty leaves go, known tokens stay known."""
        grown = self._open(leaf)
        if len(grown) <= 2 * LEAF:
            return
        parts = [grown[i : i + LEAF] for i in range(0, len(grown), LEAF)]
        tokens = self.tokens[self.size : self.size + len(self.leaves)]
        told = [(x, n) for x, n in zip(self.leaves, tokens)]
        told[leaf : leaf + 1] = [(x, sum(map(self.count, x))) for x in parts]
        told = [(x, n) for x, n in told if len(x)]
        chars = [sum(map(len, x)) if isinstance(x, list) else int(x.lengths().sum()) for x, _ in told]
        self._replant([x for x, _ in told], chars, [n for _, n in told])


_counters: dict[str, Counter] = {}


def counter_of(path: str, pattern: str) -> Counter:
    """The worker process's counter for a rank file."""
    if path not in _counters:
        _counters[path] = Counter(path, pattern)
    return _counters[path]


EDITS = "array<struct<at:int,drop:int,put:string>>"
#: A stored tree: the text, lengths of its pre-tokens, pre-tokens of each leaf, and the sums of all subtrees (a heap, root at 1).
TREE = "doc_id long, n_chars long, n_tokens long, text string, pieces binary, leaves binary, chars binary, tokens binary"
_STORED = ("text", "pieces", "leaves", "chars", "tokens")


def _tree_columns(trees: list[TokenTree]) -> list[pa.Array]:
    rows = [t.row() for t in trees]
    return [pa.array([r[c] for r in rows], pa.string() if c == "text" else pa.binary()) for c in _STORED]


def build_trees(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tree of every row of ``docs`` (schema ``TREE``), to be stored.

    A null text is empty and has an empty tree; texts of any length are cut
    whole. Repeated rows and rows without an id stay; an empty table gives no
    rows; extra columns, whatever they are called, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(ranks, pattern)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                trees = [TokenTree(t.as_py() or "", count) for t in batch.column(1)]
                sums = [pa.array([f(t) for t in trees], pa.int64()) for f in (TokenTree.length, TokenTree.total)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *sums, *_tree_columns(trees)], names=["doc_id", "n_chars", "n_tokens", *_STORED])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, TREE)


def apply_edits(trees: DataFrame, edits: Column, ranks: str, pattern: str) -> DataFrame:
    """Stored trees after their edits: ``TREE`` and (n_edits, n_encoded, n_chars_before, n_tokens_before).

    ``edits`` (over the columns of ``trees``) is an array of {at, drop, put} in
    code points, applied in order, each to the text that the one before left;
    places past the end are clipped; null edits and null parts of edits do
    nothing. ``n_encoded`` counts the pre-tokens that the edits made encode:
    all the others keep the sums that are stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(ranks, pattern)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                trees, told = [], []
                for row in batch.to_pylist():
                    tree, done = TokenTree.stored(row, count), 0
                    for e in row["edits"] or []:
                        if e is not None and None not in (e["at"], e["drop"], e["put"]):
                            tree.edit(e["at"], e["drop"], e["put"])
                            done += 1
                    trees.append(tree)
                    told.append((tree.length(), tree.total(), done, tree.encoded, row["n_chars"], row["n_tokens"]))
                n = [pa.array(c, pa.int64()) for c in zip(*told)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *n[:2], *_tree_columns(trees), *n[2:]], names=["doc_id", "n_chars", "n_tokens", *_STORED, "n_edits", "n_encoded", "n_chars_before", "n_tokens_before"])

    rows = trees.select("doc_id", "n_chars", "n_tokens", *_STORED, edits.cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, TREE + ", n_edits long, n_encoded long, n_chars_before long, n_tokens_before long")


def counts_of(edited: DataFrame) -> DataFrame:
    """(doc_id, n_chars, n_tokens, n_edits, n_chars_after, n_tokens_after, n_encoded) of edited trees."""
    before = [F.col(f"{c}_before").alias(c) for c in ("n_chars", "n_tokens")]
    return edited.select("doc_id", *before, "n_edits", F.col("n_chars").alias("n_chars_after"), F.col("n_tokens").alias("n_tokens_after"), "n_encoded")


def revision(id_col: Column, n_chars: Column, edits: int = 4, round_no: int = 0) -> Column:
    """A repeatable round of edits per document: a correction, an insertion, a cut, an addition, in turn."""
    kinds = [(5, "reviewed"), (0, " (see the note, p. 12)"), (24, ""), (1, ".\n\nIt's")]
    made = []
    for k in range(edits):
        drop, put = kinds[k % len(kinds)]
        place = F.pmod(F.xxhash64(id_col, F.lit(k + edits * round_no)), n_chars + 1).cast("int")
        made.append(F.struct(place.alias("at"), F.lit(drop).alias("drop"), F.lit(put).alias("put")))
    return F.array(*made)
