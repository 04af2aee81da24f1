"""Fast exact encoding with a word-level BPE tokenizer of the tokenizers library.

The tokenizer's pre-tokens never hold white space, so a text is the sequence of
its white-space separated chunks, each encoded for itself; chunks repeat, so a
worker keeps what it has seen. A chunk of characters below U+0130 is cut with
the tokenizer's own pattern (NFC leaves such characters alone and lower-casing
them needs no context) and its pieces go to the tokenizer's own BPE model. All
else (other scripts, the special tokens' strings, rare control characters) goes
through the tokenizer whole, and so does every text if the file's normalizer,
pre-tokenizer or model is not of the form that this shortcut was made for.
"""

from __future__ import annotations

import json

import numpy as np
import regex

KEEP = 400_000

_CONTROLS = "\x1c\x1d\x1e\x1f"

#: The parts of a tokenizer file that the shortcut stands on.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _PIECES}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _byte_chars() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Texts to the little-endian 16-bit ids of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.model = self.whole.model
        self.pieces = regex.compile(_PIECES).findall
        plain = all(t["special"] and not t["normalized"] and t["content"].startswith("<|") for t in spec["added_tokens"])
        self.known_form = plain and spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _PRE_TOKENIZER and not spec["post_processor"] and spec["model"].get("type") == "BPE"
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.bytes = _byte_chars()
        self.of_chunk: dict[str, bytes] = {}
        self.of_piece: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        known = self.of_piece.get(piece)
        if known is None:
            if len(self.of_piece) >= KEEP:
                self.of_piece.clear()
            spelled = piece.encode().decode("latin-1").translate(self.bytes)
            known = self.of_piece[piece] = np.array([t.id for t in self.model.tokenize(spelled)], "<u2").tobytes()
        return known

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if max(chunk) >= "İ":
            return self._library(chunk)
        low = chunk.lower()
        if low.isalpha():
            return self._piece(low)
        return b"".join(map(self._piece, self.pieces(low)))

    def encode(self, text: str) -> bytes:
        if not self.known_form or ("<|" in text and any(s in text for s in self.special)) or any(c in text for c in _CONTROLS):
            return self._library(text)
        low = text.lower() if _is_latin(text) else text
        if "<|" in low and low != text and any(s in low for s in self.special):
            low = text
        chunks = low.split()
        known = self.of_chunk
        try:
            return b"".join(map(known.__getitem__, chunks))
        except KeyError:
            pass
        if len(known) >= KEEP:
            known.clear()
        for chunk in chunks:
            if chunk not in known:
                known[chunk] = self._chunk(chunk)
        return b"".join(map(known.__getitem__, chunks))


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The worker process's encoder for a file; its memory of words lives on between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
