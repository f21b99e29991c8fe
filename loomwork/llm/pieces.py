r"""Encoding by pieces: a text is cut as its tokenizer would cut it, and the ids of pieces seen are kept.

Two kinds of tokenizers have a short way, told by their own description: byte-level BPE with its published pattern and nothing before it, and word-end BPE that lower-cases, drops white
space and has a published pattern of its own. For texts up to U+00FF the pattern's classes are written out, so that no table of Unicode has to agree with the tokenizer's;
runs of other characters than white space that have one above U+00FF are pieces that the tokenizer cuts itself. With any other tokenizer, and for texts with special tokens, the whole text is encoded.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from array import array
from collections.abc import Callable

import numpy as np

CACHE_PIECES = 350_000  #: pieces that a Python worker keeps in each of two generations

# White space, letters and digits up to U+00FF, and all white space.
LATIN_SPACE, LETTER, DIGIT = "\\t-\\r \\x85\\xa0", "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
SPACE = LATIN_SPACE + "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
ENDINGS = "'(?:s|t|re|ve|m|ll|d)"


def _byte_pieces(space: str, first: str = "") -> Callable[[str], list[str]]:
    return re.compile(rf"{first} ?[{LETTER}]+|{ENDINGS}| ?[{DIGIT}]+| ?[^{space}{LETTER}{DIGIT}]+|[{space}]+(?![^{space}])|[{space}]+").findall


BYTE_PIECES, WIDE_BYTE_PIECES = _byte_pieces(LATIN_SPACE), _byte_pieces(SPACE, rf" ?[^{SPACE}]*[^\x00-\xff{SPACE}][^{SPACE}]*|")
LOW_WORD_PIECES = re.compile(rf"[{LETTER}]+|{ENDINGS}|[{DIGIT}]|[^{LATIN_SPACE}{LETTER}{DIGIT}]+").findall
RUNS = re.compile(rf"[^{SPACE}]+").findall

#: What the two kinds do before they cut, and how they cut.
BYTE_LEVEL = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
WORD_LEVEL = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


def _narrow(text: str) -> bool:
    """Are all characters up to U+00FF?"""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_pieces(text: str) -> list[str]:
    return BYTE_PIECES(text) if _narrow(text) else WIDE_BYTE_PIECES(text)


def word_pieces(text: str) -> list[str]:
    if _narrow(text):
        return LOW_WORD_PIECES(text.lower())
    out: list[str] = []
    for run in RUNS(text):
        out += LOW_WORD_PIECES(run.lower()) if _narrow(run) else [run]
    return out


def _stand_ins() -> dict[int, str]:
    """Byte-level BPE shows bytes as printable characters: themselves in printable Latin-1, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}


class _Known(dict):
    """The packed ids of pieces; what isn't there is made, and what wasn't asked for in the last CACHE_PIECES new ones is dropped."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.old.clear()  # before the copy, so that there are never three generations
            self.old = dict(self)
            self.clear()
        ids = self[piece] = self.old.get(piece) or self.make(piece)
        return ids


class PieceEncoder:
    """Encodes texts piece by piece. `cut` is None where there is no short way; `type` is that of the packed ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        made = json.loads(self.tokenizer.to_str())
        kind = (made.get("normalizer"), made.get("pre_tokenizer"))
        self.cut = byte_pieces if kind == BYTE_LEVEL else word_pieces if kind == WORD_LEVEL else None
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.stand_ins = _stand_ins()
        self.known = _Known(self._piece)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            if not _narrow(piece):
                return self._whole(piece)
            piece = piece.encode().decode("latin-1")
        return array(self.type.char, [t.id for t in self.tokenizer.model.tokenize(piece.translate(self.stand_ins))]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array(self.type.char, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        if not self.cut or any(s in text for s in self.special):
            return self._whole(text)
        return b"".join(map(self.known.__getitem__, self.cut(text)))


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker and path; it outlives a task where workers are reused."""
    kept = sys.modules.setdefault("loomwork_worker_pieces", types.ModuleType("loomwork_worker_pieces")).__dict__
    if path not in kept:
        kept[path] = PieceEncoder(path)
    return kept[path]
