"""Token ids of whole texts by the tokenizers library.

With a byte-level pre-tokenizer every single space before a non-space character
starts a new pre-token, so a text can be cut there and the ids of its pieces
joined; the same piece always has the same ids.  A task keeps the ids of the
pieces it has met (about 200 bytes each, at most ``CACHE_PIECES``) and forgets them
when it ends.  Tokenizers of another make, and texts
that hold an added token such as an end mark, are encoded whole.
"""

from __future__ import annotations

import json
import re
import string
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from fxledger.llm.memory import at_task_end

CACHE_PIECES = 600_000
PUNCTUATION = string.punctuation
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?!\S)")


def _alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _line(piece: str) -> tuple[str, str] | None:
    """The parts around a single line end that has no other white space beside it."""
    left, _, right = piece.partition("\n")
    return (left, right) if left and right and not left[-1].isspace() and not right[0].isspace() else None


_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def _packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < 16 else struct.pack("<%dI" % len(ids), *ids)


class _Pieces(dict):
    """ids (little-endian unsigned 32-bit) of a piece that follows ``lead``."""

    def __init__(self, tokenizer: Tokenizer, lead: str, bare: "_Pieces | None"):
        super().__init__()
        self.tokenizer, self.tokenize, self.lead, self.bare = tokenizer, tokenizer.model.tokenize, lead, bare
        self.beside = () if bare is None else bare  # the other dictionary under one limit
        self.stand_in = _alphabet()
        self.first = "".join(self.stand_in[b] for b in lead.encode())

    def __missing__(self, piece: str) -> bytes:
        if len(self) + len(self.beside) >= CACHE_PIECES:
            self.clear()
            self._bare().clear()
        if piece.isalpha():  # one pre-token: no cut can fall inside letters
            plain = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.stand_in)
            got = self[piece] = _packed([t.id for t in self.tokenize(self.first + plain)])
            return got
        core = piece.rstrip(PUNCTUATION)
        if core != piece and core.isalpha():  # letters, then other signs: two pre-tokens
            got = self[core] + self._bare()[piece[len(core):]]
        elif "\n" in piece and (parts := _line(piece)):
            # a line end between words is a pre-token; such pieces rarely come back
            return self[parts[0]] + self._bare()["\n"] + self._bare()[parts[1]]
        else:
            ids = self.tokenizer.encode(self.lead + piece, add_special_tokens=False).ids
            got = _packed(ids)
        self[piece] = got
        return got

    def _bare(self) -> "_Pieces":
        return self if self.bare is None else self.bare


class Encoder:
    """Encodes texts to bytes of little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                         and not pre.get("add_prefix_space", True) and not spec.get("normalizer")
                         and not spec.get("post_processor") and spec["model"]["type"] == "BPE"
                         and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word")
                                     for t in spec.get("added_tokens") or []))
        self.bare = _Pieces(self.tokenizer, "", None)
        self.spaced = _Pieces(self.tokenizer, " ", self.bare)

    def forget(self) -> None:
        self.spaced.clear()
        self.bare.clear()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_piece or any(a in text for a in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        head, *rest = _CUT.split(text) if _ODD.search(text) else text.split(" ")
        if not head:
            return b"".join(map(self.spaced.__getitem__, rest))
        return self.bare[head] + b"".join(map(self.spaced.__getitem__, rest))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process; ``path`` must name a file that every
    executor has (vocabulary files are installed, not shipped)."""
    found = Encoder(path)
    at_task_end(found.forget)
    return found


def encode_column(text: pa.Array, path: str, end_id: int) -> list[bytes]:
    """ids of each text followed by ``end_id``; null is empty."""
    end, run = np.array([end_id], dtype="<u4").tobytes(), encoder(path)
    return [run(t) + end for t in text.to_pylist()]
