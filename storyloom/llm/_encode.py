"""Whole-text encoding with a public tokenizer, each distinct piece encoded once in a worker.

A text is cut only where the tokenizer itself always cuts: at white space for vocabularies that drop it, and for byte-level
ones at the places where their pattern ends a word or a run of white space. The ids of the pieces, joined, are the ids of
the text. Texts with characters that regular expression engines class differently as white space are encoded in one piece.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Sequence
from itertools import chain
from typing import Any

import numpy as np

_ODD_SPACE = re.compile("[\x1c-\x1f\x85᠎​-‍⁠﻿]")
#: A Latin word before white space or a closing mark, closing marks before white space, or any other run. Both kinds of
#: vocabulary cut between a letter and a mark; byte-level ones keep a blank with the word after it.
_WORD = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]+(?=[\\s.,;:!?]|$)"
_MARKS = r"[.,;:!?]+(?=\s|$)"
_BYTE_LEVEL_PIECES = re.compile(rf" ?{_WORD}|{_MARKS}| ?\S+|\s+(?!\S)|\s")
_WORD_PIECES = re.compile(rf"{_WORD}|{_MARKS}|\S+")
#: Bytes of pieces and ids that each memory of a worker holds from its current generation, and as many from its last one.
#: Pieces over LONGEST code points are never kept. Memory only: results do not depend on either.
GENERATION = 96 << 20
LONGEST = 64
#: What an entry takes beside its piece and its ids.
_ENTRY = 160

#: One Latin word, with or without the blank before it: one unit to the tokenizer, which needs no pattern to find it. The dotted
#: capital I is left out, for it becomes two characters in lower case.
_ONE_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")


def _byte_letters() -> list[str]:
    """The letter for each byte in byte-level vocabularies: printable bytes stand for themselves, the others come after 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


_LOADED: dict[str, PieceEncoder] = {}


class _Memory(dict):
    """What the pieces met so far encode to, in two generations: what is used again moves on, the rest is forgotten."""

    def __init__(self, learn: Callable[[str], Any], lower: bool, marks: Callable[[str], Any] | None = None):
        super().__init__()
        self.learn, self.lower, self.marks, self.last = learn, lower, marks, {}
        self.most, self.bytes = GENERATION, 0

    def forget(self) -> None:
        self.clear()
        self.last, self.bytes = {}, 0

    def __missing__(self, piece: str) -> Any:
        found = self.last.get(piece)
        if found is None:
            stem = piece.rstrip(".,;:!?") if self.marks else piece
            if len(stem) < len(piece) and stem and stem[-1].lower().isalpha():
                found = self[stem] + self.marks(piece[len(stem) :])
            elif self.lower and "A" <= piece[0] <= "Z":
                found = self[piece[0].lower() + piece[1:]]
            else:
                found = self.learn(piece)
        if len(piece) <= LONGEST:
            self.bytes += _ENTRY + 2 * len(piece) + (len(found) if isinstance(found, bytes) else len(found[1]) + len(found[2]) + 130)
            if self.bytes > self.most:
                self.last = dict(self)
                self.clear()
                self.bytes = 0
            self[piece] = found
        return found


def _kinds(node: Any) -> set[str]:
    """The types of all steps of a normalizer or pre-tokenizer, with `Removed` for a split that drops what it finds."""
    if isinstance(node, list):
        return set().union(*map(_kinds, node))
    if not isinstance(node, dict):
        return set()
    own = {node["type"]} if "type" in node else set()
    return own | ({"Removed"} if node.get("behavior") == "Removed" else set()) | _kinds(node.get("normalizers")) | _kinds(node.get("pretokenizers"))


class PieceEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        settings = json.loads(self.tokenizer.to_str())
        drops_space = "Removed" in _kinds(settings["pre_tokenizer"])
        self.pieces = _WORD_PIECES if drops_space else _BYTE_LEVEL_PIECES
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 65_536 else np.uint32
        self.code = "H" if self.dtype is np.uint16 else "I"
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.lower = lower = drops_space and "Lowercase" in _kinds(settings["normalizer"])
        # Closing marks are few and follow many different words: they are looked up like any other piece.
        self.ids = _Memory(self._ids, lower, lambda marks: self.ids[marks])
        self.spaced = _Memory(lambda piece: self._ids(" " + piece), False, lambda marks: self.ids[marks])
        self.line_feed = self._ids("\n")
        self.spans = _Memory(self._spans, lower)

    def forget(self) -> None:
        for memory in (self.ids, self.spaced, self.spans):
            memory.forget()

    def cut(self, text: str) -> list[str]:
        if _ODD_SPACE.search(text):
            return [text]
        return self.pieces.findall(text)

    def _ids(self, piece: str) -> bytes:
        if piece.isascii() and piece.lstrip(" ").isalpha() and not piece.startswith("  "):  # these letters stand for themselves
            letters = (piece.lower() if self.lower else piece).replace(" ", self.letters[32])
            return array(self.code, [token.id for token in self.model.tokenize(letters)]).tobytes()
        if _ONE_WORD.fullmatch(piece):
            letters = "".join([self.letters[b] for b in (piece.lower() if self.lower else piece).encode()])
            return array(self.code, [token.id for token in self.model.tokenize(letters)]).tobytes()
        return array(self.code, self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids).tobytes()

    def _spans(self, piece: str) -> tuple[int, bytes, bytes]:
        """How many tokens, and where they begin and end in the piece."""
        at = self.tokenizer.encode(piece, add_special_tokens=False).offsets
        return len(at), array("i", [a for a, _ in at]).tobytes(), array("i", [b for _, b in at]).tobytes()

    def _joined(self, text: str) -> bytes:
        words = text.split()
        if self.pieces is _WORD_PIECES:
            if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
                return b"".join(map(self.ids.__getitem__, words))
        else:
            lines = [line.split(" ") for line in text.split("\n")]
            if list(chain.from_iterable(lines)) == words:  # single blanks and line feeds between words, nothing else
                first, spaced = self.ids.__getitem__, self.spaced.__getitem__
                return self.line_feed.join([first(line[0]) + b"".join(map(spaced, line[1:])) for line in lines])
        return b"".join(map(self.ids.__getitem__, self.cut(text)))

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each whole text; a null text is an empty one."""
        return [np.frombuffer(self._joined(t) if t else b"", dtype=self.dtype) for t in texts]

    def offsets(self, texts: Sequence[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """First and past-the-last code point of each token of each whole text."""
        known, out = self.spans.__getitem__, []
        for text in texts:
            text = text or ""
            pieces = self.cut(text)
            if not pieces:
                out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            found = list(map(known, pieces))
            if self.pieces is _BYTE_LEVEL_PIECES or pieces == [text]:
                base = np.concatenate([[0], np.cumsum(list(map(len, pieces[:-1])), dtype=np.int64)])
            else:
                base = np.array([m.start() for m in self.pieces.finditer(text)])
            n, first, past = zip(*found, strict=True)
            shift = np.repeat(base, n)
            out.append((np.frombuffer(b"".join(first), np.int32) + shift, np.frombuffer(b"".join(past), np.int32) + shift))
        return out


def encoder(path: str, generation: int = GENERATION) -> PieceEncoder:
    """One encoder for each worker process and vocabulary file; each of its memories takes about twice `generation` bytes at most."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    for memory in (_LOADED[path].ids, _LOADED[path].spaced, _LOADED[path].spans):
        memory.most = generation
    return _LOADED[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
