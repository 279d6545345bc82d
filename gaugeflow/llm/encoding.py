"""Byte-pair encoding of whole texts, each distinct word encoded once a worker.

The tokenizers split a text into words before they merge, and no merge crosses
a word. So a text's ids are those of its pieces in order, wherever the text is
cut at a place at which the splitter cuts anyway:

* byte-level files: before a space that a visible character follows;
* word-level files: at any space or line feed (white space is dropped there).

Pieces repeat much more often than texts, so a bounded memo of piece -> ids
replaces most of the library's work and gives the same ids. A piece that the
memo lacks is split by the file's own pattern, and the library's merge model
encodes those of its words that are new. An idle worker drops its memo.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

from .common import Kept

_BEFORE_WORD = re.compile(r" (?=\S)")
_NOT_BEFORE_WORD = re.compile(r" (?!\S)")
#: Fixed value: the splitting pattern of byte-level files, which they name but don't hold.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: ``BYTE_LEVEL`` for ASCII texts; ``\\x1c`` to ``\\x1f`` are no white space there.
ASCII_LEVEL = BYTE_LEVEL.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+")


def visible_bytes() -> dict[int, str]:
    """The character that stands for each byte: printable ones for themselves,
    the others, in order, for code points from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)}


class Memo(dict):
    """piece -> bytes of the ids of ``lead + piece``; a missing one is encoded when asked for.

    Past ``limit`` pieces it starts anew and keeps those it had beside it: of
    these, pieces that are asked for again move over, until the next turn.
    Pieces and words of more than ``LONGEST`` characters are encoded each time
    and never kept, so a memo's bytes are bounded whatever the texts, such as
    those of scripts without spaces.
    """

    #: Of a piece that is kept, in characters: words hardly come longer.
    LONGEST = 48

    def __init__(self, spec: dict, tokenizer: Tokenizer, code: str, lead: str, limit: int):
        split = next((p["pattern"]["Regex"] for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"), BYTE_LEVEL)
        self.find, self.model, self.code = regex.compile(split).findall, tokenizer.model, code
        self.normalizer, self.table, self.lead, self.limit = tokenizer.normalizer, visible_bytes(), lead, limit
        self.seen_lead = lead.translate(self.table)
        # The same words of a text of ASCII characters, found without Unicode's classes.
        self.find_ascii = re.compile(ASCII_LEVEL, re.ASCII).findall if split == BYTE_LEVEL else self.find
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > self.LONGEST:
            return self.encoded(piece)
        out = self.old.get(piece)
        if out is None:
            out = self.encoded(piece)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out

    def encoded(self, piece: str) -> bytes:
        plain = piece.isascii()
        if plain and piece.isalpha():  # one word, whatever the pattern
            return self.tokens(self.seen_lead + (piece if self.normalizer is None else piece.lower()))
        text = self.lead + piece
        if self.normalizer is not None:
            text = text.lower() if plain else self.normalizer.normalize_str(text)
        words = (self.find_ascii if plain else self.find)(text)
        return self.ids(words[0]) if len(words) == 1 else b"".join(map(self.part, words))

    def part(self, word: str) -> bytes:
        """A word of a piece. One that is a piece itself isn't kept a second time."""
        alone = word[len(self.lead) :]
        if alone.isalpha() and alone.isascii() and word.startswith(self.lead):
            return self.get(alone) or self.old.get(alone) or self.ids(word)
        if len(word) > self.LONGEST:
            return self.ids(word)
        out = self.words.get(word)
        if out is None:
            if len(self.words) >= self.limit:
                self.words.clear()
            out = self.words[word] = self.ids(word)
        return out

    def ids(self, word: str) -> bytes:
        return self.tokens(word.encode().decode("latin-1").translate(self.table))

    def tokens(self, seen: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(seen)]).tobytes()


class MemoEncoder:
    """``encode(texts)`` gives the ids of each whole text as an array.

    ``memo`` bounds the pieces that each of two memos keeps twice over; a
    word-level file has one memo, of twice the size. With
    ``markers``, texts of the file's added tokens (such as ``<|endoftext|>``)
    give those tokens' ids, as the library does by default; without, they are
    ordinary text.
    """

    def __init__(self, path: str, memo: int = 200_000, markers: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not markers
        added = spec.get("added_tokens", []) if markers else []
        # A token that is sought in normalised text can be in any text.
        marks = [""] if any(t["normalized"] for t in added) else [re.escape(t["content"]) for t in added]
        self.marked = re.compile("|".join(marks)).search if marks else None
        self.drops_space = '"Split"' in json.dumps(spec["pre_tokenizer"])
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype = np.dtype("<u2" if small else "<u4")
        code = "H" if small else "I"
        self.first, self.rest = Memo(spec, self.tokenizer, code, "", memo * (2 if self.drops_space else 1)), Memo(spec, self.tokenizer, code, " ", memo)

    def ids(self, text: str) -> bytes:
        if self.marked and self.marked(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if self.drops_space:
            return b"".join(map(self.first.__getitem__, text.replace("\n", " ").split(" ")))
        pieces = _BEFORE_WORD.split(text) if _NOT_BEFORE_WORD.search(text) else text.split(" ")
        return self.first[pieces[0]] + b"".join(map(self.rest.__getitem__, pieces[1:]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.ids(t), self.dtype) for t in texts]


_ENCODERS = Kept(lambda path, markers: MemoEncoder(path, markers=markers))


def encode(texts: list[str | None], path: str, markers: bool = False) -> list[np.ndarray]:
    """The ids of each whole text, by the worker's encoder of that file; null counts as empty."""
    with _ENCODERS.use(path, markers) as encoder:
        return encoder.encode([t or "" for t in texts])


def id_type(path: str) -> np.dtype:
    """The type of a file's ids in ``encode``'s arrays."""
    with _ENCODERS.use(path, False) as encoder:
        return encoder.dtype
