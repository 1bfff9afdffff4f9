"""Pre-tokens at which public tokenizers never merge, and the tokenizers themselves on the executors.

A text with one space in front is cut before each space that follows a character other than white space and U+2581 (which
pieces have for a space), and behind each line feed with a character other than white space on both sides. Both kinds of cut are proved from the vocabulary before they are used:

- pieces (``Pieces.proved_cuts``): no mergeable piece has a space behind another character, and none holds a line feed,
  which so falls back to a byte. Merges join neighbours into pieces, so none reaches over a cut.
- byte-level merges (``ByteMerges``): the fixed pre-tokeniser ends a token in front of a space that follows a non-space, and
  on both sides of a single line feed, as only the space may lead a word and white space is otherwise a token of its own.

So each pre-token encodes alone as it does within its text, and what is known of one holds wherever it stands. A text
without such places is one pre-token. Texts are cut in slices, so that a very long one is never held as one list.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import sentencepiece
from sentencepiece import sentencepiece_model_pb2

WORD, WHITE, LINES = re.compile(" *[^ ]+| +"), re.compile("[^\\S ]|\u2581"), re.compile(r"(?<=\S\n)(?=\S)")
CUT = re.compile("(?<=[^\\s\u2581])(?= )|(?<=\\S\n)(?=\\S)")
#: Characters of a slice.
SLICE = 200_000
SPACE_MARK = "▁"
NORMAL = 1


def _split(text: str) -> list[str]:
    """What ``CUT.split`` gives, in a tenth of the time for texts without tabs and line feeds."""
    found = WORD.findall(text)
    if not WHITE.search(text):
        return found
    out, held = [], ""
    for unit in found:
        unit, held = held + unit, ""
        if unit[-1] == SPACE_MARK or unit[-1].isspace() and unit[-1] != " ":  # a space behind these begins no pre-token
            held = unit
        elif "\n" in unit:
            out += LINES.split(unit)
        else:
            out.append(unit)
    return out + LINES.split(held) if held else out


def pretokens(text: str | None) -> Iterator[list[str]]:
    """The pre-tokens of a text with a space in front, in slices of lists; a null or empty text has none."""
    if not text:
        return
    at, whole = 0, " " + text
    while len(whole) - at > SLICE and (cut := CUT.search(whole, at + SLICE)):
        yield _split(whole[at : cut.start()])
        at = cut.start()
    yield _split(whole[at:])


def read_bytes(path: str) -> bytes:
    """A vocabulary file, read on the driver; its size is fixed by the vocabulary."""
    with open(path, "rb") as f:
        return f.read()


class Pieces:
    """A piece model with byte fallback: ids of pre-tokens, and the bytes of each id."""

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces and proto.trainer_spec.byte_fallback):
            raise ValueError("a piece model that leaves texts as they are, with a space in front and byte fallback, is needed")
        if proto.trainer_spec.user_defined_symbols or any(p.type == 4 for p in proto.pieces):
            raise ValueError("symbols that a user has defined are not known here")
        self.pieces = [(p.piece, p.type) for p in proto.pieces]

    def proved_cuts(self) -> bool:
        """Whether no merge can reach over a place where a text is cut."""
        return not any(kind == NORMAL and (SPACE_MARK in p.lstrip(SPACE_MARK) or " " in p or "\n" in p) for p, kind in self.pieces)

    def ids(self, units: list[str]) -> list[list[int]]:
        """The ids of each pre-token. The model puts a space in front by itself, though not of nothing; where a pre-token has
        none, a line feed keeps it off, and the two ids of both are left out."""
        lone = [self.processor.piece_to_id(SPACE_MARK)]
        plain = [u[1:] if u.startswith(" ") else "\n" + u for u in units]
        return [lone if u == " " else x if u.startswith(" ") else x[2:] for u, x in zip(units, self.processor.encode(plain, num_threads=1), strict=True)]

    def bytes_of(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(SPACE_MARK, " ").encode() for p, kind in self.pieces]


class ByteMerges:
    """A byte-level merge tokenizer: ids of pre-tokens, and the bytes of each id."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        said = json.loads(data)
        pre = said["pre_tokenizer"] or {}
        if said["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            raise ValueError("a byte-level tokenizer without normaliser is needed")
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = True

    def ids(self, units: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def bytes_of(self) -> list[bytes]:
        """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*shown}))}
        out = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for piece, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            out[k] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        return out


@lru_cache(2)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)


@lru_cache(2)
def byte_merges(data: bytes) -> ByteMerges:
    return ByteMerges(data)
