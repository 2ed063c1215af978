"""Whole-text encoding with a given public tokenizer file; ids of frequent words are kept.

Both supported pre-tokenizers never join characters across a blank that stands
between two non-blank characters (byte-level BPE attaches the blank to what
follows, and makes a line end a pre-token of its own), so a text is the
concatenation of its blank-separated chunks and the ids of a chunk can be kept.
A chunk of letters is one pre-token and marks after them another; these go to
the library's model alone, in the byte alphabet of byte-level BPE.  Other chunks
go through the library's whole pipeline, and so do texts with characters outside
the plain Latin range or blanks in other places.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

#: Controls, superscripts and fractions, and all beyond Latin: regular expression classes may differ there.
_UNSAFE = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0\xb2\xb3\xb9\xbc-\xbe\u0130\u0250-\U0010ffff]")
_ODD_BLANK = re.compile(r" \s")
_TWO_BLANKS = re.compile(r"\s\s")
_SIMPLE = re.compile(r"([^\W\d_]+)([^\w\s]*)")
#: Byte-level BPE writes printable bytes as themselves and the others, in order, as the characters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + k for k, b in enumerate(sorted({*range(256)} - _PRINTABLE))}
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
_ENCODERS: dict[str, ChunkEncoder] = {}


class _Kept(dict):
    """key -> ids; beyond ``cap`` entries a result is made anew each time."""

    def __init__(self, make, cap: int):
        super().__init__()
        self.make, self.cap = make, cap

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < self.cap:
            self[key] = value
        return value


class ChunkEncoder:
    """``cap``: most chunks and words kept in a Python worker."""

    def __init__(self, path: str, cap: int = 875_000):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        pre = json.loads(self.lib.to_str())["pre_tokenizer"]
        kinds = [p["type"] for p in pre.get("pretokenizers", [])]
        self.leading_blank = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] \
            and self.lib.normalizer is None
        drops_blanks = kinds == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["behavior"] == "Removed" \
            and pre["pretokenizers"][0]["invert"]
        self.plain = self.leading_blank or drops_blanks
        self.model = self.lib.model
        self.chunks = _Kept(self._parts, cap)

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token."""
        if word.isascii() and word[0] == " ":
            mapped = "\u0120" + word[1:]
        else:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        ids = array("I", [t.id for t in self.model.tokenize(mapped)])
        return ids.tobytes() if _LITTLE else np.array(ids, "<u4").tobytes()

    def _parts(self, chunk: str) -> bytes:
        bare = chunk[1:] if chunk[:1] == " " else chunk
        if bare.isalpha():
            word = chunk if self.leading_blank else chunk.lower()
            return self._word(chunk) if word == chunk else self.chunks[word]
        m = _SIMPLE.fullmatch(bare)
        if not m:
            return self._whole(chunk)
        return self.chunks[chunk[:len(chunk) - len(m[2])]] + self.chunks[m[2]]

    def encode(self, text: str | None) -> bytes:
        """All ids of the text as little-endian uint32 bytes; a null text has none."""
        if not text:
            return b""
        if not self.plain or _UNSAFE.search(text):
            return self._whole(text)
        if self.leading_blank and (text[0].isspace() or text[-1].isspace() or _ODD_BLANK.search(text)):
            return self._whole(text)
        if not self.leading_blank:
            cut = text.split()
        else:
            lines = text if _TWO_BLANKS.search(text) else text.replace("\n", "\0\n\0")
            cut = lines.replace(" ", "\0 ").split("\0")
        return b"".join(map(self.chunks.__getitem__, cut))


def encoder(path: str) -> ChunkEncoder:
    """One encoder for a Python worker, kept between tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
