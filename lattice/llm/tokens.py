"""Token ids of whole texts, by the tokenizers library, at corpus speed.

Texts of one corpus repeat their words, so each worker keeps the ids of the
space-separated chunks it has met and only hands new ones to the tokenizer.
A text is cut only where the tokenizer itself always cuts (see ``Encoder``),
so the ids are those of the whole text.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import regex

#: White space that ends a chunk: a cut after it would change byte-level pre-tokens.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　] ")
_CUT = re.compile(r"(?<=\S)(?= )")
#: Chunks of printable ASCII, line feeds and composed Latin letters are cut here, by the two tokenizers' pre-token patterns; all others go to the tokenizer whole.
_PLAIN = re.compile("[\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_KEEPING = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_DROPPING = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""")
#: Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the characters from 256 on, in order.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_KEEPS = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_DROPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _DROPPING.pattern}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _OWN)}


def space_parts(text: str) -> list[str]:
    """``text`` cut before each space that follows something other than white space; the chunks after the first go without that space."""
    if "  " in text or text[-1] == " " or "\n " in text or any(x in text for x in ("\t ", "\r ", "\v ", "\f ")) or not text.isascii() and _ODD_SPACE.search(text):
        return [x[1:] if i else x for i, x in enumerate(_CUT.split(text))]
    return text.split(" ")


class _Codes(dict):
    """Chunk -> number; new chunks get the next number and wait in ``fresh``."""

    def __init__(self, numbers: list[int], fresh: list[str], lead: str):
        super().__init__()
        self.numbers, self.fresh, self.lead = numbers, fresh, lead

    def __missing__(self, chunk: str) -> int:
        code = self.numbers[0]
        self.numbers[0] += 1
        self.fresh.append(self.lead + chunk)
        if len(chunk) <= 64:  # longer ones would fill the cache and hardly come again
            self[chunk] = code
        return code


class Encoder:
    """Ids of texts by the tokenizer in ``file``, each followed by ``end``.

    A byte-level tokenizer's pre-tokens never hold a space after a character
    that isn't white space, so a text may be cut before such spaces. A tokenizer
    that drops white space allows a cut at any space. Texts go whole to a
    tokenizer of any other make (normalizer, pre-tokenizer or special tokens that
    take in spaces). Strings of special tokens in a text become their ids, as the
    library does by itself. ``most`` bounds the chunks kept.
    """

    def __init__(self, file: str, end: int, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.vocab = self.tokenizer.get_vocab_size()
        stages = json.loads(self.tokenizer.to_str())
        make, added = (stages["normalizer"], stages["pre_tokenizer"]), stages["added_tokens"]
        simple = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or re.search(r"\s", x["content"]) for x in added)
        self.keeps_space = make == _KEEPS
        self.is_usual = simple and make in (_KEEPS, _DROPS) and not stages["model"].get("ignore_merges") and not stages["model"].get("dropout")
        self.special = re.compile("|".join(re.escape(x["content"]) for x in added) or r"(?!)").search
        self.end, self.most = end, most
        self._clear()

    def _clear(self) -> None:
        numbers, self.fresh = [1], []  # 0 is the end id
        self.first, self.later = _Codes(numbers, self.fresh, ""), _Codes(numbers, self.fresh, " " if self.keeps_space else "")
        self.pieces, self.ids, self.ends = {}, array("i", [self.end]), array("q", [0, 1])

    def _add(self, text: str, flat: list[int]) -> None:
        """Append the numbers of the text's chunks."""
        if not self.is_usual:
            flat.append(self.first[text])
            return
        if not self.keeps_space:
            flat.extend(map(self.later.__getitem__, text.replace("\n", " ").split(" ")))
            return
        parts = space_parts(text)
        flat.append(self.first[parts[0]])
        flat.extend(map(self.later.__getitem__, parts[1:]))

    def _learn(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk; plain ones are cut into pre-tokens, each of which goes through the tokenizer's model."""
        out: list = [None] * len(chunks)
        rest, known, model = [], self.pieces, self.tokenizer.model
        if len(known) > 200_000:
            known.clear()
        pattern, lower = (_KEEPING, False) if self.keeps_space else (_DROPPING, True)
        plain = _PLAIN.fullmatch
        for i, chunk in enumerate(chunks):
            if not self.is_usual or not plain(chunk) or self.special(chunk):
                rest.append(i)
                continue
            ids = out[i] = []
            for piece in pattern.findall(chunk.lower() if lower else chunk):
                have = known.get(piece)
                if have is None:
                    as_bytes = piece.replace(" ", "\u0120").replace("\n", "\u010a") if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_CHARS)
                    have = known[piece] = [x.id for x in model.tokenize(as_bytes)]
                ids += have
        for i, x in zip(rest, self.tokenizer.encode_batch([chunks[i] for i in rest], add_special_tokens=False)):
            out[i] = x.ids
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one array and the bounds of each text's, end id included. Null counts as empty."""
        on = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and a collection goes through all that is kept
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.later) + len(self.first) > self.most:
            self._clear()
        flat: list[int] = []
        bounds = [0]
        for text in texts:
            if text:
                self._add(text, flat)
            flat.append(0)
            bounds.append(len(flat))
        for found in self._learn(self.fresh):
            self.ids.extend(found)
            self.ends.append(len(self.ids))
        self.fresh.clear()
        ids, ends = np.frombuffer(self.ids, np.int32), np.frombuffer(self.ends, np.int64)
        code = np.array(flat, np.int64)
        size = ends[code + 1] - ends[code]
        to = np.cumsum(size)
        out = ids[np.repeat(ends[code] - (to - size), size) + np.arange(to[-1] if len(to) else 0)].astype(np.uint32)
        return out, np.concatenate([[0], to])[np.array(bounds)]


@lru_cache(maxsize=2)
def encoder(file: str, end: int) -> Encoder:
    """This worker's encoder."""
    return Encoder(file, end)
