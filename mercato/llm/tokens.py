"""Token ids of whole texts with a public tokenizer file and the ``tokenizers`` library.

For the word-level BPE files (NFC, white space collapsed, lower case, letters / single digits /
punctuation split apart) no token ever crosses ASCII white space, so a text is the concatenation
of its words. Each distinct word goes through the library once per Python worker and its ids are
kept in a bounded two-generation cache; a text then costs one dictionary lookup per word. Files
with any other layout are encoded text by text.
"""

from __future__ import annotations

import json
import os
import struct

import regex

WORD_BPE = "word_bpe_49k.json"

# The layout for which splitting at ASCII white space is exact.
_WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_FROM_U0300 = bytes(range(0xCC, 0x100))      # lead bytes of characters from U+0300 on
_BELOW_U0300 = bytes(range(0, 0xCC))
_CONTROL = regex.compile("[\x00-\x20\x7f-\xa0]")
_PIECES = regex.compile(_WORD_PATTERN)


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for
    the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_ALPHABET = _byte_alphabet()


def _pack(ids: list[int]) -> bytes:
    return struct.pack("<%dI" % len(ids), *ids)


class _WordIds(dict):
    """word (bytes) -> packed ids, filled on demand; at most two generations of ``limit`` words."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """``encode(text)`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` as
    little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cached_words: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.by_words = self._is_word_layout(json.loads(self.tokenizer.to_str()))
        self.plain = _WordIds(self._plain_word, cached_words)
        self.lowered = _WordIds(self._lowered_word, cached_words)

    @staticmethod
    def _is_word_layout(spec: dict) -> bool:
        norm = (spec.get("normalizer") or {}).get("normalizers", [])
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        added = spec.get("added_tokens", [])
        return ([n.get("type") for n in norm] == _WORD_NORMALIZERS
                and norm[1].get("pattern") == {"Regex": r"\s+"} and norm[1].get("content") == " "
                and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
                and pre[0].get("pattern") == {"Regex": _WORD_PATTERN}
                and pre[0].get("behavior") == "Removed" and pre[0].get("invert") is True
                and pre[1].get("add_prefix_space") is False and pre[1].get("use_regex") is False
                and spec["model"].get("type") == "BPE" and not spec.get("post_processor")
                and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]
                            or not a["content"].startswith("<|") or " " in a["content"]
                            for a in added))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_words:
            return self._whole(text)
        data = text.encode("utf-8", "surrogatepass")
        if b"<|" in data or data.translate(None, _BELOW_U0300):
            return b"".join(map(self.plain.__getitem__, data.split()))
        # no added token can occur and nothing composes, so ASCII may be lower-cased first
        return b"".join(map(self.lowered.__getitem__, data.lower().split()))

    def _whole(self, text: str) -> bytes:
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _plain_word(self, word: bytes) -> bytes:
        return self._whole(word.decode("utf-8", "surrogatepass"))

    def _lowered_word(self, word: bytes) -> bytes:
        text = word.decode("utf-8").lower()
        if text.isalpha():
            return self._piece(text)
        if _CONTROL.search(text):
            return self._plain_word(word)
        pieces = _PIECES.findall(text)
        if len(pieces) == 1:
            return self._piece(pieces[0])
        return b"".join(self.lowered[p.encode()] if p.isalpha() else self._piece(p)
                        for p in pieces)

    def _piece(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() else "".join(_ALPHABET[b] for b in piece.encode())
        return _pack([t.id for t in self.model.tokenize(symbols)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str = WORD_BPE) -> Encoder:
    """The worker's encoder for a tokenizer file: a path, or the name of a public file."""
    if tokenizer not in _ENCODERS:
        path = tokenizer
        if not os.path.exists(path):
            import public_tokenizers
            path = public_tokenizers.path(tokenizer)
        _ENCODERS[tokenizer] = Encoder(str(path))
    return _ENCODERS[tokenizer]
