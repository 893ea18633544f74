"""Token ids of a public tokenizer file, looked up word by word.

The vocabulary drops white space, and neither its normalizer nor its splitting pattern looks across a space, so a text's ids
are the ids of its words in order. Words of ASCII and Latin letters go through the model of the `tokenizers` library
with two bounded caches, of words and of their parts; any other word is encoded by the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np
from tokenizers import Tokenizer

#: Words of these characters are split here: ASCII, and the Latin letters (with × and ÷ among them) whose small forms are one character each.
PLAIN = re.compile(r"[!-~À-įı-ſ]+")
#: Fixed value of the vocabulary file: its splitting pattern, over small PLAIN characters.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """encode(text): the ids of the whole text, then end_id. Caches stop growing at cache_words entries."""

    def __init__(self, path: str, end_id: int | None = 1, cache_words: int = 500_000):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = byte_letters()
        self.limit = cache_words
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        if any("<" not in s for s in self.special):
            raise ValueError("a special token without <")
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _plain(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return self._bytes([t.id for t in self.model.tokenize(shown)])

    def _part(self, part: str) -> bytes:
        out = self._plain(part)
        if len(self.parts) < self.limit:
            self.parts[part] = out
        return out

    def _word(self, word: str) -> bytes:
        known = self.parts
        if word.isascii() and word.isalpha():
            small = word.lower()  # one part, so it is kept among the words alone
            out = self.words.get(small) or known.get(small) or self._plain(small)
            if small != word and len(self.words) < self.limit and len(small) <= 64:
                self.words[small] = out
        elif PLAIN.fullmatch(word) and not ("<" in word and any(s in word for s in self.special)):
            small = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()
            out = b"".join([known.get(p) or self._part(p) for p in SPLIT.findall(small)])
        else:
            out = self._bytes(self.whole.encode(word, add_special_tokens=False).ids)
        if len(self.words) < self.limit and len(word) <= 64:
            self.words[word] = out
        return out

    def raw(self, text: str | None) -> bytes:
        known = self.words
        if text and "\n" in text:
            text = text.replace("\n", " ")
        words = text.split(" ") if text else []
        return b"".join([known[w] if w in known else self._word(w) for w in words]) + self.end

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), self.dtype)

    def encode_all(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        return [self.encode(t) for t in texts]
