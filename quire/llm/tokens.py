"""Encoders of whole texts by the vocabularies of public tokenizers, on the executors.

A text is cut before each space, and the ids of each chunk, and of each pre-token in it, are remembered. The pre-tokenisers
here cut before a space as well, whatever comes before it, unless two spaces are neighbours or the text ends in one; such
texts go to the library as a whole, and so do chunks that aren't plain Latin text.
"""

from __future__ import annotations

import base64
import ctypes
import gc
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa

#: Characters whose classes are the same to every regular-expression library, and which Unicode composition leaves alone.
_ODD = re.compile("[^\n\x20-\x7e¡-¬®-įĲ-ſ]")


#: Keys of more characters aren't remembered, so that a memory's bytes are bounded too.
LONG = 64


class Memory(dict):
    """Forgets what wasn't asked for in the last `size` or more new keys."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > LONG:
                return found
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def _ids(ids) -> bytes:
    return array("I", ids).tobytes()


class RankEncoder:
    """tiktoken's encoding by a rank file; encode() gives little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.first = Memory(lambda p: _ids(self.lib.encode_ordinary(p)), 50_000)
        self.spaced = Memory(lambda p: _ids(self.lib.encode_ordinary(" " + p)), 120_000)

    def ends(self, text: str) -> list[int]:
        """Where each pre-token ends."""
        return [m.end() for m in self.pattern.finditer(text)]

    def encode(self, text: str) -> bytes:
        if uncuttable(text):
            return _ids(self.lib.encode_ordinary(text))
        first, *rest = text.split(" ")
        return self.first[first] + b"".join(map(self.spaced.__getitem__, rest))

    def raw(self) -> list[bytes]:
        """The bytes of each id."""
        table = [b""] * (max(self.ranks.values()) + 1)
        for raw, i in self.ranks.items():
            table[i] = raw
        return table


class JsonEncoder:
    """The tokenizers library's encoding by a JSON file, without special tokens: their strings are ordinary text. size: how many chunks that follow
    a space are remembered, and two thirds as many pre-tokens."""

    def __init__(self, path: str, size: int = 150_000):
        import json

        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        split = [x["pattern"]["Regex"] for x in steps if x["type"] == "Split"]
        self.words = bool(split)  # white space is dropped, letters are lower-cased
        self.known = not self.words and spec["normalizer"] is None or self.words and [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.pattern = regex.compile(split[0] if split else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.letters = _byte_letters()
        self.model = self.lib.model
        self.token = Memory(self._token, size * 2 // 3)
        self.first = Memory(self._piece, 50_000)
        self.spaced = Memory(self._piece if self.words else lambda p: self._piece(" " + p), size)

    def _token(self, word: str) -> bytes:
        return _ids([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))])

    def _piece(self, text: str) -> bytes:
        if not self.known or _ODD.search(text):
            return _ids(self.lib.encode(text, add_special_tokens=False).ids)
        if self.words:
            text = text.lower()
        if text[text[:1] == " " :].isalpha():
            return self.token[text]
        if text[text[:1] == " " : -1].isalpha() and text[-1] in ".,":
            return self.token[text[:-1]] + self.token[text[-1]]
        return b"".join(map(self.token.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        if self.words:
            return b"".join(map(self.spaced.__getitem__, text.replace("\n", " ").split(" ")))
        if uncuttable(text):
            return _ids(self.lib.encode(text, add_special_tokens=False).ids)
        first, *rest = text.split(" ")
        return self.first[first] + b"".join(map(self.spaced.__getitem__, rest))


def uncuttable(text: str) -> bool:
    return "  " in text or text.endswith(" ")


def _byte_letters() -> dict[int, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself if visible, else the next from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def rank_encoder(path: str, pattern: str) -> RankEncoder:
    return RankEncoder(path, pattern)


@lru_cache(maxsize=2)
def json_encoder(path: str, size: int = 150_000) -> JsonEncoder:
    return JsonEncoder(path, size)


def forget() -> None:
    """Lets go of the encoders that earlier tasks have left in a worker, which are of no use to an operator without tokens."""
    if any(f.cache_info().currsize for f in (rank_encoder, json_encoder)):
        rank_encoder.cache_clear()
        json_encoder.cache_clear()
        gc.collect()
    trim()


def tidy(run: Callable) -> Callable:
    """run, a function of batches; before and after it, the worker gives back to the system what it doesn't hold any more. Workers are used
    again, and idle ones stay: what each has kept of its largest task adds up in an executor."""

    def tidied(batches: Iterator) -> Iterator:
        forget()
        yield from run(batches)
        trim()

    return tidied


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
