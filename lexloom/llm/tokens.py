"""Token ids of texts by a public tokenizer, cached by word.

A byte-level BPE never joins a blank to the word before it, so a text may be cut before each run of
blanks and the words encoded apart. Words repeat, so most come from a bounded cache. Words not in
the cache are merged by tiktoken with the ranks of the same tokenizer file, which is several times
as fast on single words as the file's own library; a file of another form goes through its own
library. tests/llm/test_exact.py holds all of this against whole-text encoding by `tokenizers`.
"""

from __future__ import annotations

import json as jsons
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: The split of byte-level BPE, a fixed value of the format.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Python takes these four as blanks, the tokenizer doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_PART = re.compile(r"\s*\S+|\s+")
#: With none of these in a text, each single space begins a word.
_UNEVEN = re.compile(r"\s\s|^\s|\s$|[\x1c-\x1f]")
MAX_CACHED = 400_000
MAX_WORD = 48


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file's text, read once on the driver and sent to the tasks (1.6 MB)."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def parts(text: str) -> list[str]:
    """text cut where no token can cross; joined, they are the text again."""
    return [text] if _SEPARATORS.search(text) else _PART.findall(text)


def _printable_bytes() -> dict[str, int]:
    """Byte by the character that stands for it in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(json: str):
    """A function from text to ids."""
    form = jsons.loads(json)
    before, special = form.get("pre_tokenizer") or {}, [t["content"] for t in form.get("added_tokens", [])]
    own = Tokenizer.from_str(json)
    if form["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or form.get("normalizer") or form.get("post_processor"):
        return lambda text: own.encode(text, add_special_tokens=False).ids
    byte = _printable_bytes()
    ranks = {bytes(byte[c] for c in k): v for k, v in form["model"]["vocab"].items() if k not in special}
    fast = tiktoken.Encoding("same", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if any(s in text for s in special):
            return own.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


class Encoder(dict):
    """Little-endian unsigned 32-bit ids by word; a key stands for a space and itself."""

    def __init__(self, json: str):
        super().__init__()
        self._encode = encoder(json)

    def __missing__(self, word: str) -> bytes:
        ids = self.whole(" " + word)
        if len(word) <= MAX_WORD:
            if len(self) >= MAX_CACHED:
                self.clear()
            self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self._encode(text), "<u4").tobytes()

    def part(self, part: str) -> bytes:
        """Ids of one of parts()."""
        return self[part[1:]] if part[:1] == " " and part[1:2] != " " else self.whole(part)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if _UNEVEN.search(text):
            return b"".join(map(self.part, parts(text)))
        first, *words = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, words))

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4
