"""Token ids of a word-level BPE tokenizer file, at the cost of one dictionary look-up a word.

Its pre-tokenizer never lets a merge cross a word, so the ids of a text are those of its words.
Words are cut by the file's own pattern, spelled out for characters below U+0180, where lower
casing, composition and the character classes are the same in every Unicode version; a text with
any other character, or with a special token's string, goes through the tokenizer whole.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from quillmesh.llm.worker_state import only

FAST_BELOW = 0x180
SPACE = "\t\n\x0b\x0c\r \x85\xa0"


def _ranges(kind: str) -> str:
    """A character class of all characters below FAST_BELOW of a general category."""
    codes = [c for c in range(FAST_BELOW) if unicodedata.category(chr(c))[0] == kind]
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


LETTER, NUMBER = _ranges("L"), _ranges("N")
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{re.escape(SPACE)}{LETTER}{NUMBER}]+")
#: Needs the tokenizer itself: characters outside the table, U+0130 (lower case is two characters), separators 1C-1F, special tokens.
SLOW = re.compile(f"[^\\x00-\\u{FAST_BELOW - 1:04x}]|İ|[\\x1c-\\x1f]|<\\|")


def needs_tokenizer(text: str) -> bool:
    """What SLOW finds; told by faster means where all characters are below U+0100."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return SLOW.search(text) is not None
    return "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f")


class WordIds:
    """texts -> their ids as little-endian unsigned 32-bit bytes.

    Words are looked up in a dictionary of at most `limit` of them; once it is full, what it lacks
    is encoded for the texts at hand and let go. Words that lack ids are encoded together as one
    text with single spaces, and told apart by the end-of-word mark of their last piece.
    """

    def __init__(self, path: str, limit: int = 600_000, chunk_chars: int = 2_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.chunk_chars = limit, chunk_chars
        self.cache: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(words):
            return [self._whole(w) for w in words]
        joined = ids.tobytes()
        return [joined[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _chunk(self, texts: list[str]) -> list[bytes]:
        cut = [None if needs_tokenizer(t) else WORDS.findall(t.lower()) for t in texts]
        cache = self.cache
        missing = [w for w in set().union(*(c for c in cut if c)) if w not in cache]
        if missing:
            cache.update(zip(missing, self._words(missing), strict=True))
        out = [self._whole(t) if c is None else b"".join(map(cache.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]
        if len(cache) > self.limit:
            for w in missing:
                del cache[w]
        return out

    def many(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        first = size = 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= self.chunk_chars:
                out += self._chunk(texts[first : k + 1])
                first, size = k + 1, 0
        return out + self._chunk(texts[first:])

    def ids(self, text: str) -> bytes:
        return self._chunk([text])[0]


def word_ids(path: str) -> WordIds:
    """One per Python worker."""
    return only(("word_ids", path), lambda: WordIds(path))
