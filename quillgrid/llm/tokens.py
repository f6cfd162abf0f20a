"""Token ids of whole texts by the public tokenizers' files, with a cache of words.

The path of a file is a parameter; nothing is copied or trained here. A text
whose characters all are Latin ones of a fixed range is split by a plain
pattern and looked up word by word; any other text, and one that could hold a
special token, goes to the library as it is. Both ways give the same ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer, normalizers, pre_tokenizers

#: Beyond these, composition, lower case and character classes are left to the library.
BEYOND = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ſ]")
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
#: Words that a worker remembers; it then starts anew.
CACHED = 600_000
#: Code points that are split together.
TOGETHER = 2_000_000


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def plain(text: str) -> bool:
    return BEYOND.search(text) is None and "<|" not in text


class WordIds:
    """Ids by a tokenizer that splits lower-cased text into words and ends each word with a mark."""

    def __init__(self, path: str, end: str = "</w>") -> None:
        self.tokenizer = tokenizer(path)
        # words that are split and in lower case already need neither of the library's first steps
        self.of_words = Tokenizer.from_file(path)
        self.of_words.no_truncation()
        self.of_words.no_padding()
        self.of_words.normalizer = normalizers.Sequence([])
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(end)
        self.words: dict[str, bytes] = {}

    def by_library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Remember the ids of words, which the library gets in one call."""
        ids = np.array(self.of_words.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            self.words.update((w, self.by_library(w)) for w in words)
            return
        raw, at = ids.tobytes(), 0
        for w, cut in zip(words, (cuts * 4).tolist(), strict=True):
            self.words[w] = raw[at:cut]
            at = cut

    def some(self, texts: list[str]) -> list[bytes]:
        """Ids of some texts, whose unknown words are learnt together."""
        split = [WORDS.findall(t.lower()) if plain(t) else None for t in texts]
        if len(self.words) > CACHED:
            self.words.clear()
        new = dict.fromkeys(w for words in split if words for w in words if w not in self.words)
        if new:
            self.learn(list(new))
        known = self.words.__getitem__
        return [self.by_library(t) if words is None else b"".join(map(known, words)) for t, words in zip(texts, split, strict=True)]

    def all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers; some TOGETHER code points at a time."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= TOGETHER:
                yield from self.some(held)
                held, size = [], 0
        yield from self.some(held)

    def ids(self, text: str) -> bytes:
        return self.some([text])[0]


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
